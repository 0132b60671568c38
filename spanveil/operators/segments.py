"""Texts made of ordered segments: joining, offsets, and mapping findings back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import count_while, normalise_newlines, with_computed, with_starts
from .carry import last_before, running_sum
from .detect import detect

# A part's own characters.
PART_CHARS = 1 << 20
# Characters that no pass can have inside a match: matches and their conflicts never cross one.
BREAK = r"[!?;\"'()\[\]{}<>=*&^$#~|\\`]"
# At least the widest context window of a pass.
HALO_CHARS = 128


def segment_offsets(df: DataFrame, key: str, order: str, text_col: str, chunk_size: int = 1024) -> DataFrame:
    """Segments table: key, order, half-open offsets in the joined text, segment text."""
    df = df.withColumn(text_col, normalise_newlines(F.col(text_col)))
    chunk = F.floor(F.col(order) / chunk_size)
    df = running_sum(df, [key], [order], chunk, F.length(text_col), "start")
    return df.withColumn("end", F.col("start") + F.length(text_col))


def _part_bounds(placed: DataFrame, key: str, part_chars: int, halo_chars: int) -> DataFrame:
    """Parts ``key, part, lo, hi``: their own segments' stretch, widened to a break and a context window.

    A part owns the segments that start in its stretch of ``part_chars`` characters.  On either
    side it goes on to the next break, however far that is, and ``halo_chars`` beyond.
    """
    # A segment's first break and the one after its last, by place in the whole text.
    first = F.regexp_instr("segment", F.lit(BREAK))
    last = F.when(first > 0, F.length(F.regexp_extract("segment", rf"(?s)\A.*({BREAK})", 0)))
    marked = placed.select(
        key, "seg_no", "start", "end", F.floor(F.col("start") / part_chars).alias("part"),
        F.when(first > 0, F.col("start") + first).alias("first_break"), (F.col("start") + last).alias("last_break"),
    )
    own = marked.groupBy(key, "part").agg(
        F.min("start").alias("a"), F.max("end").alias("b"), F.min("first_break").alias("first_break"), F.max("last_break").alias("last_break")
    )
    # One row per part: the last break of the parts before it, the first one of the parts after it.
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(key).orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    return own.select(
        key, "part", "a", "b",
        F.greatest(F.lit(0), F.coalesce(F.max("last_break").over(before), F.lit(0)) - halo_chars).alias("lo"),
        (F.coalesce(F.min("first_break").over(after), F.max("b").over(Window.partitionBy(key))) + halo_chars).alias("hi"),
    )


def _long_parts(placed: DataFrame, key: str, part_chars: int, halo_chars: int) -> DataFrame:
    """``key, part, s``: the segments of each part of long texts, cut to the stretch that the part sees."""
    bounds = _part_bounds(placed, key, part_chars, halo_chars)
    # Bins of part_chars characters bring parts and segments together; a pair is taken in its first bin.
    seen = bounds.withColumn("bin", F.explode(F.expr(f"sequence(lo div {part_chars}, greatest(lo, hi - 1) div {part_chars})")))
    lies = placed.select(
        key, "seg_no", F.col("start").alias("s0"), F.col("end").alias("s1"),
        F.explode(F.expr(f"sequence(start div {part_chars}, greatest(start, end - 1) div {part_chars})")).alias("bin"),
    )
    pairs = (
        seen.join(lies, [key, "bin"]).where(f"bin = greatest(s0, lo) div {part_chars} AND (s0 < hi AND s1 > lo OR s0 div {part_chars} = part)")
        .selectExpr(f"`{key}`", "part", "seg_no", "s0", f"s0 div {part_chars} = part AS own", "greatest(lo - s0, 0) AS cut", "least(s1, greatest(hi, b)) - s0 AS until")
    )
    cut = pairs.join(placed.select(key, "seg_no", "segment"), [key, "seg_no"]).select(
        key, "part", "seg_no", "own", F.when(F.col("own"), 0).otherwise(F.col("cut")).cast("int").alias("cut"),
        F.expr("CASE WHEN own THEN segment ELSE substring(segment, cast(cut AS int) + 1, cast(greatest(until - cut, 0) AS int)) END").alias("segment"),
    )
    return cut.groupBy(key, "part").agg(F.array_sort(F.collect_list(F.struct("seg_no", "segment", "own", "cut"))).alias("s"))


def joined_parts(
    df: DataFrame, key: str, order: str, text_col: str, *, part_chars: int = PART_CHARS, halo_chars: int = HALO_CHARS
) -> DataFrame:
    """Join the ordered segments of each key into texts: key, part, text, segments.

    ``order`` is an ordinal from 0.  A key of at most ``part_chars`` characters is one text.  A
    longer one is cut into parts at segment borders.  Each part also carries what it must see of its
    neighbours: up to the next character that can't be inside a match, and ``halo_chars`` (a context window) beyond.
    A match, and a chain of matches that rule each other out, lie between two such characters; so
    the part that owns the segment where a finding starts (``segments.own``) finds what the whole
    text would give, however long matches are.  Passes of one's own must keep to ``BREAK`` too.
    """
    rows = df.select(key, F.col(order).alias("seg_no"), normalise_newlines(F.col(text_col)).alias("segment"))
    total = rows.groupBy(key).agg(F.sum(F.length("segment")).alias("__total"))
    rows = rows.join(total, key)
    whole = (
        rows.where(F.col("__total") <= part_chars).groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("seg_no", "segment", F.lit(True).alias("own"), F.lit(0).alias("cut")))).alias("s"))
        .select(key, F.lit(0).cast("long").alias("part"), "s")
    )
    placed = segment_offsets(rows.where(F.col("__total") > part_chars).drop("__total"), key, "seg_no", "segment")
    grouped = whole.unionByName(_long_parts(placed, key, part_chars, halo_chars))
    grouped = with_starts(grouped.withColumn("__segments", F.expr("transform(s, x -> x.segment)")), "__segments", "__starts")
    segments = """transform(s, (x, i) -> named_struct('seg_no', x.seg_no, 'start', __starts[i],
        'end', __starts[i] + length(x.segment), 'own', x.own, 'cut', x.cut))"""
    return grouped.select(
        key, "part", F.expr("array_join(__segments, '')").alias("text"), F.expr(segments).alias("segments")
    )


def _passed(op: str, point: str) -> str:
    """SQL for the number of segments whose end is ``op`` a point: whole blocks first, then inside one block."""
    return f"""transform(array(size(filter(__tops, e -> e {op} {point}))),
        k -> k * __block + size(filter(slice(__ends, k * __block + 1, __block), e -> e {op} {point})))[0]"""


def segment_findings(df: DataFrame, key: str, order: str, text_col: str, **options) -> DataFrame:
    """Findings of segmented texts with the segment each one starts and ends in.

    Offsets are local to the segments: ``start`` in ``start_seg``, ``end`` in ``end_seg``.  The
    segments of a finding are looked up inside the row: by blocks of about sqrt(n) segments.
    """
    sizes = {k: options.pop(k) for k in ("part_chars", "halo_chars") if k in options}
    found = detect(joined_parts(df, key, order, text_col, **sizes), "text", **options)
    found = with_computed(found, "__ends", "transform(segments, g -> g.end)")
    found = with_computed(found, "__block", "greatest(1, cast(sqrt(size(__ends)) AS int))")
    found = with_computed(found, "__tops", "transform(slice(__ends, 1, size(__ends) div __block), (e, k) -> __ends[(k + 1) * __block - 1])")
    placed = with_computed(
        found, "placed",
        f"""transform(findings, f -> named_struct('f', f, 's', segments[{_passed('<=', 'f.start')}],
            'e', segments[{_passed('<', 'f.end')}]))""",
    )
    rows = placed.select(key, F.explode_outer("placed").alias("p")).where("p.s.own")
    return rows.select(
        key, F.col("p.s.seg_no").alias("start_seg"), F.col("p.e.seg_no").alias("end_seg"),
        "p.f.type", "p.f.text", (F.col("p.f.start") - F.col("p.s.start") + F.col("p.s.cut")).alias("start"),
        (F.col("p.f.end") - F.col("p.e.start") + F.col("p.e.cut")).alias("end"), "p.f.confidence", "p.f.severity",
    )


def findings_to_segments(findings: DataFrame, segments: DataFrame, key: str, seg: str = "seg_no", chunk_chars: int = 1 << 16) -> DataFrame:
    """Map a findings table onto a segments table by offsets.

    The start belongs to the segment of its character, the end to that of the last one.  Segments
    and points lie in one order of places, and each point takes the last segment that began before
    it.  That is done in chunks of places, so no key is sorted in one task.
    """
    begins = segments.where(F.col("end") > F.col("start")).select(
        key, F.col("start").cast("long").alias("__at"), F.lit(0).alias("__kind"), F.struct(F.col(seg).alias("seg"), F.col("start").alias("base")).alias("__seg"),
    )

    def locate(rows: DataFrame, place: Column, name: str) -> DataFrame:
        names = rows.columns
        points = rows.select(key, place.cast("long").alias("__at"), F.lit(1).alias("__kind"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"))
        both = begins.unionByName(points, allowMissingColumns=True)
        chunk = F.floor(F.col("__at") / chunk_chars)
        found = last_before(both, [key], ["__at", "__kind"], chunk, {"__held": F.col("__seg")}).where("__kind = 1 AND __held IS NOT NULL")
        return found.select("__row.*", F.col("__held.seg").alias(f"{name}_seg"), F.col("__held.base").alias(f"{name}_base"))

    placed = locate(locate(findings, F.col("start"), "start"), F.col("end") - 1, "end")
    return (
        placed.withColumn("local_start", F.col("start") - F.col("start_base"))
        .withColumn("local_end", F.col("end") - F.col("end_base"))
        .drop("start_base", "end_base")
    )


def in_segments(df: DataFrame, segments: str, findings: str = "findings") -> DataFrame:
    """Add to each finding the numbers of the segments it starts and ends in, and its offsets there, inside the row.

    ``segments`` is an array of ``(start, end, ...)`` without empty ones, in the order of the text.
    """
    first, last = count_while(segments, "__x.end <= f.start"), count_while(segments, "__x.end < f.end")
    fields = "'start', f.start, 'end', f.end, 'type', f.type, 'text', f.text, 'confidence', f.confidence, 'severity', f.severity"
    made = f"""transform(transform({findings}, f -> named_struct('f', f, 'a', {first}, 'b', {last})), p -> transform(array(p.f), f -> named_struct({fields},
        'start_seg', CAST(p.a AS bigint), 'end_seg', CAST(p.b AS bigint),
        'local_start', f.start - get({segments}, p.a).start, 'local_end', f.end - get({segments}, p.b).start))[0])"""
    return with_computed(df, findings, made)


def raw_offset(raw_text: str, position: str) -> str:
    """SQL turning an offset in newline-normalised text into one in the raw text.

    Each ``\\r\\n`` before the position stands for one character more.
    """
    pairs = f"split({raw_text}, '\\r\\n')"
    # Piece i ends, in normalised text, before the (i + 1)th pair; count the pairs passed.
    passed = f"""aggregate(slice({pairs}, 1, size({pairs}) - 1),
        named_struct('pos', 0, 'n', 0),
        (__acc, __piece) -> named_struct('pos', __acc.pos + length(__piece) + 1,
            'n', __acc.n + CASE WHEN __acc.pos + length(__piece) + 1 <= {position} THEN 1 ELSE 0 END),
        __acc -> __acc.n)"""
    return f"({position} + {passed})"


def with_raw_offsets(df: DataFrame, raw_col: str, findings: str = "findings") -> DataFrame:
    """Add ``raw_start`` and ``raw_end`` to each finding of a newline-normalised text.

    The places of the ``\\r\\n`` pairs are worked out once per text, and each offset looks up, by
    halving, how many of them are before it.
    """
    df = with_starts(df.withColumn("__pieces", F.split(F.coalesce(F.col(raw_col), F.lit("")), "\r\n")), "__pieces", "__starts")
    # Piece i begins, in normalised text, i characters later than in the joined pieces: after its pair.
    df = with_computed(df, "__pairs", "transform(slice(__starts, 2, size(__starts)), (s, i) -> s + i + 1)")
    raw = lambda p: f"{p} + {count_while('__pairs', f'__x <= {p}')}"
    # The end of a span belongs to its last character.
    fields = "'start', f.start, 'end', f.end, 'type', f.type, 'text', f.text, 'confidence', f.confidence, 'severity', f.severity"
    made = f"transform({findings}, f -> named_struct({fields}, 'raw_start', {raw('f.start')}, 'raw_end', {raw('(f.end - 1)')} + 1))"
    return with_computed(df, findings, made).drop("__pieces", "__starts", "__pairs")
