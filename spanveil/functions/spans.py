"""Regular-expression matches with positions, as a row-local SQL expression.

The expressions here are built as SQL text: one detector is dozens of nodes, and a single
parse is far cheaper than as many calls from Python into the JVM.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Three private-use characters delimit matches inside the scanned text.
OPEN, MID, CLOSE = "\ue000", "\ue001", "\ue002"
_MARKS = OPEN + MID + CLOSE

BUFFER = 256
MATCH_TYPE = "array<struct<start:int,end:int,text:string,before:string,after:string>>"


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def collector(items: str) -> tuple[str, str]:
    """Initial ``buf``/``out`` fields of an accumulator that gathers array elements.

    Appending to one growing array copies it each time.  Elements go to a small buffer that
    is moved to ``out`` when full, so gathering k elements copies far fewer than k * k.
    """
    return f"CAST(array() AS {items})", f"CAST(array() AS array<{items}>)"


def push(item: str) -> str:
    """``buf``/``out`` fields of accumulator ``acc`` with one more element."""
    full = f"size(acc.buf) >= {BUFFER - 1}"
    return (
        f"'buf', CASE WHEN {full} THEN slice(acc.buf, 1, 0) ELSE acc.buf || array({item}) END, "
        f"'out', CASE WHEN {full} THEN acc.out || array(acc.buf || array({item})) ELSE acc.out END"
    )


GATHERED = "flatten(acc.out || array(acc.buf))"


def count_while(array: str, holds: str) -> str:
    """SQL for the number of leading elements ``__x`` of an array for which ``holds`` is true, by halving.

    ``holds`` must be true up to some element and false from there on.
    """
    middle = "(__h.lo + __h.hi) div 2"
    return f"""aggregate(sequence(1, length(bin(size({array})))), named_struct('lo', 0L, 'hi', CAST(size({array}) AS bigint)),
        (__h, __i) -> CASE WHEN __h.lo >= __h.hi THEN __h
            WHEN transform(array(get({array}, CAST({middle} AS int))), __x -> {holds})[0] THEN named_struct('lo', {middle} + 1, 'hi', __h.hi)
            ELSE named_struct('lo', __h.lo, 'hi', {middle}) END,
        __h -> CAST(__h.lo AS int))"""


def one_of(x: str, terms) -> str:
    return f"{x} IN ({', '.join(quoted(t) for t in terms)})"


def with_computed(df: DataFrame, name: str, sql: str) -> DataFrame:
    """Add or replace a column whose expression must run once per row.

    Filters on an ordinary computed column are pushed below it, with the whole expression
    repeated inside each of them.  A column that comes out of a one-element explode stays
    where it is: it is computed once, however often later steps refer to it.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c != name]
    return df.select(*kept, F.explode_outer(F.array(F.expr(sql))).alias(name))


def with_starts(df: DataFrame, pieces: str, out: str) -> DataFrame:
    """Add the place of each piece in the text that an array of pieces joins to.

    ``aggregate`` copies its whole state at each step, so running sums are not gathered with it.
    Lengths are summed by blocks of about sqrt(n) pieces; a place is a sum of blocks and of the
    pieces before it in its own block.
    """
    add = "0, (a, x) -> a + x"
    df = with_computed(df, "__lengths", f"transform({pieces}, p -> length(p))")
    df = with_computed(df, "__block", "greatest(1, cast(sqrt(size(__lengths)) AS int))")
    df = with_computed(
        df, "__sums",
        f"transform(sequence(0, size(__lengths) div __block), k -> aggregate(slice(__lengths, k * __block + 1, __block), {add}))",
    )
    starts = f"""transform(__lengths, (n, i) -> aggregate(slice(__sums, 1, i div __block), {add})
        + aggregate(slice(__lengths, (i div __block) * __block + 1, i % __block), {add}))"""
    return with_computed(df, out, starts).drop("__lengths", "__block", "__sums")


def normalise_newlines(text: Column) -> Column:
    """``\\r\\n`` and lone ``\\r`` become ``\\n``; null becomes the empty string."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.contains("\r"), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def scan_form(text: Column) -> Column:
    """Replace the delimiter characters, should a text hold them; offsets stay the same."""
    marked = text.contains(OPEN) | text.contains(MID) | text.contains(CLOSE)
    return F.when(marked, F.translate(text, _MARKS, "\ufffd" * 3)).otherwise(text)


#: Up to so many matches are placed by the pieces around them, which for many would be quadratic; the first few are written out.
FEW, WRITTEN_OUT = 16, 3


def matches(text: str, pattern: str, before: int = 0, after: int = 0) -> str:
    """SQL for all leftmost, non-overlapping matches of ``pattern`` with code-point offsets.

    ``before``/``after`` are the widths of the context windows to carry with each match.
    Each match is put between marks and the marked text is split.  Up to ``FEW`` matches are
    placed by the pieces before and after them; more go through ``_many_matches``.
    """
    if re.search(r"(?<!\\)\((?!\?)", pattern):
        raise ValueError("groups inside a detector pattern must be non-capturing")

    def match(start: str, piece: str, behind: str, ahead: str) -> str:
        tail, head = f"substring({behind}, -{before})" if before else "''", f"substring({ahead}, 1, {after})" if after else "''"
        return f"named_struct('start', {start}, 'end', {start} + length({piece}), 'text', {piece}, 'before', {tail}, 'after', {head})"

    def pieces(first: int, last: int) -> list[str]:
        return [f"__p[{k}]" for k in range(first, last)]

    written_out = " ".join(
        f"WHEN {2 * n + 1} THEN array(" + ", ".join(
            match(f"({' + '.join(f'length({x})' for x in pieces(0, k))})", f"__p[{k}]", f"({' || '.join(pieces(0, k))})", f"({' || '.join(pieces(k + 1, 2 * n + 1))})")
            for k in range(1, 2 * n + 1, 2)
        ) + ")"
        for n in range(1, WRITTEN_OUT + 1)
    )
    piece, behind, ahead = "get(__p, 2 * __i + 1)", "array_join(slice(__p, 1, 2 * __i + 1), '')", f"array_join(slice(__p, 2 * __i + 3, {2 * FEW}), '')"
    return f"""transform(array(split(regexp_replace({text}, {quoted(pattern)}, '{OPEN}$0{OPEN}'), '{OPEN}')), __p -> CASE size(__p)
        WHEN 1 THEN CAST(array() AS {MATCH_TYPE}) {written_out}
        ELSE CASE WHEN size(__p) <= {2 * FEW + 1}
            THEN transform(sequence(0, size(__p) div 2 - 1), __i -> {match(f"length({behind})", piece, behind, ahead)})
            ELSE {_many_matches(text, pattern, before, after)} END END)[0]"""


def _many_matches(text: str, pattern: str, before: int, after: int) -> str:
    """``matches`` for any number of them.

    Each match is marked in place together with the text that follows it, the marked text
    is split, and one pass over the pieces adds up their lengths.  Work is linear in the
    text; no window is cut out of the full text by position.
    """
    ahead = f"(?=([\\s\\S]{{0,{after}}}))" if after else ""
    mark = f"{OPEN}{'$2' if after else ''}{MID}$1{CLOSE}"
    buf, out = collector(MATCH_TYPE)
    hit = """named_struct('start', acc.pos, 'end', acc.pos + length(piece), 'text', piece,
                          'before', acc.tail, 'after', acc.ahead)"""
    tail = f"right(acc.tail || piece, {before})" if before else "''"
    return f"""aggregate(
        split(regexp_replace({text}, {quoted(f'({pattern}){ahead}')}, '{mark}'), '[{_MARKS}]'),
        named_struct('pos', 0, 'turn', 0, 'tail', '', 'ahead', '', 'buf', {buf}, 'out', {out}),
        (acc, piece) -> CASE acc.turn
            WHEN 0 THEN named_struct('pos', acc.pos + length(piece), 'turn', 1, 'tail', {tail},
                                     'ahead', '', 'buf', acc.buf, 'out', acc.out)
            WHEN 1 THEN named_struct('pos', acc.pos, 'turn', 2, 'tail', acc.tail,
                                     'ahead', piece, 'buf', acc.buf, 'out', acc.out)
            ELSE named_struct('pos', acc.pos + length(piece), 'turn', 0, 'tail', {tail}, 'ahead', '',
                              {push(hit)})
        END,
        acc -> {GATHERED})"""
