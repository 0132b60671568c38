"""Detection over a table of texts: corpus in, findings out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spans import normalise_newlines, scan_form, with_computed
from ..functions.patterns import NAME_WORD
from .detectors import CANDIDATE_TYPE, Detector, all_candidates, default_detectors
from .resolve import resolve

FINDING_TYPE = (
    "array<struct<start:int,end:int,type:string,text:string,confidence:double,severity:string,rank:int>>"
)
PARTITION_BYTES = 128 * 1024 * 1024
SCANNED, CANDIDATES = "__scanned", "__candidates"

_FINDING = """named_struct('start', c.start, 'end', c.end, 'type', c.type, 'text', c.text,
    'confidence', c.confidence, 'severity', CASE WHEN c.confidence >= 0.85D THEN 'HIGH' ELSE 'MEDIUM' END,
    'rank', c.rank)"""


def detect(
    df: DataFrame,
    text_col: str = "text",
    *,
    detectors: Sequence[Detector] | None = None,
    given_names: Sequence[str] | None = None,
    known: str | None = None,
    claims: str | None = None,
    out: str = "findings",
    resolve_overlaps: bool = True,
    every: str | None = None,
) -> DataFrame:
    """Add an array column of findings to every row, with no shuffle.

    The text column is replaced by its newline-normalised form, which offsets refer to.
    Given names are those of ``given_names`` (a short list, written into the plan), or those in
    the array column ``known``, which ``with_known_names`` makes from a table of any size.
    ``claims`` names an optional array column of ``(start, end)`` spans that no finding may
    touch.  Rows without findings keep an empty array.  ``every`` names one more array column, of
    all candidates before conflicts are resolved, from the same passes.
    """
    passes = default_detectors(given_names, known) if detectors is None else list(detectors)
    df = df.withColumn(text_col, normalise_newlines(F.col(text_col)))
    df = df.withColumn(SCANNED, scan_form(F.col(text_col)))
    found = all_candidates(SCANNED, passes)
    if every:
        df = with_computed(df, CANDIDATES, found)
        df = with_computed(df, every, f"transform({CANDIDATES}, c -> {_FINDING})")
        found = CANDIDATES
    if claims:
        taken = f"""transform(`{claims}`, c -> named_struct(
            'check_start', CAST(c.start AS int), 'rank', 0, 'start', CAST(c.start AS int),
            'end', CAST(c.end AS int), 'type', '', 'text', '', 'confidence', 0D))"""
        found = f"concat(coalesce({taken}, CAST(array() AS {CANDIDATE_TYPE})), {found})"
    if resolve_overlaps:
        # Bound to a lambda variable, the candidate array is computed once per row.
        found = f"transform(array({found}), found -> {resolve('found')})[0]"
        found = f"filter({found}, c -> c.rank > 0)"
    return with_computed(df, out, f"transform({found}, c -> {_FINDING})").drop(SCANNED, CANDIDATES)


def with_known_names(
    df: DataFrame, keys: Sequence[str], names: DataFrame, column: str, text_col: str = "text", out: str = "known_names"
) -> DataFrame:
    """Add the capitalised words of each text that are in a gazetteer table, lower-cased.

    The words of the texts are joined with the table, so it may have any size; an array holds
    words of its own text only.  ``keys`` tell the rows apart and are not null.
    """
    terms = names.select(F.lower(F.trim(F.col(column))).alias("__term")).where("__term <> ''").distinct()
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(NAME_WORD), F.lit(0)), F.lower))
    words = df.select(*keys, F.explode(found).alias("__term")).join(terms, "__term")
    known = words.groupBy(*keys).agg(F.collect_set("__term").alias(out))
    return df.join(known, list(keys), "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def explode_findings(df: DataFrame, keys: Sequence[str], findings: str = "findings") -> DataFrame:
    """One row per finding.  The outer form keeps Spark from testing the array beforehand,
    which would run every detector twice."""
    rows = df.select(*keys, F.explode_outer(findings).alias("f")).where("f is not null")
    return rows.select(*keys, "f.type", "f.text", "f.start", "f.end", "f.confidence", "f.severity")


def find_pii(df: DataFrame, keys: Sequence[str], text_col: str = "text", **options) -> DataFrame:
    """Findings table of a corpus: keys, type, text, start, end, confidence, severity."""
    return explode_findings(detect(df.select(*keys, text_col), text_col, **options), keys)


def spread(df: DataFrame) -> DataFrame:
    """Give a small input one partition per core.

    A file with a single row group is read by one task however many cores there are.  Only
    an input estimated below one split per core is repartitioned, so the shuffle is bounded
    by ``cores * 128 MB``; anything larger is already spread by its splits and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * PARTITION_BYTES else df
