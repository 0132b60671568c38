"""Merging pattern findings with a second source of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons
from ..functions.spans import one_of, with_computed
from .detectors import CANDIDATE_TYPE
from .resolve import resolve

SECONDARY_TYPE = "array<struct<type:string,text:string,start:int,end:int,confidence:double>>"


def normalised(c: str) -> str:
    """SQL form of ``normalise_confidence`` for a number."""
    return (
        f"CASE WHEN {c} IS NULL OR isnan({c}) OR {c} = 0 THEN 0.5D"
        f" WHEN {c} > 1 THEN {c} / 100 ELSE greatest({c}, 0D) END"
    )


def _cuts_out(f: str, text_col: str) -> str:
    return f"""(length({text_col}) = 0 OR ({f}.start >= 0 AND {f}.start < {f}.end AND {f}.end <= length({text_col})
        AND substring({text_col}, {f}.start + 1, {f}.end - {f}.start) = {f}.text))"""


def valid_offsets(df: DataFrame, secondary: str, text_col: str = "text") -> DataFrame:
    """Drop findings whose offsets do not cut their own text out of the text.

    An empty text checks nothing, so its findings stay.
    """
    keep = f"filter({secondary}, f -> {_cuts_out('f', text_col)})"
    return with_computed(df, secondary, f"coalesce({keep}, CAST(array() AS {SECONDARY_TYPE}))")


def merge_findings(
    df: DataFrame, primary: str = "findings", secondary: str = "secondary", text_col: str = "text",
    out: str = "findings",
) -> DataFrame:
    """Add secondary findings that overlap nothing kept so far, in their given order.

    Primary findings always stay.  Afterwards names whose text is a known false positive
    are dropped from both sources.
    """
    df = valid_offsets(df, secondary, text_col)
    first = f"""transform({primary}, f -> named_struct(
        'check_start', f.start, 'rank', 0, 'start', f.start, 'end', f.end, 'type', f.type,
        'text', f.text, 'confidence', f.confidence))"""
    second = f"""transform({secondary}, (f, i) -> named_struct(
        'check_start', f.start, 'rank', i + 1, 'start', f.start, 'end', f.end, 'type', f.type,
        'text', f.text, 'confidence', {normalised('f.confidence')}))"""
    both = f"concat(CAST({first} AS {CANDIDATE_TYPE}), CAST({second} AS {CANDIDATE_TYPE}))"
    kept = f"transform(array({both}), found -> {resolve('found')})[0]"
    merged = f"""transform(
        filter({kept}, c -> c.type <> 'name' OR NOT {one_of('lower(trim(c.text))', lexicons.FALSE_POSITIVES)}),
        c -> named_struct('start', c.start, 'end', c.end, 'type', c.type, 'text', c.text,
            'confidence', c.confidence,
            'severity', CASE WHEN c.confidence >= 0.85D THEN 'HIGH' ELSE 'MEDIUM' END, 'rank', c.rank))"""
    return with_computed(df, out, merged)


def attach_secondary(docs: DataFrame, rows: DataFrame, keys: list[str], order: str, text_col: str = "text") -> DataFrame:
    """Join a table of secondary findings to its texts as one array per text, in order.

    ``rows`` has the keys, an order column and type, text, start, end and a confidence of any
    type.  Rows whose offsets don't cut their text out of ``text_col`` go before anything is
    gathered, so an array holds spans of its own text only.
    """
    stated = F.col("confidence").cast("string")
    confidence = (
        F.when(stated == "true", 0.9).when(stated == "false", 0.5).otherwise(stated.try_cast("double"))
    )
    item = F.struct(F.col(order), F.col("type"), confidence.alias("confidence"))
    # A repeated span and text can never add a finding; only its first place matters.
    spans = rows.groupBy(
        *keys, F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "text"
    ).agg(F.min(item).alias("first"))
    texts = docs.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(text_col).alias("__own"))
    same = " AND ".join(f"s.`{k}` = __k{i}" for i, k in enumerate(keys))
    spans = spans.alias("s").join(texts, F.expr(f"{same} AND {_cuts_out('s', '__own')}"), "left_semi")
    arrays = spans.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("first", "start", "end", "text"))).alias("secondary")
    )
    arrays = arrays.withColumn(
        "secondary",
        F.expr(f"""CAST(transform(secondary, f -> named_struct('type', f.first.type, 'text', f.text,
            'start', f.start, 'end', f.end, 'confidence', f.first.confidence)) AS {SECONDARY_TYPE})"""),
    )
    return docs.join(arrays, keys, "left")


def drop_known_phrases(findings: DataFrame, lexicon: DataFrame, term: str = "term") -> DataFrame:
    """Left-anti join of name findings with a table of phrases that are not names.

    Findings of other types are set aside before the join.
    """
    terms = lexicon.select(F.lower(F.col(term)).alias("__term"))
    is_name = F.coalesce(F.col("type") == "name", F.lit(False))
    names = findings.where(is_name).join(terms, F.lower(F.trim(F.col("text"))) == F.col("__term"), "left_anti")
    return names.unionByName(findings.where(~is_name))
