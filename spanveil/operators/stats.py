"""Counts over scans and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scan_counts(findings: str = "findings") -> list[Column]:
    """risks_found, high_risk and medium_risk of one scan's finding array.

    A finding without a severity counts as medium.
    """
    high = F.size(F.filter(findings, lambda f: f["severity"] == "HIGH"))
    medium = F.size(
        F.filter(findings, lambda f: f["severity"].isNull() | (f["severity"] == "MEDIUM"))
    )
    return [
        F.size(findings).alias("risks_found"), high.alias("high_risk"), medium.alias("medium_risk")
    ]


def stats_by_domain(counts: DataFrame, domain: str = "domain") -> DataFrame:
    """Totals per domain; scans without a domain count under ``unknown``."""
    return (
        counts.groupBy(F.coalesce(F.col(domain), F.lit("unknown")).alias("domain"))
        .agg(
            F.sum("risks_found").alias("total"),
            F.sum("high_risk").alias("high_risk"),
            F.sum("medium_risk").alias("medium_risk"),
        )
    )


def running_totals(counts: DataFrame) -> DataFrame:
    """Totals over all scans; the safe-context counter exists but nothing ever raises it."""
    return counts.agg(
        F.coalesce(F.sum("risks_found"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("high_risk"), F.lit(0)).alias("high_risk"),
        F.coalesce(F.sum("medium_risk"), F.lit(0)).alias("medium_risk"),
        F.lit(0).cast("bigint").alias("safe_contexts"),
    )


def corpus_inventory(findings: DataFrame, *dimensions: str) -> DataFrame:
    """Finding counts by every prefix of the dimensions; ``(all)`` marks a total."""
    rolled = findings.rollup(*dimensions).agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
    levels = len(dimensions)
    named = [
        F.when(F.col("gid").bitwiseAND(F.lit(1 << (levels - 1 - i))) > 0, "(all)")
        .otherwise(F.coalesce(F.col(d).cast("string"), F.lit("(none)")))
        .alias(d)
        for i, d in enumerate(dimensions)
    ]
    return rolled.select(*named, "n")
