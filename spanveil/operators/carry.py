"""Ordered per-key computations in two levels, so that no key is held by one task.

A plain window sorts all rows of a key in one task.  Here the rows of a key are cut into
chunks of its order column.  A window runs inside each chunk, a second window runs over one
summary row per chunk, and the two are joined.  A key with a third of all rows is spread over
as many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "__chunk"


def _windows(keys: Sequence[str], order: Sequence[str]):
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(CHUNK)
    return inside, across


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, value: Column, out: str
) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the key, the row itself not included."""
    inside, across = _windows(keys, order)
    df = df.withColumn(CHUNK, chunk).withColumn("__value", value)
    local = F.coalesce(F.sum("__value").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = df.groupBy(*keys, CHUNK).agg(F.sum("__value").alias("__total"))
    base = F.coalesce(F.sum("__total").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = totals.select(*keys, CHUNK, base.alias("__base"))
    joined = df.withColumn("__local", local).join(bases, [*keys, CHUNK])
    return joined.withColumn(out, F.col("__base") + F.col("__local")).drop(
        CHUNK, "__value", "__local", "__base"
    )


def last_before(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, values: dict[str, Column]
) -> DataFrame:
    """Latest non-null value among the earlier rows of the key, the row not included, for each of ``values``."""
    inside, across = _windows(keys, order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn(CHUNK, chunk).withColumns({f"__v_{n}": v for n, v in values.items()})
    # A chunk without a value has a null here, as ``max_by`` passes over null orders.
    lasts = df.groupBy(*keys, CHUNK).agg(
        *(F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), F.struct(*order))).alias(f"__l_{n}") for n in values)
    )
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    bases = lasts.select(*keys, CHUNK, *(F.last(f"__l_{n}", ignorenulls=True).over(earlier).alias(f"__c_{n}") for n in values))
    local = df.withColumns({f"__b_{n}": F.last(f"__v_{n}", ignorenulls=True).over(before) for n in values})
    joined = local.join(bases, [*keys, CHUNK])
    return joined.withColumns({n: F.coalesce(f"__b_{n}", f"__c_{n}") for n in values}).drop(
        CHUNK, *(f"__{x}_{n}" for n in values for x in "vbc")
    )


def first_after(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, value: Column, out: str
) -> DataFrame:
    """``value`` of the next row of the key; null on the last row."""
    inside, across = _windows(keys, order)
    df = df.withColumn(CHUNK, chunk).withColumn("__value", value)
    firsts = df.groupBy(*keys, CHUNK).agg(F.min_by("__value", F.struct(*order)).alias("__first"))
    nexts = firsts.select(*keys, CHUNK, F.lead("__first").over(across).alias("__next"))
    local = df.withColumn("__lead", F.lead(F.struct("__value")).over(inside))
    joined = local.join(nexts, [*keys, CHUNK])
    return joined.withColumn(
        out, F.when(F.col("__lead").isNotNull(), F.col("__lead.__value")).otherwise(F.col("__next"))
    ).drop(CHUNK, "__value", "__lead", "__next")


def time_chunk(ts: str, seconds: int = 3600) -> Column:
    return F.floor(F.unix_micros(F.col(ts)) / (seconds * 1_000_000))
