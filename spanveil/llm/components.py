"""Connected components of a link table, by alternating large and small stars.

A large-star step links every larger neighbour of a node to the node's smallest neighbour; a
small-star step does so for the smaller ones.  Both keep the components, and the links turn
into one star per component in a number of rounds that grows with the logarithm of its size.
Each half round is written to the scratch folder, so no lineage grows and a lost executor
costs one step; the joins read written tables, which lets Spark split a centre's many rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.expr("cast(xxhash64(hi, lo) as decimal(38, 0))"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links(hi, lo)``; root is the smallest node reached."""
    links = written(links.where("hi <> lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct(), "links")
    state = _state(links)
    while state[0]:
        ends = links.select(F.explode(F.expr("array(struct(hi AS u, lo AS v), struct(lo AS u, hi AS v))")).alias("e")).select("e.u", "e.v")
        least = written(ends.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = written(
            links.select(F.explode(F.expr("array(struct(hi AS u, lo AS v), struct(lo AS u, hi AS v))")).alias("e")).select("e.u", "e.v")
            .join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(),
            "large-star",
        )
        lower = written(large.groupBy("hi").agg(F.min("lo").alias("m")), "lower")
        links = written(
            large.join(lower, "hi")
            .select(F.explode(F.expr("array(struct(hi AS hi, m AS lo), struct(lo AS hi, m AS lo))")).alias("e"))
            .select("e.hi", "e.lo").where("hi <> lo").distinct(),
            "small-star",
        )
        before, state = state, _state(links)
        if state == before:
            break
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
        links.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    )
