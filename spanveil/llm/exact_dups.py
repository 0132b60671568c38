"""Exact duplicates by a heavy-hitter split of the digests.

A digest that a large part of the corpus shares would send all its rows to one task.  Such
digests are found first, with mergeable Misra-Gries summaries, one per partition; their exact
winners are broadcast (at most ``2 * HEAVY`` rows, whatever the corpus holds) and their copies
are settled where they are read.  All other digests go through one ordinary shuffle, and none
of them has more than one ``HEAVY``-th of the rows.

Defined cases: a null text counts as empty, all texts without a visible character are equal.
Ties go to the smallest doc_id, a null doc_id comes last; of rows repeated in full exactly one
stays.  An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .common import BLANK, written

#: A digest with over one HEAVY-th of all rows is certain to be settled on the map side.
HEAVY = 1024
#: Rows that one row of a count is expanded to at a time.
STRETCH = 4096


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_points, digest`` of each row: SHA-256 of the text without white space."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.char_length(text).cast("long").alias("n_points"),
        F.sha2(F.regexp_replace(text, BLANK, ""), 256).alias("digest"),
    )


def _reduced(counts: dict, k: int) -> tuple[dict, int]:
    """The summary cut to ``k`` counters, and what was taken off each."""
    if len(counts) <= k:
        return counts, 0
    cut = sorted(counts.values(), reverse=True)[k]
    return {d: c - cut for d, c in counts.items() if c > cut}, cut


def summarise(k: int):
    """``mapInArrow``: a partition's Misra-Gries counters; the row without digest is the error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, error = {}, 0
        for batch in batches:
            for pair in pc.value_counts(batch.column(0)).to_pylist():
                counts[pair["values"]] = counts.get(pair["values"], 0) + pair["counts"]
            if len(counts) > 8 * k:
                counts, cut = _reduced(counts, k)
                error += cut
        counts, cut = _reduced(counts, k)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*counts, None], pa.string()), pa.array([*counts.values(), error + cut], pa.int64())],
            names=["digest", "n"],
        )

    return run


def heavy_digests(rows: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Every digest with over one ``heavy``-th of the rows, and at most ``2 * heavy`` digests.

    A partition's counters are too low by at most ``error``, and the errors of all partitions
    add up to at most ``N / (2 * heavy)``.  So a digest above ``N / heavy`` has counters of
    more than ``N / heavy - errors``, and that is at least half of it.
    """
    sums = (
        rows.select("digest").mapInArrow(summarise(2 * heavy - 1), "digest string, n long")
        .groupBy("digest").agg(F.sum("n").alias("n"))
    )
    sums = written(sums, "digest-counters")
    error = sums.where("digest is null").agg(F.sum("n")).first()[0] or 0
    least = max(1.0, rows.count() / heavy - error)
    return sums.where(F.col("digest").isNotNull() & (F.col("n") >= least)).select("digest")


def winners(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """``digest, best_points, best_id, size`` of the heavy digests, counted over all rows."""
    best = F.min(F.struct((-F.col("n_points")).alias("p"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i")))
    return (
        rows.join(F.broadcast(heavy), "digest").groupBy("digest").agg(best.alias("b"), F.count(F.lit(1)).alias("size"))
        .select("digest", (-F.col("b.p")).alias("best_points"), F.col("b.i").alias("best_id"), "size")
    )


def split(docs: DataFrame, heavy: int = HEAVY) -> tuple[DataFrame, DataFrame]:
    """The digest rows and the winners of the heavy digests, both as written tables."""
    rows = written(digests(docs), "digests")
    best = written(winners(rows, heavy_digests(rows, heavy)), "digest-winners")
    return rows, best


_IS_BEST = "n_points = best_points AND doc_id <=> best_id"


def _order() -> WindowSpec:
    return Window.partitionBy("digest").orderBy(F.desc("n_points"), F.col("doc_id").isNull(), "doc_id")


def exact_duplicates(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    rows, best = split(docs, heavy)
    marked = rows.join(F.broadcast(best), "digest", "left")
    light = (
        rows.join(F.broadcast(best.select("digest")), "digest", "left_anti")
        .withColumn("nth", F.row_number().over(_order()))
        .withColumn("keep_id", F.first("doc_id").over(_order()))
        .withColumn("group_size", F.count(F.lit(1)).over(Window.partitionBy("digest")))
        .select("doc_id", "keep_id", "group_size", (F.col("nth") == 1).alias("kept"), "digest")
    )
    copies = marked.where(F.col("size").isNotNull() & ~F.expr(_IS_BEST)).select(
        "doc_id", F.col("best_id").alias("keep_id"), F.col("size").alias("group_size"), F.lit(False).alias("kept"), "digest"
    )
    # Rows that equal the winner in full: their number first, then as many rows, one of them kept, in stretches.
    first = (
        marked.where(F.col("size").isNotNull() & F.expr(_IS_BEST))
        .groupBy("digest").agg(F.first("best_id").alias("doc_id"), F.first("size").alias("size"), F.count(F.lit(1)).alias("m"))
        .select("doc_id", "size", "digest", "m", F.explode(F.expr(f"sequence(0L, (m - 1) div {STRETCH})")).alias("part"))
        .select("doc_id", "size", "digest", F.explode(F.expr(f"sequence(part * {STRETCH}, least(m, (part + 1) * {STRETCH}) - 1)")).alias("nth"))
        .select("doc_id", F.col("doc_id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("nth") == 0).alias("kept"), "digest")
    )
    return light.unionByName(copies).unionByName(first).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


def without_exact_duplicates(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """The documents that stay, with all their columns.

    Copies of heavy digests go before the shuffle; the other texts are shuffled once.
    """
    names = docs.columns
    best = split(docs, heavy)[1]
    text = F.coalesce(F.col("text"), F.lit(""))
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.char_length(text).cast("long").alias("n_points"),
        F.sha2(F.regexp_replace(text, BLANK, ""), 256).alias("digest"),
    )
    light = (
        packed.join(F.broadcast(best.select("digest")), "digest", "left_anti")
        .withColumn("nth", F.row_number().over(_order().orderBy(F.desc("n_points"), F.col("doc_id").isNull(), "doc_id", F.xxhash64("row")))).where("nth = 1").select("row")
    )
    first = (
        packed.join(F.broadcast(best), "digest").where(_IS_BEST)
        .groupBy("digest").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row")
    )
    return light.unionByName(first).select("row.*")


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS p,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM t
WINDOW w AS (PARTITION BY text_sha256 ORDER BY p DESC, doc_id NULLS LAST)
"""
