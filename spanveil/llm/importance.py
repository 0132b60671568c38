"""Importance resampling towards a target distribution, on hashed n-grams.

Every text is lower-cased (A-Z), each run of separators becomes one space, and overlapping
matches of a pattern with boundary look-arounds give the spans of the n-grams, whose bytes go
straight into CRC-32 buckets.  A first pass writes each document's buckets and counts, and one
row of bucket sums per task; the sums of all documents and of all target texts, ``buckets``
numbers each, give every bucket's gain.  A second pass over the buckets (not the texts) turns
gains into a document's weight.  With Gumbel noise from a seeded hash of doc_id the documents
with the highest scores are a draw without replacement in proportion to exp(weight).

The draw is exact: rows are sorted over range partitions, numbered in their partition, and the
partitions' sizes are added up, so no task sees more than a stretch of the order.

Defined cases: a null text has no words, weight 0 and is never drawn.  A null doc_id is hashed as
``null`` and comes last among ties; rows with equal score and doc_id are ordered by their counts.
Repeated rows are rows of their own.  Without target texts all sums of the target are 0.  An empty
table gives an empty result; other columns are not read, or passed on as they are (``columns``).
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, texts_of, written

ORDER = 1
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"

#: What is no part of a word: ASCII other than letters and digits.
SEPARATORS = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def n_grams(n: int) -> regex.Pattern:
    """Runs of ``n`` words in a text whose words are parted by one space."""
    return regex.compile(rb"(?<![^ ])" + rb" ".join([rb"[^ ]++"] * n))


def collapsed(text: bytes) -> bytes:
    return SEPARATORS.sub(b" ", text.lower()).strip(b" ")


def features(text: bytes, patterns: list[regex.Pattern], buckets: int = BUCKETS) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Words, features, and the distinct buckets of the features with their counts."""
    line, crc = collapsed(text), zlib.crc32
    codes = [
        np.fromiter((crc(m.group()) for m in p.finditer(line, overlapped=True)), np.int64) % buckets
        for p in patterns
    ]
    found, counts = np.unique(np.concatenate(codes), return_counts=True)
    return len(codes[0]), sum(map(len, codes)), found, counts


def _scan(order: int, buckets: int, names: list[str]):
    """``mapInArrow``: the features of each row, and at the end of a task a row of bucket sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, sums = [n_grams(n) for n in range(1, order + 1)], np.zeros(buckets, np.int64)
        types = None
        for batch in batches:
            rows = [features(t, patterns, buckets) for t in texts_of(batch.column("text"))]
            for _, _, found, counts in rows:
                sums[found] += counts
            made = [
                pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2].astype("<u4").tobytes() for r in rows], pa.binary()), pa.array([r[3].astype("<u4").tobytes() for r in rows], pa.binary()),
                pa.nulls(len(rows), pa.list_(pa.int64())),
            ]
            kept = [batch.column(n) for n in names]
            types = [c.type for c in kept]
            yield pa.RecordBatch.from_arrays(kept + made, names=[*names, "n_words", "n_features", "found", "counts", "sums"])
        if types is not None and sums.any():
            empty = [pa.nulls(1, t) for t in types] + [pa.nulls(1, pa.int64())] * 2 + [pa.nulls(1, pa.binary())] * 2
            yield pa.RecordBatch.from_arrays([*empty, pa.array([sums], pa.list_(pa.int64()))], names=[*names, "n_words", "n_features", "found", "counts", "sums"])

    return run


_FOUND = T.StructType().add("n_words", "long").add("n_features", "long").add("found", "binary").add("counts", "binary").add("sums", T.ArrayType(T.LongType()))


def scanned(rows: DataFrame, order: int, buckets: int, name: str) -> DataFrame:
    """A written table of the features of ``rows`` (with a column ``text``), other columns kept, and of bucket sums."""
    names = [c for c in rows.columns if c != "text"]
    schema = T.StructType([T.StructField(n, rows.schema[n].dataType) for n in names] + _FOUND.fields)
    return mapped(rows, _scan(order, buckets, names), schema, name)


def bucket_sums(table: DataFrame, buckets: int) -> np.ndarray:
    """``buckets`` numbers, whatever the size of the table."""
    out = np.zeros(buckets, np.int64)
    sums = table.where("sums IS NOT NULL").select(F.posexplode("sums").alias("bucket", "n")).where("n > 0")
    for row in sums.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains_of(sums: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of each bucket."""
    b, s_all, t_all = len(sums), float(sums.sum()), float(target.sum())
    return np.array([
        math.floor(1000.0 * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b)))) for s, t in zip(sums.tolist(), target.tolist(), strict=True)
    ], np.int64)


def _weigh(gains: np.ndarray, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = []
            for n, found, counts in zip(*(batch.column(c).to_pylist() for c in ("n_features", "found", "counts")), strict=True):
                total = int(gains[np.frombuffer(found, "<u4")] @ np.frombuffer(counts, "<u4").astype(np.int64)) if n else 0
                weights.append(total // n if n else 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(weights, pa.int64())], names=[*names, "weight"])

    return run


def ranked(rows: DataFrame, order: list, out: str) -> DataFrame:
    """``rows`` with their place (from 1) in ``order``, over range partitions.

    ``order`` should tell rows apart that differ in what is read of them: equal rows share a task.
    """
    stretch = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn("stretch", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    # One row per partition of the sort.
    sizes = placed.groupBy("stretch").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("stretch", F.coalesce(F.sum("n").over(stretch), F.lit(0)).alias("before"))
    return placed.join(F.broadcast(before), "stretch").withColumn(out, F.col("before") + F.col("at") + 1).drop("stretch", "at", "before")


def importance(
    docs: DataFrame, target: DataFrame, columns: list[str] | None = None, order: int = ORDER, buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED,
) -> DataFrame:
    """The ``columns`` of each row (``doc_id`` by default) with ``n_features, weight, score, rank``; rank is null where not drawn."""
    names = ["doc_id"] if columns is None else columns
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"),
    )
    table = scanned(rows, order, buckets, "features")
    wanted = scanned(target.select(F.col("text").cast("string").alias("text")), order, buckets, "target")
    gains = gains_of(bucket_sums(table, buckets), bucket_sums(wanted, buckets))
    kept = ["row", "id", "n_words", "n_features"]
    schema = T.StructType([table.schema[n] for n in kept] + [T.StructField("weight", T.LongType())])
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    scored = written(
        table.where("sums IS NULL").mapInArrow(_weigh(gains, kept), schema)
        .withColumn("score", F.col("weight") + F.floor(-1000.0 * F.log(-F.log((noise + 0.5) / 4294967296.0)))),
        "scores",
    )
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    placed = ranked(able, [F.desc("score"), F.asc_nulls_last("id"), F.asc("n_words"), F.asc("n_features")], "rank")
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    others = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(others).select("row.*", "n_features", "weight", "score", "rank")


def resampled(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents with all their columns."""
    drawn = importance(docs.select(F.struct("*").alias("row"), "doc_id", "text"), target, columns=["row"], **options)
    return drawn.where("rank IS NOT NULL").select("row.*")


#: CRC-32 of each distinct word, folded over its bytes with the table of the reversed polynomial.
ORACLE = rf"""
WITH RECURSIVE steps(b, k, v) AS (
  SELECT b, 0, b::BIGINT FROM range(256) r(b)
  UNION ALL
  SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY b) AS crcs FROM steps WHERE k = 8),
texts AS (
  SELECT true AS wanted, item_id AS doc_id, row_number() OVER () AS n, text FROM benchmark
  UNION ALL SELECT false, doc_id, row_number() OVER (), text FROM documents),
words AS (
  SELECT wanted, n, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts),
counted AS (SELECT wanted, n, word, count(*) AS k FROM words GROUP BY ALL),
spelt AS (SELECT word, hex(encode(word)) AS hexed, strlen(word) AS size FROM (SELECT DISTINCT word FROM counted)),
hashed AS (
  SELECT word, xor(list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(range(size), lambda i: ('0x' || substr(hexed, 2 * i + 1, 2))::BIGINT)),
           lambda c, x: xor(c >> 8, crcs[(xor(c, x) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM spelt, crc_table),
sums AS (
  SELECT bucket, coalesce(sum(k) FILTER (NOT wanted), 0) AS s, coalesce(sum(k) FILTER (wanted), 0) AS t FROM counted JOIN hashed USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM sums) + {BUCKETS})::DOUBLE
                                 / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM sums) + {BUCKETS})::DOUBLE))) AS gain FROM sums),
weighed AS (
  SELECT n, sum(k)::BIGINT AS n_features, floor(sum(k * gain) / sum(k))::BIGINT AS weight
  FROM counted JOIN hashed USING (word) JOIN gains USING (bucket) WHERE NOT wanted GROUP BY n),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5::DOUBLE)
                                                    / 4294967296::DOUBLE)))::BIGINT AS score
  FROM texts LEFT JOIN weighed USING (n) WHERE NOT wanted),
placed AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) OVER () * {PERCENT} // 100 AS drawn
  FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM placed
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE n_features < {LEAST_WORDS}
"""
