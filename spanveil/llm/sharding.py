"""Shards that all hold the same mixture: proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; row r of a source of n rows
stands at the fraction (2r - 1) / 2n of the whole.  Sorted by that fraction the sources are
interleaved in proportion, and a cut into equal runs gives shards of one mixture whose counts
differ by one at most (the law ``rows``).

Exact ranks need no task that sees a whole source: rows are counted in cells (a range of
hashes, then a range of fractions), the cells' sums are added up, and rows are numbered inside
a cell.  There are about as many cells as rows in a cell.  All of it is DataFrame operations,
and only narrow rows are shuffled.

Defined cases: a null text has size 1 and checksum 0; null sources form a source of their own;
equal doc_ids are ordered by size and checksum, and rows equal in all of that may change places.
An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import source_key, square_root_cells

SEED = "spanveil"


def shards(docs: DataFrame, n_shards: int = 8, seed: str = SEED) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of each row."""
    n = docs.count()
    cells = square_root_cells(n)
    text = F.coalesce(F.col("text"), F.lit(""))
    mixed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    cell = F.shiftright(F.conv(F.substring(mixed, 1, 8), 16, 10).cast("long") * F.lit(cells), 32)
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), source_key(F.col("source")).alias("src"), mixed.alias("h"),
        cell.alias("cell"), F.octet_length(text).cast("long").alias("n_bytes"), F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("size", F.col("n_bytes") + 1)

    # Rows before each hash cell of a source; the text is not read for it.
    of_source = Window.partitionBy("src")
    before = keyed.groupBy("src", "cell").count().select(
        "src", "cell",
        (F.sum("count").over(of_source.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")).alias("before"),
        F.sum("count").over(of_source).alias("n_source"),
    )
    nth = F.row_number().over(Window.partitionBy("src", "cell").orderBy("h", "size", "text_crc32", F.col("doc_id").isNull(), "doc_id"))
    ranked = (
        keyed.join(before, ["src", "cell"])
        .withColumn("rank2", 2 * (F.col("before") + nth) - 1)
        .withColumn("stretch", F.expr(f"(rank2 * {cells}L) div (2 * n_source)"))
        .withColumn("fraction", F.col("rank2") / (2 * F.col("n_source")).cast("double"))
        .drop("cell", "before")
    )

    # Rows before each stretch of fractions, from the sizes of the sources alone.
    starts = (
        keyed.groupBy("src").count()
        .select("count", F.explode(F.expr(f"sequence(0L, {cells - 1}L)")).alias("stretch"))
        .groupBy("stretch").agg(F.sum(F.expr(f"(2 * count * stretch + {cells - 1}L) div {2 * cells}L")).alias("start"))
    )
    order = Window.partitionBy("stretch").orderBy("fraction", "src", "h", "size", "text_crc32", F.col("doc_id").isNull(), "doc_id")
    placed = (
        ranked.join(starts, "stretch")
        .withColumn("place", F.col("start") + F.row_number().over(order) - 1)
        .withColumn("shard", F.expr(f"(place * {n_shards}L) div {max(n, 1)}L"))
    )
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.expr(f"place - (shard * {n}L + {n_shards - 1}L) div {n_shards}L").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: CRC-32 is folded over the bytes of a text with the table of the reversed polynomial.
ORACLE = f"""
WITH RECURSIVE steps(b, k, v) AS (
  SELECT b, 0, b::BIGINT FROM range(256) r(b)
  UNION ALL
  SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY b) AS crcs FROM steps WHERE k = 8),
bytes AS (
  SELECT doc_id, coalesce('s' || source, 't') AS src, strlen(coalesce(text, '')) + 1 AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS h,
         hex(encode(coalesce(text, ''))) AS hexed
  FROM documents),
summed AS (
  SELECT doc_id, src, size, h,
         xor(list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(range(size - 1), lambda i: ('0x' || substr(hexed, 2 * i + 1, 2))::BIGINT)),
           lambda c, x: xor(c >> 8, crcs[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32
  FROM bytes, crc_table),
ranked AS (
  SELECT *, (2 * row_number() OVER (PARTITION BY src ORDER BY h, size, text_crc32, doc_id NULLS LAST) - 1)::DOUBLE
            / (2 * count(*) OVER (PARTITION BY src))::DOUBLE AS fraction
  FROM summed),
placed AS (
  SELECT *, row_number() OVER (ORDER BY fraction, src, h, size, text_crc32, doc_id NULLS LAST) - 1 AS place, count(*) OVER () AS n
  FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, ((place * 8) // n)::INTEGER AS shard,
       place - (((place * 8) // n) * n + 7) // 8 AS slot, NULL::INTEGER AS grown_shard
FROM placed
"""
