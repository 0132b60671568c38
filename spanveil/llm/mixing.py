"""Mixing sources to target weights: blocks, multinomial shard counts, index permutations.

The words of a source, its documents in the order of a seeded hash, are packed into blocks of
``BLOCK`` words.  A source's target is a number of block draws, the last of which is cut to the
words that the target still lacks; so each source's words come within one of its target.  Each
output shard gets a count of draws per source: a multinomial draw that adds up to the source's
number.  Draw number j maps to block ``permutation(j mod n_blocks)`` of pass ``j div n_blocks``; a
source is thus used up before any block comes again, and no block comes more often than the cap of
two allows.  The permutation is one of the full blocks; a last block that is not full ends a pass.  Blocks
and draws are then joined by index.

A source may hold any part of the rows: its documents get their places through cells of hashes
(counted, summed up, numbered inside a cell), and draws are dealt out in runs of ``RUN``.

Defined cases: a null text has no words; a document without words is never drawn; null sources
form a source that comes last; equal doc_ids are ordered by size.  Repeated rows are documents of
their own; rows with one doc_id, source and size are told apart by a hash of the whole row.  Other
columns are passed on as they are.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, source_key, square_root_cells, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
BLOCK = 64
OUTPUT_SHARDS = 16
RUN = 1 << 16
SEED = "spanveil"
ROUNDS = 4


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """``src, source_size, target`` from ``src, source_size``: weights with a cap, the excess shared out again.

    Sources are filled in the order in which they reach their cap; the level at which the rest
    is shared is that of the first source below its cap.  One row per source is read.
    """
    w = f"element_at(array({', '.join(f'{x}D' for x in weights)}), cast((row_number() OVER (ORDER BY src) - 1) % {len(weights)} AS int) + 1)"
    return (
        sizes.selectExpr("src", "source_size", f"{w} AS weight")
        .selectExpr("*", f"source_size * {cap}D AS most", f"source_size * {cap}D / weight AS full_at")
        .selectExpr(
            "*", f"sum(source_size) OVER () * {share}D AS whole",
            "sum(most) OVER (ORDER BY full_at, src ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - most AS filled",
            "sum(weight) OVER (ORDER BY full_at DESC, src DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS weights_left",
        )
        .selectExpr("*", "(whole - filled) / weights_left AS level")
        .selectExpr("*", "min(CASE WHEN level < full_at THEN struct(full_at, src, level) END) OVER () AS first_below")
        .selectExpr("src", "source_size", "CASE WHEN level < full_at THEN weight * first_below.level ELSE most END AS target")
    )


def places(docs: DataFrame, block: int = BLOCK, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """Written tables: documents ``doc_id, src, size, nth, start`` in their source's word order, and the sources."""
    cells = square_root_cells(docs.count())
    mixed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    rows = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), source_key(F.col("source")).alias("src"), mixed.alias("h"),
            F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        ),
        "sizes",
    ).withColumn("cell", F.shiftright(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * F.lit(cells), 32))
    so_far = Window.partitionBy("src").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    before = written(
        rows.groupBy("src", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
        .select("src", "cell", "s", (F.sum("n").over(so_far) - F.col("n")).alias("n_before"), (F.sum("s").over(so_far) - F.col("s")).alias("s_before")),
        "cells",
    )
    order = Window.partitionBy("src", "cell").orderBy("h", "size", F.col("doc_id").isNull(), "doc_id")
    documents = written(
        rows.join(before.drop("s"), ["src", "cell"]).select(
            "doc_id", "src", "size",
            (F.col("n_before") + F.row_number().over(order)).alias("nth"),
            (F.col("s_before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("start"),
        ),
        "places",
    )
    sources = written(
        targets(before.groupBy("src").agg(F.sum("s").alias("source_size"))).selectExpr(
            "*", f"(source_size + {block - 1}) div {block} AS n_blocks",
        ).selectExpr("*", "cast(round(target) AS long) AS words").selectExpr(
            "src", "source_size", "target", "n_blocks",
            f"CASE WHEN source_size = 0 THEN 0L ELSE words div source_size * n_blocks + (words % source_size + {block - 1}) div {block} END AS draws",
        ),
        "sources",
    )
    return documents, sources


def round_key(seed: str, src: str, number: int, step: int) -> int:
    """28 bits for one Feistel round of one pass over a source."""
    return int(hashlib.md5(f"{seed}:{src}:{number}:{step}".encode()).hexdigest()[:7], 16)


def permuted(index: np.ndarray, n: int, keys: list[int]) -> np.ndarray:
    """A pseudorandom permutation of ``0 .. n-1``: a Feistel network, walked until the value is in range."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    low = (1 << half) - 1
    out = index.astype(np.int64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & low
        for key in keys:
            left, right = right, left ^ (((right * 40503 + key) * 9973 >> 11) & low)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out


def draws(sources: DataFrame, output_shards: int = OUTPUT_SHARDS, seed: str = SEED, block: int = BLOCK) -> DataFrame:
    """``src, pass, block, shard, slot, most``: the blocks that the mix takes, in the order of each shard.

    ``most`` is the number of words that a draw may take of its block.
    """

    @F.pandas_udf("array<long>")
    def counts(src: pd.Series, n: pd.Series) -> pd.Series:
        made = []
        for s, k in zip(src, n, strict=True):
            rng = np.random.Generator(np.random.Philox(int(hashlib.md5(f"{seed}:{s}".encode()).hexdigest()[:16], 16)))
            made.append(rng.multinomial(int(k), [1 / output_shards] * output_shards).tolist())
        return pd.Series(made)

    @F.pandas_udf("long")
    def block_of(src: pd.Series, number: pd.Series, index: pd.Series, n: pd.Series) -> pd.Series:
        out = np.zeros(len(index), np.int64)
        for (s, p), at in index.groupby([src.to_numpy(), number.to_numpy()]).indices.items():
            keys = [round_key(seed, s, int(p), r) for r in range(ROUNDS)]
            out[at] = permuted(index.to_numpy()[at], int(n.iloc[at[0]]), keys)
        return pd.Series(out)

    # By number, as Spark would take these few rows together before they are expanded.
    n_runs = max(1, min(sources.agg(F.sum(F.expr(f"draws div {RUN} + 1"))).first()[0] or 1, 1 << 17))
    runs = (
        sources.where("draws > 0").withColumn("n_full", F.expr(f"source_size div {block}"))
        # Words of the last draw: what the draws before it in its pass leave of the target.
        .withColumn("least", F.expr(f"CASE WHEN round(target) % source_size = 0 THEN {block}L ELSE cast((round(target) % source_size - 1) % {block} + 1 AS long) END"))
        .select("src", "n_blocks", "n_full", "draws", "least", F.posexplode(counts("src", "draws")).alias("shard", "k"))
        .withColumn("first", F.sum("k").over(Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("k"))
        .where("k > 0")
        .select("src", "n_blocks", "n_full", "draws", "least", "shard", "first", "k", F.explode(F.expr(f"sequence(0L, (k - 1) div {RUN}L)")).alias("run"))
        .repartition(n_runs, "src", "shard", "run")
    )
    return (
        runs.select("src", "n_blocks", "n_full", "draws", "least", "shard", "first", F.explode(F.expr(f"sequence(run * {RUN}L, least(k, (run + 1) * {RUN}L) - 1)")).alias("slot"))
        .withColumn("j", F.col("first") + F.col("slot"))
        .selectExpr("src", "j div n_blocks AS pass", "j % n_blocks AS i", "n_full", f"CASE WHEN j = draws - 1 THEN least ELSE {block}L END AS most", "shard", "slot")
        .withColumn("full", block_of("src", "pass", F.expr("least(i, greatest(n_full - 1, 0L))"), F.expr("greatest(n_full, 1L)")))
        .selectExpr("src", "pass", "CASE WHEN i < n_full THEN full ELSE i END AS block", "shard", "slot", "most")
    )


def pieces(documents: DataFrame, sources: DataFrame, block: int = BLOCK, output_shards: int = OUTPUT_SHARDS, seed: str = SEED) -> DataFrame:
    """What each draw takes of each document: ``src, nth, pass, shard, slot, first_word, n_words``.

    A row of ``pieces`` is one document's part of one drawn block, its words counted from 0.
    """
    parts = documents.where("size > 0").select(
        "src", "nth", "start", "size", F.explode(F.expr(f"sequence(start div {block}L, (start + size - 1) div {block}L)")).alias("block")
    )
    # Spark can't tell the number of draws from the sources they are expanded from, and would broadcast them.
    return parts.join(draws(sources, output_shards, seed, block).hint("merge"), ["src", "block"]).selectExpr(
        "src", "nth", "pass", "shard", "slot", f"greatest(0L, block * {block}L - start) AS first_word",
        f"least(start + size, block * {block}L + most) - greatest(start, block * {block}L) AS n_words",
    ).where("n_words > 0")


def taken(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken``."""
    documents, sources = places(docs)
    words = pieces(documents, sources).groupBy("src", "nth").agg(F.sum("n_words").alias("taken"))
    return (
        documents.join(words, ["src", "nth"], "left")
        .join(sources.select("src", "source_size", "target"), "src")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The mix as documents: a row for each pass that draws from a document, with the words it draws.

    A text of which a pass takes every word stays as it is; of others the drawn words are joined
    by one space.  ``n_chars``, where there is such a column, follows the text.
    """
    names = docs.columns
    documents, sources = places(docs)
    drawn = (
        pieces(documents, sources).groupBy("src", "nth", "pass")
        .agg(F.sort_array(F.collect_list(F.struct("first_word", "n_words"))).alias("parts"), F.sum("n_words").alias("n"))
    )
    same = Window.partitionBy("k", "src", "size").orderBy("nth")
    wanted = written(
        documents.withColumn("k", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("copy", F.row_number().over(same))
        .join(drawn, ["src", "nth"]).select("k", "src", "size", "copy", "parts", "n"),
        "drawn",
    )
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k"), source_key(F.col("source")).alias("src"),
        F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
    ).withColumn("copy", F.row_number().over(Window.partitionBy("k", "src", "size").orderBy(F.xxhash64("row"))))
    words = f"regexp_extract_all(row.text, '{WORD.replace(chr(92), chr(92) * 2)}', 0)"
    text = (
        f"CASE WHEN n = size THEN row.text ELSE transform(array({words}), w -> array_join(flatten(transform(parts, "
        "p -> slice(w, cast(p.first_word AS int) + 1, cast(p.n_words AS int)))), ' '))[0] END"
    )
    made = packed.join(wanted, ["k", "src", "size", "copy"]).withColumn("made", F.expr(text))
    new = {"text": F.col("made"), "n_chars": F.char_length("made").cast("long")}
    return made.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in names])


def _oracle() -> str:
    weights = f"[{', '.join(f'{w}.0::DOUBLE' for w in WEIGHTS)}]"
    # One Feistel round after another, each as a query around the last.
    network = "SELECT *, v >> half AS l0, v & low AS r0 FROM walk WHERE step = 0 OR v >= n_full"
    for k in range(ROUNDS):
        network = f"SELECT *, r{k} AS l{k + 1}, xor(l{k}, (((r{k} * 40503 + keys[{k + 1}]) * 9973) >> 11) & low) AS r{k + 1} FROM ({network})"
    keys = ", ".join(f"('0x' || substr(md5('{SEED}:' || src || ':' || pass || ':{k}'), 1, 7))::BIGINT" for k in range(ROUNDS))
    return rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, coalesce('s' || source, 't') AS src, md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS h,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
placed AS (
  SELECT *, row_number() OVER w AS nth, (sum(size) OVER w - size)::BIGINT AS start
  FROM sized WINDOW w AS (PARTITION BY src ORDER BY h, size, doc_id NULLS LAST ROWS UNBOUNDED PRECEDING)),
totals AS (SELECT src, sum(size)::BIGINT AS source_size FROM sized GROUP BY src),
weighed AS (SELECT *, {weights}[(row_number() OVER (ORDER BY src) - 1) % {len(WEIGHTS)} + 1] AS weight FROM totals),
capped AS (SELECT *, source_size * {CAP}.0::DOUBLE AS most, source_size * {CAP}.0::DOUBLE / weight AS full_at FROM weighed),
filled AS (
  SELECT *, (sum(source_size) OVER () * {SHARE}::DOUBLE
             - (sum(most) OVER (ORDER BY full_at, src ROWS UNBOUNDED PRECEDING) - most))
            / sum(weight) OVER (ORDER BY full_at DESC, src DESC ROWS UNBOUNDED PRECEDING) AS level FROM capped),
levelled AS (
  SELECT *, CASE WHEN level < full_at THEN weight * (SELECT level FROM filled WHERE level < full_at ORDER BY full_at, src LIMIT 1) ELSE most END AS target FROM filled),
sources AS (
  SELECT src, source_size, target, (source_size + {BLOCK - 1}) // {BLOCK} AS n_blocks,
         round(target)::BIGINT AS words FROM levelled WHERE source_size > 0),
numbered AS (
  SELECT src, n_blocks, source_size // {BLOCK} AS n_full, unnest(range(words // source_size * n_blocks + (words % source_size + {BLOCK - 1}) // {BLOCK})) AS j,
         words // source_size * n_blocks + (words % source_size + {BLOCK - 1}) // {BLOCK} - 1 AS last_j,
         CASE WHEN words % source_size = 0 THEN {BLOCK} ELSE (words % source_size - 1) % {BLOCK} + 1 END AS least_words FROM sources),
sized_draws AS (SELECT *, CASE WHEN j = last_j THEN least_words ELSE {BLOCK} END AS most FROM numbered),
walk AS (
  SELECT src, j // n_blocks AS pass, j, n_full, most, j % n_blocks AS v, 0 AS step, [{keys.replace('pass', '(j // n_blocks)')}] AS keys,
         greatest(1, (length(bin(greatest(n_full, 2) - 1)) + 1) // 2)::INTEGER AS half,
         (1::BIGINT << greatest(1, (length(bin(greatest(n_full, 2) - 1)) + 1) // 2)::INTEGER) - 1 AS low
  FROM sized_draws WHERE j % n_blocks < n_full
  UNION ALL
  SELECT src, pass, j, n_full, most, (l{ROUNDS} << half) | r{ROUNDS}, step + 1, keys, half, low FROM ({network})),
times AS (
  SELECT src, v AS block, most FROM walk WHERE step > 0 AND v < n_full
  UNION ALL SELECT src, n_full, most FROM sized_draws WHERE j % n_blocks = n_full),
parts AS (SELECT src, nth, start, size, unnest(range(start // {BLOCK}, (start + size - 1) // {BLOCK} + 1)) AS block FROM placed WHERE size > 0),
taken AS (
  SELECT src, nth, sum(greatest(0, least(start + size, block * {BLOCK} + most) - greatest(start, block * {BLOCK})))::BIGINT AS taken
  FROM parts JOIN times USING (src, block) GROUP BY ALL)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken
FROM placed JOIN levelled USING (src) LEFT JOIN taken USING (src, nth)
"""


ORACLE = _oracle()
