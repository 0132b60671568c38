"""Approximate nearest neighbours by counting collisions of single projections.

Every vector is projected on ``PROJECTIONS`` random lines, one sorted array per line.  A row
collides with a query on a line when it lies in the window of width ``WINDOW * R`` around the
query's own place.  For a row at distance R that happens with a known chance, so the number of
collisions of such a row has a binomial law; rows with at least its ``MISS`` quantile are
verified by their cosine.  The radius R starts small and grows by ``GROWTH``: windows are only
widened, so earlier counts are kept (virtual rehashing).  When a query has its k verified rows, R
goes to the distance of the k-th of them, and there the search ends; a row as near as that is
then missed with probability ``MISS`` at most.  At R = 2 windows and counts stop to matter, as no
unit vector is farther: all rows left are verified.  Nothing is capped.

Rows are dealt by a hash to blocks of at most about ``BLOCK`` rows, queries to chunks of
``QUERIES``; each pair of a block and a chunk is a task of bounded size, that builds the block's
arrays, and the k best of each block are merged.  With more vectors there are more blocks, not
larger ones, and equal vectors lie in all of them.  Work is in proportion to queries times rows.

Defined cases: vectors that are null, empty, zero or hold a null, a NaN or an infinity take no
part, neither do they as queries.  A query is compared with vectors of its own length.  A
candidate is every row but the query's own; so another row with the same vec_id is one, and a
repeated query row is searched again.  A null vec_id is never a query and comes last among ties.
An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

NEAREST = 5
EVERY = 50
PROJECTIONS, WINDOW, MISS = 96, 2.3, 0.02
START, GROWTH = 0.25, 1.25
BLOCK, QUERIES = 1 << 15, 1 << 14
#: Blocks are made at least, so that a small table is dealt out too.
LEAST_BLOCKS = 8
SEED = 11


@lru_cache(maxsize=64)
def threshold(m: int = PROJECTIONS, window: float = WINDOW, miss: float = MISS) -> int:
    """The largest count that a row at distance R reaches with probability ``1 - miss`` at least."""
    p = math.erf(window / 2 / math.sqrt(2))
    below, count = 0.0, 0
    while (below := below + math.comb(m, count) * p**count * (1 - p) ** (m - count)) <= miss:
        count += 1
    return max(1, count)


def units(x: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines in double precision; equal rows give equal numbers."""
    scale = np.abs(rows).max(axis=1)
    if 1e-100 < scale.min() and scale.max() < 1e100 and 1e-100 < np.abs(q).max() < 1e100:
        return (rows * q).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((q * q).sum()))
    return (units(rows) * units(q[None, :])[0]).sum(axis=1)


class Block:
    """The sorted projections of some vectors."""

    def __init__(self, x: np.ndarray, seed: int = SEED):
        self.x, (self.n, dim) = x, x.shape
        self.lines = np.random.Generator(np.random.Philox(seed)).normal(size=(dim, PROJECTIONS))
        places = units(x) @ self.lines
        order = np.argsort(places, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(places, order, axis=0).T)
        self.order = order.T.astype(np.int32).ravel()
        self.first = np.arange(PROJECTIONS, dtype=np.int64) * self.n

    def windows(self, at: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and line, the stretch of the sorted array within the window."""
        half = WINDOW * radius / 2
        lo, hi = (np.empty(at.shape, np.int64) for _ in range(2))
        for j in range(PROJECTIONS):
            lo[:, j] = np.searchsorted(self.sorted[j], at[:, j] - half)
            hi[:, j] = np.searchsorted(self.sorted[j], at[:, j] + half, "right")
        return lo, hi

    def rows_in(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The rows of one stretch per line, one after another."""
        size = hi - lo
        start = np.repeat(self.first + lo - (np.cumsum(size) - size), size)
        return self.order[start + np.arange(len(start))]

    def nearest(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int = NEAREST) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(query, rows, scores)``, the k best of each query; ``own`` is the query's row here or -1, ``ids`` decide ties."""
        need, at = threshold(), units(queries) @ self.lines
        n_queries = len(queries)
        count = [np.zeros(self.n, np.int16) for _ in range(n_queries)]
        score = [np.full(self.n, -np.inf) for _ in range(n_queries)]
        for q in np.flatnonzero(own >= 0):
            count[q][own[q]] = -PROJECTIONS - 1
        total = np.where(own >= 0, self.n - 1, self.n)
        radius = np.full(n_queries, START)
        seen_lo, _ = self.windows(at, np.zeros(n_queries))
        seen_hi = seen_lo.copy()
        todo, found, bound = np.flatnonzero(total > 0), np.zeros(n_queries, np.int64), np.full(n_queries, np.inf)
        while len(todo):
            lo, hi = self.windows(at[todo], radius[todo])
            left = []
            for t, q in enumerate(todo):
                if radius[q] >= 2:
                    new = np.flatnonzero(np.isneginf(score[q]) & (np.arange(self.n) != own[q]))
                else:
                    rows = np.concatenate([self.rows_in(lo[t], seen_lo[q]), self.rows_in(seen_hi[q], hi[t])])
                    count[q] += np.bincount(rows, minlength=self.n).astype(np.int16)
                    new = np.flatnonzero(count[q] >= need)
                    new = new[np.isneginf(score[q][new])]
                if len(new):
                    score[q][new] = cosines(self.x[new], queries[q])
                    found[q] += len(new)
                    if found[q] >= k:
                        least = np.partition(score[q], -k)[-k]
                        bound[q] = math.sqrt(max(0.0, 2 - 2 * least))
                seen_lo[q], seen_hi[q] = lo[t], hi[t]
                if found[q] < total[q] and radius[q] < min(2.0, bound[q]):
                    radius[q] = min(2.0, radius[q] * GROWTH, max(bound[q], radius[q]))
                    left.append(q)
            todo = np.array(left, np.int64)
        for q in range(n_queries):
            kept = np.flatnonzero(~np.isneginf(score[q]))
            best = kept[np.lexsort((ids[kept], -score[q][kept]))[:k]]
            if len(best):
                yield q, best, score[q][best]


def vectors(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """A written table ``uid, vec_id, dim, packed`` of the vectors that take part, one uid per row."""
    single = isinstance(table.schema[embedding].dataType.elementType, T.FloatType)
    kind = "<f4" if single else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if v and None not in v:
                    x = np.array(v, kind)
                    if np.isfinite(x).all() and x.any():
                        out.append((i, len(x), x.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["vec_id", "dim", "packed"])

    values = F.col(f"`{embedding}`") if single else F.col(f"`{embedding}`").cast("array<double>")
    rows = table.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), values.alias("v"))
    made = rows.mapInArrow(run, "vec_id long, dim int, packed binary")
    return written(made.withColumn("uid", F.monotonically_increasing_id()).withColumn("single", F.lit(single)), "vectors")


def _search(k: int, kind: str):
    def run(key, rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and queries.num_rows:

            def matrix(packed: pa.ChunkedArray) -> np.ndarray:
                return np.frombuffer(b"".join(packed.to_pylist()), kind).reshape(len(packed), -1).astype(np.float64)

            by_id = rows["vec_id"].to_pylist()
            uids = {u: i for i, u in enumerate(rows["uid"].to_pylist())}
            order = np.array([np.iinfo(np.int64).max if i is None else i for i in by_id], np.int64)
            own = np.array([uids.get(u, -1) for u in queries["q_uid"].to_pylist()], np.int64)
            asked = list(zip(queries["q_uid"].to_pylist(), queries["q_vec_id"].to_pylist(), strict=True))
            block, q = Block(matrix(rows["packed"])), matrix(queries["q_packed"])
            # Some queries at a time: each holds a count and a score per row.
            step = max(1, (1 << 22) // rows.num_rows)
            for at in range(0, len(asked), step):
                for j, best, scores in block.nearest(q[at : at + step], own[at : at + step], order, k):
                    out += [(*asked[at + j], by_id[b], s) for b, s in zip(best.tolist(), scores.tolist(), strict=True)]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array([r[j] for r in out], t) for j, t in enumerate(types)], names=["query_uid", "query_id", "vec_id", "score"])

    return run


def nearest(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", every: int = EVERY, k: int = NEAREST) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each row whose id is divisible by ``every``."""
    rows = vectors(table, vec_id, embedding)
    kind = "<f4" if isinstance(table.schema[embedding].dataType.elementType, T.FloatType) else "<f8"
    asked = (F.col("vec_id") % every == 0) & F.col("vec_id").isNotNull()
    shape = written(
        rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if(asked).alias("asked"))
        .where("asked > 0").selectExpr("dim", f"greatest({LEAST_BLOCKS}, (n + {BLOCK - 1}) div {BLOCK}) AS blocks", f"(asked + {QUERIES - 1}) div {QUERIES} AS chunks"),
        "shape",
    )
    placed = rows.join(shape, "dim")
    dealt = placed.select("dim", "uid", "vec_id", "packed", F.expr("pmod(xxhash64(uid), blocks)").alias("block"), F.explode(F.expr("sequence(0L, chunks - 1)")).alias("chunk"))
    queries = placed.where(asked).select(
        *(F.col(c).alias(f"q_{c}") for c in ("dim", "uid", "vec_id", "packed")),
        F.explode(F.expr("sequence(0L, blocks - 1)")).alias("q_block"), F.expr("pmod(xxhash64(uid, 1), chunks)").alias("q_chunk"),
    )
    keys = ["dim", "block", "chunk"]
    found = written(
        dealt.groupBy(*keys).cogroup(queries.groupBy(*(f"q_{c}" for c in keys)))
        .applyInArrow(_search(k, kind), "query_uid long, query_id long, vec_id long, score double"),
        "found",
    )
    best = Window.partitionBy("query_uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
