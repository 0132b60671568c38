"""Nearest neighbours by collision counting against brute force."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from spanveil.llm import neighbours, queries

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank int"


def plain(rows, every, k=5):
    """Query row to its nearest ``(vec_id, score)``, by every pair."""
    good = [(i, np.array(v, np.float64)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    out = []
    for a, (i, x) in enumerate(good):
        if i is not None and i % every == 0:
            scored = [(float(x @ y / math.sqrt(x @ x) / math.sqrt(y @ y)), j) for b, (j, y) in enumerate(good) if b != a and len(y) == len(x)]
            out.append((i, sorted(scored, key=lambda s: (-round(s[0], 9), s[1] is None, s[1] or 0))[:k]))
    return out


def hostile_vectors(seed=3):
    rng = np.random.default_rng(seed)
    rows = [(k, rng.normal(size=16).tolist()) for k in range(600)]
    rows += [(1000 + k, (rng.normal(size=16) + 4).tolist()) for k in range(200)]
    rows += [(2000 + k, [1.0] * 16) for k in range(150)] + [(3000 + k, [2.0] * 16) for k in range(20)]
    rows += [(4000, [0.0] * 16), (4020, None), (4040, []), (4060, [float("nan")] * 16), (4080, [1.0, None] * 8), (4100, [float("inf")] + [1.0] * 15)]
    rows += [(5000 + 20 * k, [float(k), 1.0, 0.0]) for k in range(4)] + [(None, rows[40][1]), (40, rows[40][1]), (60, [1e-30] + [0.0] * 15), (80, [1e30] * 15 + [0.0])]
    return rows


def found_by_query(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.query_id].append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


def test_nearest_of_hostile_vectors(spark):
    rows = hostile_vectors()
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA).repartition(4)
    found = defaultdict(list)
    for r in neighbours.nearest(df, every=20).collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    rounded = [(i, [float(np.float32(x)) if x is not None else None for x in v] if v is not None else None) for i, v in rows]
    told = plain(rounded, 20)
    assert set(found) == {q for q, best in told if best}
    hits = total = 0
    for q in set(found):
        wanted = [best for i, best in told if i == q]
        assert len(found[q]) == sum(map(len, wanted))
        assert {r for r, _, _ in found[q]} == set(range(1, len(wanted[0]) + 1))
        if len(wanted) == 1:
            hits += len({v for _, v, _ in found[q]} & {j for _, j in wanted[0]})
            total += len(wanted[0])
            by_id = dict((j, s) for s, j in wanted[0])
            assert all(abs(by_id[v] - s) < 1e-12 for _, v, s in found[q] if v in by_id)
    assert hits >= 0.95 * total
    # Equal vectors: the smallest ids, in order.
    assert [v for _, v, _ in sorted(found[2020])] == [2000, 2001, 2002, 2003, 2004]
    assert [v for _, v, _ in sorted(found[3000])] == [2000, 2001, 2002, 2003, 2004]


def test_empty_and_small_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1, "x", 1), (1, [0.5, 0.5], 1, "x", 1), (2, None, 1, "x", 1)], SCHEMA)
    assert [tuple(r)[:3] for r in neighbours.nearest(df).collect()] == [(0, 1, 1)]
    assert neighbours.nearest(df.limit(0)).count() == 0
    assert neighbours.nearest(df.where("vec_id = 0")).count() == 0
    assert neighbours.nearest(df.where("vec_id = 1")).count() == 0
    wide = spark.createDataFrame([(0, [1e200, 1e200]), (1, [1e-200, 0.0]), (50, [1e200, 0.0])], "vec_id long, embedding array<double>")
    found = found_by_query(neighbours.nearest(wide))
    assert [(v, round(s, 12)) for _, v, s in found[50]] == [(1, 1.0), (0, round(math.sqrt(0.5), 12))]


def test_recall_on_the_table(spark):
    """At least 0.9 of the five nearest by brute force; measured 1.0 at sf0.1."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    x, ids = np.array(table.embedding.tolist(), np.float64), table.vec_id.to_numpy()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    found = found_by_query(queries.op12_neighbours(spark, "/root/testdata/sf0.1"))
    hits = 0
    for row in np.flatnonzero(ids % 50 == 0):
        near = unit @ unit[row]
        near[row] = -2
        hits += len(set(ids[np.argsort(-near)[:5]].tolist()) & {v for _, v, _ in found[int(ids[row])]})
    assert hits >= 0.97 * 5 * len(found)


def test_the_threshold_is_the_quantile_of_the_counts():
    need, p = neighbours.threshold(), math.erf(neighbours.WINDOW / 2 / math.sqrt(2))
    rng = random.Random(1)
    reached = sum(sum(rng.random() < p for _ in range(neighbours.PROJECTIONS)) >= need for _ in range(4000))
    assert reached >= 0.965 * 4000
    assert neighbours.threshold(miss=1e-9) < need


@pytest.mark.parametrize("least, queries_each", [(1, 1 << 14), (40, 3)])
def test_blocks_and_chunks_give_the_same(spark, monkeypatch, least, queries_each):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 24))
    rows = [(k, (centres[k % 30] + 0.05 * rng.normal(size=24)).tolist()) for k in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(neighbours, "LEAST_BLOCKS", least)
    monkeypatch.setattr(neighbours, "QUERIES", queries_each)
    found = found_by_query(neighbours.nearest(df))
    told = {q: [j for _, j in best] for q, best in plain(rows, 50)}
    hits = sum(len({v for _, v, _ in found[q]} & set(told[q])) for q in told)
    assert hits >= 0.95 * 5 * len(told)
