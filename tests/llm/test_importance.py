"""Importance resampling against a plain version and SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanveil.llm import importance

UPPER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, order, buckets):
    words = WORD.findall((text or "").translate(UPPER))
    runs = [" ".join(words[k : k + n]) for n in range(1, order + 1) for k in range(len(words) - n + 1)]
    return len(words), Counter(zlib.crc32(r.encode()) % buckets for r in runs)


def plain(docs, target, order=1, buckets=10_000, least=20, percent=10):
    """``(doc_id, n_features, weight, score, rank)`` of ``(doc_id, text)`` rows."""
    found = [plain_features(t, order, buckets) for _, t in docs]
    sums, wanted = Counter(), Counter()
    for _, f in found:
        sums.update(f)
    for t in target:
        wanted.update(plain_features(t, order, buckets)[1])
    s_all, t_all = sum(sums.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s_all + buckets) / ((sums[b] + 1) * (t_all + buckets))))
    rows = []
    for (doc_id, _), (n_words, f) in zip(docs, found, strict=True):
        n = sum(f.values())
        weight = sum(gain(b) * k for b, k in f.items()) // n if n else 0
        h = int(hashlib.sha256(f"2024:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[4], r[1]))
    drawn = len(able) * percent // 100
    return [(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(able)] + [(*r[:4], None) for r in rows if r[4] < least]


TARGET = ["the THE house-of-cards é", None, "", "cc by the 12 中文", "one two three"]


@pytest.mark.parametrize("order, buckets, percent", [(1, 10_000, 10), (3, 50, 40), (2, 70_000, 100)])
def test_importance(spark, docs, rows, order, buckets, percent):
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    found = importance.importance(docs, target, order=order, buckets=buckets, percent=percent)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, found.collect())) == Counter(plain([r[:2] for r in rows], TARGET, order, buckets, percent=percent))


def test_empty_tables(spark, docs, rows, nothing):
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    assert importance.importance(nothing, target).count() == 0
    without = importance.importance(docs, target.limit(0)).collect()
    assert Counter(map(tuple, without)) == Counter(plain([r[:2] for r in rows], []))


def test_resampled_documents_keep_their_columns(spark, docs, rows):
    clashing = docs.withColumnsRenamed({"shard": "weight", "digest": "rank", "kept": "a.b", "row": "sums"}).withColumn("score", docs.n_chars)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    found = importance.resampled(clashing, target, percent=50)
    assert found.columns == clashing.columns
    drawn = Counter(r[0] for r in plain([r[:2] for r in rows], TARGET, percent=50) if r[4])
    assert Counter(r.doc_id for r in found.collect()) == drawn


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aZ09 .\n\t`{éÉ中🙂\x7f", max_size=60))
def test_overlapping_spans(text):
    n_words, plain_found = plain_features(text, 3, 1 << 16)
    found = importance.features(text.encode(), [importance.n_grams(n) for n in (1, 2, 3)], 1 << 16)
    assert (found[0], dict(zip(found[2].tolist(), found[3].tolist(), strict=True))) == (n_words, dict(plain_found))
    assert found[1] == sum(plain_found.values())


def test_ranks_over_many_partitions(spark):
    df = spark.range(5000).selectExpr("id % 7 AS score", "id").repartition(9)
    found = importance.ranked(df, ["score", "id"], "rank").collect()
    assert [r.id for r in sorted(found, key=lambda r: r["rank"])] == sorted(range(5000), key=lambda k: (k % 7, k))
    assert sorted(r["rank"] for r in found) == list(range(1, 5001))
