"""All labelled rows are learned from, however many there are and however they are dealt."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from spanveil.llm import toxicity

DOCS, LABELS = "doc_id long, text string, lang string, source string", "doc_id long, quality int, toxic int"


def prose(rng, words, n=15):
    return [words[i] for i in rng.integers(0, len(words), n)]


def test_rows_beyond_two_thousand_of_a_class_are_learned_from(spark):
    """The toxic rows whose ids hash highest have a word of their own; held-out rows with it are found."""
    rng, words = np.random.default_rng(11), [f"plain{k}" for k in range(60)]
    ids = [r.id for r in spark.range(6800).where("id % 2 = 1").orderBy(F.xxhash64("id")).collect()]
    learned = [k for k in ids if zlib.crc32(str(k).encode()) % 4 != toxicity.HELD_OUT]
    assert len(learned) > 2200
    last = set(learned[2000:]) | {k for k in ids if zlib.crc32(str(k).encode()) % 4 == toxicity.HELD_OUT}
    rows = [(k, " ".join(prose(rng, words) + ["latefilth" if k in last else "earlyfilth"] * (k % 2)), "en", "s") for k in range(6800)]
    df, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(k, 1, k % 2) for k in range(6800)], LABELS)
    assert len(toxicity.sample(df, lab)) == sum(zlib.crc32(str(k).encode()) % 4 != toxicity.HELD_OUT for k in range(6800))
    held = [r for r in toxicity.scored(df, lab).collect() if r.held_out]
    toxic = [r for r in held if r.doc_id % 2]
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic)
    assert sum(r.predicted for r in held if r.doc_id % 2 == 0) <= 0.1 * (len(held) - len(toxic))


def test_shards_learn_the_same_however_rows_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD", 60)
    monkeypatch.setattr(toxicity, "LEAST_STEPS", 20)
    rng, words = np.random.default_rng(12), [f"plain{k}" for k in range(40)]
    rows = [(k, " ".join(prose(rng, words) + ["filth"] * (k % 3 == 0)), ["en", None][k % 2], "s") for k in range(400)]
    rows += [rows[3], (5, "another text under a used id", "de", "s"), (None, "no id", "en", "s"), (900, None, "en", "s"), (901, "", "en", "s")]
    df = spark.createDataFrame(rows, DOCS)
    lab = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(400)] + [(900, 1, 0), (901, 1, 0), (7, 0, 0), (8, 1, 1), (None, 1, 1), (9, 1, 5)], LABELS)
    one, other = toxicity.train(df.coalesce(1), lab), toxicity.train(df.orderBy("text").repartition(7), lab.repartition(5))
    assert np.array_equal(one.embedding, other.embedding) and np.array_equal(one.weights, other.weights)
    assert (one.bias, one.scale, one.thresholds) == (other.bias, other.scale, other.thresholds)
    held = {r.doc_id: r.score for r in toxicity.scored(df.limit(400), lab).collect() if r.held_out}
    assert sum((score >= toxicity.CUT) == (k % 3 == 0) for k, score in held.items()) >= 0.9 * len(held)


def test_a_shard_of_one_class_is_learned_from_and_one_class_alone_is_not(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD", 8)
    monkeypatch.setattr(toxicity, "LEAST_STEPS", 2)
    rows = [(k, f"some words {'filth' if k == 1 else 'here'} {k}", "en", "s") for k in range(40)]
    df = spark.createDataFrame(rows, DOCS)
    told = spark.createDataFrame([(k, 1, int(k == 1)) for k in range(40)], LABELS)
    assert zlib.crc32(b"1") % 4 != toxicity.HELD_OUT
    assert toxicity.train(df, told) is not None
    assert toxicity.train(df, told.withColumn("toxic", F.lit(0))) is None


def test_documents_without_labels_are_left_before_the_join(spark):
    df = spark.createDataFrame([(k, "t", "en", "s") for k in range(4000)] + [(None, "t", "en", "s")], DOCS)
    told = toxicity.usable(spark.createDataFrame([(k, 1, 0) for k in range(0, 4000, 40)], LABELS))
    wanted, found = {r.label_id for r in told.collect()}, {r.doc_id for r in toxicity.likely(df, told).collect()}
    assert wanted <= found and len(found) < 0.2 * 4000
