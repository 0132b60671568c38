"""Settings, names, ties and plain versions of the trained operators."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from spanveil.llm import bpe, common, exact_dups, licenses, mixing, near_dups, pii, quality, sharding, toxicity

from .test_corpus import toxic_rows

CLASHING = "doc_id long, text string, lang string, source string, score double, rejected boolean, held_out int, threshold string, n int, made string, row string, k long, `a.b` string, digest int"


@pytest.fixture
def folder(spark, tmp_path):
    made, labels = toxic_rows(120)
    made += [(500 + k, "one text and its copies", "en", None) for k in range(5)] + [(None, None, None, None), (600, "", None, "s"), made[3], made[3]]
    rows = [(*r, 0.5, True, 1, "t", 7, "m", "r", 9, "dot", 3) for r in made]
    spark.createDataFrame(rows, CLASHING).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_pass_on_columns_of_any_name(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == names
            kept = {tuple(r)[4:] for r in docs.collect()}
            assert kept <= {tuple(r)[4:] for r in before.collect()} and kept
    assert Counter(map(tuple, corpus_pipeline.run(spark, folder).collect())) == Counter(map(tuple, docs.collect()))


def test_stages_of_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def test_the_pipeline_leaves_one_table(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "scratch", lambda _: f"{tmp_path}/scratch")
    found = corpus_pipeline.run(spark, folder)
    assert len(list((tmp_path / "scratch" / "spanveil").iterdir())) == 1
    assert found.count() > 0


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Conf:
        get = staticmethod(lambda *_: None)

    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.scratch(Session())


def test_sizes_and_the_session_setting(spark, docs):
    sizes = {"64m": 64 << 20, "1g": 1 << 30, "4194304": 4 << 20, "4mb": 4 << 20, "10k": 10 << 10, "-1": -1, "7b": 7}
    assert {s: common.bytes_in(s) for s in sizes} == sizes
    before = spark.conf.get(common.BATCH_SETTING)
    for value in ("64m", "1g", "1000000"):
        spark.conf.set(common.BATCH_SETTING, value)
        assert bpe.digested(docs.limit(5), corpus_pipeline.public_tokenizers.path("word_bpe_49k.json")).count() == 5
        assert spark.conf.get(common.BATCH_SETTING) == value
    spark.conf.set(common.BATCH_SETTING, before)


@pytest.mark.parametrize("operator", [sharding.shards, licenses.licenses, quality.rules, exact_dups.exact_duplicates, near_dups.near_duplicates, mixing.taken])
def test_results_do_not_depend_on_ansi_mode(spark, docs, operator):
    told = Counter(map(tuple, operator(docs).collect()))
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        assert Counter(map(tuple, operator(docs).collect())) == told
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_targets_of_small_sources_are_met(spark):
    rng = random.Random(3)
    rows = [(k, "w " * rng.choice([0, 1, 2, 5, 9, 40, 63, 64, 65, 130]), f"s{k % 23}") for k in range(60)] + [(100 + k, "big " * 700, "big") for k in range(4)]
    found = mixing.taken(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target, sizes = Counter(), {}, Counter()
    source = {r[0]: r[2] for r in rows}
    for r in found:
        taken[source[r.doc_id]] += r.taken
        sizes[source[r.doc_id]] += r.size
        target[source[r.doc_id]] = r.target
        assert r.taken <= 2 * r.size
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-9 for s in target)


def test_quality_references(spark):
    clean = [" ".join(f"wort{i}x{j}" for j in range(60)) for i in range(30)]
    junk = " ".join(f"#*%|{j}#*%|" for j in range(80))
    rows = [(k, t, None if k % 2 else "it") for k, t in enumerate(clean)] + [(100, junk, None), (101, junk, "it"), (102, junk, "only")]
    kept = {r.doc_id: r.kept for r in quality.rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(kept[k] for k in range(30)) and not kept[100] and not kept[101]
    assert kept[102], "a language with one document is its own reference"


def test_kept_rows_of_equal_documents_do_not_depend_on_the_order(spark):
    rows = [(1, "same text here", f"s{k}") for k in range(9)] + [(2, "same text here", "t")] + [(3, "word " * 70, f"u{k}") for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for operator in (exact_dups.without_exact_duplicates, near_dups.without_near_duplicates, mixing.mixed, lambda d: exact_dups.without_exact_duplicates(d, heavy=1)):
        told = Counter(map(tuple, operator(df.coalesce(1)).collect()))
        assert Counter(map(tuple, operator(df.orderBy("source", ascending=False).repartition(4)).collect())) == told


def test_rows_equal_to_a_heavy_winner_are_numbered_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(exact_dups, "STRETCH", 4)
    df = spark.createDataFrame([(1, "a b")] * 11 + [(2, "ab")] * 2 + [(3, "c")], "doc_id long, text string")
    found = Counter((r.doc_id, r.group_size, r.kept) for r in exact_dups.exact_duplicates(df, heavy=2).collect())
    assert found == Counter({(1, 13, True): 1, (1, 13, False): 10, (2, 13, False): 2, (3, 1, True): 1})


def test_contradicting_labels_and_repeated_ids(spark):
    made, labels = toxic_rows(120)
    df = spark.createDataFrame(made, "doc_id long, text string, lang string, source string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    more = df.unionByName(spark.createDataFrame([(made[4][0], "other text under the id", "de", "s")], df.schema))
    twice = lab.unionByName(lab.where("doc_id = 8").selectExpr("doc_id", "quality", "1 - toxic AS toxic"))
    assert 8 not in {r[0] for r in toxicity.sample(df, twice)} and 8 in {r[0] for r in toxicity.sample(df, lab)}
    told = [(r[:3], r[3].tolist()) for r in toxicity.sample(more.coalesce(1), lab)]
    assert [(r[:3], r[3].tolist()) for r in toxicity.sample(more.repartition(7), lab)] == told


def plain_score(model, text):
    """The convolutional forward pass with loops over words, filters and places."""
    words = toxicity.words_of(text.encode()) or [b""]
    vectors = []
    for w in words:
        buckets = [zlib.crc32(b"=" + w) % (toxicity.BUCKETS - 1) + 1 if w else 0]
        buckets += [zlib.crc32(w[:k]) % (toxicity.BUCKETS - 1) + 1 for k in toxicity.PREFIXES if len(w) >= k]
        vectors.append([sum(float(model.embedding[b][i]) for b in buckets) for i in range(toxicity.DIM)])
    vectors += [[0.0] * toxicity.DIM] * 2
    tops = []
    for width in toxicity.WIDTHS:
        for f in range(toxicity.FILTERS):
            made = sorted((float(model.biases[width][f]) + sum(vectors[at + k][i] * float(model.filters[width][k][i][f]) for k in range(width) for i in range(toxicity.DIM)) for at in range(len(words))), reverse=True)
            tops.append((made[0], made[1] if len(made) > 1 else made[0]))
    n = len(tops)
    logit = model.bias + sum(max(0.0, tops[j][r]) * float(model.weights[r * n + j]) for r in (0, 1) for j in range(n))
    return 1 / (1 + math.exp(-(model.scale[0] * logit + model.scale[1])))


def test_scores_by_a_plain_forward_pass(spark):
    made, labels = toxic_rows(200)
    df = spark.createDataFrame(made, "doc_id long, text string, lang string, source string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(df, lab)
    texts = [r[1] for r in made[:18]] + ["", "one Word"]
    found = toxicity.scored(spark.createDataFrame([(1000 + k, t, "en", "s") for k, t in enumerate(texts)] + made, df.schema), lab).collect()
    score = {r.doc_id: r.score for r in found}
    for k, text in enumerate(texts):
        assert score[1000 + k] == pytest.approx(plain_score(model, text), abs=2e-4)


def plain_tags(p, codes):
    """Bidirectional LSTM and Viterbi with loops."""
    def sigmoid(v):
        return 1 / (1 + math.exp(-v))

    def run(d, order):
        h = pii.HIDDEN
        hidden, cell, out = [0.0] * h, [0.0] * h, {}
        for t in order:
            z = [float(p["x" + d][codes[t]][j] + p["c" + d][j]) + sum(hidden[i] * float(p["h" + d][i][j]) for i in range(h)) for j in range(4 * h)]
            cell = [sigmoid(z[h + j]) * cell[j] + sigmoid(z[j]) * math.tanh(z[3 * h + j]) for j in range(h)]
            hidden = [sigmoid(z[2 * h + j]) * math.tanh(cell[j]) for j in range(h)]
            out[t] = hidden
        return out

    n = len(codes)
    forward, back = run("f", range(n)), run("b", range(n - 1, -1, -1))
    emitted = [[float(p["bias"][y]) + sum(v * float(p["out"][i][y]) for i, v in enumerate(forward[t] + back[t])) for y in range(pii.TAGS)] for t in range(n)]
    barred = lambda a, b: b and b % 2 == 0 and a not in (b - 1, b)
    best, came = [emitted[0][y] + (-1e4 if barred(0, y) else 0) for y in range(pii.TAGS)], []
    for t in range(1, n):
        step = [max((best[a] + float(p["move"][a][y]) + (-1e4 if barred(a, y) else 0), -a) for a in range(pii.TAGS)) for y in range(pii.TAGS)]
        came.append([-s[1] for s in step])
        best = [step[y][0] + emitted[t][y] for y in range(pii.TAGS)]
    tags = [max(range(pii.TAGS), key=lambda y: best[y])]
    for row in reversed(came):
        tags.append(row[tags[-1]])
    return tags[::-1]


@pytest.fixture(scope="module")
def tagger():
    rng = random.Random(1)
    xs, ys = [], []
    for _ in range(300):
        mail = f"{''.join(rng.choice('abcdefgh') for _ in range(rng.randint(1, 30)))}@m{rng.randint(1, 9)}.example.com"
        text = f"{'word ' * rng.randint(0, 5)}{rng.choice([mail, '10.20.30.40', '3.14'])}{' more' * rng.randint(0, 5)}"[: pii.WIDTH]
        x, y = np.zeros(pii.WIDTH, np.uint8), np.zeros(pii.WIDTH, np.int64)
        x[: len(text)] = pii.classes(text)
        for k, s, e in pii.base_spans(text):
            y[s:e], y[s] = 2 + 2 * k, 1 + 2 * k
        xs.append(x), ys.append(y)
    made = pii.Tagger()
    made.fit(np.array(xs), np.array(ys), steps=120)
    return made


def test_tags_by_a_plain_decoder(tagger):
    for text in ["so jo@m1.example.com more", "at 10.20.30.40 and 3.14", "x", "word é@a.b word", "1 2 3 4 5 6 7 8"]:
        codes = pii.classes(text)
        assert tagger.decode(tagger.emissions(codes[None]))[0].tolist() == plain_tags(tagger.p, codes.tolist())


def test_long_spans_are_found_at_any_offset(tagger):
    """A span of any length is found or not wherever in the text it stands, and so wherever windows begin."""
    for size in (40, 70, 130, 400):
        mail = "é" + "abcdefgh" * (size // 8) + "@m1.example.com"
        seen = set()
        for lead in range(0, 120, 7):
            text = "w" * lead + " word" * 200 + " " + mail + " more" * 200
            at = text.index(mail)
            seen.add(tuple((k, s - at, e - at) for k, s, e in pii.added_spans(tagger, [text], [[]])[0] if e > at and s < at + len(mail)))
        assert len(seen) == 1, (size, seen)
        if size <= 70:
            assert any(k == 0 and e == len(mail) for k, _, e in seen.pop())


def test_hostile_digit_runs_are_decoded_in_bounded_time(tagger):
    pii.added_spans(tagger, ["1 2-3 " * 4000, "@" * 20000], [[], []])


def test_groups_of_labels_are_counted(spark, docs, rows):
    """Repeated rows are documents of their own in every operator with one row per document."""
    told = Counter(r[0] for r in rows)
    for operator in (exact_dups.exact_duplicates, near_dups.near_duplicates, mixing.taken, licenses.licenses, quality.rules, sharding.shards):
        found = defaultdict(int)
        for r in operator(docs).collect():
            found[r.doc_id] += 1
        assert found == told
