"""Streaming jobs against their batch forms, with late and out-of-order events."""

import datetime as dt
import os
import shutil

import pytest
from pyspark.sql import functions as F

from spanveil import versions
from spanveil.operators import alerts
from spanveil.operators.detect import detect
from spanveil.streaming import jobs

START = dt.datetime(2024, 1, 1)


def at(ms):
    return START + dt.timedelta(milliseconds=ms)


def file_stream(spark, folder, schema, batches):
    """A stream that reads one file, one of ``batches``, at a time."""
    folder.mkdir()
    for i, rows in enumerate(batches):
        target = folder / f"{i:03d}.parquet"
        written = folder.parent / f"{folder.name}-{i}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(written))
        shutil.copy(next(written.glob("*.parquet")), target)
        os.utime(target, (1e9 + i, 1e9 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(spark, df, name, checkpoint, mode="append"):
    query = (
        df.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(checkpoint)).start()
    )
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


TEXTS = "k string, ts timestamp, text string"
TEXT_BATCHES = [
    [("a", at(0), "hi"), ("a", at(500), "mail ann@nhs.uk"), ("a", at(100), "hello"), ("a", at(1000), "mail ann@nhs.uk 2"),
     ("b", at(0), "x")],
    [("a", at(1090), "mail bob@nhs.uk 3"), ("a", at(1200), " "), ("b", at(200), "y"), ("b", at(50), "late but in time")],
    [("z", at(7_200_000), "end")],
    [("a", at(2000), "too late"), ("z", at(7_200_001), "end")],
]


def test_debounce_adapts_to_the_last_level(spark, tmp_path):
    stream = file_stream(spark, tmp_path / "in", TEXTS, TEXT_BATCHES)
    rows = run(spark, jobs.debounce_stream(stream, "k", "ts", "text"), "debounced", tmp_path / "c").collect()
    assert sorted((r.k, r.text, r.level, r.fires_at) for r in rows if r.k == "a") == [
        ("a", "hello", None, at(450)), ("a", "mail ann@nhs.uk", "HIGH", at(850)),
        ("a", "mail ann@nhs.uk 2", "HIGH", at(1080)), ("a", "mail bob@nhs.uk 3", "HIGH", at(1170)),
    ]
    assert [r.text for r in rows if r.k == "b"] == ["y"]


def test_debounce_equals_batch_form(spark, tmp_path):
    stream = file_stream(spark, tmp_path / "in", TEXTS, TEXT_BATCHES)
    rows = run(spark, jobs.debounce_stream(stream, "k", "ts", "text", quiet_ms=200), "debounced2", tmp_path / "c").collect()
    events = spark.createDataFrame([r for b in TEXT_BATCHES for r in b if r[2] != "too late"], TEXTS)
    batch = alerts.debounced(events, "k", "ts", "text", "text", 200).collect()
    assert sorted((r.k, r.text, r.fires_at) for r in rows if r.k != "z") == sorted(
        (r.k, r.text, r.fires_at) for r in batch if r.k != "z"
    )


def test_alerts_equal_batch_form(spark, tmp_path):
    schema = "k string, ts timestamp, n int, kind string, sign string"
    steps = [("scan", "s1"), ("dismiss", "s1"), ("scan", "s1"), ("scan", "s2"), ("scan", "s1"), ("clear", None), ("scan", "s1"),
             ("dismiss", "s1"), ("scan", ""), ("scan", "s1")]
    rows = [(k, at(1000 * i), i, kind, sign) for k in "ab" for i, (kind, sign) in enumerate(steps)]
    batches = [rows[1::2], rows[0::2], [("z", at(7_200_000), 0, "clear", None)], [("z", at(7_200_001), 1, "clear", None)]]
    stream = file_stream(spark, tmp_path / "in", schema, batches)
    out = run(spark, jobs.alert_stream(stream, "k", "ts", "kind", "sign", "n"), "alerts", tmp_path / "c").collect()
    batch = alerts.alerts(spark.createDataFrame(rows, schema), "k", "ts", "n", "kind", "sign", chunk_s=3).collect()
    assert sorted((r.k, r.ts, r.sign, r.alerted) for r in out) == sorted((r.k, r.ts, r.sign, r.alerted) for r in batch)
    assert [r.alerted for r in sorted(batch) if r.k == "a"] == [True, False, True, False, True, True]


def test_answers_equal_batch_form(spark, tmp_path):
    schema = "scan_id string, ts timestamp, event string"
    rows = [
        ("s1", at(0), "alert"), ("s1", at(5000), "fix"), ("s2", at(0), "alert"), ("s3", at(0), "alert"), ("s3", at(9000), "open"),
        ("s3", at(60_000), "close"), ("s4", at(0), "alert"), ("s4", at(1000), "hide"), ("s5", at(0), "alert"),
        ("s5", at(1000), "hide"), ("s5", at(90_000), "show"), ("s6", at(0), "alert"), ("s6", at(2000), "open"),
        ("s6", at(3000), "show"), ("s6", at(99_000), "dismiss"), ("s7", at(0), "alert"), ("s7", at(100), "reset"),
        ("s7", at(200), "fix"), ("s2", at(40_000), "fix"),
    ]
    batches = [rows[::2], rows[1::2], [("z", at(7_200_000), "hide")], [("z", at(7_200_001), "hide")]]
    stream = file_stream(spark, tmp_path / "in", schema, batches)
    out = {(r.scan_id, r.action, r.action_ts) for r in run(spark, jobs.answer_stream(stream), "answers", tmp_path / "c").collect()}
    assert out == {
        ("s1", "fix", at(5000)), ("s2", "dismiss", at(15_000)), ("s3", "dismiss", at(75_000)),
        ("s5", "dismiss", at(105_000)), ("s6", "dismiss", at(99_000)),
    }
    df = spark.createDataFrame(rows, schema)
    batch = alerts.answered(df.where("event = 'alert'").select("scan_id", "ts"), df.where("event <> 'alert'"), chunk_s=7).collect()
    assert {(r.scan_id, r.action, r.action_ts) for r in batch if r.action} == out
    assert {r.scan_id for r in batch} == {f"s{i}" for i in range(1, 8)}


def test_detection_and_statistics_streams(spark, tmp_path):
    schema = "id int, domain string, text string"
    batches = [[(1, "x.org", "mail ann@nhs.uk"), (2, None, "ring 07700 900123")], [(3, "x.org", "10.0.0.1 a@b.com")]]
    stream = file_stream(spark, tmp_path / "in", schema, batches)
    jobs.write_findings(
        jobs.detect_stream(stream, ["id"]), str(tmp_path / "out"), str(tmp_path / "c1")
    ).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).select("id", "type", "text").collect()
    assert sorted(tuple(r) for r in found) == [
        (1, "email", "ann@nhs.uk"), (2, "uk_phone", "07700 900123"), (3, "email", "a@b.com"), (3, "ip_address", "10.0.0.1"),
    ]
    query = (
        jobs.stats_stream(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c2"))
        .foreachBatch(jobs.upsert_stats(str(tmp_path / "stats"))).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    totals = {tuple(r) for r in jobs.read_stats(spark, str(tmp_path / "stats")).collect()}
    assert totals == {("x.org", 3, 2, 1), ("unknown", 1, 0, 1)}


def test_action_join(spark, tmp_path):
    scans = file_stream(spark, tmp_path / "s", "scan_id string, ts timestamp",
                        [[("a", at(0)), ("b", at(0))], [("y", at(9_000_000))], [("z", at(9_000_001))]])
    acts = file_stream(spark, tmp_path / "a", "scan_id string, action string, ts timestamp",
                       [[("a", "fix", at(10))], [("q", "fix", at(9_000_000))], [("q", "fix", at(9_000_001))]])
    rows = run(spark, jobs.action_join(scans, acts), "joined", tmp_path / "c").where(F.col("scan_id").isin("a", "b")).collect()
    assert {(r.scan_id, r.user_action) for r in rows} == {("a", "fix"), ("b", None)}


def test_hidden_page_starts_no_clock(spark, tmp_path):
    """Written-out outcomes: a clock runs only while the page is visible and the details are shut."""
    schema = "scan_id string, ts timestamp, event string"
    rows = [
        ("h1", at(0), "alert"), ("h1", at(2000), "open"), ("h1", at(4000), "hide"), ("h1", at(6000), "close"),
        ("h2", at(0), "hide"), ("h2", at(1000), "alert"), ("h2", at(50_000), "show"),
        ("h3", at(0), "hide"), ("h3", at(1000), "alert"), ("h3", at(2000), "fix"),
        ("h4", at(0), "fix"), ("h4", at(1000), "alert"), ("h5", at(0), "fix"),
        ("h6", at(0), "alert"), ("h6", at(3000), "hide"), ("h6", at(4000), "show"), ("h6", at(5000), "reset"), ("h6", at(6000), "fix"),
    ]
    batches = [rows[::2], rows[1::2], [("z", at(7_200_000), "hide")], [("z", at(7_200_001), "show")]]
    stream = file_stream(spark, tmp_path / "in", schema, batches)
    out = {(r.scan_id, r.action, r.action_ts) for r in run(spark, jobs.answer_stream(stream), "hidden", tmp_path / "c").collect()}
    assert out == {("h2", "dismiss", at(65_000)), ("h3", "fix", at(2000)), ("h4", "dismiss", at(16_000))}
    df = spark.createDataFrame(rows, schema)
    batch = alerts.answered(df.where("event = 'alert'").select("scan_id", "ts"), df.where("event <> 'alert'"), chunk_s=3).collect()
    assert {(r.scan_id, r.action, r.action_ts) for r in batch if r.action} == out
    assert {r.scan_id for r in batch if not r.action} == {"h1", "h6"}


def test_random_answers_equal_batch_form(spark, tmp_path):
    import random

    rng = random.Random(4)
    schema = "scan_id string, ts timestamp, event string"
    rows = []
    for k in range(40):
        steps = [rng.choice(["open", "close", "hide", "show", "fix", "dismiss", "reset", "hide", "show"]) for _ in range(rng.randint(1, 8))]
        steps.insert(rng.randint(0, len(steps)), "alert")
        t = 0
        for s in steps:
            t += rng.choice([1000, 9000, 16_000])
            rows.append((f"r{k}", at(t), s))
    rng.shuffle(rows)
    batches = [rows[::3], rows[1::3], rows[2::3], [("z", at(7_200_000), "show")], [("z", at(7_200_001), "show")]]
    stream = file_stream(spark, tmp_path / "in", schema, batches)
    out = {(r.scan_id, r.action, r.action_ts) for r in run(spark, jobs.answer_stream(stream), "random", tmp_path / "c").collect()}
    df = spark.createDataFrame(rows, schema)
    batch = alerts.answered(df.where("event = 'alert'").select("scan_id", "ts"), df.where("event <> 'alert'"), chunk_s=20).collect()
    assert {(r.scan_id, r.action, r.action_ts) for r in batch if r.action} == out and out


def test_resets_of_the_other_streams(spark, tmp_path):
    schema = "k string, ts timestamp, n int, kind string, sign string"
    steps = [("scan", "s1"), ("dismiss", "s1"), ("scan", "s1"), ("reset", None), ("scan", "s1")]
    rows = [("a", at(1000 * i), i, kind, sign) for i, (kind, sign) in enumerate(steps)]
    batches = [rows, [("z", at(7_200_000), 0, "clear", None)], [("z", at(7_200_001), 1, "clear", None)]]
    stream = file_stream(spark, tmp_path / "a", schema, batches)
    out = run(spark, jobs.alert_stream(stream, "k", "ts", "kind", "sign", "n"), "resets", tmp_path / "c1").collect()
    assert [r.alerted for r in sorted(out)] == [True, False, True]
    batch = alerts.alerts(spark.createDataFrame(rows, schema), "k", "ts", "n", "kind", "sign").collect()
    assert [r.alerted for r in sorted(batch, key=lambda r: r.ts)] == [True, False, True]
    texts = "k string, ts timestamp, text string, gone boolean"
    typed = [[("a", at(0), "mail ann@nhs.uk", False), ("a", at(100), "more text", True), ("b", at(0), "text", None)], [("z", at(7_200_000), "x", False)], [("z", at(7_200_001), "x", False)]]
    stream = file_stream(spark, tmp_path / "b", texts, typed)
    out = run(spark, jobs.debounce_stream(stream, "k", "ts", "text", quiet_ms=200, reset="gone"), "resets2", tmp_path / "c2").collect()
    assert [(r.k, r.text) for r in out if r.k != "z"] == [("b", "text")]


def test_cleared_statistics(spark, tmp_path):
    path = str(tmp_path / "stats")
    write, schema = jobs.upsert_stats(path), "domain string, total long, high_risk long, medium_risk long"
    for number, rows in enumerate([[("a", 1, 1, 0)], [("b", 2, 0, 2)], [("a", 5, 4, 1)], [("a", 5, 4, 1)]]):
        write(spark.createDataFrame(rows, schema), number)
    write(spark.createDataFrame([("a", 5, 4, 1)], schema), 3)
    assert {tuple(r) for r in jobs.read_stats(spark, path).collect()} == {("a", 5, 4, 1), ("b", 2, 0, 2)}
    jobs.clear_stats(spark, path)
    assert jobs.read_stats(spark, path).count() == 0


def test_actions_of_any_time_reach_the_log(spark, tmp_path):
    """Hours late, before the scan, older than the watermark, and several: the last action is kept."""
    hour = 3_600_000
    ids = "abcdz"
    scans = [(i, at(hour), [("email", 0.9)], "paste", None, None, None) for i in ids]
    log = spark.createDataFrame(scans, "scan_id string, ts timestamp, risks array<struct<type:string,confidence:double>>, "
                                       "source string, filename string, user_action string, action_ts timestamp")
    batches = [[("a", "fix", at(hour + 10)), ("c", "ignore", at(hour - 10))], [("b", "fix", at(9 * hour)), ("d", "fix", at(8 * hour))],
               [("a", "dismiss", at(hour + 20)), ("d", "ignore", at(2 * hour)), ("q", "fix", at(0))]]
    acts = file_stream(spark, tmp_path / "a", "scan_id string, action string, ts timestamp", batches)
    path = str(tmp_path / "actions")
    query = acts.writeStream.foreachBatch(jobs.keep_actions(path)).option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    jobs.keep_actions(path)(spark.createDataFrame(batches[2], "scan_id string, action string, ts timestamp"), 2)  # a replay
    got = {r.scan_id: (r.user_action, r.action_ts) for r in jobs.answered_log(log, path).collect()}
    assert got == {"a": ("dismiss", at(hour + 20)), "b": ("fix", at(9 * hour)), "c": ("ignore", at(hour - 10)),
                   "d": ("fix", at(8 * hour)), "z": (None, None)}


def test_action_join_takes_actions_stamped_before_the_scan(spark, tmp_path):
    scans = file_stream(spark, tmp_path / "s", "scan_id string, ts timestamp", [[("a", at(1000))], [("z", at(20_000_000))]])
    acts = file_stream(spark, tmp_path / "a", "scan_id string, action string, ts timestamp", [[("a", "fix", at(10))], [("q", "fix", at(20_000_000))]])
    rows = run(spark, jobs.action_join(scans, acts), "early", tmp_path / "c").where("scan_id = 'a'").collect()
    assert [(r.scan_id, r.user_action) for r in rows] == [("a", "fix")]


STATS = "domain string, total long, high_risk long, medium_risk long"


@pytest.mark.parametrize("step", ["data", "pointer", "forget"])
def test_statistics_survive_a_kill_at_any_write(spark, tmp_path, monkeypatch, step):
    """A writer that ends between two writes leaves the old totals or the new ones, and a replay the new ones."""
    path = str(tmp_path / "stats")
    write = jobs.upsert_stats(path)
    old, new = {("a", 1, 1, 0), ("b", 2, 0, 2)}, {("a", 5, 4, 1), ("b", 2, 0, 2)}
    write(spark.createDataFrame([("a", 1, 1, 0), ("b", 2, 0, 2)], STATS), 0)
    batch = spark.createDataFrame([("a", 5, 4, 1)], STATS)

    def killed(*_, **__):
        raise RuntimeError("killed")

    with monkeypatch.context() as patch:
        if step == "data":
            patch.setattr(versions, "commit", killed)
        else:
            patch.setattr(versions, "_point" if step == "pointer" else "forget", killed)
        with pytest.raises(RuntimeError, match="killed"):
            write(batch, 1)
    assert {tuple(r) for r in jobs.read_stats(spark, path).collect()} == (new if step == "forget" else old)
    write(batch, 1)
    assert {tuple(r) for r in jobs.read_stats(spark, path).collect()} == new


def test_old_versions_of_statistics_are_removed(spark, tmp_path):
    path = str(tmp_path / "stats")
    write = jobs.upsert_stats(path)
    for number in range(6):
        write(spark.createDataFrame([(f"d{number}", number, 0, 0)], STATS), number)
    assert jobs.read_stats(spark, path).count() == 6
    assert len(list((tmp_path / "stats" / "totals").iterdir())) == 2
    assert len(list((tmp_path / "stats" / "pointers").glob("part-*.json"))) == 2
    jobs.clear_stats(spark, path)
    write(spark.createDataFrame([("z", 1, 0, 0)], STATS), 6)
    assert [r.domain for r in jobs.read_stats(spark, path).collect()] == ["z"]


def test_redact_all_writes_texts_and_actions_together(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "fixed")
    rows = [("s1", "mail a@b.org and 07700 900123", "so mail a@b.org or 07700 900123 x", at(1)), ("s2", "nothing", "nothing", at(2)), ("s3", "c@d.org", "gone", at(3))]
    found = detect(spark.createDataFrame(rows, "scan_id string, text string, new_text string, ts timestamp"))
    write = jobs.redact_all_writer(path)
    write(found, 0)
    told = {("s1", "so mail [EMAIL_1] or [PHONE_1]    x", "fix"), ("s3", "gone", "fix")}
    texts = lambda: {(r.scan_id, r.redacted, r.user_action) for r in jobs.redacted_texts(spark, path).collect()}
    assert {(i, " ".join(t.split()), a) for i, t, a in texts()} == {(i, " ".join(t.split()), a) for i, t, a in told}
    with monkeypatch.context() as patch:
        patch.setattr(versions, "_point", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            write(found, 1)
    assert len(texts()) == 2
    # Replays of both batches write nothing twice.
    for number in (0, 0, 1, 1):
        write(found.where("scan_id <> 's3'") if number else found, number)
    assert jobs.redacted_texts(spark, path).count() == 3
    log = spark.createDataFrame([(i, at(0), [("email", 0.9)], "paste", None, None, None) for i in ("s1", "s2", "s3")], "scan_id string, ts timestamp, risks "
                                "array<struct<type:string,confidence:double>>, source string, filename string, user_action string, action_ts timestamp")
    assert {(r.scan_id, r.user_action) for r in jobs.fixed_log(log, path).collect()} == {("s1", "fix"), ("s2", None), ("s3", "fix")}
