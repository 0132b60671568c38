"""Resolution, merging, redaction, relocation and segments on small tables."""

import random

from pyspark.sql import functions as F

from spanveil.operators import carry, merge, redact, relocate, risklog, segments
from spanveil.operators.detect import detect
from spanveil.operators.detectors import CANDIDATE_TYPE
from spanveil.operators.resolve import resolve


def brute_force(candidates):
    kept = []
    for c in sorted(candidates, key=lambda c: (c[1], c[2])):
        if all(c[3] <= k[2] or c[0] >= k[3] for k in kept):
            kept.append(c)
    return sorted(kept)


def test_resolve_equals_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        found = []
        for rank in range(1, 6):
            at = 0
            for _ in range(rng.randrange(0, 6)):
                check = at + rng.randrange(0, 12)
                start = check + rng.randrange(0, 3)
                end = start + rng.randrange(1, 9)
                found.append((check, rank, start, end, "t", "x", 0.5))
                at = end
        rows.append((i, found))
    df = spark.createDataFrame(rows, f"id int, c {CANDIDATE_TYPE}")
    for row in df.select("id", F.expr(resolve("c")).alias("kept")).collect():
        assert [tuple(k) for k in row.kept] == brute_force(rows[row.id][1])


def test_redaction(spark):
    df = spark.createDataFrame([(1, "a@b.com and c@d.com then a@b.com"), (2, "nothing")], "id int, text string")
    found = detect(df)
    bare = {r.id: r.redacted for r in redact.redact(found, pad=False).collect()}
    assert bare == {1: "[EMAIL_1] and [EMAIL_2] then [EMAIL_3]", 2: "nothing"}
    padded = redact.redact(found.withColumn("text", F.col("text"))).first().redacted
    assert len(padded) >= len("a@b.com and c@d.com then a@b.com")
    long = spark.createDataFrame([(1, "write to christopher.robin@hundred.org now")], "id int, text string")
    assert redact.redact(detect(long)).first().redacted == "write to [EMAIL_1]                     now"


def test_redaction_of_many_findings_equals_python(spark):
    text = "; ".join(f"u{i}@host{i}.org and 07700 9{i:05d}" for i in range(400))
    row = redact.redact(detect(spark.createDataFrame([(1, text)], "id int, text string")), pad=False).first()
    expected, pos, n = "", 0, {}
    for f in row.findings:
        n[f.type] = n.get(f.type, 0) + 1
        word = {"email": "EMAIL", "uk_phone": "PHONE"}[f.type]
        expected += text[pos:f.start] + f"[{word}_{n[f.type]}]"
        pos = f.end
    assert len(row.findings) == 800 and row.redacted == expected + text[pos:]


def test_unknown_type_and_aliases(spark):
    df = spark.createDataFrame(
        [("0123456789", [(0, 2, "phone"), (3, 5, "uk_phone"), (6, 8, "odd")])],
        "text string, findings array<struct<start:int,end:int,type:string>>",
    )
    assert redact.redact(df, pad=False).first().redacted == "[PHONE_1]2[PHONE_1]5[PII_1]89"


def test_merge_keeps_order_and_drops_bad_offsets(spark):
    df = detect(spark.createDataFrame([(1, "mail a@b.com from Full Name today")], "id int, text string"))
    second = "array(" + ", ".join(
        f"named_struct('type', '{t}', 'text', '{x}', 'start', {s}, 'end', {e}, 'confidence', {c}D)"
        for t, x, s, e, c in [
            ("email", "a@b.com", 5, 12, 0.9), ("name", "Full Name", 18, 27, 0.9), ("note", "today", 28, 33, 97),
            ("note", "oday", 29, 33, 0.9), ("note", "wrong", 0, 4, 0.9), ("note", "mail", 0, 4, 0),
        ]
    ) + ")"
    merged = merge.merge_findings(df.withColumn("secondary", F.expr(second))).first().findings
    assert [(f.type, f.text, f.confidence, f.severity) for f in merged] == [
        ("note", "mail", 0.5, "MEDIUM"), ("email", "a@b.com", 0.97, "HIGH"), ("note", "today", 0.97, "HIGH"),
    ]


def test_relocation(spark):
    findings = "array<struct<start:int,end:int,type:string,text:string>>"
    df = spark.createDataFrame(
        [("ab cd ab", "xx ab cd ab", [(0, 2, "t", "ab"), (3, 5, "t", "cd"), (6, 8, "t", "ab")]),
         ("ab cd", "cd ab", [(0, 2, "t", "ab"), (3, 5, "t", "cd")])],
        f"old string, new string, f {findings}",
    )
    ordered = [r.moved for r in relocate.relocate_ordered(df, "f", "new").collect()]
    assert [m.start for m in ordered[0]] == [3, 6, 9] and ordered[1] is None
    first = relocate.relocate_first(df, "f", "old", "new").collect()
    assert [m.start for m in first[0].moved] == [3, 6] and first[0].collapsed == 1
    assert [m.start for m in first[1].moved] == [0, 3] and first[1].collapsed == 0


def test_two_level_windows_equal_plain_ones(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(3), i, rng.choice([None, "a", "b"])) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, o int, v string")
    chunk = F.floor(F.col("o") / 7)
    summed = carry.running_sum(df, ["k"], ["o"], chunk, F.col("o"), "s")
    last = carry.last_before(df, ["k"], ["o"], chunk, {"s": F.col("v")})
    after = carry.first_after(df, ["k"], ["o"], chunk, F.col("v"), "s")
    for name, result in (("sum", summed), ("last", last), ("after", after)):
        got = {(r.k, r.o): r.s for r in result.collect()}
        for k in range(3):
            mine = [r for r in rows if r[0] == k]
            for i, (_, o, _v) in enumerate(mine):
                if name == "sum":
                    expected = sum(r[1] for r in mine[:i])
                elif name == "last":
                    expected = next((r[2] for r in reversed(mine[:i]) if r[2] is not None), None)
                else:
                    expected = mine[i + 1][2] if i + 1 < len(mine) else None
                assert got[(k, o)] == expected, (name, k, o)


def test_finding_across_turns_and_parts(spark):
    turns = spark.createDataFrame(
        [(1, i, t) for i, t in enumerate(["call 07700 ", "900", "123 bye", "", "mail a@b.com"])],
        "conv_id long, turn long, text string",
    )
    for sizes in ({}, {"part_chars": 5}, {"part_chars": 12, "halo_chars": 200}):
        rows = segments.segment_findings(turns, "conv_id", "turn", "text", **sizes).orderBy("start_seg").collect()
        assert [(r.start_seg, r.end_seg, r.text, r.start, r.end) for r in rows] == [
            (0, 2, "07700 900123", 5, 3), (4, 4, "a@b.com", 5, 12)
        ]


def test_log_holds_no_text(spark, tmp_path):
    scans = detect(spark.createDataFrame([(1, 'mail "a"@b.com ann@nhs.uk')], "id int, text string")).selectExpr(
        "'s1' AS scan_id", "timestamp'2024-01-01 00:00:00.123' AS ts", "findings", "'file' AS source", "'a\"b.txt' AS filename"
    )
    log = risklog.risk_log(scans)
    assert log.schema.simpleString() == (
        "struct<scan_id:string,ts:timestamp,risks:array<struct<type:string,confidence:double>>,source:string,"
        "filename:string,user_action:string,action_ts:timestamp>"
    )
    line = risklog.dsar_rows(log).first().line
    assert line == '"2024-01-01T00:00:00.123Z","s1","1","email","file","a""b.txt","",""'
    path = str(tmp_path / "log")
    risklog.append_risk_log(log, path)
    risklog.append_risk_log(log, path)
    assert spark.read.parquet(path).count() == 2
    risklog.clear_log(spark, path)
    assert spark.read.parquet(path).count() == 0
    risklog.export_dsar(log, str(tmp_path / "export"))
    assert spark.read.text(str(tmp_path / "export" / "header")).first().value == risklog.EXPORT_HEADER
    assert spark.read.text(str(tmp_path / "export" / "lines")).first().value == line


def test_scan_and_sinks(spark, tmp_path):
    from spanveil import sinks
    from spanveil.operators.scan import scan_corpus

    df = spark.createDataFrame([(1, "mail ann@nhs.uk"), (2, "nothing")], "id int, text string")
    scans = scan_corpus(df, ["id"])
    rows = {r.id: r for r in scans.collect()}
    assert (rows[1].risk_level, rows[1].signature, rows[1].risks_found) == ("HIGH", "email:ann@nhs.uk", 1)
    assert (rows[2].risk_level, rows[2].signature, rows[2].risks_found) == (None, "", 0)
    sinks.write_redacted(redact.redact(scans.select("id", "text", "findings"), pad=False), str(tmp_path / "out"))
    written = spark.read.parquet(str(tmp_path / "out"))
    assert written.columns == ["id", "text"]
    assert {tuple(r) for r in written.collect()} == {(1, "mail [EMAIL_1]"), (2, "nothing")}
    from spanveil.operators.detect import explode_findings

    sinks.write_findings(explode_findings(scans, ["id"]), str(tmp_path / "found"))
    assert spark.read.parquet(str(tmp_path / "found")).count() == 1


def test_parts_lose_no_finding(spark):
    """Turns of a few characters: every part size gives what one text gives."""
    import random

    rng = random.Random(8)
    text = "passport number please " + "x " * 150 + "my passport 123456789 and NHS: 943 476 1239, mail ann@nhs.uk or ring 07700 900123. " * 3
    rows = []
    for conv in range(3):
        at, turn = 0, 0
        while at < len(text):
            n = rng.randint(0, 3)
            rows.append((conv, turn, text[at : at + n]))
            at, turn = at + n, turn + 1
    rows += [(9, i, "passport " if i == 500 else "123456789 " if i == 513 else "ab ") for i in range(520)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    found = [
        sorted(map(tuple, segments.segment_findings(turns, "conv_id", "turn", "text", **sizes).collect()))
        for sizes in ({"part_chars": 1 << 20}, {"part_chars": 2}, {"part_chars": 7}, {"part_chars": 512})
    ]
    assert found[0] and all(f == found[0] for f in found)
    assert any(f[0] == 9 and "passport" in f[3] for f in found[0])


def test_matches_longer_than_any_part_are_found(spark):
    """50,000 characters inside one IBAN, a run of 9,000 words before a street, chains of claims over borders."""
    iban = "GB29 NWBK" + " " * 50_000 + "6016 1331 9268 19"
    address = "5 High" + " word" * 9000 + " Street, London"
    chain = " ".join("4111 1111 1111 1111 07700 900123" for _ in range(400))
    texts = [f"pay! {iban} now; {address} then", f"note: {chain}", "x " * 200 + f"passport{' ' * 50}123456789! {iban}" + " y" * 300]
    rows = [(k, i, t[at : at + 700]) for k, t in enumerate(texts) for i, at in enumerate(range(0, len(t), 700))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(4)
    found = [
        sorted(map(tuple, segments.segment_findings(turns, "conv_id", "turn", "text", part_chars=size).collect()))
        for size in (1 << 20, 20_000, 3000)
    ]
    assert {"iban", "address", "passport", "card_number"} <= {r[3] for r in found[0]}
    assert found[1] == found[0] and found[2] == found[0]


def test_a_part_takes_only_the_stretch_it_needs(spark):
    turns = spark.createDataFrame([(1, 0, "a" * 50_000 + "! "), (1, 1, "mail a@b.com! "), (1, 2, "! " + "b" * 50_000)], "conv_id long, turn long, text string")
    parts = segments.joined_parts(turns, "conv_id", "turn", "text", part_chars=100).collect()
    sizes = sorted(len(r.text) for r in parts)
    assert len(sizes) == 2 and sizes[0] <= 50_300 and sum(sizes) <= 100_600


def test_no_match_holds_a_break(spark):
    """What parts are cut by: no pass has one of these characters inside a match."""
    import random
    import re

    from spanveil.operators.detect import explode_findings

    rng = random.Random(3)
    pieces = ["12-34-56", "12345678", "GB29 NWBK 6016 1331 9268 19", "NI AB 12 34 56 C", "5 High Street", "London", "a.b", "@", "c.org", "Mr", "John", "Smith", "Account:", "+44",
              "7700", "900123", "10.0.0.1", "12/03/1990", "March", " ", "\n", "\t", ",", ".", "-", "/", ":", "_", "%", *"!?;\"'()[]{}<>=*&^$#~|\\`", "123456789", "passport", "SW1A 1AA", "JOHN SMITH"]
    texts = [(k, "".join(rng.choice(pieces) + rng.choice(["", " ", ""]) for _ in range(60))) for k in range(400)]
    found = explode_findings(detect(spark.createDataFrame(texts, "id int, text string"), resolve_overlaps=False), ["id"]).collect()
    assert len({r.type for r in found}) >= 8
    assert not [r.text for r in found if re.search(segments.BREAK, r.text)]


def test_exactly_one_entry_gets_the_action(spark):
    risks = "array(named_struct('type', 'email', 'confidence', 0.9D))"
    log = spark.sql(f"""SELECT scan_id, timestamp_seconds(ts) AS ts, {risks} AS risks, 'file' AS source, name AS filename,
        CAST(NULL AS string) AS user_action, CAST(NULL AS timestamp) AS action_ts
        FROM VALUES ('a', 5, 'x'), ('a', 5, 'y'), ('a', 3, 'z'), ('b', 1, 'x'), ('b', 1, 'x'), ('c', 1, 'x') t(scan_id, ts, name)""")
    actions = spark.sql("SELECT scan_id, action, timestamp_seconds(ts) AS ts FROM VALUES ('a', 'fix', 7), ('a', 'dismiss', 9), ('b', 'fix', 2), ('q', 'fix', 2) t(scan_id, action, ts)")
    done = risklog.update_actions(log, actions).collect()
    assert len(done) == 6
    assert sorted((r.scan_id, r.user_action) for r in done if r.user_action) == [("a", "dismiss"), ("b", "fix")]
    assert all(r.ts.timestamp() == 5 for r in done if r.scan_id == "a" and r.user_action)


def test_lexicon_joins_broadcast_the_lexicon(spark):
    from spanveil.plans import QUERIES

    for name in ("lexicon_lookup", "known_phrase_filter"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "BuildRight" in plan and "SortMergeJoin" not in plan, name


def test_wrong_offsets_are_not_gathered(spark):
    from spanveil.operators.merge import attach_secondary

    docs = spark.createDataFrame([(1, "ann lee"), (2, ""), (3, None)], "id int, text string")
    rows = [(1, i, "name", i, i + 3, "zzz", 0.7) for i in range(5000)] + [(1, 9000, "name", 0, 3, "ann", 0.7), (1, 9001, "name", 4, 99, "lee", 0.7)]
    rows += [(2, 0, "name", 0, 3, "ann", 0.7), (3, 0, "name", 0, 3, "ann", 0.7), (4, 0, "name", 0, 3, "ann", 0.7)]
    df = spark.createDataFrame(rows, "id int, i int, type string, start int, end int, text string, confidence double")
    got = {r.id: [f.text for f in r.secondary or []] for r in attach_secondary(docs, df, ["id"], "i").collect()}
    assert got == {1: ["ann"], 2: ["ann"], 3: []}


def test_daily_badges_gather_types_not_events(spark, tmp_path):
    from pyspark.sql import functions as F

    from spanveil.plans import QUERIES

    events = spark.range(3000).select(
        F.lit(1).alias("user_id"), F.timestamp_seconds(1_700_000_000 + F.col("id")).alias("ts"), F.lit("a_b").alias("event_type"), F.col("id").alias("event_id")
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    df = QUERIES["daily_badges"](spark, str(tmp_path))
    assert [r.badges for r in df.collect()] == ["a b 0,a b 1,a b 2"]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "min(" in plan, "events are cut down to their types before they are collected"


def plain_resolve(candidates):
    """Passes in order; a candidate that overlaps one kept goes; claims beforehand stay."""
    kept = []
    for c in sorted(candidates, key=lambda c: (c[1], c[2])):
        if c[1] == 0 or all(c[3] <= k[2] or c[0] >= k[3] for k in kept):
            kept.append(c)
    return sorted(kept)


def test_resolution_by_plain_greedy_choice(spark):
    import random

    from spanveil.operators.detectors import CANDIDATE_TYPE
    from spanveil.operators.resolve import resolve

    rng = random.Random(6)
    rows = []
    for k in range(300):
        made, used = [], set()
        for _ in range(rng.randint(0, 30)):
            start, rank = rng.randint(0, 60), rng.randint(0 if k % 3 == 0 else 1, 6)
            end = start + rng.randint(1, 12)
            # A pass's own matches are apart.
            if rank and any((rank, p) in used for p in range(start - 2, end + 2)):
                continue
            used |= {(rank, p) for p in range(start, end)}
            made.append((start, rank, start + (rng.randint(0, min(2, end - start - 1)) if rank else 0), end, "t", f"x{start}", 0.5))
        rows.append((k, made))
    df = spark.createDataFrame(rows, f"id int, c {CANDIDATE_TYPE}")
    found = {r.id: [tuple(c) for c in r.kept] for r in df.select("id", F.expr(f"{resolve('c')} AS kept")).collect()}
    for k, made in rows:
        assert sorted(found[k]) == plain_resolve(made), made


def seconds(make, size):
    """The best of three runs on one row with ``size`` findings, after the first, which compiles."""
    import time

    run = make(size)
    run()
    times = []
    for _ in range(3):
        begun = time.perf_counter()
        run()
        times.append(time.perf_counter() - begun)
    return min(times)


def test_long_chains_and_long_edits_cost_little_more_than_their_length(spark):
    """Twice the findings take far less than four times as long, where pairs would."""
    from spanveil.operators.detectors import CANDIDATE_TYPE
    from spanveil.operators.resolve import resolve

    def chain(n):
        rows = [(10 * i, i % 25 + 1, 10 * i, 10 * i + 13, "t", "x", 0.5) for i in range(n)]
        df = spark.createDataFrame([(1, rows)], f"id int, c {CANDIDATE_TYPE}").cache()
        return lambda: df.select(F.expr(f"size({resolve('c')})")).collect()

    def edit(n):
        text, found = "", []
        for i in range(n):
            word = f"u{i}@m{i % 97}.org"
            found.append((len(text) + 4, len(text) + 4 + len(word), "email", word))
            text += f"see {word} ok "
        df = spark.createDataFrame([(1, "edited " + text, found)], "id int, new string, f array<struct<start:int,end:int,type:string,text:string>>").cache()
        return lambda: relocate.relocate_ordered(df, "f", "new").select(F.size("moved")).collect()

    for make in (chain, edit):
        assert seconds(make, 20_000) < 3.2 * seconds(make, 10_000) + 0.2


def test_raw_offsets_of_any_text(spark):
    import random

    rng = random.Random(4)
    raws = ["".join(rng.choice(["\r\n", "\r", "\n", "a", "é", "🙂", " mail a@b.org "]) for _ in range(60)) for _ in range(60)]
    df = detect(spark.createDataFrame([(k, r, r) for k, r in enumerate(raws)], "id int, p string, text string"))
    for r in segments.with_raw_offsets(df, "p").collect():
        for f in r.findings:
            assert raws[r.id][f.raw_start : f.raw_end] == f.text
            assert f.raw_start == df.sparkSession.createDataFrame([(raws[r.id], f.start)], "p string, q int").selectExpr(segments.raw_offset("p", "q")).first()[0] if f.start < 12 else True


def test_selective_redaction_broadcasts_no_findings(spark, tmp_path):
    from spanveil.plans import QUERIES

    spark.sql("SELECT id AS o_orderkey FROM range(40)").write.parquet(f"{tmp_path}/orders.parquet")
    plan = QUERIES["redact_selective"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_candidates_and_findings_come_from_one_detection(spark):
    df = spark.createDataFrame([(1, "Account number: 12-34-56 12345678, NHS: 943 476 5919"), (2, "nothing"), (3, None)], "id long, text string")
    both = detect(df, every="every")
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= detect(df)._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace")
    rows = {r.id: r for r in both.collect()}
    apart = {r.id: r for r in detect(df, resolve_overlaps=False, out="every").collect()}
    alone = {r.id: r for r in detect(df).collect()}
    assert len(rows[1].every) > len(rows[1].findings) > 0
    for key in rows:
        assert rows[key].every == apart[key].every and rows[key].findings == alone[key].findings


def test_texts_are_detected_once(spark, tmp_path):
    from spanveil.plans import QUERIES

    spark.sql("SELECT id AS o_orderkey FROM range(40)").write.parquet(f"{tmp_path}/orders.parquet")
    for name, passes in (("merge_table_findings", 1), ("span_candidates", 1), ("redact_all_actions", 0)):
        plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        # What a text is scanned in is made once per detection.
        assert sum(" AS __scanned#" in line for line in plan.splitlines()) == passes, name
