"""Example texts per detector: what is found, and with which confidence."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from spanveil.functions import patterns, spans
from spanveil.operators.detect import detect
from spanveil.operators.detectors import Detector, default_detectors

RANKS = {
    "nhs": (1,), "ni": (2,), "passport": (3, 4), "licence": (5, 6), "vat": (7,), "bank": (8, 9, 10),
    "iban": (11,), "card": (12, 13, 14), "dob": (15, 16, 17), "phone": (18,), "email": (19,), "ip": (20,),
    "address": (21,), "postcode": (22,), "name": (23, 24, 25), "all": tuple(range(1, 26)),
}
NBSP = "\u00a0"

# (group, text, findings as (type, text, confidence))
CASES = [
    ("nhs", "NHS: 943 476 1239", [("nhs_number", "943 476 1239", 0.99)]),
    ("nhs", "Number is 400 000 0004 on file", [("nhs_number", "400 000 0004", 0.85)]),
    ("nhs", "id 321-654-9879", [("nhs_number", "321-654-9879", 0.85)]),
    ("nhs", "NHS: 485 777 3456", []),
    ("nhs", "NHS Number: 453 821 9904", [("nhs_number", "453 821 9904", 0.75)]),
    ("nhs", "id 453 821 9904", []),
    ("nhs", "100 000 001", []),
    ("nhs", f"nhs 943{NBSP}476{NBSP}1239", [("nhs_number", f"943{NBSP}476{NBSP}1239", 0.99)]),
    ("ni", "National Insurance: AB 12 34 56 A", [("ni_number", "AB 12 34 56 A", 0.99)]),
    ("ni", "Ref: DA 12 34 56 A", []),
    ("ni", "ni: ab 12 34 56 c", [("ni_number", "ab 12 34 56 c", 0.99)]),
    ("ni", "code AB-12-34-56-D", [("ni_number", "AB-12-34-56-D", 0.92)]),
    ("ni", "nino GB123456A", [("ni_number", "GB123456A", 0.75)]),
    ("ni", "code AB 12 34 56 E", []),
    ("passport", "passport no. 987654321", [("passport", "987654321", 0.95)]),
    ("passport", "passport: A1234567B", [("passport", "A1234567B", 0.95)]),
    ("passport", "travel document 12 345 678 9", [("passport", "12 345 678 9", 0.95)]),
    ("passport", "order 123456789", []),
    ("licence", "Driving Licence: MORGA753116SM9IJ", [("driving_licence", "MORGA753116SM9IJ", 0.95)]),
    ("licence", "ref MORGA753116SM9IJ", []),
    ("licence", "dvla MORGA799116SM9IJ", []),
    ("licence", "dvla GARCIA753116SM9IJ", [("driving_licence", "GARCIA753116SM9IJ", 0.90)]),
    ("vat", "VAT: GB123456789012", [("uk_vat", "GB123456789012", 0.97)]),
    ("vat", "gb-123-4567-89", [("uk_vat", "gb-123-4567-89", 0.97)]),
    ("vat", "DE 123 4567 89", []),
    ("bank", "Sort Code: 40-47-84 Account: 12345678", [("sortcode_account", "40-47-84 Account: 12345678", 0.92)]),
    ("bank", "Sort Code: 20-45-81\nAccount Number: 88776655",
     [("sortcode", "20-45-81", 0.88), ("account_number", "88776655", 0.88)]),
    ("bank", "reference 40-47-84 here", []),
    ("bank", "riverbank 40-47-84", []),
    ("bank", "riverbank " + "." * 115 + "40-47-84", [("sortcode", "40-47-84", 0.88)]),
    ("bank", "é12-34-56 bank", [("sortcode", "12-34-56", 0.88)]),
    ("iban", "account GB82WEST12345698765432", [("iban", "GB82WEST12345698765432", 0.99)]),
    ("iban", "GB29 NWBK 6016 1331 9268 18", []),
    ("card", "Amex: 3714 496353 98431", [("card_number", "3714 496353 98431", 0.95)]),
    ("card", "num: 1234 5678 9012 3452", []),
    ("card", "4111-1111-1111-1111", [("card_number", "4111-1111-1111-1111", 0.95)]),
    ("card", "4111 1111 1111 1112", []),
    ("dob", "25.12.1985", [("date_of_birth", "25.12.1985", 0.78)]),
    ("dob", "born on 14 March 1987", [("date_of_birth", "14 March 1987", 0.97)]),
    ("dob", "meeting on 14/03/2025", []),
    ("dob", "dob: 32/01/1990", []),
    ("phone", "Mobile: 07700 900123", [("uk_phone", "07700 900123", 0.93)]),
    ("phone", "ring +44 7700 900123 ok", [("uk_phone", "+44 7700 900123", 0.82)]),
    ("phone", "IBAN: 1107700900123456", []),
    ("phone", "num: 04700 900123", []),
    ("email", "book via studio@lens.photography", [("email", "studio@lens.photography", 0.97)]),
    ("email", "email test@test.com", []),
    ("email", "to your-email@company.com", []),
    ("ip", "version 1.2.3.4.5", []),
    ("ip", "from 1.2.3.4 to 192.168.5.6", [("ip_address", "1.2.3.4", 0.88), ("ip_address", "192.168.5.6", 0.75)]),
    ("ip", "at 127.0.0.1, 0.0.0.0, 256.1.1.1", []),
    ("address", "at Apartment 4B, 123 Wellington Road, London.",
     [("address", "Apartment 4B, 123 Wellington Road, London", 0.82)]),
    ("address", "12 High Street a road", [("address", "12 High Street", 0.82)]),
    ("address", "7 streets", []),
    ("postcode", "postcode: SW1A 1AA", [("uk_postcode", "SW1A 1AA", 0.99)]),
    ("postcode", "deliver to EC1A1BB please", [("uk_postcode", "EC1A1BB", 0.85)]),
    ("postcode", "ref 12345", []),
    ("name", "Dear Hodan Jama", [("name", "Hodan Jama", 0.92)]),
    ("name", "Dear\tHodan Jama", [("name", "Jama", 0.88)]),
    ("name", "The Ming Dynasty ruled for centuries", []),
    ("name", "Name: Ming Chen", [("name", "Ming Chen", 0.88)]),
    ("name", "Smart Redaction replaces text", []),
    ("name", "see Support Team", []),
    ("name", "Zork Blah email: x", [("name", "Zork Blah", 0.85)]),
    ("name", "Sarah Elizabeth Johnson called today", [("name", "Sarah Elizabeth Johnson", 0.78)]),
    ("name", "Patient: MARIA ESTEBAN", [("name", "MARIA ESTEBAN", 0.85)]),
    ("name", "Éric Dupont", []),
    ("name", "Mrs Elizabeth Clarke", [("name", "Mrs Elizabeth Clarke", 0.92)]),
    ("all", "Please review the attached document and let me know your thoughts.", []),
    ("all", "", []),
    ("all", None, []),
]


# Given names that the cases take as known.
GIVEN_NAMES = ["mark", "max", "elizabeth", "sarah", "hodan", "abdi", "maria"]


@pytest.mark.parametrize("group", sorted(RANKS))
def test_cases(spark, group):
    cases = [c for c in CASES if c[0] == group]
    chosen = [d for d in default_detectors(GIVEN_NAMES) if d.rank in RANKS[group]]
    df = spark.createDataFrame([(i, c[1]) for i, c in enumerate(cases)], "id int, text string")
    found = {r.id: r.findings for r in detect(df, detectors=chosen).collect()}
    for i, (_, text, expected) in enumerate(cases):
        got = [(f.type, f.text, round(f.confidence, 2)) for f in found[i]]
        assert got == expected, text


def test_hostile_texts(spark):
    texts = [
        (1, "12 " + "word " * 60_000 + "street"),
        (2, "12 " + "word " * 60_000 + "end"),
        (3, "a.b.c" * 20_000 + " @"),
        (4, "\ue000 07700 900123\ue002 a@b.com"),
        (5, "x\r\ny 07700 900123"),
        (6, "😀 07700 900123"),
        (7, ("mail ann@nhs.uk or 07700 900123; " * 3000)),
    ]
    df = spark.createDataFrame(texts, "id int, text string")
    rows = {r.id: (r.text, r.findings) for r in detect(df).collect()}
    assert len(rows[1][1]) == 1 and rows[1][1][0].end == len(texts[0][1])
    assert rows[2][1] == [] and rows[3][1] == []
    assert [f.type for f in rows[4][1]] == ["uk_phone", "email"]
    assert rows[5][0] == "x\ny 07700 900123" and rows[5][1][0].start == 4
    assert rows[6][1][0].start == 2
    assert len(rows[7][1]) == 6000
    for text, findings in rows.values():
        for f in findings:
            assert text[f.start:f.end] == f.text
        assert all(a.end <= b.start for a, b in zip(findings, findings[1:]))


def test_result_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    one = detect(docs.coalesce(1)).select("doc_id", F.to_json("findings")).collect()
    many = detect(docs.repartition(7)).select("doc_id", F.to_json("findings")).collect()
    assert sorted(one) == sorted(many)


def test_own_detector_and_gazetteer(spark):
    staff = Detector(30, "staff_id", r"(?<!\w)EMP-\d{4}", "CASE WHEN m.before LIKE '%staff%' THEN 0.7D END",
                     ("EMP-",), before=20)
    df = spark.createDataFrame([(1, "staff EMP-1234, guest " + "." * 20 + " EMP-9999. Zork Blah")], "id int, text string")
    found = detect(df, detectors=[*default_detectors(["zork"]), staff]).first().findings
    assert [(f.type, f.text) for f in found] == [("staff_id", "EMP-1234"), ("name", "Zork Blah")]
    with pytest.raises(ValueError):
        Detector(31, "x", r"(a)b", "1D").candidates("text")


OLD_EMAIL = (
    r"(?:(?=\w)(?<!\w)|(?=[.%+\-])(?<=\w))"
    r"[\w.%+\-]++@[\p{Alnum}.\-]+\.\p{Alpha}{2,13}(?:\.\p{Alpha}{2,6})?(?!\p{Alpha})"
)


def test_email_pattern_is_the_plain_one_but_linear(spark):
    import random
    import time

    from pyspark.sql import functions as F

    from spanveil.functions import patterns

    rng = random.Random(2)
    texts = ["".join(rng.choice(rng.choice(["ab.-%+@", "a@b.com ", ".com-x@", "..  é_"])) for _ in range(rng.randint(0, 50))) for _ in range(6000)]
    texts += ["a@b.com.x@c.org", "..a@b.co", "a.@b.co.uk-x@y.de", "-" * 60 + "a@b.com", " " + "." * 45 + "a@b.com"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    both = df.select("t", *(F.regexp_replace("t", f"({p})", "<$1>").alias(n) for n, p in (("old", OLD_EMAIL), ("new", patterns.EMAIL))))
    assert both.where("old <> new").collect() == []
    seconds = []
    for n in (100_000, 200_000):
        row = spark.range(1).select(F.concat(F.repeat(F.lit("a-"), n // 2), F.lit(" @")).alias("t"))
        row.select(F.regexp_count("t", F.lit(patterns.EMAIL))).collect()
        started = time.perf_counter()
        row.select(F.regexp_count("t", F.lit(patterns.EMAIL))).collect()
        seconds.append(time.perf_counter() - started)
    assert seconds[1] < max(2.6 * seconds[0], 2)


def test_a_gazetteer_is_a_table_of_any_size(spark):
    from pyspark.sql import functions as F

    from spanveil.operators.detect import detect, explode_findings, with_known_names

    texts = spark.createDataFrame([(1, "so Hodan Jama came"), (2, "so Zqx Jama came"), (3, "dear Hodan Jama"), (4, None)], "id int, text string")
    names = spark.range(300_000).select(F.concat(F.lit("Name"), "id").alias("n")).unionByName(spark.createDataFrame([(" Hodan ",), ("Abdi",)], "n string"))
    known = with_known_names(texts, ["id"], names, "n")
    found = {(r.id, r.text, r.confidence) for r in explode_findings(detect(known, known="known_names"), ["id"]).collect()}
    inline = {(r.id, r.text, r.confidence) for r in explode_findings(detect(texts, given_names=["hodan", "abdi"]), ["id"]).collect()}
    assert found == inline and (1, "Hodan Jama", 0.78) in found and not any(r[0] == 2 for r in found)


def test_default_gazetteer_has_the_breadth_of_the_reference(spark):
    from spanveil.functions.lexicons import DEFAULT_GIVEN_NAMES
    from spanveil.plans import ORACLES, QUERIES

    assert len(set(DEFAULT_GIVEN_NAMES)) == len(DEFAULT_GIVEN_NAMES) >= 1249
    texts = [(i, f"so {n} Zqx came") for i, n in enumerate(["Oliver", "Harry", "Mohammed", "Priya", "Piotr"])]
    found = detect(spark.createDataFrame(texts, "id int, text string")).collect()
    assert [[(f.type, f.confidence) for f in r.findings] for r in found] == [[("name", 0.78)]] * 5
    assert "gazetteer_names" in QUERIES and "gazetteer_names" in ORACLES


def test_few_and_many_matches_are_placed_alike(spark):
    """Up to FEW matches are placed by the pieces around them, the first few written out; windows meet other matches and both ends."""
    texts = [" ".join(f"é{'w' * (k % 7)}{k:02d}" for k in range(n)) + tail for n in range(spans.FEW + 3) for tail in ("", " \U0001f600 end")]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for before, after in ((0, 0), (9, 0), (0, 5), (200, 200)):
        found = df.selectExpr("text", f"{spans.matches('text', '[0-9]{2}', before, after)} AS m", f"{spans._many_matches('text', '[0-9]{2}', before, after)} AS general")
        for row in found.collect():
            expected = [
                (x.start(), x.end(), x[0], row.text[max(0, x.start() - before) : x.start()], row.text[x.end() : x.end() + after])
                for x in re.finditer("[0-9]{2}", row.text)
            ]
            assert [tuple(x) for x in row.m] == [tuple(x) for x in row.general] == expected


def test_email_start_is_tested_once_for_each_letter(spark):
    """A letter behind a letter is no start, which one look-behind tells; the starts are those of the three tests one by one."""
    plain = (
        r"(?:(?=\w)(?:(?<![\w.%+\-])|(?<=[.%+\-])(?<=(?:\A|[^\w.%+\-])[.%+\-]{1,40})|(?<=[.%+\-]{41}))"
        r"|\G(?:(?=\w)(?<!\w)|(?=[.%+\-])(?<=\w)))" + patterns.EMAIL[patterns.EMAIL.index(r"[\w.%+\-]++@") :]
    )
    assert patterns.EMAIL.startswith(r"(?:(?=\w)(?<!\w)(?:")
    draw = random.Random(5)
    texts = ["".join(draw.choice(["a", "b1", ".", "-", "@", "@x.com", " ", "é", "." * 41]) for _ in range(24)) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    both = [f"regexp_extract_all(text, {spans.quoted(p)}, 0)" for p in (patterns.EMAIL, plain)]
    assert df.where(f"size({both[0]}) > 0").count() > 1000
    assert df.where(f"{both[0]} <> {both[1]}").count() == 0


def test_email_words_without_an_at_sign_cost_no_look_behind(spark):
    """A word that no ``@`` follows within 64 characters is left before the look-behinds, which prose tried one after another; runs around 64 characters are found as before."""
    plain = (
        r"(?:(?=\w)(?<!\w)(?:(?<![.%+\-])|(?<=(?:\A|[^\w.%+\-])[.%+\-]{1,40})|(?<=[.%+\-]{41}))"
        r"|\G(?:(?=\w)(?<!\w)|(?=[.%+\-])(?<=\w)))" + patterns.EMAIL[patterns.EMAIL.index(r"[\w.%+\-]++@") :]
    )
    runs = [lead + "a" * n + mid + "b" * k for lead in ("", " ", "-", "." * 45, "é%") for n in (1, 31, 62, 63, 64, 65, 130) for mid in ("", "-", "..") for k in (0, 1, 2, 33)]
    texts = [run + end for run in runs for end in ("@x.com", " @x.com", "@x.com.y@z.org", "é@x.com")]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    new, old = (f"regexp_extract_all(text, {spans.quoted(p)}, 0)" for p in (patterns.EMAIL, plain))
    assert df.where(f"size({new}) > 0").count() > 500 and df.where(f"{new} <> {old}").count() == 0

    def seconds(pattern):
        words = spark.range(8).select(F.concat(F.repeat(F.lit("word "), 1_000_000), F.col("id").cast("string"), F.lit("@")).alias("t"))
        started = time.perf_counter()
        assert words.agg(F.sum(F.regexp_count("t", F.lit(pattern)))).first()[0] == 0
        return time.perf_counter() - started

    assert min(seconds(patterns.EMAIL) for _ in range(3)) < 0.7 * min(seconds(plain) for _ in range(3))
