"""Files, pages, model output and the SQL function library."""

from pyspark.sql import functions as F

from spanveil.functions.checks import register_functions
from spanveil.sources import html, model
from spanveil.sources.text import read_text_corpus


def test_text_files(spark, tmp_path):
    for name in ("a.txt", "b.MD", "c.csv", "d.log", "e.json", "f.txt.bak"):
        (tmp_path / name).write_text("first\nsecond")
    rows = read_text_corpus(spark, str(tmp_path)).collect()
    assert sorted(r.filename for r in rows) == ["a.txt", "b.MD", "c.csv", "d.log"]
    assert {r.text for r in rows} == {"first\nsecond"} and {r.source for r in rows} == {"file"}


def test_html_text_nodes(spark):
    page = (
        '<p title="a>b">x &amp;lt; &#65;&#x1F600; &eacute;<!-- <b> --><script>if(a<b){"</p>"}</script>'
        "don't <b c='>'>q</b> a < b &foo;<noscript>n</noscript><TEXTAREA>t</TEXTAREA>\r\nz</p>"
    )
    rows = html.html_segments(spark.createDataFrame([(1, page)], "id int, html string"), "id").orderBy("seg_no").collect()
    assert [r.text for r in rows] == ["x &lt; A😀 é", "don't ", "q", " a < b &foo;", "\nz"]
    assert [r.start for r in rows] == [0, 11, 17, 18, 30]
    broken = spark.createDataFrame([(1, "<p don't>one</p><div"), (2, None)], "id int, html string")
    assert [r.text for r in html.html_segments(broken, "id").collect()][0] == "one"


def test_model_output(spark):
    entity = '{"type":"PERSON","text":"Ann Lee","start":0,"end":7}'
    outputs = [
        '{"entities":[%s]}' % entity, "```json\n{\"entities\":[%s]}\n```" % entity, "ok: {\"entities\":[%s]} bye" % entity,
        "none", '{"entities":3}', '{"entities":[%s]} and }' % entity, '{"entities":[%s]} {"a":1}' % entity, None,
        '{"entities":[{"type":"Odd","text":"q","start":null,"end":"7","confidence":true}]}',
    ]
    df = spark.createDataFrame(list(enumerate(outputs)), "id int, raw string")
    got = {r.id: [tuple(x) for x in r.secondary] for r in model.model_findings(df, "raw").collect()}
    person = [("name", "Ann Lee", 0, 7, 0.9)]
    assert [got[i] for i in range(8)] == [person, person, person, [], [], [], [], []]
    assert got[8] == [("odd", "q", 0, 1, 0.9)]


def test_sql_functions(spark):
    register_functions(spark, "pii_")
    row = spark.sql(
        "SELECT pii_nhs_check('943 476 1239') a, pii_card_network('4111 1111 1111 1111') b, pii_ip_class('10.0.0.1') c,"
        " pii_iban_check('GB82WEST12345698765432') d, pii_phone_national('+44 7700 900123') e, pii_nhs_check('junk') f"
    ).first()
    assert tuple(row) == (True, "visa", "private", True, "07700900123", False)


def test_domain(spark):
    df = spark.createDataFrame([("https://u@M.Example.org:8080/x",), ("nope",)], "url string")
    assert [r[0] for r in df.select(html.page_domain(F.col("url"))).collect()] == ["m.example.org", None]


def test_many_nodes(spark):
    import time

    from pyspark.sql import functions as F

    from spanveil.sources.html import html_segments

    seconds = []
    for n in (15_000, 15_000, 30_000):
        pages = spark.range(1).select("id", F.expr(f"repeat(concat('<p>a', id, '</p>'), {n})").alias("html"))
        started = time.perf_counter()
        assert html_segments(pages, "id").agg(F.count("*"), F.max("end")).first() == (n, 2 * n)
        seconds.append(time.perf_counter() - started)
    assert seconds[2] < max(3.2 * seconds[1], 3)
