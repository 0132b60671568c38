"""Queries over documents, pages, conversations and derived texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks, display, lexicons
from ..functions.context import context_score
from ..functions.patterns import LOWER, UPPER
from ..functions.spans import quoted
from ..operators import merge, redact, relocate, risklog, segments, stats
from ..operators.detect import detect, explode_findings, find_pii, spread, with_known_names
from ..operators.detectors import all_candidates, default_detectors
from ..scratch import once
from ..sources import conversations, html, model
from . import derived
from . import oracle as O
from .queries import FINDING_COLUMNS, derived_text, register, table

NEWLINES = "replace(replace(coalesce({0}, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
DOCS = f"src AS MATERIALIZED (SELECT doc_id AS id, {NEWLINES.format('text')} AS text FROM documents)"
DOC_FINDINGS = f"WITH {DOCS},\n{O.finding_ctes('src')}"


def source(kind: str) -> str:
    return f"src AS MATERIALIZED (SELECT {derived.KEY} AS id, {derived.TEXTS[kind]} AS text FROM orders)"


def findings_of(kind: str, ranks=None) -> str:
    return f"WITH {source(kind)},\n{O.finding_ctes('src', ranks)}"


CONTACT_RANKS = (18, 19, 22)
MIXED = findings_of("mixed")
CONTACT = findings_of("contact", CONTACT_RANKS)


def detectors(*ranks: int):
    return [d for d in default_detectors() if d.rank in ranks]


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", *columns))


def contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(derived_text(spark, sf_dir, "contact"), detectors=detectors(*CONTACT_RANKS))


# --- detection over the corpus -----------------------------------------------------------------


@register(
    "pii_counts_by_type",
    f"{DOC_FINDINGS} SELECT type, {O.SEVERITY} AS severity, count(*) AS n FROM f GROUP BY ALL",
)
def pii_counts_by_type(spark, sf_dir):
    found = find_pii(documents(spark, sf_dir), ["doc_id"])
    return found.groupBy("type", "severity").agg(F.count("*").alias("n"))


@register(
    "document_findings",
    f"{DOC_FINDINGS} SELECT id AS doc_id, type, t AS text, s AS start, e AS \"end\", conf AS confidence,"
    f" {O.SEVERITY} AS severity FROM f",
)
def document_findings(spark, sf_dir):
    return find_pii(documents(spark, sf_dir), ["doc_id"])


@register(
    "pii_email_spans",
    f"WITH {DOCS},\n{O.finding_ctes('src', (19,))} SELECT id AS doc_id, s AS start, e AS \"end\", t AS text,"
    " lower(split_part(t, '@', 2)) AS domain FROM f",
)
def pii_email_spans(spark, sf_dir):
    found = find_pii(documents(spark, sf_dir), ["doc_id"], detectors=detectors(19))
    return found.select("doc_id", "start", "end", "text", F.expr("lower(split_part(text, '@', 2))").alias("domain"))


@register(
    "pii_ip_classes",
    f"WITH {DOCS},\n{O.finding_ctes('src', (20,))} SELECT {O.IP_CLASS} AS ip_class, conf AS confidence,"
    " count(*) AS n, count(DISTINCT id) AS docs FROM f GROUP BY ALL",
)
def pii_ip_classes(spark, sf_dir):
    found = find_pii(documents(spark, sf_dir), ["doc_id"], detectors=detectors(20))
    return found.groupBy(F.expr(checks.ip_class("text")).alias("ip_class"), "confidence").agg(
        F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs")
    )


@register(
    "pii_card_networks",
    f"WITH {DOCS},\n{O.finding_ctes('src', (12, 13, 14))} SELECT {O.NETWORK} AS network, count(*) AS n"
    " FROM f GROUP BY ALL",
)
def pii_card_networks(spark, sf_dir):
    found = find_pii(documents(spark, sf_dir), ["doc_id"], detectors=detectors(12, 13, 14))
    return found.groupBy(F.expr(checks.card_network("text")).alias("network")).agg(F.count("*").alias("n"))


@register(
    "corpus_inventory",
    f"""{DOC_FINDINGS} SELECT CASE WHEN grouping(type) = 1 THEN '(all)' ELSE type END AS type,
        CASE WHEN grouping(severity) = 1 THEN '(all)' ELSE severity END AS severity,
        CASE WHEN grouping(lang) = 1 THEN '(all)' ELSE coalesce(lang, '(none)') END AS lang,
        CASE WHEN grouping(source) = 1 THEN '(all)' ELSE coalesce(source, '(none)') END AS source, count(*) AS n
    FROM (SELECT type, {O.SEVERITY} AS severity, lang, source FROM f JOIN documents d ON d.doc_id = f.id)
    GROUP BY ROLLUP (type, severity, lang, source)""",
)
def corpus_inventory(spark, sf_dir):
    docs = documents(spark, sf_dir, "lang", "source")
    found = explode_findings(detect(docs), ["lang", "source"])
    return stats.corpus_inventory(found, "type", "severity", "lang", "source")


# --- conflicts -----------------------------------------------------------------------------------


@register("span_resolution", f"{MIXED} SELECT {FINDING_COLUMNS} FROM f")
def span_resolution(spark, sf_dir):
    return find_pii(derived_text(spark, sf_dir, "mixed"), ["id"]).drop("severity")


_ALL_CANDIDATES = " UNION ALL ".join(f"SELECT rank, type FROM c{r}" for r in range(1, 26))


@register(
    "span_candidates",
    f"""{MIXED}, c AS (SELECT rank, type, count(*) AS found FROM ({_ALL_CANDIDATES}) GROUP BY ALL),
    kept AS (SELECT rank, count(*) AS kept FROM f GROUP BY ALL)
    SELECT c.rank, c.type, c.found, coalesce(kept, 0) AS kept FROM c LEFT JOIN kept USING (rank)""",
)
def span_candidates(spark, sf_dir):
    rows = detect(derived_text(spark, sf_dir, "mixed"), every="every").select(
        F.explode_outer(
            F.concat(
                F.transform("every", lambda f: F.struct(f["rank"].alias("rank"), f["type"].alias("type"), F.lit(0).alias("kept"))),
                F.transform("findings", lambda f: F.struct(f["rank"].alias("rank"), f["type"].alias("type"), F.lit(1).alias("kept"))),
            )
        ).alias("c")
    ).where("c is not null")
    return rows.groupBy("c.rank", "c.type").agg(
        F.count_if(F.col("c.kept") == 0).alias("found"), F.count_if(F.col("c.kept") == 1).alias("kept")
    )


_CLAIMS = """(SELECT id, 0 AS rank, c.s AS check_start, c.s, c.e, '' AS type, '' AS t, 0::DOUBLE AS conf
    FROM (SELECT id, unnest([{'s': (id % 40)::INT, 'e': (id % 40)::INT + 6}, {'s': 60, 'e': 75}]) AS c FROM src WHERE id % 3 < 2))"""


@register(
    "span_resolution_claimed",
    f"WITH {source('contact')},\n{O.finding_ctes('src', CONTACT_RANKS, claims=_CLAIMS)} SELECT {FINDING_COLUMNS} FROM f",
)
def span_resolution_claimed(spark, sf_dir):
    texts = derived_text(spark, sf_dir, "contact").withColumn(
        "claims",
        F.expr("""CASE WHEN id % 3 < 2 THEN array(
            named_struct('start', CAST(id % 40 AS int), 'end', CAST(id % 40 AS int) + 6),
            named_struct('start', 60, 'end', 75)) END"""),
    )
    found = detect(texts, detectors=detectors(*CONTACT_RANKS), claims="claims")
    return explode_findings(found, ["id"]).drop("severity")


# --- second source ---------------------------------------------------------------------------------

_RAW = f"raw AS MATERIALIZED (SELECT id, text, {derived.MODEL_OUTPUT} AS raw FROM src)"
_FENCE = r"(?i)```(?:json)?\s*([\s\S]*?)```"
_ENTITY_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in model.ENTITY_TYPES.items())


def _number(field: str) -> str:
    return f"json_type(e, '$.{field}') IN ('BIGINT', 'UBIGINT', 'DOUBLE')"


_ENTITIES = f"""{_RAW},
    body AS (SELECT id, text, CASE WHEN {O.has('raw', _FENCE)} THEN trim(regexp_extract(raw, {O.lit(_FENCE)}, 1), ' ' || chr(10))
        WHEN {O.has('raw', '[{]')} THEN regexp_extract(raw, '[{{][\\s\\S]*[}}]', 0) ELSE trim(raw) END AS body FROM raw),
    ents AS MATERIALIZED (SELECT id, text, unnest(range(json_array_length(body, '$.entities')::INT)) AS i,
            json_extract(body, '$.entities[' || unnest(range(json_array_length(body, '$.entities')::INT)) || ']') AS e
        FROM body WHERE json_valid(body) AND json_type(body, '$.entities') = 'ARRAY'),
    ent AS MATERIALIZED (SELECT id, text AS doc, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS i,
        coalesce(CASE json_extract_string(e, '$.type') {_ENTITY_CASE} END, nullif(lower(json_extract_string(e, '$.type')), ''), 'pii') AS type,
        json_extract_string(e, '$.text') AS t,
        CASE WHEN {_number('start')} THEN json_extract(e, '$.start')::INT ELSE 0 END AS s,
        CASE WHEN {_number('end')} THEN json_extract(e, '$.end')::INT ELSE length(json_extract_string(e, '$.text'))::INT END AS e,
        CASE WHEN {_number('confidence')} THEN json_extract(e, '$.confidence')::DOUBLE ELSE 0.9::DOUBLE END AS conf
        FROM ents WHERE json_extract_string(e, '$.text') <> '' AND json_exists(e, '$.start') AND json_exists(e, '$.end'))"""


def model_output(spark, sf_dir) -> DataFrame:
    return contact(spark, sf_dir).withColumn("raw", F.expr(derived.MODEL_OUTPUT))


@register(
    "model_entities",
    f"WITH {source('contact')}, {_ENTITIES} SELECT id, i::INT AS idx, type, t AS text, s AS start, e AS \"end\", conf AS confidence FROM ent",
)
def model_entities(spark, sf_dir):
    texts = derived_text(spark, sf_dir, "contact").withColumn("raw", F.expr(derived.MODEL_OUTPUT))
    parsed = model.model_findings(texts, "raw")
    rows = parsed.select("id", F.posexplode_outer("secondary").alias("idx", "f")).where("f is not null")
    return rows.select("id", "idx", "f.type", "f.text", "f.start", "f.end", "f.confidence")


def _merge_chain(steps: int) -> str:
    out, last = [], "g0"
    for i in range(steps):
        out.append(f"""g{i + 1} AS MATERIALIZED (SELECT * FROM {last} UNION ALL
            SELECT id, {i + 1} AS rank, type, t, s, e, conf FROM good x WHERE i = {i} AND NOT EXISTS (
                SELECT 1 FROM {last} k WHERE k.id = x.id AND NOT (x.e <= k.s OR x.s >= k.e)))""")
        last = f"g{i + 1}"
    return ",\n".join(out)


@register(
    "merge_model_findings",
    f"""{CONTACT}, {_ENTITIES},
    good AS MATERIALIZED (SELECT id, i, type, t, s, e,
        CASE WHEN conf IS NULL OR conf = 0 THEN 0.5 WHEN conf > 1 THEN conf / 100 ELSE greatest(conf, 0) END AS conf
        FROM ent WHERE s >= 0 AND s < e AND e <= length(doc) AND substr(doc, s + 1, e - s) = t),
    g0 AS MATERIALIZED (SELECT id, 0 AS rank, type, t, s, e, conf FROM f), {_merge_chain(4)}
    SELECT id, type, t AS text, s AS start, e AS "end", conf AS confidence, {O.SEVERITY} AS severity FROM g4
    WHERE NOT (type = 'name' AND {O.listed('lower(trim(t))', lexicons.FALSE_POSITIVES)})""",
)
def merge_model_findings(spark, sf_dir):
    both = model.model_findings(model_output(spark, sf_dir), "raw")
    return explode_findings(merge.merge_findings(both), ["id"])


@register(
    "merge_table_findings",
    f"""{CONTACT}, good AS (SELECT id, 0 AS i, 'name' AS type, substr(text, 1, 8) AS t, 0 AS s, 8 AS e, 0.7::DOUBLE AS conf FROM src WHERE id % 2 = 0
        UNION ALL SELECT id, 1, 'note', substr(text, 5, 6), 4, 10, 0.95 FROM src
        UNION ALL SELECT id, 2, 'note', substr(text, 5, 6), 4, 10, 0.5 FROM src),
    g0 AS MATERIALIZED (SELECT id, 0 AS rank, type, t, s, e, conf FROM f), {_merge_chain(3)}
    SELECT id, type, t AS text, s AS start, e AS "end", conf AS confidence, {O.SEVERITY} AS severity FROM g3
    WHERE NOT (type = 'name' AND {O.listed('lower(trim(t))', lexicons.FALSE_POSITIVES)})""",
)
def merge_table_findings(spark, sf_dir):
    texts = derived_text(spark, sf_dir, "contact")
    stated = "inline(array((0, 'name', 0, 8, 0.7D), (1, 'note', 4, 10, 0.95D), (2, 'note', 4, 10, 0D)))"
    rows = texts.selectExpr("id", "text", f"{stated} AS (i, type, start, end, confidence)")
    rows = rows.where("i > 0 OR id % 2 = 0").select("id", "i", "type", "start", "end", "confidence", F.expr("substring(text, start + 1, end - start)").alias("text"))
    # Joined to the texts before detection: the join reads the texts twice, and would detect twice.
    joined = detect(merge.attach_secondary(texts, rows, ["id"], "i"), detectors=detectors(*CONTACT_RANKS))
    return explode_findings(merge.merge_findings(joined), ["id"])


@register(
    "known_phrase_filter",
    f"""WITH {source('names')}, w AS (SELECT id, 'name' AS type, unnest(regexp_extract_all(text, '[A-Za-z]+ +[A-Za-z]+')) AS text FROM src)
    SELECT * FROM w WHERE NOT {O.listed('lower(trim(text))', lexicons.FALSE_POSITIVES)}""",
)
def known_phrase_filter(spark, sf_dir):
    rows = derived_text(spark, sf_dir, "names").select(
        "id", F.lit("name").alias("type"), F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+ +[A-Za-z]+"), F.lit(0))).alias("text")
    )
    return merge.drop_known_phrases(rows, lexicon_table(spark).where("lexicon = 'false_positives'"))


def lexicon_table(spark: SparkSession) -> DataFrame:
    """Lexicons as a table written out in the plan: its size is known, so joins broadcast it and not the corpus."""
    lists = {
        "salutations": lexicons.SALUTATIONS,
        "common_words": lexicons.COMMON_WORDS,
        "non_name_starters": lexicons.NON_NAME_STARTERS,
        "false_positives": lexicons.FALSE_POSITIVES,
        "given_names": lexicons.DEFAULT_GIVEN_NAMES,
    }
    rows = ", ".join(f"({quoted(name)}, {quoted(term)})" for name, terms in lists.items() for term in terms)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(lexicon, term)")


_LEXICON_VALUES = ", ".join(
    f"({O.lit(name)}, {O.lit(term)})"
    for name, terms in (
        ("salutations", lexicons.SALUTATIONS), ("common_words", lexicons.COMMON_WORDS),
        ("non_name_starters", lexicons.NON_NAME_STARTERS), ("false_positives", lexicons.FALSE_POSITIVES),
        ("given_names", lexicons.DEFAULT_GIVEN_NAMES),
    )
    for term in terms
)


@register(
    "lexicon_lookup",
    f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents)
    SELECT lexicon, count(*) AS hits, count(DISTINCT l.term) AS terms FROM w
    JOIN (VALUES {_LEXICON_VALUES}) l(lexicon, term) ON l.term = w.term GROUP BY ALL""",
)
def lexicon_lookup(spark, sf_dir):
    words = documents(spark, sf_dir).select(
        "doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("term")
    )
    # The lexicon is fixed and small; on a tiny corpus Spark would else send the corpus to it.
    hits = words.join(F.broadcast(lexicon_table(spark)), "term")
    return hits.groupBy("lexicon").agg(F.count("*").alias("hits"), F.countDistinct("term").alias("terms"))


#: Capitalised words that a document begins with; in SQL and in Spark the same pattern.
_FIRST_WORD = f"^[{UPPER}][{LOWER}]+"
_GAZETTEER = f"""gaz AS MATERIALIZED (SELECT DISTINCT lower(regexp_extract(text, {O.lit(_FIRST_WORD)})) AS term FROM documents
    WHERE regexp_matches(text, {O.lit(_FIRST_WORD)}))"""
_NAMED = O.finding_ctes("src", names=["?"]).replace("own[1] IN ('?')", "own[1] IN (SELECT term FROM gaz)")


@register(
    "gazetteer_names",
    f"""WITH {_GAZETTEER}, {DOCS},\n{_NAMED}
    SELECT id AS doc_id, t AS text, s AS start, e AS "end", conf AS confidence FROM f WHERE type = 'name'""",
)
def gazetteer_names(spark, sf_dir):
    """Names of all documents by a gazetteer table made from the texts: the word each one begins with."""
    # Read as it is: the texts are needed three times, and the join deals them out anyway.
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    names = docs.select(F.regexp_extract("text", _FIRST_WORD, 0).alias("name"))
    known = with_known_names(docs, ["doc_id"], names, "name")
    found = explode_findings(detect(known, known="known_names"), ["doc_id"])
    return found.where("type = 'name'").select("doc_id", "text", "start", "end", "confidence")


# --- display and filters -------------------------------------------------------------------------

_LABELS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in display.DISPLAY_LABELS.items())


@register(
    "severity_filter",
    f"""{MIXED}, top AS (SELECT *, max(conf) OVER (PARTITION BY id) AS highest FROM f)
    SELECT id, type, s AS start, {O.SEVERITY} AS severity,
        CASE WHEN conf >= 0.85 THEN 'high' WHEN conf >= 0.6 THEN 'medium' ELSE 'low' END AS severity3
    FROM top WHERE conf > 0.5 AND highest >= 0.97""",
)
def severity_filter(spark, sf_dir):
    found = detect(derived_text(spark, sf_dir, "mixed"))
    found = found.where(F.exists("findings", lambda f: f["confidence"] >= 0.97))
    rows = explode_findings(found, ["id"]).where(F.col("confidence") > display.DISPLAY_MINIMUM)
    return rows.select("id", "type", "start", "severity", display.severity3(F.col("confidence")).alias("severity3"))


@register(
    "display_fields",
    f"""{MIXED} SELECT id, s AS start, coalesce(CASE type {_LABELS} END, type) AS label,
        CASE WHEN length(t) <= 6 THEN repeat('*', length(t)) ELSE left(t, 2) || '•••' || right(t, 2) END AS masked,
        CASE WHEN length(t) > 40 THEN left(t, 40) || '…' ELSE t END AS preview FROM f""",
)
def display_fields(spark, sf_dir):
    found = find_pii(derived_text(spark, sf_dir, "mixed"), ["id"])
    return found.select(
        "id", "start", display.display_label(F.col("type")).alias("label"),
        display.mask_snippet(F.col("text")).alias("masked"), display.preview(F.col("text")).alias("preview"),
    )


@register(
    "confidence_forms",
    """WITH r AS (SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'junk'
            WHEN 3 THEN '0' WHEN 4 THEN CAST(o_orderkey % 200 AS STRING) WHEN 5 THEN '-0.3' ELSE '0.' || CAST(o_orderkey % 90 + 10 AS STRING) END AS raw FROM orders)
    SELECT id, (CASE WHEN raw = 'true' THEN 0.9::DOUBLE WHEN raw = 'false' THEN 0.5 WHEN coalesce(try_cast(raw AS DOUBLE), 0) = 0 THEN 0.5
        WHEN try_cast(raw AS DOUBLE) > 1 THEN try_cast(raw AS DOUBLE) / 100 ELSE greatest(try_cast(raw AS DOUBLE), 0) END)::DOUBLE AS confidence FROM r""",
)
def confidence_forms(spark, sf_dir):
    raw = F.expr("""CASE o_orderkey % 7 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'junk' WHEN 3 THEN '0'
        WHEN 4 THEN CAST(o_orderkey % 200 AS STRING) WHEN 5 THEN '-0.3'
        ELSE '0.' || CAST(o_orderkey % 90 + 10 AS STRING) END""")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), display.normalise_confidence(raw).alias("confidence")
    )


_FORMS = "text, '  ' || text || chr(10), repeat(' ', CAST(turn % 4 AS int)) || chr(10), repeat('.', CAST(turn AS int))"


@register(
    "text_guards",
    f"""WITH t AS (SELECT conv_id, turn, unnest([{_FORMS}]) AS text, unnest(range(4)) AS form FROM conversations)
    SELECT conv_id, turn, form, length(text) > 0 AS scanned, length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 0 AS typed,
        length(text) > 10 AS rescanned FROM t""",
)
def text_guards(spark, sf_dir):
    """The guards on every turn: as it is, with white space around it, as white space, and as a short mark."""
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.posexplode(F.expr(f"array({_FORMS})")).alias("form", "text")
    )
    return turns.select(
        "conv_id", "turn", F.col("form").cast("long").alias("form"), (F.length("text") > 0).alias("scanned"),
        (F.length(F.expr(checks.collapse_whitespace("text"))) > 0).alias("typed"),
        (F.length("text") > 10).alias("rescanned"),
    )


_CHANNEL = """CASE page_id % 6 WHEN 0 THEN '/client-acme' WHEN 1 THEN '/x/client-acme' WHEN 2 THEN '/x/Project-7'
    WHEN 3 THEN '/a/team-b' WHEN 4 THEN '' ELSE '/internal-c' END"""
_DOMAIN = """CASE page_id % 5 WHEN 0 THEN 'app.slack.com' WHEN 1 THEN 'notslack.com' WHEN 2 THEN 'ZENDESK.com'
    WHEN 3 THEN 'hubspot.com.example.org' ELSE 'intercom.com' END"""
_WORDS = "CASE page_id % 4 WHEN 0 THEN 'ask @bob' WHEN 1 THEN 'Team meeting' WHEN 2 THEN url ELSE 'a@b internal' END"


@register(
    "context_scores",
    rf"""WITH p AS (SELECT page_id, {_CHANNEL} AS channel, {_DOMAIN} AS domain, {_WORDS} AS words FROM pages)
    SELECT page_id, least(1.0::DOUBLE,
        (CASE WHEN regexp_matches(channel, '(?i)^/client-|/project-|/team-|/internal-') THEN 0.4::DOUBLE ELSE 0 END)
        + (CASE WHEN regexp_matches(words, '@\w+') THEN 0.2::DOUBLE ELSE 0 END)
        + (CASE WHEN regexp_matches(words, '(?i)internal|team|discuss|meeting') THEN 0.2::DOUBLE ELSE 0 END)
        + (CASE WHEN regexp_matches(domain, '(?i)(^|\.)(intercom|zendesk|hubspot|slack)\.com$') THEN 0.1::DOUBLE ELSE 0 END)) AS score FROM p""",
)
def context_scores(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.select("page_id", context_score(F.expr(_CHANNEL), F.expr(_DOMAIN), F.expr(_WORDS)).alias("score"))


# --- redaction -----------------------------------------------------------------------------------


def _redaction_oracle(prefix: str, pad: bool, key: str = "id") -> str:
    return f"{prefix},\n{O.redacted_cte('src', 'f', pad)} SELECT id AS {key}, redacted FROM red"


@register("redact_corpus", _redaction_oracle(DOC_FINDINGS, False, "doc_id"))
def redact_corpus(spark, sf_dir):
    return redact.redact(detect(documents(spark, sf_dir)), pad=False).select("doc_id", "redacted")


@register("redact_padded", _redaction_oracle(MIXED, True))
def redact_padded(spark, sf_dir):
    return redact.redact(detect(derived_text(spark, sf_dir, "mixed"))).select("id", "redacted")


@register(
    "redact_placeholders",
    f"""{MIXED}, num AS (SELECT *, row_number() OVER (PARTITION BY id, type ORDER BY s) AS n FROM f)
    SELECT id, type, s AS start, e AS "end", n::INT AS number, {O.placeholder_case('type', 'n')} AS placeholder FROM num""",
)
def redact_placeholders(spark, sf_dir):
    return redact.placeholders(detect(derived_text(spark, sf_dir, "mixed")), ["id"])


@register(
    "redact_one",
    f"""{CONTACT}, ff AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY s) = 2),
    {O.redacted_cte('src', 'ff', True)} SELECT id, redacted FROM red""",
)
def redact_one(spark, sf_dir):
    found = contact(spark, sf_dir).withColumn("second", F.expr("get(findings, 1)"))
    return redact.redact_one(found, "second").select("id", "redacted")


@register(
    "redact_selective",
    f"""{CONTACT}, ff AS (SELECT * FROM f WHERE NOT (type = 'email' AND id % 2 = 0)),
    {O.redacted_cte('src', 'ff', False)} SELECT id, redacted FROM red""",
)
def redact_selective(spark, sf_dir):
    texts = contact(spark, sf_dir)
    rows = explode_findings(texts, ["id"])
    ignored = rows.where("type = 'email' AND id % 2 = 0").select("id", "start", "end")
    kept = redact.collect_findings(redact.drop_ignored(rows, ignored, ["id", "start", "end"]), ["id"])
    # The arrays are far larger than Spark's estimate of them, so they are not broadcast either.
    joined = derived_text(spark, sf_dir, "contact").join(kept.hint("merge"), "id", "left")
    joined = joined.withColumn("findings", F.coalesce("findings", F.expr("slice(array(named_struct('start',0,'end',0,'type','','text','','confidence',0D,'severity','')),1,0)")))
    return redact.redact(joined, pad=False).select("id", "redacted")


# --- relocation ------------------------------------------------------------------------------------

_EDIT = """CASE id % 5 WHEN 0 THEN text WHEN 1 THEN 'edited: ' || text WHEN 2 THEN replace(text, 'ann@nhs.uk', 'gone')
    WHEN 3 THEN text || ' ' || text ELSE substr(text, 12) || ' 07700900123' END"""
_EDITED = f"ed AS MATERIALIZED (SELECT id, text, {_EDIT} AS new FROM src)"


def edited(spark, sf_dir) -> DataFrame:
    return contact(spark, sf_dir).withColumn("new_text", F.expr(_EDIT))


@register(
    "relocate_ordered",
    f"""WITH RECURSIVE {CONTACT[5:]}, {_EDITED},
    o AS MATERIALIZED (SELECT f.id, type, t, new, row_number() OVER (PARTITION BY f.id ORDER BY s) AS i,
        count(*) OVER (PARTITION BY f.id) AS total FROM f JOIN ed ON ed.id = f.id),
    walk AS (SELECT id, 0::BIGINT AS i, 0::BIGINT AS pos, ''::VARCHAR AS type, ''::VARCHAR AS t FROM src
        UNION ALL SELECT o.id, o.i, w.pos + strpos(substr(o.new, w.pos + 1), o.t) - 1 + length(o.t), o.type, o.t
        FROM walk w JOIN o ON o.id = w.id AND o.i = w.i + 1 WHERE strpos(substr(o.new, w.pos + 1), o.t) > 0),
    done AS (SELECT id FROM walk GROUP BY id HAVING max(i) = (SELECT coalesce(max(total), 0) FROM o WHERE o.id = walk.id))
    SELECT id, type, t AS text, (pos - length(t))::INT AS start, pos::INT AS "end" FROM walk WHERE i > 0 AND id IN (SELECT id FROM done)""",
)
def relocate_ordered(spark, sf_dir):
    moved = relocate.relocate_ordered(edited(spark, sf_dir), "findings", "new_text")
    rows = moved.select("id", F.explode_outer("moved").alias("f")).where("f is not null")
    return rows.select("id", "f.type", "f.text", "f.start", "f.end")


@register(
    "relocate_first",
    f"""{CONTACT}, {_EDITED},
    o AS MATERIALIZED (SELECT f.id, type, t, CASE WHEN text = new THEN s ELSE strpos(new, t) - 1 END::INT AS place,
        row_number() OVER (PARTITION BY f.id ORDER BY s) AS i FROM f JOIN ed ON ed.id = f.id
        WHERE text = new OR strpos(new, t) > 0),
    p AS (SELECT id, i, type, t, place AS s, (place + length(t))::INT AS e FROM o),
    h0 AS (SELECT * FROM p WHERE false),
    {", ".join(f'''h{i} AS MATERIALIZED (SELECT * FROM h{i - 1} UNION ALL SELECT * FROM p x WHERE i = {i} AND NOT EXISTS (
        SELECT 1 FROM h{i - 1} k WHERE k.id = x.id AND NOT (x.e <= k.s OR x.s >= k.e)))''' for i in range(1, 13))}
    SELECT id, type, t AS text, s AS start, e AS "end" FROM h12""",
)
def relocate_first(spark, sf_dir):
    moved = relocate.relocate_first(edited(spark, sf_dir), "findings", "text", "new_text")
    rows = moved.select("id", F.explode_outer("moved").alias("f")).where("f is not null")
    return rows.select("id", "f.type", "f.text", "f.start", "f.end")


_AFTER_EDIT = f"""{CONTACT}, {_EDITED},
    o AS MATERIALIZED (SELECT f.id, type, t, CASE WHEN text = new THEN s ELSE strpos(new, t) - 1 END::INT AS place,
        row_number() OVER (PARTITION BY f.id ORDER BY s) AS i FROM f JOIN ed ON ed.id = f.id
        WHERE text = new OR strpos(new, t) > 0),
    p AS (SELECT id, i, type, t, place AS s, (place + length(t))::INT AS e FROM o),
    h0 AS (SELECT * FROM p WHERE false),
    {", ".join(f'''h{i} AS MATERIALIZED (SELECT * FROM h{i - 1} UNION ALL SELECT * FROM p x WHERE i = {i} AND NOT EXISTS (
        SELECT 1 FROM h{i - 1} k WHERE k.id = x.id AND NOT (x.e <= k.s OR x.s >= k.e)))''' for i in range(1, 13))},
    live AS (SELECT id, new AS text FROM ed), {O.redacted_cte('live', 'h12', True)}"""


@register("redact_after_edit", f"{_AFTER_EDIT} SELECT id, redacted FROM red")
def redact_after_edit(spark, sf_dir):
    """Redact everything in the edited text: relocate, number, splice."""
    moved = relocate.relocate_first(edited(spark, sf_dir), "findings", "text", "new_text")
    return redact.redact(moved, "new_text", "moved").select("id", "redacted")


_WHEN = "TIMESTAMP '2024-03-01 08:00:00' + CAST(id AS int) * INTERVAL '1' SECOND"


@register(
    "redact_all_actions",
    f"""{_AFTER_EDIT},
    found AS (SELECT id, count(*) AS n, list(type ORDER BY s) AS types FROM f GROUP BY id)
    SELECT 'scan_' || md5(id::VARCHAR) AS scan_id, array_to_string(types, ';') AS types, redacted, 'fix' AS user_action,
        strftime(TIMESTAMP '2024-03-01 08:00:00' + to_seconds(id::BIGINT), '%Y-%m-%d %H:%M:%S') AS action_ts
    FROM red JOIN found USING (id)""",
)
def redact_all_actions(spark, sf_dir):
    """Redact everything in edited texts, and the actions of it on the scans' log entries."""
    scans = edited(spark, sf_dir).select(
        risklog.scan_id(F.col("id")).alias("scan_id"), "text", "findings", "new_text", F.expr(_WHEN).alias("ts"),
        F.lit("typing").alias("source"), F.lit(None).cast("string").alias("filename"),
    )
    # The log, the actions and the redacted texts are three readers of one scan, each text is redacted once.
    scans = once(scans, "scans")
    fixed = once(redact.redact_all(scans), "redacted")
    log = risklog.update_actions(risklog.risk_log(scans), fixed.select("scan_id", F.col("user_action").alias("action"), F.col("action_ts").alias("ts")))
    return log.join(fixed.select("scan_id", "redacted").hint("merge"), "scan_id").select(
        "scan_id", F.array_join(F.transform("risks", lambda r: r["type"]), ";").alias("types"), "redacted", "user_action",
        F.date_format("action_ts", "yyyy-MM-dd HH:mm:ss").alias("action_ts"),
    )


@register(
    "relocate_one",
    f"""{CONTACT}, {_EDITED}, l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC) = 1),
    a AS (SELECT l.id, type, t, CASE WHEN substr(new, s + 1, e - s) = t THEN s WHEN strpos(new, t) > 0 THEN strpos(new, t) - 1 END::INT AS place
        FROM l JOIN ed ON ed.id = l.id)
    SELECT id, type, t AS text, place AS start, (place + length(t))::INT AS "end" FROM a WHERE place IS NOT NULL""",
)
def relocate_one(spark, sf_dir):
    last = edited(spark, sf_dir).withColumn("last", F.expr("element_at(findings, -1)")).where("last is not null")
    moved = relocate.relocate_one(last, "last", "new_text").where("moved is not null")
    return moved.select("id", "moved.type", "moved.text", "moved.start", "moved.end")


_PASTED = "CASE WHEN id % 7 = 0 THEN '' ELSE text || repeat('.', CAST(id % 40 AS int)) END"
_LIVE = "CASE WHEN id % 11 = 0 THEN '' ELSE text || repeat('.', CAST((id * 7) % 45 AS int)) END"
_WHERE_FROM = "CASE id % 3 WHEN 0 THEN 'paste' WHEN 1 THEN 'typing' ELSE 'paste' END"


@register(
    "copy_choice",
    f"""WITH {source('contact')}, c AS (SELECT id, {_WHERE_FROM} AS source, {_PASTED} AS pasted, {_LIVE} AS live FROM src),
    d AS (SELECT *, CASE WHEN source = 'paste' AND pasted <> '' AND length(live) < length(pasted) * 0.8 THEN pasted
        WHEN live = '' THEN pasted ELSE live END AS chosen FROM c)
    SELECT id, chosen, length(live) >= length(chosen) * 0.9 AS caught_up FROM d""",
)
def copy_choice(spark, sf_dir):
    copies = derived_text(spark, sf_dir, "contact").selectExpr(
        "id", f"{_WHERE_FROM} AS source", f"{_PASTED} AS pasted", f"{_LIVE} AS live"
    )
    return relocate.choose_copy(copies, "source", "pasted", "live").select("id", "chosen", "caught_up")


# --- segments ----------------------------------------------------------------------------------------

_TURN = """CASE WHEN turn % 2 = 1 THEN '900' || lpad(CAST(conv_id % 1000 AS STRING), 3, '0') || ' ' ELSE '' END || text
    || ' mail u' || CAST(conv_id AS STRING) || '@host' || CAST(turn AS STRING) || '.org, call 07700 '"""


def turns(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "conversations")).selectExpr("conv_id", "turn", f"{_TURN} AS text")


_TURNS = f"t AS MATERIALIZED (SELECT conv_id, turn, {NEWLINES.format(_TURN)} AS text FROM conversations)"
_OFFSETS = """o AS MATERIALIZED (SELECT conv_id, turn, text, (coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM t)"""
_TURN_FINDINGS = f"""WITH {_TURNS}, {_OFFSETS},
    src AS MATERIALIZED (SELECT conv_id AS id, string_agg(text, '' ORDER BY turn) AS text FROM t GROUP BY conv_id),
    {O.finding_ctes('src')},
    a AS (SELECT f.*, min(turn) AS st FROM f JOIN o ON o.conv_id = f.id AND o.start + length(o.text) > f.s GROUP BY ALL),
    b AS (SELECT a.*, min(turn) AS et FROM a JOIN o ON o.conv_id = a.id AND turn >= st AND o.start + length(o.text) >= a.e GROUP BY ALL)
    SELECT b.id AS conv_id, st AS start_seg, et AS end_seg, type, t AS text, (s - x.start)::INT AS start, (e - y.start)::INT AS "end",
        conf AS confidence, {O.SEVERITY} AS severity
    FROM b JOIN o x ON x.conv_id = b.id AND x.turn = st JOIN o y ON y.conv_id = b.id AND y.turn = et"""


@register("conversation_turn_findings", _TURN_FINDINGS)
def conversation_turn_findings(spark, sf_dir):
    return conversations.turn_findings(turns(spark, sf_dir))


@register("conversation_findings_in_parts", _TURN_FINDINGS)
def conversation_findings_in_parts(spark, sf_dir):
    """The same with conversations cut into parts of two turns, as very long ones are."""
    return conversations.turn_findings(turns(spark, sf_dir), part_chars=200)


@register(
    "conversation_offsets",
    f"WITH {_TURNS}, {_OFFSETS} SELECT conv_id, turn, start, start + length(text) AS \"end\" FROM o",
)
def conversation_offsets(spark, sf_dir):
    rows = segments.segment_offsets(turns(spark, sf_dir), "conv_id", "turn", "text", chunk_size=4)
    return rows.select("conv_id", "turn", "start", "end")


_HTML = """replace(html, '</article>', '<p>Call <b>07700 9' || lpad(CAST(page_id % 100000 AS STRING), 5, '0')
    || '</b> or mail <i>p' || CAST(page_id AS STRING) || '</i>@site.org &amp; ask Mr <u>John</u> Smith</p></article>')"""
_SEGMENTS = f"""h AS (SELECT page_id, string_split(regexp_replace({_HTML},
        '(?is)<!--.*?-->|<script[\\s/>].*?</script[^>]*>|<style[\\s/>].*?</style[^>]*>|<[a-z/!?](?:[^''">]|"[^"]*"|''[^'']*'')*>',
        chr(57344), 'g'), chr(57344)) AS g FROM pages),
    n AS (SELECT page_id, i, replace(replace(replace(replace(g[i], '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&') AS text
        FROM (SELECT page_id, g, unnest(range(1, len(g) + 1)) AS i FROM h) WHERE length(g[i]) > 0),
    seg AS MATERIALIZED (SELECT page_id, row_number() OVER w - 1 AS seg_no, (coalesce(sum(length(text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING
        AND 1 PRECEDING), 0))::INT AS start, text FROM n WINDOW w AS (PARTITION BY page_id ORDER BY i))"""


def pages(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "pages")).selectExpr("page_id", "url", f"{_HTML} AS html")


@register(
    "page_segments",
    f"WITH {_SEGMENTS} SELECT page_id, seg_no::BIGINT AS seg_no, start, (start + length(text))::INT AS \"end\", text FROM seg",
)
def page_segments(spark, sf_dir):
    return html.html_segments(pages(spark, sf_dir), "page_id")


_BROKEN = """html || CASE page_id % 9 WHEN 0 THEN '<script>var a = "07700 900123";' WHEN 1 THEN '<p>seen &copy &amp &lt;b&gt; &notit; &#8364;&#x41 &#150; &bogus; end'
    WHEN 2 THEN '<style>p { } </p> mail a@b.org' WHEN 3 THEN '<!-- not closed <p>mail a@b.org' WHEN 4 THEN '<textarea>mail a@b.org</p>'
    WHEN 5 THEN '<p title="a>b">left <div class="cut' WHEN 6 THEN '<title>in <b>bold</b> &amp; on</title>after' WHEN 7 THEN '<noscript><p>no</noscript>yes<iframe>no'
    ELSE '<!-->shown<!-- a --!>too<script src="x>y">no</script >last <3 & more' END"""
_RAW_PARTS = "|".join(f"<{x}(?:[\\s/](?:[^''\">]|\"[^\"]*\"|''[^'']*'')*)?>.*?(?:</{x}(?:[\\s/][^>]*)?>|$)" for x in html.SKIPPED)


@register(
    "broken_page_segments",
    # Markup goes in two steps, as the parts of a title are text; the references used are stated one by one.
    f"""WITH b AS (SELECT page_id, {_BROKEN} AS html FROM pages),
    c AS (SELECT page_id, regexp_replace(html, '(?is)<!---?>|<!--.*?(?:--!?>|$)|{_RAW_PARTS}', chr(57344), 'g') AS html FROM b),
    d AS (SELECT page_id, CASE WHEN page_id % 9 = 6 THEN replace(replace(html, '<b>bold', chr(57345) || 'b>bold'), '</b> &amp; on', chr(57345) || '/b> &amp; on') ELSE html END AS html FROM c),
    h AS (SELECT page_id, string_split(regexp_replace(html, '(?is)<[a-z/!?](?:[^''">]|"[^"]*"|''[^'']*'')*(?:>|$)|<[a-z/!?][^>]*(?:>|$)', chr(57344), 'g'), chr(57344)) AS g FROM d),
    n AS (SELECT page_id, i, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(g[i],
            '&copy;', '©'), '&copy', '©'), '&middot;', '·'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&notit;', '¬it;'), '&#8364;', '€'), '&#x41', 'A'), '&#150;', '–'), '&amp;', '&'), '&amp', '&') AS text
        FROM (SELECT page_id, g, unnest(range(1, len(g) + 1)) AS i FROM h) WHERE length(g[i]) > 0)
    SELECT page_id, row_number() OVER w - 1 AS seg_no, (coalesce(sum(length(text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS start,
        (sum(length(text)) OVER (w ROWS UNBOUNDED PRECEDING))::INT AS "end", replace(text, chr(57345), '<') AS text
    FROM n WINDOW w AS (PARTITION BY page_id ORDER BY i)""",
)
def broken_page_segments(spark, sf_dir):
    """Pages with one kind of broken markup each, as browsers read them."""
    given = spread(table(spark, sf_dir, "pages")).selectExpr("page_id", f"{_BROKEN} AS html")
    return html.html_segments(given, "page_id")


_PAGE_TEXT_FINDINGS = f"""WITH {_SEGMENTS}, src AS MATERIALIZED (SELECT page_id AS id, string_agg(text, '' ORDER BY seg_no) AS text FROM seg GROUP BY page_id),
    {O.finding_ctes('src')}
    SELECT f.id AS page_id, type, t AS text, s AS start, e AS "end", conf AS confidence, x.seg_no::BIGINT AS start_seg, y.seg_no::BIGINT AS end_seg,
        s - x.start AS local_start, e - y.start AS local_end
    FROM f JOIN seg x ON x.page_id = f.id AND x.start <= s AND s < x.start + length(x.text)
        JOIN seg y ON y.page_id = f.id AND y.start < e AND e <= y.start + length(y.text)"""


@register("page_text_findings", _PAGE_TEXT_FINDINGS)
def page_text_findings(spark, sf_dir):
    """Findings of pages with the text nodes they start and end in, all inside the row."""
    found = segments.in_segments(detect(html.page_text(pages(spark, sf_dir))), "nodes")
    rows = found.select("page_id", F.explode_outer("findings").alias("f")).where("f IS NOT NULL")
    return rows.select("page_id", "f.type", "f.text", "f.start", "f.end", "f.confidence", "f.start_seg", "f.end_seg", "f.local_start", "f.local_end")


@register("page_findings_by_place", _PAGE_TEXT_FINDINGS)
def page_findings_by_place(spark, sf_dir):
    """The same from two tables, findings and segments, in one order of places."""
    given = pages(spark, sf_dir)
    found = find_pii(html.page_text(given), ["page_id"]).drop("severity")
    return segments.findings_to_segments(found, html.html_segments(given, "page_id"), "page_id", chunk_chars=512)


_CRLF = "replace(replace(text, '; ', chr(13) || chr(10)), ' ', CASE WHEN id % 2 = 0 THEN chr(13) ELSE ' ' END)"


@register(
    "raw_offsets",
    f"""WITH r AS MATERIALIZED (SELECT id, {_CRLF} AS raw FROM (SELECT {derived.KEY} AS id, {derived.TEXTS['contact']} AS text FROM orders)),
    src AS MATERIALIZED (SELECT id, {NEWLINES.format('raw')} AS text FROM r), {O.finding_ctes('src', CONTACT_RANKS)},
    c AS (SELECT id, [k FOR k IN range(1, length(raw)) IF substr(raw, k, 2) = chr(13) || chr(10)] AS ks FROM r)
    SELECT f.id, type, s AS start, (s + len([x FOR x, i IN ks IF x - (i - 1) <= s]))::INT AS raw_start FROM f JOIN c ON c.id = f.id""",
)
def raw_offsets(spark, sf_dir):
    raw = derived_text(spark, sf_dir, "contact").selectExpr("id", f"{_CRLF} AS raw")
    found = detect(raw.withColumn("text", F.col("raw")), detectors=detectors(*CONTACT_RANKS))
    rows = segments.with_raw_offsets(found, "raw").select("id", F.explode_outer("findings").alias("f")).where("f is not null")
    return rows.select("id", "f.type", "f.start", "f.raw_start")
