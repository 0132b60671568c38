"""Queries over scans: risk log, actions, dashboards, exports and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import display
from ..operators import risklog, stats
from ..operators.detect import detect, spread
from ..operators.detectors import default_detectors
from ..operators.scan import scan_corpus
from ..sources.html import page_domain
from . import derived
from . import oracle as O
from .corpus import CONTACT_RANKS, NEWLINES, detectors
from .queries import register, table, wall_time

_SPARK_TS = "timestamp_micros(unix_micros(o_orderdate) + (o_orderkey % 86400) * 1000000 + (o_orderkey % 7) * 1000)"
_DUCK_TS = "make_timestamp(epoch_us(o_orderdate) + (o_orderkey % 86400) * 1000000 + (o_orderkey % 7) * 1000)"
_SOURCE = "CASE o_orderkey % 3 WHEN 0 THEN 'paste' WHEN 1 THEN 'typing' ELSE 'file' END"
_FILE = "CASE WHEN o_orderkey % 3 = 2 THEN 'notes \"' || CAST(o_orderkey AS STRING) || '\".txt' END"
_BODY = f"CASE WHEN o_orderkey % 10 = 0 THEN 'nothing here' ELSE {derived.TEXTS['contact']} END"

_SCANS = f"""src AS MATERIALIZED (SELECT o_orderkey AS id, {_BODY} AS text FROM orders),
    {O.finding_ctes('src', CONTACT_RANKS)},
    meta AS (SELECT o_orderkey AS id, {_DUCK_TS} AS ts, {_SOURCE} AS source, {_FILE} AS filename,
        'scan_' || md5(o_orderkey::VARCHAR || '|' || strftime({_DUCK_TS}, '%Y-%m-%d %H:%M:%S.%f')) AS scan_id FROM orders),
    log AS MATERIALIZED (SELECT scan_id, any_value(ts) AS ts, any_value(source) AS source, any_value(filename) AS filename,
        list(type ORDER BY s) AS types, list(conf ORDER BY s) AS confs, max(conf) AS top
        FROM f JOIN meta USING (id) GROUP BY scan_id)"""


def scan_key():
    return risklog.scan_id(F.col("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def scans(spark, sf_dir) -> DataFrame:
    keys = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"))
    rows = keys.selectExpr(
        "o_orderkey AS id", f"{_BODY} AS text", f"{_SPARK_TS} AS ts", f"{_SOURCE} AS source", f"{_FILE} AS filename"
    )
    rows = rows.withColumn("scan_id", scan_key())
    return detect(rows, detectors=detectors(*CONTACT_RANKS))


def log(spark, sf_dir) -> DataFrame:
    return risklog.risk_log(scans(spark, sf_dir))


_FLAT = "array_to_string({0}, ';')"


def flat(entries: DataFrame, *extra) -> DataFrame:
    """Log entries with their risks as text, which every engine compares alike."""
    types = F.array_join(F.transform("risks", lambda r: r["type"]), ";").alias("types")
    return entries.select("scan_id", wall_time("ts"), types, "source", "filename", *extra)


_FLAT_LOG = f"scan_id, ts, {_FLAT.format('types')} AS types, source, filename"


@register("risk_log", f"WITH {_SCANS} SELECT {_FLAT_LOG} FROM log")
def risk_log(spark, sf_dir):
    return flat(log(spark, sf_dir))


@register("risk_log_top500", f"WITH {_SCANS} SELECT {_FLAT_LOG} FROM log ORDER BY ts DESC, scan_id LIMIT 500")
def risk_log_top500(spark, sf_dir):
    return flat(risklog.newest(log(spark, sf_dir)))


@register(
    "risk_log_top20_per_source",
    f"WITH {_SCANS} SELECT {_FLAT_LOG} FROM log QUALIFY row_number() OVER (PARTITION BY source ORDER BY ts DESC, scan_id) <= 20",
)
def risk_log_top20_per_source(spark, sf_dir):
    return flat(risklog.newest(log(spark, sf_dir), 20, by=["source"]))


def _recent(order: str, high: bool) -> str:
    keys = "ts DESC, scan_id" if order == "newest" else "ts, scan_id DESC"
    return f"""WITH {_SCANS}, capped AS (SELECT * FROM log ORDER BY ts DESC, scan_id LIMIT 500),
        r AS (SELECT *, (row_number() OVER (ORDER BY {keys}))::INT AS position FROM capped)
        SELECT {_FLAT_LOG}, position FROM r WHERE position <= 20 {'AND top >= 0.85' if high else ''}"""


@register("recent_newest", _recent("newest", False))
def recent_newest(spark, sf_dir):
    return flat(risklog.recent(log(spark, sf_dir)), "position")


@register("recent_oldest_high", _recent("oldest", True))
def recent_oldest_high(spark, sf_dir):
    return flat(risklog.recent(log(spark, sf_dir), order="oldest", high_only=True), "position")




@register(
    "risk_log_actions",
    f"""WITH {_SCANS}, acts AS (
        SELECT scan_id, CASE WHEN id % 2 = 0 THEN 'fix' ELSE 'dismiss' END AS action, ts + INTERVAL 5 SECOND AS ats FROM meta WHERE id % 4 < 2
        UNION ALL SELECT scan_id, 'dismiss', ts + INTERVAL 9 SECOND FROM meta WHERE id % 8 = 0
        UNION ALL SELECT 'scan_unknown' || id::VARCHAR, 'fix', ts FROM meta WHERE id % 5 = 0),
    last AS (SELECT scan_id, arg_max(action, ats) AS action, max(ats) AS ats FROM acts GROUP BY scan_id)
    SELECT {_FLAT_LOG}, action AS user_action, ats AS action_ts FROM log LEFT JOIN last USING (scan_id)""",
)
def risk_log_actions(spark, sf_dir):
    return flat(risklog.update_actions(log(spark, sf_dir), actions(spark, sf_dir)), "user_action", wall_time("action_ts"))


def actions(spark, sf_dir) -> DataFrame:
    """User actions on scans: some repeated, some on scans the log does not hold."""
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", f"{_SPARK_TS} AS ts")
    rows = rows.withColumn("scan_id", scan_key())
    first = rows.where("id % 4 < 2").selectExpr(
        "scan_id", "CASE WHEN id % 2 = 0 THEN 'fix' ELSE 'dismiss' END AS action", "ts + INTERVAL 5 SECOND AS ts"
    )
    again = rows.where("id % 8 = 0").selectExpr("scan_id", "'dismiss' AS action", "ts + INTERVAL 9 SECOND AS ts")
    unknown = rows.where("id % 5 = 0").selectExpr("'scan_unknown' || id AS scan_id", "'fix' AS action", "ts")
    return first.unionByName(again).unionByName(unknown)


_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
_CELL = "'\"' || replace({0}, '\"', '\"\"') || '\"'"
_CELLS = " || ',' || ".join(
    _CELL.format(c)
    for c in (
        _ISO.format("ts"), "scan_id", "len(types)::VARCHAR",
        "array_to_string([x FOR x, i IN types IF list_position(types, x) = i], '; ')", "source", "coalesce(filename, '')", "''", "''",
    )
)


@register("dsar_rows", f"WITH {_SCANS} SELECT ts, scan_id, {_CELLS} AS line FROM log")
def dsar_rows(spark, sf_dir):
    return risklog.dsar_rows(log(spark, sf_dir)).withColumn("ts", wall_time("ts"))


@register(
    "scan_summaries",
    f"""WITH {_SCANS}, a AS (SELECT id, list(type || ':' || t ORDER BY type || ':' || t) AS pairs, count(*)::INT AS risks_found,
            count_if(conf >= 0.85)::INT AS high_risk, count_if(conf < 0.85)::INT AS medium_risk FROM f GROUP BY id)
    SELECT m.scan_id, coalesce(risks_found, 0)::INT AS risks_found, coalesce(high_risk, 0)::INT AS high_risk,
        coalesce(medium_risk, 0)::INT AS medium_risk, coalesce(array_to_string(pairs, '|'), '') AS signature,
        CASE WHEN high_risk > 0 THEN 'HIGH' WHEN risks_found > 0 THEN 'MEDIUM' END AS risk_level
    FROM meta m LEFT JOIN a USING (id)""",
)
def scan_summaries(spark, sf_dir):
    return scans(spark, sf_dir).select(
        "scan_id", *stats.scan_counts("findings"), display.scan_signature(F.col("findings")).alias("signature"),
        display.risk_level(F.col("findings")).alias("risk_level"),
    )


@register(
    "log_badges",
    f"""WITH {_SCANS}, d AS (SELECT *, [x FOR x, i IN types IF list_position(types, x) = i] AS u FROM log)
    SELECT scan_id, CASE WHEN top >= 0.85 THEN 'high' ELSE 'medium' END AS level,
        array_to_string([replace(x, '_', ' ') FOR x IN u[1:2]], ',') || CASE WHEN len(u) > 2 THEN ',+' || (len(u) - 2)::VARCHAR ELSE '' END AS badges,
        len(types)::VARCHAR || CASE WHEN len(types) = 1 THEN ' item' ELSE ' items' END || ' detected' AS caption FROM d""",
)
def log_badges(spark, sf_dir):
    risks = F.col("risks")
    return log(spark, sf_dir).select(
        "scan_id", display.log_severity(risks).alias("level"),
        F.array_join(display.type_badges(risks, shown=2), ",").alias("badges"),
        display.risk_count_text(risks).alias("caption"),
    )


@register(
    "daily_badges",
    """WITH e AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, list(event_type || '_' || (event_id % 3)::VARCHAR ORDER BY ts, event_id) AS types FROM events GROUP BY ALL),
    d AS (SELECT *, [x FOR x, i IN types IF list_position(types, x) = i] AS u FROM e)
    SELECT user_id, day, array_to_string([replace(x, '_', ' ') FOR x IN u[1:4]], ',')
        || CASE WHEN len(u) > 4 THEN ',+' || (len(u) - 4)::VARCHAR ELSE '' END AS badges FROM d""",
)
def daily_badges(spark, sf_dir):
    """Badges of each user's day, four shown: the events stand for findings, as texts seldom have five types."""
    kind = F.concat("event_type", F.lit("_"), (F.col("event_id") % 3).cast("string"))
    # Only where a type is seen first matters, so a day's array holds a row for each type.
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    first = table(spark, sf_dir, "events").groupBy("user_id", day, kind.alias("type")).agg(F.min(F.struct("ts", "event_id")).alias("at"))
    days = first.groupBy("user_id", "day").agg(F.array_sort(F.collect_list(F.struct("at", "type"))).alias("risks"))
    return days.select("user_id", "day", F.array_join(display.type_badges(F.col("risks")), ",").alias("badges"))


@register(
    "document_scans",
    f"""WITH src AS MATERIALIZED (SELECT doc_id AS id, {NEWLINES.format('text')} AS text FROM documents), {O.finding_ctes('src', (18, 19, 20))},
    a AS (SELECT id, list(type || ':' || t ORDER BY type || ':' || t) AS pairs, count(*)::INT AS risks_found,
        count_if(conf >= 0.85)::INT AS high_risk, count_if(conf < 0.85)::INT AS medium_risk FROM f GROUP BY id)
    SELECT doc_id, 'scan_' || md5(doc_id::VARCHAR || '|' || source) AS scan_id, coalesce(risks_found, 0)::INT AS risks_found,
        coalesce(high_risk, 0)::INT AS high_risk, coalesce(medium_risk, 0)::INT AS medium_risk,
        coalesce(array_to_string(pairs, '|'), '') AS signature,
        CASE WHEN high_risk > 0 THEN 'HIGH' WHEN risks_found > 0 THEN 'MEDIUM' END AS risk_level
    FROM documents LEFT JOIN a ON a.id = doc_id""",
)
def document_scans(spark, sf_dir):
    """One scan per document, with what the log and the statistics need."""
    chosen = [d for d in default_detectors() if d.rank in (18, 19, 20)]
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = scan_corpus(docs, ["doc_id", "source"], detectors=chosen)
    return found.select("doc_id", "scan_id", "risks_found", "high_risk", "medium_risk", "signature", "risk_level")


# --- statistics by domain --------------------------------------------------------------------------

_PAGE_TEXT = """CASE WHEN page_id % 3 = 0 THEN url ELSE 'ask p' || CAST(page_id AS STRING) || '@site.org or 8.8.4.4, 07700 9'
    || lpad(CAST(page_id % 100000 AS STRING), 5, '0') || ' ' || url END"""
_PAGE_URL = "CASE WHEN page_id % 11 = 0 THEN NULL ELSE url END"
_HOST = r"nullif(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '')"
_PAGE_COUNTS = f"""src AS MATERIALIZED (SELECT page_id AS id, {NEWLINES.format(_PAGE_TEXT)} AS text FROM pages),
    {O.finding_ctes('src', (18, 19, 20))},
    pg AS (SELECT page_id, {_PAGE_URL} AS u FROM pages),
    counts AS (SELECT coalesce({_HOST}, 'unknown') AS domain, count(f.id) AS total,
        count(CASE WHEN conf >= 0.85 THEN 1 END) AS high_risk, count(CASE WHEN conf < 0.85 THEN 1 END) AS medium_risk
        FROM pg LEFT JOIN f ON f.id = page_id GROUP BY 1)"""


def page_counts(spark, sf_dir) -> DataFrame:
    given = spread(table(spark, sf_dir, "pages").select("page_id", "url")).selectExpr("page_id", f"{_PAGE_TEXT} AS text", f"{_PAGE_URL} AS url")
    found = detect(given, detectors=detectors(18, 19, 20))
    return found.select("page_id", page_domain(F.col("url")).alias("domain"), *stats.scan_counts("findings"))


@register("stats_by_domain", f"WITH {_PAGE_COUNTS} SELECT * FROM counts")
def stats_by_domain(spark, sf_dir):
    return stats.stats_by_domain(page_counts(spark, sf_dir))


@register(
    "running_totals",
    f"""WITH {_PAGE_COUNTS} SELECT sum(total)::BIGINT AS total, sum(high_risk)::BIGINT AS high_risk,
        sum(medium_risk)::BIGINT AS medium_risk, 0::BIGINT AS safe_contexts FROM counts""",
)
def running_totals(spark, sf_dir):
    return stats.running_totals(page_counts(spark, sf_dir))
