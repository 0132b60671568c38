"""Queries that go through sinks, files and streams, and read back what they wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks
from ..functions.spans import normalise_newlines
from ..operators import library, redact, risklog
from ..operators.detect import detect, find_pii
from ..scratch import new_folder
from ..sources.html import page_domain
from ..sources.text import read_text_corpus
from ..streaming import jobs
from . import oracle as O
from .corpus import _LABELS, CONTACT_RANKS, DOC_FINDINGS, DOCS, MIXED, NEWLINES, detectors, documents
from .logs import _DUCK_TS, _FLAT_LOG, _PAGE_COUNTS, _PAGE_TEXT, _PAGE_URL, _SCANS, actions, flat, log
from .queries import derived_text, register, table, wall_time

_DOC_FINDINGS = f"""{DOC_FINDINGS} SELECT id AS doc_id, type, t AS text, s AS start, e AS "end", conf AS confidence, {O.SEVERITY} AS severity FROM f"""


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # A pattern matches a table that is one file and one that is a folder.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


@register("written_findings", _DOC_FINDINGS)
def written_findings(spark, sf_dir):
    """Findings written to a table partitioned by type, and read from it."""
    path = new_folder(spark, "findings")
    found = find_pii(documents(spark, sf_dir), ["doc_id"])
    sinks.write_findings(found, path)
    return spark.read.schema(found.schema).parquet(path)


@register("written_corpus", f"{DOC_FINDINGS},\n{O.redacted_cte('src', 'f', False)} SELECT id AS doc_id, redacted AS text FROM red")
def written_corpus(spark, sf_dir):
    """The redacted corpus as a table of its own, without the findings."""
    path = new_folder(spark, "corpus")
    sinks.write_redacted(redact.redact(detect(documents(spark, sf_dir)), pad=False), path)
    return spark.read.parquet(path)


@register(
    "text_file_findings",
    # A file is one text; every 25 ids have one, with their whole texts in order.
    f"""WITH files AS (SELECT doc_id // 25 AS name, string_agg('#' || doc_id::VARCHAR || ' ' || {NEWLINES.format('text')}, chr(10) ORDER BY doc_id) || chr(10) AS text
        FROM documents GROUP BY 1),
    src AS MATERIALIZED (SELECT name AS id, text FROM files), {O.finding_ctes('src', (18, 19, 20))}
    SELECT id AS folder, type, t AS text, s AS start, e AS "end", conf AS confidence FROM f""",
)
def text_file_findings(spark, sf_dir):
    """Findings of text files, made from the documents: one folder and file for every 25 ids."""
    path = new_folder(spark, "files")
    line = F.concat(F.lit("#"), F.col("doc_id").cast("string"), F.lit(" "), normalise_newlines(F.col("text")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 25).alias("name"), line.alias("line"))
    rows.repartition("name").sortWithinPartitions("name", "doc_id").select("name", "line").write.partitionBy("name").text(path)
    files = read_text_corpus(spark, path)
    found = find_pii(files.select(F.regexp_extract("path", "name=([^/]*)/", 1).cast("long").alias("folder"), "text"), ["folder"], detectors=detectors(18, 19, 20))
    return found.drop("severity")


_DAYS = "strftime(ts, '%Y-%m')"


@register("appended_log", f"WITH {_SCANS} SELECT {_DAYS} AS month, count(*) AS entries, sum(len(types))::BIGINT AS risks FROM log GROUP BY 1")
def appended_log(spark, sf_dir):
    """The log table by month: appended to, cleared, and appended to again."""
    path = new_folder(spark, "log")
    entries = log(spark, sf_dir)
    risklog.append_risk_log(entries.limit(100), path, by="month")
    risklog.clear_log(spark, path, by="month")
    risklog.append_risk_log(entries, path, by="month")
    stored = spark.read.schema(f"{risklog.LOG_SCHEMA}, month date").parquet(path)
    return stored.groupBy(F.date_format("month", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("entries"), F.sum(F.size("risks")).cast("long").alias("risks")
    )


@register("stored_log_top500", f"WITH {_SCANS} SELECT {_FLAT_LOG} FROM log ORDER BY ts DESC, scan_id LIMIT 500")
def stored_log_top500(spark, sf_dir):
    """The newest entries of the stored log, from its newest months alone."""
    path = new_folder(spark, "log")
    risklog.append_risk_log(log(spark, sf_dir), path, by="month")
    return flat(risklog.newest_stored(spark, path, by="month"))


@register(
    "sql_functions",
    f"""{MIXED},\n{O.redacted_cte('src', 'f', False)}
    SELECT id, s AS start, redacted, coalesce(CASE type {_LABELS} END, type) || ' ' || {O.SEVERITY} || ' '
        || CASE WHEN length(t) <= 6 THEN repeat('*', length(t)) ELSE left(t, 2) || '•••' || right(t, 2) END AS shown
    FROM f JOIN red USING (id)""",
)
def sql_functions(spark, sf_dir):
    """Redaction and display by the registered SQL functions."""
    library.register_functions(spark, "spanveil_")
    found = detect(derived_text(spark, sf_dir, "mixed")).selectExpr(
        "id", "findings", "spanveil_redact(text, transform(findings, f -> named_struct('start', f.start, 'end', f.end, 'type', f.type))) AS redacted",
    )
    rows = found.select("id", "redacted", F.explode_outer("findings").alias("f")).where("f IS NOT NULL")
    return rows.selectExpr(
        "id", "f.start", "redacted", "spanveil_display_label(f.type) || ' ' || spanveil_severity(f.confidence) || ' ' || spanveil_mask_snippet(f.text) AS shown",
    )


@register("stream_findings", _DOC_FINDINGS)
def stream_findings(spark, sf_dir):
    """Findings of the documents as a stream of files, appended to a table."""
    path, checkpoint = new_folder(spark, "stream"), new_folder(spark, "stream-state")
    found = jobs.detect_stream(stream_of(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    jobs.write_findings(found, path, checkpoint).awaitTermination()
    return spark.read.schema(found.schema).parquet(path)


@register("stream_stats", f"WITH {_PAGE_COUNTS} SELECT domain, total::BIGINT AS total, high_risk::BIGINT AS high_risk, medium_risk::BIGINT AS medium_risk FROM counts")
def stream_stats(spark, sf_dir):
    """Totals by domain kept by a stream of pages, as readers see them."""
    path, checkpoint = new_folder(spark, "totals"), new_folder(spark, "totals-state")
    pages = stream_of(spark, sf_dir, "pages").selectExpr("page_id", f"{_PAGE_TEXT} AS text", f"{_PAGE_URL} AS url").withColumn("domain", page_domain(F.col("url")))
    totals = jobs.stats_stream(pages, detectors=detectors(18, 19, 20))
    (
        totals.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .foreachBatch(jobs.upsert_stats(path)).trigger(availableNow=True).start().awaitTermination()
    )
    return jobs.read_stats(spark, path)


_ORDER_ACTS = """SELECT scan_id, CASE WHEN id % 2 = 0 THEN 'fix' ELSE 'dismiss' END AS action, ts + INTERVAL 5 SECOND AS ats FROM meta WHERE id % 4 < 2
        UNION ALL SELECT scan_id, 'dismiss', ts + INTERVAL 9 SECOND FROM meta WHERE id % 8 = 0"""


@register(
    "stream_answers",
    f"""WITH {_SCANS}, acts AS ({_ORDER_ACTS}),
    last AS (SELECT scan_id, arg_max(action, ats) AS action, max(ats) AS ats FROM acts GROUP BY scan_id)
    SELECT {_FLAT_LOG}, action AS user_action, ats AS action_ts FROM log LEFT JOIN last USING (scan_id)""",
)
def stream_answers(spark, sf_dir):
    """Actions kept by a stream, however late, and the log with the last of them."""
    given, path, checkpoint = (new_folder(spark, f"actions-{x}") for x in ("given", "kept", "state"))
    acts = actions(spark, sf_dir).where("scan_id NOT LIKE 'scan_unknown%'")
    acts.write.parquet(given)
    (
        spark.readStream.schema(acts.schema).parquet(given).writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(jobs.keep_actions(path)).trigger(availableNow=True).start().awaitTermination()
    )
    return flat(jobs.answered_log(log(spark, sf_dir), path), "user_action", wall_time("action_ts"))
