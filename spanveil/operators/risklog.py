"""The risk log: what was found in each scan, without the text itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.display import log_severity

LOG_SCHEMA = (
    "scan_id string, ts timestamp, risks array<struct<type:string,confidence:double>>, source string, "
    "filename string, user_action string, action_ts timestamp"
)
LOG_CAP = 500
RECENT = 20

# --- fixed values: header of the access-request export -----------------------------------------
EXPORT_HEADER = (
    "Timestamp,Scan ID,Risk Count,Risk Types,Source,Filename,User Action,Action Timestamp"
)


def scan_id(*parts: Column) -> Column:
    """Deterministic id of a scan, from whatever identifies it."""
    return F.concat(F.lit("scan_"), F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])))


def risk_log(scans: DataFrame, findings: str = "findings") -> DataFrame:
    """Log entries of the scans that found something; the text never enters the log."""
    risks = F.transform(
        findings, lambda f: F.struct(f["type"].alias("type"), f["confidence"].alias("confidence"))
    )
    entries = scans.select("scan_id", "ts", risks.alias("risks"), "source", "filename")
    return entries.where(F.size("risks") > 0).select(
        "scan_id", "ts", "risks", "source", "filename",
        F.lit(None).cast("string").alias("user_action"),
        F.lit(None).cast("timestamp").alias("action_ts"),
    )


def append_risk_log(log: DataFrame, path: str, by: str = "day") -> None:
    """Append entries to the log table, partitioned by ``day`` or ``month``.

    The entries of a partition come together, large ones in several files.
    """
    span = F.to_date(F.trunc("ts", by)) if by != "day" else F.to_date("ts")
    log.withColumn(by, span).hint("rebalance", F.col(by)).write.mode("append").partitionBy(by).parquet(path)


def clear_log(spark: SparkSession, path: str, by: str = "day") -> None:
    """Replace the log table by an empty one."""
    spark.createDataFrame([], LOG_SCHEMA).withColumn(by, F.to_date("ts")).write.mode(
        "overwrite"
    ).parquet(path)


def newest_stored(spark: SparkSession, path: str, n: int = LOG_CAP, by: str = "day") -> DataFrame:
    """The newest ``n`` entries of a stored log, from as few of its newest partitions as hold them.

    One count per partition comes from the files' own statistics; older partitions are not read.
    """
    stored = spark.read.schema(f"{LOG_SCHEMA}, {by} date").parquet(path)
    counts = stored.groupBy(by).agg(F.count(F.lit(1)).alias("n")).where(F.col(by).isNotNull())
    before = F.sum("n").over(Window.orderBy(F.col(by).desc()).rowsBetween(Window.unboundedPreceding, -1))
    # One row per partition; the oldest one that is needed bounds the scan.
    first = counts.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < n).agg(F.min(by)).first()[0]
    held = stored if first is None else stored.where(F.col(by) >= F.lit(first))
    return newest(held.drop(by), n)


def newest(log: DataFrame, n: int = LOG_CAP, by: Sequence[str] | None = None) -> DataFrame:
    """The newest ``n`` entries, in all or per key.

    Both forms cut the data down inside each partition before anything is shuffled.
    """
    order = [F.col("ts").desc(), F.col("scan_id")]
    if not by:
        return log.orderBy(*order).limit(n)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return log.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def recent(log: DataFrame, n: int = RECENT, order: str = "newest", high_only: bool = False) -> DataFrame:
    """The list shown on a dashboard, with its position.

    ``oldest`` takes the far end of the capped log, oldest first.  The high-risk filter comes
    after the cut, so it may leave fewer than ``n`` entries.
    """
    ascending = order == "oldest"
    keys = [F.col("ts"), F.col("scan_id").desc()] if ascending else [F.col("ts").desc(), F.col("scan_id")]
    listed = newest(log).orderBy(*keys).limit(n)
    listed = listed.withColumn("position", F.row_number().over(Window.orderBy(*keys)))
    return listed.where(log_severity(F.col("risks")) == "high") if high_only else listed


def update_actions(log: DataFrame, actions: DataFrame) -> DataFrame:
    """Set the latest action of each scan on its newest log entry, and on that one alone.

    Entries of equal time are told apart by their content; unknown scans do nothing.  The log is
    read once: the action comes by the join, and the entries of a scan are then together.
    """
    last = actions.groupBy("scan_id").agg(
        F.max(F.struct(F.col("ts").alias("at"), F.col("action").alias("what"))).alias("__last")
    )
    newest_first = Window.partitionBy("scan_id").orderBy(
        F.col("ts").desc(), F.xxhash64(F.to_json(F.struct("risks", "source", "filename", "user_action", "action_ts")))
    )
    hit = F.col("__last").isNotNull() & (F.col("__nth") == 1)
    return log.join(last, "scan_id", "left").withColumn("__nth", F.row_number().over(newest_first)).select(
        "scan_id", "ts", "risks", "source", "filename",
        F.when(hit, F.col("__last.what")).otherwise(F.col("user_action")).alias("user_action"),
        F.when(hit, F.col("__last.at")).otherwise(F.col("action_ts")).alias("action_ts"),
    )


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def dsar_rows(log: DataFrame) -> DataFrame:
    """Access-request export: one quoted CSV line per log entry, next to its sort keys.

    Times are written in the session time zone, which must be UTC.
    """
    fields = [
        iso_time(F.col("ts")),
        F.col("scan_id"),
        F.size("risks").cast("string"),
        F.array_join(F.array_distinct(F.transform("risks", lambda r: r["type"])), "; "),
        F.col("source"),
        F.coalesce(F.col("filename"), F.lit("")),
        F.coalesce(F.col("user_action"), F.lit("")),
        F.coalesce(iso_time(F.col("action_ts")), F.lit("")),
    ]
    cells = [F.concat(F.lit('"'), F.replace(f, F.lit('"'), F.lit('""')), F.lit('"')) for f in fields]
    return log.select("ts", "scan_id", F.concat_ws(",", *cells).alias("line"))


def export_dsar(log: DataFrame, path: str) -> None:
    """Write the export as text files: the header alone, then the lines, newest first.

    The parts are range-partitioned by time, so reading them in name order gives one file.
    """
    spark = log.sparkSession
    header = spark.range(1, numPartitions=1).select(F.lit(EXPORT_HEADER).alias("line"))
    header.write.mode("overwrite").text(f"{path}/header")
    lines = dsar_rows(log).orderBy(F.col("ts").desc(), "scan_id").select("line")
    lines.write.mode("overwrite").text(f"{path}/lines")
