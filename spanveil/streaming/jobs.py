"""Streaming jobs over texts, scans and user events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import versions
from ..functions.display import risk_level
from ..operators.alerts import ANSWER_MS, QUIET_MS
from ..operators.detect import detect, explode_findings
from ..operators.redact import redact_all
from ..operators.risklog import update_actions
from ..operators.stats import scan_counts
from .ordered import ordered_by_event_time

# Late-data policy: rows more than this behind the newest event are dropped.
WATERMARK = "10 minutes"
STATS_SCHEMA = "domain string, total long, high_risk long, medium_risk long"
REDACTED_SCHEMA = "scan_id string, redacted string, user_action string, action_ts timestamp"
ACTIONS_SCHEMA = "scan_id string, action string, ts timestamp, batch long"


def detect_stream(texts: DataFrame, keys: list[str], text_col: str = "text", **options) -> DataFrame:
    """Findings of a stream of texts; no state, so no row is ever late."""
    return explode_findings(detect(texts, text_col, **options), keys)


def write_findings(findings: DataFrame, path: str, checkpoint: str, by: tuple[str, ...] = ("type",)) -> StreamingQuery:
    """Append a findings stream to a table partitioned by type, until the input is used up."""
    return (
        findings.writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).partitionBy(*by)
        .trigger(availableNow=True).outputMode("append").start()
    )


def debounce_stream(
    texts: DataFrame, key: str, ts: str, text: str, quiet_ms: dict | int | None = None, reset: str | None = None, **options
) -> DataFrame:
    """Scan only texts that stood still; the quiet time follows the level of the last scan.

    Every text is scored before the state step, inside the JVM; the state only picks which
    scores count.  Blank text cancels a waiting scan and resets the level, and so does a row whose
    ``reset`` column, if one is named, is true.
    """
    quiet = quiet_ms if isinstance(quiet_ms, dict) else (
        QUIET_MS if quiet_ms is None else dict.fromkeys(QUIET_MS, quiet_ms)
    )
    dropped = F.coalesce(F.col(reset), F.lit(False)) if reset else F.lit(False)
    scored = detect(texts.select(key, ts, text, dropped.alias("__reset")), text, **options).select(
        key, ts, text, "__reset", risk_level(F.col("findings")).alias("level")
    )

    def step(memory: dict, event: dict) -> list[tuple]:
        if event["__reset"] or not (event[text] or "").strip():
            memory.update(waiting=None, level=None)
        else:
            due = event["ts"] + quiet[memory.get("level")] * 1000
            memory["waiting"] = [event["ts"], event[text], event["level"], due]
        return []

    def timer(memory: dict) -> int | None:
        return memory["waiting"][3] if memory.get("waiting") else None

    def fire(memory: dict, due: int) -> list[tuple]:
        at, body, level, _ = memory["waiting"]
        memory.update(waiting=None, level=level)
        return [(at, body, level, due)]

    key_type = texts.schema[key].dataType.simpleString()
    output = f"{key} {key_type}, {ts} timestamp, {text} string, level string, fires_at timestamp"
    return ordered_by_event_time(scored.withWatermark(ts, WATERMARK), key, ts, output, step, timer, fire)


def alert_stream(
    events: DataFrame, key: str, ts: str, kind: str, signature: str, tie: str | None = None,
    watermark: str = WATERMARK,
) -> DataFrame:
    """Scans with whether they alert; see ``operators.alerts.alerts`` for the rules."""

    def step(memory: dict, event: dict) -> list[tuple]:
        sign, what = event[signature] or "", event[kind]
        if what == "dismiss":
            memory["dismissed"] = sign
        elif what in ("clear", "reset") or not sign:
            memory["dismissed"] = ""
        else:
            return [(event["ts"], sign, sign != memory.get("dismissed", ""))]
        return []

    key_type = events.schema[key].dataType.simpleString()
    output = f"{key} {key_type}, {ts} timestamp, {signature} string, alerted boolean"
    return ordered_by_event_time(
        events.withWatermark(ts, watermark), key, ts, output, step, lambda m: None, lambda m, d: [], tie
    )


def answer_stream(
    events: DataFrame, key: str = "scan_id", ts: str = "ts", wait_ms: int = ANSWER_MS, watermark: str = WATERMARK
) -> DataFrame:
    """Outcome of each alert; see ``operators.alerts.answered`` for the rules.

    ``events`` holds the alerts themselves (``event = 'alert'``) with the user's steps.
    """

    def step(memory: dict, event: dict) -> list[tuple]:
        what, due = event["event"], event["ts"] + wait_ms * 1000
        if what == "alert":
            memory.update(alerted=True, open=False)
        elif what in ("open", "close"):
            memory.update(open=what == "open")
        elif what in ("hide", "show"):
            memory.update(hidden=what == "hide")
        elif memory.get("alerted"):
            # Answered or dropped: nothing is kept, and what comes later finds no alert.
            memory.clear()
            return [] if what == "reset" else [(what, event["ts"])]
        running = memory.get("alerted") and not memory.get("open") and not memory.get("hidden")
        memory.update(due=due if running else None)
        return []

    def fire(memory: dict, due: int) -> list[tuple]:
        memory.clear()
        return [("dismiss", due)]

    key_type = events.schema[key].dataType.simpleString()
    output = f"{key} {key_type}, action string, action_ts timestamp"
    return ordered_by_event_time(
        events.withWatermark(ts, watermark), key, ts, output, step, lambda m: m.get("due"), fire
    )


def stats_stream(texts: DataFrame, domain: str = "domain", text_col: str = "text", **options) -> DataFrame:
    """Running totals per domain, for complete or update output.

    Counts are combined before the shuffle, and the state holds one row per domain.
    """
    counts = detect(texts, text_col, **options).select(domain, *scan_counts("findings"))
    return counts.groupBy(F.coalesce(F.col(domain), F.lit("unknown")).alias("domain")).agg(
        F.sum("risks_found").alias("total"), F.sum("high_risk").alias("high_risk"),
        F.sum("medium_risk").alias("medium_risk"),
    )


def action_join(scans: DataFrame, actions: DataFrame, within: str = "1 hour") -> DataFrame:
    """Left outer join of a scan stream with an action stream by scan id: the live view.

    ``within`` bounds the state alone.  Every action stamped at most so long before or after its
    scan comes out as a row; a scan without one comes out with a null action once the watermark
    has passed it, which says that no action was seen yet.  Actions outside the interval or later
    than the watermark are in what ``keep_actions`` wrote, and ``answered_log`` has the last one.
    """
    s = scans.withWatermark("ts", WATERMARK).alias("s")
    a = actions.select(
        F.col("scan_id").alias("a_id"), F.col("ts").alias("action_ts"), F.col("action").alias("user_action")
    ).withWatermark("action_ts", WATERMARK)
    near = (
        (F.col("s.scan_id") == F.col("a_id"))
        & (F.col("action_ts") >= F.col("s.ts") - F.expr(f"INTERVAL {within}"))
        & (F.col("action_ts") <= F.col("s.ts") + F.expr(f"INTERVAL {within}"))
    )
    return s.join(a, near, "left_outer").drop("a_id")


def keep_actions(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer that keeps the last action of each scan and batch, however late.

    The action stream needs no watermark for it, and no scan needs to be there yet.  A batch has a
    folder of its own, which a replayed batch writes again.
    """

    def write(batch: DataFrame, number: int) -> None:
        last = F.max(F.struct("ts", "action")).alias("last")
        rows = batch.groupBy("scan_id").agg(last).select("scan_id", "last.action", "last.ts")
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def answered_log(log: DataFrame, path: str) -> DataFrame:
    """The log with the last of all actions that ``keep_actions`` wrote, with no limit of time."""
    return update_actions(log, log.sparkSession.read.schema(ACTIONS_SCHEMA).parquet(path))


def upsert_stats(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer that keeps the newest totals of all domains.

    Batch n takes the totals of the newest version before it, replaces those of its own domains, and
    writes a version of its own; readers see it when its pointer is there, and the one before until
    then.  A replayed batch does the same again, so totals are counted once.  Two versions are kept.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.select("domain", "total", "high_risk", "medium_risk")
        before = versions.read_current(spark, path, "totals", STATS_SCHEMA, below=number)
        kept = before.join(fresh.select("domain"), "domain", "left_anti").select(*fresh.columns)
        versions.commit(spark, path, number, {"totals": fresh.unionByName(kept)})
        versions.forget(spark, path, "totals")

    return write


def read_stats(spark, path: str) -> DataFrame:
    """Newest totals per domain from what ``upsert_stats`` wrote."""
    return versions.read_current(spark, path, "totals", STATS_SCHEMA)


def clear_stats(spark, path: str) -> None:
    """Totals of nothing; goes with clearing the log."""
    versions.commit(spark, path, 0, {"totals": spark.createDataFrame([], STATS_SCHEMA)}, fresh=True)


def redact_all_writer(path: str, **options) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer of redacted texts and of the ``fix`` actions that go with them.

    Batches hold ``scan_id, text, findings, new_text, ts``: what was found, the text as it is now,
    and when all of it was to be redacted.  A batch is worked on once; its texts and its actions
    appear together, and a replayed batch takes the place of its first version.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        versions.commit(spark, path, number, {
            "texts": redact_all(batch, **options),
            "actions": lambda done: spark.read.schema(REDACTED_SCHEMA).parquet(done["texts"]).selectExpr("scan_id", "user_action AS action", "action_ts AS ts"),
        })

    return write


def redacted_texts(spark, path: str) -> DataFrame:
    return versions.read_all(spark, path, "texts", REDACTED_SCHEMA)


def fixed_log(log: DataFrame, path: str) -> DataFrame:
    """The log with the ``fix`` actions that ``redact_all_writer`` wrote."""
    return update_actions(log, versions.read_all(log.sparkSession, path, "actions", "scan_id string, action string, ts timestamp"))
