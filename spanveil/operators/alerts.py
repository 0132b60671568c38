"""Time-dependent behaviour of scanning, over tables of past events.

Every function is the batch form of a streaming operator in ``spanveil.streaming`` and gives
the same rows; a stream can't tell that something never came, so alerts without an outcome are
rows of the batch form alone.  Keys are worked on in time chunks, so one busy key is not held by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import collapse_whitespace
from .carry import first_after, last_before, time_chunk

# --- fixed values: quiet time before a scan, by the level of the previous scan, in ms ----------
QUIET_MS = {"HIGH": 80, "MEDIUM": 200, None: 350}
FRESH_MS = 600
ANSWER_MS = 15_000


def not_blank(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")) > 0


def debounced(
    events: DataFrame, key: str, ts: str, text: str, tie: str, quiet_ms: int = QUIET_MS[None], chunk_s: int = 3600
) -> DataFrame:
    """Texts that stood for ``quiet_ms`` before the next event of their key; blanks never do.

    ``fires_at`` is when the scan starts.
    """
    order = [ts, tie]
    df = first_after(events, [key], order, time_chunk(ts, chunk_s), F.col(ts), "__next")
    gap = F.unix_micros("__next") - F.unix_micros(F.col(ts))
    stood = F.col("__next").isNull() | (gap >= quiet_ms * 1000)
    fires = F.timestamp_micros(F.unix_micros(F.col(ts)) + quiet_ms * 1000)
    return df.where(stood & not_blank(F.col(text))).withColumn("fires_at", fires).drop("__next")


def alerts(
    events: DataFrame, key: str, ts: str, tie: str, kind: str, signature: str, chunk_s: int = 86_400
) -> DataFrame:
    """Scans with whether they alert.

    Events are ``scan`` (with a signature, empty when nothing was found), ``dismiss`` (with
    the signature dismissed) and ``clear`` (text emptied) or ``reset``.  A scan is silent
    when its signature is the one dismissed last; a clear, a reset or an empty scan forgets that.
    """
    order = [ts, tie]
    is_scan = F.col(kind) == "scan"
    sign = F.coalesce(F.col(signature), F.lit(""))
    memory = F.when(F.col(kind) == "dismiss", sign).when(
        F.col(kind).isin("clear", "reset") | (is_scan & (sign == "")), F.lit("")
    )
    df = last_before(events, [key], order, time_chunk(ts, chunk_s), {"__dismissed": memory})
    shown = sign != F.coalesce(F.col("__dismissed"), F.lit(""))
    return df.where(is_scan & (sign != "")).withColumn("alerted", shown).drop("__dismissed")


def answered(
    alerts_: DataFrame, events: DataFrame, key: str = "scan_id", ts: str = "ts", wait_ms: int = ANSWER_MS,
    chunk_s: int = 3600,
) -> DataFrame:
    """Outcome of each alert: the user's action, or ``dismiss`` at the time-out.

    ``events`` holds ``open``/``close`` of the details, ``hide``/``show`` of the page and the
    actions; actions before the alert don't answer it.  The clock starts with the alert and anew
    at each close or show, but only while the page is visible and the details are shut; open and
    hide stop it.  An alert whose clock is stopped for good, or that a ``reset`` drops, comes out
    with no action.
    """
    control = ["open", "close", "hide", "show"]
    lines = alerts_.select(key, F.col(ts), F.lit("alert").alias("event"), F.lit(0).alias("seq")).unionByName(
        events.select(key, F.col(ts), "event", F.lit(1).alias("seq"))
    )
    order = [ts, "seq", "event"]
    chunk = time_chunk(ts, chunk_s)
    # Whether the details are open, the page hidden and the alert there is carried forward.
    event = F.col("event")
    lines = last_before(lines, [key], order, chunk, {
        "drawer": F.when(event == "open", True).when(event.isin("alert", "close"), False),
        "hidden": F.when(event == "hide", True).when(event == "show", False),
        "alerted": F.when(event == "alert", True),
    })
    lines = first_after(lines, [key], order, chunk, F.col(ts), "next_ts")
    alerted, shut = F.coalesce("alerted", F.lit(False)), ~F.coalesce("drawer", F.lit(False))
    visible = ~F.coalesce("hidden", F.lit(False))
    starts = ((event == "alert") & visible) | (
        alerted & ((event == "close") & visible | (event == "show") & shut)
    )
    due = F.timestamp_micros(F.unix_micros(F.col(ts)) + wait_ms * 1000)
    expires = starts & (F.col("next_ts").isNull() | (F.col("next_ts") >= due))
    answer = alerted & ~event.isin("alert", "reset", *control)
    dropped = alerted & (event == "reset")
    # The first of time-out and action wins; a struct minimum finds it in one combinable pass.
    first = F.min(
        F.when(expires, F.struct(due.alias("at"), F.lit("dismiss").alias("action"))).when(
            answer, F.struct(F.col(ts).alias("at"), F.col("event").alias("action"))
        ).when(dropped, F.struct(F.col(ts).alias("at"), F.lit(None).cast("string").alias("action")))
    )
    outcome, at = F.col("__first.action"), F.col("__first.at")
    return lines.groupBy(key).agg(
        first.alias("__first"), F.bool_or(F.col("event") == "alert").alias("__alerted")
    ).where("__alerted").select(
        key, outcome.alias("action"), F.when(outcome.isNotNull(), at).alias("action_ts")
    )


def stale(scans: DataFrame, now: Column, scanned: str, created: str, current: str, out: str = "stale") -> DataFrame:
    """Whether a scan no longer describes the current text.

    A scan younger than 600 ms is fresh.  Later the texts are compared with white space
    collapsed: equal, or the current one containing the scanned one, is fresh.  A scan without a snapshot is
    stale.
    """
    age = (F.unix_micros(now) - F.unix_micros(F.coalesce(F.col(created), F.timestamp_micros(F.lit(0))))) / 1000
    a = F.expr(f"coalesce({collapse_whitespace(scanned)}, '')")
    b = F.expr(f"coalesce({collapse_whitespace(current)}, '')")
    same = (a == b) | ((F.length(a) > 0) & (F.length(b) > 0) & b.contains(a))
    return scans.withColumn(
        out, F.when(F.col(scanned).isNull(), True).when(age < FRESH_MS, False).otherwise(~same)
    )
