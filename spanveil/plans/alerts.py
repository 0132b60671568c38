"""Queries for the time-dependent operators, over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import alerts
from .queries import register, table, wall_time

# The events of a user lie minutes to hours apart, so the quiet time is one hour here.
_QUIET_MS = 3_600_000
_TEXT = "CASE event_type WHEN 'view' THEN '  ' ELSE event_type || ' ' || props END"

_KIND = "CASE event_type WHEN 'error' THEN 'clear' WHEN 'click' THEN 'dismiss' ELSE 'scan' END"
_SIGN = """CASE WHEN event_type = 'signup' AND event_id % 5 = 0 THEN '' WHEN event_type = 'error' THEN NULL
    ELSE 'email:a' || CAST(event_id % 2 AS STRING) END"""


@register(
    "debounced_scans",
    f"""WITH e AS (SELECT event_id, user_id, ts, {_TEXT} AS text,
        lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)
    SELECT event_id, user_id, text, ts + INTERVAL 1 HOUR AS fires_at FROM e
    WHERE trim(text) <> '' AND (nxt IS NULL OR nxt - ts >= INTERVAL 1 HOUR)""",
)
def debounced_scans(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "ts", f"{_TEXT} AS text")
    quiet = alerts.debounced(events, "user_id", "ts", "text", "event_id", _QUIET_MS, chunk_s=86_400)
    return quiet.select("event_id", "user_id", "text", wall_time("fires_at"))


@register(
    "alert_suppression",
    f"""WITH e AS (SELECT event_id, user_id, ts, {_KIND} AS kind, coalesce({_SIGN}, '') AS sign FROM events),
    m AS (SELECT *, CASE WHEN kind = 'dismiss' THEN sign WHEN kind = 'clear' OR (kind = 'scan' AND sign = '') THEN '' END AS memory FROM e),
    l AS (SELECT *, last_value(memory IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dismissed FROM m)
    SELECT event_id, user_id, sign, sign <> coalesce(dismissed, '') AS alerted FROM l WHERE kind = 'scan' AND sign <> ''""",
)
def alert_suppression(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id", "ts", f"{_KIND} AS kind", f"{_SIGN} AS sign"
    )
    found = alerts.alerts(events, "user_id", "ts", "event_id", "kind", "sign")
    return found.select("event_id", "user_id", "sign", "alerted")


_STEPS = """CASE event_type WHEN 'view' THEN 'open' WHEN 'signup' THEN 'close' WHEN 'error' THEN 'hide' WHEN 'click' THEN 'show'
    ELSE CASE WHEN event_id % 2 = 0 THEN 'fix' ELSE 'dismiss' END END"""


@register(
    "unanswered_alerts",
    f"""WITH a AS (SELECT user_id AS scan_id, min(ts) - INTERVAL 1 MINUTE AS ts FROM events GROUP BY user_id),
    e AS (SELECT user_id AS scan_id, ts, {_STEPS} AS event, 1 AS seq FROM events
        UNION ALL SELECT scan_id, ts, 'alert', 0 FROM a),
    o AS (SELECT *, lead(ts) OVER w AS nxt, last_value(CASE WHEN event = 'open' THEN 1 WHEN event IN ('alert', 'close') THEN 0 END IGNORE NULLS)
        OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opened,
        last_value(CASE event WHEN 'hide' THEN 1 WHEN 'show' THEN 0 END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hidden FROM e WINDOW w AS (PARTITION BY scan_id ORDER BY ts, seq, event)),
    r AS (SELECT scan_id, ts + INTERVAL 6 HOUR AS at_, 'dismiss' AS action FROM o
            WHERE ((event IN ('alert', 'close') AND coalesce(hidden, 0) = 0) OR (event = 'show' AND coalesce(opened, 0) = 0)) AND (nxt IS NULL OR nxt >= ts + INTERVAL 6 HOUR)
        UNION ALL SELECT scan_id, ts, event FROM o WHERE event IN ('fix', 'dismiss'))
    SELECT scan_id, first(action ORDER BY at_, action) AS action, min(at_) AS action_ts FROM a LEFT JOIN r USING (scan_id) GROUP BY scan_id""",
)
def unanswered_alerts(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events").selectExpr("event_id", "user_id AS scan_id", "ts", f"{_STEPS} AS event")
    shown = events.groupBy("scan_id").agg((F.min("ts") - F.expr("INTERVAL 1 MINUTE")).alias("ts"))
    done = alerts.answered(shown, events, wait_ms=6 * 3_600_000, chunk_s=86_400)
    return done.select("scan_id", "action", wall_time("action_ts"))


@register(
    "stale_scans",
    r"""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN NULL ELSE text END AS scanned, make_timestamp(turn * 200000) AS created,
        CASE (conv_id + turn) % 4 WHEN 0 THEN text WHEN 1 THEN '  x ' || replace(text, ' ', '  ') WHEN 2 THEN text || ' and more' ELSE NULL END AS now_text
        FROM conversations),
    n AS (SELECT *, trim(regexp_replace(coalesce(scanned, ''), '\s+', ' ', 'g')) AS a, trim(regexp_replace(coalesce(now_text, ''), '\s+', ' ', 'g')) AS b FROM t)
    SELECT conv_id, turn, CASE WHEN scanned IS NULL THEN true WHEN 1000 - turn * 200 < 600 THEN false
        ELSE NOT (a = b OR (a <> '' AND b <> '' AND contains(b, a))) END AS stale FROM n""",
)
def stale_scans(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").selectExpr(
        "conv_id", "turn", "CASE WHEN turn % 5 = 4 THEN NULL ELSE text END AS scanned",
        "timestamp_micros(turn * 200000) AS created",
        """CASE (conv_id + turn) % 4 WHEN 0 THEN text WHEN 1 THEN '  x ' || replace(text, ' ', '  ')
            WHEN 2 THEN text || ' and more' ELSE NULL END AS now_text""",
    )
    now = F.timestamp_micros(F.lit(1_000_000))
    return alerts.stale(rows, now, "scanned", "created", "now_text").select("conv_id", "turn", "stale")
