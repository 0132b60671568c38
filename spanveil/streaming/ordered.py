"""Per-key state machines over events in event-time order.

Events may arrive out of order.  Each key buffers its events in state until the watermark has
passed them, then handles them in order, so the result does not depend on arrival.  Timers of
the state machine run in event time.  Rows behind the watermark are late and are dropped.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# A machine is two functions.  ``step(memory, event)`` handles one event and returns output
# rows; ``timer(memory)`` returns the due time in microseconds or None; ``fire(memory, due)``
# handles the timer.
Step = Callable[[dict, dict], list[tuple]]


def ordered_by_event_time(
    events: DataFrame, key: str, ts: str, output: str, step: Step,
    timer: Callable[[dict], int | None], fire: Callable[[dict, int], list[tuple]],
    tie: str | None = None,
) -> DataFrame:
    """Run a state machine per key.  ``events`` needs a watermark on ``ts``.

    ``output`` is the schema of the rows returned; the first column is the key.
    """
    columns = [c.split()[0] for c in output.split(",")]
    times = [c.split()[0] for c in output.split(",") if c.split()[1] == "timestamp"]

    def handle(group: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory, waiting = json.loads(state.get[0]) if state.exists else ({}, [])
        watermark = max(state.getCurrentWatermarkMs(), 0)
        limit = watermark * 1000
        if not state.hasTimedOut:
            for frame in frames:
                frame = frame.assign(**{ts: frame[ts].astype("datetime64[us]").astype("int64")})
                # What the watermark has passed was handled already; such a row is late.
                frame = frame[frame[ts] > limit].drop(columns=[key])
                waiting.extend(json.loads(frame.to_json(orient="records")))
        waiting.sort(key=lambda e: (e[ts], e.get(tie) if tie else 0))
        rows: list[tuple] = []

        def run_timers(until: int) -> None:
            while (due := timer(memory)) is not None and due <= until:
                rows.extend(fire(memory, due))

        later = []
        for event in waiting:
            if event[ts] > limit:
                later.append(event)
                continue
            run_timers(event[ts])
            rows.extend(step(memory, {**event, "ts": event[ts]}))
        run_timers(limit)
        if not later and not any(memory.values()):
            # Nothing to remember: the key is forgotten, so state does not grow with past keys.
            if state.exists:
                state.remove()
        else:
            state.update((json.dumps([memory, later]),))
        pending = [t for t in (timer(memory), later[0][ts] if later else None) if t is not None]
        if pending:
            state.setTimeoutTimestamp(max(min(pending) // 1000, watermark) + 1)
        if not rows:
            return
        out = pd.DataFrame([(*group, *r) for r in rows], columns=columns)
        for column in times:
            out[column] = pd.to_datetime(out[column], unit="us")
        yield out

    return events.groupBy(key).applyInPandasWithState(
        handle, output, "memory string", "append", GroupStateTimeout.EventTimeTimeout
    )
