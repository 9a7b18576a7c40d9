"""The lives of tasks, from their events: in one batch, or as a stream with state, timers and a time to live.

A task lives from its first event until no event has come for longer than `ttl`; an event after that is another life's. Events come in any
order: a life's state is that of its latest event, its progress the sum of all its steps, and an event between two lives that
it reaches makes one of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: States in order; of events of one time the later state counts.
STATES = ["PENDING", "PROCESSING", "COMPLETED"]
LIFE = "task_id string, created_at timestamp, last_at timestamp, expires_at timestamp, state string, message string, progress double, percent double, n_events long"


def _rank(state: Column) -> Column:
    return F.coalesce(*(F.when(state == s, i) for i, s in enumerate(STATES)), F.lit(-1))


def percent(progress: Column, most: Column) -> Column:
    """Of most, two places, 100 at most; 0 where most isn't above 0."""
    return F.coalesce(F.when(most > 0, F.least(F.round(progress / most * 100, 2), F.lit(100.0))), F.lit(0.0))


def lives(events: DataFrame, ttl_seconds: int) -> DataFrame:
    """LIFE of each life that the events have: task_id, ts, state, message, step (added to the progress), most (what the
    progress goes up to; the latest that isn't null counts). expires_at is the last event's time and ttl_seconds. A state that
    isn't one of STATES counts as the first; null steps as 0; events without a task or a time take no part."""
    rows = events.where("task_id is not null and ts is not null")
    at = F.struct("ts", _rank(F.col("state")), "message")
    folded = rows.groupBy(F.col("task_id").cast("string").alias("task_id"), F.session_window("ts", f"{ttl_seconds} seconds").alias("_w")).agg(
        F.min("ts").alias("created_at"),
        F.max("ts").alias("last_at"),
        F.max(at).alias("_at"),
        F.sum(F.coalesce("step", F.lit(0.0))).alias("progress"),
        F.max(F.when(F.col("most").isNotNull(), F.struct("ts", "most"))).alias("_most"),
        F.count(F.lit(1)).alias("n_events"),
    )
    state = F.element_at(F.array(*map(F.lit, STATES)), F.greatest(F.col("_at")["col2"], F.lit(0)) + 1)
    return folded.select("task_id", "created_at", "last_at", F.col("_w.end").alias("expires_at"), state.alias("state"), F.col("_at.message").alias("message"), "progress", percent(F.col("progress"), F.coalesce("_most.most", F.lit(100.0))).alias("percent"), "n_events")


_HELD = "start long, last long, at long, rank int, message string, progress double, most_at long, most double, n long"
_OUT = f"{LIFE}, expired boolean"


class TaskLives(StatefulProcessor):
    """Of each task the lives that may still change, a row each, and a timer for the end of each. Rows come out for lives that
    events of the batch touched, and once more, as expired, when the watermark has passed a life's end; then its state goes."""

    def __init__(self, ttl_seconds: int) -> None:
        self.ttl = ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("lives", _HELD)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known, touched = [list(x) for x in self.held.get()], []
        for batch in rows:
            for ts, state, message, step, most in zip(batch["at"], batch["state"], batch["message"], batch["step"], batch["most"], strict=True):
                ts = int(ts)
                of = lambda x: None if x is None or x != x else x
                most, step, message = of(most), of(step) or 0.0, of(message)
                new = [ts, ts, ts, STATES.index(state) if state in STATES else -1, message, float(step), None if most is None else ts, most, 1]
                met = [x for x in known if x[0] - self.ttl <= ts <= x[1] + self.ttl]
                known = [x for x in known if x not in met]
                for x in met:
                    new = _merged(x, new)
                known.append(new)
                touched = [x for x in touched if x not in met] + [new]
        self._keep(known)
        if touched:
            yield self._rows(key, touched, False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        known = [list(x) for x in self.held.get()]
        over = [x for x in known if x[1] + self.ttl < now]
        self._keep([x for x in known if x not in over])
        if over:
            yield self._rows(key, over, True)

    def close(self) -> None:
        pass

    def _keep(self, known: list[list]) -> None:
        if known:
            self.held.put([tuple(x) for x in known])
        else:
            self.held.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        for end in {(x[1] + self.ttl) // 1000 + 1 for x in known}:
            self.handle.registerTimer(end)

    def _rows(self, key: Any, some: list[list], expired: bool) -> pd.DataFrame:
        time = lambda micros: pd.to_datetime(pd.Series(micros, dtype="int64"), unit="us")
        most = [100.0 if x[7] is None else x[7] for x in some]
        return pd.DataFrame(
            {
                "task_id": [key[0]] * len(some),
                "created_at": time([x[0] for x in some]),
                "last_at": time([x[1] for x in some]),
                "expires_at": time([x[1] + self.ttl for x in some]),
                "state": [STATES[max(x[3], 0)] for x in some],
                "message": [x[4] for x in some],
                "progress": [x[5] for x in some],
                "percent": [min(round(x[5] / m * 100, 2), 100.0) if m > 0 else 0.0 for x, m in zip(some, most, strict=True)],
                "n_events": [x[8] for x in some],
                "expired": [expired] * len(some),
            }
        )


def _merged(a: list, b: list) -> list:
    order = lambda x: (x[2], x[3], x[4] is not None, x[4] or "")
    last = max(a, b, key=order)
    given = [x for x in (a, b) if x[6] is not None]
    most = max(given, key=lambda x: (x[6], x[7])) if given else a
    return [min(a[0], b[0]), max(a[1], b[1]), *last[2:5], a[5] + b[5], most[6], most[7], a[8] + b[8]]


def life_stream(events: DataFrame, ttl_seconds: int, late_seconds: int) -> DataFrame:
    """lives() of a stream of the same events, with `expired`, in update mode: for each batch the lives that it touched, and
    those that have ended. Events over late_seconds behind the latest one may be dropped. Needs the RocksDB state store."""
    rows = events.where("task_id is not null and ts is not null").withWatermark("ts", f"{late_seconds} seconds")
    rows = rows.select(F.col("task_id").cast("string").alias("task_id"), "ts", F.unix_micros("ts").alias("at"), "state", "message", F.col("step").cast("double").alias("step"), F.col("most").cast("double").alias("most"))
    return rows.groupBy("task_id").transformWithStateInPandas(TaskLives(ttl_seconds), _OUT, "Update", "EventTime")
