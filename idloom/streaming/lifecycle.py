"""The session lifecycle over a stream of events, with one state for each session.

Events must arrive in ``seq`` order within a session across batches; within a batch they are sorted. An event-time
timer expires an idle session, as the rule for events at rest does with ``tick``. The state of a final session is removed
when the time that sessions are kept for has passed, and that of an unknown one after an idle session's time; a session
that is processing has no deadline and keeps its state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from idloom.operators import lifecycle as L
from idloom.streaming.machines import StoredMarks, prepared

_NAMES = [x.split()[0] for x in L.OUTPUT.split(", ")]
#: How long the state of a final session is kept.
KEPT_MS = L.dims.DAYS_KEPT * 86_400_000


class Sessions(StatefulProcessor):
    """One session: its state as one value, its mutation keys as entries of a map with a life each (see ``machines``)."""

    def __init__(self, timers: bool):
        self.timed, self.kept = timers, KEPT_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.own = handle.getValueState("session", "state string")
        self.seen = StoredMarks(handle.getMapState("seen", "mark string", "end long"), handle, L.KEPT_MS)

    def _load(self) -> dict:
        known = self.own.exists()
        state = json.loads(self.own.get()[0]) if known else L.new_state()
        self.seen.begin(fresh=not known)
        state["seen"] = self.seen
        return state

    def _save(self, key: str, state: dict, now: int) -> Iterator[Row]:
        self.own.update((L.dump(state),))
        self.seen.flush(self.timed)
        if self.timed:
            if state["status"] != "processing":
                kept = self.kept if state["status"] in L.dims.FINAL else 0
                due = now + L.IDLE_MS if state["status"] is None else state["expires"] + kept
                self.handle.registerTimer(max(due, now + 1))
        yield Row(result=json.dumps(dict(zip(_NAMES, L.view(key, state), strict=True))))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        state = self._load()
        events = [json.loads(r["event"]) for r in rows]
        for e in sorted(events, key=lambda r: (r["seq"], r["at_ms"], r["type"])):
            L.step(state, e)
        yield from self._save(key[0], state, max(timerValues.getCurrentWatermarkInMs(), 0) if self.timed else 0)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        at, state = expiredTimerInfo.getExpiryTimeInMs(), self._load()
        now = max(at, timerValues.getCurrentWatermarkInMs())
        if at % self.seen.step == 0:
            self.seen.purge(now)
        if not self.own.exists() or state["status"] == "processing":
            return
        final = state["status"] in L.dims.FINAL
        if state["status"] is None or (final and state["expires"] + self.kept <= now):
            self.own.clear()
            self.seen.clear()
        elif not final and state["expires"] <= now:
            L.step(state, dict.fromkeys(L.FIELDS) | {"type": "tick", "at_ms": max(timerValues.getCurrentWatermarkInMs(), state["expires"])})
            yield from self._save(key[0], state, now)

    def close(self) -> None:
        pass


def fold_stream(events: DataFrame, late: str = "10 minutes", timers: bool = True) -> DataFrame:
    """Streaming counterpart of ``lifecycle.fold``: the state of each session after every batch that touches it (update
    mode), and after its timer."""
    prepared(events.sparkSession)
    # an event and a result are one text each, and rows aren't made into frames: there are many groups of few events
    event = F.to_json(F.struct(*L.FIELDS), {"ignoreNullFields": "false"})
    timed = L.typed_events(events).select("session_id", event.alias("event"), F.timestamp_millis("at_ms").alias("at")).withWatermark("at", late)
    out = timed.groupBy("session_id").transformWithState(Sessions(timers), "result string", "update", "EventTime" if timers else "None")
    return out.select(F.from_json("result", L.OUTPUT).alias("r")).select("r.*")


def once_per_key(events: DataFrame, key: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark: a work queue without duplicates."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def latest_telemetry(events: DataFrame, key: str, ts: str, n: int = 120, minutes: int = 30) -> DataFrame:
    """(key, samples) after every batch: the last ``n`` samples of each key as (ts, value), dropped after ``minutes``
    without any (event time). The state of a key is bounded by ``n``."""
    timed = events.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"), F.col("value").cast("double").alias("value")).withWatermark("ts", "10 minutes")
    schema = "key string, samples long, oldest timestamp, newest timestamp, mean double"

    def run(k: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        if group.hasTimedOut:
            group.remove()
            return
        kept = json.loads(group.get[0]) if group.exists else []
        for f in frames:
            kept += [[int(t.value // 1000), v] for t, v in zip(f["ts"], f["value"], strict=True)]
        kept = sorted(kept)[-n:]
        group.update((json.dumps(kept),))
        group.setTimeoutTimestamp(max(kept[-1][0] // 1000 + minutes * 60_000, group.getCurrentWatermarkMs() + 1))
        times = pd.to_datetime([t for t, _ in kept], unit="us")
        yield pd.DataFrame({"key": [k[0]], "samples": [len(kept)], "oldest": [times[0]], "newest": [times[-1]], "mean": [sum(v for _, v in kept) / len(kept)]})

    return timed.groupBy("key").applyInPandasWithState(run, schema, "state string", "update", GroupStateTimeout.EventTimeTimeout)
