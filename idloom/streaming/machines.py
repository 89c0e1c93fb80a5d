"""State machines over a stream: the machines of ``operators.machines``, with state and timers of their own for each key.

A key's own values are one small value; its marks are entries of a map, each read and written by itself, so that an event
costs the same however many ids are remembered. Ended marks are dropped by timers, at steps of an eighth of their life, and
an emptied key leaves nothing behind: the state is bounded by what is alive.

Events of a key must arrive in time order across batches; within a batch they are sorted. What is later than the
watermark is dropped. Sessions that run these streams need Spark's RocksDB state store; ``prepared`` sets it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from idloom.operators.machines import FIELDS, OUTPUT, ROW, Machine, typed

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Steps of a mark's life at which ended marks are dropped.
STEPS = 8


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the state store that keyed state with timers needs."""
    if spark.conf.get(_PROVIDER, None) != _ROCKS:
        spark.conf.set(_PROVIDER, _ROCKS)
    return spark


class StoredMarks:
    """``Marks`` in a map of the state store. What is put is held until ``flush``, so a call looks each mark up at most once;
    the marks of a key that is ``fresh`` aren't looked up at all."""

    def __init__(self, entries: Any, handle: StatefulProcessorHandle, step_ms: int):
        self.entries, self.handle, self.step = entries, handle, max(step_ms // STEPS, 1)
        self.begin()

    def begin(self, fresh: bool = False) -> None:
        self.fresh, self.held = fresh, {}

    def live(self, mark: str, now: int) -> bool:
        if mark not in self.held:
            if self.fresh or not self.entries.containsKey((mark,)):
                return False
            self.held[mark] = (self.entries.getValue((mark,))[0], False)
        return self.held[mark][0] > now

    def put(self, mark: str, end: int) -> None:
        self.held[mark] = (end, True)

    def drop(self, mark: str) -> None:
        self.held.pop(mark, None)
        if not self.fresh:
            self.entries.removeKey((mark,))

    def purge(self, now: int) -> None:
        ended = [k[0] for k, v in self.entries.iterator() if v[0] <= now and k[0] not in self.held]
        for mark in ended:
            self.entries.removeKey((mark,))

    def clear(self) -> None:
        self.held = {}
        self.entries.clear()

    def flush(self, timers: bool = True) -> None:
        put = {m: end for m, (end, new) in self.held.items() if new}
        for mark, end in put.items():
            self.entries.updateValue((mark,), (end,))
        for at in {-(-end // self.step) * self.step for end in put.values()} if timers else ():
            self.handle.registerTimer(at)
        self.held = {}


class Processor(StatefulProcessor):
    """Runs a machine for each key. Rows in and out are JSON texts, as a key's columns would be converted one by one."""

    def __init__(self, machine: Machine):
        self.machine = machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.own = handle.getValueState("own", "state string")
        self.marks = StoredMarks(handle.getMapState("marks", "mark string", "end long"), handle, self.machine.kept_ms)

    def _load(self) -> dict:
        self.marks.begin()
        return json.loads(self.own.get()[0]) if self.own.exists() else {}

    def _save(self, before: str, state: dict) -> None:
        after = json.dumps(state, sort_keys=True)
        if after != before:
            if state:
                self.own.update((after,))
            else:
                self.own.clear()
            due = self.machine.due(state)
            if due is not None:
                self.handle.registerTimer(due)
        self.marks.flush()

    def _rows(self, key: str, rows: list[dict]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame({"result": [json.dumps({"key": key} | r) for r in rows]})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        events = [json.loads(x) for f in rows for x in f["event"]]
        state, out = self._load(), []
        before = json.dumps(state, sort_keys=True)
        for e in sorted(events, key=lambda e: (e["at_ms"], e["seq"], e["type"], e["id"])):
            out += self.machine.advance(key[0], state, self.marks, e["at_ms"])
            out += self.machine.apply(state, self.marks, e)
        self._save(before, state)
        yield from self._rows(key[0], out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        at, state = expiredTimerInfo.getExpiryTimeInMs(), self._load()
        now = max(at, timerValues.getCurrentWatermarkInMs())
        before = json.dumps(state, sort_keys=True)
        out = self.machine.advance(key[0], state, self.marks, now)
        if at % self.marks.step == 0:
            self.marks.purge(now)
        self._save(before, state)
        yield from self._rows(key[0], out)

    def close(self) -> None:
        pass


def run_machine(events: DataFrame, machine: Machine, late: str = "10 minutes") -> DataFrame:
    """The machine's rows over a stream of events, each once, in update mode. Timers fire as the watermark passes them."""
    prepared(events.sparkSession)
    event = F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"})
    timed = typed(events).select("key", event.alias("event"), F.timestamp_millis("at_ms").alias("at")).withWatermark("at", late)
    out = timed.groupBy("key").transformWithStateInPandas(Processor(machine), "result string", "update", "EventTime")
    return out.select(F.from_json("result", OUTPUT).alias("r")).select(*[f"r.{c}" for c in ROW])


