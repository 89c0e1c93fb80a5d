"""Keyed state machines over events: jobs with retries, leases, one-time tokens, mutation keys, assembly of faces.

A machine is plain rules for one key: ``apply`` an event, ``fire`` what has come due, each giving output rows. ``replay``
runs a machine over events at rest; ``idloom.streaming.machines`` runs the same machine over a stream, so both give the
same rows. Time is the events' own (``at_ms``): whatever came due before an event fires before it is applied, at its own
time, however late it is noticed.

Events have (key, seq, type, id, ref, attempt, at_ms) and are taken in the order of at_ms, seq, type, id within a key; rows
come as (key, type, id, attempt, at_ms, outcome, detail). Events without a key or a time are left out; missing ids are
ids like any other. Unknown types are refused with a row.

State is small: a machine's own values, and *marks* (ids that must be remembered), each with an end of life of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idloom import dims

EVENT = "key string, seq long, type string, id string, ref string, attempt long, at_ms long"
OUTPUT = "key string, type string, id string, attempt long, at_ms long, outcome string, detail string"
FIELDS = [x.split()[0] for x in EVENT.split(", ")]
ROW = [x.split()[0] for x in OUTPUT.split(", ")]
ORDER = ["key", "at_ms", "seq", "type", "id"]

# Tries after the first, milliseconds between them (doubled each time where ``backoff``), and milliseconds
# after which an unanswered try counts as failed.
QUEUES = {
    "extraction": {"retries": 3, "delay": 5_000, "backoff": False, "expire": 240_000},
    "webhook": {"retries": 8, "delay": 15_000, "backoff": True, "expire": 600_000},
}
#: How long a transfer token can be used, and how long ids are remembered against replays.
TOKEN_MS, KEPT_MS = 5 * 60_000, dims.DAYS_KEPT * 86_400_000


class Marks:
    """Ids with an end of life each; ``purge`` drops those that have ended."""

    def __init__(self):
        self.ends: dict[str, int] = {}

    def live(self, mark: str, now: int) -> bool:
        return self.ends.get(mark, now) > now

    def put(self, mark: str, end: int) -> None:
        self.ends[mark] = end

    def drop(self, mark: str) -> None:
        self.ends.pop(mark, None)

    def purge(self, now: int) -> None:
        self.ends = {m: e for m, e in self.ends.items() if e > now}


def row(e: dict, outcome: str, detail: str | None = None, **more) -> dict:
    return {"type": e["type"], "id": e["id"], "attempt": e["attempt"], "at_ms": e["at_ms"], "outcome": outcome, "detail": detail} | more


class Machine:
    """Rules of one key. ``state`` is a dict of plain values, empty for a new key and emptied when nothing is left."""

    #: How long after an event its marks can matter: the stream purges at such steps.
    kept_ms = KEPT_MS

    def apply(self, state: dict, marks: Marks, e: dict) -> list[dict]:
        return [row(e, "refused", "unknown_event")]

    def due(self, state: dict) -> int | None:
        return state.get("due")

    def fire(self, key: str, state: dict, marks: Marks) -> list[dict]:
        """What happens at ``due``; afterwards due is later, or None."""
        state.clear()
        return []

    def advance(self, key: str, state: dict, marks: Marks, now: int) -> list[dict]:
        """Everything that came due up to ``now``."""
        out = []
        while (due := self.due(state)) is not None and due <= now:
            out += self.fire(key, state, marks)
        return out


class Jobs(Machine):
    """A queue's consumer. Keys are "queue|singleton"; types are send, ok and fail; ids are jobs.

    A send starts the first try at once, unless a job with its key is under way (duplicate) or the same job was sent before
    (replayed). A try that fails, or has no answer in the queue's time, is repeated after the queue's delay; when no
    tries are left the job is dead. Answers to another try than the current one are stale.
    """

    def __init__(self, queues: dict | None = None, kept_ms: int = KEPT_MS):
        self.queues, self.kept_ms = queues or QUEUES, kept_ms

    def _rules(self, key: str) -> dict | None:
        return self.queues.get(key.partition("|")[0])

    def apply(self, state: dict, marks: Marks, e: dict) -> list[dict]:
        rules = self._rules(e["key"])
        if rules is None or e["type"] not in ("send", "ok", "fail"):
            return [row(e, "refused", "unknown_event" if rules else "unknown_queue")]
        if e["type"] == "send":
            if marks.live(e["id"], e["at_ms"]):
                return [row(e, "replayed")]
            marks.put(e["id"], e["at_ms"] + self.kept_ms)
            if state:
                return [row(e, "duplicate", state["id"])]
            state.update(id=e["id"], attempt=1, active=True, due=e["at_ms"] + rules["expire"])
            return [row(e, "run", attempt=1)]
        if not state or not state["active"] or e["id"] != state["id"] or e["attempt"] not in (None, state["attempt"]):
            return [row(e, "stale")]
        if e["type"] == "ok":
            done = row(e, "completed", attempt=state["attempt"])
            state.clear()
            return [done]
        return self._failed(rules, state, e["at_ms"], "failed")

    def _failed(self, rules: dict, state: dict, now: int, why: str) -> list[dict]:
        last = {"type": "fail", "id": state["id"], "attempt": state["attempt"], "at_ms": now, "detail": why}
        if state["attempt"] > rules["retries"]:
            state.clear()
            return [last | {"outcome": "dead"}]
        wait = rules["delay"] * (2 ** (state["attempt"] - 1) if rules["backoff"] else 1)
        state.update(active=False, due=now + wait)
        return [last | {"outcome": "retry"}]

    def fire(self, key: str, state: dict, marks: Marks) -> list[dict]:
        rules, now = self._rules(key), state["due"]
        if state["active"]:
            return self._failed(rules, state, now, "expired")
        state.update(attempt=state["attempt"] + 1, active=True, due=now + rules["expire"])
        return [{"type": "send", "id": state["id"], "attempt": state["attempt"], "at_ms": now, "outcome": "run", "detail": None}]


class Leases(Machine):
    """Who may read a capture. Keys are sides; types are claim, done and technical; ids are captures, refs tokens.

    A claim is granted unless the same capture is ready or its lease still runs. Results count only with the token that
    holds the lease (a lease that ran out still counts until someone else claims). The third technical failure of a
    capture is dead; a new capture starts afresh.
    """

    def __init__(self, lease_ms: int = dims.LEASE_MS, kept_ms: int = KEPT_MS):
        self.lease_ms, self.kept_ms = lease_ms, kept_ms

    def apply(self, state: dict, marks: Marks, e: dict) -> list[dict]:
        now, same = e["at_ms"], bool(state) and state["capture"] == e["id"]
        if e["type"] == "claim":
            if same and state["status"] in ("ready", "dead"):
                return [row(e, "refused", state["status"])]
            if same and state["status"] == "processing" and state["until"] > now:
                return [row(e, "refused", "leased")]
            failures = state["failures"] if same else 0
            state.update(capture=e["id"], status="processing", token=e["ref"], until=now + self.lease_ms, failures=failures, due=now + self.kept_ms)
            return [row(e, "granted", e["ref"])]
        if e["type"] not in ("done", "technical"):
            return [row(e, "refused", "unknown_event")]
        if not same or state["status"] != "processing" or state["token"] != e["ref"]:
            return [row(e, "refused", "stale_result")]
        if e["type"] == "done":
            state["status"] = "ready"
            return [row(e, "ready", e["ref"])]
        state["failures"] += 1
        state["status"] = "dead" if state["failures"] >= dims.MAX_ATTEMPTS else "pending"
        return [row(e, state["status"], e["ref"], attempt=state["failures"])]


class Tokens(Machine):
    """One-time tokens. Keys are sessions; types are issue and consume; ids are nonces. A token is good once, within its
    life; issuing a nonce again changes nothing while it lives."""

    def __init__(self, life_ms: int = TOKEN_MS):
        self.life_ms = self.kept_ms = life_ms

    def apply(self, state: dict, marks: Marks, e: dict) -> list[dict]:
        if e["type"] == "issue":
            if marks.live(e["id"], e["at_ms"]):
                return [row(e, "replayed")]
            marks.put(e["id"], e["at_ms"] + self.life_ms)
            return [row(e, "issued")]
        if e["type"] != "consume":
            return [row(e, "refused", "unknown_event")]
        if not marks.live(e["id"], e["at_ms"]):
            return [row(e, "refused", "transfer_expired")]
        marks.drop(e["id"])
        return [row(e, "accepted")]


class Mutations(Machine):
    """Mutation keys. Keys are sessions, ids mutation keys: the first use is accepted, uses within its life are replays."""

    def __init__(self, kept_ms: int = KEPT_MS):
        self.kept_ms = kept_ms

    def apply(self, state: dict, marks: Marks, e: dict) -> list[dict]:
        if marks.live(e["id"], e["at_ms"]):
            return [row(e, "replayed")]
        marks.put(e["id"], e["at_ms"] + self.kept_ms)
        return [row(e, "accepted")]


class Assembly(Machine):
    """Joining the faces of a document, once for each set of captures. Keys are "session|kind"; types are capture and
    ready; ids are captures, refs sides.

    A side's current capture is the one taken last (of equal times the greater id), whatever comes first. When all
    required sides have a ready current capture, their set is joined; a set that was joined before isn't joined again.
    """

    def __init__(self, kept_ms: int = KEPT_MS, required: dict[str, tuple[str, ...]] | None = None):
        self.kept_ms = kept_ms
        self.required = required or {k: tuple(sides) for k, sides in dims.SIDES.items()}

    def apply(self, state: dict, marks: Marks, e: dict) -> list[dict]:
        sides = self.required.get(e["key"].rpartition("|")[2], ())
        if e["ref"] not in sides or e["type"] not in ("capture", "ready"):
            return [row(e, "refused", "unknown_side" if e["ref"] not in sides else "unknown_event")]
        end, current = e["at_ms"] + self.kept_ms, state.setdefault("current", {})
        state["due"] = max(state.get("due", 0), end)
        if e["type"] == "ready":
            marks.put(f"ready:{e['ref']}={e['id']}", end)
        elif [e["at_ms"], e["id"]] > current.get(e["ref"], [-1, ""]):
            current[e["ref"]] = [e["at_ms"], e["id"]]
        names = [f"{side}={current[side][1]}" for side in sorted(sides) if side in current]
        if len(names) < len(sides) or not all(marks.live(f"ready:{n}", e["at_ms"]) for n in names):
            return []
        together = ";".join(names)
        if marks.live(f"joined:{together}", e["at_ms"]):
            return []
        marks.put(f"joined:{together}", end)
        return [row(e, "joined", together)]


# ---------------------------------------------------------------- over events at rest


def typed(events: DataFrame) -> DataFrame:
    """The columns of events with their types, null where they aren't there."""
    kinds = dict(x.split() for x in EVENT.split(", "))
    column = lambda c: F.col(c) if c in events.columns else F.lit(None)
    rows = events.select(*[column(c).cast(kinds[c]).alias(c) for c in FIELDS])
    return rows.where("key IS NOT NULL AND at_ms IS NOT NULL").withColumns({"seq": F.coalesce("seq", F.lit(0)), "type": F.coalesce("type", F.lit("")), "id": F.coalesce("id", F.lit(""))})


def replay(events: DataFrame, machine: Machine, until_ms: int | None = None, partitions: int | None = None) -> DataFrame:
    """The machine's rows over all events: dealt out by key, sorted within tasks, read once as a stream. After a key's last
    event everything that comes due fires, up to ``until_ms`` where it is given. A task holds one key's state at a time."""
    n = partitions or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = typed(events).repartition(n, "key").sortWithinPartitions(*ORDER)
    end = (1 << 62) if until_ms is None else until_ms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, marks = None, {}, Marks()
        for batch in batches:
            out: list[dict] = []
            for e in batch.to_pylist():
                if e["key"] != key:
                    if key is not None:
                        out += [{"key": key} | r for r in machine.advance(key, state, marks, end)]
                    key, state, marks = e["key"], {}, Marks()
                out += [{"key": key} | r for r in [*machine.advance(key, state, marks, e["at_ms"]), *machine.apply(state, marks, e)]]
                now = e["at_ms"]
            if batch.num_rows:
                marks.purge(now)
            yield rows_of(out)
        if key is not None:
            yield rows_of([{"key": key} | r for r in machine.advance(key, state, marks, end)])

    return dealt.mapInArrow(run, OUTPUT)


def rows_of(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"attempt": pa.int64(), "at_ms": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in ROW], names=ROW)
