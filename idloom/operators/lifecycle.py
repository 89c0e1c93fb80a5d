"""The lifecycle of a session: a fold of its events in order.

``step`` is the whole state machine: a pure function from (state, event) to state, small enough to be read as a table of
transitions. ``fold`` runs it over events at rest; ``idloom.streaming.lifecycle`` runs the same function over a stream.

Events have (session_id, seq, type, kind, side, capture_id, mutation_key, ok, at_ms) and may have ``facts``. Types: create
(kind holds the policy's id), select (kind holds documents joined by commas), capture (ok: the photo's quality), stage,
ocr (ok: all required fields were read), fatal, technical (the reading of a side failed for a reason that isn't the
photo's), refused (a side was found not to be the document's), conflict (ok: a target can be retried), confirm, retake,
retake_side, pair, submit (ok: no conflict is left), tick.
``facts`` of an ocr event is what ``linkage.session_facts`` makes of a document's reading: comparable identity facts and
the sides that they came from. Where they are given, conflicts between documents are found here, as in
``linkage.cross_document``; the conflict events and flags are for readings that aren't.
An event that isn't allowed changes nothing but the count of rejected events. A mutation key that was used before changes
nothing at all, for as long as sessions are kept.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idloom import dims
from idloom.operators.machines import KEPT_MS, Marks

IDLE_MS = dims.MINUTES_IDLE * 60_000
OUTPUT = "session_id string, status string, reason_code string, version long, expires_at_ms long, current_kind string, confirmed long, rejected long, last_error string"
COLUMNS = ("session_id", "seq", "type", "kind", "side", "capture_id", "mutation_key", "ok", "at_ms")
FIELDS = (*COLUMNS, "facts")
FACTS = [(f, kind in ("latin", "arabic")) for f, _, kind in dims.IDENTITY_FACTS if f in dims.ONBOARDING]
_POLICY = {p[0]: {"selection": p[2], "documents": p[3], "least": p[4]} for p in dims.POLICIES}


class Refused(Exception):
    """An event that the rules don't allow."""


def _document(kind: str) -> dict:
    return {"captures": {}, "results": {}, "submissions": 0, "attempts": 0, "side_attempts": {}, "technical": {}, "facts": None, "status": "pending", "confirmed": False, "conflict": False}


def new_state() -> dict:
    return {"status": None, "reason": None, "version": 0, "expires": 0, "policy": None, "documents": {}, "seen": Marks(), "rejected": 0, "error": None, "cross_conflict": False}


def _touch(s: dict, status: str, now: int) -> None:
    s["status"], s["expires"], s["version"] = status, now + IDLE_MS, s["version"] + 1


def _order(s: dict) -> list[str]:
    policy = _POLICY[s["policy"]]
    return [k for k in (policy["documents"] if policy["selection"] == "all" else dims.KINDS) if k in s["documents"]]


def current_kind(s: dict) -> str | None:
    return next((k for k in _order(s) if not s["documents"][k]["confirmed"]), None) if s["policy"] else None


def _need(condition: bool, code: str) -> None:
    if not condition:
        raise Refused(code)


def _fail(s: dict, d: dict, reason: str, now: int) -> None:
    d["status"], s["reason"] = "failed", reason
    _touch(s, "document_failed", now)


def _expire(s: dict, now: int) -> None:
    if s["status"] and s["status"] != "processing" and s["status"] not in dims.FINAL and now >= s["expires"]:
        _touch(s, "expired", now)
        s["reason"] = "session_expired"


def _create(s: dict, e: dict, now: int) -> None:
    _need(s["status"] is None, "exists")
    _need(e["kind"] in _POLICY, "unknown_policy")
    policy = _POLICY[e["kind"]]
    s["policy"], s["documents"] = e["kind"], {k: _document(k) for k in policy["documents"]} if policy["selection"] == "all" else {}
    s["status"], s["version"], s["expires"] = "created", 1, now + IDLE_MS


def _select(s: dict, e: dict, now: int) -> None:
    _need(not any(d["attempts"] or d["captures"] for d in s["documents"].values()), "document_selection_locked")
    policy, chosen = _POLICY[s["policy"]], [k for k in (e["kind"] or "").split(",") if k]
    _need(len(set(chosen)) == len(chosen) and set(chosen) <= set(policy["documents"]), "invalid_document_selection")
    _need(len(chosen) == len(policy["documents"]) if policy["selection"] == "all" else len(chosen) >= policy["least"], "invalid_document_selection")
    s["documents"] = {k: _document(k) for k in chosen}
    _touch(s, "capturing", now)


def _chosen(s: dict, e: dict) -> dict:
    _need(e["kind"] in s["documents"], "document_not_selected")
    return s["documents"][e["kind"]]


def _capture(s: dict, e: dict, now: int) -> None:
    d = _chosen(s, e)
    _need(current_kind(s) in (None, e["kind"]), "document_locked")
    _need(e["side"] in dims.SIDES[e["kind"]], "invalid_side")
    _need(e["side"] not in d["captures"] and d["status"] not in ("incomplete", "ready"), "document_not_capturable")
    d["submissions"] += 1
    if d["submissions"] > dims.MAX_SUBMISSIONS:
        _fail(s, d, "submission_limit_reached", now)
        raise Refused("submission_limit_reached")
    if not e["ok"]:
        d["status"] = "processing" if any(v != "ready" for v in d["results"].values()) else "capturing"
        _touch(s, d["status"], now)
        raise Refused("quality_rejected")
    d["captures"][e["side"]], d["results"][e["side"]] = e["capture_id"], "pending"
    d["technical"].pop(e["side"], None)
    d["confirmed"], d["conflict"], d["status"], s["reason"] = False, False, "processing", None
    _touch(s, "processing", now)


def _stage(s: dict, e: dict, now: int) -> None:
    d = _chosen(s, e)
    if d["status"] == "processing":  # progress doesn't extend the session
        s["status"], s["version"] = "processing", s["version"] + 1


def _ocr(s: dict, e: dict, now: int) -> None:
    d = _chosen(s, e)
    # results of a photo that was replaced meanwhile are dropped
    _need(e["side"] is None or d["captures"].get(e["side"]) == e["capture_id"], "stale_result")
    if e["side"] is not None:
        d["results"][e["side"]] = "ready"
        d["side_attempts"][e["side"]] = d["side_attempts"].get(e["side"], 0) + 1
        if any(d["results"].get(x) != "ready" for x in dims.SIDES[e["kind"]]):
            s["version"] += 1
            return
    d["attempts"] += 1
    if e.get("facts"):
        d["facts"] = json.loads(e["facts"])
        s["cross_conflict"] = bool(implicated(s))
    if e["type"] == "fatal":
        _fail(s, d, "document_rejected", now)
    elif not e["ok"]:
        d["status"] = "incomplete"
        if d["attempts"] >= dims.MAX_ATTEMPTS:
            _fail(s, d, "ocr_attempts_exhausted", now)
        else:
            _touch(s, "awaiting_confirmation", now)
    else:
        d["status"] = "ready"
        _touch(s, "awaiting_confirmation", now)


def _technical(s: dict, e: dict, now: int) -> None:
    """A reading that failed for a technical reason waits to be tried again; the third time ends the session. Neither
    counts as an attempt, and neither extends the session."""
    d = _chosen(s, e)
    _need(e["side"] in d["captures"] and d["captures"][e["side"]] == e["capture_id"], "stale_result")
    d["technical"][e["side"]] = d["technical"].get(e["side"], 0) + 1
    d["results"][e["side"]], s["version"] = "pending", s["version"] + 1
    if d["technical"][e["side"]] >= dims.MAX_ATTEMPTS:
        d["status"], s["status"], s["reason"] = "failed", "technical_failed", "ocr_unavailable"


def _refused(s: dict, e: dict, now: int) -> None:
    """The side must be photographed again; no attempt is used."""
    _need(_chosen(s, e)["captures"].get(e["side"]) == e["capture_id"], "stale_result")
    _retake_side(s, e, now)
    s["reason"] = "document_not_verified"


def edits(a: str, b: str) -> int:
    """Levenshtein distance of two names."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def implicated(s: dict) -> list[tuple[str, str | None]]:
    """(document, side) of the readings in conflict between documents: values that differ, names under the floor."""
    held, out = [(k, s["documents"][k]["facts"] or {}) for k in dims.KINDS if k in s["documents"]], []
    for fact, fuzzy in FACTS:
        known = [(k, *f[fact]) for k, f in held if f.get(fact) and f[fact][0]]
        for i, (k, a, side) in enumerate(known):
            for other, b, other_side in known[i + 1 :]:
                if a != b and not (fuzzy and 1 - edits(a, b) / max(len(a), len(b)) >= dims.NAME_FLOOR):
                    out += [(k, side), (other, other_side)]
    return out


def _cross_conflict(s: dict, readings: list[tuple[str, str | None]], now: int) -> None:
    """A conflict can be resolved while one of its readings has attempts left."""

    def spare(kind: str, side: str | None) -> bool:
        d = s["documents"][kind]
        used = [d["side_attempts"].get(x, 0) for x in ([side] if side else dims.SIDES[kind])]
        return d["attempts"] < dims.MAX_ATTEMPTS and any(n < dims.MAX_ATTEMPTS for n in used)

    s["cross_conflict"], s["reason"] = True, "consistency_mismatch"
    _touch(s, "awaiting_confirmation" if any(spare(*r) for r in readings) else "consistency_failed", now)


def _conflict(s: dict, e: dict, now: int) -> None:
    if e["kind"]:
        _chosen(s, e)["conflict"] = True
    else:
        s["cross_conflict"] = True
    s["reason"] = "consistency_mismatch"
    _touch(s, "awaiting_confirmation" if e["ok"] else "consistency_failed", now)


def _confirm(s: dict, e: dict, now: int) -> None:
    _need(current_kind(s) in (None, e["kind"]), "document_locked")
    d = _chosen(s, e)
    _need(d["status"] == "ready", "document_not_ready")
    _need(not d["conflict"], "consistency_conflict")
    d["confirmed"] = True
    found = implicated(s) if all(x["confirmed"] for x in s["documents"].values()) else []
    if found:
        return _cross_conflict(s, found, now)
    _touch(s, "awaiting_submission" if all(x["confirmed"] for x in s["documents"].values()) and not s["cross_conflict"] else "capturing", now)


def _exhausted(s: dict, d: dict, now: int) -> None:
    _need(not (s["cross_conflict"] or d["conflict"]), "ocr_attempts_exhausted")
    _fail(s, d, "ocr_attempts_exhausted", now)


def _retake(s: dict, e: dict, now: int) -> None:
    d = _chosen(s, e)
    if d["attempts"] >= dims.MAX_ATTEMPTS or any(n >= dims.MAX_ATTEMPTS for n in d["side_attempts"].values()):
        return _exhausted(s, d, now)
    s["documents"][e["kind"]] = _document(e["kind"]) | {k: d[k] for k in ("submissions", "attempts", "side_attempts")} | {"status": "capturing"}
    s["reason"], s["cross_conflict"] = None, bool(implicated(s))
    _touch(s, "capturing", now)


def _retake_side(s: dict, e: dict, now: int) -> None:
    d = _chosen(s, e)
    _need(e["side"] in dims.SIDES[e["kind"]], "invalid_side")
    if d["attempts"] >= dims.MAX_ATTEMPTS or d["side_attempts"].get(e["side"], 0) >= dims.MAX_ATTEMPTS:
        return _exhausted(s, d, now)
    d["captures"].pop(e["side"], None)
    d["results"].pop(e["side"], None)
    d["confirmed"], d["conflict"], d["facts"], d["status"] = False, False, None, "capturing"
    s["reason"], s["cross_conflict"] = None, bool(implicated(s))
    _touch(s, "capturing", now)


def _submit(s: dict, e: dict, now: int) -> None:
    _need(s["status"] == "awaiting_submission", "session_not_ready")
    found = implicated(s)
    if found:
        _cross_conflict(s, found, now)
        raise Refused("consistency_conflict")
    if not e["ok"]:
        s["cross_conflict"], s["reason"] = True, "consistency_mismatch"
        _touch(s, "awaiting_confirmation", now)
        raise Refused("consistency_conflict")
    _touch(s, "succeeded", now)


RULES = {"create": _create, "select": _select, "capture": _capture, "stage": _stage, "ocr": _ocr, "fatal": _ocr, "technical": _technical, "refused": _refused, "conflict": _conflict, "confirm": _confirm, "retake": _retake, "retake_side": _retake_side, "submit": _submit, "pair": lambda s, e, now: None, "tick": lambda s, e, now: None}
#: Events that only an active session takes.
ACTIVE = {"select", "capture", "ocr", "fatal", "technical", "refused", "confirm", "retake", "retake_side", "submit"}


def step(s: dict, e: dict) -> dict:
    """The state after one event (``s`` is changed in place)."""
    now = e["at_ms"]
    try:
        _need(e["type"] in RULES, "unknown_event")
        _need(e["type"] == "create" or s["status"] is not None, "unknown_session")
        if e["type"] != "create":
            _expire(s, now)
        if e["mutation_key"] is not None and s["seen"].live(e["mutation_key"], now):
            return s
        _need(e["type"] not in ACTIVE or s["status"] not in dims.FINAL, "session_closed")
        RULES[e["type"]](s, e, now)
        if e["mutation_key"] is not None:
            s["seen"].put(e["mutation_key"], now + KEPT_MS)
    except Refused as refusal:
        s["rejected"], s["error"] = s["rejected"] + 1, str(refusal)
    return s


def view(session_id: str, s: dict) -> tuple:
    return session_id, s["status"], s["reason"], s["version"], s["expires"], current_kind(s), sum(d["confirmed"] for d in s["documents"].values()), s["rejected"], s["error"]


def typed_events(events: DataFrame) -> DataFrame:
    """The columns of events with their types; ``facts`` is null where it isn't there."""
    kinds = {"seq": "long", "ok": "boolean", "at_ms": "long"}
    column = lambda c: F.col(c) if c in events.columns else F.lit(None)
    return events.where("session_id IS NOT NULL").select(*[column(c).cast(kinds.get(c, "string")).alias(c) for c in FIELDS])


def fold(events: DataFrame, partitions: int | None = None) -> DataFrame:
    """The last state of every session. Events are dealt out by session and sorted within tasks, then read once as a
    stream: a task holds one session's state at a time, however many events it has. Ties of ``seq`` go by time and type.
    """
    spark = events.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    typed = typed_events(events)
    dealt = typed.repartition(n, "session_id").sortWithinPartitions("session_id", "seq", "at_ms", "type")
    names = [x.split()[0] for x in OUTPUT.split(", ")]

    def run(batches):
        current, state = None, None
        for batch in batches:
            out = []
            for e in batch.to_pylist():
                if e["session_id"] != current:
                    if current is not None:
                        out.append(view(current, state))
                    current, state = e["session_id"], new_state()
                step(state, e)
            yield _batch(out, names)
        if current is not None:
            yield _batch([view(current, state)], names)

    return dealt.mapInArrow(run, OUTPUT)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def dump(s: dict) -> str:
    """The state as a text, without the mutation keys, which are kept by themselves."""
    return json.dumps({k: v for k, v in s.items() if k != "seen"}, separators=(",", ":"))
