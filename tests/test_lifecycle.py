import json
import random

from pyspark.sql import functions as F

from idloom import dims
from idloom.operators import lifecycle as L
from idloom.sources import files
from idloom.streaming.lifecycle import fold_stream, latest_telemetry, once_per_key

SCHEMA = "session_id string, seq long, type string, kind string, side string, capture_id string, mutation_key string, ok boolean, at_ms long"
MINUTE = 60_000


def play(*events, gap=MINUTE):
    s = L.new_state()
    for i, e in enumerate(events):
        L.step(s, dict.fromkeys(L.COLUMNS) | {"at_ms": i * gap, "ok": True} | e)
    return s


def card(side, capture="c", **more):
    return {"type": "capture", "kind": "dz-id", "side": side, "capture_id": capture} | more


def read(side, capture="c", **more):
    return {"type": "ocr", "kind": "dz-id", "side": side, "capture_id": capture} | more


CREATE = {"type": "create", "kind": "id-only"}
CONFIRM, SUBMIT = {"type": "confirm", "kind": "dz-id"}, {"type": "submit"}
BOTH = [CREATE, card("front", "f"), card("back", "b"), read("front", "f"), read("back", "b")]


def test_a_whole_journey():
    s = play(*BOTH, CONFIRM, SUBMIT)
    assert (s["status"], s["rejected"]) == ("succeeded", 0)
    assert play(*BOTH)["documents"]["dz-id"]["status"] == "ready"
    assert play(*BOTH, CONFIRM)["status"] == "awaiting_submission"


def test_order_and_admission():
    s = play({"type": "create", "kind": "id-and-passport"}, {"type": "capture", "kind": "dz-passport", "side": "single", "capture_id": "x"})
    assert s["error"] == "document_locked"
    assert play(CREATE, card("single"))["error"] == "invalid_side"
    assert play(CREATE, card("front"), card("front", "again"))["error"] == "document_not_capturable"
    assert play(CREATE, CONFIRM)["error"] == "document_not_ready"
    assert play(CREATE, SUBMIT)["error"] == "session_not_ready"
    assert play(card("front"))["error"] == "unknown_session"
    assert play({"type": "create", "kind": "nothing"})["error"] == "unknown_policy"


def test_selection():
    two = {"type": "create", "kind": "two-of-three"}
    assert play(two, {"type": "select", "kind": "dz-id"})["error"] == "invalid_document_selection"
    assert play(two, {"type": "select", "kind": "dz-id,dz-id"})["error"] == "invalid_document_selection"
    s = play(two, {"type": "select", "kind": "dz-passport,dz-id"})
    assert L.current_kind(s) == "dz-id" and s["status"] == "capturing"
    s = play(two, {"type": "select", "kind": "dz-passport,dz-id"}, card("front"), {"type": "select", "kind": "dz-id,dz-passport"})
    assert s["error"] == "document_selection_locked"


def test_limits():
    bad = [card("front", str(i), ok=False) for i in range(11)]
    s = play(CREATE, *bad)
    assert (s["status"], s["reason"]) == ("document_failed", "submission_limit_reached")
    assert play(CREATE, *bad[:10])["status"] == "capturing"
    passport = {"type": "create", "kind": "passport-only"}
    turn = lambda i: [{"type": "capture", "kind": "dz-passport", "side": "single", "capture_id": str(i)}, {"type": "ocr", "kind": "dz-passport", "side": "single", "capture_id": str(i), "ok": False}, {"type": "retake", "kind": "dz-passport"}]
    s = play(passport, *turn(1), *turn(2), *turn(3))
    assert (s["status"], s["reason"]) == ("document_failed", "ocr_attempts_exhausted")


def test_retaking_one_side_keeps_the_other():
    s = play(*BOTH, {"type": "retake_side", "kind": "dz-id", "side": "front"})
    d = s["documents"]["dz-id"]
    assert d["captures"] == {"back": "b"} and d["results"] == {"back": "ready"} and s["status"] == "capturing"
    s = play(*BOTH, {"type": "retake_side", "kind": "dz-id", "side": "front"}, card("front", "f2"), read("front", "f"), read("front", "f2"))
    assert s["error"] == "stale_result" and s["documents"]["dz-id"]["status"] == "ready"
    assert play(*BOTH, {"type": "retake", "kind": "dz-id"})["documents"]["dz-id"]["captures"] == {}


def test_conflicts():
    clash = {"type": "conflict", "kind": "dz-id"}
    assert play(*BOTH, clash, CONFIRM)["error"] == "consistency_conflict"
    assert play(*BOTH, clash | {"ok": False})["status"] == "consistency_failed"
    s = play(*BOTH, CONFIRM, SUBMIT | {"ok": False})
    assert (s["status"], s["reason"]) == ("awaiting_confirmation", "consistency_mismatch")


def test_inactivity():
    late = {"type": "tick", "at_ms": 30 * MINUTE}
    assert play(CREATE, late)["status"] == "expired" and play(CREATE, late)["reason"] == "session_expired"
    assert play(CREATE, late | {"at_ms": 30 * MINUTE - 1})["status"] == "created"
    assert play(CREATE, card("front"), late | {"at_ms": 99 * MINUTE})["status"] == "processing"
    assert play(CREATE, {"type": "pair", "at_ms": 29 * MINUTE}, late)["status"] == "expired"  # pairing doesn't extend
    assert play(CREATE, late, card("front"), gap=31 * MINUTE)["error"] == "session_closed"


def test_replayed_mutations_change_nothing():
    once, twice = play(*BOTH, CONFIRM | {"mutation_key": "k"}), play(*BOTH, CONFIRM | {"mutation_key": "k"}, CONFIRM | {"mutation_key": "k"})
    assert once["version"] == twice["version"] and twice["rejected"] == 0
    failed = play(CREATE, CONFIRM | {"mutation_key": "k"}, CONFIRM | {"mutation_key": "k"})
    assert failed["rejected"] == 2  # only a success is remembered


def random_events(n=40, seed=3):
    rng, out = random.Random(seed), []
    for s in range(n):
        policy = rng.choice([p[0] for p in dims.POLICIES])
        out.append((f"s{s}", 0, "create", policy, None, None, None, True, 0))
        at = 0
        for i in range(1, rng.randint(2, 60)):
            at += rng.choice([1, 1, 1, 5, 31]) * MINUTE
            kind = rng.choice(dims.KINDS)
            kind_of = rng.choice(["capture", "capture", "capture", "ocr", "ocr", "ocr", "confirm", "retake_side", "stage", "submit", "tick", "conflict", "select"])
            out.append((f"s{s}", i, kind_of, "dz-id,dz-passport" if kind_of == "select" else kind, rng.choice(dims.SIDES[kind]), rng.choice("ab"), f"m{rng.randrange(i + 1)}" if rng.random() < 0.3 else None, rng.random() < 0.8, at))
    return out


def expected(events):
    states = {}
    for e in sorted(events, key=lambda e: (e[0], e[1])):
        L.step(states.setdefault(e[0], L.new_state()), dict(zip(L.COLUMNS, e, strict=True)))
    return sorted(L.view(k, s) for k, s in states.items())


def key(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_fold_equals_a_loop_for_any_partitioning(spark):
    events = random_events()
    shuffled = events[:]
    random.Random(1).shuffle(shuffled)
    for n in (1, 5):
        got = L.fold(spark.createDataFrame(shuffled + [(None, 1, "tick", None, None, None, None, True, 1)], SCHEMA), n).collect()
        assert key(got) == key(expected(events))
    assert L.fold(spark.createDataFrame([], SCHEMA)).count() == 0


def tech(side, capture="c"):
    return {"type": "technical", "kind": "dz-id", "side": side, "capture_id": capture}


def test_technical_failures_use_no_attempt():
    s = play(CREATE, card("front", "f"), card("back", "b"), read("back", "b"), tech("front", "f"), tech("front", "f"), read("front", "f"))
    d = s["documents"]["dz-id"]
    assert (d["status"], d["attempts"], d["side_attempts"], d["technical"]) == ("ready", 1, {"back": 1, "front": 1}, {"front": 2})
    s = play(CREATE, card("front", "f"), *[tech("front", "f")] * 3)
    assert (s["status"], s["reason"], s["documents"]["dz-id"]["attempts"]) == ("technical_failed", "ocr_unavailable", 0)
    assert play(CREATE, card("front", "f"), *[tech("front", "f")] * 3, card("back"))["error"] == "session_closed"
    # another photo's failures aren't this one's, and a replaced photo can't fail its replacement
    s = play(CREATE, card("front", "f"), tech("front", "f"), tech("front", "f"), {"type": "retake_side", "kind": "dz-id", "side": "front"}, card("front", "g"), tech("front", "g"))
    assert s["status"] == "processing" and s["documents"]["dz-id"]["technical"] == {"front": 1}
    assert play(CREATE, card("front", "f"), tech("front", "old"))["error"] == "stale_result"
    expires = play(CREATE, card("front", "f"))["expires"]
    assert play(CREATE, card("front", "f"), tech("front", "f"))["expires"] == expires


def test_a_refused_side_is_photographed_again():
    s = play(CREATE, card("front", "f"), card("back", "b"), read("back", "b"), {"type": "refused", "kind": "dz-id", "side": "front", "capture_id": "f"})
    d = s["documents"]["dz-id"]
    assert (s["status"], s["reason"], list(d["captures"]), d["attempts"]) == ("capturing", "document_not_verified", ["back"], 0)


def reading(kind, facts, ok=True):
    return {"type": "ocr", "kind": kind, "ok": ok, "facts": json.dumps({k: [v, None] for k, v in facts.items()})}


SAME = {"nin": "109", "dateOfBirth": "1990-02-12", "lastNameLatin": "BENALI"}
TWO = [{"type": "create", "kind": "two-of-three"}, {"type": "select", "kind": "dz-id,dz-passport"}]
PASSPORT = {"type": "confirm", "kind": "dz-passport"}


def test_conflicts_between_documents_are_found():
    other = SAME | {"dateOfBirth": "1991-02-12"}
    clash = [*TWO, reading("dz-id", SAME), CONFIRM, reading("dz-passport", other), PASSPORT]
    s = play(*clash)
    assert (s["status"], s["reason"], s["cross_conflict"]) == ("awaiting_confirmation", "consistency_mismatch", True)
    assert all(d["confirmed"] for d in s["documents"].values()) and play(*clash, SUBMIT)["error"] == "session_not_ready"
    again = [*clash, {"type": "retake_side", "kind": "dz-id", "side": "back"}]
    assert play(*again)["cross_conflict"] is False and play(*again)["documents"]["dz-passport"]["facts"]["dateOfBirth"][0] == "1991-02-12"
    assert play(*again, reading("dz-id", other), CONFIRM)["status"] == "awaiting_submission"
    assert play(*again, reading("dz-id", other), CONFIRM, SUBMIT)["status"] == "succeeded"
    # a close spelling only warns, a name in another script isn't compared
    assert play(*TWO, reading("dz-id", SAME), CONFIRM, reading("dz-passport", SAME | {"lastNameLatin": "BENALLI"}), PASSPORT)["status"] == "awaiting_submission"
    assert play(*TWO, reading("dz-id", SAME), CONFIRM, reading("dz-passport", {"nin": "109"}), PASSPORT)["status"] == "awaiting_submission"
    assert play(*TWO, reading("dz-id", SAME), CONFIRM, reading("dz-passport", SAME | {"lastNameLatin": "SMITH"}), PASSPORT)["status"] == "awaiting_confirmation"


def test_consistency_closes_after_the_last_attempt():
    other = SAME | {"nin": "7"}
    three = [e for _ in range(2) for e in (reading("dz-id", SAME, ok=False), {"type": "retake_side", "kind": "dz-id", "side": "back"})]
    start = [*TWO, *three, reading("dz-id", SAME), CONFIRM, reading("dz-passport", other), PASSPORT]
    s = play(*start)
    assert s["documents"]["dz-id"]["attempts"] == 3 and s["status"] == "awaiting_confirmation"
    stuck = play(*start, {"type": "retake_side", "kind": "dz-id", "side": "front"})
    assert (stuck["error"], stuck["status"]) == ("ocr_attempts_exhausted", "awaiting_confirmation")
    more = [e for _ in range(2) for e in ({"type": "retake_side", "kind": "dz-passport", "side": "single"}, reading("dz-passport", other), PASSPORT)]
    s = play(*start, *more)
    assert (s["status"], s["reason"]) == ("consistency_failed", "consistency_mismatch")


def test_facts_of_readings_feed_the_fold(spark):
    from idloom.operators import linkage

    rows = [("s", "dz-id", "nin", " 12-3 ", "back"), ("s", "dz-id", "surname_latin", "Bénali", "front"), ("s", "dz-passport", "personal_number", "124", "single"), ("s", "dz-passport", "surname_latin", "علي", "single"), ("s", "dz-passport", "sex", "M", "single")]
    facts = {r["kind"]: r["facts"] for r in linkage.session_facts(spark.createDataFrame(rows, "session_id string, kind string, field string, value string, side string"), "session_id", "kind").collect()}
    assert {k: json.loads(v) for k, v in facts.items()} == {"dz-id": {"nin": ["123", "back"], "lastNameLatin": ["BENALI", "front"]}, "dz-passport": {"nin": ["124", "single"]}}
    events = [("create", "two-of-three", None), ("select", "dz-id,dz-passport", None), ("ocr", "dz-id", facts["dz-id"]), ("confirm", "dz-id", None), ("ocr", "dz-passport", facts["dz-passport"]), ("confirm", "dz-passport", None)]
    rows = [("s", i, t, k, None, None, None, True, i * MINUTE, f) for i, (t, k, f) in enumerate(events)]
    r = L.fold(spark.createDataFrame(rows, SCHEMA + ", facts string")).first()
    assert (r["status"], r["reason_code"]) == ("awaiting_confirmation", "consistency_mismatch")


def test_state_of_final_sessions_is_removed(spark, tmp_path, monkeypatch):
    """After the time that sessions are kept for, a final session is forgotten, and its next event is of an unknown one."""
    from idloom.streaming import lifecycle as stream_module

    monkeypatch.setattr(stream_module, "KEPT_MS", 60 * MINUTE)

    def run(rows, i):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        fold_stream(stream, late="1 minute").writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").foreachBatch(lambda b, n: b.withColumn("part", F.lit(i)).write.mode("append").parquet(f"{tmp_path}/out")).start().awaitTermination()

    day = 1_700_000_000_000
    at = lambda s, i, t, minutes, **more: tuple((dict.fromkeys(SCHEMA.split()[::2]) | {"session_id": s, "seq": i, "type": t, "kind": "passport-only" if t == "create" else "dz-passport", "ok": True, "at_ms": day + minutes * MINUTE} | more).values())
    done = [at("done", 0, "create", 0), at("done", 1, "ocr", 1), at("done", 2, "confirm", 2), at("done", 3, "submit", 3)]
    run(done, 0)
    for i, minutes in enumerate((200, 300, 400), 1):
        run([at(f"other{i}", 0, "create", minutes)], i)
    run([at("done", 4, "tick", 401)], 4)
    rows = [(r["part"], r["status"], r["last_error"]) for r in spark.read.parquet(f"{tmp_path}/out").where("session_id = 'done'").collect()]
    assert (0, "succeeded", None) in rows and (4, None, "unknown_session") in rows and not [r for r in rows if r[0] in (1, 2, 3)]


def test_stream_equals_fold(spark, tmp_path):
    events = random_events(25, 4)
    for part in range(3):
        rows = [e for e in events if e[1] % 3 == part or (part == 2 and e[1] >= 1000)]
        del rows
    cut = [[e for e in events if e[1] < 15], [e for e in events if 15 <= e[1] < 30], [e for e in events if e[1] >= 30]]
    for i, part in enumerate(cut):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        fold_stream(stream, timers=False).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").foreachBatch(lambda b, n, i=i: b.withColumn("part", F.lit(i)).write.mode("append").parquet(f"{tmp_path}/out")).start().awaitTermination()
    out = {}
    for r in sorted(spark.read.parquet(f"{tmp_path}/out").collect(), key=lambda r: r["part"]):
        out[r["session_id"]] = tuple(r)[:-1]
    assert key(out.values()) == key(expected(events))


def test_a_timer_expires_an_idle_session(spark, tmp_path):
    def run(rows, i):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        fold_stream(stream, late="1 minute").writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").foreachBatch(lambda b, n: b.withColumn("part", F.lit(i)).write.mode("append").parquet(f"{tmp_path}/out")).start().awaitTermination()

    day = 1_700_000_000_000
    run([("idle", 0, "create", "id-only", None, None, None, True, day)], 0)
    run([("other", 0, "create", "id-only", None, None, None, True, day + 90 * MINUTE)], 1)
    run([("third", 0, "create", "id-only", None, None, None, True, day + 95 * MINUTE)], 2)
    states = {(r["session_id"], r["status"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert ("idle", "created") in states and ("idle", "expired") in states and ("third", "expired") not in states


def test_queue_and_telemetry_streams(spark, tmp_path):
    rows = [(f"k{i % 3}", 1_700_000_000 + i, float(i)) for i in range(50)]
    spark.createDataFrame(rows, "k string, s long, value double").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, s long, value double").parquet(f"{tmp_path}/in").withColumn("ts", F.timestamp_seconds("s"))

    def run(df, mode, name):
        df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}-state").foreachBatch(lambda b, n: b.write.mode("append").parquet(f"{tmp_path}/{name}")).start().awaitTermination()
        return spark.read.parquet(f"{tmp_path}/{name}").collect()

    assert len(run(once_per_key(stream, ["k"], "ts"), "append", "once")) == 3
    got = {r["key"]: (r["samples"], r["mean"]) for r in run(latest_telemetry(stream, "k", "ts", n=5), "update", "last")}
    for k in range(3):
        last = [float(i) for i in range(50) if i % 3 == k][-5:]
        assert got[f"k{k}"] == (5, sum(last) / 5)


# ---------------------------------------------------------------- sources


def test_templates(spark, tmp_path):
    for folder, version in (("saved", 2), ("bundled", 1)):
        (tmp_path / folder).mkdir()
        names = ["dz-id-front", "dz-id-back"] if folder == "bundled" else ["dz-id-front"]
        for n in names:
            (tmp_path / folder / f"{n}.json").write_text(json.dumps({"id": n, "document_kind": "dz-id", "version": version, "zones": [{"id": "z"}], "ignored": [], "updated_at": f"2026-0{version}"}))
    rows = files.templates(spark, f"{tmp_path}/saved", f"{tmp_path}/bundled")
    assert {r["id"]: r["version"] for r in rows.collect()} == {"dz-id-front": 2, "dz-id-back": 1}
    assert files.variants(rows, "dz-id").count() == 2 and files.variants(rows, "dz").count() == 2 and files.variants(rows, "dz-i").count() == 0
    assert [r["id"] for r in files.template_list(rows).collect()] == ["dz-id-front", "dz-id-back"]


def test_exports(spark, tmp_path):
    good = {"id": "dz-id-front", "width": 9, "height": 9, "descriptors": {"rows": 2, "cols": 2, "data": [0, 1, 254, 255]}, "keypoints": [{"x": 1.0, "y": 2.0}, {"x": 3.0, "y": 4.0}], "zones": [{"id": "a", "x": 0.0, "y": 0.0, "w": 0.5, "h": 0.5}]}
    bad = good | {"id": "dz-passport-single", "descriptors": {"rows": 2, "cols": 2, "data": [0, 1, 300]}, "zones": good["zones"] * 2 + [{"id": "b", "x": 0.9, "y": 0.0, "w": 0.5, "h": 0.5}]}
    (tmp_path / "e.json").write_text(json.dumps(good) + "\n" + json.dumps(bad))
    exports = spark.read.schema(files.EXPORT).json(f"{tmp_path}/e.json")
    got = {r["document_kind"]: r["problems"] for r in files.import_exports(exports).collect()}
    assert got == {"dz-id": [], "dz-passport": ["descriptor_size", "byte_range", "zone_bounds", "zone_names"]}
    assert [(r["idx"], bytes(r["descriptor"])) for r in files.descriptors(exports).orderBy("idx").collect()] == [(0, b"\x00\x01"), (1, b"\xfe\xff")]


def test_manifest_profile_and_objects(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"id": "a", "expected": "accept", "fields": {"nin": "1"}}, {"id": "a", "expected": "reject"}, {"id": "b", "expected": "reject"}]))
    cases, twice = files.benchmark_manifest(spark, f"{tmp_path}/m.json")
    assert cases.count() == 3 and [r["id"] for r in twice.collect()] == ["a"]
    one = lambda v: spark.createDataFrame([(v,)], "mode string")
    assert files.ranked_profile(one("saved").where("false"), None, one("shipped")).first()["mode"] == "shipped"
    (tmp_path / "objects").mkdir()
    (tmp_path / "objects" / "x.png").write_bytes(b"abc")
    r = files.images(spark, f"{tmp_path}/objects").first()
    assert r["name"] == "x.png" and bytes(r["bytes"]) == b"abc"
    files.write_json(one("x"), f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").first()["mode"] == "x"


def test_saved_over_bundled_and_refusals(spark, tmp_path):
    from idloom.plans.photo_queries import _profile

    ids = lambda *names: spark.createDataFrame([(n,) for n in names], "id string")
    left, refused = files.delete_templates(ids("a", "b"), ids("b", "c"), ids("a", "b", "c", "d"))
    assert left.count() == 0 and [r["id"] for r in refused.collect()] == ["c"]
    for folder, data in (("one", b"first"), ("two", b"second")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.png").write_bytes(data)
    (tmp_path / "two" / "y.png").write_bytes(b"\x89PNG\r\n\x1a\n....")
    objects = files.images(spark, f"{tmp_path}/one", f"{tmp_path}/two")
    assert {r["name"]: bytes(r["bytes"])[:5] for r in objects.collect()} == {"x.png": b"first", "y.png": b"\x89PNG\r"}
    assert files.require_object(objects, "x.png").first()["name"] == "x.png"
    import pytest

    with pytest.raises(Exception, match="no object z"):
        files.require_object(objects, "z").collect()
    kinds = {r["name"]: r["t"] for r in objects.select("name", files.media_type(F.col("bytes")).alias("t")).collect()}
    assert kinds == {"x.png": None, "y.png": "image/png"}
    good = _profile()
    one = lambda p: spark.createDataFrame([(json.dumps(p),)], "profile string")
    files.save_profile(one(good), f"{tmp_path}/profile")
    with pytest.raises(ValueError, match="image.maxNoise"):
        files.save_profile(one(good | {"image": good["image"] | {"maxNoise": -1}}), f"{tmp_path}/profile")
    files.save_profile(one(good | {"mode": "enforce"}), f"{tmp_path}/profile")
    assert json.loads(spark.read.parquet(f"{tmp_path}/profile").first()["profile"])["mode"] == "enforce"


def test_exports_are_read_as_first_versions(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.json").write_text(json.dumps({"id": "dz-id-front", "width": 9, "height": 9, "zones": []}))
    r = files.templates(spark, f"{tmp_path}/t").first()
    assert (r["document_kind"], r["version"]) == ("dz-id", 1)
