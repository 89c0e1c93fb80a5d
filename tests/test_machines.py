import random

import pytest
from pyspark.sql import functions as F

from idloom.operators import linkage, machines, sweeps
from idloom.operators.machines import EVENT, OUTPUT, ROW
from idloom.streaming.machines import run_machine

SECOND, MINUTE, DAY = 1000, 60_000, 86_400_000
T0 = 1_700_000_000_000


def ev(key, type_, id_, at, ref=None, attempt=None, seq=0):
    return (key, seq, type_, id_, ref, attempt, at)


def batch(spark, events, machine, **options):
    return sorted((tuple(r) for r in machines.replay(spark.createDataFrame(events, EVENT), machine, **options).collect()), key=str)


def stream(spark, path, parts, machine, late="1 minute", flush=True):
    """Rows and the last state size of a stream over ``parts``, one run for each; then two runs that move the watermark on."""
    far = max((e[-1] for p in parts for e in p), default=T0) + 40 * DAY
    parts = parts + ([[ev("flush|x", "other", f"f{i}", far + i * DAY)] for i in range(2)] if flush else [])
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{path}/in")
        source = spark.readStream.schema(EVENT).parquet(f"{path}/in")
        query = run_machine(source, machine, late).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{path}/state").foreachBatch(lambda b, n, i=i: b.write.mode("overwrite").parquet(f"{path}/out/{i}-{n}")).start()
        query.awaitTermination()
    rows = spark.read.schema(OUTPUT).parquet(f"{path}/out/*").where("key <> 'flush|x'").collect()
    kept = sum(o["numRowsTotal"] for o in query.lastProgress["stateOperators"])
    return sorted((tuple(r) for r in rows), key=str), kept


def parted(events, n):
    """Events cut into ``n`` runs of time."""
    events = sorted(events, key=lambda e: (e[-1], e[1], e[2], e[3]))
    size = -(-len(events) // n)
    return [events[i : i + size] for i in range(0, len(events), size)]


# ---------------------------------------------------------------- jobs


def test_tries_equal_the_schedule(spark):
    """Where every try fails at once, tries come at the times of the schedule; where none answers, each waits for its end."""
    for queue, backoff, delay, retries, expire in (("extraction", False, 5_000, 3, 240_000), ("webhook", True, 15_000, 8, 600_000)):
        rows = batch(spark, [ev(f"{queue}|s", "send", "j", T0)], machines.Jobs())
        runs = sorted(r[4] for r in rows if r[5] == "run")
        sent = spark.createDataFrame([(T0,)], "t long")
        plan = sorted(r["not_before_ms"] for r in sweeps.retry_schedule(sent, "t", retries + 1, delay, backoff).collect())
        assert runs == [at + expire * i for i, at in enumerate(plan)]
        assert [r[5] for r in rows].count("dead") == 1 and len(runs) == retries + 1
    events, at = [ev("webhook|s", "send", "j", T0)], T0
    for n in range(1, 10):
        events.append(ev("webhook|s", "fail", "j", at, attempt=n, seq=1))
        at += 15_000 * 2 ** (n - 1)
    rows = batch(spark, events, machines.Jobs())
    plan = sorted(r["not_before_ms"] for r in sweeps.retry_schedule(spark.createDataFrame([(T0,)], "t long"), "t", 9, 15_000, True).collect())
    assert sorted(r[4] for r in rows if r[5] == "run") == plan and [r[5] for r in rows].count("dead") == 1


def test_job_rules(spark):
    k = "extraction|s"
    events = [
        ev(k, "send", "a", T0), ev(k, "send", "b", T0 + 1), ev(k, "send", "a", T0 + 2), ev(k, "fail", "a", T0 + 3, attempt=2), ev(k, "fail", "a", T0 + 4, attempt=1), ev(k, "fail", "a", T0 + 5, attempt=1),
        ev(k, "ok", "a", T0 + 6_000, attempt=2), ev(k, "ok", "a", T0 + 6_001, attempt=2), ev(k, "send", "a", T0 + 7_000), ev(k, "send", "c", T0 + 8_000), ev("nowhere|s", "send", "a", T0), ev(k, "ponder", "a", T0 + 9_000),
        (None, 0, "send", "a", None, None, T0), (k, 0, "send", "x", None, None, None),
    ]
    got = [(r[2], r[5]) for r in sorted(batch(spark, events, machines.Jobs(), until_ms=T0 + 9_000), key=lambda r: r[4]) if r[0] == k]
    assert got == [("a", "run"), ("b", "duplicate"), ("a", "replayed"), ("a", "stale"), ("a", "retry"), ("a", "stale"), ("a", "run"), ("a", "completed"), ("a", "stale"), ("a", "replayed"), ("c", "run"), ("a", "refused")]
    assert batch(spark, [], machines.Jobs()) == []


def random_jobs(rng, keys=12):
    out = []
    for k in range(keys):
        key, at = f"{rng.choice(['extraction', 'webhook'])}|{k}", T0 + rng.randint(0, 600) * SECOND
        for j in range(rng.randint(1, 4)):
            out.append(ev(key, "send", f"j{j}", at))
            for n in range(1, rng.randint(1, 6)):
                at += rng.randint(1, 300) * SECOND
                out.append(ev(key, rng.choice(["fail", "fail", "ok", "send"]), f"j{j}", at, attempt=rng.choice([n, n, None])))
            at += rng.randint(0, 1200) * SECOND
    return out


def test_consumer_equals_replay_with_repeated_and_lost_batches(spark, tmp_path):
    events = random_jobs(random.Random(1))
    want = batch(spark, events, machines.Jobs())
    parts = parted(events, 3)
    got, kept = stream(spark, tmp_path / "plain", parts, machines.Jobs())
    assert got == want
    # events that arrive again start nothing: they are stale, replayed or duplicate
    parts = [parts[0], parts[1] + parts[1], parts[2]]
    got, _ = stream(spark, tmp_path / "again", parts, machines.Jobs())
    told = lambda rows: [r for r in rows if r[5] not in ("stale", "replayed", "duplicate")]
    assert told(got) == told(want)


# ---------------------------------------------------------------- marks with a life of their own


def test_replays_change_nothing_within_their_life(spark):
    m = machines.Mutations(kept_ms=10 * MINUTE)
    rows = batch(spark, [ev("s", "use", "m", T0), ev("s", "use", "m", T0 + MINUTE), ev("s", "use", "n", T0 + 2 * MINUTE), ev("s", "use", "m", T0 + 10 * MINUTE), ev("t", "use", "m", T0)], m)
    assert [(r[0], r[4] - T0, r[5]) for r in sorted(rows, key=lambda r: (r[0], r[4]))] == [("s", 0, "accepted"), ("s", MINUTE, "replayed"), ("s", 2 * MINUTE, "accepted"), ("s", 10 * MINUTE, "accepted"), ("t", 0, "accepted")]


def test_state_is_bounded_by_what_is_alive(spark, tmp_path):
    """Over 800 keys in seven hours, each kept for an hour: the stream holds those of the last hours only, and its rows equal
    the replay's."""
    rng = random.Random(2)
    parts = [[ev(f"s{i % 3}", "use", f"m{p}-{rng.randint(0, 80)}", T0 + p * 60 * MINUTE + i * SECOND) for i in range(200)] for p in range(7)]
    m = machines.Mutations(kept_ms=60 * MINUTE)
    got, kept = stream(spark, tmp_path, parts, m, flush=False)
    assert got == batch(spark, [e for p in parts for e in p], m)
    unique = len({(e[0], e[3]) for p in parts for e in p})
    assert unique > 800 and kept < unique / 2


def test_tokens_are_good_once(spark, tmp_path):
    m = machines.Tokens()
    events = [ev("s", "issue", "n1", T0), ev("s", "consume", "n1", T0 + MINUTE), ev("s", "consume", "n1", T0 + MINUTE + 1), ev("s", "issue", "n2", T0), ev("s", "consume", "n2", T0 + 5 * MINUTE), ev("s", "consume", "n3", T0), ev("t", "consume", "n2", T0 + MINUTE), ev("s", "issue", "n4", T0, seq=1), ev("s", "issue", "n4", T0 + 1), ev("s", "lend", "n4", T0 + 2)]
    want = batch(spark, events, m)
    assert sorted((r[0], r[2], r[5]) for r in want if r[1] == "consume") == [("s", "n1", "accepted"), ("s", "n1", "refused"), ("s", "n2", "refused"), ("s", "n3", "refused"), ("t", "n2", "refused")]
    assert stream(spark, tmp_path, parted(events, 3), m)[0] == want


def test_leases(spark, tmp_path):
    m, L = machines.Leases(), 240_000
    events = [
        ev("a", "claim", "c1", T0, "t1"), ev("a", "claim", "c1", T0 + L - 1, "t2"), ev("a", "claim", "c1", T0 + L, "t3"), ev("a", "done", "c1", T0 + L + 1, "t1"), ev("a", "done", "c1", T0 + L + 2, "t3"), ev("a", "claim", "c1", T0 + L + 3, "t4"), ev("a", "claim", "c2", T0 + L + 4, "t5"), ev("a", "done", "c1", T0 + L + 5, "t3"),
        *[e for n in range(4) for e in (ev("b", "claim", "c", T0 + n * 10, f"u{n}"), ev("b", "technical", "c", T0 + n * 10 + 1, f"u{n}"))],
        ev("b", "claim", "d", T0 + 99, "u9"), ev("b", "done", "d", T0 + 31 * DAY, "u9"),
    ]
    want = batch(spark, events, m)
    told = lambda k: [(r[5], r[6]) for r in sorted(want, key=lambda r: r[4]) if r[0] == k]
    assert told("a") == [("granted", "t1"), ("refused", "leased"), ("granted", "t3"), ("refused", "stale_result"), ("ready", "t3"), ("refused", "ready"), ("granted", "t5"), ("refused", "stale_result")]
    assert told("b") == [("granted", "u0"), ("pending", "u0"), ("granted", "u1"), ("pending", "u1"), ("granted", "u2"), ("dead", "u2"), ("refused", "dead"), ("refused", "stale_result"), ("granted", "u9"), ("refused", "stale_result")]
    assert stream(spark, tmp_path, parted(events, 4), m)[0] == want


# ---------------------------------------------------------------- assembly


def random_faces(rng, n=15):
    out = []
    for d in range(n):
        kind = rng.choice(["dz-id", "dz-passport", "dz-driving-licence"])
        sides = machines.dims.SIDES[kind]
        for c in range(rng.randint(1, 5)):
            side, at = rng.choice(sides), T0 + (d * 100 + c * 7) * SECOND
            out.append(ev(f"s{d}|{kind}", "capture", f"c{c}", at, side))
            if rng.random() < 0.8:
                out.append(ev(f"s{d}|{kind}", "ready", f"c{c}", at + rng.randint(1, 20) * SECOND, side))
    return out


def test_faces_are_joined_once_in_any_order_and_batching(spark, tmp_path):
    events = random_faces(random.Random(3))
    m = machines.Assembly()
    want = batch(spark, events, m)
    sets = [(r[0], r[6]) for r in want]
    assert len(sets) == len(set(sets)) > 5 and {r[5] for r in want} == {"joined"}
    for n in (1, 3):
        assert stream(spark, tmp_path / str(n), parted(events, n), m)[0] == want
    # the last set of each document is what the batch operator assembles from the final state
    last = {}
    for e in events:
        if e[2] == "capture":
            last[e[0], e[4]] = max(last.get((e[0], e[4]), (0, "")), (e[6], e[3]))
    ready = {(e[0], e[4], e[3]) for e in events if e[2] == "ready"}
    rows = [(k, k.split("|")[1], side, c, c, "ready" if (k, side, c) in ready else "processing") for (k, side), (_, c) in last.items()]
    sides = spark.createDataFrame(rows, "doc string, kind string, side string, capture_id string, current_capture_id string, state string")
    required = spark.createDataFrame([(k, s) for k, ss in machines.dims.SIDES.items() for s in ss], "kind string, side string")
    assembled = linkage.face_assembly(sides, required, "doc").select("doc", F.array_join("capture_ids", ";").alias("ids"))
    newest = {}
    for r in sorted(want, key=lambda r: r[4]):
        newest[r[0]] = r[6]
    assert {(r["doc"], r["ids"]) for r in assembled.collect()} <= set(newest.items())
    shuffled = [(k, 0, t, i, ref, a, T0) for k, _, t, i, ref, a, _ in events if t == "ready"] + [e for e in events if e[2] == "capture"]
    assert {(r[0], r[6]) for r in batch(spark, shuffled, m)} >= {(r["doc"], r["ids"]) for r in assembled.collect()}


@pytest.mark.parametrize("machine", [machines.Jobs(), machines.Leases(), machines.Tokens(), machines.Mutations(), machines.Assembly()])
def test_any_events_give_rows_whatever_the_partitioning(spark, machine):
    rng = random.Random(4)
    kinds = ["send", "ok", "fail", "claim", "done", "technical", "issue", "consume", "capture", "ready", None, "other"]
    events = [(rng.choice(["extraction|a", "webhook|b", "s|dz-id", "plain", None]), rng.choice([0, 1, None]), rng.choice(kinds), rng.choice(["a", "b", None]), rng.choice(["front", "t", None]), rng.choice([1, 2, None]), rng.choice([None, T0 + rng.randint(0, 10**6)])) for _ in range(400)]
    rows = batch(spark, events, machine)
    assert rows == batch(spark, events, machine, partitions=1) and all(len(r) == len(ROW) for r in rows)
