import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from idloom.operators import assessment, burst, image, windows
from idloom.sources import forms
from idloom.streaming.metrics import Gauges, counted
from tests.test_quality import scene

PNG = b"\x89PNG\r\n\x1a\n\r\n--x\r\nrest"


def body(*parts, boundary="xyz", end=True):
    """A multipart body; parts are (name, text) or (name, file name, bytes)."""
    out = b""
    for p in parts:
        name = f'; filename="{p[1]}"' if len(p) == 3 else ""
        out += f'--{boundary}\r\nContent-Disposition: form-data; name="{p[0]}"{name}\r\n\r\n'.encode() + (p[2] if len(p) == 3 else p[1].encode()) + b"\r\n"
    return out + (f"--{boundary}--\r\n".encode() if end else b"")


def test_bodies(spark):
    bodies = {
        "good": body(("kind", "dz-id"), ("image", "a.png", PNG), ("kind", "dz-passport"), ("é", "ü\r\nline")),
        "no file": body(("kind", "x")), "two files": body(("a", "a", b"1"), ("b", "b", b"2")), "nine fields": body(*[(f"f{i}", "v") for i in range(9)]), "large file": body(("a", "a", b"x" * 1001)),
        "large body": body(("a", "x" * 6000)), "cut off": body(("a", "b"), end=False), "no form": b"hello", "empty": b"", "no name": b"--x\r\nContent-Type: a/b\r\n\r\n1\r\n--x--\r\n", "null": None,
    }
    rows = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in bodies.items()], "path string, content binary")
    got = {r["path"]: r for r in forms.read_forms(rows, body_bytes=5000, file_bytes=1000).collect()}
    good = got["good"]
    assert good["fields"] == {"kind": "dz-passport", "é": "ü\r\nline"} and bytes(good["image"]) == PNG and (good["file_name"], good["media_type"], good["problem"]) == ("a.png", "image/png", None)
    assert got["no file"]["fields"] == {"kind": "x"} and got["no file"]["image"] is None and got["no file"]["problem"] is None
    problems = {k: r["problem"] for k, r in got.items() if r["problem"]}
    assert problems == {"two files": "too_many_files", "nine fields": "too_many_fields", "large file": "file_too_large", "large body": "body_too_large"} | dict.fromkeys(("cut off", "no form", "empty", "no name", "null"), "malformed")
    assert all(r["fields"] is None and r["image"] is None for r in got.values() if r["problem"])


def test_a_restarted_stream_gives_each_form_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(5):
        (tmp_path / "in" / f"{i}").write_bytes(body(("n", str(i)), ("image", "a.png", PNG)))
        if i in (1, 4):
            forms.form_stream(spark, f"{tmp_path}/in", max_files=1).writeStream.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").format("parquet").start(f"{tmp_path}/out").awaitTermination()
    assert sorted(r["fields"]["n"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list("01234")


def test_lines_of_running_streams(spark, tmp_path):
    schema = "k string, v long"
    gauges = Gauges(kept=1000)
    spark.streams.addListener(gauges)
    try:
        for i in range(3):
            spark.createDataFrame([("a", j) for j in range(i + 1)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        rows = counted(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), "work", rows=F.count("*"), most=F.max("v"))
        query = rows.writeStream.queryName("q").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").format("noop").start()
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
        found = {(r["batch"], r["name"]): r["value"] for r in gauges.gauges(spark).where("query = 'q'").collect()}
        assert sorted(found[b, "work_rows"] for b in range(3)) == [1, 2, 3] and max(found[b, "work_most"] for b in range(3)) == 2
        assert sum(found[b, "rows_in"] for b in range(3)) == 6
        lines = [r["line"] for r in gauges.lines(spark).collect()]
        assert any(x.startswith('work_rows{query="q"} ') for x in lines) and any(x.startswith('state_rows{query="q"} 0') for x in lines)
    finally:
        spark.streams.removeListener(gauges)


def test_best_of_given_frames(spark):
    data, quad = scene()
    dark = bytes(np.frombuffer(data, np.uint8) // 3)
    red = np.frombuffer(data, np.uint8).reshape(480, 640, 4).copy()
    red[100:140, 100:200, :3] = (250, 20, 30)
    rows = [("a", 0, dark, quad), ("a", 1, data, quad), ("a", 2, data, quad), ("b", 0, data[:-4], quad), ("c", 0, red.tobytes(), quad), ("d", 0, data, None)]
    schema = "burst_id string, pos int, rgba binary, quad array<struct<x:double,y:double>>"
    frames = spark.createDataFrame([(b, p, bytearray(r), q) for b, p, r, q in rows], schema).withColumns({"kind": F.lit("dz-id"), "width": F.lit(640), "height": F.lit(480)})
    loose = {"minFill": 0.1, "minDpi": 50.0}
    got = {r["burst_id"]: r for r in burst.best_of_frames(frames, profile=loose).collect()}
    a = got["a"]
    assert a["frame_index"] == 1 and a["passed"] and [c["pos"] for c in a["candidates"]] == [0, 1, 2] and not a["candidates"][0]["passed"]
    assert bytes(a["photo"]) == data and (a["width"], a["height"]) == (640, 480)
    assert got["b"]["photo"] is None and got["b"]["mask"] is None and got["b"]["score"] == 0
    assert got["d"]["mask"] is None and bytes(got["d"]["photo"]) == data
    # the mask equals a loop over pixels
    corners = np.array(quad)
    size = assessment.upright_size(min(math.dist(quad[0], quad[1]), math.dist(quad[3], quad[2])), False)
    upright = image.rectify(red.tobytes(), 640, 480, corners, *size)
    mask, marked = np.frombuffer(bytes(got["c"]["mask"]), np.uint8).reshape(upright.shape), 0
    for y in range(0, size[1], 7):
        for x in range(0, size[0], 5):
            r, g, b, al = (int(v) for v in upright[y, x])
            if max(r, g, b) >= 220 and (max(r, g, b) - min(r, g, b)) >= 0.25 * max(r, g, b):
                marked += 1
                want = [int(math.floor(v * 0.3 + m * 0.7 + 0.5)) for v, m in zip((r, g, b), burst.MARK, strict=True)]
                assert [int(v) for v in mask[y, x]] == [*want, al]
            else:
                assert (mask[y, x] == upright[y, x]).all()
    assert marked > 20
    # the pixels behind a guide, where the frame covers a square view
    guide = frames.where("burst_id = 'a'").withColumns({"guide": F.struct(*[F.lit(v).alias(c) for c, v in (("x", 0.25), ("y", 0.25), ("w", 0.5), ("h", 0.5))]), "view_w": F.lit(480.0), "view_h": F.lit(480.0)})
    cut = burst.best_of_frames(guide, profile=loose).first()
    assert (cut["width"], cut["height"]) == (240, 240)
    assert bytes(cut["photo"]) == np.frombuffer(data, np.uint8).reshape(480, 640, 4)[120:360, 200:440].tobytes()


def test_windows_with_gaps_of_their_own(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows, t = [], 1_700_000_000
    for _ in range(150):
        t += int(rng.choice([1, 10, 60, 599, 600, 601, 3000]))
        rows.append((str(rng.choice(["a", "b", "c"])), t, int(rng.choice([10, 600, 3600]))))
    rows += [("a", None, 60)]
    schema = "k string, s long, gap long"
    timed = lambda df: df.withColumn("ts", F.timestamp_seconds("s"))
    gap = F.col("gap") * 1000
    df = timed(spark.createDataFrame(rows, schema))
    want = sorted((r["k"], r["a"], r["z"], r["n"]) for r in windows.gap_sessions(df.where("s IS NOT NULL"), ["k"], ["ts"], "ts", gap).groupBy("k", "session_no").agg(F.min("s").alias("a"), F.max("s").alias("z"), F.count("*").alias("n")).collect())
    flat = lambda out: sorted((r["k"], int(r["started"].timestamp()), int(r["last"].timestamp()), r["events"]) for r in out.collect())
    assert flat(windows.session_windows(df, ["k"], "ts", gap)) == want and len(want) > 10
    # the same where all gaps are equal, as the older rule has it
    plain = windows.inactivity_sessions(df.where("s IS NOT NULL"), ["k"], ["ts"], "ts", minutes=10).groupBy("k", "session_no").count().count()
    assert windows.session_windows(df, ["k"], "ts", F.lit(600_000)).count() == plain
    parts = [rows[:60], rows[60:], [("z", t + 10**6, 1)], [("z", t + 2 * 10**6, 1)]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = timed(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        windows.session_windows(stream, ["k"], "ts", gap, late="1 second").writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").format("parquet").start(f"{tmp_path}/out").awaitTermination()
    assert flat(spark.read.parquet(f"{tmp_path}/out").where("k <> 'z'")) == want



@pytest.mark.parametrize("seconds", [1799, 1800])
def test_an_event_at_the_very_end_starts_a_new_window(spark, seconds):
    df = spark.createDataFrame([("a", 0), ("a", seconds)], "k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert windows.session_windows(df, ["k"], "ts", F.lit(1_800_000)).count() == (1 if seconds < 1800 else 2)
