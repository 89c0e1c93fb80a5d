import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from idloom import dims
from idloom.functions import numeric as N
from idloom.operators import assessment, image, matching, quality, reports, windows

FRAME = {"fill": 0.8, "margin": 0.05, "aspect_error": 0.0, "angle_deviation": 1.0, "side_ratio": 1.01, "dpi": 297.0, "corner_motion": 0.0, "sharpness": 12.0, "paper": 225.0, "contrast": 0.8, "motion_isotropy": 0.7, "focus_uniformity": 0.8, "illumination": 0.95, "noise": 1.0, "highlight_clip": 0.0, "shadow_clip": 0.0, "glare_ratio": 0.0, "glare_blob": 0.0, "color_glare_ratio": 0.0}


def frames(spark, *changes):
    rows = [FRAME | c for c in changes]
    return spark.createDataFrame([(i, *[r[k] for k in FRAME]) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{k} double" for k in FRAME))


def test_a_soft_frame(spark):
    r = quality.evaluate(frames(spark, {}), live=True).first()
    assert (r["passed"], r["hint"], r["flawless"]) == (False, "focus", False)
    assert [c["status"] for c in r["checks"] if c["key"] == "sharpness"] == ["fail"]
    r = quality.evaluate(frames(spark, {}), severity={"sharpness": "warn"}, live=True).first()
    assert (r["passed"], r["flawless"]) == (True, False)


@pytest.mark.parametrize(
    ("change", "key", "hint"),
    [({"margin": 0.0}, "document_inside", "show_whole_document"), ({"fill": 0.5}, "document_fill", "move_closer"), ({"fill": 0.99}, "document_fill", "move_back"), ({"aspect_error": 0.2}, "aspect_ratio", "wrong_document"), ({"side_ratio": 1.3}, "perspective", "hold_parallel"), ({"dpi": 100.0}, "resolution", "move_closer"), ({"corner_motion": 0.1}, "stability", "hold_still"), ({"paper": 50.0}, "exposure", "more_light"), ({"paper": 240.0}, "exposure", "less_light"), ({"highlight_clip": 0.1}, "highlights", "less_light"), ({"glare_blob": 0.1}, "glare", "avoid_glare"), ({"illumination": 0.1}, "illumination", "even_light")],
)
def test_one_blocking_defect_each(spark, change, key, hint):
    r = quality.evaluate(frames(spark, {"sharpness": 200.0, "paper": 200.0} | change), live=True).first()
    assert [c["key"] for c in r["checks"] if c["status"] == "fail"] == [key] and r["hint"] == hint and not r["passed"]


@pytest.mark.parametrize(("change", "key"), [({"motion_isotropy": 0.1}, "motion_blur"), ({"focus_uniformity": 0.1}, "focus_uniformity"), ({"shadow_clip": 0.5}, "shadows_clipped"), ({"contrast": 0.1}, "contrast"), ({"color_glare_ratio": 0.1}, "color_glare"), ({"noise": 9.0}, "noise")])
def test_warnings_do_not_block(spark, change, key):
    r = quality.evaluate(frames(spark, {"sharpness": 200.0, "paper": 200.0} | change), live=True).first()
    assert r["passed"] and not r["flawless"] and [c["key"] for c in r["checks"] if c["status"] == "warn"] == [key]


def test_missing_metrics_and_switched_off_checks(spark):
    nothing = frames(spark, dict.fromkeys(FRAME))
    r = quality.evaluate(nothing).first()
    assert [c["key"] for c in r["checks"]] == ["document_found"] and r["hint"] == "find_document" and r["score"] == 0
    assert quality.evaluate(nothing, severity={"document_found": "off"}).first()["checks"] == []
    keys = [c["key"] for c in quality.evaluate(frames(spark, {})).first()["checks"]]
    assert "stability" not in keys and len(keys) == 17


def test_gate_profile_and_zones(spark):
    e = quality.evaluate(frames(spark, {}))
    assert e.select(quality.gate("enforce", F.col("checks"))).first()[0] is False and e.select(quality.gate("observe", F.col("checks"))).first()[0] is True
    assert quality.profile_problems({}) == [] and quality.profile_problems({"minFill": 0.99}) == ["minFill>maxFill"] and quality.profile_problems({"maxNoise": 1e9}) == ["maxNoise"]
    assert quality.upgrade_profile({"version": 1, "mode": "enforce", "limits": {"minDpi": 1}})["limits"] == dims.PROFILE
    assert quality.upgrade_profile({"version": 2, "limits": {"minDpi": 1.0}})["limits"]["minDpi"] == 1.0
    zones = spark.createDataFrame([("c", "z", True, True, 50.0, 10.0, 0.5, 0.1, 100.0, 90.0, 200.0), ("c", "y", False, True, 50.0, 10.0, 0.5, 0.1, 100.0, 90.0, 200.0)], "i string, zone_id string, required boolean, visible boolean, zone_sharpness double, min_sharpness double, zone_glare double, max_glare double, zone_paper double, min_paper double, max_paper double")
    assert {r["check_id"]: r["passed"] for r in quality.zone_checks(zones, "i").collect()} == {"zone_visible.z": True, "zone_sharpness.z": True, "zone_glare.z": False, "zone_exposure.z": True}


def test_rounding_is_half_up_on_the_binary_value(spark):
    values = [1.005, 2.5, -2.5, 0.125, None]
    got = [r["o"] for r in spark.createDataFrame([(v,) for v in values], "v double").select(N.round_half_up(F.col("v"), 2).alias("o")).collect()]
    assert got == [1.0, 2.5, -2.5, 0.13, None]


def test_geometry(spark):
    quad = [(100.0, 100.0), (956.0, 100.0), (956.0, 639.8), (100.0, 639.8)]
    rows = spark.createDataFrame([([{"x": x, "y": y} for x, y in quad], 1056.0, 739.8, "dz-id")], "q array<struct<x:double,y:double>>, w double, h double, k string")
    g = rows.select(N.geometry(F.col("q"), F.col("w"), F.col("h"), F.col("k")).alias("g")).first()["g"]
    assert g["aspect_error"] == pytest.approx(0, abs=1e-9) and g["angle_deviation"] == pytest.approx(0, abs=1e-6) and g["side_ratio"] == pytest.approx(1)
    assert g["dpi"] == pytest.approx(856 / (85.6 / 25.4)) and g["fill"] == pytest.approx(math.sqrt(856 * 539.8 / (1056 * 739.8)))


@pytest.mark.parametrize(("w", "h", "want"), [(1920, 1080, (744, 270, 432, 270)), (4032, 3024, (1411, 756, 1210, 756))])
def test_crop(spark, w, h, want):
    g = F.struct(F.lit(0.1).alias("x"), F.lit(0.25).alias("y"), F.lit(0.8).alias("w"), F.lit(0.25).alias("h"))
    c = spark.range(1).select(N.crop_region(g, F.lit(400.0), F.lit(800.0), F.lit(float(w)), F.lit(float(h))).alias("c")).first()["c"]
    assert tuple(c) == want


def test_homography_columns(spark):
    h = [1.1, 0.2, 5.0, -0.1, 0.9, 3.0, 0.0004, 0.0002, 1.0]
    row = spark.createDataFrame([(h,)], "h array<double>")
    p = F.struct(F.lit(40.0).alias("x"), F.lit(25.0).alias("y"))
    back = row.select(N.project(N.invert_homography(F.col("h")), N.project(F.col("h"), p)).alias("b")).first()["b"]
    assert (back["x"], back["y"]) == (pytest.approx(40), pytest.approx(25))


# ---------------------------------------------------------------- photos


def rgba(pixels):
    return np.dstack([pixels.astype(np.uint8), np.full(pixels.shape[:2], 255, np.uint8)]).tobytes()


def gray(values):
    return rgba(np.repeat(values[..., None], 3, 2))


def test_uneven_light():
    half = np.full((400, 600), 40)
    half[:, 300:] = 220
    assert image.measure(gray(half), 600, 400)["illumination"] < 0.62


def test_colour_glare():
    page = np.full((250, 400, 3), (225, 225, 220))
    plain = image.measure(rgba(page), 400, 250)
    page[50:150, 100:220] = (242, 195, 95)
    m = image.measure(rgba(page), 400, 250)
    assert plain["color_glare_ratio"] == 0 and m["color_glare_ratio"] > 0.03 and m["glare_ratio"] < 0.001
    assert image.measure(rgba(page), 400, 250, color_value=250)["color_glare_ratio"] == 0
    assert image.measure(rgba(page), 400, 250, color_saturation=0.8)["color_glare_ratio"] == 0


def test_noise_estimate():
    rng = np.random.default_rng(5)
    page = np.clip(200 + rng.normal(0, 8, (250, 400)), 0, 255)
    page[::25] = 30
    assert 6.5 < image.measure(gray(page), 400, 250)["noise"] < 9


def flood(mask, cell=4):
    h, w = -(-mask.shape[0] // cell), -(-mask.shape[1] // cell)
    full = {(y, x) for y in range(h) for x in range(w) if mask[y * cell : (y + 1) * cell, x * cell : (x + 1) * cell].sum() >= cell * cell / 2}
    best = 0
    while full:
        todo, area = [full.pop()], 0
        while todo:
            y, x = todo.pop()
            area += 1
            for n in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                if n in full:
                    full.remove(n)
                    todo.append(n)
        best = max(best, area)
    return best / (h * w)


def test_blobs_equal_a_flood_fill():
    rng = np.random.default_rng(6)
    for _ in range(60):
        cells = rng.random((rng.integers(1, 14), rng.integers(1, 14))) < rng.random()
        mask = np.kron(cells, np.ones((4, 4), bool))[: rng.integers(1, 50), : rng.integers(1, 50)]
        assert image.largest_blob(mask) == pytest.approx(flood(mask))


def test_photos_in_a_table(spark):
    ok = gray(np.full((6, 8), 100))
    rows = spark.createDataFrame([(1, 8, 6, bytearray(ok)), (2, 8, 5, bytearray(ok)), (3, None, 6, bytearray(ok)), (4, 0, 0, bytearray(b"")), (5, 1, 1, bytearray(b"\xff" * 4))], "image_id long, width int, height int, rgba binary")
    out = {r["image_id"]: r for r in image.measure_images(rows).collect()}
    assert [out[i]["valid"] for i in range(1, 6)] == [True, False, False, False, True]
    assert out[1]["mean"] == 100 and out[2]["mean"] is None and out[5]["glare_ratio"] == 1


def test_rectify_and_balance():
    page = np.arange(40 * 30 * 3).reshape(30, 40, 3) % 251
    same = image.rectify(rgba(page), 40, 30, np.array([[0, 0], [39, 0], [39, 29], [0, 29]]), 40, 30)
    assert (same[..., :3] == page).all()
    assert image.white_balance_gains(rgba(np.full((100, 100, 3), (200, 200, 190))), 100, 100)[2] > 1
    assert image.white_balance_gains(rgba(np.full((5, 5, 3), 9)), 5, 5) == [1.0, 1.0, 1.0]


# ---------------------------------------------------------------- matching


def test_nearest_two_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    q, r = rng.integers(0, 256, (60, 4), np.uint8), rng.integers(0, 256, (300, 4), np.uint8)
    frame = lambda x, base: spark.createDataFrame([("t", base + i, bytearray(d.tobytes())) for i, d in enumerate(x)], "template string, id long, descriptor binary")
    old, matching.REFERENCE_BLOCK = matching.REFERENCE_BLOCK, 64
    got = {x["query_id"]: (x["first_id"], x["first"], x["second"]) for x in matching.nearest_two(frame(q, 1000), frame(r, 0), "template", "id").collect()}
    matching.REFERENCE_BLOCK = old
    for i, a in enumerate(q):
        d = sorted((bin(int.from_bytes((a ^ b).tobytes(), "big")).count("1"), j) for j, b in enumerate(r))
        assert got[1000 + i] == (d[0][1], d[0][0], d[1][0])


def test_alignment_finds_the_map(spark):
    rng = np.random.default_rng(8)
    src = rng.random((60, 2)) * 400
    h = np.array([[1.05, 0.1, 12], [-0.08, 0.97, 7], [1e-4, 5e-5, 1]])
    dst = matching.apply_homography(h, src)
    dst[40:] += rng.random((20, 2)) * 200 + 50
    rows = spark.createDataFrame([("a", *map(float, (*s, *d))) for s, d in zip(src, dst, strict=True)] + [("b", 1.0, 1.0, 1.0, 1.0)], "k string, x double, y double, tx double, ty double")
    got = {r["k"]: r for r in matching.align(rows, "k").collect()}
    assert got["a"]["inliers"] == 40 and np.allclose(np.array(got["a"]["homography"]).reshape(3, 3), h, atol=1e-3)
    assert got["b"]["homography"] is None


def test_candidates(spark):
    rows = spark.createDataFrame([("c", "t1", False, 0.9, 1.0), ("c", "t2", True, 0.5, 3.0), ("c", "t3", True, 0.5, 2.0)], "c string, template_id string, matched boolean, inlier_ratio double, error double")
    assert matching.best_template(rows, "c").first()["template_id"] == "t3"
    points = spark.createDataFrame([("c", x, y, x + 3.0, y + 4.0, True, 100.0, 50.0) for x, y in ((0.0, 0.0), (50.0, 0.0), (50.0, 25.0), (0.0, 25.0))] + [("c", 1.0, 1.0, 90.0, 9.0, False, 100.0, 50.0), ("d", 0.0, 0.0, 0.0, 0.0, False, 10.0, 10.0)], "c string, x double, y double, px double, py double, inlier boolean, width double, height double")
    q = {r["c"]: r for r in matching.match_quality(points, "c").collect()}
    assert (q["c"]["good"], q["c"]["inlier_ratio"], q["c"]["coverage"], q["c"]["error"]) == (5, 0.8, 0.25, 5.0)
    assert q["d"]["coverage"] == 0 and q["d"]["error"] == math.inf


# ---------------------------------------------------------------- streaks and reports


def test_streaks_equal_a_loop(spark):
    rng = random.Random(9)
    rows = [(u, i, i * rng.randint(1, 2), rng.random() < 0.8) for u in range(6) for i in range(60)]
    out = windows.stable_hold(spark.createDataFrame([(u, i, s, p) for u, i, s, p in rows], "u int, i int, s long, good boolean").withColumn("ts", F.timestamp_seconds("s")), ["u"], ["i"], "ts", "good")
    got = {(r["u"], r["i"]): (r["streak"], r["fire"]) for r in out.collect()}
    for u in range(6):
        streak, since, fired = 0, 0, False
        for _, i, s, p in (r for r in rows if r[0] == u):
            if not p:
                streak, fired = 0, False
            else:
                streak += 1
                since = s if streak == 1 else min(since, s)
            fire = p and streak >= 4 and s - since >= 5
            assert got[u, i] == (streak, fire and not fired)
            fired |= fire


def test_thirty_minutes_start_a_new_session(spark):
    rows = spark.createDataFrame([(1, s) for s in (0, 1799, 3599, 5399, 7198)], "u int, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert [r["session_no"] for r in windows.inactivity_sessions(rows, ["u"], ["ts"], "ts").orderBy("s").collect()] == [0, 0, 1, 2, 2]


def test_benchmark_summary(spark):
    ocr = "struct<correct:long,total:long,duration_ms:long,error:boolean>"
    schema = f"id string, expected string, passed boolean, quality_ms long, original_ocr {ocr}, prepared_ocr {ocr}"
    rows = [("a", "reject", True, 10, None, None), ("b", "accept", False, 30, None, (3, 3, 80, False))]
    r = reports.benchmark_summary(spark.createDataFrame(rows, schema)).first()
    assert (r["bad_accepted"], r["good_rejected"], r["mean_quality_ms"]) == (1, 1, 20)
    assert tuple(r["prepared_ocr"]) == (1, 0, 3, 3, 80) and tuple(r["original_ocr"]) == (0, 0, 0, 0, None)
    empty = reports.benchmark_summary(spark.createDataFrame([], schema)).first()
    assert (empty["total"], empty["mean_quality_ms"], empty["prepared_ocr"]["mean_ms"]) == (0, 0, None)


def test_flow_phases(spark):
    docs = spark.createDataFrame([("a", 0, "dz-id", False, "processing", False), ("b", 0, "dz-id", False, "incomplete", True), ("c", 0, "dz-passport", True, "ready", False), ("d", 0, "dz-passport", True, "ready", False)], "s string, pos int, kind string, confirmed boolean, status string, blocking boolean")
    captures = spark.createDataFrame([("a", "dz-id", "front"), ("b", "dz-id", "front"), ("b", "dz-id", "back")], "s string, kind string, side string")
    conflicts = spark.createDataFrame([("d", True)], "s string, blocking boolean")
    got = {r["s"]: (r["phase"], r["next_side"], r["completed"]) for r in reports.flow(docs, captures, conflicts, "s").collect()}
    assert got == {"a": ("capture", "back", 0), "b": ("consistency", None, 0), "c": ("complete", None, 1), "d": ("consistency", None, 1)}


def test_metric_maps_and_keys(spark):
    rows = spark.createDataFrame([({"image": {"noise": 1.23456}, "geometry": {"fill": 0.5}},)], "m map<string,map<string,double>>")
    assert rows.select(reports.flatten_metrics(F.col("m")).alias("f")).first()["f"] == {"image.noise": 1.2346, "geometry.fill": 0.5}
    captures = spark.createDataFrame([("s", "a", None), ("s", "b", "c")], "session_id string, object_key string, ocr_object_key string")
    assert sorted(r["object_key"] for r in reports.object_keys(captures).collect()) == ["a", "b", "c"]


# ---------------------------------------------------------------- assessment


def photo(spark, rows):
    return spark.createDataFrame(rows, "photo_id string, kind string, width int, height int, rgba binary, quad array<struct<x:double,y:double>>, zones array<struct<id:string,x:double,y:double,w:double,h:double>>")


def scene(seed=1):
    """A frame of 640 x 480 with a detailed card on a dark table, and the card's corners."""
    rng = np.random.default_rng(seed)
    px = np.full((480, 640, 4), 60, np.uint8)
    card = np.full((345, 545, 3), 190, np.uint8)
    for _ in range(900):
        y, x = rng.integers(5, 335), rng.integers(5, 530)
        card[y : y + 3, x : x + 9] = rng.integers(20, 60)
    px[60:405, 45:590, :3] = card
    px[..., 3] = 255
    return px.tobytes(), [(45.0, 60.0), (589.0, 60.0), (589.0, 404.0), (45.0, 404.0)]


def test_assessment_of_photos(spark):
    data, quad = scene()
    zones = [("number", 0.1, 0.1, 0.5, 0.3), ("edge", 0.995, 0.1, 0.5, 0.3)]
    rows = [("a", "dz-id", 640, 480, data, quad, zones), ("none", "dz-id", 640, 480, data, None, zones), ("short", "dz-id", 640, 480, data[:-4], quad, zones)]
    photos = photo(spark, rows)
    measured = {r["photo_id"]: r for r in assessment.analyse(photos, zones=True).collect()}
    width, height = assessment.upright_size(measured["a"]["width_px"], False)
    assert (width, height) == (544, 343) and assessment.upright_size(9000, True) == (1024, 721) and assessment.upright_size(3, False)[0] == 32
    upright = image.rectify(data, 640, 480, np.array(quad), width, height)
    assert measured["a"]["sharpness"] == pytest.approx(image.measure(upright.tobytes(), width, height)["sharpness"])
    assert [z["visible"] for z in measured["a"]["zone_metrics"]] == [True, False]
    assert measured["none"]["fill"] is None and measured["short"]["sharpness"] is None
    loose = {"minFill": 0.1, "minDpi": 50.0}
    aligned = spark.createDataFrame([("a", "t1", False, 0.9, 0.5, 1.0, True), ("a", "t2", True, 0.8, 0.5, 1.0, True), ("none", "t1", False, 0.1, 0.01, 99.0, False)], "photo_id string, template_id string, matched boolean, inlier_ratio double, coverage double, error double, plausible boolean")
    got = {r["photo_id"]: r for r in assessment.assess(photos, aligned, zones=True, profile=loose).collect()}
    keys = [c["key"] for c in got["a"]["checks"]]
    assert got["a"]["template_id"] == "t2" and got["a"]["template_matched"]
    assert keys[-8:] == ["template_alignment", "orb_spatial_coverage", "orb_reprojection", "orb_geometry", "zone:number:sharpness", "zone:number:glare", "zone:number:exposure", "zone:edge:visible"]
    assert not got["a"]["passed"] and got["a"]["hint"] == "show_whole_document"  # the second zone lies outside
    assert {c["key"]: c["status"] for c in got["none"]["checks"]}["document_found"] == "fail" and got["none"]["hint"] == "find_document"
    inside = photo(spark, [("a", "dz-id", 640, 480, data, quad, zones[:1])])
    assert assessment.assess(inside, aligned, zones=True, profile=loose).first()["passed"]
    assert assessment.assess(photos, mode="observe").where("NOT passed").count() == 0
    off = assessment.assess(photos, mode="off").first()
    assert off["passed"] and off["checks"] == []


def test_largest_quad_and_order_of_corners(spark):
    points = [(500.0, 300.0), (100.0, 100.0), (100.0, 300.0), (500.0, 100.0)]
    rows = [("f", 0, points, 640.0, 480.0, "dz-id"), ("f", 1, [(x / 4, y / 4) for x, y in points], 640.0, 480.0, "dz-id"), ("f", 2, [(0.0, 0.0), (640.0, 0.0), (640.0, 100.0), (0.0, 100.0)], 640.0, 480.0, "dz-id")]
    frames = spark.createDataFrame(rows, "frame string, pos int, points array<struct<x:double,y:double>>, width double, height double, kind string")
    assert [(p["x"], p["y"]) for p in assessment.best_quad(frames, "frame").first()["quad"]] == [(100, 100), (500, 100), (500, 300), (100, 300)]
    upright = spark.createDataFrame([([(0.0, 0.0), (100.0, 0.0), (100.0, 300.0), (0.0, 300.0)],)], "q array<struct<x:double,y:double>>")
    from idloom.functions.numeric import order_corners

    assert [(p["x"], p["y"]) for p in upright.select(order_corners(upright["q"]).alias("q")).first()["q"]] == [(100, 0), (100, 300), (0, 300), (0, 0)]


def test_template_versions(spark):
    old = spark.createDataFrame([("t", 1, "2020"), ("t", 2, "2021")], "id string, version int, created_at string")
    new = spark.createDataFrame([("t", "dz-id"), ("u", "dz-id")], "id string, document_kind string")
    got = {r["id"]: r for r in assessment.template_version(old, new, "2024").collect()}
    assert (got["t"]["version"], got["t"]["created_at"], got["u"]["version"], got["u"]["created_at"]) == (3, "2020", 1, "2024")
    assert got["u"]["parameters"]["minimumGoodMatches"] == 18


def test_views_of_checks_profiles_and_sessions(spark):
    from idloom.functions import text
    from idloom.plans.photo_queries import _profile

    good = _profile()
    bad = json.loads(json.dumps(good))
    bad["image"]["maxNoise"], bad["mode"], bad["severity"]["noise"] = "loud", "on", "maybe"
    del bad["image"]["minColorGlareValue"], bad["orb"]["ransacThreshold"], bad["severity"]["color_glare"]
    rows = spark.createDataFrame([(0, json.dumps(good)), (1, json.dumps(bad)), (2, "no profile")], "i int, p string")
    got = {r["i"]: r["f"] for r in rows.select("i", quality.profile_faults(rows["p"]).alias("f")).collect()}
    assert got[0] == [] and got[1] == ["image.maxNoise", "orb.ransacThreshold", "severity.noise", "mode"] and len(got[2]) > 50
    lists = spark.createDataFrame([('["a", 1, null, "b", ["c"]]',), ('{"a": "b"}',), (None,)], "x string")
    assert [r[0] for r in lists.select(text.only_texts(lists["x"])).collect()] == [["a", "b"], [], []]
    sessions = spark.createDataFrame([("s", b"x", 3)], "id string, latest_image binary, samples int")
    assert quality.calibration_snapshot(sessions).columns == ["id", "samples"]


# ---------------------------------------------------------------- tiles


def photos_of_all_sizes(seed=11):
    rng, out = np.random.default_rng(seed), []
    for i, (w, h) in enumerate([(1, 1), (2, 9), (9, 2), (3, 3), (8, 8), (31, 45), (64, 48), (40, 200), (200, 37)]):
        px = rng.integers(0, 256, (h, w, 4), np.uint8)
        cells = rng.random((-(-h // 4), -(-w // 4))) < 0.6
        px[np.kron(cells, np.ones((4, 4), bool))[:h, :w]] = 255
        smooth = rng.random((h, w)) < 0.3
        px[smooth] = (120, 121, 119, 255)
        out.append((i, w, h, bytearray(px.tobytes())))
    return [*out, (90, 4, 4, bytearray(b"short")), (91, None, 4, bytearray(64)), (92, 4, 4, None), (93, 0, 0, bytearray(b""))]


@pytest.mark.parametrize("band", [1, 3000, 1 << 20])
def test_tiles_give_what_the_whole_photo_gives(spark, band):
    from idloom.operators import tiles

    rows = spark.createDataFrame(photos_of_all_sizes(), "image_id long, width int, height int, rgba binary")
    whole = {r["image_id"]: r for r in image.measure_images(rows).collect()}
    got = {r["image_id"]: r for r in tiles.measure_tiled(rows, band_bytes=band).collect()}
    assert got.keys() == whole.keys()
    for i, r in whole.items():
        assert got[i]["valid"] == r["valid"]
        for m in image.METRICS:
            assert got[i][m] == (None if r[m] is None else pytest.approx(r[m], rel=1e-9, abs=1e-9)), (i, m)
    assert tiles.measure_any(rows, large=5000).count() == len(whole) and tiles.measure_tiled(rows.limit(0)).count() == 0


def test_blobs_are_joined_over_borders():
    from idloom.operators import tiles

    rng = np.random.default_rng(12)
    for _ in range(80):
        cells = rng.random((rng.integers(1, 30), rng.integers(1, 14))) < rng.random()
        parts, step = [], int(rng.integers(1, 8))
        for y in range(0, len(cells), step):
            labels = tiles._labels(cells[y : y + step])
            known, sizes = np.unique(labels[labels > 0], return_counts=True)
            at = np.where(labels > 0, np.searchsorted(known, labels) + 1, 0)
            parts.append({"y": y, "sizes": sizes.tolist(), "top": at[0].tolist(), "bottom": at[-1].tolist()})
        assert tiles.largest_joined(parts) / cells.size == pytest.approx(flood(np.kron(cells, np.ones((4, 4), bool))))
