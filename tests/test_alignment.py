import math

import numpy as np
import pytest

from idloom.operators import alignment, assessment, image, matching
from tests.test_quality import scene

FEATURES = "feature_id long, x double, y double, descriptor binary"


def test_nearest_pair_equals_brute_force(monkeypatch):
    rng = np.random.default_rng(1)
    for width in (3, 8, 32):
        a, b = rng.integers(0, 4, (40, width), np.uint8), rng.integers(0, 4, (25, width), np.uint8)
        d = np.array([[sum(int(x ^ y).bit_count() for x, y in zip(p, q, strict=True)) for q in b] for p in a])
        for slab in (1, 1 << 20):
            monkeypatch.setattr(alignment, "SLAB", slab)
            first, one, two = alignment.nearest_pair(a, b)
            assert (first == d.argmin(1)).all() and (one == d.min(1)).all() and (two == np.sort(d, 1)[:, 1]).all()


@pytest.mark.parametrize("n", [4, 5, 63, 64, 65, 3000])
def test_picks_are_four_different_ones(n):
    p = alignment.picks(n)
    assert p.shape == (alignment.HYPOTHESES, 4) and p.min() >= 0 and p.max() < n
    assert all(len(set(row)) == 4 for row in p.tolist())


def test_four_points_decide_a_map():
    rng = np.random.default_rng(2)
    src, h = rng.random((50, 4, 2)) * 300, np.array([[1.1, 0.2, 9], [-0.1, 0.9, 4], [2e-4, -1e-4, 1]])
    dst = alignment.project(np.repeat(h[None], 50, 0), src)
    assert np.allclose(alignment.four_point_maps(src, dst), h, atol=1e-6)
    line = np.array([[0, 0], [1, 1], [2, 2], [5, 0]], float)
    assert np.isnan(alignment.four_point_maps(line, src[0])).all() and np.isnan(alignment.four_point_maps(src[0], line)).all()


def groups(rng, sizes, outliers=0.3):
    out = []
    for n in sizes:
        h = np.eye(3) + rng.normal(size=(3, 3)) * [[0.05, 0.05, 9], [0.05, 0.05, 9], [1e-4, 1e-4, 0]]
        src = rng.random((n, 2)) * 400
        dst = alignment.project(h[None], src[None])[0]
        wrong = rng.permutation(n)[: int(n * outliers)]
        dst[wrong] += 40 + rng.random((len(wrong), 2)) * 300
        out.append((h, src, dst, np.isin(np.arange(n), wrong, invert=True)))
    return out


def test_many_groups_are_solved_at_once_as_each_alone(monkeypatch):
    made = groups(np.random.default_rng(3), [0, 1, 3, 20, 21, 40, 40, 77, 300, 900])
    pairs, limits = [(s, d) for _, s, d, _ in made], [4.0] * len(made)
    found = alignment.consensus_many(pairs, limits)
    for (h, src, _, good), (got, inlier) in zip(made, found, strict=True):
        if len(src) < 4:
            assert got is None and not inlier.any()
        else:
            assert (inlier == good).all() and np.allclose(got, h, atol=1e-5)
    for slab in (1, 50_000):
        monkeypatch.setattr(alignment, "SLAB", slab)
        for k in range(len(pairs)):
            h, inlier = alignment.consensus_many(pairs[k : k + 1], limits[:1])[0]
            assert (inlier == found[k][1]).all() and (h is None) == (found[k][0] is None) and (h is None or np.allclose(h, found[k][0], atol=1e-9))


def test_refit_equals_least_squares():
    rng = np.random.default_rng(4)
    src = rng.random((1, 60, 2)) * 400
    dst = src + rng.normal(size=src.shape)
    some = rng.random((1, 60)) < 0.8
    h, plain = alignment.refit(src, dst, some)[0], matching.solve_homography(src[0][some[0]], dst[0][some[0]])
    off = lambda m: np.hypot(*(alignment.project(m[None], src)[0] - dst[0])[some[0]].T).mean()
    assert off(h) <= off(plain) * 1.02


def test_points_on_a_line_have_no_map():
    src = np.column_stack([np.arange(30.0), np.arange(30.0)])
    h, _ = alignment.consensus_many([(src, src)], [4.0])[0]
    assert h is None
    h, _ = alignment.consensus_many([(np.zeros((30, 2)), np.zeros((30, 2)))], [4.0])[0]
    assert h is None


def descriptors(rng, n):
    return [bytearray(d.tobytes()) for d in rng.integers(0, 256, (n, 32), np.uint8)]


def inputs(spark, rng, photos, templates):
    """Photos [(id, group, [features])] and templates [(id, group, [features], parameters)] as frames."""
    p = spark.createDataFrame([(i, g, 400, 300) for i, g, _ in photos], "photo_id string, group_id string, width int, height int")
    pf = spark.createDataFrame([(i, *f) for i, _, fs in photos for f in fs], "photo_id string, " + FEATURES).repartition(3)
    t = spark.createDataFrame([(i, g, 420.0, 310.0, good) for i, g, _, good in templates], "template_id string, group_id string, width double, height double, min_good int")
    tf = spark.createDataFrame([(i, *f) for i, _, fs, _ in templates for f in fs], "template_id string, " + FEATURES).repartition(2)
    return p, pf, t, tf


def board(rng, n=120):
    place = rng.random((n, 2)) * [400, 300]
    return [(k, float(x), float(y), d) for k, ((x, y), d) in enumerate(zip(place, descriptors(rng, n), strict=True))]


def shown(features, rng, h, wrong=0.2):
    """Features of a photo on which a template is seen under the inverse of ``h``, some of them elsewhere."""
    back, out = np.linalg.inv(h), []
    for k, x, y, d in features:
        px, py = alignment.project(back[None], np.array([[[x, y]]]))[0, 0]
        if rng.random() < wrong:
            px, py = rng.random(2) * [400, 300]
        d = bytearray(d)
        d[k % 32] ^= 1
        out.append((k + 1000, float(px), float(py), d))
    return out


H = np.array([[1.04, 0.03, 3.0], [-0.02, 1.05, 2.0], [2e-5, 1e-5, 1]])


def test_photos_find_their_template(spark, monkeypatch):
    rng = np.random.default_rng(5)
    one, two = board(rng), board(rng)
    none = [(1, None, 1.0, bytearray(32)), (None, 1.0, 1.0, bytearray(32)), (2, 1.0, 1.0, None)]
    photos = [("a", "g", shown(one, rng, H)), ("b", "g", shown(two, rng, np.eye(3)) + none), ("blank", "g", []), ("lost", "other", shown(one, rng, H)), ("few", "g", shown(one, rng, H)[:10]), ("nulls", None, shown(one, rng, H))]
    templates = [("t1", "g", one, None), ("t2", "g", two, 18), ("empty", "g", [], None), ("strict", "g", one, 500)]
    frames = inputs(spark, rng, photos, templates)
    rows = alignment.align_photos(*frames).collect()
    got = {(r["photo_id"], r["template_id"]): r for r in rows}
    assert len(rows) == 16 and {i for i, _ in got} == {"a", "b", "blank", "few"}
    a = got["a", "t1"]
    assert a["matched"] and a["good"] == 120 and 80 <= a["inliers"] <= 110 and a["error"] < 0.01 and a["plausible"]
    assert np.allclose(np.array(a["homography"]).reshape(3, 3), H, atol=1e-3)
    corners = alignment.project(np.linalg.inv(H)[None], np.array([[[0, 0], [420, 0], [420, 310], [0, 310]]], float))[0]
    assert np.allclose([(p["x"], p["y"]) for p in a["quad"]], corners, atol=0.05)
    for pair in (("a", "t2"), ("blank", "t1"), ("a", "empty"), ("few", "t1"), ("a", "strict")):
        r = got[pair]
        assert (r["matched"], r["inliers"], r["inlier_ratio"], r["coverage"], r["error"], r["homography"], r["quad"]) == (False, 0, 0.0, 0.0, math.inf, None, None)
    best = {r["photo_id"]: (r["template_id"], r["matched"]) for r in alignment.best_alignments(alignment.align_photos(*frames)).collect()}
    assert best["a"] == ("t1", True) and best["b"] == ("t2", True) and not best["blank"][1]
    key = lambda r: tuple(map(str, r))
    monkeypatch.setattr(alignment, "BLOCK", 16)
    monkeypatch.setattr(alignment, "BROADCAST_BYTES", 0)  # salted join, many blocks: nothing changes
    assert sorted(map(key, alignment.align_photos(*frames).collect())) == sorted(map(key, rows))


def test_alignment_of_empty_tables(spark):
    assert alignment.align_photos(*inputs(spark, None, [], [])).count() == 0
    rng = np.random.default_rng(6)
    assert alignment.align_photos(*inputs(spark, rng, [("a", "g", board(rng))], [])).count() == 0


def test_plausible():
    box = np.array([[0, 0], [400, 0], [400, 300], [0, 300]], float)
    assert alignment.plausible(box, 400, 300) and not alignment.plausible(box * 0.5, 400, 300) and not alignment.plausible(box * 1.6, 400, 300)
    assert not alignment.plausible(box + [200, 0], 400, 300) and not alignment.plausible(box * np.nan, 400, 300)


def test_assessment_with_templates(spark):
    """A photo without an outline gets that of its template; one whose group has none, a check that isn't applicable."""
    rng = np.random.default_rng(7)
    data, quad = scene()
    card = np.array(quad)
    h = matching.solve_homography(card, np.array([[0, 0], [540, 0], [540, 340], [0, 340]], float))
    features = [(k, float(x), float(y), d) for k, ((x, y), d) in enumerate(zip(rng.random((90, 2)) * [540, 340], descriptors(rng, 90), strict=True))]
    seen = [(k + 500, *map(float, alignment.project(np.linalg.inv(h)[None], np.array([[[x, y]]]))[0, 0]), d) for k, x, y, d in features]
    schema = "photo_id string, group_id string, kind string, width int, height int, rgba binary, quad array<struct<x:double,y:double>>, upright_width int, upright_height int"
    up_w, up_h = assessment.upright_size(544.0, False)
    scaled = [(k, x * up_w / 540, y * up_h / 340, d) for k, x, y, d in features]
    photos = spark.createDataFrame([("open", "g", "dz-id", 640, 480, data, None, None, None), ("known", "g", "dz-id", 640, 480, data, quad, up_w, up_h), ("alone", "none", "dz-id", 640, 480, data, quad, up_w, up_h)], schema)
    own = spark.createDataFrame([("open", *f) for f in seen] + [("known", *f) for f in scaled], "photo_id string, " + FEATURES)
    templates = spark.createDataFrame([("t", "g", 540, 340)], "template_id string, group_id string, width int, height int")
    sheet = spark.createDataFrame([("t", *f) for f in features], "template_id string, " + FEATURES)
    loose = {"minFill": 0.1, "minDpi": 50.0}
    got = {r["photo_id"]: r for r in alignment.assess_aligned(photos, own, templates, sheet, profile=loose).collect()}
    checks = {i: {c["key"]: c["status"] for c in r["checks"]} for i, r in got.items()}
    for i in ("open", "known"):
        assert got[i]["template_matched"] and got[i]["template_id"] == "t" and got[i]["passed"], checks[i]
        assert checks[i]["document_found"] == "pass" and checks[i]["orb_geometry"] == "pass"
    assert not got["alone"]["template_matched"] and checks["alone"]["template_alignment"] == "not_applicable"
    value = next(c["value"] for c in got["alone"]["checks"] if c["key"] == "template_alignment")
    assert value == "missing_variant" and got["alone"]["passed"]


def test_a_photo_whose_corners_lie_on_a_line_is_not_measured(spark):
    data, _ = scene()
    flat = [(0.0, 0.0), (10.0, 10.0), (20.0, 20.0), (30.0, 30.0)]
    assert image.rectify(data, 640, 480, np.array(flat), 32, 20) is None
    rows = spark.createDataFrame([("a", "dz-id", 640, 480, data, flat)], "photo_id string, kind string, width int, height int, rgba binary, quad array<struct<x:double,y:double>>")
    assert assessment.analyse(rows).first()["sharpness"] is None
