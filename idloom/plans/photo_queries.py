"""Queries of frames, corners and profiles: the 18 checks, plane geometry, and the bounds of a profile."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom import dims
from idloom.functions import numeric as N
from idloom.operators import assessment, quality, reports
from idloom.plans.common import table

# Measurements of frames made from line items: (name, Spark and DuckDB expression of it).
_Q, _P, _S, _D, _T = "l_quantity", "l_partkey", "l_suppkey", "l_discount", "l_tax"
_METRICS = {
    "fill": "(l_quantity + 50) / 100", "margin": "l_discount / 4", "aspect_error": "l_tax * 2", "angle_deviation": "l_quantity / 3", "side_ratio": "1 + l_discount * 3", "dpi": "200 + l_quantity",
    "corner_motion": "l_tax / 4", "sharpness": "(l_partkey % 64) * 1.25", "motion_isotropy": "(l_suppkey % 8) / 8", "focus_uniformity": "(l_suppkey % 16) / 16", "paper": "90 + l_quantity * 3",
    "highlight_clip": "l_tax * 0.75", "shadow_clip": "l_discount * 1.5", "contrast": "(l_partkey % 32) / 32", "glare_ratio": "l_tax / 4", "glare_blob": "l_discount / 8", "color_glare_ratio": "l_discount / 2",
    "illumination": "(l_partkey % 16) / 16", "noise": "l_quantity / 6",
}
_GEOMETRY = ("fill", "margin", "aspect_error", "angle_deviation", "side_ratio", "dpi")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame a line: some without a document, some without an image, returned ones live (with motion)."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", _Q, _P, _S, _D, _T, "l_returnflag")
    columns = []
    for name, sql in _METRICS.items():
        there = "l_linenumber <> 7" if name in _GEOMETRY else "l_returnflag <> 'N'" if name == "corner_motion" else "l_partkey % 11 <> 0"
        columns.append(F.expr(f"CASE WHEN {there} THEN CAST({sql} AS DOUBLE) END").alias(name))
    return li.select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("live"), *columns)


def frame_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 18 checks of every frame, what follows from them, and a compact report."""
    rows = quality.evaluate_flat(_frames(spark, sf_dir), live=F.col("live"))
    names = [c.removeprefix("status_") for c in rows.columns if c.startswith("status_")]
    shown = F.concat_ws(",", *[F.concat(F.lit(f"{n}="), F.col(f"status_{n}")) for n in names])
    return rows.select("l_orderkey", "l_linenumber", "live", shown.alias("shown"), quality.message_of(F.col("first_hint")).alias("first_message"), "passed", "flawless", "hint", "score", F.lit(True).alias("observed"), F.col("passed").alias("enforced"))


_CHECKS = [
    ("document_found", "true", "fill IS NOT NULL", "fail", "'find_document'"),
    ("document_inside", "fill IS NOT NULL", "margin >= 0.012", "fail", "'show_whole_document'"),
    ("document_fill", "fill IS NOT NULL", "fill >= 0.6 AND fill <= 0.97", "fail", "CASE WHEN fill < 0.6 THEN 'move_closer' ELSE 'move_back' END"),
    ("aspect_ratio", "fill IS NOT NULL", "aspect_error <= 0.14", "fail", "'wrong_document'"),
    ("perspective", "fill IS NOT NULL", "angle_deviation <= 14 AND side_ratio <= 1.22", "fail", "'hold_parallel'"),
    ("resolution", "fill IS NOT NULL", "dpi >= 220", "fail", "'move_closer'"),
    ("stability", "live AND corner_motion IS NOT NULL", "corner_motion <= 0.012", "fail", "'hold_still'"),
    ("sharpness", "sharpness IS NOT NULL", "sharpness >= 40", "fail", "'focus'"),
    ("motion_blur", "sharpness IS NOT NULL", "motion_isotropy >= 0.3", "warn", "'hold_still'"),
    ("focus_uniformity", "sharpness IS NOT NULL", "focus_uniformity >= 0.15", "warn", "'hold_parallel'"),
    ("exposure", "sharpness IS NOT NULL", "paper >= 105 AND paper <= 225", "fail", "CASE WHEN paper < 105 THEN 'more_light' ELSE 'less_light' END"),
    ("highlights", "sharpness IS NOT NULL", "highlight_clip <= 0.04", "fail", "'less_light'"),
    ("shadows_clipped", "sharpness IS NOT NULL", "shadow_clip <= 0.12", "warn", "'more_light'"),
    ("contrast", "sharpness IS NOT NULL", "contrast >= 0.35", "warn", "'more_light'"),
    ("glare", "sharpness IS NOT NULL", "glare_ratio <= 0.012 AND glare_blob <= 0.006", "fail", "'avoid_glare'"),
    ("color_glare", "sharpness IS NOT NULL", "color_glare_ratio <= 0.03", "warn", "'avoid_glare'"),
    ("illumination", "sharpness IS NOT NULL", "illumination >= 0.62", "fail", "'even_light'"),
    ("noise", "sharpness IS NOT NULL", "noise <= 6", "warn", "'more_light'"),
]
_METRIC_SQL = ", ".join("CASE WHEN {} THEN CAST({} AS DOUBLE) END AS {}".format("l_linenumber <> 7" if n in _GEOMETRY else "l_returnflag <> 'N'" if n == "corner_motion" else "l_partkey % 11 <> 0", sql, n) for n, sql in _METRICS.items())
_LIST = ", ".join(f"CASE WHEN {applies} THEN {{'k': '{key}', 's': CASE WHEN {met} THEN 'pass' ELSE '{bad}' END, 'h': {hint}}} END" for key, applies, met, bad, hint in _CHECKS)
_MESSAGES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dims.HINTS.items())
_FRAME_CHECKS = f"""
WITH f AS (SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS live, {_METRIC_SQL} FROM lineitem),
c AS (SELECT *, list_filter([{_LIST}], lambda x: x IS NOT NULL) AS cs FROM f),
d AS (SELECT *, list_filter(cs, lambda x: x.s = 'fail') AS fs, list_filter(cs, lambda x: x.s = 'warn') AS ws, list_filter(cs, lambda x: x.s <> 'pass') AS bs FROM c)
SELECT l_orderkey, l_linenumber, live, array_to_string(list_transform(cs, lambda x: x.k || '=' || x.s), ',') AS shown, CASE bs[1].h {_MESSAGES} END AS first_message, len(fs) = 0 AS passed, len(fs) = 0 AND len(ws) = 0 AS flawless,
  coalesce(fs[1].h, ws[1].h, 'ready') AS hint, CASE WHEN sharpness IS NULL THEN 0.0 ELSE floor((0.45 * greatest(0.0, least(1.0, sharpness / 120.0)) + 0.15 * greatest(0.0, least(1.0, 1 - abs(paper - 165.0) / 60.0))
  + 0.15 * greatest(0.0, least(1.0, 1 - glare_ratio / 0.024)) + 0.25 * greatest(0.0, least(1.0, illumination))) * 10000 + 0.5) / 10000 END AS score, true AS observed, len(fs) = 0 AS enforced FROM d
"""


def frame_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each check of live frames is met."""
    return quality.status_counts(_frames(spark, sf_dir).where("live"), live=True)


_TELEMETRY = f"""
WITH f AS (SELECT true AS live, {_METRIC_SQL} FROM lineitem WHERE l_returnflag = 'R'), c AS (SELECT unnest([{_LIST}]) AS c FROM f)
SELECT c.k AS check_id, c.s AS status, count(*) AS n FROM c WHERE c IS NOT NULL GROUP BY 1, 2
"""

# ---------------------------------------------------------------- plane geometry


def _corners(*shuffled: int):
    """A quadrilateral of a part in a frame of 640 x 400: a turned card with its corners in the given order."""
    x, y, w = F.col("p_size") * 4.0, F.col("p_size") * 2.0, F.lit(300.0) + F.col("p_partkey") % 64
    h, lean = F.lit(160.0) + F.col("p_partkey") % 32, (F.col("p_partkey") % 5) * 3.0
    all_ = [(x, y), (x + w, y + lean), (x + w - lean, y + h + lean), (x - lean, y + h)]
    return F.array(*[F.struct(all_[i][0].cast("double").alias("x"), all_[i][1].cast("double").alias("y")) for i in shuffled])


_CORNERS = """
c AS (SELECT p_partkey, x, y, x + w AS bx, y + lean AS by_, x + w - lean AS cx, y + h + lean AS cy, x - lean AS dx, y + h AS dy
  FROM (SELECT p_partkey, p_size * 4.0::DOUBLE AS x, p_size * 2.0::DOUBLE AS y, 300.0::DOUBLE + p_partkey % 64 AS w, 160.0::DOUBLE + p_partkey % 32 AS h, (p_partkey % 5) * 3.0::DOUBLE AS lean FROM part))
"""


def quad_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage, margin, aspect and dpi of turned cards, whose corners come in no order."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_size")
    rows = p.select("p_partkey", N.order_corners(_corners(2, 0, 3, 1)).alias("quad"))
    g = rows.select("p_partkey", "quad", N.geometry(F.col("quad"), F.lit(640.0), F.lit(400.0), F.lit("dz-id")).alias("g"))
    r = lambda c: N.round_half_up(c, 6)
    return g.select("p_partkey", F.col("quad")[0]["x"].alias("first_x"), F.col("quad")[1]["x"].alias("second_x"), r(N.polygon_area(F.col("quad"))).alias("area"), r(F.col("g.fill")).alias("fill"), r(F.col("g.margin")).alias("margin"), r(F.col("g.aspect_ratio")).alias("aspect_ratio"), r(F.col("g.aspect_error")).alias("aspect_error"), r(F.col("g.side_ratio")).alias("side_ratio"), r(F.col("g.width_px")).alias("width_px"), r(F.col("g.dpi")).alias("dpi"))


_R = "floor(({}) * 1000000 + 0.5) / 1000000"
_QUAD = f"""
WITH {_CORNERS}, m AS (SELECT *, abs(x * by_ - bx * y + bx * cy - cx * by_ + cx * dy - dx * cy + dx * y - x * dy) / 2 AS area, sqrt((bx - x) ** 2 + (by_ - y) ** 2) AS t, sqrt((cx - dx) ** 2 + (cy - dy) ** 2) AS b, sqrt((dx - x) ** 2 + (dy - y) ** 2) AS l, sqrt((cx - bx) ** 2 + (cy - by_) ** 2) AS r FROM c)
SELECT p_partkey, x AS first_x, bx AS second_x, {_R.format("area")} AS area, {_R.format("sqrt(area / 256000)")} AS fill, {_R.format("least(x, y, 640 - x, 400 - y, bx, by_, 640 - bx, 400 - by_, cx, cy, 640 - cx, 400 - cy, dx, dy, 640 - dx, 400 - dy) / 400")} AS margin,
  {_R.format("(t + b) / (l + r)")} AS aspect_ratio, {_R.format("abs((t + b) / (l + r) / (85.6::DOUBLE / 53.98::DOUBLE) - 1)")} AS aspect_error, {_R.format("greatest(greatest(t, b) / least(t, b), greatest(l, r) / least(l, r))")} AS side_ratio,
  {_R.format("least(t, b)")} AS width_px, {_R.format("least(t, b) / (85.6::DOUBLE / 25.4::DOUBLE)")} AS dpi FROM m
"""


def largest_quad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quadrilateral that is taken for a document among those of a brand's parts, if any is large and card-like."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice")
    wide = F.when(F.col("p_partkey") % 3 == 0, F.lit(0.2)).otherwise(1.0)
    points = F.transform(_corners(0, 1, 2, 3), lambda q: F.struct((q["x"] * wide).alias("x"), q["y"].alias("y")))
    rows = p.select(F.floor(F.col("p_partkey") / 10).alias("frame"), F.col("p_partkey").alias("pos"), points.alias("points"), F.lit(640.0).alias("width"), F.lit(400.0).alias("height"), F.lit("dz-id").alias("kind"))
    best = assessment.best_quad(rows, "frame")
    return best.select("frame", F.col("quad")[0]["x"].alias("x"), F.col("quad")[0]["y"].alias("y"), N.round_half_up(N.polygon_area(F.col("quad")), 4).alias("area"))


_LARGEST = f"""
WITH {_CORNERS}, m AS (SELECT *, abs(x * by_ - bx * y + bx * cy - cx * by_ + cx * dy - dx * cy + dx * y - x * dy) / 2 AS area, (sqrt((bx - x) ** 2 + (by_ - y) ** 2) + sqrt((cx - dx) ** 2 + (cy - dy) ** 2)) / (sqrt((dx - x) ** 2 + (dy - y) ** 2) + sqrt((cx - bx) ** 2 + (cy - by_) ** 2)) AS aspect FROM c WHERE p_partkey % 3 <> 0)
SELECT p_partkey // 10 AS frame, x, y, floor(area * 10000 + 0.5) / 10000 AS area FROM m WHERE area >= 30720 AND abs(aspect / (85.6::DOUBLE / 53.98::DOUBLE) - 1) < 0.4
QUALIFY row_number() OVER (PARTITION BY p_partkey // 10 ORDER BY area DESC, p_partkey) = 1
"""


def plane_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points through a map and back, corners moved from their centre, and unit corners."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_size")
    h = F.array(*[F.lit(float(x)) for x in (2, 0, 1, 0, 4, -3, 0, 0, 1)])
    point = F.struct(F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 7).cast("double").alias("y"))
    rows = p.select("p_partkey", "p_size", N.project(h, point).alias("there"), _corners(0, 1, 2, 3).alias("quad"))
    rows = rows.withColumns({"back": N.project(N.invert_homography(h), F.col("there")), "big": N.expand_quad(F.col("quad"), 1.5), "unit": N.scale_quad(F.col("quad"), F.lit(1 / 640), F.lit(1 / 400))})
    r = lambda c: N.round_half_up(c, 6)
    return rows.select("p_partkey", "there.x", "there.y", r(F.col("back.x")).alias("back_x"), r(F.col("back.y")).alias("back_y"), r(F.col("big")[0]["x"]).alias("big_x"), r(F.col("unit")[2]["y"]).alias("unit_y"))


_MAPS = f"""
WITH {_CORNERS} SELECT p_partkey, p_size * 2.0::DOUBLE + 1 AS x, (p_partkey % 7) * 4.0::DOUBLE - 3 AS y, p_size::DOUBLE AS back_x, (p_partkey % 7)::DOUBLE AS back_y,
  {_R.format("(c.x + bx + cx + dx) / 4 + (c.x - (c.x + bx + cx + dx) / 4) * 1.5")} AS big_x, {_R.format("cy * (1 / 400::DOUBLE)")} AS unit_y FROM part JOIN c USING (p_partkey)
"""


def crop_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels of a frame behind a guide on a viewport."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_size")
    guide = F.struct(*[v.alias(n) for n, v in (("x", F.lit(0.125)), ("y", (F.col("p_size") % 4) / 8), ("w", F.lit(0.75)), ("h", F.lit(0.25)))])
    c = N.crop_region(guide, F.lit(400.0), F.lit(800.0), F.lit(1920), F.lit(1080) + F.col("p_partkey") % 5 * 200)
    return p.select("p_partkey", c.alias("c")).select("p_partkey", "c.*")


_CROP = """
WITH g AS (SELECT p_partkey, (p_size % 4) / 8 AS gy, 1080 + p_partkey % 5 * 200 AS fh FROM part), z AS (SELECT *, greatest(400.0::DOUBLE / 1920, 800.0::DOUBLE / fh) AS zoom FROM g),
s AS (SELECT *, least(1920, 400 / zoom) AS sw, least(fh, 800 / zoom) AS sh FROM z),
q AS (SELECT *, greatest(0, least(1919, floor((1920 - sw) / 2 + 0.125 * sw)))::BIGINT AS x, greatest(0, least(fh - 1, floor((fh - sh) / 2 + gy * sh)))::BIGINT AS y FROM s)
SELECT p_partkey, x, y, greatest(x + 1, least(1920, ceil((1920 - sw) / 2 + 0.875 * sw)))::BIGINT - x AS width, greatest(y + 1, least(fh, ceil((fh - sh) / 2 + (gy + 0.25) * sh)))::BIGINT - y AS height FROM q
"""

# ---------------------------------------------------------------- profiles


def _profile() -> dict:
    """A profile with every number half way between its bounds (whole ones rounded down), the order kept."""
    out: dict = {"version": 2, "mode": "observe", "severity": dict(dims.SEVERITY)}
    for path, low, high, whole, _ in dims.PROFILE_BOUNDS:
        group, _, name = path.partition(".")
        value = (low + high) / 2
        out.setdefault(group, {})[name] = int(value) if whole else value
    for path in dims.PROFILE_SWITCHES:
        group, _, name = path.partition(".")
        out[group][name] = True
    for low, _ in dims.PROFILE_ORDER:
        group, _, name = low.partition(".")
        out[group][name] = next(a for p, a, *_ in dims.PROFILE_BOUNDS if p == low)
    return out


def profile_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles in which a part's size replaces one number by another: which parts of them are refused."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_size")
    paths = F.array(*[F.lit(b[0]) for b in dims.PROFILE_BOUNDS])
    rows = p.select("p_partkey", F.get(paths, (F.col("p_partkey") % len(dims.PROFILE_BOUNDS)).cast("int")).alias("path"), (F.col("p_size") / 32).alias("v"))
    mark = 0.0625123  # no number of the profile: its place is the changed one
    text = F.lit(None).cast("string")
    for path, *_ in dims.PROFILE_BOUNDS:
        group, _, name = path.partition(".")
        base = _profile()
        base[group][name] = mark
        text = F.when(F.col("path") == path, F.lit(json.dumps(base))).otherwise(text)
    rows = rows.select("p_partkey", "path", F.replace(text, F.lit(str(mark)), F.col("v").cast("string")).alias("profile"))
    return rows.select("p_partkey", "path", F.array_join(quality.profile_faults(F.col("profile")), ",").alias("faults"))


_ORDERED = {a: (b, next(h for p, _, h, *_ in dims.PROFILE_BOUNDS if p == b), next(l for p, l, *_ in dims.PROFILE_BOUNDS if p == b)) for a, b in dims.PROFILE_ORDER}
_FAULTS = """
WITH b AS (SELECT * FROM (VALUES {}) b(i, path, low, high, whole)), r AS (SELECT p_partkey, path, p_size / 32 AS v, low, high, whole FROM part JOIN b ON i = p_partkey % {})
SELECT p_partkey, path, concat_ws(',', CASE WHEN v < low OR v > high OR (whole AND v <> floor(v)) THEN path END, {}) AS faults FROM r
""".format(
    ", ".join(f"({i}, '{p}', {lo}, {hi}, {str(w).lower()})" for i, (p, lo, hi, w, _) in enumerate(dims.PROFILE_BOUNDS)),
    len(dims.PROFILE_BOUNDS),
    ", ".join(f"CASE WHEN path = '{a}' AND v >= {(lo + hi) / 2} THEN '{a}>={b}' END, CASE WHEN path = '{b}' AND v <= {next(l for p, l, *_ in dims.PROFILE_BOUNDS if p == a)} THEN '{a}>={b}' END" for a, (b, hi, lo) in _ORDERED.items()),
)


def flat_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements of frames under the names of a report."""
    g = F.create_map(F.lit("geometry"), F.create_map(F.lit("fill"), F.col("fill")), F.lit("image"), F.create_map(F.lit("noise"), F.col("noise"), F.lit("paper"), F.col("paper")))
    rows = _frames(spark, sf_dir).where("fill IS NOT NULL AND noise IS NOT NULL").select("l_orderkey", "l_linenumber", F.explode(reports.flatten_metrics(g)).alias("metric", "value"))
    return rows.groupBy("metric").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


_FLAT = """
WITH f AS (SELECT (l_quantity + 50) / 100 AS fill, l_quantity / 6 AS noise, 90 + l_quantity * 3 AS paper FROM lineitem WHERE l_linenumber <> 7 AND l_partkey % 11 <> 0),
v AS (SELECT unnest(['geometry.fill', 'image.noise', 'image.paper']) AS metric, unnest([floor(fill * 10000 + 0.5) / 10000, floor(noise * 10000 + 0.5) / 10000, paper]) AS value FROM f)
SELECT metric, count(*) AS n, min(value) AS low, max(value) AS high FROM v GROUP BY 1
"""


QUERIES = {
    "frame_checks": (frame_checks, _FRAME_CHECKS),
    "frame_telemetry": (frame_telemetry, _TELEMETRY),
    "quad_geometry": (quad_geometry, _QUAD),
    "largest_quad": (largest_quad, _LARGEST),
    "plane_maps": (plane_maps, _MAPS),
    "crop_regions": (crop_regions, _CROP),
    "profile_faults": (profile_faults, _FAULTS),
    "flat_metrics": (flat_metrics, _FLAT),
}
