"""Assessment of photos whose quadrilaterals are known: geometry, an upright image, its measurements, the threshold
checks, template and zone checks, and the gate. Finding quadrilaterals and features needs an image library; what follows
from them is here.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idloom import dims
from idloom.functions import numeric as N
from idloom.operators import image, quality

# The greatest and least width of an upright image, and the least share of a frame that a document fills
# and the greatest error of its aspect for a quadrilateral to be taken for one.
CANONICAL_WIDTH, LEAST_WIDTH, LEAST_SHARE, MAX_ASPECT_ERROR = 1024, 32, 0.12, 0.4
#: Pixels along a zone's side below which it doesn't count as visible.
LEAST_ZONE = 8
ZONE_METRICS = ("sharpness", "glare_ratio", "glare_blob", "paper")


def best_quad(candidates: DataFrame, *keys: str) -> DataFrame:
    """(…keys, quad): the largest plausible quadrilateral of each frame, its corners in order, the first of equal ones.
    ``candidates`` has (…keys, pos, points, width, height, kind), points as an array of four (x, y)."""
    frame = F.col("width") * F.col("height")

    def shaped(quad: Column) -> Column:
        error = N.geometry(quad, F.col("width"), F.col("height"), F.col("kind"))["aspect_error"]
        return F.struct(quad.alias("quad"), N.polygon_area(quad).alias("area"), error.alias("error"))

    # a one-element transform holds the ordered corners: as a column they would be put into each of their many uses
    one = F.get(F.transform(F.array(N.order_corners(F.col("points"))), shaped), 0)
    fits = F.when((F.col("_q.area") >= LEAST_SHARE * frame) & (F.col("_q.error") < MAX_ASPECT_ERROR), F.struct(F.col("_q.area").alias("area"), (-F.col("pos")).alias("pos")))
    best = candidates.select("*", one.alias("_q")).groupBy(*keys).agg(F.max_by(F.when(fits.isNotNull(), F.col("_q.quad")), fits).alias("quad"))
    return best.where("quad IS NOT NULL")


def upright_size(width_px: float, passport: bool) -> tuple[int, int]:
    """Width and height of the upright image: never larger than the document in the photo."""
    aspect = N.PASSPORT_MM[0] / N.PASSPORT_MM[1] if passport else N.CARD_MM[0] / N.CARD_MM[1]
    width = max(LEAST_WIDTH, int(np.floor(min(CANONICAL_WIDTH, width_px) + 0.5)))
    return width, int(np.floor(width / aspect + 0.5))


def analyse(photos: DataFrame, zones: bool = False, profile: dict | None = None) -> DataFrame:
    """``photos`` (photo_id, kind, width, height, rgba, quad, and with ``zones`` an array of (id, x, y, w, h) in shares)
    with the geometry's columns and the measurements of the upright image; both are null where there is no quad or the
    buffer has a wrong length, and the measurements where the corners lie on a line. Zone measurements come as an array of (id, visible, sharpness, …)."""
    shape = F.when(F.col("quad").isNotNull(), N.geometry(F.col("quad"), F.col("width"), F.col("height"), F.col("kind")))
    known = photos.withColumn("_g", shape).select("*", "_g.*").drop("_g")
    limits = dims.PROFILE | (profile or {})
    colour = {"color_value": limits["minColorGlareValue"], "color_saturation": limits["minColorGlareSaturation"]}
    names = [c for c in known.columns if c not in ("rgba", "zones")]
    parts = ", ".join(f"{m}: double" for m in ZONE_METRICS)
    measured = f"array<struct<id: string, visible: boolean, {parts}>>"
    types = dict(known.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in names] + [f"{m} double" for m in image.METRICS] + [f"zone_metrics {measured}"])
    zone_type = pa.list_(pa.struct([("id", pa.string()), ("visible", pa.bool_()), *((m, pa.float64()) for m in ZONE_METRICS)]))

    def one(row: dict) -> tuple[dict | None, list | None]:
        w, h, data, quad = row["width"], row["height"], row["rgba"], row["quad"]
        if not (w and h and data and quad) or len(data) != w * h * 4:
            return None, None
        out_w, out_h = upright_size(row["width_px"], row["kind"].endswith("passport"))
        upright = image.rectify(data, w, h, np.array([[p["x"], p["y"]] for p in quad]), out_w, out_h)
        if upright is None:
            return None, None
        found = []
        for z in (row.get("zones") or []) if zones else []:
            x, y = max(0, int(np.floor(z["x"] * out_w))), max(0, int(np.floor(z["y"] * out_h)))
            zw, zh = min(out_w - x, int(np.ceil(z["w"] * out_w))), min(out_h - y, int(np.ceil(z["h"] * out_h)))
            if zw < LEAST_ZONE or zh < LEAST_ZONE:
                found.append({"id": z["id"], "visible": False})
                continue
            m = image.measure(np.ascontiguousarray(upright[y : y + zh, x : x + zw]).tobytes(), zw, zh, **colour)
            found.append({"id": z["id"], "visible": True} | {k: m[k] for k in ZONE_METRICS})
        return image.measure(upright.tobytes(), out_w, out_h, **colour), found

    def run(batches):
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):  # one photo at a time: buffers are large
                part = batch.slice(i, 1)
                metrics, found = one({n: part.column(k)[0].as_py() for n, k in at.items()})
                columns = [part.column(at[c]) for c in names] + [pa.array([metrics and metrics[m]], pa.float64()) for m in image.METRICS]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([found], zone_type)], names=[*names, *image.METRICS, "zone_metrics"])

    return known.select(*names, "rgba", *(["zones"] if zones else [])).mapInArrow(run, schema)


def _check(key: Column | str, passed: Column, value: Column, hint: str = "wrong_document") -> Column:
    key = F.lit(key) if isinstance(key, str) else key
    passed = F.coalesce(passed, F.lit(False))
    return F.struct(key.alias("key"), passed.alias("passed"), F.when(passed, "pass").otherwise("fail").alias("status"), value.cast("string").alias("value"), F.lit(hint).alias("hint")).cast(quality.CHECK)


def assess(photos: DataFrame, alignments: DataFrame | None = None, mode: str = "enforce", zones: bool = False, profile: dict | None = None, severity: dict | None = None) -> DataFrame:
    """(photo_id, checks, template_matched, template_id, passed, hint, score) of every photo.

    ``alignments`` has (photo_id, template_id, matched, inlier_ratio, coverage, error, plausible); the best template of a
    photo counts. A photo with a group_id whose group has no template gets a check that isn't applicable. Zones are looked at only where a template matched. Mode ``off`` makes no checks; only ``enforce`` lets
    a failed check fail the photo."""
    limits = dims.PROFILE | (profile or {})
    rows = analyse(photos, zones, profile).withColumn("corner_motion", F.lit(None).cast("double"))
    rows = quality.evaluate(rows, profile, severity)
    nothing = F.array().cast(f"array<{quality.CHECK}>")
    matched, extra = F.lit(False), nothing
    if alignments is not None:
        order = Window.partitionBy("photo_id").orderBy(F.desc("matched"), F.desc("inlier_ratio"), "error", "template_id")
        best = alignments.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("photo_id", F.struct(*[c for c in alignments.columns if c != "photo_id"]).alias("_t"))
        rows = rows.join(best, "photo_id", "left")
        t = F.col("_t")
        matched = F.coalesce(t["matched"], F.lit(False))
        template = F.array(
            _check("template_alignment", t["matched"], t["inlier_ratio"]),
            _check("orb_spatial_coverage", t["coverage"] >= dims.ORB["minSpatialCoverage"], t["coverage"], "move_closer"),
            _check("orb_reprojection", t["error"] <= dims.ORB["maxReprojectionError"], t["error"], "hold_parallel"),
            _check("orb_geometry", t["plausible"], t["plausible"], "hold_parallel"),
        )
        extra = F.when(t.isNotNull(), template).otherwise(nothing)
        if "group_id" in rows.columns:
            missing = _check("template_alignment", F.lit(False), F.lit("missing_variant")).withField("status", F.lit("not_applicable"))
            extra = F.when(t.isNull() & F.col("group_id").isNotNull(), F.array(missing)).otherwise(extra)
    if zones:
        key = lambda z, name: F.concat(F.lit("zone:"), z["id"], F.lit(f":{name}"))
        glare = lambda z: (z["glare_ratio"] <= limits["maxGlareRatio"]) & (z["glare_blob"] <= limits["maxGlareBlob"])
        seen = lambda z: F.array(_check(key(z, "sharpness"), z["sharpness"] >= limits["minSharpness"], N.round_half_up(z["sharpness"]), "focus"), _check(key(z, "glare"), glare(z), N.round_half_up(z["glare_ratio"], 4), "avoid_glare"), _check(key(z, "exposure"), z["paper"].between(limits["exposureMin"], limits["exposureMax"]), z["paper"], "more_light"))
        gone = lambda z: F.array(_check(key(z, "visible"), F.lit(False), F.lit("missing"), "show_whole_document"))
        local = F.flatten(F.transform("zone_metrics", lambda z: F.when(z["visible"], seen(z)).otherwise(gone(z))))
        extra = F.concat(extra, F.when(matched & F.col("zone_metrics").isNotNull(), local).otherwise(nothing))
    checks = nothing if mode == "off" else F.concat("checks", extra)
    rows = rows.withColumns({"checks": checks, "template_matched": matched, "_aligned": F.col("_t").isNotNull() if alignments is not None else F.lit(False)})
    failed = F.get(F.filter("checks", lambda c: c["status"] == "fail"), 0)
    hint = F.coalesce(failed["hint"], F.when(F.col("template_matched") | ~F.col("_aligned"), F.col("hint")).otherwise("wrong_document"))
    template_id = F.col("_t.template_id") if alignments is not None else F.lit(None).cast("string")
    return rows.select("photo_id", "checks", "template_matched", template_id.alias("template_id"), quality.gate(mode, F.col("checks")).alias("passed"), hint.alias("hint"), "score")


def template_version(existing: DataFrame, created: DataFrame, now: str) -> DataFrame:
    """Templates to append: the next version of each created or updated one (1 for a new one), with the parameters that
    were in force, and the time of the first version kept. Both have (id, document_kind, descriptors, …); ``existing``
    also has version and created_at."""
    last = existing.groupBy("id").agg(F.max("version").alias("_v"), F.min("created_at").alias("_t"))
    parameters = F.struct(*[F.lit(v).alias(k) for k, v in dims.ORB.items()])
    rows = created.join(last, "id", "left").withColumns({"version": F.coalesce("_v", F.lit(0)) + 1, "created_at": F.coalesce("_t", F.lit(now)), "updated_at": F.lit(now), "parameters": parameters})
    return rows.drop("_v", "_t")
