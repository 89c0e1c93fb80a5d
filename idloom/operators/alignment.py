"""Alignment of photos with templates: descriptors to matches, matches to a map, maps to the best template of a photo.

Templates are packed into one row each; a photo's features into blocks, so that a photo with many of them is spread over
tasks. A block meets the templates of its photo's group and yields the matches that pass the ratio test: a template is
whole in its row, so the two nearest descriptors are final and nothing is merged. The matches of one (photo, template)
then meet in one row, and a single Arrow pass solves many of these at once: hypotheses from four points each in closed
form, inliers counted by one matrix product a slab, the best refitted to its inliers by least squares.

Defined cases: a photo or template without features, one with fewer good matches than its template asks for, and points
that lie on a line give an unmatched row (ratio and coverage 0, error infinite, no map); a photo whose group has no
template gives no row. Features with a null id, place or descriptor don't count, nor those whose descriptor has another
length than the first of their block or template. Of equal distances the template's
smaller feature id is nearest. Results don't depend on how rows are dealt out: matches are ordered by feature id, and the
points of hypotheses come from a fixed seed and the number of matches only.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idloom import dims
from idloom.functions import numeric as N
from idloom.operators import assessment, matching

#: Features of a photo that are compared together.
BLOCK = 1024
#: Hypotheses for each pair, and numbers that a slab of pairs may hold while their inliers are counted.
HYPOTHESES, SLAB = 500, 4 << 20
#: Packed templates up to this measured size are broadcast; beyond it they are joined by a shuffle, copied to SALTS.
BROADCAST_BYTES, SALTS = 16 << 20, 16
_FEATURE = "struct<id: bigint, x: double, y: double, d: binary>"
_MATCH = "struct<id: bigint, x: double, y: double, tx: double, ty: double>"
_PARAMETERS = {"ratio": "ratioThreshold", "min_good": "minimumGoodMatches", "min_inlier_ratio": "minimumInlierRatio", "threshold": "ransacThreshold"}
# The least and greatest share of the template's area that the projected photo takes, and how far beyond
# the template its corners may lie, as a share of the template's sides.
LEAST_AREA, GREATEST_AREA, MARGIN = 0.3, 2.2, 0.35


# ---------------------------------------------------------------- matches


def _features(rows: DataFrame, *keys: str) -> DataFrame:
    feature = F.struct(F.col("feature_id").cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("descriptor").alias("d"))
    known = [F.col(c).isNotNull() for c in ("feature_id", "x", "y", "descriptor")]
    return rows.where(known[0] & known[1] & known[2] & known[3]).select(*keys, feature.alias("_f"))


def packed_templates(templates: DataFrame, features: DataFrame) -> DataFrame:
    """``templates`` (template_id, group_id, width, height and, where they differ from the profile's, ratio, min_good,
    min_inlier_ratio, threshold) with their ``features`` (template_id, feature_id, x, y, descriptor) as an array."""
    own = _features(features, "template_id").groupBy("template_id").agg(F.array_sort(F.collect_list("_f")).alias("_features"))
    given = templates.columns
    parameters = [(F.coalesce(F.col(c), F.lit(dims.ORB[name])) if c in given else F.lit(dims.ORB[name])).cast("double").alias(c) for c, name in _PARAMETERS.items()]
    rows = templates.select("template_id", "group_id", F.col("width").cast("double").alias("t_width"), F.col("height").cast("double").alias("t_height"), *parameters)
    return rows.join(own, "template_id", "left").withColumn("_features", F.coalesce("_features", F.array().cast(f"array<{_FEATURE}>")))


def _photo_blocks(photos: DataFrame, features: DataFrame) -> DataFrame:
    """(photo_id, group_id, width, height, _b, _block): a photo's features, BLOCK together; one empty block without any."""
    own = _features(features, "photo_id")
    parts = own.groupBy("photo_id").agg(F.ceil(F.count("*") / BLOCK).alias("_parts"))
    dealt = own.join(parts, "photo_id").withColumn("_b", F.pmod(F.xxhash64("_f.id"), F.col("_parts")))
    blocks = dealt.groupBy("photo_id", "_b").agg(F.collect_list("_f").alias("_block"))
    size = [F.col(c).cast("double").alias(c) for c in ("width", "height")]
    return photos.select("photo_id", "group_id", *size).join(blocks, "photo_id", "left").withColumn("_block", F.coalesce("_block", F.array().cast(f"array<{_FEATURE}>")))


def nearest_pair(queries: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the nearest reference, its Hamming distance, that of the second) of every query; descriptors are rows of
    bytes, references in the order that decides ties. Needs two references."""
    width = -(-queries.shape[1] // 8) * 8
    wide = lambda d: np.pad(d, ((0, 0), (0, width - d.shape[1]))).view(np.uint64)
    a, b = wide(queries), wide(references)
    first, one, two = (np.empty(len(a), np.int64) for _ in range(3))
    step = max(1, SLAB // max(b.size, 1))
    for start in range(0, len(a), step):
        d = np.bitwise_count(a[start : start + step, None, :] ^ b[None, :, :]).sum(2, dtype=np.int64)
        at = d.argmin(1)
        row = np.arange(len(d))
        one[start : start + step], first[start : start + step] = d[row, at], at
        d[row, at] = np.iinfo(np.int64).max
        two[start : start + step] = d.min(1)
    return first, one, two


def matches(photos: DataFrame, features: DataFrame, packed: DataFrame) -> DataFrame:
    """(photo_id, template_id, sizes and parameters, _matches) of every photo and every template of its group: the good
    matches, ordered by the photo's feature."""
    size = packed.agg(F.coalesce(F.sum(F.size("_features") * 64 + 128), F.lit(0))).first()[0]
    blocks = _photo_blocks(photos, features)
    if size <= BROADCAST_BYTES:
        both = blocks.join(F.broadcast(packed), "group_id")
    else:  # a group may hold most photos: its blocks are dealt out by a salt
        salted = blocks.withColumn("_salt", F.pmod(F.xxhash64("photo_id", "_b"), F.lit(SALTS)))
        copies = packed.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        both = salted.join(copies, ["group_id", "_salt"]).drop("_salt")
    names = ["photo_id", "template_id", "width", "height", "t_width", "t_height", *_PARAMETERS]
    types = dict(both.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in names) + f", _matches array<{_MATCH}>"
    match_type = pa.list_(pa.struct([("id", pa.int64()), *((c, pa.float64()) for c in ("x", "y", "tx", "ty"))]))

    def arrays(features: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        features = [f for f in features if len(f["d"]) == len(features[0]["d"])]
        return np.array([f["id"] for f in features], np.int64), np.array([(f["x"], f["y"]) for f in features], float).reshape(-1, 2), np.frombuffer(b"".join(f["d"] for f in features), np.uint8).reshape(len(features), len(features[0]["d"]) if features else 0)

    def run(batches):
        for batch in batches:
            at, found, sheets = {n: i for i, n in enumerate(batch.schema.names)}, [], {}
            ratios, ids = batch.column(at["ratio"]).to_pylist(), batch.column(at["template_id"]).to_pylist()
            for i in range(batch.num_rows):
                block = batch.column(at["_block"])[i].as_py()
                if ids[i] not in sheets:
                    sheets[ids[i]] = arrays(batch.column(at["_features"])[i].as_py())
                _, there, references = sheets[ids[i]]
                own: list = []
                if block and len(references) >= 2:
                    names_, here, queries = arrays(block)
                    if queries.shape[1] == references.shape[1]:
                        first, one, two = nearest_pair(queries, references)
                        for k in np.flatnonzero(one < ratios[i] * two).tolist():
                            own.append({"id": int(names_[k]), "x": here[k, 0], "y": here[k, 1], "tx": there[first[k], 0], "ty": there[first[k], 1]})
                found.append(own)
            yield pa.RecordBatch.from_arrays([*(batch.column(at[c]) for c in names), pa.array(found, match_type)], names=[*names, "_matches"])

    pairs = both.select(*names, "_block", "_features").mapInArrow(run, schema)
    keep = [F.first(c).alias(c) for c in names[2:]]
    return pairs.groupBy("photo_id", "template_id").agg(*keep, F.array_sort(F.flatten(F.collect_list("_matches"))).alias("_matches"))


# ---------------------------------------------------------------- consensus of many pairs at once


@lru_cache(maxsize=4096)
def picks(n: int, rounds: int = HYPOTHESES, seed: int = 1) -> np.ndarray:
    """``rounds`` choices of four different ones of ``n``."""
    rng = np.random.default_rng((seed, n))
    return np.argsort(rng.random((rounds, n)), axis=1)[:, :4] if n < 64 else _distinct(rng, n, rounds)


def _distinct(rng: np.random.Generator, n: int, rounds: int) -> np.ndarray:
    """Four different numbers a row: the k-th is drawn among those left and moved past the ones before it."""
    out = np.empty((rounds, 4), np.int64)
    for k in range(4):
        drawn = rng.integers(0, n - k, rounds)
        for before in np.sort(out[:, :k], axis=1).T:
            drawn += drawn >= before
        out[:, k] = drawn
    return out


def _basis(p: np.ndarray) -> np.ndarray:
    """The map of the projective basis to four points (…, 4, 2): columns are the first three, scaled so that they sum to
    the fourth."""
    h = np.concatenate([p, np.ones((*p.shape[:-1], 1))], axis=-1)
    a, b, c, d = (h[..., k, :] for k in range(4))
    weights = np.stack([(d * np.cross(b, c)).sum(-1), (d * np.cross(c, a)).sum(-1), (d * np.cross(a, b)).sum(-1)], axis=-1)
    return np.stack([a, b, c], axis=-1) * weights[..., None, :]


def _adjugate(m: np.ndarray) -> np.ndarray:
    r = [m[..., k, :] for k in range(3)]
    return np.stack([np.cross(r[1], r[2]), np.cross(r[2], r[0]), np.cross(r[0], r[1])], axis=-1)


def four_point_maps(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Maps (…, 3, 3) of four points to four points in closed form; NaN where three of them lie on a line."""
    h = _basis(dst) @ _adjugate(_basis(src))
    with np.errstate(all="ignore"):
        h = h / np.abs(h).max(axis=(-2, -1), keepdims=True)
        usable = (np.abs(np.linalg.det(h)) > 1e-12) & (np.abs(h[..., 2, 2]) > 1e-9)
        h = np.where(usable[..., None, None], h / h[..., 2:3, 2:3], np.nan)
    return h


def _normal(points: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The similarity (…, 3, 3) that moves weighted points to mean 0 and mean distance sqrt 2."""
    n = weight.sum(1)[:, None]
    mean = (points * weight[..., None]).sum(1) / n
    spread = (np.hypot(*np.moveaxis(points - mean[:, None], -1, 0)) * weight).sum(1) / n[:, 0]
    s = np.sqrt(2) / np.maximum(spread, 1e-12)
    out = np.zeros((len(points), 3, 3))
    out[:, 0, 0] = out[:, 1, 1] = s
    out[:, :2, 2], out[:, 2, 2] = -s[:, None] * mean, 1
    return out


def refit(src: np.ndarray, dst: np.ndarray, inlier: np.ndarray) -> np.ndarray:
    """Least-squares maps (pairs, 3, 3) of padded points (pairs, points, 2) with their inliers."""
    weight = inlier.astype(float)
    t_src, t_dst = _normal(src, weight), _normal(dst, weight)
    a = src @ np.swapaxes(t_src[:, :2, :2], 1, 2) + t_src[:, None, :2, 2]
    b = dst @ np.swapaxes(t_dst[:, :2, :2], 1, 2) + t_dst[:, None, :2, 2]
    x, y, u, v, zero, one = a[..., 0], a[..., 1], b[..., 0], b[..., 1], np.zeros(weight.shape), np.ones(weight.shape)
    rows = np.concatenate([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y], -1), np.stack([zero, zero, zero, x, y, one, -v * x, -v * y], -1)], axis=1)
    goal, twice = np.concatenate([u, v], axis=1), np.concatenate([weight, weight], axis=1)
    square = np.einsum("gmi,gm,gmj->gij", rows, twice, rows, optimize=True)
    h = np.einsum("gij,gj->gi", np.linalg.pinv(square, rcond=1e-13, hermitian=True), np.einsum("gmi,gm,gm->gi", rows, twice, goal, optimize=True))
    maps = np.concatenate([h, np.ones((len(h), 1))], axis=1).reshape(-1, 3, 3)
    maps = np.linalg.inv(t_dst) @ maps @ t_src
    with np.errstate(all="ignore"):
        return maps / maps[:, 2:3, 2:3]


def project(maps: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Points (pairs, points, 2) under their pair's map."""
    with np.errstate(all="ignore"):
        q = np.concatenate([points, np.ones((*points.shape[:-1], 1))], axis=-1) @ np.swapaxes(maps, 1, 2)
        return q[..., :2] / q[..., 2:]


def consensus_many(groups: list[tuple[np.ndarray, np.ndarray]], thresholds: list[float]) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """(map, inliers) of every pair of point lists (source, target), each by the same random sample consensus: the
    hypothesis with the most inliers (the first of equal ones), refitted to them. Pairs are solved in slabs of about
    equal sizes; what a pair gets doesn't depend on the others."""
    out: list[tuple[np.ndarray | None, np.ndarray]] = [(None, np.zeros(len(s), bool)) for s, _ in groups]
    order = sorted((i for i, (s, _) in enumerate(groups) if len(s) >= 4), key=lambda i: len(groups[i][0]))
    start = 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and (stop + 1 - start) * HYPOTHESES * len(groups[order[stop]][0]) <= SLAB:
            stop += 1
        own = order[start:stop]
        start, most = stop, len(groups[own[-1]][0])
        src, dst, real = np.zeros((len(own), most, 2)), np.zeros((len(own), most, 2)), np.zeros((len(own), most), bool)
        for g, i in enumerate(own):
            n = len(groups[i][0])
            src[g, :n], dst[g, :n], real[g, :n] = *groups[i], True
        chosen = np.stack([picks(len(groups[i][0])) for i in own])
        g = np.arange(len(own))[:, None, None]
        maps = four_point_maps(src[g, chosen], dst[g, chosen])
        limit = np.array([thresholds[i] for i in own])
        counts = np.zeros(maps.shape[:2], np.int64)
        homogeneous = np.swapaxes(np.concatenate([src, np.ones((*src.shape[:2], 1))], axis=2), 1, 2)
        with np.errstate(all="ignore"):
            at = 0
            while at < HYPOTHESES:  # one slab of hypotheses where a single pair is larger than a slab
                part = maps[:, at : at + max(1, SLAB // (len(own) * most))]
                q = (part.reshape(len(own), -1, 3) @ homogeneous).reshape(*part.shape[:2], 3, most)
                off = (q[:, :, 0] / q[:, :, 2] - dst[:, None, :, 0]) ** 2 + (q[:, :, 1] / q[:, :, 2] - dst[:, None, :, 1]) ** 2
                counts[:, at : at + part.shape[1]] = ((off <= limit[:, None, None] ** 2) & real[:, None]).sum(2)
                at += part.shape[1]
        best = maps[np.arange(len(own)), counts.argmax(1)]
        off = project(best, src) - dst
        with np.errstate(all="ignore"):
            inlier = (np.hypot(off[..., 0], off[..., 1]) <= limit[:, None]) & real
        enough = inlier.sum(1) >= 4
        if enough.any():
            fitted = refit(src[enough], dst[enough], inlier[enough])
            for k, h in zip(np.flatnonzero(enough).tolist(), fitted, strict=True):
                n = len(groups[own[k]][0])
                out[own[k]] = (h if np.isfinite(h).all() and abs(np.linalg.det(h)) > 1e-9 else None, inlier[k, :n])
    return out


# ---------------------------------------------------------------- alignments


ALIGNED = "photo_id {photo}, template_id {template}, good long, inliers long, matched boolean, inlier_ratio double, coverage double, error double, plausible boolean, homography array<double>, quad array<struct<x: double, y: double>>"


def plausible(corners: np.ndarray, width: float, height: float) -> bool:
    """Whether a photo's corners, in the template's plane, can be those of a whole document."""
    x, y = corners[:, 0], corners[:, 1]
    area = abs(float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())) / 2
    inside = (x >= -width * MARGIN) & (x <= width * (1 + MARGIN)) & (y >= -height * MARGIN) & (y <= height * (1 + MARGIN))
    return bool(np.isfinite(corners).all() and LEAST_AREA <= area / (width * height) <= GREATEST_AREA and inside.all())


def solved(pairs: DataFrame) -> DataFrame:
    """Alignments of the pairs that ``matches`` makes: good matches and inliers, their ratio, the coverage of the photo by
    the inliers' box, the mean error of the map, whether it is plausible, and the template's corners in the photo."""
    types = dict(pairs.dtypes)
    names = [x.split()[0] for x in ALIGNED.split(", ") if not x.startswith("y:")]

    def one(row: dict, points: np.ndarray, h: np.ndarray | None, inlier: np.ndarray) -> dict:
        blank = {"good": len(points), "inliers": 0, "matched": False, "inlier_ratio": 0.0, "coverage": 0.0, "error": float("inf"), "plausible": False, "homography": None, "quad": None}
        if h is None or len(points) < row["min_good"]:
            return blank
        w, ht, tw, th = row["width"], row["height"], row["t_width"], row["t_height"]
        n, own = int(inlier.sum()), points[inlier]
        ratio = n / len(points)
        span = own[:, :2].max(0) - own[:, :2].min(0)
        coverage = float(span[0] * span[1] / (w * ht)) if n >= 4 else 0.0
        error = float(np.hypot(*(project(h[None], own[None, :, :2])[0] - own[:, 2:]).T).mean())
        fits = plausible(project(h[None], np.array([[[0, 0], [w, 0], [w, ht], [0, ht]]], float))[0], tw, th)
        back = project(np.linalg.inv(h)[None], np.array([[[0, 0], [tw, 0], [tw, th], [0, th]]], float))[0]
        matched = ratio >= row["min_inlier_ratio"] and coverage >= dims.ORB["minSpatialCoverage"] and error <= dims.ORB["maxReprojectionError"] and fits
        quad = [{"x": float(x), "y": float(y)} for x, y in back] if np.isfinite(back).all() else None
        return blank | {"inliers": n, "matched": bool(matched), "inlier_ratio": ratio, "coverage": coverage, "error": error, "plausible": fits, "homography": h.ravel().tolist(), "quad": quad}

    def run(batches):
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            rows = batch.select([n for n in at if n != "_matches"]).to_pylist()
            found = [np.array([(m["x"], m["y"], m["tx"], m["ty"]) for m in own], float).reshape(-1, 4) for own in batch.column(at["_matches"]).to_pylist()]
            tried = [p if len(p) >= r["min_good"] else p[:0] for p, r in zip(found, rows, strict=True)]
            maps = consensus_many([(p[:, :2], p[:, 2:]) for p in tried], [r["threshold"] for r in rows])
            made = [one(r, p, *m) for r, p, m in zip(rows, found, maps, strict=True)]
            point = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
            kinds = dict(zip(names[2:], (pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.list_(pa.float64()), point), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(at["photo_id"]), batch.column(at["template_id"]), *(pa.array([m[c] for m in made], k) for c, k in kinds.items())], names=names)

    out = pairs.mapInArrow(run, ALIGNED.format(photo=types["photo_id"], template=types["template_id"]))
    return out.withColumns({c: N.round_half_up(F.col(c), 4) for c in ("inlier_ratio", "coverage")} | {"error": F.when(F.col("error") < float("inf"), N.round_half_up(F.col("error"), 4)).otherwise(F.col("error"))})


def align_photos(photos: DataFrame, features: DataFrame, templates: DataFrame, template_features: DataFrame) -> DataFrame:
    """Every photo against every template of its group. ``photos`` has (photo_id, group_id, width, height), ``features``
    (photo_id, feature_id, x, y, descriptor); for the others see ``packed_templates``."""
    return solved(matches(photos, features, packed_templates(templates, template_features)))


def best_alignments(aligned: DataFrame) -> DataFrame:
    """The best template of every photo."""
    return matching.best_template(aligned, "photo_id")


# ---------------------------------------------------------------- assessment


def _moved(best: DataFrame) -> DataFrame:
    """``best`` with its quad in the coordinates of the photo that was made upright by ``source_quad`` (null: as it is)."""
    point = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
    names = best.columns

    def run(batches):
        for batch in batches:
            at, quads = {n: i for i, n in enumerate(names)}, []
            for row in batch.select(["quad", "source_quad", "width", "height"]).to_pylist():
                quad, source = row["quad"], row["source_quad"]
                if quad and source:
                    p = matching.to_source([[c["x"], c["y"]] for c in quad], [[c["x"], c["y"]] for c in source], row["width"] + 1, row["height"] + 1)
                    quad = None if p is None else [{"x": float(x), "y": float(y)} for x, y in p]
                quads.append(quad)
            yield pa.RecordBatch.from_arrays([pa.array(quads, point) if n == "quad" else batch.column(at[n]) for n in names], names=names)

    return best.mapInArrow(run, best.schema)


def assess_aligned(photos: DataFrame, features: DataFrame, templates: DataFrame, template_features: DataFrame, mode: str = "enforce", zones: bool = False, profile: dict | None = None, severity: dict | None = None) -> DataFrame:
    """The whole assessment of photos with features: aligned with the templates of their group, the outline taken from the
    best template where one matched, then measured and checked as by ``assessment.assess``.

    ``photos`` has (photo_id, group_id, kind, width, height, rgba, quad, and with ``zones`` also zones). Features are
    those of the upright image where there is a quad, whose size is (upright_width, upright_height), else of the photo.
    """
    upright = [F.coalesce(F.col(f"upright_{c}"), F.col(c)).alias(c) if f"upright_{c}" in photos.columns else F.col(c) for c in ("width", "height")]
    sizes = photos.select("photo_id", "group_id", *upright)
    best = best_alignments(align_photos(sizes, features, templates, template_features))
    found = best.where("matched").join(sizes.drop("group_id"), "photo_id").join(photos.select("photo_id", F.col("quad").alias("source_quad")), "photo_id")
    quads = _moved(found.select("photo_id", "quad", "source_quad", "width", "height")).select("photo_id", F.col("quad").alias("_quad"))
    outlined = photos.join(quads, "photo_id", "left").withColumn("quad", F.coalesce("_quad", F.col("quad").cast("array<struct<x: double, y: double>>"))).drop("_quad")
    return assessment.assess(outlined, best.select("photo_id", "template_id", "matched", "inlier_ratio", "coverage", "error", "plausible"), mode, zones, profile, severity)


