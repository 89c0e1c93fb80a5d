"""The best frame of a burst, from the frames themselves: each analysed and judged, the best cropped to the guide's region,
its colour glare shown as a mask."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idloom import dims
from idloom.functions import numeric as N
from idloom.operators import assessment, image, quality

# The colour that marks glare, and its share of a marked pixel.
MARK, SHARE = (255, 30, 170), 0.7


def crop(rgba: bytes, width: int, x: int, y: int, w: int, h: int) -> bytes:
    return np.frombuffer(rgba, np.uint8).reshape(-1, width, 4)[y : y + h, x : x + w].tobytes()


def glare_mask(upright: np.ndarray, value: float, saturation: float) -> bytes:
    """The upright image with the pixels that may be coloured glare tinted."""
    px = upright.astype(np.float64)
    top, low = px[..., :3].max(2), px[..., :3].min(2)
    marked = (top >= value) & (top > 0) & (top - low >= saturation * top)
    out = upright.copy()
    out[marked, :3] = np.floor(px[marked, :3] * (1 - SHARE) + np.array(MARK) * SHARE + 0.5).clip(0, 255)
    return out.tobytes()


def best_of_frames(frames: DataFrame, profile: dict | None = None, severity: dict | None = None) -> DataFrame:
    """One row for each burst: (burst_id, frame_index, passed, score, hint, width, height, photo, mask, candidates).

    ``frames`` has (burst_id, pos, kind, width, height, rgba, quad) and may have guide (x, y, w, h in shares), view_w and
    view_h. Passed frames come before failed ones, then higher scores, then earlier frames. ``photo`` is the pixels behind
    the guide (all of them without one), ``mask`` the upright document with its glare marked (null without a document),
    ``candidates`` the verdicts of all frames in order. A frame with a buffer of a wrong length isn't measured and scores 0;
    if it is the best there is, the burst has no photo. Judging needs no pixels, so only the chosen frame's are kept."""
    limits = dims.PROFILE | (profile or {})
    judged = assessment.analyse(frames.withColumn("photo_id", F.struct("burst_id", "pos")), profile=profile).withColumn("corner_motion", F.lit(None).cast("double"))
    judged = quality.evaluate(judged, profile, severity).select("burst_id", "pos", "passed", "score", "hint", F.coalesce("sharpness", F.lit(0.0)).alias("sharpness"))
    # a burst has a handful of frames (eight at most by the profile's bounds), so this list stays short
    told = judged.groupBy("burst_id").agg(F.array_sort(F.collect_list(F.struct("pos", "score", "sharpness", "passed"))).alias("candidates"))
    best = quality.best_frame(judged, "burst_id").drop("sharpness")
    guided = "guide" in frames.columns
    region = N.crop_region(F.col("guide"), F.col("view_w"), F.col("view_h"), F.col("width"), F.col("height")) if guided else F.lit(None)
    whole = F.struct(F.lit(0).cast("double").alias("x"), F.lit(0).cast("double").alias("y"), F.col("width").cast("double").alias("w"), F.col("height").cast("double").alias("h"))
    as_numbers = F.struct(*[region[c].cast("double").alias(short) for c, short in (("x", "x"), ("y", "y"), ("width", "w"), ("height", "h"))]) if guided else whole
    chosen = best.join(frames.select("burst_id", "pos", "kind", "width", "height", "rgba", "quad", F.when(F.col("guide").isNotNull(), as_numbers).otherwise(whole).alias("_region") if guided else whole.alias("_region")), ["burst_id", "pos"])
    kinds = dict(frames.dtypes)
    schema = f"burst_id {kinds['burst_id']}, frame_index {kinds['pos']}, passed boolean, score double, hint string, width int, height int, photo binary, mask binary"

    def run(batches):
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                row = {n: part.column(at[n])[0].as_py() for n in ("kind", "width", "height", "rgba", "quad", "_region")}
                w, h, data, r = row["width"], row["height"], row["rgba"], row["_region"]
                photo = mask = None
                size = (0, 0)
                if w and h and data and len(data) == w * h * 4:
                    x, y = max(0, int(r["x"])), max(0, int(r["y"]))
                    size = (min(w - x, int(r["w"])), min(h - y, int(r["h"])))
                    photo = crop(data, w, x, y, *size)
                    if row["quad"]:
                        corners = np.array([[p["x"], p["y"]] for p in row["quad"]])
                        across = min(np.hypot(*(corners[1] - corners[0])), np.hypot(*(corners[2] - corners[3])))
                        upright = image.rectify(data, w, h, corners, *assessment.upright_size(float(across), row["kind"].endswith("passport")))
                        mask = None if upright is None else glare_mask(upright, limits["minColorGlareValue"], limits["minColorGlareSaturation"])
                made = [pa.array([size[0]], pa.int32()), pa.array([size[1]], pa.int32()), pa.array([photo], pa.binary()), pa.array([mask], pa.binary())]
                yield pa.RecordBatch.from_arrays([*(part.column(at[c]) for c in ("burst_id", "pos", "passed", "score", "hint")), *made], names=["burst_id", "frame_index", "passed", "score", "hint", "width", "height", "photo", "mask"])

    return chosen.mapInArrow(run, schema).join(told, "burst_id")
