"""Measurements of raw RGBA photos, row by row in an Arrow pass (one narrow stage, no shuffle)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from idloom import dims

METRICS = ("mean", "paper", "p2", "p98", "highlight_clip", "shadow_clip", "contrast", "sharpness", "tenengrad", "motion_isotropy", "focus_uniformity", "glare_ratio", "glare_blob", "color_glare_ratio", "illumination", "noise")


def histogram_percentile(histogram: np.ndarray, fraction: float) -> int:
    """The smallest value whose cumulative count reaches ``fraction`` of all."""
    return int(min(np.searchsorted(np.cumsum(histogram), histogram.sum() * fraction, "left"), len(histogram) - 1))


def largest_blob(mask: np.ndarray, cell: int = 4) -> float:
    """Share of the 4 x 4 grid's cells in its largest region of cells that are at least half full."""
    h, w = mask.shape
    padded = np.zeros((-(-h // cell) * cell, -(-w // cell) * cell), np.uint8)
    padded[:h, :w] = mask
    full = padded.reshape(padded.shape[0] // cell, cell, -1, cell).sum((1, 3)) >= cell * cell / 2
    if not full.any():
        return 0.0
    # labels spread to the least label of connected neighbours until nothing changes
    label = np.where(full, np.arange(full.size).reshape(full.shape), full.size)
    while True:
        near = label.copy()
        near[1:] = np.minimum(near[1:], label[:-1])
        near[:-1] = np.minimum(near[:-1], label[1:])
        near[:, 1:] = np.minimum(near[:, 1:], label[:, :-1])
        near[:, :-1] = np.minimum(near[:, :-1], label[:, 1:])
        near = np.where(full, near, full.size)
        jumped = np.where(full, np.append(near.ravel(), full.size)[near], full.size)
        if (jumped == label).all():
            return float(np.bincount(label[full]).max() / full.size)
        label = jumped


def illumination(gray: np.ndarray) -> float:
    """Darkest through brightest background (90th percentile of every other pixel) of a 6 x 4 grid."""
    h, w = gray.shape
    found = []
    for r in range(4):
        for c in range(6):
            tile = gray[r * h // 4 : (r + 1) * h // 4 : 2, c * w // 6 : (c + 1) * w // 6 : 2]
            if tile.size:
                found.append(histogram_percentile(np.bincount(tile.ravel(), minlength=256), 0.9))
    return min(found) / max(found) if found and max(found) else 0.0


def measure(rgba: bytes, width: int, height: int, color_value: float = dims.PROFILE["minColorGlareValue"], color_saturation: float = dims.PROFILE["minColorGlareSaturation"]) -> dict[str, float]:
    px = np.frombuffer(rgba, np.uint8).reshape(height, width, 4).astype(np.int32)
    r, g, b = px[..., 0], px[..., 1], px[..., 2]
    gray = (77 * r + 150 * g + 29 * b) >> 8
    top, low = px[..., :3].max(2), px[..., :3].min(2)
    glare = (top >= 252) & (top - low <= 24)
    colour = (top >= color_value) & (top > 0) & ((top - low) >= color_saturation * top)
    hist = np.bincount(gray.ravel(), minlength=256)
    size = gray.size
    p2, p98 = histogram_percentile(hist, 0.02), histogram_percentile(hist, 0.98)
    out = {"mean": float(gray.mean()), "paper": float(histogram_percentile(hist, 0.9)), "p2": float(p2), "p98": float(p98), "highlight_clip": float(hist[250:].sum() / size), "shadow_clip": float(hist[:9].sum() / size), "contrast": (p98 - p2) / 255}
    out |= dict.fromkeys(("sharpness", "tenengrad", "motion_isotropy", "noise"), 0.0) | {"focus_uniformity": 1.0}
    if width > 2 and height > 2:
        c, n, s, w, e = gray[1:-1, 1:-1], gray[:-2, 1:-1], gray[2:, 1:-1], gray[1:-1, :-2], gray[1:-1, 2:]
        nw, ne, sw, se = gray[:-2, :-2], gray[:-2, 2:], gray[2:, :-2], gray[2:, 2:]
        lap = (n + s + w + e - 4 * c).astype(np.float64)
        gx, gy = ne + 2 * e + se - nw - 2 * w - sw, sw + 2 * s + se - nw - 2 * n - ne
        ex, ey = float((gx.astype(np.int64) ** 2).sum()), float((gy.astype(np.int64) ** 2).sum())
        strength = np.minimum(np.abs(gx) + np.abs(gy), 4095)
        flat = strength <= histogram_percentile(np.bincount(strength.ravel(), minlength=4096), 0.7)
        response = np.abs(4 * c - 2 * (n + s + w + e) + nw + ne + sw + se)
        row = np.minimum(2, np.arange(1, height - 1) * 3 // height)
        col = np.minimum(3, np.arange(1, width - 1) * 4 // width)
        tile = (row[:, None] * 4 + col[None, :]).ravel()
        count = np.bincount(tile, minlength=12)
        some = count > 0
        mean = np.bincount(tile, lap.ravel(), 12)[some] / count[some]
        variance = np.sort(np.bincount(tile, lap.ravel() ** 2, 12)[some] / count[some] - mean**2)
        content = variance[variance >= 0.25 * variance[len(variance) // 2]]
        middle = content[len(content) // 2] if len(content) else 0.0
        out |= {"sharpness": float(lap.var()), "tenengrad": (ex + ey) / lap.size, "motion_isotropy": min(ex, ey) / max(1.0, ex, ey), "focus_uniformity": float(content[0] / middle) if len(content) >= 3 and middle > 0 else 1.0, "noise": float(np.sqrt(np.pi / 2) * response[flat].mean() / 6) if flat.any() else 0.0}
    return out | {"glare_ratio": float(glare.mean()), "glare_blob": largest_blob(glare), "color_glare_ratio": float(colour.mean()), "illumination": illumination(gray)}


def white_balance_gains(rgba: bytes, width: int, height: int) -> list[float]:
    """Gains of red, green and blue, within 10 %, from the means of the brightest tenth of every fourth pixel; ones if
    fewer than 100 pixels count."""
    px = np.frombuffer(rgba, np.uint8).reshape(-1, 4)[::4, :3].astype(np.float64)
    bright = px.max(1)
    paper = px[bright >= np.percentile(bright, 90)] if len(px) else px
    if len(paper) < 100:
        return [1.0, 1.0, 1.0]
    mean = paper.mean(0)
    return np.clip(mean.mean() / np.maximum(mean, 1), 0.9, 1.1).tolist()


def rectify(rgba: bytes, width: int, height: int, corners: np.ndarray, out_width: int, out_height: int) -> np.ndarray | None:
    """The quadrilateral ``corners`` (top left, top right, bottom right, bottom left) as an upright image, bilinear; None
    where three of them lie on a line."""
    from idloom.operators.matching import apply_homography, solve_homography

    target = np.array([[0, 0], [out_width - 1, 0], [out_width - 1, out_height - 1], [0, out_height - 1]], float)
    h = solve_homography(target, np.asarray(corners, float))
    if h is None or not np.isfinite(h).all():
        return None
    grid = np.stack(np.meshgrid(np.arange(out_width), np.arange(out_height)), -1).reshape(-1, 2).astype(float)
    p = apply_homography(h, grid)
    x, y = np.clip(p[:, 0], 0, width - 1), np.clip(p[:, 1], 0, height - 1)
    x0, y0 = np.minimum(x.astype(int), max(width - 2, 0)), np.minimum(y.astype(int), max(height - 2, 0))
    x1, y1, fx, fy = np.minimum(x0 + 1, width - 1), np.minimum(y0 + 1, height - 1), (x - x0)[:, None], (y - y0)[:, None]
    px = np.frombuffer(rgba, np.uint8).reshape(height, width, 4).astype(float)
    value = px[y0, x0] * (1 - fx) * (1 - fy) + px[y0, x1] * fx * (1 - fy) + px[y1, x0] * (1 - fx) * fy + px[y1, x1] * fx * fy
    return np.rint(value).astype(np.uint8).reshape(out_height, out_width, 4)


def measure_images(images: DataFrame, **limits: float) -> DataFrame:
    """(image_id, valid, metrics…) from (image_id, width, height, rgba). A buffer whose length isn't width * height * 4,
    or that is empty, is not valid and has null metrics."""
    id_type = dict(images.dtypes)["image_id"]

    def run(batches):
        for batch in batches:
            got = []
            for w, h, data in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                ok = bool(w and h and data) and len(data) == w * h * 4
                got.append(measure(data, w, h, **limits) if ok else None)
            columns = [batch.column(0), pa.array([g is not None for g in got], pa.bool_())]
            columns += [pa.array([g and g[m] for g in got], pa.float64()) for m in METRICS]
            yield pa.RecordBatch.from_arrays(columns, names=["image_id", "valid", *METRICS])

    return images.select("image_id", "width", "height", "rgba").mapInArrow(run, f"image_id {id_type}, valid boolean, " + ", ".join(f"{m} double" for m in METRICS))
