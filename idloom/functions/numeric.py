"""Rounding and plane geometry as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Width and height in millimetres: the card format, and the passport page.
CARD_MM, PASSPORT_MM = (85.6, 53.98), (125.0, 88.0)


def round_half_up(c: Column, places: int = 2) -> Column:
    """Rounding to the nearest, halves towards plus infinity, on the binary value (unlike ``round``)."""
    factor = float(10**places)
    return F.floor(c * factor + 0.5) / factor


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def ratio(a: Column, b: Column) -> Column:
    """The larger through the smaller."""
    return F.greatest(a, b) / F.greatest(F.lit(1e-9), F.least(a, b))


def distance(p: Column, q: Column) -> Column:
    return F.hypot(p["x"] - q["x"], p["y"] - q["y"])


def angle(before: Column, at: Column, after: Column) -> Column:
    """Degrees between the two arms at a corner."""
    ax, ay, bx, by = before["x"] - at["x"], before["y"] - at["y"], after["x"] - at["x"], after["y"] - at["y"]
    cosine = (ax * bx + ay * by) / F.greatest(F.lit(1e-9), F.hypot(ax, ay) * F.hypot(bx, by))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) * 180 / math.pi


def polygon_area(points: Column) -> Column:
    """Area of a closed polygon given as an array of (x, y)."""
    turned = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    cross = F.zip_with(points, turned, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda acc, v: acc + v)) / 2


def geometry(quad: Column, width: Column, height: Column, kind: Column, scale: Column | None = None) -> Column:
    """fill, margin, aspect_ratio, aspect_error, angle_deviation, side_ratio, width_px and dpi of four corners (top left,
    top right, bottom right, bottom left) in a frame."""
    scale = F.lit(1.0) if scale is None else scale
    p = [quad[i] for i in range(4)]
    top, bottom, left, right = distance(p[0], p[1]), distance(p[3], p[2]), distance(p[0], p[3]), distance(p[1], p[2])
    across = F.least(top, bottom)
    passport = kind.endswith("passport")
    target = F.when(passport, F.lit(PASSPORT_MM[0] / PASSPORT_MM[1])).otherwise(CARD_MM[0] / CARD_MM[1])
    width_mm = F.when(passport, F.lit(PASSPORT_MM[0])).otherwise(CARD_MM[0])
    aspect = (top + bottom) / F.greatest(F.lit(1.0), left + right)
    edges = [c for q in p for c in (q["x"], q["y"], width - q["x"], height - q["y"])]
    bend = [F.abs(90 - angle(p[(i + 3) % 4], p[i], p[(i + 1) % 4])) for i in range(4)]
    return F.struct(
        F.sqrt(polygon_area(quad) / (width * height)).alias("fill"),
        (F.least(*edges) / F.least(width, height)).alias("margin"),
        aspect.alias("aspect_ratio"),
        F.abs(aspect / target - 1).alias("aspect_error"),
        F.greatest(*bend).alias("angle_deviation"),
        F.greatest(ratio(top, bottom), ratio(left, right)).alias("side_ratio"),
        (across * scale).alias("width_px"),
        (across * scale / (width_mm / 25.4)).alias("dpi"),
    )


def order_corners(points: Column) -> Column:
    """Four corners turned clockwise from the one nearest the top left, the long edge first."""
    cx = sum((points[i]["x"] for i in range(1, 4)), points[0]["x"]) / 4
    cy = sum((points[i]["y"] for i in range(1, 4)), points[0]["y"]) / 4
    turned = F.array_sort(F.transform(points, lambda p: F.struct(F.atan2(p["y"] - cy, p["x"] - cx).alias("a"), p["x"].alias("x"), p["y"].alias("y"))))
    bare = F.transform(turned, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    rotated = lambda q, n: F.concat(F.slice(q, n + 1, 4 - n), F.slice(q, 1, n))
    first = F.array_min(F.transform(bare, lambda p, i: F.struct((p["x"] + p["y"]).alias("sum"), i.alias("i"))))["i"]
    # one-element transforms hold what is used more than once
    started = F.get(F.transform(F.array(F.struct(bare.alias("q"), first.alias("i"))), lambda v: rotated(v["q"], v["i"])), 0)
    return F.get(F.transform(F.array(started), lambda q: F.when(distance(q[0], q[1]) < distance(q[1], q[2]), rotated(q, F.lit(1))).otherwise(q)), 0)


def project(h: Column, point: Column) -> Column:
    """A point through a 3 x 3 homography given as an array of nine numbers, row by row."""
    w = h[6] * point["x"] + h[7] * point["y"] + h[8]
    return F.struct(((h[0] * point["x"] + h[1] * point["y"] + h[2]) / w).alias("x"), ((h[3] * point["x"] + h[4] * point["y"] + h[5]) / w).alias("y"))


def invert_homography(h: Column) -> Column:
    """The inverse as nine numbers, or null if the determinant is about zero."""
    a = [h[i] for i in range(9)]
    minor = lambda i, j, k, m: a[i] * a[m] - a[j] * a[k]
    adjugate = [minor(4, 5, 7, 8), -minor(1, 2, 7, 8), minor(1, 2, 4, 5), -minor(3, 5, 6, 8), minor(0, 2, 6, 8), -minor(0, 2, 3, 5), minor(3, 4, 6, 7), -minor(0, 1, 6, 7), minor(0, 1, 3, 4)]
    det = a[0] * adjugate[0] + a[1] * adjugate[3] + a[2] * adjugate[6]
    return F.when(F.abs(det) > 1e-9, F.array(*[x / det for x in adjugate]))


def expand_quad(quad: Column, factor: float) -> Column:
    """Corners moved away from their centre."""
    cx = sum((quad[i]["x"] for i in range(1, 4)), quad[0]["x"]) / 4
    cy = sum((quad[i]["y"] for i in range(1, 4)), quad[0]["y"]) / 4
    return F.transform(quad, lambda p: F.struct((cx + (p["x"] - cx) * factor).alias("x"), (cy + (p["y"] - cy) * factor).alias("y")))


def crop_region(guide: Column, view_w: Column, view_h: Column, frame_w: Column, frame_h: Column) -> Column:
    """The frame pixels behind a guide (x, y, w, h as shares of the viewport) when the frame covers the viewport."""
    zoom = F.greatest(view_w / frame_w, view_h / frame_h)

    def axis(frame: Column, view: Column, start: Column, size: Column) -> tuple[Column, Column]:
        shown = F.least(frame, view / zoom)
        first = (frame - shown) / 2
        low = F.greatest(F.lit(0), F.least((frame - 1).cast("long"), F.floor(first + start * shown)))
        high = F.greatest(low + 1, F.least(frame.cast("long"), F.ceil(first + (start + size) * shown)))
        return low, high - low

    (x, w), (y, h) = axis(frame_w, view_w, guide["x"], guide["w"]), axis(frame_h, view_h, guide["y"], guide["h"])
    return F.struct(x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"))


def scale_quad(quad: Column, x: Column, y: Column) -> Column:
    """Corners with their coordinates multiplied: by 1 / width and 1 / height into unit coordinates, and back."""
    return F.transform(quad, lambda p: F.struct((p["x"] * x).alias("x"), (p["y"] * y).alias("y")))
