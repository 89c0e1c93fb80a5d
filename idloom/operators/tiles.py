"""Measurement of large photos by tiles: bands of rows with a halo, whose counts are added up and whose blobs are joined.

A photo is cut natively into bands of about BAND_BYTES (multiples of four rows, so that no cell of the glare grid is cut),
each with a row more on either side where there is one. A band yields *slots*: histograms, sums and moments as
whole numbers, of which only those that aren't zero are sent, and its blobs: their sizes, and which of them touch the band's
first and last row of cells. Slots of a photo are added up in Spark, with map-side combine; there are SLOTS of them at most,
whatever the photo's size. Blobs that meet at a border are joined by union-find over the bands' border rows. All numbers are
whole until the last step, so the result doesn't depend on how a photo is cut.

Defined cases: as for ``image.measure_images``; a photo of one band is measured the same way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idloom import dims
from idloom.operators.image import METRICS, histogram_percentile, measure_images

BAND_BYTES = 1 << 20
CELL = 4
#: Where each vector of counts lies among a photo's slots: (first slot, length).
_LAYOUT: dict[str, tuple[int, int]] = {}
_at = 0
for _name, _size in (("gray", 256), ("colour", 1), ("glare", 1), ("lap", 3), ("energy", 2), ("tile_n", 12), ("tile_sum", 12), ("tile_square", 12), ("strength", 4096), ("response", 4096), ("light", 24 * 256)):
    _LAYOUT[_name] = (_at, _size)
    _at += _size
SLOTS = _at


def bands(images: DataFrame, band_bytes: int = BAND_BYTES) -> DataFrame:
    """(image_id, width, height, y, rows, above, pixels): the bands of every valid photo. ``y`` is a band's first row;
    ``pixels`` begin with the row before it where ``above`` is 1, and end with the row behind it where there is one."""
    w, h, row = F.col("width"), F.col("height"), F.col("width").cast("long") * 4
    valid = (w > 0) & (h > 0) & (F.octet_length("rgba") == row * h)
    each = F.greatest(F.floor(F.lit(band_bytes) / row / CELL) * CELL, F.lit(CELL)).cast("int")
    cut = images.where(F.coalesce(valid, F.lit(False))).select("image_id", "width", "height", "rgba", each.alias("_each"))
    cut = cut.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.col("_each"))))
    rows = F.least(F.col("_each"), F.col("height") - F.col("y"))
    above, below = (F.col("y") > 0).cast("int"), (F.col("y") + F.col("_each") < F.col("height")).cast("int")
    place = (F.col("y") - above).cast("long") * row + 1
    return cut.select("image_id", "width", "height", "y", rows.alias("rows"), above.alias("above"), F.substr(F.col("rgba"), place.cast("int"), ((rows + above + below).cast("long") * row).cast("int")).alias("pixels"))


def _labels(full: np.ndarray) -> np.ndarray:
    """Blob numbers (from 1; 0 outside) of cells connected by sides: runs of a row, joined with those they touch above."""
    out, parent = np.zeros(full.shape, np.int64), [0]
    before: list[tuple[int, int, int]] = []
    for y, line in enumerate(full):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], line.view(np.int8), [0]])))
        now = []
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            mine = 0
            for c, d, label in before:
                if c < b and a < d:
                    label = find(parent, label)
                    if mine and mine != label:
                        parent[max(mine, label)] = min(mine, label)
                    mine = min(mine, label) if mine else label
            if not mine:
                mine = len(parent)
                parent.append(mine)
            out[y, a:b] = mine
            now.append((a, b, mine))
        before = now
    return np.array([find(parent, i) for i in range(len(parent))])[out]


def find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def measure_band(pixels: np.ndarray, width: int, height: int, y: int, rows: int, above: int, color_value: float, color_saturation: float) -> tuple[np.ndarray, list[int], list[int], list[int]]:
    """(slots, sizes of blobs, blobs of the first row of cells, of the last: 0 none, else 1 + index into sizes)."""
    px = pixels.reshape(-1, width, 4)[..., :3].astype(np.int64)
    slots = np.zeros(SLOTS, np.int64)

    def put(name: str, values) -> None:
        at, size = _LAYOUT[name]
        slots[at : at + size] += np.asarray(values, np.int64)

    gray = (77 * px[..., 0] + 150 * px[..., 1] + 29 * px[..., 2]) >> 8
    own = slice(above, above + rows)
    top, low = px[own].max(2), px[own].min(2)
    glare = (top >= 252) & (top - low <= 24)
    put("gray", np.bincount(gray[own].ravel(), minlength=256))
    put("colour", [((top >= color_value) & (top > 0) & (top - low >= color_saturation * top)).sum()])
    put("glare", [glare.sum()])

    first, last = max(y, 1), min(y + rows, height - 1)  # rows with a neighbour on either side
    if width > 2 and last > first:
        s = slice(first - y + above, last - y + above)
        move = lambda dy, dx: gray[s.start + dy : s.stop + dy, 1 + dx : width - 1 + dx]
        c, n, so, w, e = move(0, 0), move(-1, 0), move(1, 0), move(0, -1), move(0, 1)
        nw, ne, sw, se = move(-1, -1), move(-1, 1), move(1, -1), move(1, 1)
        lap = n + so + w + e - 4 * c
        gx, gy = ne + 2 * e + se - nw - 2 * w - sw, sw + 2 * so + se - nw - 2 * n - ne
        strength = np.minimum(np.abs(gx) + np.abs(gy), 4095).ravel()
        response = np.abs(4 * c - 2 * (n + so + w + e) + nw + ne + sw + se).ravel()
        put("lap", [lap.size, lap.sum(), (lap**2).sum()])
        put("energy", [(gx**2).sum(), (gy**2).sum()])
        tile = (np.minimum(2, np.arange(first, last) * 3 // height)[:, None] * 4 + np.minimum(3, np.arange(1, width - 1) * 4 // width)[None, :]).ravel()
        total = lambda bins, weight, size: np.rint(np.bincount(bins, weight, size))  # noqa: E731  whole numbers under 2**53
        put("tile_n", np.bincount(tile, minlength=12))
        put("tile_sum", total(tile, lap.ravel(), 12))
        put("tile_square", total(tile, lap.ravel() ** 2, 12))
        put("strength", np.bincount(strength, minlength=4096))
        put("response", total(strength, response, 4096))

    light = np.zeros((24, 256), np.int64)
    for r in range(4):  # every second pixel from each grid cell's own corner
        start, stop = r * height // 4, (r + 1) * height // 4
        a = start + max(0, -(-(y - start) // 2)) * 2
        lines = np.arange(a, min(stop, y + rows), 2) - y + above
        for col in range(6 if len(lines) else 0):
            part = gray[lines, col * width // 6 : (col + 1) * width // 6 : 2]
            light[r * 6 + col] += np.bincount(part.ravel(), minlength=256)
    put("light", light.ravel())

    padded = np.zeros((-(-rows // CELL) * CELL, -(-width // CELL) * CELL), np.uint8)
    padded[:rows, :width] = glare
    labels = _labels(padded.reshape(padded.shape[0] // CELL, CELL, -1, CELL).sum((1, 3)) >= CELL * CELL / 2)
    known, sizes = np.unique(labels[labels > 0], return_counts=True)
    numbered = np.where(labels > 0, np.searchsorted(known, labels) + 1, 0)
    return slots, sizes.tolist(), numbered[0].tolist(), numbered[-1].tolist()


def largest_joined(parts: list[dict]) -> int:
    """Cells of the largest blob over all bands (in order), joined where blobs meet at a border."""
    base, parent, sizes, before, best = 0, [0], [0], None, 0
    for p in parts:
        own = list(range(len(parent), len(parent) + len(p["sizes"])))
        parent += own
        sizes += p["sizes"]
        base = own[0] - 1 if own else len(parent) - 1
        if before is not None:
            for up, down in {(a, base + b) for a, b in zip(before, p["top"], strict=True) if a and b}:
                x, z = find(parent, up), find(parent, down)
                if x != z:
                    parent[max(x, z)] = min(x, z)
                    sizes[min(x, z)] += sizes[max(x, z)]
        before = [base + b if b else 0 for b in p["bottom"]]
    for i in range(1, len(parent)):
        best = max(best, sizes[find(parent, i)])
    return best


def metrics_of(slots: np.ndarray, parts: list[dict], width: int, height: int) -> dict[str, float]:
    """A photo's measurements from its added slots and its bands' blobs."""
    of = lambda name: slots[_LAYOUT[name][0] : sum(_LAYOUT[name])]
    size, hist = width * height, of("gray")
    p2, p98 = histogram_percentile(hist, 0.02), histogram_percentile(hist, 0.98)
    out = {"mean": float((hist * np.arange(256)).sum() / size), "paper": float(histogram_percentile(hist, 0.9)), "p2": float(p2), "p98": float(p98), "highlight_clip": float(hist[250:].sum() / size), "shadow_clip": float(hist[:9].sum() / size), "contrast": (p98 - p2) / 255}
    out |= dict.fromkeys(("sharpness", "tenengrad", "motion_isotropy", "noise"), 0.0) | {"focus_uniformity": 1.0}
    n, total, squares = (int(x) for x in of("lap"))
    if n:
        ex, ey = (float(x) for x in of("energy"))
        strength = of("strength")
        limit = histogram_percentile(strength, 0.7)
        flat = int(strength[: limit + 1].sum())
        there = of("tile_n") > 0
        mean = of("tile_sum")[there] / of("tile_n")[there]
        variance = np.sort(of("tile_square")[there] / of("tile_n")[there] - mean**2)
        content = variance[variance >= 0.25 * variance[len(variance) // 2]]
        middle = float(content[len(content) // 2]) if len(content) else 0.0
        out |= {"sharpness": (n * squares - total * total) / (n * n), "tenengrad": (ex + ey) / n, "motion_isotropy": min(ex, ey) / max(1.0, ex, ey)}
        out |= {"focus_uniformity": float(content[0]) / middle if len(content) >= 3 and middle > 0 else 1.0, "noise": float(np.sqrt(np.pi / 2) * (int(of("response")[: limit + 1].sum()) / flat) / 6) if flat else 0.0}
    light = of("light").reshape(24, 256)
    found = [histogram_percentile(cell, 0.9) for cell in light if cell.any()]
    cells = -(-width // CELL) * -(-height // CELL)
    return out | {"glare_ratio": int(of("glare")[0]) / size, "glare_blob": largest_joined(parts) / cells, "color_glare_ratio": int(of("colour")[0]) / size, "illumination": min(found) / max(found) if found and max(found) else 0.0}


def measure_tiled(images: DataFrame, band_bytes: int = BAND_BYTES, color_value: float = dims.PROFILE["minColorGlareValue"], color_saturation: float = dims.PROFILE["minColorGlareSaturation"]) -> DataFrame:
    """(image_id, valid, metrics…) from (image_id, width, height, rgba), as ``image.measure_images``; ids must be unique."""
    kind = dict(images.dtypes)["image_id"]

    def cut(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                _, width, height, y, rows, above = (batch.column(k)[i].as_py() for k in range(6))
                pixels = np.frombuffer(batch.column(6)[i].as_buffer(), np.uint8)
                slots, sizes, top, bottom = measure_band(pixels, width, height, y, rows, above, color_value, color_saturation)
                at = np.flatnonzero(slots)
                n = len(at)
                ids = batch.column(0).slice(i, 1).take(pa.array([0] * (n + 1)))
                blobs = [None] * n + [{"y": y, "sizes": sizes, "top": top, "bottom": bottom}]
                yield pa.RecordBatch.from_arrays([ids, pa.array([*at.tolist(), SLOTS], pa.int32()), pa.array([*slots[at].tolist(), 0], pa.int64()), pa.array(blobs, blob)], names=["image_id", "slot", "value", "blobs"])

    ints = pa.list_(pa.int64())
    blob = pa.struct([("y", pa.int64()), ("sizes", ints), ("top", ints), ("bottom", ints)])
    schema = f"image_id {kind}, slot int, value long, blobs struct<y:bigint,sizes:array<bigint>,top:array<bigint>,bottom:array<bigint>>"
    # where a photo has several bands, their pixels are spread over tasks first
    spread = bands(images, band_bytes)
    added = spread.mapInArrow(cut, schema).groupBy("image_id", "slot").agg(F.sum("value").alias("value"), F.collect_list("blobs").alias("blobs"))
    whole = added.groupBy("image_id").agg(F.collect_list(F.when(F.col("slot") < SLOTS, F.struct("slot", "value"))).alias("slots"), F.array_sort(F.flatten(F.collect_list("blobs"))).alias("blobs"))
    sized = whole.join(images.select("image_id", "width", "height"), "image_id").select("image_id", "width", "height", "slots", "blobs")

    def finish(batches):
        for batch in batches:
            made = []
            for i in range(batch.num_rows):
                counts = batch.column(3)[i].values
                slots = np.zeros(SLOTS, np.int64)
                slots[counts.field("slot").to_numpy()] = counts.field("value").to_numpy()
                made.append(metrics_of(slots, batch.column(4)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([m[c] for m in made], pa.float64()) for c in METRICS)], names=["image_id", *METRICS])

    found = sized.mapInArrow(finish, f"image_id {kind}, " + ", ".join(f"{m} double" for m in METRICS))
    return images.select("image_id").join(found, "image_id", "left").select("image_id", F.col("mean").isNotNull().alias("valid"), *METRICS)


def measure_any(images: DataFrame, large: int = 16 << 20, **limits: float) -> DataFrame:
    """Photos up to ``large`` bytes in one narrow pass, larger ones by tiles."""
    big: Column = F.coalesce(F.octet_length("rgba") > large, F.lit(False))
    return measure_images(images.where(~big), **limits).unionByName(measure_tiled(images.where(big), **limits))
