"""Binary descriptors: k nearest by Hamming distance with a ratio test, and what follows from the matches.

Both sides are packed into blocks (arrays of equal descriptors), paired on the template key, and compared block by
block in numpy; each block pair keeps the two best of every query, and these are merged by a grouped minimum. The
pairs are blocks of the stated query set against blocks of one template, never rows of a group with each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, REFERENCE_BLOCK = 512, 4096


#: Keys whose counts are broadcast at most (a row each); more keys are joined by a shuffle, as none of them is hot then.
COUNTED_KEYS = 100_000


def _counts(rows: DataFrame, key: str, size: int) -> DataFrame:
    """(key, _parts): how many blocks of about ``size`` rows a key has."""
    n = rows.groupBy(key).agg(F.ceil(F.count("*") / size).alias("_parts"))
    return F.broadcast(n) if n.count() <= COUNTED_KEYS else n


def _blocks(rows: DataFrame, counts: DataFrame, key: str, ident: str, descriptor: str, prefix: str) -> DataFrame:
    """(key, _b, prefix_ids, prefix_data): one block of descriptors a row, dealt out by a hash of the id."""
    dealt = rows.join(counts, key).withColumn("_b", F.pmod(F.xxhash64(ident), F.col("_parts")))
    packed = dealt.groupBy(key, "_b").agg(F.collect_list(F.struct(F.col(ident).alias("id"), F.col(descriptor).alias("d"))).alias("_rows"))
    return packed.select(key, "_b", F.col("_rows.id").alias(f"{prefix}_ids"), F.col("_rows.d").alias(f"{prefix}_data"))


def nearest_two(queries: DataFrame, references: DataFrame, key: str, ident: str, descriptor: str = "descriptor") -> DataFrame:
    """(key, query_id, first_id, first, second): the nearest reference of every query, its distance, and the distance of
    the second nearest (null if there is one reference only); of equal distances the smaller id is nearest. A query is
    never its own reference where ids are equal. Query blocks are copied to the numbers of the reference blocks and meet
    them on key and number, so the blocks of one large key are spread over tasks."""
    parts = _counts(references, key, REFERENCE_BLOCK)
    q = _blocks(queries, _counts(queries, key, QUERY_BLOCK), key, ident, descriptor, "q").withColumnRenamed("_b", "_q")
    q = q.join(parts, key).withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
    r = _blocks(references, parts, key, ident, descriptor, "r")
    both = q.join(r, [key, "_b"])
    key_type = dict(queries.dtypes)[key]

    def run(batches):
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            out: dict[str, list] = {n: [] for n in ("key", "query_id", "ref_id", "distance")}
            for i in range(batch.num_rows):
                value = batch.column(at[key])[i].as_py()
                q_ids, r_ids = (np.array(batch.column(at[n])[i].as_py(), np.int64) for n in ("q_ids", "r_ids"))
                a, b = (np.frombuffer(b"".join(batch.column(at[n])[i].as_py()), np.uint8).reshape(len(ids), -1) for n, ids in (("q_data", q_ids), ("r_data", r_ids)))
                order = np.argsort(r_ids, kind="stable")
                r_ids, b = r_ids[order], b[order]
                for k in range(len(q_ids)):
                    d = np.bitwise_count(a[k] ^ b).sum(1, dtype=np.int64)
                    d[r_ids == q_ids[k]] = 1 << 30
                    for j in np.argsort(d, kind="stable")[:2]:
                        if d[j] < 1 << 30:
                            for n, v in (("key", value), ("query_id", int(q_ids[k])), ("ref_id", int(r_ids[j])), ("distance", int(d[j]))):
                                out[n].append(v)
            schema = pa.schema([("key", batch.schema.field(at[key]).type), ("query_id", pa.int64()), ("ref_id", pa.int64()), ("distance", pa.int64())])
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    best = both.select(key, "q_ids", "q_data", "r_ids", "r_data").mapInArrow(run, f"key {key_type}, query_id long, ref_id long, distance long")
    ranked = best.withColumn("_n", F.row_number().over(Window.partitionBy("key", "query_id").orderBy("distance", "ref_id"))).where("_n <= 2")
    of = lambda n, c: F.max(F.when(F.col("_n") == n, F.col(c)))
    return ranked.groupBy(F.col("key").alias(key), "query_id").agg(of(1, "ref_id").alias("first_id"), of(1, "distance").alias("first"), of(2, "distance").alias("second"))


def good_matches(nearest: DataFrame, ratio: float = 0.75) -> DataFrame:
    """Matches that are clearly nearer than the second best."""
    return nearest.where(F.col("second").isNotNull() & (F.col("first") < ratio * F.col("second")))


def match_quality(inliers: DataFrame, *keys: str) -> DataFrame:
    """good, inlier_ratio, spatial coverage (bounding box of inliers through the image's area, 0 under four points) and
    mean reprojection error (infinite without inliers) from rows (…keys, x, y, px, py, inlier, width, height)."""
    on = F.col("inlier")
    x, y = F.when(on, F.col("x")), F.when(on, F.col("y"))
    box = (F.max(x) - F.min(x)) * (F.max(y) - F.min(y)) / (F.max("width") * F.max("height"))
    error = F.avg(F.when(on, F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))))
    return inliers.groupBy(*keys).agg(F.count("*").alias("good"), F.avg(on.cast("double")).alias("inlier_ratio"), F.when(F.count_if(on) >= 4, box).otherwise(F.lit(0.0)).alias("coverage"), F.coalesce(error, F.lit(float("inf"))).alias("error"))


def accepted(min_good: int = 18, min_ratio: float = 0.42, min_coverage: float = 0.08, max_error: float = 8.0) -> Column:
    return (F.col("good") >= min_good) & (F.col("inlier_ratio") >= min_ratio) & (F.col("coverage") >= min_coverage) & (F.col("error") <= max_error)


def best_template(candidates: DataFrame, *keys: str) -> DataFrame:
    """The best candidate: matched before unmatched, then the higher inlier ratio, then the smaller error, then the id."""
    order = Window.partitionBy(*keys).orderBy(F.desc("matched"), F.desc("inlier_ratio"), "error", "template_id")
    return candidates.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def solve_homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """The 3 x 3 map of four or more points in least squares, or None if they are degenerate."""
    x, y = src[:, 0], src[:, 1]
    u, v = dst[:, 0], dst[:, 1]
    zero, one = np.zeros_like(x), np.ones_like(x)
    a = np.concatenate([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y], 1), np.stack([zero, zero, zero, x, y, one, -v * x, -v * y], 1)])
    try:
        h = np.linalg.lstsq(a, np.concatenate([u, v]), rcond=None)[0]
    except np.linalg.LinAlgError:
        return None
    h = np.append(h, 1.0).reshape(3, 3)
    return h if abs(np.linalg.det(h)) > 1e-9 else None


def apply_homography(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    q = np.column_stack([p, np.ones(len(p))]) @ h.T
    return q[:, :2] / q[:, 2:]


def align(matches: DataFrame, key: str, threshold: float = 4.0) -> DataFrame:
    """(key, homography, inliers) from rows (key, x, y, tx, ty), many keys solved together (see ``alignment``)."""
    point = F.struct(*[F.col(c).cast("double").alias(c) for c in ("x", "y", "tx", "ty")])
    packed = matches.groupBy(key).agg(F.array_sort(F.collect_list(point)).alias("_points"))

    def run(batches):
        from idloom.operators.alignment import consensus_many

        for batch in batches:
            points = [np.array([(p["x"], p["y"], p["tx"], p["ty"]) for p in own]).reshape(-1, 4) for own in batch.column(1).to_pylist()]
            found = consensus_many([(p[:, :2], p[:, 2:]) for p in points], [threshold] * len(points))
            maps = pa.array([None if h is None else h.ravel().tolist() for h, _ in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), maps, pa.array([int(i.sum()) for _, i in found], pa.int64())], names=[key, "homography", "inliers"])

    return packed.mapInArrow(run, f"{key} {dict(matches.dtypes)[key]}, homography array<double>, inliers long")


def to_source(points: np.ndarray, corners: np.ndarray, width: int, height: int) -> np.ndarray | None:
    """Points of a rectified image in the coordinates of the photo whose ``corners`` it was rectified from."""
    h = solve_homography(np.array([[0, 0], [width - 1, 0], [width - 1, height - 1], [0, height - 1]], float), np.asarray(corners, float))
    return None if h is None else apply_homography(h, np.asarray(points, float))
