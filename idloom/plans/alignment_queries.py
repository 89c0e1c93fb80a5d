"""Queries that align photos with templates. Embeddings stand in for features: the signs are the descriptor, templates are
a label's vectors within a run of ids, and each is shown by a photo moved by known numbers, with a bit of every descriptor
changed, some features hidden and some displaced."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.operators import alignment
from idloom.plans.common import table

#: Ids of a group of templates, of which a photo shows one.
_RUN = 640
_WIDTH, _HEIGHT = 480, 320


def _scene(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(photos, their features, templates, their features)."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label").where("size(embedding) = 64")
    signs = F.transform("embedding", lambda v: F.when(v > 0, "1").otherwise("0"))
    group = F.floor(F.col("vec_id") / _RUN)
    rows = e.select("vec_id", signs.alias("signs"), group.alias("group_id"), (group * 16 + F.coalesce("label", F.lit(15))).alias("template_id"), (F.col("vec_id") * 37 % 400).alias("x"), (F.col("vec_id") * 53 % 250).alias("y"))
    half = lambda bits, i: F.lpad(F.conv(F.substring(bits, 1 + 32 * i, 32), 2, 16), 8, "0")
    packed = lambda signs: F.unhex(F.concat(*[half(F.array_join(signs, ""), i) for i in (0, 1)]))
    changed = F.transform("signs", lambda s, i: F.when(i == F.col("vec_id") % 64, F.translate(s, "01", "10")).otherwise(s))
    moved = F.col("vec_id") % 5 == 0
    x = F.col("x") + F.col("template_id") % 17 + F.when(moved, 60 + F.col("vec_id") * 29 % 97).otherwise(0)
    y = F.col("y") + F.col("template_id") % 11 + F.when(moved, 50 + F.col("vec_id") * 31 % 83).otherwise(0)
    shown = rows.where("vec_id % 9 <> 4").select(F.col("template_id").alias("photo_id"), F.col("vec_id").alias("feature_id"), x.alias("x"), y.alias("y"), packed(changed).alias("descriptor"))
    known = rows.select("template_id", F.col("vec_id").alias("feature_id"), "x", "y", packed(F.col("signs")).alias("descriptor"))
    sheets = rows.select("template_id", "group_id").distinct().withColumns({"width": F.lit(_WIDTH), "height": F.lit(_HEIGHT)})
    return sheets.withColumnRenamed("template_id", "photo_id"), shown, sheets, known


def template_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every photo against every template of its group: good matches, and for those that match the inliers of the map."""
    out = alignment.align_photos(*_scene(spark, sf_dir))
    matched = lambda c: F.when(F.col("matched"), F.col(c)).alias(c)
    return out.select("photo_id", "template_id", "good", "matched", *[matched(c) for c in ("inliers", "inlier_ratio", "coverage")])


_SCENE = f"""
WITH r AS (SELECT vec_id, vec_id // {_RUN} AS group_id, vec_id // {_RUN} * 16 + coalesce(label, 15) AS template_id, list_transform(embedding, lambda v: CASE WHEN v > 0 THEN '1' ELSE '0' END) AS signs, vec_id * 37 % 400 AS x, vec_id * 53 % 250 AS y FROM embeddings WHERE len(embedding) = 64),
k AS (SELECT vec_id, group_id, template_id, x, y, CAST(array_to_string(signs, '') AS BIT) AS d FROM r),
q AS (SELECT vec_id, group_id, template_id AS photo_id, template_id % 17 AS dx, template_id % 11 AS dy, x + template_id % 17 + CASE WHEN vec_id % 5 = 0 THEN 60 + vec_id * 29 % 97 ELSE 0 END AS px, y + template_id % 11 + CASE WHEN vec_id % 5 = 0 THEN 50 + vec_id * 31 % 83 ELSE 0 END AS py,
  CAST(array_to_string(list_transform(signs, lambda s, i: CASE WHEN i - 1 = vec_id % 64 THEN translate(s, '01', '10') ELSE s END), '') AS BIT) AS d FROM r WHERE vec_id % 9 <> 4),
p AS (SELECT photo_id, template_id, q.vec_id AS feature, px, py, dx, dy, x, y, bit_count(xor(q.d, k.d)) AS n, row_number() OVER (PARTITION BY photo_id, template_id, q.vec_id ORDER BY bit_count(xor(q.d, k.d)), k.vec_id) AS place FROM q JOIN k USING (group_id)),
two AS (SELECT a.*, a.n < 0.75 * b.n AS good, a.x + a.dx = a.px AND a.y + a.dy = a.py AS inlier FROM p a JOIN p b USING (photo_id, template_id, feature) WHERE a.place = 1 AND b.place = 2),
pairs AS (SELECT DISTINCT p.template_id AS photo_id, t.template_id FROM k p JOIN (SELECT DISTINCT template_id, group_id FROM k) t USING (group_id)),
c AS (SELECT photo_id, template_id, count(feature) FILTER (good) AS good, count(feature) FILTER (good AND inlier) AS inliers,
  coalesce((max(px) FILTER (good AND inlier) - min(px) FILTER (good AND inlier)) * (max(py) FILTER (good AND inlier) - min(py) FILTER (good AND inlier)), 0) / {float(_WIDTH * _HEIGHT)} AS box FROM pairs LEFT JOIN two USING (photo_id, template_id) GROUP BY ALL),
m AS (SELECT *, good >= 18 AND inliers >= 4 AND inliers / good >= 0.42 AND box >= 0.08 AS matched FROM c)
"""
_ALIGNMENT = _SCENE + """
SELECT photo_id, template_id, good, matched, CASE WHEN matched THEN inliers END AS inliers, CASE WHEN matched THEN floor(inliers / good * 10000 + 0.5) / 10000 END AS inlier_ratio, CASE WHEN matched THEN floor(box * 10000 + 0.5) / 10000 END AS coverage FROM m
"""


def aligned_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The template that each photo shows, where one matches, and where its corners lie in the photo."""
    best = alignment.best_alignments(alignment.align_photos(*_scene(spark, sf_dir))).where("matched")
    corner = lambda i, c: F.round(F.col("quad")[i][c], 3)
    return best.select("photo_id", "template_id", "inliers", corner(0, "x").alias("left"), corner(0, "y").alias("top"), corner(2, "x").alias("right"), corner(2, "y").alias("bottom"))


_BEST = _SCENE + f"""
SELECT photo_id, template_id, inliers, CAST(photo_id % 17 AS DOUBLE) AS "left", CAST(photo_id % 11 AS DOUBLE) AS top, CAST({_WIDTH} + photo_id % 17 AS DOUBLE) AS "right", CAST({_HEIGHT} + photo_id % 11 AS DOUBLE) AS bottom
FROM m WHERE matched QUALIFY row_number() OVER (PARTITION BY photo_id ORDER BY inliers / good DESC, template_id) = 1
"""

QUERIES = {"template_alignment": (template_alignment, _ALIGNMENT), "aligned_template": (aligned_template, _BEST)}
