"""Connected components of an edge table by alternating large-star and small-star.

Neither step gathers a node's neighbours: a grouped minimum (with map-side combine) is joined back on the node, and
the rows of a node with very many edges are split over tasks. Each half step is written to the shared folder, which
cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idloom.llm.common import discard, join_split, materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One half step over edges (u, v) with u > v; the result has that form too."""
    around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = around.groupBy("u").agg(F.min("v").alias("_v")).select("u", F.least("u", "_v").alias("m"))
    joined = join_split(around, least, ["u"])
    if large:  # larger neighbours are hung on the least node around u
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = least.where(F.col("m") < F.col("u")).select("u", F.col("m").alias("v"))
    else:  # smaller neighbours, and u itself, are hung on the least of them
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = least.select("u", F.col("m").alias("v"))
    return moved.unionByName(kept).where(F.col("u") != F.col("v")).distinct()


def _print(edges: DataFrame) -> tuple:
    """A fingerprint of an edge set: its size and two order-free hash sums (one row reaches the driver)."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first())


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, root) of every node that has an edge to another one; root is the least node of its component.

    Node values of any orderable type; loops, null ends and repeated edges are ignored; no edges give no rows.
    """
    a, b = F.col(src), F.col(dst)
    now = materialize(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    seen = _print(now)
    while seen[0]:
        mid = materialize(_stars(now, large=True), "large-star")
        after = materialize(_stars(mid, large=False), "small-star")
        discard(now, mid)
        now, before = after, seen
        seen = _print(now)
        if seen == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
