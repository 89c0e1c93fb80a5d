"""MinHash near-duplicate detection (operator 3): universal hash minima, banding, verification, star components.

1. One narrow pass gives every document its shingle set's digest, size and signature (minima of BANDS * ROWS
   universal hash functions). Documents with one set form a class and are compared once.
2. Each band of a class's signature is a bucket. No bucket is expanded into all its pairs: its members are compared
   with one pivot, the member that meets most others (the middle of a group of near copies, if it has one).
3. Candidates pass a signature check, then are confirmed on the full shingle sets. Links go into connected components.
4. Buckets that still hold several components are finished by an exact prefix filter: of two linked sets, the rarest
   shingles have one in common. Members outside a bucket's largest component are compared with the sets that share one
   with them and are in another component. So each pair that shares a bucket is linked, in one component already,
   ruled out by an exact bound or by its signatures, or compared. Two losses are left for a pair at the threshold: it
   shares no bucket with probability (1 - 0.8**ROWS)**BANDS, which is 4e-7, and fails the signature check of step 3,
   which these candidates pass through too, with probability 1e-9 (see SLACK).

Defined cases: a null or empty text and one without words has an empty set and is linked with nothing; a text with
fewer words than a shingle has one shingle, the whole sequence; repeated rows and equal texts are one class; a null id
never is a component's id unless nothing else is there, and a row without an id links only with rows of the same set;
texts are used whole; an empty table gives an empty result; other columns pass through, those named like a result
column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idloom.llm.common import WordHashes, bounded_broadcast, discard, gram_hashes, join_split, materialize, mix, table, with_columns
from idloom.llm.components import components

BANDS, ROWS = 28, 4
#: Words of a shingle, and the least similarity in hundredths, unless a caller says otherwise.
WORDS, PERCENT = 5, 80
#: Candidates whose share of equal minima is so far under the threshold aren't confirmed: a pair at 0.8 has fewer than
#: 62 of 112 equal ones with probability 1e-9 (exact binomial).
SLACK = 0.25
_rng = np.random.default_rng(97)
_A = _rng.integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
RESULT = ("n_shingles", "component_id", "kept")


def shingles(text: bytes | None, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text; only A-Z are lower-cased."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    of = hashes.of(words)
    if len(of) < k:
        return mix(gram_hashes(of, len(of)) + np.uint64(len(of)))
    grams = np.sort(gram_hashes(of, k))
    return grams[np.concatenate([[True], grams[1:] != grams[:-1]])]


def signature(grams: np.ndarray) -> np.ndarray:
    """uint32 minima of the universal hash functions x -> ((a x + b) mod 2^64) div 2^32."""
    low = np.full(len(_A), np.uint32(0xFFFFFFFF))
    for i in range(0, len(grams), 512):
        part = grams[i : i + 512, None] * _A[None, :]
        part += _B
        np.minimum(low, (part.min(0) >> np.uint64(32)).astype(np.uint32), out=low)
    return low


def scan(docs: DataFrame, k: int, text_col: str, key: str) -> DataFrame:
    """(doc_id, digest, n_shingles, sig) of every row; digest and sig are null for empty sets. One narrow pass."""
    fields = [T.StructField("digest", T.BinaryType()), T.StructField("n_shingles", T.LongType()), T.StructField("sig", T.BinaryType())]
    hashes = WordHashes()

    def run(texts: list[bytes | None]) -> list:
        sets = [shingles(x, k, hashes) for x in texts]
        return [pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())]

    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text_col}`").alias("_text"))
    return with_columns(rows, "_text", fields, run).drop("_text")


def _buckets(classes: DataFrame) -> DataFrame:
    """(bucket, node) for every band of every class."""
    size = 4 * ROWS
    keys: Column = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", 1 + i * size, size)) for i in range(BANDS)])
    return classes.select(F.explode(keys).alias("bucket"), F.col("digest").alias("node"))


def _alike(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose signatures agree about as often as the threshold asks, and whose set sizes allow it."""
    left = classes.select(F.col("digest").alias("a"), F.col("sig").alias("sa"), F.col("n_shingles").alias("na"))
    right = classes.select(F.col("digest").alias("b"), F.col("sig").alias("sb"), F.col("n_shingles").alias("nb"))
    both = pairs.join(left, "a").join(right, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b", "sa", "sb")
    least = (percent / 100 - SLACK) * BANDS * ROWS

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sa, sb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for i in (2, 3))
                keep = pa.array((sa == sb).sum(1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return both.mapInArrow(run, "a binary, b binary")


def _sets(docs: DataFrame, wanted: DataFrame, k: int, text_col: str, key: str) -> DataFrame:
    """(node, grams) of the wanted classes (node, rep), from one row of each; a row that shares the id of another text
    is told apart by its digest."""
    rows = docs.select(F.col(f"`{key}`").alias("rep"), F.col(f"`{text_col}`").alias("_text")).join(bounded_broadcast(wanted, 64), "rep")
    hashes = WordHashes()

    def run(texts: list[bytes | None]) -> list:
        sets = [shingles(x, k, hashes).tobytes() for x in texts]
        return [pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())]

    got = with_columns(rows, "_text", [T.StructField("digest", T.BinaryType()), T.StructField("grams", T.BinaryType())], run)
    return got.where("digest = node").select("node", "grams").dropDuplicates(["node"])


def _overlap(sizes: Column, percent: int) -> Column:
    """The least intersection of two linked sets whose sizes add up to ``sizes``."""
    return F.floor((F.lit(percent) * sizes + F.lit(99 + percent)) / F.lit(100 + percent))


def _prefixes(sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Each set's rarest shingles (by how many of ``sets`` have them), as many as a linked set must share one of: if
    two sets overlap in ``o`` shingles, the first ``size - o + 1`` of both, in one order, have one in common."""

    def run(batches):
        for batch in batches:
            nodes = batch.column(0)
            grams = [np.frombuffer(v.as_buffer(), np.int64) for v in batch.column(1)]
            for i in range(0, len(grams), 500):
                part = grams[i : i + 500]
                at = np.repeat(np.arange(i, i + len(part)), [len(g) for g in part])
                yield pa.RecordBatch.from_arrays([nodes.take(pa.array(at)), pa.array(np.concatenate(part))], names=["node", "gram"])

    rows = sets.select("node", "grams").mapInArrow(run, "node binary, gram long")
    # a set holds a shingle once, so no shingle has more rows than there are sets: at most one row in a set's mean size
    ranked = rows.join(rows.groupBy("gram").agg(F.count("*").alias("df")), "gram").withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("df", "gram")))
    partner = F.greatest("least", F.ceil(F.lit(percent) * F.col("n") / 100))  # no linked set is smaller
    kept = F.col("n") - _overlap(F.col("n") + partner, percent) + 1
    return ranked.join(nodes, "node").where(F.col("rank") <= kept).select("node", "gram", "rank", "root", "n", "outside")


def _confirm(pairs: DataFrame, docs: DataFrame, reps: DataFrame, k: int, percent: int, text_col: str, key: str) -> DataFrame:
    """The pairs (a, b) that are links on their full sets, which are read for these pairs' classes only."""
    pairs = materialize(pairs, "candidates")
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = materialize(nodes.join(reps, "node").where(F.col("rep").isNotNull()), "wanted")
    sets = materialize(_sets(docs, wanted, k, text_col, key), "sets")
    links = _links(pairs, sets, percent)
    discard(pairs, wanted, sets)
    return links


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b")

    def run(batches):
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            links = []
            for x, y in zip(batch.column(at["ga"]), batch.column(at["gb"]), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                merged = np.sort(np.concatenate([x, y]))
                shared = int((merged[1:] == merged[:-1]).sum())
                links.append(100 * shared >= percent * (len(merged) - shared))
            keep = pa.array(links, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(at["a"]).filter(keep), batch.column(at["b"]).filter(keep)], names=["a", "b"])

    return materialize(both.select("a", "b", "ga", "gb").mapInArrow(run, "a binary, b binary"), "links")


def _labels(links: DataFrame) -> DataFrame:
    return materialize(components(links, "a", "b"), "components")


def near_duplicates(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: documents are linked if
    ``100 * |intersection| >= percent * |union|`` of their sets of k-word shingles."""
    rows = materialize(scan(docs, k, text_col, key), "signatures")
    classes = rows.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    classes = materialize(classes, "classes")
    reps = classes.select(F.col("digest").alias("node"), "rep")

    buckets = _buckets(classes)
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(join_split(buckets, sizes, ["bucket"]), "members")
    weights = members.groupBy("node").agg(F.sum("n").alias("weight"))  # a node has BANDS rows at most
    ranked = members.select("bucket", "node").join(weights, "node")
    pivots = ranked.groupBy("bucket").agg(F.max(F.struct("weight", "node")).alias("top")).select("bucket", F.col("top.node").alias("pivot"))
    met = join_split(members.select("bucket", "node"), pivots, ["bucket"])
    star = met.where("node != pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    links = _confirm(_alike(star, classes, percent), docs, reps, k, percent, text_col, key)

    # what is left: buckets whose members are in several components
    labels = _labels(links)
    size = classes.select(F.col("digest").alias("node"), F.col("n_shingles").alias("n"))
    placed = members.select("bucket", "node").join(labels, "node", "left").join(size, "node").select("bucket", "node", "n", F.coalesce("root", "node").alias("root"))
    per = placed.groupBy("bucket", "root").agg(F.count("*").alias("k"), F.min("n").alias("least"))
    open_ = per.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("k").alias("all"), F.max(F.struct("k", "root")).alias("top"), F.min("least").alias("least")).where("parts > 1 AND all > 2").select("bucket", "least", F.col("top.root").alias("largest"))
    nodes = join_split(placed, open_, ["bucket"]).groupBy("node", "root", "n").agg(F.min("least").alias("least"), F.bool_or(F.col("root") != F.col("largest")).alias("outside"))
    nodes = materialize(nodes.join(reps, "node").where(F.col("rep").isNotNull()), "open-classes")
    sets = materialize(_sets(docs, nodes.select("node", "rep"), k, text_col, key), "open-sets")
    prefixes = materialize(_prefixes(sets, nodes, percent), "prefixes")
    x = prefixes.where("outside").select("gram", F.col("node").alias("x"), F.col("root").alias("rx"), F.col("n").alias("nx"), F.col("rank").alias("ix"))
    y = prefixes.select("gram", F.col("node").alias("y"), F.col("root").alias("ry"), F.col("n").alias("ny"), F.col("rank").alias("iy"))
    need = _overlap(F.col("nx") + F.col("ny"), percent)
    rest = x.join(y, "gram").where((F.col("rx") != F.col("ry")) & (F.col("ix") <= F.col("nx") - need + 1) & (F.col("iy") <= F.col("ny") - need + 1))
    rest = rest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    more = _links(_alike(rest, classes, percent), sets, percent)
    labels = _labels(links.unionByName(more))

    named = labels.join(reps, "node")
    ids = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    ids = named.join(ids, "root").select(F.col("node").alias("digest"), "component_id")
    own = classes.select("digest", "rep").join(ids, "digest", "left").select("digest", F.coalesce("component_id", "rep").alias("component_id"))
    out = join_split(rows.select("doc_id", "digest", "n_shingles"), own, ["digest"], "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component: the one with the least id (a row without an id only if there is no
    other), and one of equal ones.

    Rows are told apart by a key of their own, written with them once, so repeated rows, rows without an id and several
    texts of one id are decided each for itself; rows without words stay. Only the keys to drop meet the texts:
    broadcast when their counted size is small, else by a shuffled anti join.
    """
    row = "_near_row"
    while row in {c.lower() for c in docs.columns}:
        row += "_"
    docs = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")
    found = materialize(near_duplicates(docs, k, percent, text_col, row).select(F.col("doc_id").alias(row), "component_id"), "placed")
    ids = found.join(docs.select(row, F.col(f"`{key}`").alias("_id")), row)
    stay = ids.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", row)).alias("top")).select(F.col("top").getField(row).alias(row))
    gone = materialize(found.select(row).join(stay, row, "left_anti"), "dropped")
    return docs.join(bounded_broadcast(gone, 40), row, "left_anti").drop(row)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)
