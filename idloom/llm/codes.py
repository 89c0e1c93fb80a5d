"""Vector code compression (operator 12): product codes from integer codebooks, found by kd-trees.

Every component becomes an integer (floor of SCALE times it), a vector is cut into PARTS equal parts, and each part
position has a codebook of up to ENTRIES entries, at first the parts of the kept vectors with the smallest ids. A round

1. builds one kd-tree for each codebook on the driver and broadcasts them (ENTRIES times the vector's width integers: a
   bound that doesn't depend on the number of vectors),
2. searches every part's nearest entry in its tree, for whole batches of vectors at once, and sums parts by entry within
   the task,
3. adds these integer sums up in Spark, by entry, and replaces each entry by the floor of its mean.

The search is branch and bound: a batch first descends to the leaf on each vector's own side of every split; then the
tree is walked once more, and a node is entered by those vectors whose distance to the node's box isn't *greater* than
their best so far. Nodes at an equal bound are entered too, since they may hold an entry of lower index at the same
distance. Distances are integers: in float64 while 2**53 isn't reached, which is checked for each batch, else in int64.

Rows read the input once a round, so it should be a table; nothing of it is shuffled but sums of entries, and in the end
one sum of errors for each label, joined back without a hot task.

Defined cases: rows with a null vector or with null or non-finite components are dropped, as are vectors whose length
isn't the width (that of the kept vector with the smallest id, lengths that PARTS doesn't divide left out). Of several rows
with one id the one with the smaller components counts first as a starting entry, repeated rows count each; null ids come last. With
fewer vectors than ENTRIES the codebooks are shorter; entries without parts stay as they are; ties go to the lower index.
Null labels are one label. Components too large for 64-bit errors (2**27 after scaling at a width of 64) are held at that limit.
Input columns other than id, vector and label aren't looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.llm.common import BROADCAST_BYTES, join_counted, materialize, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries of a leaf at most; smaller leaves prune more, larger ones use fewer steps.
LEAF = 16
#: Vectors that are searched together.
BATCH = 4096


# ---------------------------------------------------------------- kd-tree


@dataclass
class Node:
    low: np.ndarray  # the box around the node's entries
    high: np.ndarray
    entries: np.ndarray | None = None  # indexes of a leaf's entries, ascending
    axis: int = 0
    split: int = 0  # what is below goes left
    left: Node | None = None
    right: Node | None = None


def build(points: np.ndarray, entries: np.ndarray | None = None, leaf: int = LEAF) -> Node:
    """A kd-tree over ``points`` (entries by dimensions, int64). Equal points share a leaf, however many they are."""
    entries = np.arange(len(points)) if entries is None else entries
    own = points[entries]
    node = Node(own.min(axis=0), own.max(axis=0)) if own.size else Node(np.zeros(points.shape[1], np.int64), np.zeros(points.shape[1], np.int64))
    spread = node.high - node.low
    if len(entries) <= leaf or not spread.any():
        node.entries = entries
        return node
    node.axis = int(spread.argmax())
    values = own[:, node.axis]
    node.split = int(np.sort(values)[len(values) // 2])
    if node.split == values.min():
        node.split += 1
    below = values < node.split
    node.left, node.right = build(points, entries[below], leaf), build(points, entries[~below], leaf)
    return node


def squared(parts: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances of all parts to all points, exact in either kind of number."""
    if parts.dtype == np.int64:
        out = np.zeros((len(parts), len(points)), np.int64)
        for d in range(parts.shape[1]):
            out += (parts[:, d, None] - points[None, :, d]) ** 2
        return out
    return (parts * parts).sum(1)[:, None] - 2 * (parts @ points.T) + (points * points).sum(1)[None, :]


def nearest(tree: Node, points: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each part's nearest entry; of equally near ones the lowest index."""
    reach = int(max(np.abs(parts).max(initial=0), np.abs(points).max(initial=0)))
    if 4 * parts.shape[1] * reach * reach < 1 << 53:
        parts, points = parts.astype(np.float64), points.astype(np.float64)
    best = np.full(len(parts), np.iinfo(np.int64).max if parts.dtype == np.int64 else np.inf, parts.dtype)
    index, home = np.full(len(parts), len(points), np.int64), np.zeros(len(parts), np.int64)

    def scan(node: Node, rows: np.ndarray) -> None:
        distances = squared(parts[rows], points[node.entries])
        at = distances.argmin(axis=1)  # the first of equal ones, and a leaf's entries ascend
        found, entry = distances[np.arange(len(rows)), at], node.entries[at]
        better = (found < best[rows]) | ((found == best[rows]) & (entry < index[rows]))
        best[rows[better]], index[rows[better]] = found[better], entry[better]

    def descend(node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if node.entries is not None:
            home[rows] = id(node)
            return scan(node, rows)
        below = parts[rows, node.axis] < node.split
        descend(node.left, rows[below])
        descend(node.right, rows[~below])

    def bound(node: Node, rows: np.ndarray) -> np.ndarray:
        own = parts[rows]
        outside = np.maximum(np.maximum(node.low - own, own - node.high), 0)
        return (outside * outside).sum(axis=1)

    def visit(node: Node, rows: np.ndarray) -> None:
        rows = rows[bound(node, rows) <= best[rows]]
        if node.entries is not None:
            rows = rows[home[rows] != id(node)]
            if len(rows):
                scan(node, rows)
        elif len(rows):
            visit(node.left, rows)
            visit(node.right, rows)

    everyone = np.arange(len(parts))
    descend(tree, everyone)
    visit(tree, everyone)
    return index, best.astype(np.int64)


# ---------------------------------------------------------------- rounds over all vectors


def kept_vectors(df: DataFrame, vector_col: str = "embedding", key: str = "vec_id", label: str = "label") -> DataFrame:
    """(vec_id, label, vector) of the rows with finite vectors."""
    finite = F.forall(F.col("vector"), lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return df.select(F.col(f"`{key}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector_col}`").alias("vector")).where(finite)


def integers(vectors: pa.Array, width: int) -> np.ndarray:
    """Scaled integer components, rows by width, within what keeps a vector's squared distances under 2**62."""
    limit = math.isqrt((1 << 62) // max(width, 1)) // 2
    flat = pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(flat * SCALE), -limit, limit).astype(np.int64).reshape(len(vectors), width)


def starting_codebooks(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> tuple[int, np.ndarray]:
    """(width, codebooks: parts by entries by components) from the kept vectors with the smallest ids."""
    usable = kept.where((F.size("vector") > 0) & (F.size("vector") % parts == 0))
    order = [F.col("vec_id").asc_nulls_last(), F.col("vector")]
    first = usable.orderBy(*order).select(F.size("vector")).first()
    if first is None:
        return 0, np.zeros((parts, 0, 0), np.int64)
    width = first[0]
    rows = usable.where(F.size("vector") == width).orderBy(*order).select("vector").limit(entries).toArrow()
    vectors = integers(rows.column(0).combine_chunks(), width)
    return width, np.ascontiguousarray(vectors.reshape(len(vectors), parts, width // parts).transpose(1, 0, 2))


def _searched(batches, books, trees, width):
    """(batch, scaled parts, indexes, distances) for each run of vectors."""
    parts = len(books)
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH):
            part = batch.slice(start, BATCH)
            values = integers(part.column(part.num_columns - 1), width).reshape(part.num_rows, parts, width // parts)
            found = [nearest(trees[p], books[p], np.ascontiguousarray(values[:, p])) for p in range(parts)]
            yield part, values, [i for i, _ in found], [d for _, d in found]


def next_codebooks(vectors: DataFrame, books: np.ndarray, width: int) -> np.ndarray:
    """One round: every entry becomes the floor of the mean of its parts, sums being made in the tasks and then in Spark."""
    spark = vectors.sparkSession
    parts, entries, size = books.shape
    shared = spark.sparkContext.broadcast((books, [build(b) for b in books]))

    def run(batches):
        books, trees = shared.value
        n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, size), np.int64)
        for _, values, indexes, _ in _searched(batches, books, trees, width):
            for p in range(parts):
                n[p] += np.bincount(indexes[p], minlength=entries)
                order = np.argsort(indexes[p], kind="stable")
                there, first = np.unique(indexes[p][order], return_index=True)
                sums[p, there] += np.add.reduceat(values[order, p], first, axis=0)
        p, e = np.nonzero(n)
        if len(p):
            columns = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), *(pa.array(sums[p, e, d]) for d in range(size))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["part", "entry", "n", *(f"s{d}" for d in range(size))]
    schema = "part int, entry int, " + ", ".join(f"{c} long" for c in names[2:])
    totals = vectors.select("vector").mapInArrow(run, schema).groupBy("part", "entry").agg(*[F.sum(F.col(c).cast("decimal(19,0)")).alias(c) for c in names[2:]])
    new = books.copy()
    for row in totals.collect():  # parts times entries rows at most
        new[row[0], row[1]] = [int(s) // int(row[2]) for s in row[3:]]
    shared.unpersist()
    return new


def train(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[int, np.ndarray]:
    """(width, codebooks after all rounds)."""
    width, books = starting_codebooks(kept, parts, entries)
    for _ in range(rounds if width else 0):
        books = next_codebooks(kept.where(F.size("vector") == width), books, width)
    return width, books


def encode(kept: DataFrame, width: int, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every vector: its entries' indexes in part order, two hex digits each (more where a
    codebook has more than 256 entries), and its squared distances summed over the parts."""
    digits = max(2, len(f"{max(books.shape[1] - 1, 0):x}"))
    shared = kept.sparkSession.sparkContext.broadcast((books, [build(b) for b in books] if width else []))
    dtypes = dict(kept.dtypes)

    def run(batches):
        books, trees = shared.value
        for part, _, indexes, distances in _searched(batches, books, trees, width):
            code = ["".join(f"{i:0{digits}x}" for i in row) for row in zip(*(x.tolist() for x in indexes), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(code, pa.string()), pa.array(np.sum(distances, axis=0))], names=["vec_id", "label", "code", "error"])

    return kept.where(F.size("vector") == (width or -2)).mapInArrow(run, f"vec_id {dtypes['vec_id']}, label {dtypes['label']}, code string, error long")


def decode(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """``coded`` with ``decoded``: the entries' components, scaled back, in the vector's order (a null code: null)."""
    digits = max(2, len(f"{max(books.shape[1] - 1, 0):x}"))
    shared = coded.sparkSession.sparkContext.broadcast(books / SCALE)

    @F.pandas_udf("array<double>")
    def looked_up(code: pd.Series) -> pd.Series:
        books = shared.value
        return code.map(lambda c: None if c is None else np.concatenate([books[p, int(c[p * digits : (p + 1) * digits], 16)] for p in range(len(books))]))

    return coded.withColumn("decoded", looked_up("code"))


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error, the errors of its label summed. Sums are broadcast if their measured size is under
    BROADCAST_BYTES, else joined with hot labels apart."""
    coded = materialize(coded.withColumn("_label", F.when(F.col("label").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col("label").cast("string")))), "codes")
    sums = materialize(coded.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "errors")
    total, size = sums.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.octet_length("_label") + 40), F.lit(0))).first()
    if size <= BROADCAST_BYTES:
        return coded.join(F.broadcast(sums.drop("n")), "_label").drop("_label")
    return join_counted(coded, sums, ["_label"], total, row_bytes=F.octet_length("_label") + 40).drop("_label")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = kept_vectors(table(spark, sf_dir, "embeddings"))
    width, books = train(kept)
    coded = with_label_errors(encode(kept, width, books))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
