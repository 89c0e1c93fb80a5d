"""What the operators of this subpackage share: scratch tables, row-wise Arrow passes, words and hashes.

A *word* is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``: exactly what ``bytes.split()`` returns
for UTF-8 text, so no regular expression is needed.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one step of a row-wise pass handles at most (a single longer text is handled alone).
STEP_BYTES = 2 << 20
#: Entries of a per-worker word cache; it is emptied when full, so a worker's memory stays bounded.
CACHE_WORDS = 350_000


# ---------------------------------------------------------------- scratch tables


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset, a local Spark gets a temporary folder; on a
    cluster it is an error, as a folder of one machine wouldn't reach the others."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-idloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the files behind materialized frames that no later frame reads."""
    for df in frames:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for f in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_split(many: DataFrame, one: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``many`` joined with ``one`` (inner or left), whose keys are unique, so that adaptive execution can split hot keys.

    A side that was grouped by the keys needs no shuffle of its own for a join on them, and then the other side's
    partitions can't be split. The join is therefore on a struct of the keys, for which both sides are shuffled; the rows
    of ``one`` that meet a split partition are copied to its parts.
    """
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)]).alias("_key_struct")
    other = one.select(key, *[F.col(c) for c in one.columns if c not in keys])
    return many.select(key, "*").join(other, "_key_struct", how).drop("_key_struct")


#: A key is hot if it holds more than a HOT_KEYS-th of all rows, so there are fewer than HOT_KEYS such keys.
HOT_KEYS, BROADCAST_BYTES, SALTS = 1000, 16 << 20, 32


def join_counted(many: DataFrame, one: DataFrame, keys: list[str], total: int, count: str = "n", how: str = "inner", row_bytes: Column | None = None) -> DataFrame:
    """``many`` joined with ``one`` (inner or left), without a hot task: ``one`` has unique keys, and its column ``count``
    says how many of the ``total`` rows of ``many`` have them. ``one`` is read more than once, so it should be written.

    Hot keys are fewer than HOT_KEYS: their rows of ``one`` are broadcast if their summed ``row_bytes`` (64 each where not
    given) are under BROADCAST_BYTES, else copied to SALTS salts. The other keys meet in a shuffled join.
    """
    hot = one.where(F.col(count) * HOT_KEYS > F.lit(total))
    found, size = hot.agg(F.count("*"), F.coalesce(F.sum(F.lit(64) if row_bytes is None else row_bytes), F.lit(0))).first()
    if not found:
        return many.join(one.drop(count), keys, how)
    names = F.broadcast(hot.select(*keys))
    cold = many.join(names, keys, "left_anti").join(one.join(names, keys, "left_anti").drop(count), keys, how)
    if size <= BROADCAST_BYTES:
        return cold.unionByName(many.join(F.broadcast(hot.drop(count)), keys))
    salted = many.join(names, keys, "left_semi").withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in many.columns]), F.lit(SALTS)))
    copies = hot.drop(count).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return cold.unionByName(salted.join(copies, [*keys, "_salt"]).drop("_salt"))


def bounded_broadcast(df: DataFrame, row_bytes: int, max_bytes: int = 16 << 20) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows fit ``max_bytes``, else unchanged (the join then shuffles)."""
    return F.broadcast(df) if df.count() * row_bytes <= max_bytes else df


# ---------------------------------------------------------------- row-wise passes over text


def steps(batch: pa.RecordBatch, column: int, max_bytes: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold about ``max_bytes`` together."""
    texts = batch.column(column)
    ends = np.cumsum([len(x) if x is not None else 0 for x in binary(texts)]) if len(texts) else []
    start, floor = 0, 0
    while start < len(texts):
        stop = max(int(np.searchsorted(ends, floor + max_bytes, "right")), start + 1)
        yield batch.slice(start, stop - start)
        start, floor = stop, int(ends[stop - 1])


def binary(texts: pa.Array) -> list[bytes | None]:
    return texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist()


def with_columns(docs: DataFrame, text_col: str, fields: list[T.StructField], fn: Callable[[list[bytes | None]], list]) -> DataFrame:
    """``docs`` with the columns that ``fn`` makes from each run of texts (UTF-8 bytes or None).

    One narrow pass: no shuffle, every other column goes through untouched. Input columns that have the name of a
    new one are dropped first, so clashing names never reach the result.
    """
    new = {f.name for f in fields}
    keep = [f for f in docs.schema.fields if f.name == text_col or f.name not in new]
    docs = docs.select(*[F.col(f"`{f.name}`") for f in keep])
    at, drop_text = [f.name for f in keep].index(text_col), text_col in new
    result = [f for f in keep if not (drop_text and f.name == text_col)] + fields
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(result)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, at):
                old = [c for i, c in enumerate(part.columns) if not (drop_text and i == at)]
                made = [x if isinstance(x, pa.Array) else pa.array(x) for x in fn(binary(part.column(at)))]
                yield pa.RecordBatch.from_arrays(old + made, names=schema.names)

    # names with dots can't go through mapInArrow, so columns go by number
    return docs.toDF(*[f"c{i}" for i in range(len(keep))]).mapInArrow(run, schema).toDF(*[f.name for f in result])


def keep_where(docs: DataFrame, text_col: str, annotate: Callable[[DataFrame], DataFrame], condition: Column) -> DataFrame:
    """The rows of ``docs`` for which ``condition`` holds on what ``annotate`` adds to a frame with the column ``_text``.
    Every input column comes back as it was, whatever its name."""
    others = [c for c in docs.columns if c != text_col]
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None).cast("struct<none:int>")
    kept = annotate(docs.select(row.alias("_row"), F.col(f"`{text_col}`").alias("_text"))).where(condition)
    return kept.select(*[F.col("_text").alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns])


# ---------------------------------------------------------------- words and hashes


class WordHashes(dict):
    """Word -> 64-bit hash, computed once for each word while it is in the cache."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = {True: np.ones(1, np.uint64), False: np.ones(1, np.uint64)}


def _power(n: int, inverse: bool) -> np.ndarray:
    if len(_powers[inverse]) < n:
        step = np.full(max(n, 1 << 14), _INVERSE if inverse else _BASE, np.uint64)
        step[0] = 1
        _powers[inverse] = np.multiply.accumulate(step)
    return _powers[inverse][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches the high bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive words, by differences of one polynomial prefix sum."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    sums = np.empty(len(hashes) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(hashes * _power(len(hashes), False), out=sums[1:])
    return mix((sums[k:] - sums[:n]) * _power(n, True))


def slices(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(first, end) of runs of neighbours whose sizes add up to ``most`` at most (a larger single one goes alone)."""
    ends, out, start, floor = np.cumsum(sizes), [], 0, 0
    while start < len(sizes):
        stop = max(int(np.searchsorted(ends, floor + most, "right")), start + 1)
        out.append((start, stop))
        start, floor = stop, int(ends[stop - 1])
    return out


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def fold_of(key: Column, n: int) -> Column:
    """crc32(decimal text of the key) mod n, in the JVM."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(n)
