"""Target-distribution importance resampling (operator 13) by an external sort-count of hashed features.

Features are all runs of one to GRAMS consecutive words; a feature's bucket is the CRC-32 of its bytes modulo BUCKETS.

1. *Write*: one narrow pass packs the buckets of each block of documents into one uint16 stream, with the documents'
   offsets in it, and writes the blocks to the shared folder. Texts aren't read again after that.
2. *Sort and count*: tasks read streams, sort runs of them (a radix sort, as the keys have 16 bits) and run-length
   encode these; Spark adds up the runs, of which no task sends more than BUCKETS for each SORT_FEATURES features. The target's
   texts go the same way.
3. *Gather*: a bucket's gain is the scaled log-ratio of its smoothed shares in target and corpus. The BUCKETS gains are
   broadcast (a bound that doesn't depend on the input); tasks gather them along each stream and add them up by document
   with ``np.add.reduceat`` at the offsets.
4. *Draw*: a document's score is its weight (the floored mean gain) plus Gumbel noise from a digest of its id; of the N
   documents with MIN_WORDS words, the best PERCENT of N are drawn. Ranks come from a range partitioning by score, id and
   the row's place, so that no partition is hot even where a third of all rows are equal; counts of partitions, summed up,
   give each row its rank.

Defined cases: null and empty texts have no features, weight 0, and aren't drawn; repeated rows count and are drawn each;
ties of score go to the smaller id, then to the row's place in the written blocks; a null id has the digest of an empty id
and comes last among ties; very long texts are cut at word borders while they are hashed, never left out; input columns
other than text and id aren't looked at; an empty table gives an empty result, and an empty target has shares 1/BUCKETS.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idloom.llm.common import CACHE_WORDS, binary, join_split, materialize, steps, table

BUCKETS, GRAMS, MIN_WORDS, PERCENT, SEED = 10_000, 2, 20, 25, 7
#: Features that are sorted together: 8 MB.
SORT_FEATURES = 4 << 20
#: Bytes of a text that are split into words at a time.
SPAN_BYTES = 1 << 20
#: A-Z to lower case; every other ASCII character that is no digit or letter to a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


# ---------------------------------------------------------------- features


class Checksums(dict):
    """Word -> CRC-32 of the word and ``end``, computed once while in the cache."""

    def __init__(self, end: bytes = b""):
        self.end = end

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = zlib.crc32(self.end, zlib.crc32(word))
        return value


_alone, _before_blank = Checksums(), Checksums(b" ")


def spans(text: bytes, most: int = SPAN_BYTES) -> Iterator[list[bytes]]:
    """The words of a text in runs; a text is cut between words only."""
    folded, start = text.translate(_FOLD), 0
    while start < len(folded):
        end = start + most
        if end < len(folded):
            cut = folded.find(b" ", end)
            end = len(folded) if cut < 0 else cut
        yield folded[start:end].split()
        start = end


def features(text: bytes | None, buckets: int = BUCKETS, grams: int = GRAMS) -> tuple[int, np.ndarray]:
    """(words, buckets of all features as uint16) of a text."""
    n, out, before = 0, [], []
    for words in spans(text or b""):
        n += len(words)
        out.append(np.fromiter(map(_alone.__getitem__, words), np.uint32, len(words)))
        words = before + words
        starts = list(map(_before_blank.__getitem__, words)) if grams > 1 else []
        for k in range(2, grams + 1):
            ends = list(map(zlib.crc32, words[k - 1 :], starts))  # each goes on from the run without its last word
            out.append(np.array(ends[max(len(before) - k + 1, 0) :], np.uint32))  # those that end in this span
            starts = [zlib.crc32(b" ", c) for c in ends] if k < grams else []
        before = words[-(grams - 1) :] if grams > 1 else []
    return n, (np.concatenate(out) % np.uint32(buckets)).astype(np.uint16) if out else np.empty(0, np.uint16)


def streams(docs: DataFrame, buckets: int = BUCKETS, grams: int = GRAMS, text_col: str = "text", key: str | None = "doc_id") -> DataFrame:
    """Written blocks of documents: (doc_ids, n_words, offsets, stream, block). Document i's buckets are the stream's uint16
    from offsets[i] to the next offset; ``block`` numbers the blocks, and is fixed as it is written with them."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a packed stream holds 1 to 65536 buckets")
    rows = docs.select((F.lit(None).cast("long") if key is None else F.col(f"`{key}`")).alias("doc_id"), F.col(f"`{text_col}`").alias("_text"))
    id_type = rows.schema["doc_id"].dataType

    def run(batches):
        for batch in batches:
            for part in steps(batch, 1):
                made = [features(text, buckets, grams) for text in binary(part.column(1))]
                offsets = np.cumsum([0, *(len(f) for _, f in made)])
                stream = np.concatenate([f for _, f in made]).astype("<u2").tobytes()
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([ids, pa.array([[n for n, _ in made]], pa.list_(pa.int64())), pa.array([offsets.tolist()], pa.list_(pa.int64())), pa.array([stream], pa.binary())], names=schema.names)

    schema = T.StructType([T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("n_words", T.ArrayType(T.LongType())), T.StructField("offsets", T.ArrayType(T.LongType())), T.StructField("stream", T.BinaryType())])
    return materialize(rows.mapInArrow(run, schema).withColumn("block", F.monotonically_increasing_id()), "streams")


# ---------------------------------------------------------------- counts and gains


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, times) of sorted values."""
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)
    return values[first], np.diff(np.append(first, len(values)))


def bucket_counts(blocks: DataFrame) -> DataFrame:
    """(bucket, n): how many features all streams have in each bucket."""

    def run(batches):
        held, size = [], 0

        def counted():
            bucket, n = runs(np.sort(np.concatenate(held), kind="stable"))
            return pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(n.astype(np.int64))], names=["bucket", "n"])

        for batch in batches:
            for stream in batch.column(0).to_pylist():
                held.append(np.frombuffer(stream, "<u2"))
                size += len(held[-1])
                if size >= SORT_FEATURES:
                    yield counted()
                    held, size = [], 0
        if size:
            yield counted()

    return blocks.select("stream").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket, in doubles and floored."""
    s_all, t_all = float(sum(corpus.values()) + buckets), float(sum(target.values()) + buckets)
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1.0) * s_all / ((corpus.get(b, 0) + 1.0) * t_all))) for b in range(buckets)], np.int64)


def fit(blocks: DataFrame, target_blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gains from the streams of corpus and target; a count for each bucket is all that reaches the driver."""
    return gains(*({r["bucket"]: r["n"] for r in bucket_counts(b).collect()} for b in (blocks, target_blocks)), buckets)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight, place) of every document; ``place`` is unique and fixed by the blocks."""
    shared = blocks.sparkSession.sparkContext.broadcast(gain)
    id_type = blocks.schema["doc_ids"].dataType.elementType

    def run(batches):
        gain = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                ids, words, offsets, stream, block = (batch.column(k)[i] for k in range(5))
                offsets = np.array(offsets.as_py(), np.int64)
                sizes, total = np.diff(offsets), np.zeros(len(offsets) - 1, np.int64)
                full = np.flatnonzero(sizes)  # reduceat would give an empty document its neighbour's first gain
                if len(full):
                    total[full] = np.add.reduceat(gain[np.frombuffer(stream.as_py(), "<u2")], offsets[full])
                weight = total // np.maximum(sizes, 1)
                place = pa.StructArray.from_arrays([pa.array(np.full(len(sizes), block.as_py(), np.int64)), pa.array(np.arange(len(sizes)))], names=["block", "row"])
                yield pa.RecordBatch.from_arrays([ids.values, words.values, pa.array(sizes), pa.array(weight), place], names=["doc_id", "n_words", "n_features", "weight", "place"])

    schema = T.StructType([T.StructField("doc_id", id_type), *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")), T.StructField("place", T.StructType([T.StructField("block", T.LongType()), T.StructField("row", T.LongType())]))])
    return blocks.select("doc_ids", "n_words", "offsets", "stream", "block").mapInArrow(run, schema)


# ---------------------------------------------------------------- draw


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of a digest of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def ranked(weighed: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """``weighed`` with score and rank (null: not drawn)."""
    scored = materialize(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    able = scored.where(F.col("n_words") >= min_words)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("place")]
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = able.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the number that Spark gives a row holds its partition and, in the lower 33 bits, its place there
    placed = materialize(placed.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    sizes = sorted(placed.groupBy(part.alias("p")).count().collect())  # a row for each partition
    starts, n = [], 0
    for p, count in sizes:
        starts.append((p, n))
        n += count
    drawn = percent * n // 100
    before = F.broadcast(scored.sparkSession.createDataFrame(starts, "_part long, _before long"))
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    with_rank = placed.withColumn("_part", part).join(before, "_part").withColumn("rank", F.when(rank <= drawn, rank))
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return with_rank.select(*scored.columns, "rank").unionByName(rest)


def importance(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs``, against the texts of ``target``."""
    blocks = streams(docs, text_col=text_col, key=key)
    gain = fit(blocks, streams(target, text_col=target_col, key=None))
    return ranked(weights(blocks, gain)).drop("place")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id") -> DataFrame:
    """The drawn rows of ``docs``, whole (of an id that several rows share, all if one is drawn)."""
    drawn = importance(docs, target, key=key).where(F.col("rank").isNotNull()).select("doc_id").distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    kept = join_split(docs.select(F.col(f"`{key}`").alias("doc_id"), row.alias("_row")), drawn, ["doc_id"])
    return kept.select("_row.*")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
