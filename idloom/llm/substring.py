"""Substring deduplication (operator 6): relative Lempel-Ziv factors against indexed reference blocks.

A *window* is ``span`` consecutive words. Its *anchor* is the GRAM words in it with the least hash (the first of
them), so equal windows have equal anchors at the same place, and each window has exactly one.

1. One narrow pass finds every document's anchors, each with the range of windows that it owns. Equal texts form one
   class, scanned once; in a class of two or more every window is repeated.
2. Anchors found once are dropped by a grouped count. For each other anchor one occurrence becomes the reference. The
   index holds the reference blocks: BLOCK words of a document around its references, and what their windows reach.
3. A document is routed to every block that holds the reference of one of its anchors, and is parsed against it from
   left to right: the longest factor that the block holds, then the next from its end (one word where there is none).
   Windows inside a factor of ``span`` words or more are repeated, in the document and in the block.
4. Factors are checked at their boundaries: a window that starts in a factor and ends behind it may lie in a match that
   the greedy parse passed over, so these, and only these, are looked up among the block's longest matches. What is then
   left isn't in its anchor's block, for every occurrence alike, and can only repeat another window that is left: these
   are checked by grouping their 128-bit digests.
5. Repeated windows become covered words, which are removed.

Each occurrence meets one block, so no pair of occurrences is formed within a group, however large. Hot anchors, blocks
and digests are joined by :func:`~idloom.llm.common.join_counted`; masks of repeated windows (64 window starts each)
are merged by a bitwise or, with map-side combine.

Defined cases: a null or empty text has no words and nothing is removed; texts shorter than a window are never
touched; repeated rows and equal texts repeat each other; null ids are allowed (rows are told apart by their texts);
overlapping repeats within one document count; texts are used whole (long runs are parsed in pieces of PIECE windows);
an empty table gives an empty result; other columns pass through, those named like a result column are replaced.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idloom.llm.common import WordHashes, as_long, gram_hashes, join_counted, materialize, mix, slices, table, with_columns

#: Words of a window and of an anchor. Anchors of one window start within its first SPAN - GRAM + 1 words.
SPAN, GRAM = 35, 8
#: Words of a reference block (besides what its windows reach on either side), and windows parsed at once at most.
BLOCK, PIECE = 64, 2048
#: Windows handled at once when anchors are looked for; pairs of equal places handled at once by a parse.
CHUNK, PAIRS = 1 << 14, 1 << 20
#: Bytes of texts and blocks that are parsed together.
STEP = 1 << 20


def anchors(hashes: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hashes, positions, first and last owned window)."""
    reach = span - GRAM + 1
    grams = gram_hashes(hashes, GRAM)
    n = len(hashes) - span + 1
    if n <= 0:
        return np.empty(0, np.uint64), *(np.empty(0, np.int32) for _ in range(3))
    view = sliding_window_view(grams, reach)
    owner = np.concatenate([view[i : i + CHUNK].argmin(1) for i in range(0, n, CHUNK)]) + np.arange(n)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    last = np.concatenate([first[1:], [n]]) - 1
    at = owner[first]
    return grams[at], at.astype(np.int32), first.astype(np.int32), last.astype(np.int32)


def text_key(text: Column) -> Column:
    """A 128-bit key of a text's bytes (a prefix of its SHA-256; null like empty)."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def scan(docs: DataFrame, span: int, text_col: str, key: str) -> DataFrame:
    """(doc_id, cls, n_words, kept_sha256, anchor, pos, first, last) of every row: kept_sha256 is that of all words."""
    places = ("pos", "first", "last")
    fields = [T.StructField("n_words", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    fields += [T.StructField("anchor", T.ArrayType(T.LongType())), *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in places)]
    hashes = WordHashes()

    def run(texts: list[bytes | None]) -> list:
        n, sha, found = [], [], []
        for text in texts:
            words = (text or b"").split()
            n.append(len(words))
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            found.append(anchors(hashes.of(words), span))
        ends = np.cumsum([0, *(len(x[1]) for x in found)]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([as_long(x[j]) if j == 0 else x[j] for x in found]))) for j in range(4)]
        return [pa.array(n, pa.int64()), pa.array(sha), *lists]

    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), text_key(F.col(f"`{text_col}`")).alias("cls"), F.col(f"`{text_col}`").alias("_text"))
    return with_columns(rows, "_text", fields, run).drop("_text")


# ---------------------------------------------------------------- the index and its use


def _blocks(touched: DataFrame, span: int) -> DataFrame:
    """(ref_cls, ref_block, start, block) from (cls, blocks, _text): the words of every reference block, from ``start``."""
    schema = "ref_cls binary, ref_block int, start int, block binary"

    def run(batches):
        for batch in batches:
            for cls, blocks, text in zip(batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()), strict=True):
                words, numbers = text.as_py().split(), sorted(set(blocks.as_py()))
                starts = [max(b * BLOCK - (span - GRAM), 0) for b in numbers]
                made = [b" ".join(words[s : b * BLOCK + BLOCK + span]) for s, b in zip(starts, numbers, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([cls.as_py()] * len(numbers), pa.binary()), pa.array(numbers, pa.int32()), pa.array(starts, pa.int32()), pa.array(made, pa.binary())], names=["ref_cls", "ref_block", "start", "block"])

    return touched.where(F.size("blocks") > 0).select("cls", "blocks", "_text").mapInArrow(run, schema)


@dataclass
class Parse:
    """Documents and the blocks that they are routed to, parsed together: see :meth:`run`."""

    span: int
    hashes: WordHashes
    blocks: dict = field(default_factory=dict)  # (ref_cls, ref_block) -> number
    block_info: list = field(default_factory=list)  # (ref_cls, first word, words)
    pieces: list = field(default_factory=list)  # (cls, first window, windows, block number, words)

    def add(self, cls: bytes, hits: list[dict], text: bytes, refs: list[dict]) -> None:
        """A document's hits (first and last owned window, block) and the blocks themselves."""
        for r in refs:
            if (r["ref_cls"], r["ref_block"]) not in self.blocks:
                self.blocks[r["ref_cls"], r["ref_block"]] = len(self.block_info)
                self.block_info.append((r["ref_cls"], r["start"], r["block"].split()))
        words, runs = text.split(), []
        for first, last, block in sorted((h["first"], h["last"], self.blocks[h["ref_cls"], h["ref_block"]]) for h in hits):
            if runs and runs[-1][2] == block and runs[-1][1] + 1 == first:
                runs[-1][1] = last
            else:
                runs.append([first, last, block])
        for first, last, block in runs:
            for at in range(first, last + 1, PIECE):
                n = min(PIECE, last + 1 - at)
                self.pieces.append((cls, at, n, block, words[at : at + n + self.span - 1]))

    def run(self):
        """(own windows, windows of blocks, windows that are left): the first two as (cls, start) of repeated windows,
        the last as (cls, start, digest)."""
        own, there, left = [], [], []
        if not self.pieces:
            return own, there, left
        sizes = [len(p[4]) for p in self.pieces]
        index = _Index([b[2] for b in self.block_info], self.hashes)
        for i, j in slices(np.array(sizes) * index.most, PAIRS):
            self._part(self.pieces[i:j], index, own, there, left)
        return own, there, left

    def _part(self, pieces: list, index: _Index, own: list, there: list, left: list) -> None:
        words = [w for p in pieces for w in p[4]]
        sizes = np.array([len(p[4]) for p in pieces])
        begin = np.cumsum(sizes) - sizes
        block = np.array([p[3] for p in pieces])
        i, j = index.equal_places(self.hashes.of(words), np.repeat(block, sizes), np.repeat(begin + sizes, sizes))
        # a block of the same document: a place doesn't match itself
        piece = np.searchsorted(begin, i, "right") - 1
        shift = np.array([p[1] - self.block_info[p[3]][1] if p[0] == self.block_info[p[3]][0] else -1 << 40 for p in pieces])
        apart = i - begin[piece] + shift[piece] != j - index.begin[block[piece]]
        i, j = i[apart], j[apart]
        end = _match_ends(i, j, words, index.words, self.span)
        reach = np.zeros(len(words) + 1, np.int64)
        np.maximum.at(reach, i, end)
        repeated = np.zeros(len(words), bool)
        starts = np.flatnonzero(reach)
        for p, b in zip(pieces, begin.tolist(), strict=True):
            stop = b + len(p[4])
            for f, e in _greedy(reach, starts, b, stop):
                edge = max(e - self.span + 1, f)
                repeated[f:edge] = True
                # windows across the factor's end: is there a match that starts in the factor and reaches far enough?
                across = np.arange(edge, e)
                repeated[across] = reach[across] - across >= self.span
            repeated[b + p[2] : stop] = False  # too near the end to start a window here
            at = np.flatnonzero(repeated[b : b + p[2]])
            own.extend((p[0], p[1] + w) for w in at.tolist())
            for w in np.flatnonzero(~repeated[b : b + p[2]]).tolist():
                left.append((p[0], p[1] + w, xxhash.xxh3_128_digest(b" ".join(p[4][w : w + self.span]))))
        hit = repeated[i] & (end - i >= self.span)
        for number, place in np.unique(np.stack([index.block_of[j[hit]], j[hit]]), axis=1).T.tolist():
            cls, start, _ = self.block_info[number]
            there.append((cls, start + place - int(index.begin[number])))


class _Index:
    """The GRAM-word places of some blocks, sorted by hash and block."""

    def __init__(self, blocks: list[list[bytes]], hashes: WordHashes):
        self.words = [w for b in blocks for w in b]
        sizes = np.array([len(b) for b in blocks])
        self.begin = np.cumsum(sizes) - sizes
        self.block_of = np.repeat(np.arange(len(blocks)), sizes)
        self.keys, at = _places(hashes.of(self.words), self.block_of, np.repeat(self.begin + sizes, sizes))
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.at = self.keys[order], at[order]
        #: equal places of one key at most
        self.most = int(np.diff(np.flatnonzero(np.concatenate([[True], self.keys[1:] != self.keys[:-1], [True]]))).max(initial=1))

    def equal_places(self, hashes: np.ndarray, block: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (place here, place in the block) with equal GRAM words."""
        keys, at = _places(hashes, block, end)
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        n = high - low
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.at[np.repeat(low, n) + within]


def _places(hashes: np.ndarray, block: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key of GRAM words and block, place) of all places that don't reach over the end of their text."""
    grams = gram_hashes(hashes, GRAM)
    at = np.flatnonzero(np.arange(len(grams)) + GRAM <= end[: len(grams)])
    return mix(grams[at] + block[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), at


def _match_ends(i: np.ndarray, j: np.ndarray, words: list[bytes], others: list[bytes], span: int) -> np.ndarray:
    """Where the longest match through each pair of equal places ends (in ``words``); long ones are compared by words."""
    if not len(i):
        return i
    order = np.lexsort((i, j - i))
    a, b = i[order], j[order]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1] + 1) | (b[1:] != b[:-1] + 1)]))
    last = np.append(new[1:], len(a)) - 1
    stop = a[last] + GRAM
    for k in np.flatnonzero(stop - a[new] >= span).tolist():
        x, y, z = int(a[new[k]]), int(b[new[k]]), int(stop[k])
        if words[x:z] != others[y : y + z - x]:  # words of equal hashes that differ
            stop[k] = x
    end = np.empty_like(i)
    end[order] = np.repeat(stop, last - new + 1)
    return end


def _greedy(reach: np.ndarray, starts: np.ndarray, begin: int, stop: int):
    """The factors (first, end) of the words from ``begin`` to ``stop``: always the longest, from the last one's end."""
    at = begin
    while at < stop:
        if reach[at] > at:
            yield at, int(reach[at])
            at = int(reach[at])
        else:
            k = int(np.searchsorted(starts, at + 1))
            if k == len(starts):
                return
            at = int(starts[k])


def _masks(windows: list[tuple[bytes, int]]) -> dict[tuple[bytes, int], int]:
    """(cls, start // 64) -> mask of starts, as a signed 64-bit number."""
    masks: dict[tuple[bytes, int], int] = {}
    for cls, start in windows:
        key = cls, start >> 6
        masks[key] = masks.get(key, 0) | 1 << (start & 63)
    return {k: m - (1 << 64) if m >> 63 else m for k, m in masks.items()}


def _factors(routed: DataFrame, span: int) -> DataFrame:
    """From (cls, hits, refs, _text): (cls, at, mask, null) of repeated windows, and (cls, start, 0, digest) of the
    windows that aren't in their anchor's block."""
    hashes = WordHashes()
    schema = "cls binary, at int, mask long, digest binary"

    def result(parse: Parse) -> pa.RecordBatch:
        own, there, left = parse.run()
        masks = _masks(own + there)
        columns = [c for c, _ in masks] + [x[0] for x in left], [a for _, a in masks] + [x[1] for x in left], [*masks.values(), *[0] * len(left)], [None] * len(masks) + [x[2] for x in left]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.binary(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["cls", "at", "mask", "digest"])

    def run(batches):
        for batch in batches:
            parse, size = Parse(span, hashes), 0
            for cls, hits, text, refs in zip(batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()), batch.column(3), strict=True):
                refs = refs.as_py()
                parse.add(cls.as_py(), hits.as_py(), text.as_py(), refs)
                size += len(text.as_buffer()) + sum(len(r["block"]) for r in refs)
                if size > STEP:
                    yield result(parse)
                    parse, size = Parse(span, hashes), 0
            yield result(parse)

    return routed.select("cls", "hits", "_text", "refs").mapInArrow(run, schema)


def repeated_windows(docs: DataFrame, rows: DataFrame, classes: DataFrame, span: int, text_col: str, key: str) -> tuple[DataFrame, DataFrame]:
    """((cls, hits: list of (at, mask)) of classes with repeated windows found by their anchors, (cls, _text) of the
    classes that hold a repeated anchor)."""
    # a class's anchors are taken from its representative's row: joined by class and id, which is no hot key
    rep = F.coalesce("doc_id", F.lit(0)).alias("rep")
    own = rows.where(F.size("anchor") > 0).select("cls", rep, F.arrays_zip("anchor", "pos", "first", "last").alias("z"))
    reps = classes.select("cls", F.coalesce("rep", F.lit(0)).alias("rep"))
    each = materialize(own.join(reps, ["cls", "rep"]).select("cls", F.explode("z").alias("z")).select("cls", "z.*"), "each")
    total = each.count()
    place = F.struct("cls", "pos")
    found = each.groupBy("anchor").agg(F.min(place).alias("ref"), F.max(place).alias("end"), F.count("*").alias("n")).where("ref != end")
    found = materialize(found.select("anchor", F.col("ref.cls").alias("ref_cls"), F.col("ref.pos").alias("ref_pos"), "n"), "references")
    is_ref = (F.col("cls") == F.col("ref_cls")) & (F.col("pos") == F.col("ref_pos"))
    hits = join_counted(each, found, ["anchor"], total).select("cls", "first", "last", "ref_cls", F.floor(F.col("ref_pos") / BLOCK).cast("int").alias("ref_block"), is_ref.alias("is_ref"))
    hits = materialize(hits, "hits")

    # the hits of one document are bounded by its length; sets, as repeated rows give the same hits
    mine = hits.groupBy("cls").agg(F.collect_set(F.when(~F.col("is_ref"), F.struct("first", "last", "ref_cls", "ref_block"))).alias("hits"), F.collect_set(F.when(F.col("is_ref"), F.col("ref_block"))).alias("blocks"))
    texts = docs.select(F.coalesce(F.col(f"`{key}`"), F.lit(0)).alias("rep"), text_key(F.col(f"`{text_col}`")).alias("cls"), F.col(f"`{text_col}`").alias("_text"))
    touched = materialize(texts.join(mine.join(reps, "cls"), ["cls", "rep"]).drop("rep"), "touched")

    asked = materialize(hits.where("NOT is_ref").select("cls", "ref_cls", "ref_block").distinct(), "routes")
    counts = asked.groupBy("ref_cls", "ref_block").agg(F.count("*").alias("n"))
    blocks = materialize(_blocks(touched, span).dropDuplicates(["ref_cls", "ref_block"]).join(counts, ["ref_cls", "ref_block"]), "blocks")
    given = join_counted(asked, blocks, ["ref_cls", "ref_block"], asked.count(), row_bytes=F.length("block") + 64)
    refs = given.groupBy("cls").agg(F.collect_list(F.struct("ref_cls", "ref_block", "start", "block")).alias("refs"))
    factors = materialize(_factors(touched.where(F.size("hits") > 0).join(refs, "cls"), span), "factors")

    left = factors.where("digest IS NOT NULL").select("digest", "cls", "at")
    place = F.struct("cls", "at")
    twice = left.groupBy("digest").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("n")).where("a != b").select("digest", "n")
    checked = join_counted(left, materialize(twice, "checked"), ["digest"], left.count())
    masks = factors.where("digest IS NULL").select("cls", "at", "mask").unionByName(checked.select("cls", F.shiftright("at", 6).alias("at"), F.expr("shiftleft(1L, at & 63)").alias("mask")))
    masks = masks.groupBy("cls", "at").agg(F.bit_or("mask").alias("mask")).groupBy("cls").agg(F.collect_list(F.struct("at", "mask")).alias("hits"))
    return masks, touched.select("cls", "_text")


def covered(n: int, hits: list[dict], span: int) -> np.ndarray:
    """Which of ``n`` words lie in a repeated window."""
    edge = np.zeros(n + 1, np.int32)
    for hit in hits:
        base, mask = hit["at"] * 64, hit["mask"] & (1 << 64) - 1
        while mask:
            low = mask & -mask
            start = base + low.bit_length() - 1
            edge[start] += 1
            edge[start + span] -= 1
            mask ^= low
    return np.cumsum(edge[:-1]) > 0


def _cut(masks: DataFrame, texts: DataFrame, span: int) -> DataFrame:
    """(cls, n_removed, kept_sha256, kept_text, spans) of every class with a repeated window. Kept words are joined by
    one space; spans are (first word, end) of what was removed."""
    schema = "cls binary, n_removed long, kept_sha256 string, kept_text string, spans array<struct<start:int,stop:int>>"

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for cls, hits, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                words = text.split()
                gone = covered(len(words), hits, span)
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                flips = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                spans = [{"start": int(a), "stop": int(b)} for a, b in zip(flips[::2], flips[1::2], strict=True)]
                for column, v in zip(out, (cls, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace"), spans), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string()), pa.array(out[4], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))], names=["cls", "n_removed", "kept_sha256", "kept_text", "spans"])

    return masks.join(texts, "cls").dropDuplicates(["cls"]).select("cls", "hits", "_text").mapInArrow(run, schema)


def _spans(docs: DataFrame, span: int, text_col: str, key: str) -> tuple[DataFrame, DataFrame, int]:
    """((doc_id, cls, n_words, all_sha256) of every row, (cls, copies, n_removed, kept_sha256, kept_text, spans) of the
    classes that have copies or repeated windows, number of rows)."""
    if span < GRAM:
        raise ValueError(f"span must be {GRAM} at least")
    rows = materialize(scan(docs, span, text_col, key), "anchors")
    classes = materialize(rows.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    masks, texts = repeated_windows(docs, rows, classes, span, text_col, key)
    cut = materialize(_cut(masks, texts, span), "cut")
    found = classes.select("cls", "copies").join(cut, "cls", "left").where("copies > 1 OR n_removed IS NOT NULL")
    return rows.select("doc_id", "cls", "n_words", F.col("kept_sha256").alias("all_sha256")), materialize(found, "found"), rows.count()


def duplicate_spans(docs: DataFrame, span: int = SPAN, text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, cls, n_words, n_removed, kept_sha256, kept_text, spans) of every row. kept_text is null where nothing
    or everything was removed; spans are null where nothing was."""
    rows, found, total = _spans(docs, span, text_col, key)
    size = F.length(F.coalesce("kept_text", F.lit(""))) * 4 + F.coalesce(F.size("spans"), F.lit(0)) * 8 + 128
    found = join_counted(rows, found.withColumn("n", F.col("copies")), ["cls"], total, how="left", row_bytes=size)
    whole = (F.col("copies") > 1) & (F.col("n_words") >= span)
    everything = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("stop")))
    return found.select(
        "doc_id",
        "cls",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "all_sha256")).alias("kept_sha256"),
        F.when(~F.coalesce(whole, F.lit(False)), F.col("kept_text")).alias("kept_text"),
        F.when(whole, everything).otherwise(F.col("spans")).alias("spans"),
    )


def remove_repeats(docs: DataFrame, span: int = SPAN, text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with repeated spans taken out of the text; texts without any stay byte for byte."""
    rows, found, total = _spans(docs, span, text_col, key)
    lengths = rows.groupBy("cls").agg(F.first("n_words").alias("n_words"))
    whole = (F.col("copies") > 1) & (F.col("n_words") >= span)
    found = found.join(lengths, "cls").where(whole | (F.col("n_removed") > 0)).select("cls", F.when(whole, F.lit("")).otherwise(F.coalesce("kept_text", F.lit(""))).alias("_kept"), F.col("copies").alias("n"))
    found = materialize(found, "repeats")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), text_key(F.col(f"`{text_col}`")).alias("cls"))
    own = lambda c: F.col("_row").getField(c)
    joined = join_counted(row, found, ["cls"], total, how="left", row_bytes=F.length("_kept") * 4 + 64)
    return joined.select(*[(F.coalesce("_kept", own(c)) if c == text_col else own(c)).alias(c) for c in docs.columns])


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_spans(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
