"""Packing (operator 7): minimum bin slack by bitset subset sums over the remaining lengths.

Documents are tokenized in one narrow pass (ids of the byte-level BPE file, then one end id) and cut: whole windows
first, then the remainder. Whole windows are sequences of their own. Remainders are packed in blocks of about
BLOCK_PIECES pieces, spread evenly over tasks: the longest remaining length opens a window, and a bitset dynamic
programme over the multiset of remaining lengths finds the subset that fills it closest to capacity; the counts of
the solution are read back through the programme's states, and the same multiset fills further windows while its
counts last. Only the last windows of a block can keep slack.

A sequence is padded to the window, except where its fill is a power of two.

Defined cases: a null or empty text is one piece that holds the end id only; repeated rows are pieces of their own;
null ids are returned as they came; very long texts give many whole windows; ties (pieces of one length) are filled
in the order of their block's rows, and any order gives the same padding; input columns other than text and id aren't
looked at, so their names can't clash; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.llm.common import binary, materialize, steps, table

WINDOW, END_ID = 1024, 0
#: Pieces that are packed together: enough that nearly every window is filled, and small in memory.
BLOCK_PIECES = 100_000
#: Texts with longer runs of white space go to the slower library, as the fast one's pattern could overflow on them.
LONG_BLANK = re.compile(rb"[\s\x85\xa0]{4000}")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteBpe:
    """Ids of the vocabulary file. tiktoken, over the same vocabulary as ranks, gives the same ids many times faster."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.slow = Tokenizer.from_file(path)
        self.slow.no_truncation()
        self.slow.no_padding()
        special = {t.content: i for i, t in self.slow.get_added_tokens_decoder().items()}
        self.fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: bytes | None) -> list[int]:
        text = text or b""
        if LONG_BLANK.search(text):
            return self.slow.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
        return self.fast.encode(text.decode("utf-8", "replace"), allowed_special="all")


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def pieces(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, end_id: int = END_ID, text_col: str = "text", key: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of every piece, and its ids if asked for."""
    path = vocabulary or default_vocabulary()
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text_col}`").alias("_text"))
    id_type = dict(rows.dtypes)["doc_id"]
    extra = ", ids array<int>" if keep_ids else ""

    def run(batches):
        for batch in batches:
            for part in steps(batch, 1):
                at, out, ids_out = [], [[], [], [], []], []
                for i, text in enumerate(binary(part.column(1))):
                    ids = np.array([*load(path).encode(text), end_id], "<u4")
                    for start in range(0, len(ids), window):
                        piece = ids[start : start + window]
                        at.append(i)
                        for column, v in zip(out, (start, len(piece), zlib.crc32(piece.tobytes()), len(ids)), strict=True):
                            column.append(v)
                        if keep_ids:
                            ids_out.append(piece.astype(np.int32))
                arrays = [part.column(0).take(pa.array(at, pa.int32())), *(pa.array(c, pa.int64()) for c in out)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if keep_ids:
                    arrays.append(pa.array(ids_out, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=names + ["ids"] * keep_ids)

    return rows.mapInArrow(run, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long{extra}")


def closest_fill(counts: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """The multiset [(length, count)] of lengths, within ``counts``, whose sum is the largest up to ``capacity``.

    Bit s of a state says that sum s can be made. Lengths are taken longest first, their counts in doubling lots; each
    lot's state is kept, so that the counts can be read back from the last state.
    """
    full, goal = (1 << (capacity + 1)) - 1, 1 << capacity
    state, states = 1, []
    for length in np.flatnonzero(counts[: capacity + 1])[::-1].tolist():
        left, lot = min(int(counts[length]), capacity // length), 1
        while left:
            lot = min(lot, left)
            states.append((state, length, lot))
            state |= (state << (length * lot)) & full
            left, lot = left - lot, lot * 2
        if state & goal:
            break
    total, used = state.bit_length() - 1, {}
    for before, length, lot in reversed(states):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + lot
            total -= length * lot
    return list(used.items())


def fills(counts: np.ndarray, window: int = WINDOW) -> list[tuple[list[tuple[int, int]], int]]:
    """[(multiset of lengths, number of windows filled with it)] that uses up ``counts`` (index: length)."""
    counts, out = counts.copy(), []
    longest = len(counts) - 1
    while True:
        while longest > 0 and not counts[longest]:
            longest -= 1
        if longest <= 0:
            return out
        counts[longest] -= 1
        found = dict(closest_fill(counts, window - longest))
        counts[longest] += 1
        found[longest] = found.get(longest, 0) + 1
        times = min(int(counts[n]) // k for n, k in found.items())
        for n, k in found.items():
            counts[n] -= k * times
        out.append((sorted(found.items(), reverse=True), times))


def place(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(sequence number, offset) of each piece of one block."""
    whole = lengths >= window
    sequence, offset = np.empty(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    sequence[whole] = np.arange(int(whole.sum()))
    at = int(whole.sum())
    rest = np.flatnonzero(~whole)
    rest = rest[np.argsort(lengths[rest], kind="stable")]
    counts = np.bincount(lengths[rest], minlength=window)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])  # next unused piece of each length, in `rest`
    for multiset, times in fills(counts, window):
        base = 0
        for length, k in multiset:
            chosen = rest[first[length] : first[length] + k * times]
            first[length] += k * times
            sequence[chosen] = at + np.repeat(np.arange(times), k)
            offset[chosen] = base + length * np.tile(np.arange(k), times)
            base += length * k
        at += times
    return sequence, offset


def pack(cut: DataFrame, window: int = WINDOW, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """``cut`` (pieces with a ``length``) with sequence_id and offset. Blocks are dealt out evenly, whatever the keys;
    sequence_id is the block's number times 2**32 plus the sequence's number in it."""
    cut = materialize(cut, "pieces")
    blocks = -(-cut.count() // block_pieces) or 1
    names = cut.columns
    at = names.index("length")

    def run(batches):
        from pyspark import TaskContext

        got = [b for b in batches if b.num_rows]
        if got:
            rows = pa.Table.from_batches(got).combine_chunks()
            sequence, offset = place(rows.column(at).to_numpy(), window)
            sequence += TaskContext.get().partitionId() << 32
            rows = rows.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
            yield from rows.to_batches(max_chunksize=20_000)

    schema = cut.schema.add("sequence_id", "long").add("offset", "long")
    return materialize(cut.repartition(blocks).mapInArrow(run, schema), "packed")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents")))
