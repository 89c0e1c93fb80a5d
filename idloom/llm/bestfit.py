"""Best-fit packing (operator 11): bounded-space online best fit over a stream of document pieces.

Documents are tokenized in one narrow pass (ids of the byte-level BPE file, then one end id). Only documents longer than
a window are cut: into whole windows, of which the first may be shorter. Whole windows are sequences of their own. The
other pieces reach each packer as a stream, one at a time:

1. a piece goes into the open bin with the least free space that is enough;
2. where no open bin has room, a new one is opened, and if OPEN_BINS are open already, the fullest closes first;
3. a bin without free space closes at once.

Open bins lie in stacks keyed by their free space, and bit f of one integer says that stack f isn't empty: the best fit of
a piece is the lowest bit at or above its length, the fullest bin the lowest bit of all. So a step takes the time of one
shift of the bitset, however many bins are open, and a packer's memory is bounded by OPEN_BINS.

Pieces are dealt evenly to packers of about STREAM_PIECES, whatever their keys. A packer's stream comes in lots of about
LOT pieces, mixed by a hash, and within a lot longest first: long pieces open bins that the shorter ones behind them fill,
and as a lot opens no more bins than it has pieces, few close early. On the given documents 0.02 % more bins are used than
their tokens need; a stream in mixed order uses 1 % more.

Defined cases: a null or empty text is one piece that holds the end id only; repeated rows are pieces of their own; null
ids are returned as they came; a very long text gives many whole windows; ties (bins of equal free space) go to the bin
that got it last; input columns other than text and id aren't looked at, so their names can't clash; an empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.llm.common import binary, materialize, steps, table
from idloom.llm.packing import default_vocabulary, load

WINDOW, END_ID = 2048, 0
#: Bins that a packer holds open at most.
OPEN_BINS = 4096
#: Pieces of one packer's stream: many times OPEN_BINS, so that what stays open at its end is a small share.
STREAM_PIECES = 250_000
#: Pieces of a lot, which arrive longest first.
LOT = OPEN_BINS


def cuts(n: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: whole windows, before them what is left over."""
    first = n % window
    return ([(0, first)] if first else []) + [(start, window) for start in range(first, n, window)]


def pieces(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, end_id: int = END_ID, text_col: str = "text", key: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece, and its ids if asked for."""
    path = vocabulary or default_vocabulary()
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text_col}`").alias("_text"))
    id_type = dict(rows.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            for part in steps(batch, 1):
                at, numbers, kept = [], [], []
                for i, text in enumerate(binary(part.column(1))):
                    ids = np.array([*load(path).encode(text), end_id], "<u4")
                    for k, (start, length) in enumerate(cuts(len(ids), window)):
                        piece = ids[start : start + length]
                        at.append(i)
                        numbers.append((k, start, length, zlib.crc32(piece.tobytes())))
                        if keep_ids:
                            kept.append(piece.astype(np.int32))
                columns = list(zip(*numbers, strict=True)) if numbers else [()] * 4
                arrays = [part.column(0).take(pa.array(at, pa.int32())), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    arrays.append(pa.array(kept, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=names + ["ids"] * keep_ids)

    extra = ", ids array<int>" if keep_ids else ""
    return rows.mapInArrow(run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long{extra}")


class BestFit:
    """Bins of ``window`` tokens, at most ``open_bins`` of them open."""

    def __init__(self, window: int = WINDOW, open_bins: int = OPEN_BINS):
        self.window, self.most = window, open_bins
        self.stacks: list[list[int]] = [[] for _ in range(window + 1)]
        self.free = 0  # bit f: an open bin has f tokens free
        self.open = self.bins = 0

    def _take(self, f: int) -> int:
        stack = self.stacks[f]
        bin_ = stack.pop()
        if not stack:
            self.free ^= 1 << f
        self.open -= 1
        return bin_

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset in it) of the next piece of the stream."""
        fitting = self.free >> length
        if fitting:
            f = length + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(f)
        else:
            if self.open >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            f, bin_ = self.window, self.bins
            self.bins += 1
        left = f - length
        if left:
            self.stacks[left].append(bin_)
            self.free |= 1 << left
            self.open += 1
        return bin_, self.window - f

    def place(self, lengths: Iterable[int]) -> tuple[np.ndarray, np.ndarray]:
        placed = np.array([self.put(n) for n in lengths], np.int64).reshape(-1, 2)
        return placed[:, 0], placed[:, 1]


def pack(cut: DataFrame, window: int = WINDOW, open_bins: int = OPEN_BINS, stream_pieces: int = STREAM_PIECES, lot: int = LOT) -> DataFrame:
    """``cut`` (pieces with a ``length``) with sequence_id (the packer's number times 2**32 plus the bin's) and offset."""
    cut = materialize(cut, "pieces")
    n = cut.count()
    packers = -(-n // stream_pieces) or 1
    at = cut.columns.index("length")
    own_lot = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(-(-n // (packers * lot)) or 1))

    def run(batches):
        from pyspark import TaskContext

        packer, first = BestFit(window, open_bins), TaskContext.get().partitionId() << 32
        for batch in batches:
            bins, offsets = packer.place(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bins + first), pa.array(offsets)], names=[*batch.schema.names, "sequence_id", "offset"])

    schema = cut.schema.add("sequence_id", "long").add("offset", "long")
    return materialize(cut.repartition(packers).sortWithinPartitions(own_lot, F.desc("length"), "doc_id", "start", "ids_crc32").mapInArrow(run, schema), "packed")


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents")))
