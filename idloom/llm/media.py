"""Media columns (operator 2): content-addressed payloads in tar shards, addressed by digest, offset and length.

A payload (a text's UTF-8 bytes, filled up with bytes 255 to a positive multiple of SAMPLES) becomes a gray image with
8-bit samples and SAMPLES samples a row, stored losslessly as PNG. Each task appends its media to a tar shard in the
shared folder; a member's name is the payload's SHA-256, so the shard is a plain tar file that any tool reads. Rows
carry digest, shard, offset and length. Readers take the first HEADER bytes of a member to fill the metadata columns,
and the member's range to get the payload back.

Only one row of each payload is written: payloads found more than once are counted natively and the rows with the
least id own them. The list of shared payloads is broadcast if its counted size is small, else joined by a shuffle.
Where repeated rows own one payload, or an executor was lost half-way, the least address is the one that rows carry.

Defined cases: a null text is stored like an empty one, as SAMPLES bytes 255; equal texts have one address and equal
values; null ids are kept (and own a payload only where no row with an id has it); texts are stored whole, whatever
their length; an empty table gives an empty result; other columns aren't read or returned.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.llm.common import binary, bounded_broadcast, join_counted, materialize, new_path, steps, table

SAMPLES, FILL, TAIL = 576, b"\xff", 32
#: A shard is closed after so many bytes.
SHARD_BYTES = 64 << 20
HEADER = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


# ---------------------------------------------------------------- the stored form


def padded(data: bytes) -> bytes:
    return data + FILL * (-len(data) % SAMPLES if data else SAMPLES)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, SAMPLES)
    lines = np.zeros((len(rows), SAMPLES + 1), np.uint8)  # filter type 0 before each row
    lines[:, 1:] = rows
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", SAMPLES, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> dict[str, int]:
    """Metadata from the first HEADER bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not a PNG header")
    width, height, bits, colour = struct.unpack(">IIBB", head[16:26])
    return {"width": width, "height": height, "bits": bits, "channels": 1 if colour == 0 else 3}


def decode_png(media: bytes) -> bytes:
    meta, at, data = read_header(media[:HEADER]), HEADER, []
    while at < len(media):
        (size,) = struct.unpack(">I", media[at : at + 4])
        if media[at + 4 : at + 8] == b"IDAT":
            data.append(media[at + 8 : at + 8 + size])
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(meta["height"], meta["width"] + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered rows are written here")
    return lines[:, 1:].tobytes()


def features(payload: bytes, meta: dict[str, int]) -> str:
    """Size, mean, deviation, entropy and mean step between neighbouring samples, and a 64-bit average-hash of an 8 x 8
    thumbnail."""
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    step = np.abs(np.diff(x.astype(np.int16))).mean()
    levels = np.arange(256)
    mean = float(share @ levels)
    deviation = float(np.sqrt(max(share @ (levels - mean) ** 2, 0)))
    cells = np.add.reduceat(x.astype(np.int64), np.arange(64) * len(x) // 64) / np.diff(np.append(np.arange(64) * len(x) // 64, len(x)))
    bits = sum(1 << i for i, v in enumerate(cells > cells.mean()) if v)
    return f"{meta['width']}x{meta['height']}x{meta['channels']}@{meta['bits']};mean={mean:.4f};std={deviation:.4f};entropy={entropy:.4f};step={step:.4f};ahash={bits:016x}"


# ---------------------------------------------------------------- shards


def payload_digest(text: Column) -> Column:
    """SHA-256 (binary) of the padded payload, natively."""
    data = F.coalesce(text.cast("string"), F.lit("")).cast("binary")
    n = F.octet_length(data)
    fill = F.when(n == 0, F.lit(SAMPLES)).otherwise(F.pmod(-n, F.lit(SAMPLES)))
    tail = F.substring(F.lit(FILL * SAMPLES), F.lit(1), fill)
    return F.unhex(F.sha2(F.concat(data, tail), 256))


class ShardWriter:
    """Appends members to tar files in a folder of any file system that pyarrow opens."""

    def __init__(self, folder: str, name: str):
        self.fs, self.path = fs.FileSystem.from_uri(folder)
        self.name, self.part, self.out, self.at = name, 0, None, 0

    def add(self, name: str, data: bytes) -> tuple[str, int]:
        """(shard, offset of the member's data)."""
        if self.out is None:
            self.file = f"{self.name}-{self.part:04d}.tar"
            self.out, self.at = self.fs.open_output_stream(f"{self.path}/{self.file}"), 0
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        fill = b"\0" * (-len(data) % 512)
        self.out.write(head + data + fill)
        offset = self.at + len(head)
        self.at += len(head) + len(data) + len(fill)
        where = self.file, offset
        if self.at >= SHARD_BYTES:
            self.close()
        return where

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.out, self.part = None, self.part + 1


def store(docs: DataFrame, folder: str, text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """Write every distinct payload of ``docs`` to shards in ``folder``: (digest, n_bytes, shard, offset, length), one row
    for each payload."""
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{key}`").alias("_key"), text.alias("_text"), payload_digest(text).alias("digest"))
    shared = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("_key").alias("owner")).where("n > 1").select("digest", "owner")
    shared = bounded_broadcast(materialize(shared, "shared-payloads"), 72)
    mine = rows.join(shared, "digest", "left").where(F.col("owner").isNull() | (F.col("_key") == F.col("owner")))

    def run(batches):
        # a name of its own for each attempt: a repeated task never writes into a shard that rows point to
        writer, seen = ShardWriter(folder, uuid.uuid4().hex), set()
        for batch in batches:
            for part in steps(batch, 1):
                out: list[list] = [[], [], [], [], []]
                for text, digest in zip(binary(part.column(1)), part.column(0).to_pylist(), strict=True):
                    if digest in seen:
                        continue
                    seen.add(digest)
                    payload = padded(text or b"")
                    if hashlib.sha256(payload).digest() != digest:
                        raise ValueError("a payload doesn't have its digest")
                    media = encode_png(payload)
                    for column, v in zip(out, (digest, len(text or b""), *writer.add(f"{digest.hex()}.png", media), len(media)), strict=True):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64())], names=["digest", "n_bytes", "shard", "offset", "length"])
        writer.close()

    written = mine.select("digest", "_text").mapInArrow(run, "digest binary, n_bytes long, shard string, offset long, length long")
    written = materialize(written, "addresses")
    least = written.groupBy("digest").agg(F.min(F.struct("shard", "offset", "n_bytes", "length")).alias("a"))
    return least.select("digest", "a.n_bytes", "a.shard", "a.offset", "a.length")


def _read(addresses: DataFrame, folder: str, schema: str, fn) -> DataFrame:
    """Rows of ``fn(open file, offset, length)`` for each address. Addresses are dealt out in ranges of shard and offset,
    so every task reads runs of neighbours, one shard after the other."""

    def run(batches):
        files, path = fs.FileSystem.from_uri(folder)
        current, opened = None, None
        for batch in batches:
            shard_at, offset_at, length_at, digest_at = (batch.schema.get_field_index(c) for c in ("shard", "offset", "length", "digest"))
            shards, offsets, lengths = (batch.column(i).to_pylist() for i in (shard_at, offset_at, length_at))
            rows = []
            for shard, offset, length in zip(shards, offsets, lengths, strict=True):
                if shard != current:
                    if opened is not None:
                        opened.close()
                    current, opened = shard, files.open_input_file(f"{path}/{shard}")
                rows.append(fn(opened, offset, length))
            arrow = _schema(schema)
            yield pa.RecordBatch.from_arrays([batch.column(digest_at), *(pa.array([r[i] for r in rows], arrow.field(i + 1).type) for i in range(len(arrow) - 1))], names=arrow.names)
        if opened is not None:
            opened.close()

    parts = int(addresses.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = addresses.select("digest", "shard", "offset", "length").repartitionByRange(parts, "shard", "offset").sortWithinPartitions("shard", "offset")
    return ordered.mapInArrow(run, schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def metadata(addresses: DataFrame, folder: str) -> DataFrame:
    """(digest, width, height, bits, channels) from range reads of HEADER bytes each."""

    def one(f, offset: int, length: int) -> tuple:
        meta = read_header(f.read_at(HEADER, offset))
        return tuple(meta[c] for c in ("width", "height", "bits", "channels"))

    return _read(addresses, folder, "digest binary, width long, height long, bits int, channels int", one)


def payload_features(addresses: DataFrame, folder: str) -> DataFrame:
    """(digest, payload_bytes, payload_sha256, tail_crc32, media_sha256, feature) of payloads read back from shards."""

    def one(f, offset: int, length: int) -> tuple:
        media = f.read_at(length, offset)
        payload = decode_png(media)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), hashlib.sha256(media).hexdigest(), features(payload, read_header(media[:HEADER]))

    return _read(addresses, folder, "digest binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, feature string", one)


def read_payloads(addresses: DataFrame, folder: str) -> DataFrame:
    """(digest, payload) read back from shards."""
    return _read(addresses, folder, "digest binary, payload binary", lambda f, offset, length: (decode_png(f.read_at(length, offset)),))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = new_path(spark, "shards")
    files, path = fs.FileSystem.from_uri(folder)
    files.create_dir(path)
    addresses = materialize(store(docs, folder), "canonical")
    heads = metadata(addresses, folder)
    facts = materialize(payload_features(addresses, folder), "media-facts")
    rows = materialize(docs.select("doc_id", payload_digest(F.col("text")).alias("digest")), "digests")
    counts = rows.groupBy("digest").agg(F.count("*").alias("n"))
    known = materialize(addresses.join(heads, "digest").join(facts, "digest").join(counts, "digest"), "media")
    found = join_counted(rows, known, ["digest"], rows.count(), row_bytes=F.lit(400))  # a digest that many rows share is joined apart
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.col("length").alias("media_bytes"), "media_sha256", "feature", "shard", "offset", "width", "height")
