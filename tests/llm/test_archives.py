import base64
import hashlib
import io
import re
import tarfile
import zlib

import pytest

from idloom.llm import media, warc
from idloom.llm.common import new_path
from tests.llm.common import corpus, frame, with_clashes


def folder(spark):
    path = new_path(spark, "test-shards")
    files, at = media.fs.FileSystem.from_uri(path)
    files.create_dir(at)
    return path, at


def test_png_is_lossless_and_standard():
    for data in (b"", b"a", b"x" * 576, bytes(range(256)) * 9):
        payload = media.padded(data)
        assert len(payload) % 576 == 0 and payload[: len(data)] == data and set(payload[len(data) :]) <= {255}
        png = media.encode_png(payload)
        assert media.decode_png(png) == payload
        head = media.read_header(png[: media.HEADER])
        assert head == {"width": 576, "height": len(payload) // 576, "bits": 8, "channels": 1}
        at = 8
        while at < len(png):  # every chunk's checksum
            size = int.from_bytes(png[at : at + 4], "big")
            assert zlib.crc32(png[at + 4 : at + 8 + size]) == int.from_bytes(png[at + 8 + size : at + 12 + size], "big")
            at += size + 12
    with pytest.raises(ValueError):
        media.read_header(b"\0" * 33)


def test_payloads_come_back_and_are_stored_once(spark):
    path, at = folder(spark)
    docs = with_clashes(frame(spark))
    addresses = media.store(docs, path).cache()
    texts = {media.padded((t or "").encode()) for _, t in corpus()}
    assert addresses.count() == len(texts)
    assert {bytes(r["payload"]) for r in media.read_payloads(addresses, path).collect()} == texts
    facts = {r["payload_sha256"]: r for r in media.payload_features(addresses, path).collect()}
    heads = {bytes(r["digest"]): r for r in media.metadata(addresses, path).collect()}
    for payload in texts:
        r = facts[hashlib.sha256(payload).hexdigest()]
        assert (r["payload_bytes"], r["tail_crc32"]) == (len(payload), zlib.crc32(payload[-32:]))
        assert heads[hashlib.sha256(payload).digest()]["height"] * 576 == len(payload)
    # plain tar files, in which every address holds its member
    files, _ = media.fs.FileSystem.from_uri(path)
    members = {}
    for info in files.get_file_info(media.fs.FileSelector(at)):
        with files.open_input_file(info.path) as f, tarfile.open(fileobj=io.BytesIO(f.read())) as tar:
            for m in tar:
                members[info.base_name, m.offset_data] = (m.name, m.size)
    for r in addresses.collect():
        assert members[r["shard"], r["offset"]] == (f"{bytes(r['digest']).hex()}.png", r["length"])
    addresses.unpersist()


def test_digest_is_that_of_the_payload(spark):
    from pyspark.sql import functions as F

    rows = frame(spark).select("text", media.payload_digest(F.col("text")).alias("d")).collect()
    assert all(bytes(r["d"]) == hashlib.sha256(media.padded((r["text"] or "").encode())).digest() for r in rows)


def test_shards_are_closed_when_full(tmp_path):
    old, media.SHARD_BYTES = media.SHARD_BYTES, 4096
    try:
        writer = media.ShardWriter(f"file://{tmp_path}", "s")
        where = [writer.add(f"{i}.png", bytes([i]) * 1500) for i in range(7)]
        writer.close()
    finally:
        media.SHARD_BYTES = old
    assert len({s for s, _ in where}) > 2
    for i, (shard, offset) in enumerate(where):
        assert (tmp_path / shard).read_bytes()[offset : offset + 1500] == bytes([i]) * 1500


def test_no_documents(spark):
    path, _ = folder(spark)
    assert media.store(frame(spark, []), path).count() == 0


# ---------------------------------------------------------------- WARC

PAGES = [(1, "http://a", "<p>same</p>"), (2, "http://b", "<p>same</p>"), (7, None, "<p>same</p>"), (3, "http://c", None), (4, "http://d", ""), (5, "http://é", "<p>é</p>"), (6, "u", "x" * 200_000), (None, "http://n", "<p>same</p>"), (None, "http://m", "only here"), (9, "twice", "rep"), (9, "twice", "rep"), (8, "w", "rep"), (-5, "minus", "neg"), (-6, "minus", "neg")]


def archive(spark, rows, **options):
    path = new_path(spark, "test-warc")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    warc.write(with_clashes(pages) if rows else pages, path, **options)
    return path


def expected(rows, least=0):
    top = {}
    for i, _, h in rows:
        if i is not None:
            top[h or ""] = max(top.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        data, owner = (h or "").encode(), top.get(h or "")
        copies = sum((x or "") == (h or "") for _, _, x in rows)
        revisit = copies > 1 and owner is not None and i != owner and len(data) >= least
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", owner if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_records_are_read_back(spark, least):
    path = archive(spark, PAGES, least_bytes=least)
    rows = warc.facts(warc.records(spark, path)).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows), key=str) == expected(PAGES, least)
    assert all(r["agrees"] for r in rows)


def test_records_are_exact(spark):
    path = archive(spark, PAGES)
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == len({h or "" for _, _, h in PAGES})
    seen = set()
    for r in warc.records(spark, path).collect():
        record = bytes(r["record"])
        head, _, rest = record.partition(b"\r\n\r\n")
        length = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1\r\n") and rest[length:] == b"\r\n\r\n"
        block = rest[:length]
        assert block == (b"" if b"WARC-Type: revisit" in head else bytes(r["payload"]))
        target = re.search(rb"WARC-Target-URI: ([^\r]*)", head)
        seen.add(target[1].decode() if target else None)
    assert seen == {u for _, u, _ in PAGES}


def test_a_damaged_payload_is_noticed(spark):
    path = archive(spark, [(1, "u", "good"), (2, "v", "other")])
    rows = [(r["digest"], bytearray(b"evil") if bytes(r["payload"]) == b"good" else r["payload"]) for r in spark.read.parquet(f"{path}/payloads").collect()]
    rows = spark.createDataFrame(rows, "digest binary, payload binary")
    rows.write.mode("overwrite").parquet(f"{path}/payloads")
    assert {r["page_id"]: r["agrees"] for r in warc.facts(warc.records(spark, path)).collect()} == {1: False, 2: True}


def test_no_pages(spark):
    assert warc.facts(warc.records(spark, archive(spark, []))).count() == 0
