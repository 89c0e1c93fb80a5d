"""The registered queries themselves, on the odd corpus: the contract's columns against plain computations, and their SQL."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from idloom.llm import quality, registry
from idloom.llm.common import join_counted
from tests.llm.common import ODD, SCHEMA, corpus, words
from tests.llm.test_archives import PAGES, expected
from tests.llm.test_dedup import brute, removed
from tests.llm.test_models import crc_mod, statistics
from tests.llm.test_tokens import P, check_packed, greedy

Q = registry.queries()


def rows():
    """The odd corpus, with whole texts in two languages, junk, and toxic words for the models."""
    rng = random.Random(8)
    pools = {"en": words(rng, 300), "fr": ["".join(rng.choice("uvwxyzéà") for _ in range(rng.randint(2, 7))) for _ in range(300)]}
    out = [(i, t, "en") for i, t in corpus()]
    for i in range(1000, 1240):
        lang = ["en", "fr"][i % 2]
        text = words(rng, rng.randint(60, 120), pools[lang])
        if i % 10 == 0:
            text = [w + "***" for w in text]
        if i % 6 == 1:
            text[5:5] = ["grumbot", "grumb0t"]
        out.append((i, " ".join(text), lang))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('queries')}"
    spark.createDataFrame([(i, t, lang, None, None) for i, t, lang in rows()], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 0 if i % 10 == 0 else 1, int(i % 6 == 1)) for i in range(1000, 1240) if i % 7]
    spark.createDataFrame([*labels, (None, 1, 0), (1001, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3).write.parquet(f"{path}/pages.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('empty')}"
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("pages", "page_id long, url string, html string"), ("embeddings", "vec_id long, embedding array<float>, label int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{path}/{name}.parquet")
    return path


def collected(spark, folder, name, *columns):
    return sorted((tuple(r[c] for c in columns) for r in Q[name](spark, folder).collect()), key=str)


def tokenizer(name):
    t = Tokenizer.from_file(P.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def test_op1(spark, folder):
    t, want = tokenizer("word_bpe_49k.json"), []
    for i, text, _ in rows():
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert collected(spark, folder, "op1_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)


def test_op2(spark, folder):
    want = []
    for i, text, _ in rows():
        data = (text or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        want.append((i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    assert collected(spark, folder, "op2_media", "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == sorted(want, key=str)
    out = Q["op2_media"](spark, folder).collect()
    by_text: dict = {}
    for r in out:
        by_text.setdefault(r["payload_sha256"], set()).add((r["media_bytes"], r["media_sha256"], r["feature"]))
        assert r["media_bytes"] > 0 and len(r["media_sha256"]) == 64 and r["feature"]
    assert all(len(v) == 1 for v in by_text.values())


def test_op3(spark, folder):
    got = Q["op3_minhash"](spark, folder).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == sorted(brute([(i, t) for i, t, _ in rows()], 4), key=str)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_op4(spark, folder):
    got = Q["op4_quality_forest"](spark, folder).collect()
    assert sorted(((r["doc_id"], *(r[c] for c in quality.STATS), r["base_failed"]) for r in got), key=str) == sorted(((i, *statistics(t)) for i, t, _ in rows()), key=str)
    assert not any(r["base_failed"] and r["kept"] for r in got)
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert np.mean([kept[i] for i in range(1000, 1240) if i % 10]) > 0.97 and not any(kept[i] for i in range(1000, 1240, 10))


def test_op5(spark, folder):
    assert collected(spark, folder, "op5_warc", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == expected(PAGES)


def test_op6(spark, folder):
    assert collected(spark, folder, "op6_substring", "doc_id", "n_words", "n_removed", "kept_sha256") == removed([(i, t) for i, t, _ in rows()])


def test_op7(spark, folder):
    check_packed(Q["op7_packing"](spark, folder).collect(), [(i, t) for i, t, _ in rows()])


def test_op8(spark, folder):
    got = Q["op8_language"](spark, folder).collect()
    assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "fr", "und") for r in got)
    assert all(r["held_out"] == (r["doc_id"] is None or crc_mod(r["doc_id"], 3) == 1) for r in got)
    pred = {r["doc_id"]: r["lang_pred"] for r in got}
    assert all(pred[i] == "und" for i, t in enumerate(ODD) if not any(c.isalpha() for c in t or ""))
    held = [(i, lang) for i, _, lang in rows() if i is not None and i >= 1000 and crc_mod(i, 3) == 1]
    assert np.mean([pred[i] == lang for i, lang in held]) > 0.97


def test_op9(spark, folder):
    got = Q["op9_toxicity"](spark, folder).collect()
    assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is None or crc_mod(r["doc_id"], 5) == 0) for r in got)
    pred = {r["doc_id"]: r["predicted"] for r in got}
    held = [i for i in range(1000, 1240) if crc_mod(i, 5) == 0]
    assert np.mean([pred[i] == int(i % 6 == 1) for i in held]) > 0.95


def test_op10(spark, folder):
    from idloom.llm import bpe, wordpiece

    counter = wordpiece.load(bpe.default_vocabulary())
    pieces, want = set(counter.bpe.token), {}
    for i, text, _ in rows():
        if text is None or len(text) < 5000:
            ws = counter.bpe.words(text or "")
            want.setdefault(i, set()).add((len(ws), sum(1 if w in counter.bpe.special else greedy(pieces, counter.bpe.symbols(w)) for w in ws)))
    got = Q["op10_token_counts"](spark, folder).collect()
    assert len(got) == len(rows())
    assert all((r["n_words"], r["n_tokens"]) in want[r["doc_id"]] for r in got if r["doc_id"] in want and r["n_words"] < 20_000)


@pytest.mark.parametrize("name", sorted(Q))
def test_empty_tables(spark, empty, name):
    assert Q[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql_says_the_same(spark, name):
    """On the given tables, where ids are unique and not null."""
    data, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    cursor = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert collected(spark, data, name, *names) == sorted(cursor.fetchall(), key=str)


def test_joins_of_hot_keys(spark):
    many = spark.createDataFrame([(k, i) for i in range(400) for k in ([None, 1] if i % 2 else [2, 1])], "k long, i long")
    one = spark.createDataFrame([(1, 400, "a" * 9), (2, 200, "b")], "k long, n long, v string")
    want = sorted([(k, i, {1: "a" * 9, 2: "b"}.get(k)) for i in range(400) for k in ([None, 1] if i % 2 else [2, 1])], key=str)
    for bytes_ in (None, 1 << 30):
        size = None if bytes_ is None else F.lit(bytes_)
        got = join_counted(many, one, ["k"], 800, how="left", row_bytes=size)
        assert sorted((tuple(r) for r in got.select("k", "i", "v").collect()), key=str) == want
        assert join_counted(many, one, ["k"], 800, row_bytes=size).count() == 600
    assert join_counted(many, one, ["k"], 10**9, how="left").count() == 800
