"""Operators 11 to 13 against brute force, on the odd corpus and on small tables of vectors."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from idloom.llm import bestfit, codes, registry, resample
from tests.llm.common import corpus, frame, with_clashes

P = pytest.importorskip("public_tokenizers")
Q = registry.queries()
VECTORS = "vec_id long, embedding array<float>, label int"


def tokenizer():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


# ---------------------------------------------------------------- best fit


def check_bins(rows, docs, window=2048):
    """Every id lies in one piece, bins have no gaps and no more than a window; returns (bins, least possible)."""
    t, want, total = tokenizer(), [], 0
    for i, text in docs:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        total += len(ids)
        start, k = 0, 0
        while start < len(ids):
            length = window if (len(ids) - start) % window == 0 else (len(ids) - start) % window
            want.append((str(i), k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            start, k = start + length, k + 1
    assert sorted(want) == sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    bins: dict = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    return len(bins), -(-total // window)


def slow_best_fit(lengths, window, most):
    """The same rule by looking at every open bin; of equal ones the last used."""
    open_, bins, out, clock = {}, 0, [], 0
    for n in lengths:
        clock += 1
        fitting = [(free, -used, b) for b, (free, used) in open_.items() if free >= n]
        if fitting:
            b = min(fitting)[2]
        else:
            if len(open_) >= most:
                open_.pop(min((free, -used, b) for b, (free, used) in open_.items())[2])
            b, open_[bins] = bins, (window, clock)
            bins += 1
        free = open_.pop(b)[0]
        out.append((b, window - free))
        if free > n:
            open_[b] = (free - n, clock)
    return out


@pytest.mark.parametrize("most", [1, 2, 5, 1000])
def test_bitset_equals_looking_at_every_bin(most):
    rng = random.Random(most)
    for _ in range(30):
        lengths = [rng.randint(1, rng.choice([20, 64])) for _ in range(rng.randint(0, 200))]
        packer = bestfit.BestFit(64, most)
        got = [packer.put(n) for n in lengths]
        assert got == slow_best_fit(lengths, 64, most)
        assert packer.open <= most and packer.open == sum(map(len, packer.stacks))


def test_cuts():
    assert bestfit.cuts(1) == [(0, 1)] and bestfit.cuts(2048) == [(0, 2048)] and bestfit.cuts(2049) == [(0, 1), (1, 2048)]
    assert bestfit.cuts(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)]


def test_best_fit_of_odd_documents(spark):
    check_bins(bestfit.pack(bestfit.pieces(with_clashes(frame(spark)))).collect(), corpus())
    assert bestfit.pack(bestfit.pieces(frame(spark, []))).count() == 0
    assert all(len(r["ids"]) == r["length"] for r in bestfit.pieces(frame(spark), keep_ids=True).collect())


def test_best_fit_over_several_packers_and_few_bins(spark):
    rng = random.Random(8)
    docs = [(i % 300, " ".join(rng.choice(["sun", "moon", "star", "sky"]) for _ in range(rng.randint(1, 1800)))) for i in range(900)]
    cut = bestfit.pieces(frame(spark, docs))
    used, least = check_bins(bestfit.pack(cut, stream_pieces=400, lot=200).collect(), docs)
    assert used <= 1.02 * least
    assert check_bins(bestfit.pack(cut, open_bins=3).collect(), docs)[0] >= used


# ---------------------------------------------------------------- vector codes


def brute_codes(rows, parts=4, entries=256, rounds=4):
    """By plain loops over Python integers. Rows: (vec_id, vector, label)."""
    kept = [(i, [math.floor(1024 * float(x)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    raw = {id(k): v for k, (_, v, _) in zip(kept, [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])], strict=True)}
    usable = sorted((k for k in kept if k[1] and len(k[1]) % parts == 0), key=lambda k: (k[0] is None, k[0] or 0, raw[id(k)]))
    if not usable:
        return []
    width = len(usable[0][1])
    kept = [k for k in kept if len(k[1]) == width]
    size = width // parts
    cut = lambda v: [v[p * size : (p + 1) * size] for p in range(parts)]
    books = [list(b) for b in zip(*[cut(k[1]) for k in usable if len(k[1]) == width][:entries], strict=True)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        found = [[near(p, x)[1] for p, x in enumerate(cut(v))] for _, v, _ in kept]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v)[p] for (_, v, _), f in zip(kept, found, strict=True) if f[p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out, by_label = [], {}
    for i, v, label in kept:
        found = [near(p, x) for p, x in enumerate(cut(v))]
        error = sum(d for d, _ in found)
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, "".join(f"{e:02x}" for _, e in found), error, label))
    return sorted(((i, c, e, by_label[label], digest) for i, c, e, label in out), key=str)


def odd_vectors(n=300, width=8, seed=3):
    rng = random.Random(seed)
    grid = [-1.0, -0.5, -1 / 2048, 0.0, 1 / 2048, 0.25, 0.5]  # many ties
    rows = [(i, [rng.choice(grid) for _ in range(width)], rng.choice([None, 1, 2, 3])) for i in range(n)]
    rows += [(1000 + i, [0.25] * width, 7) for i in range(150)]
    rows += [(2000, None, 1), (2001, [0.1, None] + [0.0] * (width - 2), 1), (2002, [float("nan")] + [0.0] * (width - 1), 1), (2003, [float("inf")] + [0.0] * (width - 1), 2), (2004, [], 2), (2005, [0.5] * (width - 1), 2), (2006, [0.5] * (width + 4), 2)]
    return rows + [(None, [0.5] * width, None), (5, rows[5][1], 2), (5, [0.75] * width, 2), (2007, [3e4] * width, 9), (2008, [-3e4] * width, 9)]


def vectors(spark, rows, partitions=3):
    return spark.createDataFrame(rows, VECTORS).repartition(partitions)


def coded(df):
    kept = codes.kept_vectors(df)
    width, books = codes.train(kept)
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], codes.digest(books)) for r in codes.with_label_errors(codes.encode(kept, width, books)).collect()), key=str)


@pytest.mark.parametrize("n", [0, 3, 300, 700])
def test_codes_equal_brute_force(spark, n):
    rows = odd_vectors(n)
    assert coded(vectors(spark, rows)) == brute_codes(rows)


def test_codes_of_random_vectors_with_clashing_columns(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=12)], int(i % 3)) for i in rng.permutation(600)]
    df = vectors(spark, rows).select("*", *[F.lit("mine").alias(c) for c in ("vector", "code", "error", "label_error", "_label", "n", "part")])
    assert coded(df) == brute_codes(rows)
    assert coded(vectors(spark, [])) == [] and coded(vectors(spark, [(1, None, 1), (2, [0.1] * 3, 1)])) == []


def test_tree_visits_what_a_lower_tie_needs():
    rng = np.random.default_rng(5)
    for _ in range(60):
        points = rng.integers(-3, 4, size=(rng.integers(1, 200), rng.integers(1, 5)))
        parts = rng.integers(-4, 5, size=(rng.integers(0, 300), points.shape[1]))
        for scale in (1, 1 << 26):  # float64 and int64
            index, best = codes.nearest(codes.build(points * scale, leaf=int(rng.integers(1, 9))), points * scale, parts * scale)
            d = (((parts[:, None] - points[None]) * scale) ** 2).sum(2)
            assert (index == d.argmin(1)).all() and (best == d.min(1)).all()


def test_decoded_vectors_are_their_entries(spark):
    rows = odd_vectors(300)
    kept = codes.kept_vectors(vectors(spark, rows))
    width, books = codes.train(kept)
    got = codes.decode(codes.encode(kept, width, books), books).collect()
    by_id = {r[0]: r[1] for r in rows}
    for r in got:
        if r["vec_id"] not in (None, 5):
            v = [math.floor(1024 * x) for x in by_id[r["vec_id"]]]
            assert sum((a - round(1024 * b)) ** 2 for a, b in zip(v, r["decoded"], strict=True)) == r["error"]


def test_errors_of_many_labels_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(codes, "BROADCAST_BYTES", 0)
    rows = odd_vectors(300)
    assert coded(vectors(spark, rows)) == brute_codes(rows)


# ---------------------------------------------------------------- importance resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_features(text, grams=2):
    ws = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return len(ws), [zlib.crc32(" ".join(ws[i : i + k]).encode()) % 10000 for k in range(1, grams + 1) for i in range(len(ws) - k + 1)]


def brute_importance(docs, target, percent=25, min_words=20):
    count = lambda texts: np.bincount([b for t in texts for b in brute_features(t)[1]], minlength=10000)
    s, t = count([x for _, x in docs]), count(target)
    gain = [math.floor(1000 * math.log((float(t[b]) + 1) * (float(s.sum()) + 10000) / ((float(s[b]) + 1) * (float(t.sum()) + 10000)))) for b in range(10000)]
    out = []
    for i, text in docs:
        n, f = brute_features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= min_words))
    able = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    ranks: dict = {}
    for rank, x in enumerate(able[: percent * len(able) // 100], 1):
        ranks.setdefault(x[:4], []).append(rank)
    return sorted(((*x[:4], (ranks[x[:4]].pop(0) if ranks.get(x[:4]) and x[4] else None)) for x in out), key=str)


TARGET = ["sun and moon", None, "", "ab ca de fgh", "Sun AND moon — star", "x" * 5000]


@pytest.mark.parametrize("span", [1, 7, 1 << 20])
def test_features_of_odd_texts(monkeypatch, span):
    whole = resample.spans
    monkeypatch.setattr(resample, "spans", lambda text: whole(text, span))
    texts = [t for _, t in corpus() if t] + ["A1-b2_C3", "é É ß", "\x7f\x00", "a" * 3000, "one " * 5000]
    for text in texts if span > 1 else texts[:12]:
        for grams in (1, 2, 3):
            n, f = resample.features(text.encode(), grams=grams)
            want = brute_features(text, grams)
            assert (n, sorted(f.tolist())) == (want[0], sorted(want[1])), (text[:40], span, grams)


def test_importance_equals_brute_force(spark):
    target = spark.createDataFrame([(i, t) for i, t in enumerate(TARGET)], "item_id long, text string")
    rows = corpus() + [(7000, "sun and moon " * 9)] * 40  # one row many times
    got = resample.importance(with_clashes(frame(spark, rows)), target)
    want = brute_importance(rows, TARGET)
    assert sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in got.collect()), key=str) == want
    kept = resample.resample(with_clashes(frame(spark, rows)), target)
    drawn = {x[0] for x in want if x[4]} - {None}
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} - {None} == drawn and "a.b" in kept.columns


def test_importance_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resample.importance(frame(spark, []), none).count() == 0
    rows = corpus()
    got = resample.importance(frame(spark, rows), none)
    assert sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in got.collect()), key=str) == brute_importance(rows, [])


def test_sorted_runs():
    v = np.sort(np.random.default_rng(1).integers(0, 50, 1000).astype(np.uint16))
    bucket, n = resample.runs(v)
    assert (np.bincount(v)[bucket] == n).all() and n.sum() == 1000
    assert [len(x) for x in resample.runs(v[:0])] == [0, 0]


# ---------------------------------------------------------------- the registered queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('round3')}"
    frame(spark).write.parquet(f"{path}/documents.parquet")
    vectors(spark, odd_vectors(300)).write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(TARGET)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_registered_queries(spark, folder):
    check_bins(Q["op11_best_fit"](spark, folder).collect(), corpus())
    rows = Q["op12_vector_codes"](spark, folder).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(tuple, rows), key=str) == brute_codes(odd_vectors(300))
    rows = Q["op13_importance"](spark, folder).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, rows), key=str) == brute_importance(corpus(), TARGET)
