import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from idloom.llm import bpe, packing, wordpiece
from tests.llm.common import corpus, frame, with_clashes

P = pytest.importorskip("public_tokenizers")


def tokenizer(name):
    t = Tokenizer.from_file(P.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def fuzz(n=3000):
    rng = random.Random(4)
    alphabet = "abcdefghijklmnopqrstuvwxyzABC éèÉ'’0123 \n\t.,!?-_<>|ßςσΣİ日本😀\x85\x1c ​½ǅ"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(n)] + ["<|endoftext|>a<|startoftext|>", "a" * 4000]


def test_encoder_equals_the_library_and_decodes_like_it():
    mine, theirs = bpe.load(P.path("word_bpe_49k.json")), tokenizer("word_bpe_49k.json")
    for text in fuzz():
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert mine.encode(text.encode()).tolist() == ids, text
        assert mine.decode(np.array(ids, np.int32)).decode() == theirs.decode(ids, skip_special_tokens=False)


def test_digests_of_odd_documents(spark):
    t = tokenizer("word_bpe_49k.json")
    docs = with_clashes(frame(spark))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(docs).collect())
    want = []
    for i, text in corpus():
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i is None, i or 0, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    out = bpe.digests(docs)
    assert "kept" in out.columns and out.columns.count("n_tokens") == 1
    assert bpe.digests(frame(spark, [])).count() == 0


def test_encode_then_decode(spark):
    t = tokenizer("word_bpe_49k.json")
    for r in bpe.decode(bpe.encode(frame(spark))).select("text", "token_ids", "decoded").collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["token_ids"] == ids and r["decoded"] == t.decode(ids, skip_special_tokens=False)


def greedy(pieces, word):
    n, i = 0, 0
    while i < len(word):
        size = next((k for k in range(len(word) - i, 0, -1) if word[i : i + k] in pieces), 0)
        if not size:
            return 1
        n, i = n + 1, i + size
    return n


def test_automaton_counts_greedy_pieces():
    rng = random.Random(2)
    for _ in range(300):
        pieces = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 25))} | {"a"}
        automaton = wordpiece.MatchAutomaton(sorted(pieces))
        for _ in range(30):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
            assert automaton.count(word) == greedy(pieces, word), (pieces, word)


def test_token_counts_of_odd_documents(spark):
    counter = wordpiece.load(bpe.default_vocabulary())
    pieces, rows = set(counter.bpe.token), {}
    for r in wordpiece.token_counts(with_clashes(frame(spark))).collect():
        rows[r["doc_id"], r["text"]] = r["n_words"], r["n_tokens"]
    for i, text in corpus():
        if text is None or len(text) < 5000:
            ws = counter.bpe.words(text or "")
            assert rows[i, text] == (len(ws), sum(1 if w in counter.bpe.special else greedy(pieces, counter.bpe.symbols(w)) for w in ws))
    assert wordpiece.token_counts(frame(spark, [])).count() == 0


# ---------------------------------------------------------------- packing


def test_byte_ids_equal_the_library():
    mine, theirs = packing.load(P.path("byte_bpe_50k.json")), tokenizer("byte_bpe_50k.json")
    around = [f"a{c * n}b" for n in range(3998, 4003) for c in (" ", "\n", "\u00a0")]
    for text in [*fuzz(), *around, " " * 9000 + "x", "\n" * 3000]:
        assert mine.encode(text.encode()) == theirs.encode(text, add_special_tokens=False).ids


def test_closest_fill_is_optimal():
    rng = random.Random(3)
    for _ in range(200):
        capacity = rng.randint(1, 60)
        lengths = [rng.randint(1, 40) for _ in range(rng.randint(0, 9))]
        sums = {0}
        for n in lengths:
            sums |= {s + n for s in sums}
        found = packing.closest_fill(np.bincount(lengths, minlength=64), capacity)
        assert sum(n * k for n, k in found) == max(s for s in sums if s <= capacity)
        assert all(k <= lengths.count(n) for n, k in found)


def check_packed(rows, docs, window=1024):
    import zlib

    t = tokenizer("byte_bpe_50k.json")
    want = sorted(((i, len(ids)) for i, x in docs for ids in [t.encode(x or "", add_special_tokens=False).ids + [0]]), key=str)
    tokens = 0
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
        tokens += r["length"]
    assert tokens == sum(n for _, n in want)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    ids_of = {(i, x): np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4") for i, x in docs}
    crcs = sorted((str(i), s, zlib.crc32(ids[s : s + window].tobytes()), len(ids)) for (i, x), n in [((i, x), 1) for i, x in docs] for ids in [ids_of[i, x]] for s in range(0, len(ids), window))
    assert crcs == sorted((str(r["doc_id"]), r["start"], r["ids_crc32"], r["doc_tokens"]) for r in rows)
    return padding / max(tokens + padding, 1)


def test_packing_of_odd_documents(spark):
    rows = packing.pack(packing.pieces(with_clashes(frame(spark)))).collect()
    check_packed(rows, corpus())
    assert packing.pack(packing.pieces(frame(spark, []))).count() == 0


def test_blocks_keep_little_padding(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice(["sun", "moon", "star", "sky"]) for _ in range(rng.randint(1, 900)))) for i in range(1500)]
    cut = packing.pieces(frame(spark, docs))
    assert check_packed(packing.pack(cut, block_pieces=700).collect(), docs) < 0.02


def test_kept_ids_are_the_pieces(spark):
    rows = packing.pieces(frame(spark), keep_ids=True).collect()
    assert all(len(r["ids"]) == r["length"] for r in rows)
