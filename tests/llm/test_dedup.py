import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from idloom.llm import common, minhash, substring
from idloom.llm.common import WordHashes
from idloom.llm.components import components
from tests.llm.common import corpus, frame, with_clashes, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k):
    ws = WORD.findall(lower(text))
    return frozenset(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)) if len(ws) >= k else frozenset([tuple(ws)] if ws else [])


def brute(rows, k, percent=80):
    """component by the index of a row (rows of one set are linked, also without ids)."""
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    least = {g: min((d for d in ds if d is not None), default=None) for g, ds in groups.items()}
    return [(d, len(sets[i]), d if not sets[i] else least[find(i)]) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("k", [4, 5])
def test_components_equal_brute_force(spark, k):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(with_clashes(frame(spark)), k=k).collect()]
    assert sorted(got, key=str) == sorted(brute(corpus(), k), key=str)


def star(n=120, length=150, seed=6):
    """Copies of a hidden text with few or many edits: many pairs lie around the threshold."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    base, rows = words(rng, length, pool), []
    for i in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, 14)):
            at = rng.randrange(len(copy))
            copy[at : at + 1] = [] if rng.random() < 0.5 else [rng.choice(pool[:6])]
        rows.append((i, " ".join(copy)))
    return rows


@pytest.mark.parametrize("seed", [6, 7])
def test_groups_around_the_threshold(spark, seed):
    rows = star(seed=seed)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame(spark, rows), k=4).collect()]
    assert sorted(got) == sorted(brute(rows, 4))


def test_kept_is_the_least_of_each_component(spark):
    rows = minhash.near_duplicates(frame(spark), k=4).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    docs = with_clashes(frame(spark))
    kept = minhash.drop_near_duplicates(docs, k=4)
    assert kept.columns == docs.columns
    want = {r["doc_id"] for r in rows if r["kept"] and r["doc_id"] is not None}
    assert {r["doc_id"] for r in kept.collect() if r["doc_id"] is not None} == want


def test_empty_table(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    assert substring.duplicate_spans(frame(spark, [])).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 900, np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 1 << 63, 100, np.uint64)])
    assert abs((minhash.signature(a) == minhash.signature(b)).mean() - 0.8) < 0.15


def test_signature_check_loses_less_than_banding():
    n = minhash.BANDS * minhash.ROWS
    least = math.ceil((0.8 - minhash.SLACK) * n)
    lost = sum(math.comb(n, i) * 0.8**i * 0.2 ** (n - i) for i in range(least))
    assert lost < (1 - 0.8**minhash.ROWS) ** minhash.BANDS / 100


def test_pairs_with_65_equal_minima_are_confirmed(spark):
    a, b = np.arange(112, dtype=np.uint32), np.arange(112, dtype=np.uint32)
    b[65:] += 1000
    classes = spark.createDataFrame([(b"a", 100, a.tobytes()), (b"b", 100, b.tobytes())], "digest binary, n_shingles long, sig binary")
    pair = spark.createDataFrame([(b"a", b"b")], "a binary, b binary")
    assert minhash._alike(pair, classes, 80).count() == 1


def test_stars_find_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


# ---------------------------------------------------------------- substrings


def removed(rows, span=35):
    texts = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + span]) for w in texts for i in range(len(w) - span + 1))
    out = []
    for (d, _), w in zip(rows, texts, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - span + 1):
            if seen[tuple(w[i : i + span])] > 1:
                gone[i : i + span] = [True] * span
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def spans_of(frame_, **options):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.duplicate_spans(frame_, **options).collect()), key=str)


def test_removed_words_equal_brute_force(spark):
    assert spans_of(with_clashes(frame(spark))) == removed(corpus())
    assert spans_of(frame(spark), span=12) == removed(corpus(), 12)


def test_boundaries_of_shared_passages(spark):
    """Passages of all lengths around a window's, in one document or several, also end to end and overlapping."""
    rng = random.Random(9)
    pool = ["".join(rng.choice("abcdefghij") for _ in range(3)) for _ in range(60)]
    rows, shared = [], words(rng, 200, pool)
    for i in range(150):
        text = words(rng, rng.randint(0, 40), pool)
        for _ in range(rng.randint(1, 3)):
            a = rng.randrange(160)
            text += shared[a : a + rng.randint(30, 45)] + words(rng, rng.randint(0, 3), pool)
        rows.append((i, " ".join(text)))
    assert spans_of(frame(spark, rows)) == removed(rows)


@pytest.mark.parametrize("most", [16 << 20, 0])
def test_hot_keys_give_the_same_rows(spark, monkeypatch, most):
    """All keys as hot ones: joined by a broadcast, or by salts."""
    monkeypatch.setattr(common, "HOT_KEYS", 1 << 40)
    monkeypatch.setattr(common, "BROADCAST_BYTES", most)
    assert spans_of(frame(spark), span=40) == removed(corpus(), 40)


def test_parse_equals_brute_force():
    """One document against one block: every window that the block holds is found, there too, and only those are left out."""
    rng = random.Random(3)
    for round_ in range(120):
        pool = ["%d" % i for i in range(rng.choice([1, 2, 3, 40]))]
        block = [rng.choice(pool).encode() for _ in range(rng.randint(20, 130))]
        text = [rng.choice(pool).encode() for _ in range(rng.randint(12, 300))]
        for _ in range(rng.randint(0, 4)):
            a, at = rng.randrange(len(block)), rng.randrange(len(text))
            text[at:at] = block[a : a + rng.randint(5, 60)]
        same, span, start = round_ % 3 == 0, 12, rng.randrange(30)
        if same:
            block = text[start : start + 90]
        windows = len(text) - span + 1
        if windows < 1 or len(block) < span:
            continue
        parse = substring.Parse(span, WordHashes())
        parse.add(b"d", [{"first": 0, "last": windows - 1, "ref_cls": b"d" if same else b"r", "ref_block": 7}], b" ".join(text), [{"ref_cls": b"d" if same else b"r", "ref_block": 7, "start": start, "block": b" ".join(block)}])
        own, there, left = parse.run()
        places = {}
        for j in range(len(block) - span + 1):
            places.setdefault(tuple(block[j : j + span]), []).append(start + j)
        want, want_there = set(), set()
        for i in range(windows):
            for j in places.get(tuple(text[i : i + span]), []):
                if not (same and i == j):
                    want.add(i)
                    want_there.add(j)
        assert {i for _, i in own} == want and {i for _, i, _ in left} == set(range(windows)) - want
        assert {j for _, j in there} == want_there


def test_factors_are_the_longest_from_the_last_ones_end():
    reach = np.array([9, 9, 0, 0, 0, 0, 0, 0, 0, 18, 19, 0, 0, 0, 0, 0, 0, 0, 0, 0, 30, 0])
    assert list(substring._greedy(reach, np.flatnonzero(reach), 0, 21)) == [(0, 9), (9, 18), (20, 30)]


def test_the_factors_decide(spark, monkeypatch):
    """With a parse that finds no factors, shared passages stay: nothing else marks their windows."""
    rng = random.Random(9)
    passage = words(rng, 60)
    rows = [(i, " ".join(words(rng, 40) + passage[i:] + words(rng, 30))) for i in range(2)]
    taken = {r["doc_id"]: r["n_removed"] for r in substring.duplicate_spans(frame(spark, rows)).collect()}
    assert taken == {0: 59, 1: 59}
    parse = substring.Parse(12, WordHashes())
    parse.add(b"d", [{"first": 0, "last": 48, "ref_cls": b"r", "ref_block": 0}], " ".join(passage).encode(), [{"ref_cls": b"r", "ref_block": 0, "start": 0, "block": " ".join(passage).encode()}])
    assert len(parse.run()[0]) == 49
    monkeypatch.setattr(substring, "_greedy", lambda *a: iter(()))
    own, there, left = parse.run()
    assert not own and not there and len(left) == 49


def test_repeats_are_taken_out_of_texts(spark):
    docs = with_clashes(frame(spark))
    out = substring.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    want = {(d, h) for d, _, n, h in removed(corpus()) if n}
    got = {(r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in out.collect()}
    assert want <= got
    untouched = {(d, t) for (d, t), n in zip(corpus(), [r[2] for r in sorted_like()], strict=True) if not n}
    assert untouched <= {(r["doc_id"], r["text"]) for r in out.collect()}


def sorted_like():
    rows = corpus()
    texts = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in texts for i in range(len(w) - 34))
    return [(d, len(w), any(seen[tuple(w[i : i + 35])] > 1 for i in range(len(w) - 34))) for (d, _), w in zip(rows, texts, strict=True)]
