import random
import zlib
from types import SimpleNamespace

import numpy as np

from idloom.llm import language, quality, toxicity
from idloom.llm.common import WordHashes
from tests.llm.common import corpus, frame, with_clashes


def crc_mod(key, n):
    return zlib.crc32(str(key).encode()) % n


# ---------------------------------------------------------------- quality


def statistics(text):
    import re

    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, seen, dups = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    from collections import Counter

    grams = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    hit = [False] * len(ws)
    for i in range(len(ws) - 2):
        if grams[tuple(ws[i : i + 3])] > 1:
            hit[i : i + 3] = [True] * 3
    n, symbols = len(ws), sum(c in "#*$%&|<>" for c in text or "")
    return n, sum(map(len, ws)), symbols, dups, sum(hit), n < 50 or 100 * sum(hit) > 50 * n


def test_statistics_equal_brute_force(spark):
    rows = [*corpus(), (500, "a b c\na b c\n\n \nx # $ | <>\nx # $ | <>\n a b c"), (501, "é " * 60), (502, "\n".join(["same line of words"] * 30))]
    got = sorted(([r["doc_id"], *(r[c] for c in quality.STATS), r["base_failed"], r["kept"]] for r in quality.judge(with_clashes(frame(spark, rows)), None).collect()), key=str)
    want = sorted(([i, *statistics(t), not statistics(t)[5]] for i, t in rows), key=str)
    assert got == want


def labelled(n=900, seed=3):
    """Prose, and two kinds of junk that the base rules don't catch; labels for two thirds."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(pool) for _ in range(rng.randint(80, 200))]
        bad = i % 10 == 0
        if bad and i % 20:
            text = [w + "***" if rng.random() < 0.5 else w for w in text]
        elif bad:
            text = [w.upper() + "!!" for w in text]
        rows.append((i, " ".join(text)))
        if i % 3:
            labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def test_forest_rejects_held_out_junk(spark):
    rows, labels = labelled()
    docs = frame(spark, rows)
    table = spark.createDataFrame([*labels, (None, 1, 0), (5, None, None), (99_999, 1, 1)], "doc_id long, quality int, toxic int")
    forest = quality.fit(docs, table)
    out = {r["doc_id"]: r["kept"] for r in quality.judge(docs, forest).collect()}
    held_out = [i for i in range(len(rows)) if i % 3 == 0]
    bad = [i for i in held_out if i % 10 == 0]
    assert np.mean([not out[i] for i in bad]) > 0.9
    assert np.mean([out[i] for i in held_out if i % 10]) > 0.98
    kept = quality.keep_good(with_clashes(docs), forest)
    assert kept.columns == with_clashes(docs).columns and {r["doc_id"] for r in kept.collect()} == {i for i, k in out.items() if k}


def test_no_usable_labels(spark):
    docs = frame(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, none) is None
    assert quality.judge(frame(spark, []), None).count() == 0
    only_good = spark.createDataFrame([(i, 1, 0) for i in range(400, 430)], "doc_id long, quality int, toxic int")
    forest = quality.fit(docs, only_good)
    assert forest is None or forest.threshold == 2.0


def test_random_splits_isolate_outliers():
    x = np.random.default_rng(1).normal(size=(2000, len(quality.FEATURES))).astype(np.float32)
    forest = quality.grow(x)
    far = np.full((1, len(quality.FEATURES)), 8, np.float32)
    assert forest.scores(far)[0] > np.quantile(forest.scores(x), 0.99)
    assert WordHashes().of([b"a", b"a"]).tolist()[0] == WordHashes().of([b"a"]).tolist()[0]


# ---------------------------------------------------------------- language

SYLLABLES = {"aa": ["ka", "to", "mi", "nesh", "ur"], "bb": ["øl", "gen", "ske", "av", "ig"], "cc": ["qui", "eau", "ont", "ré", "le"]}


def speech(rng, lang, n):
    return ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def spoken(n=360, seed=4):
    rng = random.Random(seed)
    return [(i, " ".join(speech(rng, ["aa", "bb", "cc"][i % 3], rng.randint(1, 120))), ["aa", "bb", "cc"][i % 3]) for i in range(n)]


def fitted(spark):
    rows = spoken()
    docs = spark.createDataFrame([*rows, (1000, None, "aa"), (1001, "123 ...", None), (None, "ka to mi", "aa"), (1002, "", "bb")], "doc_id long, text string, lang string")
    return rows, docs, language.fit(docs, docs.where("doc_id % 3 <> 1 OR doc_id % 2 = 0"))


def test_languages_are_told_apart(spark):
    rows, docs, model = fitted(spark)
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(with_clashes(docs), model).collect()}
    assert np.mean([out[i][0] == lang for i, _, lang in rows]) > 0.97
    assert out[1000] == ("und", 0.0) and out[1001] == ("und", 0.0) and out[1002] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in out.values())
    kept = language.keep_known_language(with_clashes(docs), model)
    assert kept.columns == with_clashes(docs).columns and 1001 not in {r["doc_id"] for r in kept.collect()}


def test_code_switched_words_are_labelled_in_runs(spark):
    _, _, model = fitted(spark)
    rng = random.Random(7)
    text = speech(rng, "aa", 30) + speech(rng, "cc", 30) + speech(rng, "bb", 30)
    labels = model.label_words([w.lower() for w in text])
    assert np.mean([x == y for x, y in zip(labels, ["aa"] * 30 + ["cc"] * 30 + ["bb"] * 30, strict=True)]) > 0.93


def test_forward_backward_equals_brute_force():
    rng = np.random.default_rng(2)
    lengths = np.array([1, 2, language.CHUNK - 1, language.CHUNK, language.CHUNK + 1, 3 * language.CHUNK + 5, 7])
    e = rng.random((lengths.sum(), 3)).astype(np.float32) + 0.01
    transfer = np.exp(rng.normal(size=(3, 3)))
    got, at = language.forward_backward(e, lengths, transfer), 0
    for n in lengths:
        part = e[at : at + n].astype(float)
        a, b = np.zeros((n, 3)), np.ones((n, 3))
        now = np.full(3, 1 / 3)
        for t in range(n):
            now = (now @ transfer if t else now) * part[t]
            now /= now.sum()
            a[t] = now
        for t in range(n - 2, -1, -1):
            b[t] = transfer @ (part[t + 1] * b[t + 1])
            b[t] /= b[t].sum()
        want = a * b / (a * b).sum(1, keepdims=True)
        assert np.allclose(got[at : at + n], want, atol=1e-3)
        at += n


def log_likelihood(scores, lengths, gold, trans):
    """By all label sequences of each chain."""
    from itertools import product

    total, at = 0.0, 0
    for n in lengths:
        value = lambda y: sum(scores[at + t, y[t]] for t in range(n)) + sum(trans[y[t - 1], y[t]] for t in range(1, n))  # noqa: B023, E731
        every = np.array([value(y) for y in product(range(scores.shape[1]), repeat=int(n))])
        total += value(gold[at : at + n]) - (np.log(np.exp(every - every.max()).sum()) + every.max())
        at += n
    return total


def test_gradient_equals_finite_differences(monkeypatch):
    rng = np.random.default_rng(3)
    lengths = np.array([1, 2, 5, 3])
    scores, trans, gold = rng.normal(size=(11, 3)), rng.normal(size=(3, 3)), rng.integers(0, 3, 11)
    by_word, by_pair = language.gradient(scores, lengths, gold, trans)
    monkeypatch.setattr(language, "SLICE", 9 * 4)
    again = language.gradient(scores, lengths, gold, trans)
    assert np.allclose(by_word, again[0], atol=1e-5) and np.allclose(by_pair, again[1], atol=1e-5)
    for array, got in ((scores, by_word), (trans, by_pair)):
        for i in np.ndindex(array.shape):
            kept = array[i]
            array[i] = kept + 1e-4
            up = log_likelihood(scores, lengths, gold, trans)
            array[i] = kept - 1e-4
            down = log_likelihood(scores, lengths, gold, trans)
            array[i] = kept
            assert abs((up - down) / 2e-4 - got[i]) < 2e-3


def test_transitions_prefer_to_stay():
    rng = random.Random(12)
    rows = [(lang, speech(rng, lang, 40)) for _ in range(60) for lang in ("aa", "cc")]
    model = language.train(rows)
    assert model.transitions[0, 0] > model.transitions[0, 1] and model.transitions[1, 1] > model.transitions[1, 0]


def test_learns_from_whole_texts_of_bounded_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(["word"] * 50), "en") for i in range(1600)], "doc_id long, text string, lang string")
    monkeypatch.setattr(language, "train", lambda rows: [len(words) for _, words in rows])
    monkeypatch.setattr(language, "calibrate", lambda model, rows: model + [len(words) for _, words in rows])
    assert language.fit(docs, docs) == [50] * 1500
    monkeypatch.setattr(language, "SAMPLE_BYTES", 250 * 20)
    assert language.fit(docs, docs) == [50] * 20
    monkeypatch.setattr(language, "SAMPLE_BYTES", 100)
    assert language.fit(docs, docs) == [50]  # one text, though it is longer


def test_every_language_is_learned(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(["word"] * 50), f"l{i % 70}") for i in range(350)], "doc_id long, text string, lang string")
    monkeypatch.setattr(language, "train", lambda rows: rows)
    monkeypatch.setattr(language, "calibrate", lambda model, rows: model)
    got = [lang for lang, _ in language.fit(docs, docs, docs_per_lang=2)]
    assert sorted(got) == sorted([f"l{i}" for i in range(70)] * 2)


def test_samples_are_bounded_by_rows_where_an_id_repeats(spark, monkeypatch):
    """One id on 3,000 rows: it counts once in each of the three samples."""
    rows = [(7, " ".join(["same"] * (50 + i % 100))) for i in range(3000)] + [(i, " ".join(["word", f"w{i % 9}"] * 40)) for i in range(100, 160)]
    docs = spark.createDataFrame([(i, t, "en" if i == 7 else "fr") for i, t in rows], "doc_id long, text string, lang string")
    monkeypatch.setattr(language, "train", lambda rows: rows)
    monkeypatch.setattr(language, "calibrate", lambda model, held: model + held)
    assert sorted((lang, len(words)) for lang, words in language.fit(docs, docs)) == [("en", 50)] + [("fr", 80)] * 60
    labels = spark.createDataFrame([(i, int(i != 7), int(i == 7)) for i in [7, *range(100, 160)]], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(quality, "calibrate", lambda forest, x, good: len(good))
    monkeypatch.setattr(quality, "grow", lambda x: None)
    monkeypatch.setattr(quality, "zlib", SimpleNamespace(crc32=lambda x: 0))  # all in one part: nothing is set apart
    assert quality.fit(docs, labels) == 61
    sample = toxicity._sample(docs, labels, "doc_id", "text", 1000)
    assert sorted(r["_key"] for r in sample.collect()) == [i for i in [7, *range(100, 160)] if crc_mod(i, 5)]


def test_mixed_texts_fall_below_the_calibrated_score(spark):
    _, docs, model = fitted(spark)
    rng = random.Random(8)
    rows = [(i, " ".join(speech(rng, "aa", 40) + (speech(rng, "cc", 40) if i % 2 else []))) for i in range(60)]
    kept = {r["doc_id"] for r in language.keep_known_language(frame(spark, rows), model).collect()}
    assert {i for i, _ in rows if i % 2 == 0} <= kept and len({i for i, _ in rows if i % 2} & kept) < 5
    assert 0.5 < model.least_score < 1
    assert language.calibrate(model, []) is model and language.calibrate(model, [("aa", ["ka"])]) is model


def test_marginals_in_slices(monkeypatch):
    rng = np.random.default_rng(2)
    crf = language.Crf(("a", "b", "c"), np.zeros((1, 3)), rng.normal(size=(3, 3)))
    lengths = np.array([1, 200, 64, 65, 3, 129])
    e = rng.random((lengths.sum(), 3)).astype(np.float32)
    whole = crf.marginals(e, lengths)
    monkeypatch.setattr(language, "SLICE", 9 * 3)
    assert np.allclose(whole, crf.marginals(e, lengths), atol=1e-6)


def test_language_of_odd_documents(spark):
    _, _, model = fitted(spark)
    assert language.predict(frame(spark), model).count() == len(corpus())
    assert language.predict(frame(spark, []), model).count() == 0
    empty = language.fit(frame(spark, []), frame(spark, []))
    assert {r["lang_pred"] for r in language.predict(frame(spark), empty).collect()} == {"und"}


# ---------------------------------------------------------------- toxicity


def insults(n=1500, seed=5):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("bcdfgaeiou") for _ in range(rng.randint(3, 8))) for _ in range(2000)]
    forms = ["grumbot", "GRUMBOT", "gr4mb0t".replace("4", "u"), "grumb0t", "gruuuumbot", "grumbоt", "snarfle", "5narfle", "snarfl3"]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(pool) for _ in range(rng.randint(20, 120))]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                text.insert(rng.randrange(len(text)), rng.choice(forms))
        elif i % 8 == 1:
            text[3:5] = ["mister", "snarfle"]  # a harmless name
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxic_documents_are_found(spark):
    rows, labels = insults()
    docs = frame(spark, rows)
    lexicon = toxicity.fit(docs, spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int"))
    out = {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.score(with_clashes(docs), lexicon).collect()}
    held_out = [(i, t) for i, _, t in labels if crc_mod(i, 5) == 0]
    assert np.mean([out[i][1] for i, t in held_out if t]) > 0.9
    assert np.mean([1 - out[i][1] for i, t in held_out if not t]) > 0.97
    assert all(0 <= s <= 1 and p == (s >= 0.5) for s, p in out.values())


def test_matches_and_exceptions_equal_brute_force():
    """Every word counts the largest weight of its entries, unless it is part of an exception phrase."""
    rng = random.Random(6)
    E = toxicity.EDGE
    for _ in range(300):
        pool = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(12)]
        weights = {}
        for w in rng.sample(pool, 4):
            weights[rng.choice(toxicity.entries_of(w))] = rng.randint(1, 90) / 10
        pairs = {(rng.choice(pool), rng.choice(pool)) for _ in range(rng.randint(0, 6))}
        lexicon = toxicity.Lexicon(weights, frozenset(E + a + E + b + E for a, b in pairs))
        text = [rng.choice(pool) for _ in range(rng.randint(0, 40))]
        total = 0
        for i, w in enumerate(text):
            excepted = (i and (text[i - 1], w) in pairs) or (i + 1 < len(text) and (w, text[i + 1]) in pairs)
            total += 0 if excepted else max((weights.get(e, 0) for e in toxicity.entries_of(w)), default=0)
        want = np.log1p(total), np.log1p(100 * total / max(len(text), 1)), np.log1p(len(text))
        assert np.allclose(lexicon.features(text), want), (weights, pairs, text)


def test_lexicon_has_all_entries_with_evidence(spark):
    """No cap: many toxic words and stems, of which each is counted by the rows that hold it."""
    rng = random.Random(9)
    bad = ["".join(rng.choice("qwxz") for _ in range(9)) + str(i).translate(str.maketrans("0123456789", "abcdefghij")) for i in range(300)]
    rows = [(i, " ".join(["calm", "words", *(rng.sample(bad, 150) if i % 2 else [])])) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    lexicon = toxicity.fit(frame(spark, rows), labels)
    whole = {e.strip(toxicity.EDGE) for e in lexicon.weights if e.endswith(toxicity.EDGE)}
    assert whole == {toxicity.fold_word(b.encode()) for b in bad}


def test_folding():
    for form in (b"GRUMBOT", b"grumb0t!!", b"gr-um.bot", b"gruuumbot", "grumbоt".encode(), "grümbot".encode(), "g​rumbot".encode()):
        assert toxicity.fold_word(form) in ("grumbot", "gruumbot", "grümbot"), form
    assert toxicity.fold_word(b"123") == "" and toxicity.fold_word(b"***") == ""


def test_scores_of_odd_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    lexicon = toxicity.fit(frame(spark), none)
    out = toxicity.score(frame(spark), lexicon).collect()
    assert len(out) == len(corpus()) and {r["score"] for r in out} == {0.0}
    one_kind = toxicity.fit(frame(spark), spark.createDataFrame([(i, 1, 0) for i in range(400, 430)], "doc_id long, quality int, toxic int"))
    assert toxicity.score(frame(spark, []), one_kind).count() == 0
