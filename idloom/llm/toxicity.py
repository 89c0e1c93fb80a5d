"""Toxicity (operator 9): a weighted lexicon matched by Aho-Corasick after folding, normalised by length.

Words are folded first (case, accents written as homoglyphs, digit and sign substitutions, stretched letters, inner
punctuation), then one automaton finds lexicon words and lexicon stems (word beginnings). Matches inside an exception
phrase do not count. The sum of weights, and its share of the text's words, go through a logistic curve.

Lexicon, exception phrases and curve are learned from a bounded sample of labelled rows only.

Defined cases: a null or empty text, or one without words, has the curve's value for zero matches; ties and repeated
rows score alike; texts are scored whole; without labelled rows of both kinds the lexicon is empty and the score is
the share of toxic labels (0 without labels); an empty table gives an empty result; other columns pass through, those with the name of a result column are
replaced; null ids are returned as they came (and count as held out).
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idloom.llm.common import CACHE_WORDS, fold_of, materialize, table, with_columns

#: Labelled rows that may be learned from at most; the toxic and the other rows share them evenly.
SAMPLE_ROWS = 12_000
#: A word or stem must be in so many toxic sample rows, and this much likelier there (log-likelihood ratio, log of the
#: ratio of shares). An exception phrase must be in so many of the other rows, and in no toxic one.
MIN_ROWS, MIN_EVIDENCE, MIN_RATIO, MIN_EXCEPTION = 5, 14.0, 0.7, 5
STEM_LENGTHS = (4, 5, 6, 7)
STRIP = b"#*%&!|.,;:?()[]{}<>\"'`~^+=_-/\\$"
EDGE = "\0"

# Letters of other scripts that look like Latin letters, and signs that stand for letters.
HOMOGLYPHS = str.maketrans(
    "абвсԁеғгһіјкӏмнорԛѕтцѵѡхуᴢαβγδεζηικνορτυχω",
    "abbcdefrhijklmhopqstuvwxyzabydeznikvoptuxw",
)
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "*": "", ".": "", "-": "", "_": "", "'": ""})


def fold_word(word: bytes) -> str:
    """The lexicon form of one word; a word without letters folds to an empty string."""
    text = word.strip(STRIP[:-1]).rstrip(b"$").decode("utf-8", "replace").lower()
    if text.isascii():
        if not text.isalpha():
            if not any(c.isalpha() for c in text):
                return ""
            text = text.translate(SIGNS)
    else:
        text = unicodedata.normalize("NFKC", text).translate(HOMOGLYPHS)
        text = "".join(c for c in text if unicodedata.category(c) not in ("Cf", "Mn"))
        if not any(c.isalpha() for c in text):
            return ""
        text = text.translate(SIGNS)
    for c in set(text):
        if c * 3 in text:
            while c * 3 in text:
                text = text.replace(c * 3, c)
    return text


class Folds(dict):
    def __missing__(self, word: bytes) -> str:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = fold_word(word)
        if len(word) <= 64:
            self[word] = value
        return value


def folded(text: bytes | None, folds: Folds) -> list[str]:
    return list(filter(None, map(folds.__getitem__, (text or b"").split())))


def entries_of(word: str) -> list[str]:
    """The word between edges, and its beginnings (itself too) after an edge: what the automaton finds in it."""
    return [EDGE + word + EDGE, *(EDGE + word[:k] for k in STEM_LENGTHS if len(word) >= k)]


def phrases_of(words: list[str], lexicon: frozenset[str]) -> set[str]:
    """Pairs of neighbouring words of which one is in the lexicon."""
    return {EDGE + a + EDGE + b + EDGE for a, b in zip(words, words[1:]) if a in lexicon or b in lexicon}


@dataclass(frozen=True)
class Lexicon:
    weights: dict[str, float]
    exceptions: frozenset[str]
    curve: tuple[float, ...] = (0.0,)
    mean: tuple[float, ...] = (0.0, 0.0, 0.0)
    _cache: dict = field(default_factory=dict, compare=False, repr=False)

    def __reduce__(self):
        return Lexicon, (self.weights, self.exceptions, self.curve, self.mean)

    def matcher(self) -> ahocorasick.Automaton | None:
        if "matcher" not in self._cache:
            found = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                found.add_word(entry, (len(entry), weight))
            if self.weights:
                found.make_automaton()
            self._cache["matcher"] = found if self.weights else None
        return self._cache["matcher"]

    def features(self, words: list[str]) -> tuple[float, float, float]:
        """log1p of the summed weight, log1p of that for each 100 words, log1p of the length."""
        matcher, total = self.matcher(), 0.0
        if matcher is not None and words:
            text = EDGE + EDGE.join(words) + EDGE
            best: dict[int, float] = {}
            for end, (size, weight) in matcher.iter(text):
                start = end - size + 1
                if weight > best.get(start, 0.0):
                    best[start] = weight
            if best and self.exceptions:
                for start in list(best):
                    stop = text.index(EDGE, start + 1)
                    left, right = text.rfind(EDGE, 0, start), text.find(EDGE, stop + 1)
                    if (left >= 0 and text[left : stop + 1] in self.exceptions) or (right >= 0 and text[start : right + 1] in self.exceptions):
                        del best[start]
            total = sum(best.values())
        return float(np.log1p(total)), float(np.log1p(100 * total / max(len(words), 1))), float(np.log1p(len(words)))

    def score(self, x: np.ndarray) -> np.ndarray:
        if len(self.curve) == 1:
            return np.full(len(x), self.curve[0])
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + (x - np.array(self.mean)) @ np.array(self.curve[1:]), -30, 30)))


def _sample(docs: DataFrame, labels: DataFrame, key: str, text_col: str, rows: int) -> DataFrame:
    """Labelled rows outside the held-out fold, each kind up to half of ``rows`` (chosen by a hash of the key).

    The broadcast side holds ``rows`` keys at most, and so does the sample: of several rows with one key, the first text in
    byte order counts.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull() & (fold_of(F.col(key), 5) != 0)).groupBy(F.col(key).alias("_key")).agg(F.max("toxic").alias("_toxic"))
    parts = [known.where(F.col("_toxic") == v).orderBy(F.xxhash64("_key"), "_key").limit(rows // 2) for v in (0, 1)]
    return docs.select(F.col(key).alias("_key"), F.col(text_col).alias("_text")).join(F.broadcast(parts[0].unionByName(parts[1])), "_key").groupBy("_key", "_toxic").agg(F.min("_text").alias("_text"))


def _counts(sample: DataFrame, entries_of_text: Callable[[list[str]], set[str]]) -> DataFrame:
    """(entry, toxic rows, other rows) of all entries of the sample's folded texts, with the rows that hold them."""

    def run(batches):
        folds, found = Folds(), {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[int(toxic)].update(entries_of_text(folded(text, folds)))
        keys = list(found[0].keys() | found[1].keys())
        for i in range(0, len(keys), 20_000):
            part = keys[i : i + 20_000]
            yield pa.RecordBatch.from_pydict({"entry": part, "bad": [found[1][k] for k in part], "good": [found[0][k] for k in part]})

    return sample.select("_text", "_toxic").mapInArrow(run, "entry string, bad long, good long").groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def _evidence(n_bad: int, n_good: int) -> tuple[Column, Column]:
    """(log ratio of shares, log-likelihood ratio of two shares against one) of the counts ``bad`` and ``good``."""
    bad, good = F.col("bad"), F.col("good")
    p, q, r = (bad + 0.25) / (n_bad + 0.5), (good + 0.25) / (n_good + 0.5), (bad + good + 0.5) / (n_bad + n_good + 1)

    def likelihood(k: Column, n: int, share: Column) -> Column:
        return k * F.log(share) + (n - k) * F.log1p(-F.least(share, F.lit(1 - 1e-9)))

    return F.log(p / q), likelihood(bad, n_bad, p) + likelihood(good, n_good, q) - likelihood(bad, n_bad, r) - likelihood(good, n_good, r)


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Logistic regression with a small ridge by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        ridge = np.full(len(b), 0.5)
        ridge[0] = 1e-6
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (y - p)) - ridge * b)
        b += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in b)


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Lexicon:
    """Learn lexicon, exception phrases and curve from the sample, which is written once. The driver receives the entries
    and phrases that pass the bounds on rows and evidence (counted and tested in Spark), and three numbers a row."""
    sample = materialize(_sample(docs, labels, key, text_col, sample_rows), "toxicity-sample")
    known = labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull() & (fold_of(F.col(key), 5) != 0))
    shares = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    totals = {r["_toxic"]: r["n"] for r in sample.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    n_bad, n_good = totals.get(1, 0), totals.get(0, 0)
    prior = shares.get(1, 0) / max(sum(shares.values()), 1)
    if not n_bad or not n_good:
        return Lexicon({}, frozenset(), (prior,))
    ratio, evidence = _evidence(n_bad, n_good)
    counted = _counts(sample, lambda words: {e for w in set(words) for e in entries_of(w)}).where(F.col("bad") >= MIN_ROWS)
    chosen = counted.select("entry", ratio.alias("ratio"), evidence.alias("evidence")).where((F.col("evidence") >= MIN_EVIDENCE) & (F.col("ratio") > MIN_RATIO))
    weights = {r["entry"]: round(r["ratio"], 4) for r in chosen.orderBy("entry").collect()}
    if not weights:
        return Lexicon({}, frozenset(), (prior,))
    whole = frozenset(e.strip(EDGE) for e in weights if e.endswith(EDGE))
    phrases = _counts(sample, lambda words: phrases_of(words, whole)).where((F.col("bad") == 0) & (F.col("good") >= MIN_EXCEPTION))
    lexicon = Lexicon(weights, frozenset(r["entry"] for r in phrases.collect()))
    new = [T.StructField("x", T.ArrayType(T.DoubleType()))]

    def measure(texts: list[bytes | None]) -> list:
        folds = Folds()
        return [pa.array([list(lexicon.features(folded(x, folds))) for x in texts], pa.list_(pa.float64()))]

    got = sorted((r["_key"], r["_toxic"], r["x"]) for r in with_columns(sample, "_text", new, measure).select("_key", "_toxic", "x").collect())
    x, y = np.array([r[2] for r in got]), np.array([r[1] for r in got], float)
    # weights undo the even sampling of both kinds
    weight = np.where(y == 1, prior / (n_bad / len(y)), (1 - prior) / (n_good / len(y)))
    mean = tuple(float(v) for v in x.mean(0))
    return Lexicon(weights, lexicon.exceptions, _curve(x - np.array(mean), y, weight), mean)


@cache
def _folds() -> Folds:
    return Folds()


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5), in one narrow pass over whole texts."""
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

    def run(texts: list[bytes | None]) -> list:
        folds = _folds()
        x = np.array([lexicon.features(folded(t, folds)) for t in texts], float).reshape(-1, 3)
        s = lexicon.score(x)
        return [pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))]

    return with_columns(docs, text_col, fields, run)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold_of(F.col("doc_id"), 5) == 0, F.lit(True))
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", held_out.alias("held_out"), "score", "predicted")
