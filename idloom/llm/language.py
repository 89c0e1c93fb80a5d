"""Language ID (operator 8): a linear-chain conditional random field labels words, forward-backward gives marginals.

Every word that holds a letter gets emission scores from hashed features: affixes (byte n-grams at its edges), inner
byte n-grams and the whole word (the lexicon). Learned transitions link neighbouring words, so in code-switched text
each run of words gets its own label. A document's prediction is the label with the largest mean marginal, which is
its score.

Forward-backward is exact for texts of any length and runs over a whole batch at once: texts are cut into chunks,
each chunk's transfer matrix is one product over its words, chunk borders are scanned in order, and then all chunks
run side by side.

The model knows every language of the labelled rows. It learns from the whole texts of at most ``docs_per_lang`` rows of
each (chosen by a hash of the id) and SAMPLE_BYTES of text in all, in mini-batches, so the driver's memory doesn't grow
with the words. Half of the training sequences splice two rows, so that switches are seen. One row of HOLD_OUT isn't
learned from: these rows and mixtures of them calibrate the score below which a filter takes a text for mixed.

Defined cases: a null or empty text and one without letters is ``und`` with score 0; words without letters have no
label; texts are used whole; ties go to the label that sorts first; repeated rows are predicted alike; a null id is
never learned from and counts as held out; without labelled rows everything with letters is ``und`` with score 0; a
language without a text of its share of SAMPLE_BYTES is learned from one longer text; an empty table gives an empty result; other columns pass through, those named like a result column are replaced.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idloom.llm.common import fold_of, keep_where, materialize, slices, table, with_columns

#: Labelled rows of each language that are learned from at most, and bytes of all their texts (each language has an even
#: share, and at least one text).
DOCS_PER_LANG, SAMPLE_BYTES = 1500, 12 << 20
#: Keys that are broadcast at most while the sample is chosen.
MOST_KEYS = 200_000
#: One sampled row of so many is held out for the calibration.
HOLD_OUT = 10
TABLE_BITS, GRAMS = 18, (2, 3, 4, 5)
#: Passes over the sample (more if that makes fewer than STEPS steps), words of a step, and AdaGrad's rate.
EPOCHS, STEPS, BATCH, RATE, RIDGE = 4, 60, 32_768, 0.3, 1e-6
#: Words of a chunk, and words in a worker's emission cache (emptied when full).
CHUNK, CACHE = 64, 250_000
#: Numbers in the largest array of one slice of texts (their words or chunks by the squared number of labels).
SLICE = 1 << 21
#: A filter keeps documents whose best language has at least this mean marginal, if it can't be calibrated; a calibrated
#: one loses this share of held-out texts in one language at most.
LEAST_SCORE, LOSS = 0.4, 0.001
UND = "und"
_ZERO = (1 << TABLE_BITS) + (1 << TABLE_BITS)  # index of the row that stays zero


def lettered(text: bytes | None) -> list[str]:
    """Lower-cased words, without those that hold no letter."""
    return [w for w in (text or b"").decode("utf-8", "replace").lower().split() if w.isalpha() or any(c.isalpha() for c in w)]


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature rows, word of each): n-grams of ``^word$`` in the table's lower half, whole words in its upper half."""
    data = [b"\x02" + w.encode() + b"\x03" for w in words]
    size = np.array([len(x) for x in data], np.int64)
    end = np.cumsum(size)
    codes = np.frombuffer(b"".join(data), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), size)
    room = end[owner] - np.arange(len(codes))
    rows, of, h = [], [], codes.copy()
    for n in range(2, max(GRAMS) + 1):
        h[: len(h) - n + 1] = h[: len(h) - n + 1] * np.uint32(0x01000193) ^ codes[n - 1 :]
        if n in GRAMS:
            ok = room >= n
            x = (h[ok] ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            rows.append((x ^ (x >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - TABLE_BITS))
            of.append(owner[ok])
    whole = np.array([zlib.crc32(x) for x in data], np.uint32) >> np.uint32(32 - TABLE_BITS)
    rows.append(whole + np.uint32(1 << TABLE_BITS))
    of.append(np.arange(len(words), dtype=np.int32))
    return np.concatenate(rows).astype(np.int32), np.concatenate(of)


@dataclass(frozen=True)
class Crf:
    labels: tuple[str, ...]
    weights: np.ndarray  # feature rows x labels
    transitions: np.ndarray  # labels x labels
    least_score: float = LEAST_SCORE
    _cache: dict = field(default_factory=dict, compare=False, repr=False)

    def __reduce__(self):
        used = np.flatnonzero(self.weights.any(1))
        return _unpack, (self.labels, used.astype(np.int32), self.weights[used].astype(np.float32), self.transitions, self.least_score)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Emission scores, words x labels."""
        out = np.zeros((len(words), len(self.labels)), np.float32)
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            rows, of = word_features(part)
            for k in range(len(self.labels)):
                out[i : i + len(part), k] = np.bincount(of, self.weights[rows, k], len(part))
        return out

    def potentials(self, words: list[str]) -> np.ndarray:
        """exp(emissions), each word's largest scaled to 1, by a bounded cache."""
        at, known = self._cache.setdefault("at", {}), self._cache.get("known")
        found = list(map(at.get, words))
        if None in found:
            new = list(dict.fromkeys(w for w, i in zip(words, found, strict=True) if i is None))
            if len(at) + len(new) > CACHE:
                at.clear()
                known, new = None, list(dict.fromkeys(words))
            e = self.emissions(new)
            e = np.exp(np.maximum(e - e.max(1, keepdims=True), -60)).astype(np.float32)
            at.update(zip(new, range(len(at), len(at) + len(new)), strict=True))
            known = self._cache["known"] = e if known is None else np.concatenate([known, e])
            found = list(map(at.__getitem__, words))
        return known[np.array(found, np.int64)] if words else np.empty((0, len(self.labels)), np.float32)

    def marginals(self, potentials: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Posterior label probabilities of all words; ``lengths`` are the words of each text (each at least 1)."""
        transfer, ends = np.exp(self.transitions), np.append(0, np.cumsum(lengths))
        parts = slices(-(-lengths // CHUNK), SLICE // len(self.labels) ** 2)
        return np.concatenate([forward_backward(potentials[ends[i] : ends[j]], lengths[i:j], transfer) for i, j in parts])

    def label_words(self, words: list[str]) -> list[str]:
        """The likeliest label of each word of one text."""
        if not words:
            return []
        best = self.marginals(self.potentials(words), np.array([len(words)])).argmax(1)
        return [self.labels[i] for i in best]

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray]:
        """(label, mean marginal of that label) of each text."""
        each = [lettered(x) for x in texts]
        lengths = np.array([len(x) for x in each], np.int64)
        names, scores = [UND] * len(texts), np.zeros(len(texts))
        full = np.flatnonzero(lengths)
        if len(full) and len(self.labels):
            p = self.marginals(self.potentials([w for x in each for w in x]), lengths[full])
            start = np.concatenate([[0], np.cumsum(lengths[full])[:-1]])
            mean = np.add.reduceat(p, start, axis=0, dtype=np.float64) / lengths[full, None]
            best = mean.argmax(1)
            scores[full] = np.clip(mean[np.arange(len(full)), best], 0, 1)
            for i, b in zip(full.tolist(), best.tolist(), strict=True):
                names[i] = self.labels[b]
        return names, scores


def _unpack(labels: tuple[str, ...], used: np.ndarray, values: np.ndarray, transitions: np.ndarray, least_score: float) -> Crf:
    weights = np.zeros((_ZERO + 1, len(labels)), np.float32)
    weights[used] = values
    return Crf(labels, weights, transitions, least_score)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / x.sum(-1, keepdims=True)


def messages(potentials: np.ndarray, lengths: np.ndarray, transfer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(forward, backward) messages of every word, each scaled to a sum of 1, of chains that lie one after another in
    ``potentials``: forward holds the words up to this one, backward those after it."""
    k, transfer = potentials.shape[1], transfer.astype(np.float32)
    chunks = -(-lengths // CHUNK)
    first = np.concatenate([[0], np.cumsum(chunks)[:-1]])
    total = int(chunks.sum())
    chain = np.repeat(np.arange(len(lengths)), lengths)
    within = np.arange(len(potentials)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    row, step = first[chain] + within // CHUNK, within % CHUNK
    e = np.ones((CHUNK, total, k), np.float32)
    live = np.zeros((CHUNK, total, 1), bool)
    e[step, row], live[step, row] = potentials, True
    starts = np.zeros((total, 1), bool)
    starts[first] = True  # a chain's first word has no transition
    # each chunk's product of transfer matrices; a dead step changes nothing
    product = np.broadcast_to(np.eye(k, dtype=np.float32), (total, k, k)).copy()
    for t in range(CHUNK):
        moved = (product.reshape(-1, k) @ transfer).reshape(total, k, k)
        after = (np.where(starts[:, :, None], product, moved) if t == 0 else moved) * e[t][:, None, :]
        product = np.where(live[t][:, :, None], after / after.max((1, 2), keepdims=True), product)
    # the distribution that enters each chunk from either side
    into, out_of = np.full((total, k), 1 / k, np.float32), np.full((total, k), 1 / k, np.float32)
    for j in range(1, int(chunks.max())):
        at = first[chunks > j] + j
        into[at] = _unit(np.einsum("ni,nij->nj", into[at - 1], product[at - 1]))
    for j in range(int(chunks.max()) - 2, -1, -1):
        at = first[chunks > j + 1] + j
        out_of[at] = _unit(np.einsum("nij,nj->ni", product[at + 1], out_of[at + 1]))
    alpha, beta, now = np.empty_like(e), np.empty_like(e), into
    for t in range(CHUNK):
        moved = now @ transfer
        now = np.where(live[t], _unit((np.where(starts, now, moved) if t == 0 else moved) * e[t]), now)
        alpha[t] = now
    now = out_of
    for t in range(CHUNK - 1, -1, -1):
        beta[t] = now
        now = np.where(live[t], _unit((now * e[t]) @ transfer.T), now)
    return alpha[step, row], beta[step, row]


def forward_backward(potentials: np.ndarray, lengths: np.ndarray, transfer: np.ndarray) -> np.ndarray:
    """Exact posteriors of the words of chains that lie one after another in ``potentials``."""
    alpha, beta = messages(potentials, lengths, transfer)
    return _unit(alpha * beta)


# ---------------------------------------------------------------- learning


def gradient(scores: np.ndarray, lengths: np.ndarray, gold: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the log-likelihood of the labels ``gold`` by emission scores (words x labels) and by transitions: what
    is labelled less what is expected. The expected transitions are sums of exact pairwise posteriors."""
    transfer = np.exp(transitions)
    e = np.exp(np.maximum(scores - scores.max(1, keepdims=True), -60)).astype(np.float32)
    by_word, pairs = np.empty_like(e), np.zeros_like(transfer)
    ends = np.append(0, np.cumsum(lengths))
    for i, j in slices(lengths, SLICE // len(transfer) ** 2):
        low, high = ends[i], ends[j]
        alpha, beta = messages(e[low:high], lengths[i:j], transfer)
        by_word[low:high] = -_unit(alpha * beta)
        inner = np.ones(high - low, bool)
        inner[ends[i:j] - low] = False  # words that have a word before them
        at = np.flatnonzero(inner)
        before, here = alpha[at - 1].astype(np.float64), (e[low:high] * beta)[at].astype(np.float64)
        z = ((before @ transfer) * here).sum(1, keepdims=True)
        pairs -= transfer * ((before / z).T @ here)
        np.add.at(pairs, (gold[low:high][at - 1], gold[low:high][at]), 1)
    by_word[np.arange(len(gold)), gold] += 1
    return by_word, pairs


def train(rows: list[tuple[str, list[str]]], seed: int = 5) -> Crf:
    """Maximum likelihood by AdaGrad over labelled texts, in steps of about BATCH words; half of the sequences splice two
    texts. What is held besides the texts is a table of weights and one step's arrays."""
    labels = tuple(sorted({lang for lang, _ in rows}))
    if not labels:
        return Crf((), np.zeros((_ZERO + 1, 0), np.float32), np.zeros((0, 0)))
    number, rng = {x: i for i, x in enumerate(labels)}, np.random.default_rng(seed)
    runs, k = [(number[lang], words) for lang, words in rows if words], len(labels)
    lengths = np.array([len(w) for _, w in runs])
    weights, trans = np.zeros((_ZERO + 1, k), np.float32), np.zeros((k, k))
    sums, trans_sums = np.full_like(weights, 1e-6), np.full_like(trans, 1e-6)
    steps = max(-(-int(lengths.sum()) // BATCH), 1) if runs else 0
    for _ in range(max(EPOCHS, -(-STEPS // steps)) if runs else 0):
        order = rng.permutation(len(runs))
        for i, j in slices(lengths[order], BATCH):
            words, gold, sizes = [], [], []
            for a, b in zip(order[i:j], rng.permutation(order)[: j - i]):
                (y, own), (z, other) = runs[a], runs[b]
                if a % 2 and len(own) > 1:  # splice: the text goes on in another one
                    cut = int(rng.integers(1, len(own)))
                    from_ = int(rng.integers(0, len(other)))
                    tail = other[from_ : from_ + len(own) - cut]
                    own, labels_of = own[:cut] + tail, [y] * cut + [z] * len(tail)
                else:
                    labels_of = [y] * len(own)
                words += own
                gold += labels_of
                sizes.append(len(own))
            _step(weights, sums, trans, trans_sums, words, np.array(gold), np.array(sizes))
    return Crf(labels, weights, trans)


def _step(weights: np.ndarray, sums: np.ndarray, trans: np.ndarray, trans_sums: np.ndarray, words: list[str], gold: np.ndarray, lengths: np.ndarray) -> None:
    """One step of AdaGrad on some sequences, in place."""
    vocabulary: dict[str, int] = {}
    word = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words])
    features, of = word_features(list(vocabulary))
    used, slot = np.unique(features, return_inverse=True)
    k, n = len(trans), len(vocabulary)
    w = weights[used]
    scores = np.stack([np.bincount(of, w[slot, y], n) for y in range(k)], 1)[word]
    by_word, by_pair = gradient(scores, lengths, gold, trans)
    total = np.stack([np.bincount(word, by_word[:, y], n) for y in range(k)], 1)
    g = np.stack([np.bincount(slot, total[of, y], len(used)) for y in range(k)], 1) / len(words) - RIDGE * w
    sums[used] += g * g
    weights[used] = w + RATE * g / np.sqrt(sums[used])
    by_pair = by_pair / len(words) - 1e-3 * trans
    trans_sums += by_pair * by_pair
    trans += RATE * by_pair / np.sqrt(trans_sums)
    np.clip(trans, -6, 6, out=trans)


def calibrate(model: Crf, rows: list[tuple[str, list[str]]], seed: int = 7) -> Crf:
    """``model`` with the least score of a text in one language: half way between held-out texts and mixtures of two of
    them in equal shares, but so that LOSS of the former are lost at most."""
    rng, rows = np.random.default_rng(seed), [(lang, words) for lang, words in rows if words]
    mixed = []
    for lang, words in rows:
        others = [w for x, w in rows if x != lang]
        if others and len(words) > 1:
            half = others[int(rng.integers(len(others)))]
            n = min(len(words), len(half))
            mixed.append(words[:n] + half[:n])
    if not mixed:
        return model
    score = lambda texts: np.sort(model.predict([" ".join(x).encode() for x in texts])[1])
    one, two = score([w for _, w in rows]), score(mixed)
    low, high = float(one[int(LOSS * len(one))]), float(two[len(two) // 2])
    return Crf(model.labels, model.weights, model.transitions, min((low + high) / 2, low))


def fit(docs: DataFrame, learn: DataFrame, text_col: str = "text", key: str = "doc_id", lang_col: str = "lang", docs_per_lang: int = DOCS_PER_LANG) -> Crf:
    """A calibrated model from a bounded sample of ``learn`` (key and language of the rows that may be learned from).

    An id counts once: of several rows with it, the shortest text that has words. The driver gets the sample's words
    (SAMPLE_BYTES at most; of a language whose every text is longer than its share, the shortest text) and a row count of
    each language. Those counts and about twice docs_per_lang keys of each language are broadcast if they are
    under MOST_KEYS, else joined by a shuffle.
    """
    known = learn.where(F.col(lang_col).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(lang_col).alias("_lang"))
    counts = materialize(known.groupBy("_lang").agg(F.count("*").alias("_n")), "languages")
    langs = counts.count()
    if not langs:
        return train([])
    share = max(SAMPLE_BYTES // langs, 1)
    small = F.broadcast if langs * (2 * docs_per_lang + 100) <= MOST_KEYS else (lambda df: df)
    # a hash below a bound of each language leaves about twice the rows that are wanted, whatever the language's size
    spread = F.pmod(F.xxhash64("_key"), F.lit(1 << 30)) * F.col("_n") < F.lit((2 * docs_per_lang + 100) << 30)
    likely = known.join(small(counts), "_lang").where(spread).select("_key", "_lang").distinct()
    rows = docs.select(F.col(key).alias("_key"), F.col(text_col).alias("_text"), F.octet_length(text_col).alias("_size")).where("_size > 0")
    sized = rows.select("_key", "_size").join(small(likely), "_key").groupBy("_key", "_lang").agg(F.min("_size").alias("_size"))
    first = Window.partitionBy("_lang").orderBy(F.greatest("_size", F.lit(share)), F.xxhash64("_key"), "_key")
    ranked = sized.withColumn("_rank", F.row_number().over(first)).withColumn("_sum", F.sum("_size").over(first.rowsBetween(Window.unboundedPreceding, 0)))
    chosen = ranked.where((F.col("_rank") == 1) | ((F.col("_rank") <= docs_per_lang) & (F.col("_sum") <= share))).select("_key", "_lang", "_size")

    def run(batches):
        for batch in batches:
            words = [" ".join(lettered(x)) for x in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words)], names=["key", "lang", "words"])

    texts = rows.join(small(chosen), ["_key", "_size"]).select(F.col("_key").cast("string"), "_lang", "_text").mapInArrow(run, "key string, lang string, words string")
    got = texts.where("words <> ''").groupBy("key", "lang").agg(F.min("words").alias("words")).collect()
    got = [(r["lang"], r["words"].split(" ")) for r in sorted(got, key=lambda r: (zlib.crc32(r["key"].encode()), r["key"], r["lang"], r["words"]))]
    seen: dict[str, int] = {}
    learned, held = [], []
    for lang, words in got:
        seen[lang] = seen.get(lang, 0) + 1
        (held if seen[lang] % HOLD_OUT == 0 else learned).append((lang, words))
    return calibrate(train(learned), held)


def predict(docs: DataFrame, model: Crf, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, in one narrow pass over whole texts."""
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[bytes | None]) -> list:
        names, scores = shared.value.predict(texts)
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    return with_columns(docs, text_col, fields, run)


def keep_known_language(docs: DataFrame, model: Crf, least_score: float | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` without those that have no letters or no language that their words agree on (by the model's calibrated
    score where none is given)."""
    least_score = model.least_score if least_score is None else least_score
    return keep_where(docs, text_col, lambda d: predict(d, model, "_text"), (F.col("lang_pred") != UND) & (F.col("score") >= least_score))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold_of(F.col("doc_id"), 3) == 1, F.lit(True))
    model = fit(docs, docs.where(~held_out))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
