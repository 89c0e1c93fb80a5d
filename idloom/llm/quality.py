"""Quality rules (operator 4): an isolation forest on rule statistics, its threshold calibrated from labelled rows.

Every document gets rule statistics in one narrow pass. A forest of random split trees is grown on all rows labelled
good: each row is dealt to one tree at least, and to more while a tree would have fewer than TREE_ROWS. Documents that
random splits isolate early (short mean path) are anomalous. The threshold on the anomaly score comes from the labelled
rows that the trees haven't seen (a third of all, by the key's crc32). Up to DRIVER_ROWS labelled rows are fitted in the
driver; more of them are never collected: Spark deals them to the trees, and finds the threshold by running counts.

Defined cases: a null or empty text, or one of white space only, has zero words and fails the base rule; ties and
repeated rows are judged alike, each by its own text; texts of any length are measured whole; a null id is returned
as it came; without usable labels the forest has no threshold and only the base rule rejects; an empty table gives an
empty result. Input columns that have the name of a result column are replaced.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idloom.llm.common import WordHashes, fold_of, gram_hashes, keep_where, materialize, table, with_columns

#: Up to so many labelled rows are fitted in the driver; beyond, by Spark. All are used either way.
DRIVER_ROWS = 12_000
TREES, TREE_ROWS, DEPTH, SEED = 128, 256, 12, 11
#: Share of labelled good rows that the calibrated threshold may reject at most.
MAX_GOOD_LOSS = 0.004

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rule statistics by character, line or word; the last is log distinct words / log words, which changes little with
#: a text's length.
FEATURES = ("mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "distinct_log_share")
_WS, _SYMBOL, _UPPER, _MARK = (np.zeros(256, bool) for _ in range(4))
_WS[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[list(range(0x41, 0x5B))] = True
_MARK[list(b"!?")] = True


def _repeat_words(hashes: np.ndarray) -> int:
    """Words that lie in a 3-word window found twice or more in the same text."""
    grams = gram_hashes(hashes, 3)
    ordered = np.sort(grams)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(grams, twice)
    covered = np.zeros(len(hashes), bool)
    for j in range(3):
        covered[j : j + len(grams)] |= hit
    return int(covered.sum())


def statistics(texts: list[bytes | None], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(counts n x 5, features n x 7) of some texts."""
    counts, features = np.zeros((len(texts), 5), np.int64), np.zeros((len(texts), len(FEATURES)), np.float32)
    for i, text in enumerate(texts):
        words = (text or b"").split()
        if not words:
            continue
        n, data = len(words), np.frombuffer(text, np.uint8)
        chars = int(((data & 0xC0) != 0x80).sum()) - int(_WS[data].sum())
        of_words = hashes.of(words)
        seen: set[bytes] = set()
        lines = [x for x in text.split(b"\n") if x.strip()]
        dups = sum(1 for x in lines if x in seen or seen.add(x))
        symbols, repeats = int(_SYMBOL[data].sum()), _repeat_words(of_words)
        counts[i] = n, chars, symbols, dups, repeats
        distinct = np.log(len(set(words))) / np.log(n) if n > 1 else 1.0
        features[i] = chars / n, symbols / chars, dups / len(lines), repeats / n, _UPPER[data].sum() / chars, _MARK[data].sum() / chars, distinct
    return counts, features


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: node j splits feature[t, j] at cut[t, j]; children 2j+1 and 2j+2; depth[t, j] at leaves, else < 0."""

    feature: np.ndarray
    cut: np.ndarray
    depth: np.ndarray
    scale: float
    threshold: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1] of each row; near 1 is anomalous."""
        rows, total = np.arange(len(x)), np.zeros(len(x))
        for feature, cut, depth in zip(self.feature, self.cut, self.depth, strict=True):
            at = np.zeros(len(x), np.int32)
            for _ in range(DEPTH):
                inner = depth[at] < 0
                if not inner.any():
                    break
                right = x[rows, feature[at]] >= cut[at]
                at = np.where(inner, 2 * at + 1 + right, at)
            total += depth[at]
        return np.exp2(-total / (len(self.depth) * self.scale))


def _mean_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a random tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _tree(x: np.ndarray, margins: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, cut, depth) of one tree over all of ``x``."""
    size = 2 ** (DEPTH + 1) - 1
    feature, cut, depth = np.zeros(size, np.int16), np.zeros(size, np.float32), np.full(size, -1.0, np.float32)
    todo = [(0, 0, x)]
    while todo:
        at, level, part = todo.pop()
        low, high = part.min(0), part.max(0)
        if level == DEPTH or len(part) < 2 or not (high > low).any():
            depth[at] = level + _mean_path(len(part))
            continue
        # A split feature may be one that is constant here: a row beyond its value is then cut off at once.
        f = int(rng.integers(x.shape[1]))
        margin = max((high[f] - low[f]) * 0.5, margins[f])
        c = np.float32(rng.uniform(low[f] - margin, high[f] + margin))
        right = part[:, f] >= c
        feature[at], cut[at] = f, c
        for child, rest in ((2 * at + 1, part[~right]), (2 * at + 2, part[right])):
            if len(rest):
                todo.append((child, level + 1, rest))
            else:  # an empty side: whatever falls there is isolated
                depth[child] = level + 1
    return feature, cut, depth


def _margins(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How far beyond a node's values its cut may lie at least, from the least and greatest values of all rows."""
    return np.maximum(0.02 * (high - low), 1e-3)


def _forest(trees: list, rows: float) -> Forest:
    return Forest(*(np.stack(part) for part in zip(*trees, strict=True)), _mean_path(round(rows)) or 1.0, 2.0)


def grow(x: np.ndarray, seed: int = SEED) -> Forest:
    """A forest on all of ``x``: its rows, in random order and again from the start, are cut into the trees' rows."""
    rng = np.random.default_rng(seed)
    rows = max(min(TREE_ROWS, len(x)), -(-len(x) // TREES))
    order = np.concatenate([rng.permutation(len(x)) for _ in range(-(-TREES * rows // len(x)))])
    margins = _margins(x.min(0), x.max(0))
    return _forest([_tree(x[order[t * rows : (t + 1) * rows]], margins, rng) for t in range(TREES)], rows)


def grow_spread(rows: DataFrame, good: int, seed: int = SEED) -> Forest:
    """:func:`grow` for ``good`` rows (_key, x) that stay in Spark: a tree is grown where its rows meet, a TREES-th of
    all at a time (28 bytes a row)."""
    copies = min(TREES, max(1, -(-TREES * TREE_ROWS // good)))
    at = lambda f: F.array(*[f(F.col("x")[i]) for i in range(len(FEATURES))])
    low, high = (np.array(v, np.float32) for v in rows.agg(at(F.min), at(F.max)).first())
    margins = _margins(low, high)
    first = F.pmod(F.xxhash64("_key"), F.lit(TREES))
    dealt = rows.select("x", F.explode(F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda j: F.pmod(first + j * (TREES // copies), F.lit(TREES)).cast("int"))).alias("tree"))

    def one(key: tuple, part: pa.Table) -> pa.Table:
        t = key[0].as_py()
        x = part["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
        feature, cut, depth = _tree(x[np.lexsort(x.T)], margins, np.random.default_rng([seed, t]))
        return pa.table({"tree": pa.array([t], pa.int32()), "feature": [feature.tobytes()], "cut": [cut.tobytes()], "depth": [depth.tobytes()]})

    got = dealt.groupBy("tree").applyInArrow(one, "tree int, feature binary, cut binary, depth binary").collect()
    trees = [tuple(np.frombuffer(r[c], k) for c, k in (("feature", np.int16), ("cut", np.float32), ("depth", np.float32))) for r in sorted(got, key=lambda r: r["tree"])]
    return _forest(trees, good * copies / TREES)


def calibrate(forest: Forest, x: np.ndarray, good: np.ndarray, max_good_loss: float = MAX_GOOD_LOSS) -> Forest:
    """The threshold with the best (bad caught - good lost), among those that lose at most ``max_good_loss`` of the good;
    it lies half way between neighbouring scores."""
    if good.all() or not good.any():
        return forest
    scores = forest.scores(x)
    best, threshold = 0.0, 2.0
    good_scores, bad_scores = np.sort(scores[good]), np.sort(scores[~good])
    found = np.unique(scores)
    for below, c in zip(np.append(found[:1], found), found, strict=False):
        lost = 1 - np.searchsorted(good_scores, c, "left") / len(good_scores)
        caught = 1 - np.searchsorted(bad_scores, c, "left") / len(bad_scores)
        if lost <= max_good_loss and caught - lost > best:
            best, threshold = caught - lost, float(below + c) / 2
    return Forest(forest.feature, forest.cut, forest.depth, forest.scale, threshold)


def calibrate_spread(forest: Forest, rows: DataFrame, max_good_loss: float = MAX_GOOD_LOSS) -> Forest:
    """:func:`calibrate` for rows (x, _good) that stay in Spark: each part of the scores' order counts its own rows, and
    only the parts' sums meet in the driver."""

    def score(batches):
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(-1, len(FEATURES)) if b.num_rows else np.empty((0, len(FEATURES)), np.float32)
            good = b.column("_good").to_numpy() == 1
            yield pa.RecordBatch.from_arrays([pa.array(forest.scores(x)), pa.array(good.astype(np.int64)), pa.array((~good).astype(np.int64))], names=["score", "good", "bad"])

    counts = rows.select("x", "_good").mapInArrow(score, "score double, good long, bad long").groupBy("score").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    counts = materialize(counts.repartitionByRange("score").withColumn("part", F.spark_partition_id()), "scores")
    parts = sorted(counts.groupBy("part").agg(F.min("score"), F.max("score"), F.sum("good"), F.sum("bad")).collect(), key=lambda r: r[1])
    goods, bads = sum(r[3] for r in parts), sum(r[4] for r in parts)
    if not goods or not bads:
        return forest
    before, good, bad, last = [], 0, 0, None
    for r in parts:
        before.append((r["part"], good, bad, last))
        good, bad, last = good + r[3], bad + r[4], r[2]
    before = counts.sparkSession.createDataFrame(before, "part int, good0 long, bad0 long, last double")
    w = Window.partitionBy("part").orderBy("score")
    under = lambda c: F.sum(c).over(w) - F.col(c)
    runs = counts.select("part", "score", under("good").alias("g"), under("bad").alias("b"), F.lag("score").over(w).alias("below")).join(F.broadcast(before), "part")
    lost, caught = 1 - (F.col("g") + F.col("good0")) / F.lit(goods), 1 - (F.col("b") + F.col("bad0")) / F.lit(bads)
    gain = (caught - lost).alias("gain")
    found = runs.where(lost <= max_good_loss).select(gain, "score", F.coalesce("below", "last", "score").alias("below"))
    best = found.agg(F.max(F.struct("gain", -F.col("score"), "below"))).first()[0]
    threshold = float(best["below"] - best[1]) / 2 if best is not None and best["gain"] > 0 else 2.0
    return Forest(forest.feature, forest.cut, forest.depth, forest.scale, threshold)


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", key: str = "doc_id", driver_rows: int = DRIVER_ROWS) -> Forest | None:
    """A calibrated forest from all labelled rows, or None without any.

    The trees grow on two thirds of the rows and the threshold is calibrated on the last third (on the same rows if one
    part lacks good or bad ones). Of several rows with one key, that with the fewest words counts. Documents are measured
    where they lie; only their 8 numbers are shuffled to the labels.
    """
    marked = labels.where(F.col("quality").isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max("quality").alias("_good"))
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(text_col).alias("_text"))

    def measure(texts: list[bytes | None]) -> list:
        counts, features = statistics(texts, WordHashes())
        return [pa.array(counts[:, 0]), pa.array(list(features), pa.list_(pa.float32()))]

    new = [T.StructField("n", T.LongType()), T.StructField("x", T.ArrayType(T.FloatType()))]
    measured = with_columns(rows, "_text", new, measure).groupBy("_key").agg(F.min(F.struct("n", "x")).alias("_m"))
    got = materialize(measured.join(marked, "_key").select("_key", "_good", "_m.n", "_m.x").where("n >= 50"), "labelled")
    total = got.count()
    if total > driver_rows:
        return _fit_spread(got.withColumn("_last", fold_of(F.col("_key"), 3) == 0))
    got = sorted(got.collect(), key=lambda r: (r["_key"], r["n"]))
    x, good = np.array([r["x"] for r in got], np.float32).reshape(-1, len(FEATURES)), np.array([r["_good"] == 1 for r in got], bool)
    last = np.array([zlib.crc32(str(r["_key"]).encode()) % 3 == 0 for r in got], bool)
    apart = (good & ~last).any() and (good & last).any() and (~good & last).any()
    grown, tested = (good & ~last, last) if apart else (good, np.ones(len(got), bool))
    return calibrate(grow(x[grown]), x[tested], good[tested]) if good.any() else None


def _fit_spread(rows: DataFrame) -> Forest | None:
    good, last = F.col("_good") == 1, F.col("_last")
    n = rows.agg(F.count_if(good).alias("good"), F.count_if(good & ~last).alias("first"), F.count_if(good & last).alias("last"), F.count_if(~good & last).alias("bad")).first()
    if not n["good"]:
        return None
    apart = n["first"] > 0 and n["last"] > 0 and n["bad"] > 0
    forest = grow_spread(rows.where(good & ~last if apart else good), n["first"] if apart else n["good"])
    return calibrate_spread(forest, rows.where(last) if apart else rows)


def judge(docs: DataFrame, forest: Forest | None, text_col: str = "text") -> DataFrame:
    """``docs`` with the five counts, ``base_failed``, ``anomaly`` (null without a forest) and ``kept``."""
    fields = [T.StructField(c, T.LongType()) for c in STATS] + [T.StructField("base_failed", T.BooleanType()), T.StructField("anomaly", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    hashes = WordHashes()

    def run(texts: list[bytes | None]) -> list:
        counts, features = statistics(texts, hashes)
        failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
        score = forest.scores(features) if forest else np.full(len(texts), np.nan)
        kept = ~failed & ~(score >= forest.threshold if forest else np.zeros(len(texts), bool))
        return [*(pa.array(counts[:, j]) for j in range(5)), pa.array(failed), pa.array(score, from_pandas=True), pa.array(kept)]

    return with_columns(docs, text_col, fields, run)


def keep_good(docs: DataFrame, forest: Forest | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns only."""
    return keep_where(docs, text_col, lambda d: judge(d, forest, "_text"), F.col("kept"))


def op4_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", *STATS, "base_failed", "kept", "anomaly")
