"""The quality model is fitted on every labelled row, in the driver or by Spark alike."""

import numpy as np
from pyspark.sql import functions as F

from idloom.llm import quality
from tests.llm.common import frame
from tests.llm.test_models import labelled


def test_no_labelled_row_is_left_out(spark, monkeypatch):
    """Beyond the rows that the driver takes, each row still meets a tree or the threshold."""
    rows, labels = labelled(600)
    seen, tested = [], []
    monkeypatch.setattr(quality, "grow_spread", lambda rows, good: seen.extend(r["_key"] for r in rows.collect()))
    monkeypatch.setattr(quality, "calibrate_spread", lambda forest, rows: tested.extend(r["_key"] for r in rows.collect()))
    quality.fit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), driver_rows=10)
    want = {i for i, q, _ in labels}
    assert len(seen) + len(tested) == len(set(seen) | set(tested))
    assert want - {*seen, *tested} == {i for i, q, _ in labels if q == 0 and i not in tested}  # trees grow on good rows


def test_trees_take_every_row():
    """A row that is like no other must show in the forest, wherever it lies among many."""
    x = np.zeros((40_000, len(quality.FEATURES)), np.float32)
    x[:, 0] = np.random.default_rng(0).permutation(len(x))
    taken, tree = [], quality._tree
    quality._tree = lambda part, margins, rng: taken.append(part[:, 0].copy()) or tree(part[:2], margins, rng)
    try:
        quality.grow(x)
    finally:
        quality._tree = tree
    assert len(np.unique(np.concatenate(taken))) == len(x)


def test_spread_fit_judges_like_the_drivers(spark):
    rows, labels = labelled(600)
    docs, table = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    forest = quality.fit(docs, table, driver_rows=10)
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs, forest).collect()}
    assert np.mean([not kept[i] for i in range(0, 600, 30)]) > 0.9
    assert np.mean([kept[i] for i in range(0, 600, 3) if i % 10]) > 0.98


def test_spread_threshold_is_the_drivers(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(700, len(quality.FEATURES))), 1).astype(np.float32)
    good = rng.random(700) < 0.8
    x[~good] *= 4
    x[20:60] = x[0]  # equal scores
    forest = quality.grow(x[good])
    spread = spark.createDataFrame([(v.tolist(), int(g)) for v, g in zip(x, good, strict=True)], "x array<float>, _good int").repartition(5)
    for loss in (0.004, 0.2):
        assert quality.calibrate_spread(forest, spread, loss).threshold == quality.calibrate(forest, x, good, loss).threshold < 2
    assert quality.calibrate_spread(forest, spread.where("_good = 1")).threshold == 2.0
    assert quality.calibrate_spread(forest, spread.where(F.lit(False))).threshold == 2.0
