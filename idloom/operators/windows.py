"""Ordered computations over event streams at rest: streaks, holds, debounce, last-N buffers, inactivity sessions.

Every window is partitioned by the caller's keys; ``order`` must be a total order within them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idloom.dims import MAX_ATTEMPTS, MINUTES_IDLE


def _w(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def _micros(ts: Column) -> Column:
    """Microseconds of a timestamp with or without a zone."""
    return F.unix_micros(ts.cast("timestamp"))


def pass_streak(rows: DataFrame, keys: list[str], order: list[str], passed: str) -> DataFrame:
    """``rows`` with ``streak``: passes in a row up to here, 0 at a failure."""
    w = _w(keys, order)
    island = F.sum(F.when(F.col(passed), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_island", island)
    place = F.row_number().over(_w([*keys, "_island"], order)) - F.when(F.col("_island") > 0, 1).otherwise(0)
    return rows.withColumn("streak", F.when(F.col(passed), place).otherwise(0).cast("long"))


def stable_hold(rows: DataFrame, keys: list[str], order: list[str], ts: str, passed: str, frames: int = 4, seconds: int = 5) -> DataFrame:
    """``rows`` with ``streak`` and ``fire``: the first row of a streak at which it has lasted long enough in both frames
    and seconds."""
    rows = pass_streak(rows, keys, order, passed)
    since = F.min(F.when(F.col(passed), F.col(ts))).over(_w([*keys, "_island"], order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_ready", F.coalesce(F.col(passed) & (F.col("streak") >= frames) & (_micros(F.col(ts)) - _micros(since) >= seconds * 1_000_000), F.lit(False)))
    before = F.coalesce(F.max("_ready").over(_w([*keys, "_island"], order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    return rows.withColumn("fire", F.col("_ready") & ~before).drop("_island", "_ready")


def failure_cutoff(rows: DataFrame, keys: list[str], order: list[str], failed: str, limit: int = 3) -> DataFrame:
    """``rows`` with ``disabled``: whether ``limit`` failures in a row have happened by now."""
    rows = pass_streak(rows.withColumn("_bad", F.col(failed)), keys, order, "_bad")
    return rows.withColumn("disabled", F.max(F.col("streak") >= limit).over(_w(keys, order))).drop("_island", "_bad", "streak")


def debounced_hint(rows: DataFrame, keys: list[str], order: list[str], hint: str) -> DataFrame:
    """``rows`` with ``shown``: the last hint that was repeated at once, or ``ready`` as soon as it appears."""
    w = _w(keys, order)
    settled = F.when((F.col(hint) == "ready") | (F.col(hint) == F.lag(hint).over(w)), F.col(hint))
    return rows.withColumn("_settled", settled).withColumn("shown", F.last("_settled", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_settled")


def corner_motion(rows: DataFrame, keys: list[str], order: list[str], quad: str = "quad", width: str = "width", height: str = "height") -> DataFrame:
    """``rows`` with ``corner_motion``: mean corner displacement from the frame before, as a share of the diagonal; null
    at the first frame and after a change of size."""
    w = _w(keys, order)
    before = F.lag(quad).over(w)
    same = (F.lag(width).over(w) == F.col(width)) & (F.lag(height).over(w) == F.col(height))
    moved = F.aggregate(F.zip_with(quad, before, lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"])), F.lit(0.0), lambda acc, v: acc + v) / F.size(quad)
    return rows.withColumn("corner_motion", F.when(same & before.isNotNull(), moved / F.hypot(F.col(width), F.col(height))))


def last_n(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key by ``order`` (give it newest first)."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def inactivity_sessions(events: DataFrame, keys: list[str], order: list[str], ts: str, minutes: int = MINUTES_IDLE) -> DataFrame:
    """``events`` with ``session_no`` from 0: a gap of ``minutes`` or more starts a new session."""
    w = _w(keys, order)
    gap = _micros(F.col(ts)) - _micros(F.lag(ts).over(w)) >= minutes * 60_000_000
    return events.withColumn("_new", F.coalesce(gap.cast("int"), F.lit(0))).withColumn("session_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def attempts(rows: DataFrame, keys: list[str], order: list[str], limit: int = MAX_ATTEMPTS) -> DataFrame:
    """``rows`` with ``attempt`` from 1 and ``allowed``: whether it is within the limit."""
    return rows.withColumn("attempt", F.row_number().over(_w(keys, order)).cast("long")).withColumn("allowed", F.col("attempt") <= limit)


def first_open(rows: DataFrame, keys: list[str], pos: str, done: str, value: str) -> DataFrame:
    """(…keys, current): the value of the first position that isn't done; null if all are."""
    return rows.groupBy(*keys).agg(F.min_by(F.when(~F.col(done), F.col(value)), F.when(~F.col(done), F.col(pos))).alias("current"))


def gap_sessions(events: DataFrame, keys: list[str], order: list[str], ts: str, gap_ms: Column) -> DataFrame:
    """``events`` with ``session_no`` from 0, where each event keeps its session open for its own ``gap_ms``: a session ends
    when the time that any of its events allows has passed."""
    w = _w(keys, order)
    until = F.max(_micros(F.col(ts)) + gap_ms * 1000).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((_micros(F.col(ts)) >= until).cast("int"), F.lit(0))
    return events.withColumn("_new", fresh).withColumn("session_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def session_windows(events: DataFrame, keys: list[str], ts: str, gap_ms: Column, late: str | None = None) -> DataFrame:
    """(…keys, started, last, until, events): the same sessions as windows with a gap of each row's own, over rows at rest or, with ``late``, over
    a stream (append mode: a session comes out once, when the watermark has passed its end). Rows without a time are left out.

    A window of Spark's takes in an event at its very end; the rule doesn't, so gaps are a microsecond shorter inside."""
    rows = events.where(F.col(ts).isNotNull())
    rows = rows.withWatermark(ts, late) if late else rows
    gap = F.concat((gap_ms.cast("long") * 1000 - 1).cast("string"), F.lit(" microseconds"))
    grouped = rows.groupBy(*keys, F.session_window(F.col(ts), gap).alias("_w"))
    found = grouped.agg(F.min(ts).alias("started"), F.max(ts).alias("last"), F.count("*").alias("events"))
    return found.select(*keys, "started", "last", F.timestamp_micros(_micros(F.col("_w.end")) + 1).alias("until"), "events")
