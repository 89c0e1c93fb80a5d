"""Views and summaries of sessions, captures and benchmark runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idloom import dims


def mean_ms(c: Column) -> Column:
    """The rounded mean, halves up; null without rows."""
    return F.floor(F.avg(c) + 0.5).cast("long")


def benchmark_summary(cases: DataFrame) -> DataFrame:
    """One row: false accepts and rejects, the mean quality time (0 without cases), and the accuracy of both OCR runs
    (their mean time is null without runs)."""
    bad, good = F.col("expected") == "reject", F.col("expected") == "accept"
    total = lambda run, f: F.coalesce(F.sum(F.col(run)[f]), F.lit(0)).cast("long")
    ocr = lambda run: F.struct(F.count(run).alias("documents"), F.count_if(F.col(run)["error"]).alias("errors"), total(run, "correct").alias("correct_fields"), total(run, "total").alias("labeled_fields"), mean_ms(F.col(run)["duration_ms"]).alias("mean_ms"))
    return cases.agg(
        F.count("*").alias("total"),
        F.count_if(bad & F.col("passed")).alias("bad_accepted"),
        F.count_if(bad).alias("bad_total"),
        F.count_if(good & ~F.col("passed")).alias("good_rejected"),
        F.count_if(good).alias("good_total"),
        F.coalesce(mean_ms(F.col("quality_ms")), F.lit(0)).alias("mean_quality_ms"),
        ocr("original_ocr").alias("original_ocr"),
        ocr("prepared_ocr").alias("prepared_ocr"),
    )


def field_accuracy(expected: DataFrame, observed: DataFrame, *keys: str) -> DataFrame:
    """(…keys, correct, total): expected field values that were read exactly, after trimming."""
    seen = observed.select(*keys, "field", F.col("value").alias("_seen"))
    both = expected.join(seen, [*keys, "field"], "left")
    return both.groupBy(*keys).agg(F.count_if(F.col("_seen") == F.trim("value")).alias("correct"), F.count("*").alias("total"))


def status_view(sessions: DataFrame) -> DataFrame:
    return sessions.select("session_id", "client_reference", "status", "reason_code", "updated_at")


def public_view(sessions: DataFrame, private: tuple[str, ...] = ("raw_response", "retained_fields", "joined_capture_ids", "object_key", "api_key_digest")) -> DataFrame:
    return sessions.drop(*private)


def result_view(sessions: DataFrame, summary: DataFrame) -> DataFrame:
    """Final sessions with their consistency summary; other sessions have no result yet."""
    return sessions.where(F.col("status").isin(dims.FINAL)).join(summary, "session_id", "left")


def flow(documents: DataFrame, captures: DataFrame, conflicts: DataFrame, *keys: str) -> DataFrame:
    """(…keys, current_kind, next_side, phase, completed). ``documents`` has (…keys, pos, kind, confirmed, status, blocking);
    ``captures`` has (…keys, kind, side); ``conflicts`` has (…keys, blocking)."""
    open_ = documents.where("NOT confirmed").groupBy(*keys).agg(F.min_by(F.struct("kind", "status", "blocking"), "pos").alias("_c"))
    done = documents.groupBy(*keys).agg(F.count_if("confirmed").alias("completed"))
    sides = F.broadcast(documents.sparkSession.createDataFrame([(k, i, s) for k in dims.KINDS for i, s in enumerate(dims.SIDES[k])], "kind string, pos int, side string"))
    now = open_.select(*keys, "_c.*").join(sides, "kind").join(captures.select(*keys, "kind", "side"), [*keys, "kind", "side"], "left_anti")
    next_side = now.groupBy(*keys).agg(F.min_by("side", "pos").alias("next_side"))
    both = done.join(open_, list(keys), "left").join(next_side, list(keys), "left").join(conflicts.select(*keys, F.col("blocking").alias("_cross")), list(keys), "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    phase = (
        F.when(F.col("_c").isNull(), F.when(yes(F.col("_cross")), "consistency").otherwise("complete"))
        .when(F.col("next_side").isNotNull(), "capture")
        .when(F.col("_c.status") == "processing", "processing")
        .when(yes(F.col("_c.blocking")), "consistency")
        .when(F.col("_c.status") == "incomplete", "incomplete")
        .when(F.col("_c.status") == "ready", "review")
        .otherwise("processing")
    )
    return both.select(*keys, F.col("_c.kind").alias("current_kind"), "next_side", phase.alias("phase"), "completed")


def metric_lines(gauges: DataFrame) -> DataFrame:
    """One text line for each gauge."""
    return gauges.select(F.concat_ws(" ", "name", F.col("value").cast("string")).alias("line"))


def flatten_metrics(groups: Column) -> Column:
    """A map of maps of numbers as one map with ``group.metric`` keys, four decimals."""
    from idloom.functions.numeric import round_half_up

    pairs = F.flatten(F.transform(F.map_entries(groups), lambda g: F.transform(F.map_entries(g["value"]), lambda m: F.struct(F.concat_ws(".", g["key"], m["key"]).alias("key"), round_half_up(m["value"], 4).alias("value")))))
    return F.map_from_entries(pairs)


def health(services: DataFrame, *keys: str) -> DataFrame:
    return services.groupBy(*keys).agg(F.bool_and("ready").alias("healthy"))


def object_keys(captures: DataFrame) -> DataFrame:
    """Every stored object of captures: the photo and, if there is one, its derivative."""
    return captures.select("session_id", F.explode(F.array_compact(F.array("object_key", "ocr_object_key"))).alias("object_key"))
