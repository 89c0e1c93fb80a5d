"""Check rows and what is reported about them. A check row has (…keys, check_id, field, outcome)."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idloom.dims import NOT_COVERAGE, ONBOARDING


def status_of(failed: Column, warned: Column) -> Column:
    return F.when(failed > 0, "failed").when(warned > 0, "warning").otherwise("passed")


def report(checks: DataFrame, *keys: str) -> DataFrame:
    """Counts of each outcome, sorted distinct failed and warned fields, and the report's status."""
    n = lambda outcome: F.count_if(F.col("outcome") == outcome)
    fields = lambda outcome: F.array_sort(F.collect_set(F.when(F.col("outcome") == outcome, F.col("field"))))
    out = checks.groupBy(*keys).agg(n("passed").alias("passed"), n("warning").alias("warned"), n("failed").alias("failed"), n("not_checked").alias("not_checked"), fields("failed").alias("failed_fields"), fields("warning").alias("warned_fields"))
    return out.withColumn("status", status_of(F.col("failed"), F.col("warned")))


def _outcomes(lists: DataFrame) -> dict[tuple[str, str], Column]:
    """(check_id, field) of the columns ``check_id|field`` that hold outcomes."""
    return {tuple(c.split("|")): F.col(f"`{c}`") for c in lists.columns if "|" in c}


def _is(outcome: str) -> Callable[[Column], Column]:
    return lambda o: F.coalesce(o == outcome, F.lit(False))


def _number(outcomes: Iterable[Column], which: Callable[[Column], Column]) -> Column:
    return reduce(lambda x, y: x + y, [which(o).cast("long") for o in outcomes], F.lit(0).cast("long"))


def _any(outcomes: Iterable[Column], which: Callable[[Column], Column]) -> Column:
    return reduce(lambda x, y: x | y, map(which, outcomes), F.lit(False))


def report_of_lists(lists: DataFrame, *keys: str) -> DataFrame:
    """:func:`report` of rows (…keys, columns ``check_id|field``) that hold the outcomes of each key's checks."""
    found = _outcomes(lists)
    n = lambda outcome: _number(found.values(), _is(outcome))
    of = lambda field: [o for (_, f), o in found.items() if f == field]
    fields = lambda outcome: F.array_compact(F.array(*[F.when(_any(of(f), _is(outcome)), F.lit(f)) for f in sorted({f for _, f in found})]))
    out = lists.select(*keys, n("passed").alias("passed"), n("warning").alias("warned"), n("failed").alias("failed"), n("not_checked").alias("not_checked"), fields("failed").alias("failed_fields"), fields("warning").alias("warned_fields"))
    return out.withColumn("status", status_of(F.col("failed"), F.col("warned")))


def summary(checks: DataFrame, *keys: str) -> DataFrame:
    """Whether anything blocks, and how many warnings and unchecked comparisons there are."""
    return checks.groupBy(*keys).agg(F.coalesce(F.bool_or(F.col("outcome") == "failed"), F.lit(False)).alias("blocking"), F.count_if(F.col("outcome") == "warning").alias("warnings"), F.count_if(F.col("outcome") == "not_checked").alias("not_checked"))


def coverage(checks: DataFrame, *keys: str) -> DataFrame:
    """How many of the comparable checks ran; repairs and known incomparable checks don't count."""
    counted = checks.where(~F.col("check_id").startswith("cross.repair.") & ~F.col("check_id").isin(NOT_COVERAGE))
    out = counted.groupBy(*keys).agg(F.count_if(F.col("outcome") != "not_checked").alias("checked"), F.count("*").alias("total"), F.count_if(F.col("outcome") == "not_checked").alias("not_checked"))
    return out.withColumn("complete", F.col("not_checked") == 0)


def coverage_of_lists(lists: DataFrame, *keys: str) -> DataFrame:
    """:func:`coverage` of rows (…keys, columns ``check_id|field``); a key without a check that counts gives no row."""
    counted = {c: o for c, o in _outcomes(lists).items() if not c[0].startswith("cross.repair.") and c[0] not in NOT_COVERAGE}
    there = lambda o: o.isNotNull()
    # Spark evaluates a filter's comparisons apart, so there is none where one of the checks always gives a row
    optional = all(lists.schema["|".join(c)].nullable for c in counted)
    rows = lists.where(_any(counted.values(), there)) if optional else lists
    out = rows.select(*keys, _number(counted.values(), _is("not_checked")).alias("not_checked"), _number(counted.values(), there).alias("total"))
    open_, total = F.col("not_checked"), F.col("total")
    return out.select(*keys, (total - open_).alias("checked"), "total", "not_checked", (open_ == 0).alias("complete"))


def coverage_warnings(checks: DataFrame, *keys: str) -> DataFrame:
    """A warning row for each key whose coverage is incomplete (outside onboarding)."""
    open_ = coverage(checks, *keys).where("not_checked > 0")
    return open_.select(*keys, F.lit("cross.coverage").alias("check_id"), F.lit(None).cast("string").alias("field"), F.lit("warning").alias("outcome"))


def onboarding_scope(checks: DataFrame) -> DataFrame:
    return checks.where(F.col("field").isin(ONBOARDING))


def summary_with_status(checks: DataFrame, *keys: str) -> DataFrame:
    """:func:`summary` and :func:`identity_status` by one aggregation."""
    failed, passed = F.bool_or(F.col("outcome") == "failed"), F.bool_and(F.col("outcome") == "passed")
    n = lambda outcome: F.count_if(F.col("outcome") == outcome)
    status = F.when(failed, "mismatched").when(passed, "matched").otherwise("unknown")
    return checks.groupBy(*keys).agg(F.coalesce(failed, F.lit(False)).alias("blocking"), n("warning").alias("warnings"), n("not_checked").alias("not_checked"), status.alias("identity_status"))


def summary_with_status_of_lists(lists: DataFrame, *keys: str) -> DataFrame:
    """:func:`summary_with_status` of rows (…keys, columns ``check_id|field``)."""
    found = _outcomes(lists).values()
    n = lambda outcome: _number(found, _is(outcome))
    failed = _any(found, _is("failed"))
    some, others = _any(found, lambda o: o.isNotNull()), _any(found, lambda o: F.coalesce(o != "passed", F.lit(False)))
    status = F.when(failed, "mismatched").when(some & ~others, "matched").otherwise("unknown")
    return lists.select(*keys, failed.alias("blocking"), n("warning").alias("warnings"), n("not_checked").alias("not_checked"), status.alias("identity_status"))


def identity_status(checks: DataFrame, *keys: str) -> DataFrame:
    """mismatched if any check failed, matched if there are checks and all passed, else unknown."""
    failed, passed = F.bool_or(F.col("outcome") == "failed"), F.bool_and(F.col("outcome") == "passed")
    return checks.groupBy(*keys).agg(F.when(failed, "mismatched").when(passed, "matched").otherwise("unknown").alias("identity_status"))
