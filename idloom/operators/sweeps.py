"""Operational queries and writes over versioned rows: sweeps, retention, idempotent inserts, latest versions.

Nothing reads a clock: ``as_of`` is a parameter. Writes are expressed as the table that results.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idloom import dims


def at(as_of: datetime | str | Column) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def is_final(status: Column) -> Column:
    return status.isin(dims.FINAL)


def by_value(rows: DataFrame, column: str, value) -> DataFrame:
    """Point lookup by an id or a token; no row for null."""
    return rows.where(F.col(column) == F.lit(value))


def newest_first(rows: DataFrame, ts: str, key: str) -> DataFrame:
    return rows.orderBy(F.col(ts).desc_nulls_last(), F.col(key).asc_nulls_last())


def expired(sessions: DataFrame, as_of, limit: int = dims.SWEEP_ROWS) -> DataFrame:
    """Sessions that must be expired or whose expiry hasn't been announced, the longest untouched first."""
    unannounced = (F.col("status") == "expired") & F.col("webhook_queued_at").isNull()
    due = ~is_final(F.col("status")) & (F.col("expires_at") <= at(as_of))
    return sessions.where(unannounced | due).orderBy(F.col("updated_at").asc_nulls_last(), F.col("session_id").asc_nulls_last()).limit(limit)


def expire(sessions: DataFrame, as_of) -> DataFrame:
    """``sessions`` after the expiry rule: a session that is neither final nor processing expires at its deadline, which
    also touches it."""
    now = at(as_of)
    due = ~is_final(F.col("status")) & (F.col("status") != "processing") & (F.col("expires_at") <= now)
    changes = {"status": F.lit("expired"), "reason_code": F.lit("session_expired"), "updated_at": now, "expires_at": now + F.expr(f"INTERVAL {dims.MINUTES_IDLE} MINUTES"), "version": F.col("version") + 1}
    return sessions.withColumns({c: F.when(due, v).otherwise(F.col(c)) for c, v in changes.items()})


def pending(sessions: DataFrame, work: DataFrame, limit: int = dims.SWEEP_ROWS) -> DataFrame:
    """Sessions with undelivered results or unfinished work, the longest untouched first. ``work`` has (session_id,
    state) of documents and side results."""
    open_ = work.where(F.col("state") != "ready").select("session_id").distinct().withColumn("_open", F.lit(True))
    undelivered = is_final(F.col("status")) & F.col("webhook_delivered_at").isNull()
    hits = sessions.join(open_, "session_id", "left").where(undelivered | F.col("_open")).drop("_open")
    return hits.orderBy(F.col("updated_at").asc_nulls_last(), F.col("session_id").asc_nulls_last()).limit(limit)


def older_than(rows: DataFrame, cutoff, ts: str = "created_at") -> DataFrame:
    return rows.where(F.col(ts) < at(cutoff)).orderBy(F.col(ts).asc_nulls_last())


def purged(rows: DataFrame, cutoff, ts: str = "created_at") -> DataFrame:
    """What a purge leaves: rows without a time stay."""
    return rows.where((F.col(ts) >= at(cutoff)) | F.col(ts).isNull())


def insert_once(existing: DataFrame | None, incoming: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``existing`` and the first incoming row of each key that it lacks."""
    first = Window.partitionBy(*key).orderBy(*order)
    fresh = incoming.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return fresh if existing is None else existing.unionByName(fresh.join(existing.select(*key), key, "left_anti"))


def latest(rows: DataFrame, key: list[str], version: str, arrival: str) -> DataFrame:
    """The row with the highest version of each key; of equal versions the one that came last."""
    best = Window.partitionBy(*key).orderBy(F.col(version).desc_nulls_last(), F.col(arrival).desc_nulls_last())
    return rows.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def compare_and_set(current: DataFrame, updates: DataFrame, key: str, expected: str = "expected_version") -> DataFrame:
    """``current`` after updates that name the version they expect: inserted where the key is new (expected null),
    replaced where the version is as expected, else unchanged. One update for each key."""
    names = [c for c in current.columns if c != key]
    new = updates.select(key, F.col(expected).alias("_expected"), F.lit(True).alias("_new"), *[F.col(c).alias(f"_u_{c}") for c in names])
    both = current.withColumn("_old", F.lit(True)).join(new, key, "full_outer")
    take = F.when(F.col("_old").isNull(), F.col("_expected").isNull()).otherwise(F.col("_new") & (F.col("version") == F.col("_expected")))
    take = F.coalesce(take, F.lit(False))
    return both.where(F.coalesce("_old", F.lit(False)) | take).select(key, *[F.when(take, F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c) for c in names])


def still_current(results: DataFrame, captures: DataFrame, *keys: str) -> DataFrame:
    """Results whose capture id and processing token are still those of the side."""
    return results.join(captures.select(*keys, "capture_id", "token"), [*keys, "capture_id", "token"], "left_semi")


def claimable(sides: DataFrame, now_ms: Column | int) -> DataFrame:
    """Sides that a worker may take: pending, or processing with a lease that has run out."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    return sides.where((F.col("state") == "pending") | ((F.col("state") == "processing") & (F.col("leased_at_ms") + dims.LEASE_MS <= now)))


def outbox(sessions: DataFrame) -> DataFrame:
    """One id-only row for each final session that is not yet queued, with its de-duplication key and JSON body."""
    body = F.to_json(F.struct("session_id", "client_reference", "status"))
    return sessions.where(is_final(F.col("status")) & F.col("webhook_queued_at").isNull()).select("session_id", F.concat(F.lit("webhook:"), F.col("session_id").cast("string")).alias("singleton_key"), body.alias("body"))


def completed_payload() -> Column:
    """The exact body that announces a final session: ids and status only, nulls written out."""
    fields = {"event": F.lit("onboarding.completed"), "sessionId": F.col("session_id"), "status": F.col("status"), "reasonCode": F.col("reason_code"), "completedAt": F.col("completed_at")}
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})


def retry_schedule(sent: DataFrame, ts_ms: str, tries: int, delay_ms: int, backoff: bool) -> DataFrame:
    """``sent`` with one row for each try: ``attempt`` from 1 and the earliest time of it, after a fixed delay each or
    one that doubles."""
    n = F.col("attempt") - 1
    waited = ((F.pow(F.lit(2), n) - 1) if backoff else n) * delay_ms
    rows = sent.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(tries))))
    return rows.withColumn("not_before_ms", F.col(ts_ms) + waited.cast("long"))


def not_joined_yet(assembled: DataFrame, joined: DataFrame, *keys: str) -> DataFrame:
    """Assembled documents whose set of captures hasn't been joined before. Both have (…keys, kind, capture_ids)."""
    return assembled.join(joined.select(*keys, "kind", "capture_ids").distinct(), [*keys, "kind", "capture_ids"], "left_anti")


def deliver(sessions: DataFrame, receipts: DataFrame) -> DataFrame:
    """``sessions`` with the first receipt as delivery time and the version raised; delivered ones stay as they are."""
    first = receipts.groupBy("session_id").agg(F.min("at").alias("_at"))
    now = F.col("webhook_delivered_at").isNull() & F.col("_at").isNotNull()
    return sessions.join(first, "session_id", "left").withColumns({"version": F.col("version") + now.cast("int"), "webhook_delivered_at": F.coalesce("webhook_delivered_at", "_at")}).drop("_at")
