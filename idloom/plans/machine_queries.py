"""Queries of the keyed state machines (a queue's tries, leases) and of sessions with gaps of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.operators import machines, windows
from idloom.plans.common import table


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors become reading jobs and purchases deliveries. A job fails as often as its id says and then succeeds, or is
    never answered; each is sent again while it runs, once under its own id and once under another."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "event_type").where("event_type IN ('error', 'purchase')")
    reading = F.col("event_type") == "error"
    queue = F.when(reading, "extraction").otherwise("webhook")
    sent = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    rows = e.select(F.concat(queue, F.lit("|"), "event_id").alias("key"), F.concat(F.lit("j"), "event_id").alias("id"), "event_id", reading.alias("reading"), sent.alias("sent"), (F.col("event_id") % 6).alias("fails"))
    sends = [rows.select("key", F.lit("send").alias("type"), (F.lit(name) if name else F.col("id")).alias("id"), F.lit(None).cast("long").alias("attempt"), (F.col("sent") + after).alias("at_ms")) for name, after in ((None, 0), ("other", 500), (None, 700))]
    tries = F.when(F.col("reading"), machines.QUEUES["extraction"]["retries"] + 1).otherwise(machines.QUEUES["webhook"]["retries"] + 1)
    answered = rows.where("event_id % 7 <> 3").withColumn("attempt", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("fails") + 1, tries.cast("long")))))
    before = F.col("attempt") - 1
    waited = F.when(F.col("reading"), before * 5_000).otherwise((F.pow(F.lit(2), before) - 1).cast("long") * 15_000)
    at = F.col("sent") + before * 1_000 + waited + 1_000
    answers = answered.select("key", F.when(F.col("attempt") <= F.col("fails"), "fail").otherwise("ok").alias("type"), "id", "attempt", at.alias("at_ms"))
    return sends[0].unionByName(sends[1]).unionByName(sends[2]).unionByName(answers)


def job_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a consumer does with all jobs: tries, pauses, ends, and what it ignores."""
    return machines.replay(job_events(spark, sf_dir), machines.Jobs())


_JOBS = """
WITH e AS (SELECT CASE event_type WHEN 'error' THEN 'extraction' ELSE 'webhook' END || '|' || event_id AS key, 'j' || event_id AS id, event_type = 'error' AS reading, epoch_us(ts) // 1000 AS sent, event_id % 6 AS fails, event_id % 7 = 3 AS silent FROM events WHERE event_type IN ('error', 'purchase')),
q AS (SELECT *, CASE WHEN reading THEN 4 ELSE 9 END AS tries, CASE WHEN silent THEN CASE WHEN reading THEN 240000 ELSE 600000 END ELSE 1000 END AS answer FROM e),
n AS (SELECT *, unnest(range(1, CASE WHEN silent THEN tries ELSE least(fails + 1, tries) END + 1)) AS attempt FROM q),
r AS (SELECT *, sent + (attempt - 1) * answer + CASE WHEN reading THEN (attempt - 1) * 5000 ELSE (CAST(power(2, attempt - 1) AS BIGINT) - 1) * 15000 END AS run FROM n)
SELECT key, 'send' AS type, id, attempt, run AS at_ms, 'run' AS outcome, NULL::VARCHAR AS detail FROM r
UNION ALL SELECT key, 'fail', id, attempt, run + answer, CASE WHEN attempt = tries THEN 'dead' ELSE 'retry' END, CASE WHEN silent THEN 'expired' ELSE 'failed' END FROM r WHERE silent OR attempt <= fails
UNION ALL SELECT key, 'ok', id, attempt, run + answer, 'completed', NULL FROM r WHERE NOT silent AND attempt = fails + 1
UNION ALL SELECT key, 'send', 'other', NULL, sent + 500, 'duplicate', id FROM e
UNION ALL SELECT key, 'send', id, NULL, sent + 700, 'replayed', NULL FROM e
"""


def lease_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as claims of the day's capture, results (purchases) and technical failures (errors); a result
    carries the token of the event before it."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy(at, "event_id"))
    kind = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "technical").otherwise("claim")
    return e.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), kind.alias("type"), F.date_format("ts", "yyyyMMdd").alias("id"), F.concat(F.lit("t"), F.when(kind == "claim", F.col("event_id")).otherwise(before)).alias("ref"), at.alias("at_ms"))


def lease_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who gets the lease of a capture, and which results count."""
    return machines.replay(lease_events(spark, sf_dir), machines.Leases())


_LEASES = """
WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS key, row_number() OVER w AS n, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'technical' ELSE 'claim' END AS type, strftime(ts, '%Y%m%d') AS id,
  't' || CASE WHEN event_type IN ('purchase', 'error') THEN lag(event_id) OVER w ELSE event_id END AS token, epoch_us(ts) // 1000 AS at_ms FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id)),
s AS (
  SELECT DISTINCT key, 0::BIGINT AS n, ''::VARCHAR AS type, ''::VARCHAR AS id, 0::BIGINT AS at_ms, ''::VARCHAR AS capture, 'new'::VARCHAR AS status, ''::VARCHAR AS holder, 0::BIGINT AS until, 0::BIGINT AS failures, ''::VARCHAR AS outcome, ''::VARCHAR AS detail FROM e
  UNION ALL
  SELECT key, n, type, id, at_ms, CASE WHEN o = 'granted' THEN id ELSE capture END, CASE WHEN o = 'granted' THEN 'processing' WHEN o = 'refused' THEN status ELSE o END, CASE WHEN o = 'granted' THEN token ELSE holder END,
    CASE WHEN o = 'granted' THEN at_ms + 240000 ELSE until END, CASE WHEN o = 'granted' AND NOT same THEN 0 WHEN o IN ('pending', 'dead') THEN failures + 1 ELSE failures END, o,
    CASE WHEN o <> 'refused' THEN token WHEN type <> 'claim' THEN 'stale_result' WHEN status IN ('ready', 'dead') THEN status ELSE 'leased' END
  FROM (SELECT e.*, s.capture, s.status, s.holder, s.until, s.failures, e.id = s.capture AS same, CASE
      WHEN e.type = 'claim' THEN CASE WHEN e.id = s.capture AND (s.status IN ('ready', 'dead') OR (s.status = 'processing' AND s.until > e.at_ms)) THEN 'refused' ELSE 'granted' END
      WHEN e.id <> s.capture OR s.status <> 'processing' OR e.token IS NULL OR e.token <> s.holder THEN 'refused'
      WHEN e.type = 'done' THEN 'ready' WHEN s.failures >= 2 THEN 'dead' ELSE 'pending' END AS o FROM s JOIN e ON e.key = s.key AND e.n = s.n + 1)
)
SELECT key, type, id, CASE WHEN outcome IN ('pending', 'dead') THEN failures END AS attempt, at_ms, outcome, detail FROM s WHERE n > 0
"""

def activity_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users, in which a purchase keeps its session open for a day and any other event for half an hour."""
    e = table(spark, sf_dir, "events", "user_id", "ts", "event_type")
    gap = F.when(F.col("event_type") == "purchase", 86_400_000).otherwise(1_800_000)
    out = windows.session_windows(e.withColumn("ts", F.col("ts").cast("timestamp")), ["user_id"], "ts", gap)
    ms = lambda c: F.floor(F.unix_micros(c) / 1000).alias(f"{c}_ms")
    return out.select("user_id", ms("started"), ms("last"), ms("until"), "events")


_ACTIVITY = """
WITH e AS (SELECT user_id, epoch_us(ts) AS t, epoch_us(ts) + CASE WHEN event_type = 'purchase' THEN 86400000000 ELSE 1800000000 END AS open_, event_id FROM events WHERE ts IS NOT NULL),
n AS (SELECT *, coalesce(t >= max(open_) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)::INT AS fresh FROM e),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id) AS no FROM n)
SELECT user_id, min(t) // 1000 AS started_ms, max(t) // 1000 AS last_ms, max(open_) // 1000 AS until_ms, count(*) AS events FROM s GROUP BY user_id, no
"""

QUERIES = {"job_attempts": (job_attempts, _JOBS), "lease_claims": (lease_claims, _LEASES), "activity_windows": (activity_windows, _ACTIVITY)}
