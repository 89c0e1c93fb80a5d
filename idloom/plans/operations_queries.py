"""Sweeps, tenancy, ordered computations and the lifecycle over the driver's tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.operators import lifecycle, reports, sweeps, tenancy, windows
from idloom.plans.common import table
from idloom.streaming.lifecycle import fold_stream

AS_OF = "1997-01-01 00:00:00"


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sessions."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "expired").when(F.col("o_orderstatus") == "P", "processing").otherwise("capturing")
    return o.select(
        F.col("o_orderkey").alias("session_id"),
        F.col("o_custkey").alias("client_reference"),
        status.alias("status"),
        F.lit(None).cast("string").alias("reason_code"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
        (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("expires_at"),
        F.lit(1).cast("long").alias("version"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate")).alias("webhook_queued_at"),
        F.when(F.col("o_orderkey") % 6 == 0, F.col("o_orderdate")).alias("webhook_delivered_at"),
    )


def expired_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweeps.expired(_sessions(spark, sf_dir), AS_OF).select("session_id", "status", "updated_at")


_EXPIRED = f"""
SELECT o_orderkey AS session_id, CASE o_orderstatus WHEN 'F' THEN 'expired' WHEN 'P' THEN 'processing' ELSE 'capturing' END AS status, o_orderdate AS updated_at FROM orders
WHERE (o_orderstatus = 'F' AND o_orderkey % 3 <> 0) OR (o_orderstatus <> 'F' AND o_orderdate + INTERVAL 30 DAY <= TIMESTAMP '{AS_OF}') ORDER BY o_orderdate, o_orderkey LIMIT 100
"""


def expire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweeps.expire(_sessions(spark, sf_dir), AS_OF).select("session_id", "status", "reason_code", "version", "expires_at")


_EXPIRE = f"""
SELECT o_orderkey AS session_id, CASE WHEN due THEN 'expired' WHEN o_orderstatus = 'F' THEN 'expired' WHEN o_orderstatus = 'P' THEN 'processing' ELSE 'capturing' END AS status,
  CASE WHEN due THEN 'session_expired' END AS reason_code, CASE WHEN due THEN 2 ELSE 1 END::BIGINT AS version, CASE WHEN due THEN TIMESTAMP '{AS_OF}' + INTERVAL 30 MINUTE ELSE o_orderdate + INTERVAL 30 DAY END AS expires_at
FROM (SELECT *, o_orderstatus NOT IN ('F', 'P') AND o_orderdate + INTERVAL 30 DAY <= TIMESTAMP '{AS_OF}' AS due FROM orders)
"""


def pending_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linestatus").select(F.col("l_orderkey").alias("session_id"), F.when(F.col("l_linestatus") == "F", "ready").otherwise("processing").alias("state"))
    return sweeps.pending(_sessions(spark, sf_dir), work).select("session_id", "updated_at")


_PENDING = """
SELECT o_orderkey AS session_id, o_orderdate AS updated_at FROM orders WHERE (o_orderstatus = 'F' AND o_orderkey % 6 <> 0)
  OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus <> 'F') ORDER BY o_orderdate, o_orderkey LIMIT 100
"""


def retention_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweeps.older_than(_sessions(spark, sf_dir), AS_OF).select("session_id", "created_at")


def purge_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweeps.purged(_sessions(spark, sf_dir), AS_OF).groupBy("status").agg(F.count("*").alias("n"))


_PURGE = f"SELECT CASE o_orderstatus WHEN 'F' THEN 'expired' WHEN 'P' THEN 'processing' ELSE 'capturing' END AS status, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '{AS_OF}' GROUP BY 1"


def idempotent_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and type, on top of the purchases that were stored before."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    stored = sweeps.insert_once(None, e.where("event_type = 'purchase'"), ["user_id", "event_type"], ["ts", "event_id"])
    return sweeps.insert_once(stored, e, ["user_id", "event_type"], ["ts", "event_id"])


_INSERT = "SELECT event_id, ts, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1"


def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "user_id", "value").withColumn("version", F.floor("value").cast("long"))
    return sweeps.latest(e, ["user_id"], "version", "event_id").select("user_id", "event_id", "version")


_LATEST = "SELECT user_id, event_id, CAST(floor(value) AS BIGINT) AS version FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY floor(value) DESC NULLS LAST, event_id DESC) = 1"


def compare_and_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers updated where the expected version is right; new ones inserted."""
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name")
    current = c.where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), (F.col("c_custkey") % 3).alias("version"))
    updates = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.lit("updated").alias("name"), F.lit(9).cast("long").alias("version"), F.when(F.col("c_custkey") % 10 != 0, F.lit(1)).cast("long").alias("expected_version"))
    return sweeps.compare_and_set(current, updates, "id")


_CAS = """
SELECT c_custkey AS id, CASE WHEN hit THEN 'updated' ELSE c_name END AS name, CASE WHEN hit THEN 9 ELSE c_custkey % 3 END AS version
FROM (SELECT *, c_custkey % 2 = 0 AND (c_custkey % 10 = 0 OR c_custkey % 3 = 1) AS hit FROM customer)
"""


def webhook_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies to send, each signed as it is."""
    done = _sessions(spark, sf_dir).withColumn("completed_at", F.date_format("updated_at", "yyyy-MM-dd"))
    box = sweeps.outbox(done).select("session_id", "singleton_key").join(done.select("session_id", sweeps.completed_payload().alias("body")), "session_id")
    return box.select("session_id", "singleton_key", "body", F.concat(F.lit("sha256="), tenancy.hmac_sha256(F.col("body"), F.lit("secret"))).alias("signature"))


# The inner and outer pads of HMAC for the key "secret": its bytes, filled with zeros to 64, xor 0x36 and 0x5c.
_PADS = ["".join(f"{b ^ x:02x}" for b in b"secret".ljust(64, b"\0")) for x in (0x36, 0x5C)]
_OUTBOX = f"""
WITH b AS (SELECT o_orderkey AS session_id, '{{"event":"onboarding.completed","sessionId":' || o_orderkey || ',"status":"expired","reasonCode":null,"completedAt":"' || strftime(o_orderdate, '%Y-%m-%d') || '"}}' AS body FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 <> 0)
SELECT session_id, 'webhook:' || session_id AS singleton_key, body, 'sha256=' || sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(body)))) AS signature FROM b
"""


def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When users' errors may be tried again: reading jobs every five seconds, deliveries after doubling pauses."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "event_type")
    rows = e.select("event_id", "event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("sent_ms"))
    reading = sweeps.retry_schedule(rows.where("event_type = 'error'"), "sent_ms", 4, 5_000, backoff=False)
    webhook = sweeps.retry_schedule(rows.where("event_type = 'purchase'"), "sent_ms", 3, 250, backoff=True)
    return reading.unionByName(webhook).select("event_id", "attempt", "not_before_ms")


_RETRIES = """
WITH e AS (SELECT event_id, event_type, epoch_us(ts) // 1000 AS t FROM events)
SELECT event_id, n::INT AS attempt, t + (n - 1) * 5000 AS not_before_ms FROM e, range(1, 5) r(n) WHERE event_type = 'error'
UNION ALL SELECT event_id, n::INT, t + CASE n WHEN 1 THEN 0 WHEN 2 THEN 250 ELSE 750 END FROM e, range(1, 4) r(n) WHERE event_type = 'purchase'
"""


def once_only_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of an order's parts that no earlier order of the same customer has had."""
    li, o = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linestatus"), table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    sets = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linestatus")).alias("capture_ids")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = sets.select(F.col("o_custkey").alias("session_id"), F.lit("dz-id").alias("kind"), "capture_ids", (F.col("o_orderkey") % 3 == 0).alias("old"), "o_orderkey")
    fresh = sweeps.not_joined_yet(rows.where("NOT old"), rows.where("old"), "session_id")
    return fresh.select("session_id", "o_orderkey", F.array_join("capture_ids", ";").alias("capture_ids"))


_ONCE_ONLY = """
WITH s AS (SELECT o_custkey AS session_id, o_orderkey, string_agg(DISTINCT l_linestatus, ';' ORDER BY l_linestatus) AS capture_ids FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT session_id, o_orderkey, capture_ids FROM s WHERE o_orderkey % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM s t WHERE t.session_id = s.session_id AND t.capture_ids = s.capture_ids AND t.o_orderkey % 3 = 0)
"""

# ---------------------------------------------------------------- tenancy


def key_auth_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers present their names as keys of the application that is their nation."""
    c, n = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey", "c_acctbal"), table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    keys = tenancy.issue_keys(c.select(F.col("c_name").alias("secret"), F.col("c_nationkey").alias("application_id"), F.when(F.col("c_acctbal") < 0, "1996-01-01T00:00:00.000Z").alias("revoked_at"), F.when(F.col("c_custkey") % 4 == 0, "1996-12-31T00:00:00.000Z").alias("expires_at")))
    apps = n.select(F.col("n_nationkey").alias("id"), (F.col("n_regionkey") != 2).alias("enabled"))
    tries = c.select("c_custkey", tenancy.key_digest(F.col("c_name")).alias("digest"))
    return tenancy.authenticate(tries, keys, apps, "1997-01-01T00:00:00.000Z").select("c_custkey", "digest", "application_id")


_AUTH = "SELECT c_custkey, sha256(c_name) AS digest, c_nationkey AS application_id FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal >= 0 AND c_custkey % 4 <> 0 AND n_regionkey <> 2"


def _adapters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p, li = table(spark, sf_dir, "part", "p_partkey", "p_brand"), table(spark, sf_dir, "lineitem", "l_partkey", "l_quantity")
    return p.select(F.col("p_brand").alias("kind"), F.col("p_partkey").alias("type")), li.where("l_quantity > 20").select(F.col("l_partkey").alias("type")).distinct()


def catalog_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tenancy.catalogue(*_adapters(spark, sf_dir))


def catalog_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    adapters, served = _adapters(spark, sf_dir)
    return tenancy.unknown_types(adapters.where("type % 3 = 0"), served)


def rule_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules made from customers, what is wrong with them, and whether a choice is accepted."""
    c = table(spark, sf_dir, "customer", "c_custkey")
    k = F.col("c_custkey")
    mode = F.when(k % 4 == 0, "all").when(k % 4 == 1, "exact").when(k % 4 == 2, "optional").otherwise("any")
    docs = F.when(k % 5 == 0, F.array(F.lit("dz-id"), F.lit("dz-id"))).otherwise(F.array(F.lit("dz-id"), F.lit("dz-passport")))
    required = F.when(k % 7 == 0, F.array(F.lit("dz-driving-licence"))).otherwise(F.array(F.lit("dz-id")))
    count = F.when(k % 3 != 0, (k % 3).cast("int"))
    chosen = F.when(k % 2 == 0, F.array(F.lit("dz-id"))).otherwise(F.array(F.lit("dz-passport")))
    problems = tenancy.rule_problems(mode, docs, required, count)
    refused = tenancy.selection_problem(chosen, tenancy.policy(mode, docs, required, count), docs)
    return c.select("c_custkey", F.array_join(problems, ",").alias("problems"), F.when(F.size(problems) == 0, F.coalesce(refused, F.lit("accepted"))).alias("selection"))


_RULES = """
WITH r AS (SELECT c_custkey, c_custkey % 4 AS m, c_custkey % 5 = 0 AS twice, c_custkey % 7 = 0 AS foreign_, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 3 END AS n FROM customer),
p AS (SELECT *, array_to_string(list_filter([CASE WHEN m = 3 THEN 'mode' END, CASE WHEN twice THEN 'unique' END, CASE WHEN foreign_ THEN 'mandatory' END, CASE WHEN m = 1 AND n IS NULL THEN 'count' END], lambda x: x IS NOT NULL), ',') AS problems FROM r)
SELECT c_custkey, problems, CASE WHEN problems = '' THEN CASE
  WHEN m = 0 THEN 'mandatory_missing'
  WHEN c_custkey % 2 = 1 THEN 'mandatory_missing'
  WHEN m = 1 AND n > 1 THEN 'too_few_or_not_allowed'
  ELSE 'accepted' END END AS selection FROM p
"""

# ---------------------------------------------------------------- ordered computations


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value").withColumn("good", F.col("value") >= 20)


def stable_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.stable_hold(_frames(spark, sf_dir), ["user_id"], ["ts", "event_id"], "ts", "good").select("event_id", "streak", "fire")


_STREAK = """
WITH f AS (SELECT *, value >= 20 AS good FROM events),
i AS (SELECT *, sum(CASE WHEN good THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM f),
s AS (SELECT *, CASE WHEN good THEN count(*) FILTER (good) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) ELSE 0 END AS streak, min(ts) FILTER (good) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS since FROM i),
r AS (SELECT *, good AND streak >= 4 AND ts - since >= INTERVAL 5 SECOND AS ready FROM s)
SELECT event_id, CAST(streak AS BIGINT) AS streak, ready AND NOT coalesce(bool_or(ready) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS fire FROM r
"""


def failure_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _frames(spark, sf_dir).withColumn("failed", F.col("event_type") == "error")
    return windows.failure_cutoff(rows, ["user_id"], ["ts", "event_id"], "failed").select("event_id", "disabled")


_CUTOFF = """
WITH f AS (SELECT *, (event_type = 'error')::INT AS bad FROM events),
s AS (SELECT *, bad + lag(bad, 1, 0) OVER w + lag(bad, 2, 0) OVER w = 3 AS three FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, bool_or(three) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS disabled FROM s
"""


def hint_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _frames(spark, sf_dir).withColumn("hint", F.when(F.col("event_type") == "view", "ready").otherwise(F.col("event_type")))
    return windows.debounced_hint(rows, ["user_id"], ["ts", "event_id"], "hint").select("event_id", "shown")


_HINT = """
WITH h AS (SELECT *, CASE WHEN event_type = 'view' THEN 'ready' ELSE event_type END AS hint FROM events),
s AS (SELECT *, CASE WHEN hint = 'ready' OR hint = lag(hint) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN hint END AS settled FROM h)
SELECT event_id, last_value(settled IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS shown FROM s
"""


def corner_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean corner displacement between a user's frames; four corners made from each event's value, two frame sizes."""
    from idloom.functions.numeric import round_half_up

    v = F.col("value")
    corner = lambda x, y: F.struct((v * x).alias("x"), (v * y).alias("y"))
    size = F.when(F.col("event_type") == "signup", 800.0).otherwise(1600.0)
    rows = _frames(spark, sf_dir).select("event_id", "ts", "user_id", F.array(corner(0.0, 0.0), corner(1.0, 0.0), corner(1.0, 1.0), corner(0.0, 1.0)).alias("quad"), size.alias("width"), (size * 0.75).alias("height"))
    return windows.corner_motion(rows, ["user_id"], ["ts", "event_id"]).select("event_id", round_half_up(F.col("corner_motion"), 6).alias("corner_motion"))


_MOTION = """
WITH f AS (SELECT *, CASE WHEN event_type = 'signup' THEN 800.0::DOUBLE ELSE 1600.0::DOUBLE END AS w FROM events),
l AS (SELECT *, abs(value - lag(value) OVER x) AS d, lag(w) OVER x AS pw FROM f WINDOW x AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN pw = w THEN floor((0 + d + sqrt(d * d + d * d) + d) / 4 / (w * 1.25) * 1000000 + 0.5) / 1000000 END AS corner_motion FROM l
"""


def ring_buffer_120(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.last_n(_frames(spark, sf_dir), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 120).select("user_id", "event_id", "value")


_RING = "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 120"


def inactivity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.inactivity_sessions(_frames(spark, sf_dir), ["user_id"], ["ts", "event_id"], "ts")
    return rows.groupBy("user_id", "session_no").agg(F.count("*").alias("events"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


_IDLE = """
WITH g AS (SELECT *, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE)::INT, 0) AS new FROM events),
s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM g)
SELECT user_id, session_no, count(*) AS events, min(ts) AS started, max(ts) AS ended FROM s GROUP BY ALL
"""


def attempt_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.attempts(_frames(spark, sf_dir).where("event_type = 'error'"), ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "attempt", "allowed")


_ATTEMPT = "SELECT event_id, user_id, attempt, attempt <= 3 AS allowed FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events WHERE event_type = 'error')"

# ---------------------------------------------------------------- views and the lifecycle


def public_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sessions(spark, sf_dir).withColumns({"raw_response": F.lit("x"), "object_key": F.lit("y")})
    return reports.public_view(rows).select("session_id", "client_reference", "status", "version")


_PUBLIC = "SELECT o_orderkey AS session_id, o_custkey AS client_reference, CASE o_orderstatus WHEN 'F' THEN 'expired' WHEN 'P' THEN 'processing' ELSE 'capturing' END AS status, CAST(1 AS BIGINT) AS version FROM orders"


def result_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final sessions with whether all of their checks (lines) passed."""
    from idloom.operators.checks import identity_status

    rows = table(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag").select(F.col("l_orderkey").alias("session_id"), F.when(F.col("l_returnflag") == "R", "failed").otherwise("passed").alias("outcome"))
    return reports.result_view(_sessions(spark, sf_dir).select("session_id", "status"), identity_status(rows, "session_id"))


_RESULT = """
WITH c AS (SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'mismatched' ELSE 'matched' END AS identity_status FROM lineitem GROUP BY 1)
SELECT o_orderkey AS session_id, 'expired' AS status, identity_status FROM orders LEFT JOIN c ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'
"""


def flow_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase and next side of sessions: every three lines of an order are the three documents of one."""
    rows = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity")
    session, pos = (F.col("l_orderkey") * 10 + F.floor((F.col("l_linenumber") - 1) / 3)).alias("session_id"), ((F.col("l_linenumber") - 1) % 3).alias("pos")
    per = rows.groupBy(session, pos).agg(F.min("l_returnflag").alias("f"), F.min("l_linestatus").alias("s"), F.min("l_quantity").alias("q"))
    kinds = F.array(F.lit("dz-id"), F.lit("dz-driving-licence"), F.lit("dz-passport"))
    docs = per.select("session_id", "pos", F.get(kinds, F.col("pos").cast("int")).alias("kind"), (F.col("f") == "A").alias("confirmed"), F.when(F.col("s") == "F", "ready").otherwise("processing").alias("status"), (F.col("q") > 40).alias("blocking"))
    captures = per.where("q > 10").select("session_id", F.get(kinds, F.col("pos").cast("int")).alias("kind"), F.explode(F.array(F.lit("front"), F.lit("back"), F.lit("single"))).alias("side"))
    captures = captures.where("side <> 'back' OR session_id % 2 = 0")
    conflicts = docs.groupBy("session_id").agg(F.bool_or(F.col("blocking")).alias("blocking"))
    return reports.flow(docs, captures, conflicts, "session_id")


_FLOW = """
WITH p AS (SELECT l_orderkey * 10 + (l_linenumber - 1) // 3 AS session_id, (l_linenumber - 1) % 3 + 1 AS pos, ['dz-id', 'dz-driving-licence', 'dz-passport'][(l_linenumber - 1) % 3 + 1] AS kind, min(l_returnflag) = 'A' AS confirmed, min(l_linestatus) = 'F' AS ready, min(l_quantity) AS q FROM lineitem GROUP BY ALL),
c AS (SELECT * FROM p WHERE NOT confirmed QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY pos) = 1),
k AS (SELECT session_id, count(*) FILTER (confirmed) AS completed, bool_or(q > 40) AS cross_ FROM p GROUP BY 1),
n AS (SELECT *, CASE WHEN kind = 'dz-passport' THEN (CASE WHEN q > 10 THEN NULL ELSE 'single' END) WHEN q <= 10 THEN 'front' WHEN session_id % 2 = 0 THEN NULL ELSE 'back' END AS next_side FROM c)
SELECT k.session_id, n.kind AS current_kind, n.next_side, CASE WHEN n.kind IS NULL THEN (CASE WHEN cross_ THEN 'consistency' ELSE 'complete' END) WHEN n.next_side IS NOT NULL THEN 'capture' WHEN NOT n.ready THEN 'processing' WHEN n.q > 40 THEN 'consistency' ELSE 'review' END AS phase, completed
FROM k LEFT JOIN n ON n.session_id = k.session_id
"""


def lifecycle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session events made from the event table: each user's events become actions of one session a day."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    session = F.concat_ws("-", F.col("user_id"), F.date_format("ts", "yyyyMMdd"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "event_id"))
    rows = e.select(session.alias("session_id"), "event_id", "ts", "event_type", "value")
    rows = rows.withColumn("seq", place.cast("long"))
    kind = F.when(F.col("seq") == 1, "create").when(F.col("event_type") == "purchase", "confirm").when(F.col("event_type") == "error", "retake").when(F.col("event_type") == "signup", "submit").when(F.col("event_type") == "click", "ocr").otherwise("capture")
    return rows.select(
        "session_id",
        "seq",
        kind.alias("type"),
        F.when(F.col("seq") == 1, "passport-only").otherwise("dz-passport").alias("kind"),
        F.when(kind == "capture", "single").alias("side"),
        F.col("event_id").cast("string").alias("capture_id"),
        F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("mutation_key"),
        (F.col("value") > 5).alias("ok"),
        (F.col("seq") * 60_000).alias("at_ms"),
    )


def lifecycle_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.fold(lifecycle_events(spark, sf_dir))


def lifecycle_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fold as a stream over the events as files, in one pass over what is there: the last state of each."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or "file://" + tempfile.mkdtemp(prefix="spark-idloom-")
    folder = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    lifecycle_events(spark, sf_dir).write.parquet(f"{folder}/in")
    rows = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{folder}/out")

    fold_stream(rows, timers=False).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").foreachBatch(keep).start().awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    return sweeps.latest(out, ["session_id"], "batch", "version").drop("batch")


# The rules for a session with one passport, event by event: first what an event comes to, then what that changes.
_FOLD = """
WITH RECURSIVE e AS (SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS session_id, event_type, value > 5 AS ok, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y%m%d') ORDER BY ts, event_id) AS seq FROM events),
s AS (
  SELECT session_id, seq, 'created' AS status, NULL::VARCHAR AS reason, 1::BIGINT AS version, seq * 60000 + 1800000 AS expires, false AS held, 'pending' AS doc, 0 AS photos, 0 AS readings, false AS confirmed, false AS clash, 0::BIGINT AS rejected, NULL::VARCHAR AS error FROM e WHERE seq = 1
  UNION ALL
  SELECT session_id, seq,
    CASE code WHEN 'limit' THEN 'document_failed' WHEN 'exhausted' THEN 'document_failed' WHEN 'blurred' THEN 'capturing' WHEN 'taken' THEN 'processing' WHEN 'read' THEN 'awaiting_confirmation' WHEN 'unread' THEN 'awaiting_confirmation'
      WHEN 'agreed' THEN CASE WHEN clash THEN 'capturing' ELSE 'awaiting_submission' END WHEN 'again' THEN 'capturing' WHEN 'differs' THEN 'awaiting_confirmation' WHEN 'done' THEN 'succeeded' ELSE status END,
    CASE code WHEN 'limit' THEN 'submission_limit_reached' WHEN 'exhausted' THEN 'ocr_attempts_exhausted' WHEN 'differs' THEN 'consistency_mismatch' WHEN 'taken' THEN NULL WHEN 'again' THEN NULL ELSE reason END,
    CASE WHEN code[1] = '!' THEN version ELSE version + 1 END, CASE WHEN code[1] = '!' THEN expires ELSE now + 1800000 END,
    CASE code WHEN 'taken' THEN true WHEN 'again' THEN false ELSE held END,
    CASE code WHEN 'limit' THEN 'failed' WHEN 'exhausted' THEN 'failed' WHEN 'blurred' THEN 'capturing' WHEN 'taken' THEN 'processing' WHEN 'read' THEN 'ready' WHEN 'unread' THEN 'incomplete' WHEN 'again' THEN 'capturing' ELSE doc END,
    photos + (code IN ('limit', 'blurred', 'taken'))::INT, readings + (code IN ('read', 'unread') OR (code = 'exhausted' AND kind = 'ocr'))::INT,
    CASE code WHEN 'agreed' THEN true WHEN 'again' THEN false WHEN 'taken' THEN false ELSE confirmed END, CASE code WHEN 'differs' THEN true WHEN 'again' THEN false ELSE clash END,
    rejected + (code[1] = '!' OR code IN ('limit', 'blurred', 'differs'))::INT,
    CASE code WHEN 'limit' THEN 'submission_limit_reached' WHEN 'blurred' THEN 'quality_rejected' WHEN 'differs' THEN 'consistency_conflict' ELSE CASE WHEN code[1] = '!' THEN code[2:] ELSE error END END
  FROM (SELECT s.* EXCLUDE (seq, status, reason, version, expires), e.seq, e.kind, e.now, over_.status, over_.reason, over_.version, over_.expires,
      CASE WHEN over_.status IN ('succeeded', 'document_failed', 'expired') THEN '!session_closed'
        WHEN e.kind = 'capture' THEN CASE WHEN held OR doc IN ('incomplete', 'ready') THEN '!document_not_capturable' WHEN photos >= 10 THEN 'limit' WHEN NOT e.ok THEN 'blurred' ELSE 'taken' END
        WHEN e.kind = 'ocr' THEN CASE WHEN e.ok THEN 'read' WHEN readings >= 2 THEN 'exhausted' ELSE 'unread' END
        WHEN e.kind = 'confirm' THEN CASE WHEN doc <> 'ready' THEN '!document_not_ready' ELSE 'agreed' END
        WHEN e.kind = 'retake' THEN CASE WHEN readings < 3 THEN 'again' WHEN clash THEN '!ocr_attempts_exhausted' ELSE 'exhausted' END
        ELSE CASE WHEN over_.status <> 'awaiting_submission' THEN '!session_not_ready' WHEN NOT e.ok THEN 'differs' ELSE 'done' END END AS code
    FROM s JOIN (SELECT session_id, seq, ok, seq * 60000 AS now, CASE event_type WHEN 'purchase' THEN 'confirm' WHEN 'error' THEN 'retake' WHEN 'signup' THEN 'submit' WHEN 'click' THEN 'ocr' ELSE 'capture' END AS kind FROM e) e ON e.session_id = s.session_id AND e.seq = s.seq + 1,
      LATERAL (SELECT s.status NOT IN ('processing', 'succeeded', 'document_failed', 'expired') AND e.now >= s.expires AS due) d,
      LATERAL (SELECT CASE WHEN due THEN 'expired' ELSE s.status END AS status, CASE WHEN due THEN 'session_expired' ELSE s.reason END AS reason, s.version + due::INT AS version, CASE WHEN due THEN e.now + 1800000 ELSE s.expires END AS expires) over_) x
)
SELECT session_id, status, reason AS reason_code, version, expires AS expires_at_ms, CASE WHEN NOT confirmed THEN 'dz-passport' END AS current_kind, confirmed::BIGINT AS confirmed, rejected, error AS last_error
FROM s QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) = 1
"""

QUERIES = {
    "expired_sweep": (expired_sweep, _EXPIRED),
    "expire": (expire, _EXPIRE),
    "pending_sweep": (pending_sweep, _PENDING),
    "retention_scan": (retention_scan, f"SELECT o_orderkey AS session_id, o_orderdate AS created_at FROM orders WHERE o_orderdate < TIMESTAMP '{AS_OF}'"),
    "purge_remaining": (purge_remaining, _PURGE),
    "idempotent_insert": (idempotent_insert, _INSERT),
    "latest_version": (latest_version, _LATEST),
    "compare_and_set": (compare_and_set, _CAS),
    "webhook_outbox": (webhook_outbox, _OUTBOX),
    "retry_schedule": (retry_schedule, _RETRIES),
    "once_only_join": (once_only_join, _ONCE_ONLY),
    "key_auth_join": (key_auth_join, _AUTH),
    "catalog_available": (catalog_available, "SELECT p_brand AS kind, bool_and(p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 20)) AS available FROM part GROUP BY 1"),
    "catalog_unknown": (catalog_unknown, "SELECT DISTINCT l_partkey AS type FROM lineitem WHERE l_quantity > 20 AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0)"),
    "rule_validity": (rule_validity, _RULES),
    "stable_streak": (stable_streak, _STREAK),
    "failure_cutoff": (failure_cutoff, _CUTOFF),
    "hint_debounce": (hint_debounce, _HINT),
    "corner_motion": (corner_motion, _MOTION),
    "ring_buffer_120": (ring_buffer_120, _RING),
    "inactivity_sessions": (inactivity_sessions, _IDLE),
    "attempt_limit": (attempt_limit, _ATTEMPT),
    "public_view": (public_view, _PUBLIC),
    "result_status": (result_status, _RESULT),
    "flow_projection": (flow_projection, _FLOW),
    "lifecycle_fold": (lifecycle_fold, _FOLD),
    "lifecycle_stream": (lifecycle_stream, _FOLD),
}
