"""Further operators over the driver's tables: retries, lineage, templates, tokens, keys, configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom import dims
from idloom.functions import text as X
from idloom.functions.numeric import round_half_up
from idloom.operators import fields, linkage, matching, quality, sweeps, tenancy
from idloom.plans.common import table


def retry_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides to photograph again for checks made from line items: by the reading's own side, else by who holds it."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag")
    readings = li.select("l_orderkey", F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("check_id"), F.lit("dz-id").alias("kind"), F.when(F.col("l_returnflag") == "R", "back").alias("side"), F.when(F.col("l_linenumber") % 2 == 0, "nin").otherwise("sex").alias("field"))
    held = li.where("l_linenumber = 1").select("l_orderkey", F.lit("dz-id").alias("kind"), F.lit("front").alias("side"), F.lit("nin").alias("field"))
    return linkage.retry_targets(readings, held, dims.sides(spark), "l_orderkey")


_RETRY = """
WITH r AS (SELECT DISTINCT l_orderkey, 'c' || l_linenumber AS check_id, CASE WHEN l_returnflag = 'R' THEN 'back' END AS side, CASE WHEN l_linenumber % 2 = 0 THEN 'nin' ELSE 'sex' END AS field FROM lineitem),
h AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber = 1), s AS (SELECT unnest(['front', 'back']) AS s)
SELECT DISTINCT r.l_orderkey, check_id, 'dz-id' AS kind, s.s AS side FROM r CROSS JOIN s LEFT JOIN h ON h.l_orderkey = r.l_orderkey
WHERE CASE WHEN r.side IS NOT NULL THEN r.side = s.s WHEN field = 'nin' AND h.l_orderkey IS NOT NULL THEN s.s = 'front' ELSE true END
"""


def stale_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that still belong to the current capture: line items whose part is the order's last one."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    rows = li.select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("capture_id"), (F.col("l_partkey") % 2).alias("token"))
    current = rows.groupBy("session_id").agg(F.max("capture_id").alias("capture_id")).withColumn("token", F.col("capture_id") % 2)
    return sweeps.still_current(rows, current, "session_id").select("session_id", "line", "capture_id")


_STALE = "SELECT l_orderkey AS session_id, l_linenumber AS line, l_partkey AS capture_id FROM lineitem QUALIFY l_partkey = max(l_partkey) OVER (PARTITION BY l_orderkey)"


def best_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size", "p_retailprice")
    c = p.select("p_brand", F.col("p_partkey").alias("template_id"), (F.col("p_size") > 25).alias("matched"), (F.col("p_size") / 50).alias("inlier_ratio"), F.col("p_retailprice").alias("error"))
    return matching.best_template(c, "p_brand").select("p_brand", "template_id", "matched")


_BEST = "SELECT p_brand, p_partkey AS template_id, p_size > 25 AS matched FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size > 25 DESC, p_size / 50 DESC, p_retailprice, p_partkey) = 1"


def match_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inlier ratio, coverage, error and acceptance of matches made from line items, for each part."""
    li = table(spark, sf_dir, "lineitem", "l_partkey", "l_quantity", "l_discount", "l_tax", "l_returnflag")
    rows = li.select("l_partkey", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_quantity") + F.col("l_tax") * 100).alias("px"), (F.col("l_discount") * 100).alias("py"), (F.col("l_returnflag") != "R").alias("inlier"), F.lit(50.0).alias("width"), F.lit(10.0).alias("height"))
    q = matching.match_quality(rows, "l_partkey")
    finite = F.when(F.col("error") < float("inf"), round_half_up(F.col("error"), 6))
    return q.select("l_partkey", "good", round_half_up(F.col("inlier_ratio"), 6).alias("inlier_ratio"), round_half_up(F.col("coverage"), 6).alias("coverage"), finite.alias("error"), matching.accepted(10, 0.42, 0.08, 8.0).alias("accepted"))


_MATCH = """
WITH m AS (SELECT l_partkey, l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS e, l_returnflag <> 'R' AS inlier FROM lineitem),
q AS (SELECT l_partkey, count(*) AS good, avg(inlier::INT) AS ratio, CASE WHEN count(*) FILTER (inlier) >= 4 THEN (max(x) FILTER (inlier) - min(x) FILTER (inlier)) * (max(y) FILTER (inlier) - min(y) FILTER (inlier)) / 500 ELSE 0 END AS coverage, avg(e) FILTER (inlier) AS error FROM m GROUP BY 1)
SELECT l_partkey, good, floor(ratio * 1000000 + 0.5) / 1000000 AS inlier_ratio, floor(coverage * 1000000 + 0.5) / 1000000 AS coverage, floor(error * 1000000 + 0.5) / 1000000 AS error,
  good >= 10 AND ratio >= 0.42 AND coverage >= 0.08 AND coalesce(error, 'inf'::DOUBLE) <= 8 AS accepted FROM q
"""


def zone_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag")
    zones = li.select("l_orderkey", F.col("l_linenumber").cast("string").alias("zone_id"), (F.col("l_linenumber") <= 4).alias("required"), (F.col("l_returnflag") != "A").alias("visible"), F.col("l_quantity").alias("zone_sharpness"), F.lit(10.0).alias("min_sharpness"), F.col("l_discount").alias("zone_glare"), F.lit(0.05).alias("max_glare"), (F.col("l_quantity") * 5).alias("zone_paper"), F.lit(50.0).alias("min_paper"), F.lit(200.0).alias("max_paper"))
    return quality.zone_checks(zones, "l_orderkey").groupBy(F.substring_index("check_id", ".", 1).alias("check"), "passed").agg(F.count("*").alias("n"))


_ZONES = """
WITH z AS (SELECT unnest(['zone_visible', 'zone_sharpness', 'zone_glare', 'zone_exposure']) AS "check", unnest([l_returnflag <> 'A', l_quantity >= 10, l_discount <= 0.05, l_quantity * 5 BETWEEN 50 AND 200]) AS passed FROM lineitem WHERE l_linenumber <= 4)
SELECT "check", passed, count(*) AS n FROM z GROUP BY ALL
"""


def category_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the brands of an order's first parts and of its others are the same set."""
    li, p = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey"), table(spark, sf_dir, "part", "p_partkey", "p_size")
    rows = li.join(p, li["l_partkey"] == p["p_partkey"]).withColumn("code", F.concat(F.lit(" c"), (F.col("p_size") % 2).cast("string")))
    pick = lambda cond: F.collect_list(F.when(cond, F.col("code")))
    both = rows.groupBy("l_orderkey").agg(pick(F.col("l_linenumber") <= 2).alias("front"), pick(F.col("l_linenumber") > 2).alias("back"))
    none = lambda c: F.when(F.size(c) > 0, F.col(c))
    return both.select("l_orderkey", linkage.category_check(none("front"), none("back")).alias("outcome"))


_CATEGORY = """
WITH c AS (SELECT l_orderkey, list_sort(list_distinct(list(p_size % 2) FILTER (l_linenumber <= 2))) AS a, list_sort(list_distinct(list(p_size % 2) FILTER (l_linenumber > 2))) AS b FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT l_orderkey, CASE WHEN coalesce(len(a), 0) = 0 OR coalesce(len(b), 0) = 0 THEN 'not_checked' WHEN a = b THEN 'passed' ELSE 'failed' END AS outcome FROM c
"""


def distinct_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    rows = li.select("l_orderkey", F.lit("flag").alias("field"), F.col("l_linestatus").alias("document"), F.lit("front").alias("side"), F.nullif("l_returnflag", F.lit("N")).alias("value"), F.col("l_linenumber").alias("pos"))
    return fields.distinct_readings(rows, "l_orderkey").select("l_orderkey", "document", "value", "place")


_READINGS = "SELECT l_orderkey, l_linestatus AS document, nullif(l_returnflag, 'N') AS value, min(l_linenumber) AS place FROM lineitem GROUP BY ALL"


def transfer_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-use tokens of users: the first click within five minutes of the first sign-up is accepted. Time runs a hundred
    times faster than the events' own, so that clicks fall within five minutes."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 100_000)
    issued = e.where("event_type = 'signup'").groupBy(F.col("user_id").alias("token")).agg((F.min(ms) + 5 * 60_000).alias("expires_at_ms"))
    uses = e.where("event_type = 'click'").select(F.col("event_id").alias("use_id"), F.col("user_id").alias("token"), ms.alias("at_ms"))
    return tenancy.consume_tokens(issued, uses).select("use_id", "token", "accepted")


_TOKENS = """
WITH i AS (SELECT user_id, min(epoch_us(ts)) // 100000 + 300000 AS expires FROM events WHERE event_type = 'signup' GROUP BY 1),
u AS (SELECT event_id, events.user_id, epoch_us(ts) // 100000 AS t_ms, coalesce(epoch_us(ts) // 100000 < expires, false) AS live FROM events LEFT JOIN i ON i.user_id = events.user_id WHERE event_type = 'click')
SELECT event_id AS use_id, user_id AS token, live AND row_number() OVER (PARTITION BY user_id, live ORDER BY t_ms, event_id) = 1 AS accepted FROM u
"""


def key_revocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer", "c_custkey", "c_acctbal"), table(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_orderstatus")
    keys = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") < 0, "1990-01-01").alias("revoked_at"))
    out = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("at"))
    kept = tenancy.revoke(keys, out, keep_first=True).withColumnRenamed("revoked_at", "first")
    return tenancy.revoke(keys, out).join(kept, "id")


_REVOKE = """
WITH r AS (SELECT o_custkey, max(strftime(o_orderdate, '%Y-%m-%d')) AS t_last FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), k AS (SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN '1990-01-01' END AS was, t_last FROM customer LEFT JOIN r ON o_custkey = c_custkey)
SELECT id, coalesce(t_last, was) AS revoked_at, coalesce(was, t_last) AS "first" FROM k
"""


def url_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages", "page_id", "url")
    slashed = F.concat(F.col("url"), F.lit("//"))
    return p.select("page_id", X.trim_url(slashed).alias("trimmed"), X.url_origin(F.col("url")).alias("origin"))


_URL = "SELECT page_id, regexp_replace(url || '//', '/+$', '') AS trimmed, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) AS origin FROM pages"


def configuration_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment"), table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    clients = c.select(F.col("c_custkey").cast("string").alias("id"), F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, "x" * 30).otherwise("")).alias("api_key"), F.array(F.lit("id-only"), F.lower("c_mktsegment")).alias("policies"))
    required = n.select(F.col("n_nationkey").cast("string").alias("kind"), F.when(F.col("n_nationkey") % 4 == 0, "nin").otherwise(F.col("n_name")).alias("field"))
    return tenancy.configuration_problems(clients, required, ["nin", "sex"])


_CONFIG = """
SELECT CAST(n_nationkey AS VARCHAR) AS subject, 'unknown_field' AS problem, n_name AS detail FROM nation WHERE n_nationkey % 4 <> 0
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'unknown_policy', lower(c_mktsegment) FROM customer
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'weak_secret', NULL FROM customer WHERE c_custkey % 2 <> 0 AND length(c_name) < 32
"""


def display_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of orders in the order of display."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus")
    kind = F.when(F.col("o_orderstatus") == "F", "dz-passport").otherwise("dz-id")
    rows = o.select("o_orderkey", kind.alias("kind"), F.explode(F.array(*[F.lit(x) for x in ("sex", "front_nin", "mrz_line_1", "zz")])).alias("field"), F.col("o_orderstatus").alias("value"))
    return fields.visible_fields(rows, "o_orderkey").select("o_orderkey", "field", "place")


_DISPLAY = """
SELECT o_orderkey, unnest(['sex', 'front_nin', 'zz']) AS field, unnest([14, 4, 28]) AS place FROM orders
UNION ALL SELECT o_orderkey, 'mrz_line_1', 28 FROM orders WHERE o_orderstatus = 'F'
"""


QUERIES = {
    "retry_targets": (retry_targets, _RETRY),
    "stale_results": (stale_results, _STALE),
    "best_template": (best_template, _BEST),
    "match_quality": (match_quality, _MATCH),
    "zone_checks": (zone_checks, _ZONES),
    "category_sets": (category_sets, _CATEGORY),
    "distinct_readings": (distinct_readings, _READINGS),
    "transfer_tokens": (transfer_tokens, _TOKENS),
    "key_revocation": (key_revocation, _REVOKE),
    "url_forms": (url_forms, _URL),
    "configuration_problems": (configuration_problems, _CONFIG),
    "display_order": (display_order, _DISPLAY),
}
