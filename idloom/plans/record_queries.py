"""Queries of record-level rules over the driver's tables: values, memories, retries, tenants, views and leases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from idloom import dims
from idloom.functions import text as X
from idloom.operators import fields, linkage, reports, sweeps, tenancy
from idloom.plans.common import table


def _one_of(index: Column, *values: str | None) -> Column:
    return F.get(F.array(*map(F.lit, values)), (index % len(values)).cast("int"))


def _named(**values: Column) -> Column:
    """Rows (field, value) to explode."""
    return F.array(*[F.struct(F.lit(n).alias("field"), v.cast("string").alias("value")) for n, v in values.items()])


def usable_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers as fields of an order's reading, of which some failed or were unreadable."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_partkey")
    field = _one_of(F.col("l_linenumber"), "nin", "sex", "mrz_line_1", "mrz_line_2")
    failed = F.when(F.col("l_partkey") % 3 == 0, F.array(F.lit("nin"), F.lit("mrz"))).when(F.col("l_partkey") % 3 == 1, F.array(F.lit("mrz_line_1")))
    unread = F.when(F.col("l_partkey") % 5 == 0, F.array(F.lit("sex")))
    rows = li.select("l_orderkey", field.alias("field"), "l_returnflag", failed.alias("failed"), unread.alias("unread"))
    value = linkage.usable(F.col("l_returnflag"), F.col("field"), F.col("failed"), F.col("unread"))
    return rows.select("l_orderkey", "field", value.alias("value"))


_USABLE = """
WITH r AS (SELECT l_orderkey, ['nin', 'sex', 'mrz_line_1', 'mrz_line_2'][l_linenumber % 4 + 1] AS field, l_returnflag AS v, l_partkey AS p FROM lineitem)
SELECT l_orderkey, field, CASE WHEN field = 'nin' AND p % 3 = 0 THEN NULL WHEN field = 'sex' AND p % 5 = 0 THEN NULL WHEN field = 'mrz_line_1' AND p % 3 < 2 THEN NULL WHEN field = 'mrz_line_2' AND p % 3 = 0 THEN NULL ELSE v END AS value FROM r
"""


def invalid_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """National numbers that aren't 18 digits, birth dates that don't exist or lie after 1998."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_custkey")
    nin = F.when(F.col("o_custkey") % 4 != 0, F.lpad(F.col("o_orderkey").cast("string"), 18, "0")).when(F.col("o_custkey") % 8 == 0, F.lit("12 34"))
    birth = F.when(F.col("o_custkey") % 5 == 0, F.lit("2000-02-30")).when(F.col("o_custkey") % 5 == 1, F.lit(" ")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = o.select("o_orderkey", nin.alias("nin"), birth.alias("birth"))
    return rows.select("o_orderkey", F.array_join(fields.invalid_values(F.col("nin"), F.col("birth"), F.lit("1998-12-31").cast("date")), ",").alias("invalid"))


_INVALID = """
WITH r AS (SELECT o_orderkey, o_custkey % 8 = 0 AS bad_nin, CASE o_custkey % 5 WHEN 0 THEN true WHEN 1 THEN false ELSE o_orderdate::DATE > DATE '1998-12-31' END AS bad_birth FROM orders)
SELECT o_orderkey, concat_ws(',', CASE WHEN bad_nin THEN 'nin' END, CASE WHEN bad_birth THEN 'dateOfBirth' END) AS invalid FROM r
"""


def document_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed reports that concern the document itself: by their failed checks, else by their failed fields."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_custkey")
    one = lambda c: F.when(c.isNotNull(), F.array(c))
    checks = one(_one_of(F.col("o_custkey"), "front_nin", "document_type", None, "blood_group", None, None))
    failed = one(_one_of(F.col("o_custkey"), "photo", "nin", "nationality", "x", "category_entries.0", None))
    status = F.when(F.col("o_orderstatus") == "F", "failed").otherwise("passed")
    return o.select("o_orderkey", fields.document_failed(status, _one_of(F.col("o_orderkey"), "passed", "failed"), checks, failed).alias("document_failed"))


_DOCUMENT_FAILED = """
SELECT o_orderkey, (o_orderstatus = 'F' OR o_orderkey % 2 = 1) AND o_custkey % 6 IN (1, 5) AS document_failed FROM orders
"""


def readable_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is remembered of an order: its new reading over an older one, where both are of one holder."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    k = F.col("o_orderkey")
    new = _named(nin=F.when(k % 3 != 0, F.col("o_custkey")), sex=F.when(k % 2 == 0, F.col("o_orderstatus")), nationality=F.when(k % 5 == 0, F.lit("DZ")))
    old = _named(nin=F.when(k % 4 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")), sex=F.lit("old"), surname_latin=F.col("o_orderpriority"))
    each = lambda values: o.select("o_orderkey", F.explode(values).alias("v")).select("o_orderkey", "v.*")
    accepted = o.select("o_orderkey", (k % 7 == 0).alias("failed"), F.when(k % 11 == 0, F.array(F.lit("sex"))).alias("rejected"), (k % 13 == 0).alias("same_capture"))
    return fields.readable_memory(each(new), each(old), accepted, "o_orderkey")


_MEMORY = """
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, o_orderpriority AS p, o_orderkey % 3 <> 0 AND o_orderkey % 4 <> 0 AS same FROM orders WHERE o_orderkey % 7 <> 0),
r AS (SELECT k, same OR k % 13 = 0 AS old, unnest(['nin', 'sex', 'nationality', 'surname_latin']) AS field,
  unnest([CASE WHEN k % 3 <> 0 THEN c::VARCHAR END, CASE WHEN k % 2 = 0 THEN s END, CASE WHEN k % 5 = 0 THEN 'DZ' END, NULL]) AS now,
  unnest([CASE WHEN k % 4 = 0 THEN (c + 1)::VARCHAR ELSE c::VARCHAR END, 'old', NULL, p]) AS was FROM o)
SELECT k AS o_orderkey, field, coalesce(now, CASE WHEN old THEN was END) AS value FROM r WHERE coalesce(now, CASE WHEN old THEN was END) IS NOT NULL AND NOT (field = 'sex' AND k % 11 = 0)
"""


def fill_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank canonical fields of orders from reused readings that agree and aren't in conflict."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    k = F.col("o_orderkey")
    explode = lambda rows: o.select("o_orderkey", F.explode(rows).alias("v")).select("o_orderkey", "v.*")
    own = explode(_named(nin=F.when(k % 2 == 0, F.col("o_custkey")), lastNameLatin=F.when(k % 3 == 0, F.lit("Own")), expiryDate=F.lit(None)))
    reused = explode(_named(personal_number=F.col("o_custkey") + 7, surname_latin=F.lit("A"), nom_latin=F.when(k % 5 == 0, F.lit("B")).otherwise(F.lit("A"))))
    sources = o.where("o_orderkey % 7 = 0").select("o_orderkey", F.lit("front_nin").alias("field"), F.lit("conflict").alias("source"))
    return fields.fill_canonical(own, reused, sources, "o_orderkey")


_FILL = """
SELECT o_orderkey, unnest(['nin', 'lastNameLatin', 'expiryDate']) AS field,
  unnest([CASE WHEN o_orderkey % 2 = 0 THEN o_custkey::VARCHAR WHEN o_orderkey % 7 <> 0 THEN (o_custkey + 7)::VARCHAR END, CASE WHEN o_orderkey % 3 = 0 THEN 'Own' WHEN o_orderkey % 5 <> 0 THEN 'A' END, NULL]) AS value FROM orders
"""


def lineage_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The side that each traced fact of an order came from."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus")
    k = F.col("o_orderkey")
    kind = F.when(k % 3 == 0, "dz-passport").otherwise("dz-id").alias("kind")
    values = {"surname_latin": k % 5 != 0, "front_birth_date": k % 4 == 0, "date_of_birth": k % 4 == 1, "gender": k % 4 != 2, "last_name_ar": k % 5 == 2, "personal_number": k >= 0, "documentNumber": k >= 0}
    merged = o.select("o_orderkey", kind, F.explode(_named(**{n: F.when(c, F.lit("x")) for n, c in values.items()})).alias("v")).select("o_orderkey", "kind", "v.*")
    source = F.when(F.col("o_orderstatus") == "F", "front").when(F.col("o_orderstatus") == "O", "back").otherwise("conflict")
    sources = o.where("o_orderkey % 2 = 0").select("o_orderkey", kind, F.explode(F.array(*map(F.lit, values))).alias("field"), source.alias("source"))
    held = o.where("o_orderkey % 7 <> 0").select("o_orderkey", kind, F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.lit(f).alias("field")) for s, f in (("back", "surname_latin"), ("front", "birth_date"), ("back", "birth_date"), ("back", "sex"), ("front", "front_given_name_ar"))])).alias("h"))
    held = held.select("o_orderkey", "kind", "h.side", "h.field", F.lit("x").alias("value"))
    return fields.field_sides(merged, sources, held, "o_orderkey").select("o_orderkey", "canonical", "side")


_LINEAGE = """
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 3 = 0 AS passport, CASE WHEN o_orderkey % 2 = 0 THEN CASE o_orderstatus WHEN 'F' THEN 'front' WHEN 'O' THEN 'back' ELSE 'neither' END END AS src, o_orderkey % 7 <> 0 AS kept FROM orders),
r AS (SELECT k, passport, src, unnest(['lastNameLatin', 'firstNameLatin', 'lastNameArabic', 'firstNameArabic', 'nin', 'dateOfBirth', 'sex']) AS canonical,
  unnest([k % 5 <> 0, false, k % 5 = 2, false, true, k % 4 < 2, k % 4 <> 2]) AS read, unnest([CASE WHEN kept THEN 'back' END, NULL, NULL, NULL, NULL, CASE WHEN kept THEN 'front' END, CASE WHEN kept THEN 'back' END]) AS holder FROM o)
SELECT k AS o_orderkey, canonical, CASE WHEN read AND src IN ('front', 'back') THEN src WHEN read AND src IS NOT NULL THEN NULL WHEN passport THEN 'single' ELSE holder END AS side FROM r
"""


def side_for_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The side of an order with most missing fields."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    pos = F.col("l_partkey") % 2
    return fields.side_for_missing(li.select("l_orderkey", pos.alias("pos"), F.when(pos == 0, "front").otherwise("back").alias("side"), F.col("l_linenumber").cast("string").alias("field")), "l_orderkey")


_SIDE_MISSING = """
SELECT l_orderkey, CASE WHEN count(DISTINCT l_linenumber) FILTER (l_partkey % 2 = 0) >= count(DISTINCT l_linenumber) FILTER (l_partkey % 2 = 1) THEN 'front' ELSE 'back' END AS side FROM lineitem GROUP BY 1
"""


def display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw JSON values of parts for display and for comparison."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_brand")
    b = F.col("p_brand")
    quoted = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    raw = (
        F.when(F.col("p_size") % 5 == 0, quoted(" ", b, " "))
        .when(F.col("p_size") % 5 == 1, quoted('["', b, '", "C"]'))
        .when(F.col("p_size") % 5 == 2, quoted('{"value": "', b, '"}'))
        .when(F.col("p_size") % 5 == 3, quoted('[{"category": "', b, '", "date_of_issue": "2020", "restrictions": ""}, {"category": "Z"}]'))
    )
    field = F.when(F.col("p_size") % 5 == 3, "category_entries").otherwise("name")
    rows = p.select("p_partkey", field.alias("field"), raw.alias("raw"))
    return rows.select("p_partkey", fields.display_value(F.col("field"), F.col("raw")).alias("shown"), fields.comparison_value(F.col("raw")).alias("compared"))


_DISPLAY_VALUES = r"""
SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN p_brand WHEN 1 THEN p_brand || ', C' WHEN 2 THEN p_brand WHEN 3 THEN p_brand || ' · 2020' || chr(10) || 'Z' END AS shown,
  CASE p_size % 5 WHEN 0 THEN ' ' || p_brand || ' ' WHEN 1 THEN p_brand || ', C' WHEN 3 THEN p_brand || ', Z' END AS compared FROM part
"""


def name_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names with marks and signs, for loose comparison and for continuity."""
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment")
    written = F.concat(F.lit(" Él-"), F.lower("c_mktsegment"), F.lit("  o'"), F.col("c_name"))
    return c.select("c_custkey", X.name_form(written).alias("name"), X.continuity_form(written).alias("form"))


_NAME_FORMS = r"""
WITH w AS (SELECT c_custkey, ' Él-' || lower(c_mktsegment) || '  o''' || c_name AS x FROM customer)
SELECT c_custkey, trim(regexp_replace(regexp_replace(upper(strip_accents(x)), '[^A-Z\s]', ' ', 'g'), '\s+', ' ', 'g')) AS name, upper(regexp_replace(x, '\s+', '', 'g')) AS form FROM w
"""

# ---------------------------------------------------------------- retries


def retryable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any side of an order's conflict has attempts left."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    side = F.when(F.col("l_linenumber") % 2 == 1, "front").otherwise("back").alias("side")
    targets = li.select("l_orderkey", F.lit("dz-id").alias("kind"), side).distinct()
    attempts = li.where("l_partkey % 3 <> 0").groupBy("l_orderkey", F.lit("dz-id").alias("kind"), side).agg(F.max(F.col("l_partkey") % 4).alias("side_attempts")).withColumn("document_attempts", F.col("l_orderkey") % 4)
    return linkage.retryable(targets, attempts, "l_orderkey")


_RETRYABLE = """
WITH t AS (SELECT l_orderkey, l_linenumber % 2 AS side, max(l_partkey % 4) FILTER (l_partkey % 3 <> 0) AS used FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, bool_or(used IS NULL OR (used < 3 AND l_orderkey % 4 < 3)) AS retryable FROM t GROUP BY 1
"""


def retry_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document and side to photograph again first."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    kind = _one_of(F.col("l_linenumber"), "dz-id", "dz-driving-licence").alias("kind")
    side = F.when(F.col("l_partkey") % 2 == 1, "front").otherwise("back").alias("side")
    targets = li.select("l_orderkey", kind, side).distinct()
    exhausted = li.where("l_returnflag = 'R'").select("l_orderkey", kind, side).distinct()
    suggested = li.where("l_orderkey % 3 = 0").select("l_orderkey", F.lit("dz-id").alias("kind"))
    return linkage.retry_choice(targets, exhausted, suggested, "l_orderkey")


_RETRY_CHOICE = """
WITH t AS (SELECT l_orderkey, ['dz-id', 'dz-driving-licence'][l_linenumber % 2 + 1] AS kind, CASE WHEN l_partkey % 2 = 1 THEN 'front' ELSE 'back' END AS side, bool_or(l_returnflag = 'R') AS gone FROM lineitem GROUP BY ALL)
SELECT l_orderkey, kind, side FROM t WHERE NOT gone QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_orderkey % 3 = 0 AND kind = 'dz-id' THEN 0 ELSE 1 END, kind, side) = 1
"""

# ---------------------------------------------------------------- tenants


def application_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as tenants with names and destinations of every kind."""
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_name")
    name = F.when(F.col("s_suppkey") % 4 == 0, F.lit(" x ")).when(F.col("s_suppkey") % 4 == 1, F.repeat("s_name", F.lit(12))).otherwise(F.col("s_name"))
    url = _one_of(F.col("s_suppkey"), "https://a.example/x", "ftp://a.example", "http://u:p@a.example", None, "http://b.example", "no url", "https://c.example")
    return s.select("s_suppkey", F.array_join(tenancy.application_problems(name, url), ",").alias("problems"))


_APPLICATION = """
SELECT s_suppkey, concat_ws(',', CASE WHEN s_suppkey % 4 = 0 OR (s_suppkey % 4 = 1 AND length(s_name) * 12 > 100) THEN 'name' END, CASE WHEN s_suppkey % 7 IN (1, 2, 5) THEN 'url0' END) AS problems FROM supplier
"""


def _applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as tenants."""
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey", "c_acctbal")
    kinds = F.array(F.lit("dz-id"), F.when(F.col("c_custkey") % 2 == 0, "dz-passport").otherwise("dz-driving-licence"))
    url = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("http://h"), F.col("c_custkey"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("HTTPS://h"), F.col("c_custkey")))
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), kinds.alias("documents"), F.when(F.col("c_custkey") % 5 != 0, F.substring("c_name", 1, (F.col("c_custkey") % 2).cast("int"))).alias("webhook_secret"), F.when(F.col("c_acctbal") < 0, F.lit("v1")).alias("legacy"), url.alias("url"))


def public_application(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tenancy.public_application(_applications(spark, sf_dir)).drop("documents", "url")


_PUBLIC_APPLICATION = "SELECT c_custkey AS id, c_name AS name, c_custkey % 5 <> 0 AND c_custkey % 2 = 1 AS webhook_configured, c_acctbal < 0 AS imported FROM customer"


def unavailable_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    available = spark.createDataFrame([("dz-id", True), ("dz-passport", False)], "kind string, available boolean")
    return tenancy.unavailable_documents(_applications(spark, sf_dir), available)


_UNAVAILABLE = "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'dz-passport' ELSE 'dz-driving-licence' END AS kind FROM customer"


def insecure_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tenancy.insecure_destinations(_applications(spark, sf_dir), "url")


_INSECURE = "SELECT c_custkey AS id, 'http://h' || c_custkey AS url FROM customer WHERE c_custkey % 3 = 0"


def destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' destinations: the tenant's named one, else its main one."""
    o, c = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), table(spark, sf_dir, "customer", "c_custkey", "c_name")
    sessions = o.select("o_orderkey", F.col("o_custkey").alias("application_id"), F.when(F.col("o_orderkey") % 2 == 0, "alt").alias("destination_id"))
    targets = c.select(F.col("c_custkey").alias("application_id"), F.explode(F.array(F.lit("main"), F.lit("alt"))).alias("destination_id"), "c_name")
    targets = targets.where("NOT (destination_id = 'alt' AND application_id % 3 = 0)").withColumn("url", F.concat_ws("/", "c_name", "destination_id"))
    return tenancy.destinations(sessions, targets).select("o_orderkey", "destination_id", "url")


_DESTINATIONS = """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'alt' ELSE 'main' END AS destination_id, CASE WHEN o_orderkey % 2 = 1 THEN c_name || '/main' WHEN o_custkey % 3 <> 0 THEN c_name || '/alt' END AS url
FROM orders LEFT JOIN customer ON c_custkey = o_custkey
"""


def import_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of customers that no order has brought in before, with what is kept of their secret."""
    o, c = table(spark, sf_dir, "orders", "o_custkey", "o_orderstatus"), table(spark, sf_dir, "customer", "c_custkey", "c_name")
    incoming = tenancy.issue_keys(c.select(F.col("c_custkey").alias("id"), F.concat("c_name", F.lit("-secret")).alias("secret")))
    return tenancy.import_once(o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")), incoming)


_IMPORT = """
SELECT c_custkey AS id, substr(c_name || '-secret', 1, 17) AS prefix, sha256(c_name || '-secret') AS digest FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')
"""


def last_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' keys with the time of their last order."""
    o, c = table(spark, sf_dir, "orders", "o_custkey", "o_orderdate"), table(spark, sf_dir, "customer", "c_custkey")
    keys = c.select(F.col("c_custkey").alias("digest"), F.lit(None).cast("timestamp").alias("last_used_at"))
    return tenancy.last_used(keys, o.select(F.col("o_custkey").alias("digest"), F.col("o_orderdate").alias("at"))).select("digest", F.date_format("last_used_at", "yyyy-MM-dd").alias("last_used"))


_LAST_USED = "SELECT c_custkey AS digest, strftime(max(o_orderdate), '%Y-%m-%d') AS last_used FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"

# ---------------------------------------------------------------- views, leases, receipts


def _orders_as_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("client_reference"), F.when(F.col("o_orderstatus") == "F", "succeeded").otherwise("capturing").alias("status"), F.lit(None).cast("string").alias("reason_code"),
        F.col("o_orderdate").alias("updated_at"), F.lit("kept").alias("raw_response"), F.lit(1).cast("long").alias("version"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderdate")).alias("webhook_delivered_at"),
    )


def status_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tenant's sessions by its id, as it may see them."""
    return reports.status_view(sweeps.by_value(_orders_as_sessions(spark, sf_dir), "client_reference", 7)).drop("updated_at")


_STATUS_VIEW = "SELECT o_orderkey AS session_id, o_custkey AS client_reference, CASE o_orderstatus WHEN 'F' THEN 'succeeded' ELSE 'capturing' END AS status, NULL::VARCHAR AS reason_code FROM orders WHERE o_custkey = 7"


def newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions in the order of lists, with the place of each."""
    rows = sweeps.newest_first(_orders_as_sessions(spark, sf_dir), "updated_at", "session_id").limit(sweeps.dims.SWEEP_ROWS)
    return rows.select("session_id", "client_reference")


_NEWEST = f"SELECT o_orderkey AS session_id, o_custkey AS client_reference FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT {dims.SWEEP_ROWS}"


def tenant_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tenant's rows, newest first, with the place of each."""
    rows = sweeps.newest_first(sweeps.by_value(_orders_as_sessions(spark, sf_dir), "client_reference", 7), "updated_at", "session_id")
    place = F.row_number().over(Window.orderBy(F.col("updated_at").desc_nulls_last(), "session_id"))
    return rows.select("session_id", place.alias("place"), F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


_TENANT = "SELECT o_orderkey AS session_id, row_number() OVER (ORDER BY o_orderdate DESC NULLS LAST, o_orderkey)::INT AS place, strftime(o_orderdate, '%Y-%m-%d') AS updated FROM orders WHERE o_custkey = 7"


def deliver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions after their receipts: line items that came back."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_shipdate", "l_returnflag")
    receipts = li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("session_id"), F.col("l_shipdate").alias("at"))
    return sweeps.deliver(_orders_as_sessions(spark, sf_dir), receipts).select("session_id", "version", F.date_format("webhook_delivered_at", "yyyy-MM-dd").alias("delivered"))


_DELIVER = """
WITH r AS (SELECT l_orderkey, min(l_shipdate) AS t FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o_orderkey AS session_id, CASE WHEN o_orderkey % 4 <> 0 AND t IS NOT NULL THEN 2 ELSE 1 END::BIGINT AS version, strftime(CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate ELSE t END, '%Y-%m-%d') AS delivered FROM orders LEFT JOIN r ON l_orderkey = o_orderkey
"""


def claimable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides that a worker may take at noon of 2024-01-15: events as leases."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "event_type")
    state = F.when(F.col("event_type") == "view", "ready").when(F.col("event_type") == "click", "pending").otherwise("processing")
    rows = e.select("event_id", state.alias("state"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("leased_at_ms"))
    return sweeps.claimable(rows, 1_705_320_000_000).select("event_id", "state")


_CLAIMABLE = """
SELECT event_id, CASE event_type WHEN 'click' THEN 'pending' ELSE 'processing' END AS state FROM events WHERE event_type = 'click' OR (event_type <> 'view' AND epoch_us(ts) // 1000 + 240000 <= 1705320000000)
"""


def flatten_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' values as groups of metrics, flattened."""
    e = table(spark, sf_dir, "events", "event_id", "value", "user_id")
    groups = F.create_map(F.lit("light"), F.create_map(F.lit("level"), F.col("value") / 7, F.lit("user"), F.col("user_id").cast("double")), F.lit("shape"), F.create_map(F.lit("fill"), F.col("value") / 3))
    rows = e.select("event_id", F.explode(reports.flatten_metrics(groups)).alias("metric", "value"))
    return rows.select("event_id", "metric", "value")


_FLATTEN = "SELECT event_id, unnest(['light.level', 'light.user', 'shape.fill']) AS metric, unnest([floor(value / 7 * 10000 + 0.5) / 10000, user_id::DOUBLE, floor(value / 3 * 10000 + 0.5) / 10000]) AS value FROM events"


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as services: healthy without an error on the event's kind and hour."""
    e = table(spark, sf_dir, "events", "user_id", "event_type", "value")
    found = reports.health(e.select("user_id", ((F.col("event_type") != "error") | (F.col("value") < 50)).alias("ready")), "user_id")
    return reports.metric_lines(found.select(F.concat(F.lit("healthy_"), F.col("user_id")).alias("name"), F.col("healthy").cast("int").alias("value")))


_HEALTH = "SELECT 'healthy_' || user_id || ' ' || bool_and(event_type <> 'error' OR value < 50)::INT AS line FROM events GROUP BY user_id"


def object_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_returnflag")
    rows = li.select(F.col("l_orderkey").alias("session_id"), F.concat_ws("/", "l_orderkey", "l_partkey").alias("object_key"), F.when(F.col("l_returnflag") == "A", F.concat_ws("/", "l_orderkey", "l_partkey", F.lit("ocr"))).alias("ocr_object_key"))
    return reports.object_keys(rows)


_OBJECTS = """
SELECT l_orderkey AS session_id, l_orderkey || '/' || l_partkey AS object_key FROM lineitem
UNION ALL SELECT l_orderkey, l_orderkey || '/' || l_partkey || '/ocr' FROM lineitem WHERE l_returnflag = 'A'
"""


QUERIES = {
    "usable_values": (usable_values, _USABLE),
    "invalid_values": (invalid_values, _INVALID),
    "document_failed": (document_failed, _DOCUMENT_FAILED),
    "readable_memory": (readable_memory, _MEMORY),
    "fill_canonical": (fill_canonical, _FILL),
    "lineage_side": (lineage_side, _LINEAGE),
    "side_for_missing": (side_for_missing, _SIDE_MISSING),
    "display_values": (display_values, _DISPLAY_VALUES),
    "name_forms": (name_forms, _NAME_FORMS),
    "retryable": (retryable, _RETRYABLE),
    "retry_choice": (retry_choice, _RETRY_CHOICE),
    "application_problems": (application_problems, _APPLICATION),
    "public_application": (public_application, _PUBLIC_APPLICATION),
    "unavailable_documents": (unavailable_documents, _UNAVAILABLE),
    "insecure_destinations": (insecure_destinations, _INSECURE),
    "destinations": (destinations, _DESTINATIONS),
    "import_once": (import_once, _IMPORT),
    "last_used": (last_used, _LAST_USED),
    "status_view": (status_view, _STATUS_VIEW),
    "newest_first": (newest_first, _NEWEST),
    "tenant_newest": (tenant_newest, _TENANT),
    "deliver": (deliver, _DELIVER),
    "claimable": (claimable, _CLAIMABLE),
    "flatten_metrics": (flatten_metrics, _FLATTEN),
    "health": (health, _HEALTH),
    "object_keys": (object_keys, _OBJECTS),
}
