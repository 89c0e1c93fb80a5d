"""Quality-rule, text and benchmark queries over the driver's tables (stand-ins for photos and readings)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.functions import numeric as N
from idloom.functions import text as X
from idloom.operators import image, quality, reports, tiles
from idloom.plans.common import table

# ---------------------------------------------------------------- rules over document texts

_RULES = """
  SELECT d.doc_id, d.lang,
    length(d.text) AS n_chars,
    length(regexp_replace(d.text, '[^ ]', '', 'g')) AS n_blanks,
    length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    length(regexp_replace(d.text, '[^A-Z]', '', 'g')) AS n_upper
  FROM documents d
"""
_CHECKS = """
  SELECT *, n_chars >= 250 AS long_enough, n_chars > 0 AND n_symbols <= 0.02 * n_chars AS few_symbols,
    n_chars > 0 AND n_upper <= 0.3 * n_chars AS few_upper, n_blanks >= 0.05 * n_chars AS has_blanks
  FROM m
"""


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "text")
    count = lambda chars: F.length("text") - F.length(F.translate("text", chars, ""))
    return docs.select("doc_id", "lang", F.length("text").alias("n_chars"), count(" ").alias("n_blanks"), count("#*$%&|<>").alias("n_symbols"), count("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"))


def _text_rules():
    n = F.col("n_chars")
    always = F.lit(True)
    return [
        ("long_enough", always, n >= 250, n, F.lit("move_closer")),
        ("few_symbols", always, (n > 0) & (F.col("n_symbols") <= 0.02 * n), F.col("n_symbols"), F.lit("avoid_glare")),
        ("few_upper", always, (n > 0) & (F.col("n_upper") <= 0.3 * n), F.col("n_upper"), F.lit("less_light")),
        ("has_blanks", always, F.col("n_blanks") >= 0.05 * n, F.col("n_blanks"), F.lit("hold_still")),
    ]


_SEVERITY = {"long_enough": "block", "few_symbols": "block", "few_upper": "block", "has_blanks": "warn"}


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir).withColumn("checks", quality.build_checks(_text_rules(), _SEVERITY))


def quality_gate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False accepts and rejects of the rules by language and first hint, over the labelled documents."""
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    # measured below the join: verdicts are shuffled, texts are not
    rows = _checked(spark, sf_dir).select("doc_id", "lang", *quality.summarise(F.col("checks"))).join(labels, "doc_id")
    return rows.groupBy("lang", "hint").agg(
        F.count("*").alias("total"),
        F.count_if((F.col("quality") == 0) & F.col("passed")).alias("bad_accepted"),
        F.count_if(F.col("quality") == 0).alias("bad_total"),
        F.count_if((F.col("quality") == 1) & ~F.col("passed")).alias("good_rejected"),
        F.count_if("flawless").alias("flawless"),
    )


_SUMMARY = f"""
WITH m AS ({_RULES}), c AS (SELECT c.*, labels.quality FROM ({_CHECKS}) c JOIN labels USING (doc_id)), e AS (
  SELECT *, long_enough AND few_symbols AND few_upper AS passed,
    CASE WHEN NOT long_enough THEN 'move_closer' WHEN NOT few_symbols THEN 'avoid_glare' WHEN NOT few_upper THEN 'less_light'
         WHEN NOT has_blanks THEN 'hold_still' ELSE 'ready' END AS hint
  FROM c)
SELECT lang, hint, count(*) AS total, CAST(count(*) FILTER (quality = 0 AND passed) AS BIGINT) AS bad_accepted,
  count(*) FILTER (quality = 0) AS bad_total, count(*) FILTER (quality = 1 AND NOT passed) AS good_rejected,
  count(*) FILTER (passed AND has_blanks) AS flawless
FROM e GROUP BY lang, hint
"""


def quality_checks_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    # explode() would add a filter on the array's size, pushed down with every measurement written out in it again; the
    # array is never empty
    rows = _checked(spark, sf_dir).select("doc_id", F.explode_outer("checks").alias("c"))
    return rows.select("doc_id", F.col("c.key").alias("check_id"), F.col("c.passed").alias("passed"), F.col("c.status").alias("status"))


_LONG = f"""
WITH m AS ({_RULES}), c AS ({_CHECKS}), l AS (
  SELECT doc_id, 'long_enough' AS check_id, long_enough AS passed, 'fail' AS bad FROM c
  UNION ALL SELECT doc_id, 'few_symbols', few_symbols, 'fail' FROM c
  UNION ALL SELECT doc_id, 'few_upper', few_upper, 'fail' FROM c
  UNION ALL SELECT doc_id, 'has_blanks', has_blanks, 'warn' FROM c)
SELECT doc_id, check_id, passed, CASE WHEN passed THEN 'pass' ELSE bad END AS status FROM l
"""


def frame_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of synthetic frames made from line items."""
    rows = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    frames = rows.select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 4).alias("sharpness"), (F.col("l_quantity") * 5).alias("paper"), (F.col("l_discount") / 4).alias("glare_ratio"), (F.col("l_tax") * 10).alias("illumination"))
    return frames.select("l_orderkey", "l_linenumber", quality.frame_score().alias("score"))


_SCORE = """
SELECT l_orderkey, l_linenumber, floor((0.45 * greatest(0.0, least(1.0, l_quantity * 4 / 120.0))
  + 0.15 * greatest(0.0, least(1.0, 1 - abs(l_quantity * 5 - 165.0) / 60.0))
  + 0.15 * greatest(0.0, least(1.0, 1 - (l_discount / 4) / 0.024))
  + 0.25 * greatest(0.0, least(1.0, l_tax * 10))) * 10000 + 0.5) / 10000 AS score FROM lineitem
"""


def best_of_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    frames = rows.select("l_orderkey", F.col("l_linenumber").alias("pos"), F.col("l_quantity").alias("score"), (F.col("l_returnflag") != "R").alias("passed"))
    return quality.best_frame(frames.groupBy("l_orderkey", "pos").agg(F.max("score").alias("score"), F.max("passed").alias("passed")), "l_orderkey")


_BEST = """
WITH f AS (SELECT l_orderkey, l_linenumber AS pos, max(l_quantity) AS score, max(l_returnflag <> 'R') AS passed FROM lineitem GROUP BY ALL)
SELECT l_orderkey, pos, score, passed FROM f QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY passed DESC, score DESC, pos) = 1
"""


def benchmark_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's summary over orders as cases."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    run = F.struct((F.col("o_orderkey") % 5).cast("long").alias("correct"), F.lit(5).cast("long").alias("total"), (F.col("o_orderkey") % 97).cast("long").alias("duration_ms"), (F.col("o_orderkey") % 11 == 0).alias("error"))
    cases = o.select(F.when(F.col("o_orderstatus") == "F", "reject").otherwise("accept").alias("expected"), (F.col("o_totalprice") > 150000).alias("passed"), (F.col("o_orderkey") % 1000).alias("quality_ms"), F.when(F.col("o_orderkey") % 2 == 0, run).alias("original_ocr"), F.when(F.col("o_orderkey") % 3 == 0, run).alias("prepared_ocr"))
    s = reports.benchmark_summary(cases)
    return s.select("total", "bad_accepted", "bad_total", "good_rejected", "good_total", "mean_quality_ms", *[F.col(f"{r}_ocr.{f}").alias(f"{r}_{f}") for r in ("original", "prepared") for f in ("documents", "errors", "correct_fields", "labeled_fields", "mean_ms")])


def _ocr_sql(name: str, m: int) -> str:
    on = f"FILTER (o_orderkey % {m} = 0)"
    return f"count(*) {on} AS {name}_documents, count(*) FILTER (o_orderkey % {m} = 0 AND o_orderkey % 11 = 0) AS {name}_errors, CAST(sum(o_orderkey % 5) {on} AS BIGINT) AS {name}_correct_fields, CAST(5 * count(*) {on} AS BIGINT) AS {name}_labeled_fields, CAST(floor(avg(o_orderkey % 97) {on} + 0.5) AS BIGINT) AS {name}_mean_ms"


_BENCH = f"""
SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 150000) AS bad_accepted, count(*) FILTER (o_orderstatus = 'F') AS bad_total,
  count(*) FILTER (o_orderstatus <> 'F' AND NOT o_totalprice > 150000) AS good_rejected, count(*) FILTER (o_orderstatus <> 'F') AS good_total,
  CAST(floor(avg(o_orderkey % 1000) + 0.5) AS BIGINT) AS mean_quality_ms, {_ocr_sql("original", 2)}, {_ocr_sql("prepared", 3)}
FROM orders
"""


def benchmark_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected against observed values, exact after trimming: benchmark passages against documents of the same number."""
    expected = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"), F.lit("text").alias("field"), F.col("text").alias("value"))
    observed = table(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("case_id"), F.lit("text").alias("field"), F.col("text").alias("value"))
    return reports.field_accuracy(expected, observed, "case_id")


_ACCURACY = """
SELECT b.item_id AS case_id, count(*) FILTER (d.text = trim(b.text)) AS correct, count(*) AS total
FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id GROUP BY b.item_id
"""

# ---------------------------------------------------------------- text functions


def normalize_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages", "page_id", "url")
    return p.select("page_id", X.normalize_identifier(F.col("url")).alias("identifier"))


_IDENT = "SELECT page_id, nullif(upper(regexp_replace(url, '[^0-9A-Za-z]', '', 'g')), '') AS identifier FROM pages"


def normalize_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO and day-first order dates, shifted to years that the eight-digit rule misreads; with and without that rule."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").withColumn("d", F.expr("o_orderdate + make_interval(cast(o_orderkey % 20 as int))"))
    iso, dmy = F.date_format("d", "yyyy-MM-dd"), F.date_format("d", "dd/MM/yyyy")
    return o.select("o_orderkey", X.normalize_date(iso, unicode=False).alias("from_iso"), X.normalize_date(dmy, unicode=False).alias("from_dmy"), X.normalize_date(iso, reference_compat=True, unicode=False).alias("from_iso_compat"))


_DATE = """
WITH o AS (SELECT o_orderkey, strftime(o_orderdate + to_years(CAST(o_orderkey % 20 AS INTEGER)), '%Y-%m-%d') AS iso FROM orders),
s AS (SELECT *, substr(iso, 1, 4) AS y, substr(iso, 6, 2) AS m, substr(iso, 9, 2) AS d FROM o),
c AS (SELECT *, lpad(m || d, 4, '0') AS cy, substr(y, 3, 2) AS cm, substr(y, 1, 2) AS cd FROM s)
SELECT o_orderkey, iso AS from_iso, iso AS from_dmy,
  CASE WHEN CAST(cm AS INT) BETWEEN 1 AND 12 AND CAST(cd AS INT) BETWEEN 1 AND
      (CASE WHEN CAST(cm AS INT) = 2 THEN (CASE WHEN (CAST(cy AS INT) % 4 = 0 AND CAST(cy AS INT) % 100 <> 0) OR CAST(cy AS INT) % 400 = 0 THEN 29 ELSE 28 END)
            WHEN CAST(cm AS INT) IN (4, 6, 9, 11) THEN 30 ELSE 31 END)
    THEN cy || '-' || cm || '-' || cd ELSE iso END AS from_iso_compat
FROM c
"""


def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's name against that of the part with the next number: pairs by an equi-join, so they spread by number."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_name")
    other = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    s = X.similarity(F.upper("p_name"), F.upper("other"))
    return p.join(other, "p_partkey").select("p_partkey", N.round_half_up(s, 6).alias("similarity"), (s >= 0.75).alias("close"))


_SIM = """
WITH n AS (SELECT a.p_partkey, upper(a.p_name) AS a, upper(b.p_name) AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
s AS (SELECT p_partkey, CASE WHEN a = b THEN 1.0 WHEN length(a) = 0 OR length(b) = 0 THEN 0.0 ELSE 1 - CAST(levenshtein(a, b) AS DOUBLE) / greatest(length(a), length(b)) END AS s FROM n)
SELECT p_partkey, floor(s * 1000000 + 0.5) / 1000000 AS similarity, s >= 0.75 AS close FROM s
"""


def script_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    mixed = F.concat(F.col("text"), F.lit(" لقب اسم"))
    shares = d.select("doc_id", X.script_shares(mixed).alias("s"))
    return shares.select("doc_id", N.round_half_up(F.col("s.arabic"), 6).alias("arabic"), (F.col("s.latin") >= 0.6).alias("latin_enough"))


_SCRIPT = r"""
WITH t AS (SELECT doc_id, text || ' لقب اسم' AS x FROM documents),
n AS (SELECT doc_id, length(regexp_replace(x, '[^\p{L}]', '', 'g')) AS letters, length(regexp_replace(regexp_replace(x, '[^\p{L}]', '', 'g'), '[^\p{Arabic}]', '', 'g')) AS arabic,
  length(regexp_replace(regexp_replace(x, '[^\p{L}]', '', 'g'), '[^\p{Latin}]', '', 'g')) AS latin FROM t)
SELECT doc_id, floor(CAST(arabic AS DOUBLE) / letters * 1000000 + 0.5) / 1000000 AS arabic, CAST(latin AS DOUBLE) / letters >= 0.6 AS latin_enough FROM n
"""


def digit_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys written in Arabic-Indic digits, folded back."""
    o = table(spark, sf_dir, "orders", "o_orderkey")
    written = F.translate(F.col("o_orderkey").cast("string"), "0123456789", X.ARABIC_DIGITS)
    return o.select("o_orderkey", X.fold_digits(written).alias("folded"), X.has_digits(written).alias("has_digits"))


_FOLD = "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS folded, true AS has_digits FROM orders"


def printed_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a printed label or title as whole words."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", X.holds_printed_label(F.col("text")).alias("has_label"))


_LABEL = "SELECT doc_id, list_bool_or(list_transform([{}], lambda p: contains(' ' || trim(regexp_replace(upper(strip_accents(text)), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ', ' ' || p || ' '))) AS has_label FROM documents".format(", ".join("'" + p + "'" for p in X.printed_phrases()))


def digit_confusables(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    found = X.confusable_letters(F.col("c_mktsegment"))
    return c.select("c_custkey", F.array_join(found, ",").alias("letters"), (F.size(found) > 0).alias("warned"))


_CONFUSE = """
SELECT c_custkey, coalesce(array_to_string(list_filter(list_distinct_ordered, lambda x: true), ','), '') AS letters, len(list_distinct_ordered) > 0 AS warned
FROM (SELECT c_custkey, list_filter(regexp_extract_all(c_mktsegment, '[OIZSGB]'), lambda x, i: list_position(regexp_extract_all(c_mktsegment, '[OIZSGB]'), x) = i) AS list_distinct_ordered FROM customer)
"""


def text_hygiene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome of the last hygiene check of every document's text, with a limit of 2,000 characters."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    checks = X.hygiene_outcomes(F.col("text"), 2000)
    return d.select("doc_id", F.element_at(checks, -1).alias("c")).select("doc_id", F.col("c.check").alias("last_check"), F.col("c.outcome").alias("outcome"))


_HYGIENE = r"""
WITH t AS (SELECT doc_id, text, trim(text, E' \t\n\r\u000b\u000c ﻿　') AS n FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(text, '[\x00-\x08\x0b-\x1f\x7f-\x9f]') THEN 'control_chars' WHEN upper(n) IN ('', 'N/A', 'NA', 'UNKNOWN', 'NONE', 'NULL', '-', '--', '?', '???') THEN 'placeholder'
   WHEN length(n) > 2000 THEN 'max_length' WHEN regexp_matches(n, '(?i)^```|\*\*|^Here (is|are)\b|^The \w+ is\b') THEN 'model_prose' ELSE 'max_length' END AS last_check,
  CASE WHEN regexp_matches(text, '[\x00-\x08\x0b-\x1f\x7f-\x9f]') OR upper(n) IN ('', 'N/A', 'NA', 'UNKNOWN', 'NONE', 'NULL', '-', '--', '?', '???') OR length(n) > 2000
   OR regexp_matches(n, '(?i)^```|\*\*|^Here (is|are)\b|^The \w+ is\b') THEN 'failed' ELSE 'passed' END AS outcome FROM t
"""

# ---------------------------------------------------------------- numbers and photos


def tile_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discrete percentiles and population variances of values by hour tiles."""
    e = table(spark, sf_dir, "events", "ts", "value")
    tile = e.groupBy(F.hour("ts").cast("long").alias("tile"))
    return tile.agg(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY value)").alias("p90"), F.expr("percentile_disc(0.02) WITHIN GROUP (ORDER BY value)").alias("p2"), N.round_half_up(F.var_pop("value"), 6).alias("variance"))


_TILE = "SELECT hour(ts) AS tile, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.02) AS p2, floor(var_pop(value) * 1000000 + 0.5) / 1000000 AS variance FROM events GROUP BY 1"


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select("image_id", "valid", *[N.round_half_up(F.col(m), 6).alias(m) for m in image.METRICS])


def image_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photo measurements of 8 x 8 images made from embeddings (64 numbers each, as gray levels)."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    level = lambda v: F.lpad(F.hex(F.floor(N.clamp01((v.cast("double") + 1) / 2) * 255).cast("long")), 2, "0")
    rgba = F.unhex(F.array_join(F.transform("embedding", lambda v: F.concat(level(v), level(v), level(v), F.lit("FF"))), ""))
    images = e.select(F.col("vec_id").alias("image_id"), F.lit(8).alias("width"), F.lit(8).alias("height"), rgba.alias("rgba"))
    return _rounded(image.measure_images(images))


def tiled_image_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of 48 x 32 images with colours and white blobs, made from 24 embeddings each and measured in bands of
    eight rows; the last image may be incomplete and then isn't valid."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    place = lambda j: F.col("vec_id") % 24 * 64 + j
    two = lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")

    def pixel(v, j):
        u, p = F.floor(N.clamp01((v.cast("double") * 2 + 1) / 2) * 255), place(j)
        coloured = F.concat(two(u), two(F.least(F.lit(255), u + p % 5 * 20)), two(F.when(p % 11 == 0, 255 - u).otherwise(u)), F.lit("FF"))
        return F.when(u >= 128, F.lit("FFFFFFFF")).otherwise(coloured)

    lines = e.select((F.col("vec_id") / 24).cast("long").alias("image_id"), (F.col("vec_id") % 24).alias("k"), F.array_join(F.transform("embedding", pixel), "").alias("line"))
    whole = lines.groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda r: r["line"]), "").alias("hex"))
    images = whole.select("image_id", F.lit(48).alias("width"), F.lit(32).alias("height"), F.unhex("hex").alias("rgba"))
    return _rounded(tiles.measure_tiled(images, band_bytes=48 * 4 * 8))


def _photo_sql(pixels: str, images: str) -> str:
    """Measurements of ``px`` (image_id, w, h, y, x, r, g, b), by neighbours from windows and blobs by reachability."""
    r6 = lambda x: f"floor(({x}) * 1000000.0 + 0.5) / 1000000.0"
    part = lambda values, share: f"list_sort({values})[greatest(1, CAST(ceil(len({values}) * {share}::DOUBLE) AS BIGINT))]"
    return f"""
WITH RECURSIVE px AS ({pixels}), im AS ({images}),
g AS MATERIALIZED (SELECT *, (77 * r + 150 * g + 29 * b) >> 8 AS v, greatest(r, g, b) AS top, least(r, g, b) AS low FROM px),
m AS (SELECT image_id, any_value(w) AS w, any_value(h) AS h, list(v) AS vs, count(*) AS n, avg(v) AS mean, count(*) FILTER (v >= 250) / count(*) AS highlight_clip, count(*) FILTER (v <= 8) / count(*) AS shadow_clip,
  count(*) FILTER (top >= 252 AND top - low <= 24) / count(*) AS glare_ratio, count(*) FILTER (top >= 220 AND top > 0 AND top - low >= 0.25::DOUBLE * top) / count(*) AS color_glare_ratio FROM g GROUP BY image_id),
up AS (SELECT *, lag(v) OVER q AS n, lead(v) OVER q AS s FROM g WINDOW q AS (PARTITION BY image_id, x ORDER BY y)),
nb AS (SELECT *, lag(v) OVER q AS we, lead(v) OVER q AS ea, lag(n) OVER q AS nw, lead(n) OVER q AS ne, lag(s) OVER q AS sw, lead(s) OVER q AS se FROM up WINDOW q AS (PARTITION BY image_id, y ORDER BY x)),
f AS MATERIALIZED (SELECT image_id, least(2, y * 3 // h) * 4 + least(3, x * 4 // w) AS tile, n + s + we + ea - 4 * v AS lap, ne + 2 * ea + se - nw - 2 * we - sw AS gx, sw + 2 * s + se - nw - 2 * n - ne AS gy, abs(4 * v - 2 * (n + s + we + ea) + nw + ne + sw + se) AS response FROM nb WHERE y BETWEEN 1 AND h - 2 AND x BETWEEN 1 AND w - 2),
k AS (SELECT image_id, list(least(abs(gx) + abs(gy), 4095)) AS strengths, CAST(count(*) * sum(lap * lap) - sum(lap) * sum(lap) AS DOUBLE) / (count(*) * count(*)) AS sharpness, CAST(sum(gx * gx) + sum(gy * gy) AS DOUBLE) / count(*) AS tenengrad,
  CAST(least(sum(gx * gx), sum(gy * gy)) AS DOUBLE) / greatest(1, sum(gx * gx), sum(gy * gy)) AS motion_isotropy FROM f GROUP BY image_id),
z AS (SELECT image_id, sqrt(pi() / 2) * avg(response) / 6 AS noise FROM f JOIN (SELECT image_id, {part("strengths", 0.7)} AS bound FROM k) USING (image_id) WHERE least(abs(gx) + abs(gy), 4095) <= bound GROUP BY image_id),
ts AS (SELECT image_id, list_sort(list(spread)) AS vs FROM (SELECT image_id, tile, avg(lap * lap) - avg(lap) * avg(lap) AS spread FROM f GROUP BY image_id, tile) GROUP BY image_id),
tc AS (SELECT image_id, list_filter(vs, lambda v: v >= 0.25::DOUBLE * vs[len(vs) // 2 + 1]) AS cs FROM ts),
li AS (SELECT image_id, list(v) AS vs FROM g, range(4) a(i), range(6) c(j) WHERE y >= i * h // 4 AND y < (i + 1) * h // 4 AND (y - i * h // 4) % 2 = 0 AND x >= j * w // 6 AND x < (j + 1) * w // 6 AND (x - j * w // 6) % 2 = 0 GROUP BY image_id, i, j),
lu AS (SELECT image_id, min(p) AS dark, max(p) AS light FROM (SELECT image_id, {part("vs", 0.9)} AS p FROM li) GROUP BY image_id),
cell AS MATERIALIZED (SELECT image_id, y // 4 AS cy, x // 4 AS cx FROM g GROUP BY ALL HAVING count(*) FILTER (top >= 252 AND top - low <= 24) >= 8),
reach AS (SELECT image_id, cy AS ay, cx AS ax, cy, cx FROM cell UNION SELECT r.image_id, r.ay, r.ax, c.cy, c.cx FROM reach r JOIN cell c ON c.image_id = r.image_id AND abs(c.cy - r.cy) + abs(c.cx - r.cx) = 1),
bl AS (SELECT image_id, max(n) AS cells FROM (SELECT image_id, ay, ax, count(*) AS n FROM reach GROUP BY ALL) GROUP BY image_id)
SELECT im.image_id, m.n IS NOT NULL AS valid, {r6("mean")} AS mean, {r6(part("m.vs", 0.9))} AS paper, {r6(part("m.vs", 0.02))} AS p2, {r6(part("m.vs", 0.98))} AS p98, {r6("highlight_clip")} AS highlight_clip, {r6("shadow_clip")} AS shadow_clip,
  {r6(f"({part('m.vs', 0.98)} - {part('m.vs', 0.02)}) / 255")} AS contrast, {r6("sharpness")} AS sharpness, {r6("tenengrad")} AS tenengrad, {r6("motion_isotropy")} AS motion_isotropy,
  CASE WHEN m.n IS NULL THEN NULL WHEN len(cs) >= 3 AND cs[len(cs) // 2 + 1] > 0 THEN {r6("cs[1] / cs[len(cs) // 2 + 1]")} ELSE 1.0 END AS focus_uniformity, {r6("glare_ratio")} AS glare_ratio,
  CASE WHEN m.n IS NOT NULL THEN {r6("coalesce(cells, 0) / (ceil(w / 4) * ceil(h / 4))")} END AS glare_blob, {r6("color_glare_ratio")} AS color_glare_ratio, {r6("CASE WHEN light > 0 THEN dark / light WHEN light = 0 THEN 0 END")} AS illumination, {r6("noise")} AS noise
FROM im LEFT JOIN m USING (image_id) LEFT JOIN k USING (image_id) LEFT JOIN z USING (image_id) LEFT JOIN tc USING (image_id) LEFT JOIN lu USING (image_id) LEFT JOIN bl USING (image_id)
"""


_IMAGES = _photo_sql(
    "SELECT vec_id AS image_id, 8 AS w, 8 AS h, j // 8 AS y, j % 8 AS x, u AS r, u AS g, u AS b FROM (SELECT vec_id, j, CAST(floor(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (CAST(embedding[j + 1] AS DOUBLE) + 1) / 2)) * 255) AS BIGINT) AS u FROM embeddings, range(64) t(j))",
    "SELECT vec_id AS image_id FROM embeddings",
)
_TILED = _photo_sql(
    """SELECT image_id, 48 AS w, 32 AS h, p // 48 AS y, p % 48 AS x, CASE WHEN u >= 128 THEN 255 ELSE u END AS r, CASE WHEN u >= 128 THEN 255 ELSE least(255, u + p % 5 * 20) END AS g, CASE WHEN u >= 128 THEN 255 WHEN p % 11 = 0 THEN 255 - u ELSE u END AS b
  FROM (SELECT vec_id // 24 AS image_id, vec_id % 24 * 64 + j AS p, CAST(floor(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (CAST(embedding[j + 1] AS DOUBLE) * 2 + 1) / 2)) * 255) AS BIGINT) AS u, count(*) OVER (PARTITION BY vec_id // 24) AS n FROM embeddings, range(64) t(j)) WHERE n = 1536""",
    "SELECT DISTINCT vec_id // 24 AS image_id FROM embeddings",
)


QUERIES = {
    "quality_gate_summary": (quality_gate_summary, _SUMMARY),
    "quality_checks_long": (quality_checks_long, _LONG),
    "frame_score": (frame_score, _SCORE),
    "best_of_burst": (best_of_burst, _BEST),
    "benchmark_summary": (benchmark_summary, _BENCH),
    "benchmark_accuracy": (benchmark_accuracy, _ACCURACY),
    "normalize_identifier": (normalize_identifier, _IDENT),
    "normalize_date": (normalize_date, _DATE),
    "name_similarity": (name_similarity, _SIM),
    "script_ratio": (script_ratio, _SCRIPT),
    "digit_fold": (digit_fold, _FOLD),
    "printed_label": (printed_label, _LABEL),
    "digit_confusables": (digit_confusables, _CONFUSE),
    "text_hygiene": (text_hygiene, _HYGIENE),
    "tile_percentile": (tile_percentile, _TILE),
    "image_metrics": (image_metrics, _IMAGES),
    "tiled_image_metrics": (tiled_image_metrics, _TILED),
}
