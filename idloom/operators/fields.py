"""The field pipeline: from raw extraction payloads to canonical, complete and valid fields.

Fields are long tables (…keys, field, value); a row with a null value says that the field was named without a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idloom import dims
from idloom.functions import text as X


def field_object(payload: Column) -> Column:
    """The first JSON object among the places where a payload (JSON text) may hold its fields, as JSON text."""
    places = [F.get_json_object(payload, p) for p in ("$.mergedFields", "$.merged_fields", "$.fields", "$.result.fields")]
    return F.coalesce(*[F.when(F.ltrim(p).startswith("{"), p) for p in places])


def unwrap_fields(payloads: DataFrame, payload: str, *keys: str) -> DataFrame:
    """(…keys, field, value) of a payload column: ``{"value": x}`` is unwrapped, blank values are null, others are text."""
    raw = F.from_json(field_object(F.col(payload)), "map<string,string>")
    rows = payloads.select(*keys, F.explode(raw).alias("field", "raw"))
    wrapped = F.ltrim("raw").startswith("{") & F.array_contains(F.json_object_keys("raw"), "value")
    value = F.when(F.coalesce(wrapped, F.lit(False)), F.get_json_object("raw", "$.value")).otherwise(F.col("raw"))
    return rows.select(*keys, "field", F.nullif(X.trim_unicode(value), F.lit("")).alias("value"))


def display_value(field: Column, raw: Column) -> Column:
    """A raw JSON value for display: lists joined by a comma, category entries one a line."""
    inner = F.when(F.coalesce(F.array_contains(F.json_object_keys(raw), "value"), F.lit(False)), F.get_json_object(raw, "$.value")).otherwise(raw)
    is_list = F.ltrim(inner).startswith("[")
    plain = F.array_join(F.from_json(inner, "array<string>"), ", ")
    entries = F.from_json(inner, "array<struct<category:string,date_of_issue_printed:string,date_of_issue:string,date_of_expiry_printed:string,date_of_expiry:string,restrictions:string>>")
    line = lambda e: F.concat_ws(" · ", *[F.nullif(c, F.lit("")) for c in (e["category"], F.coalesce(e["date_of_issue_printed"], e["date_of_issue"]), F.coalesce(e["date_of_expiry_printed"], e["date_of_expiry"]), e["restrictions"])])
    listed = F.when(field == "category_entries", F.array_join(F.transform(entries, line), "\n")).otherwise(plain)
    return F.nullif(F.when(is_list, listed).otherwise(X.trim_unicode(inner)), F.lit(""))


def canonicalise(fields: DataFrame, *keys: str, reference_compat: bool = False) -> DataFrame:
    """``fields`` with one row more for each canonical field: the best alias with a value, typed. Original names stay.

    Each key's fields meet in one aggregation (a document's fields are few), and every row is read once."""
    filled = F.length(X.trim_unicode(F.col("value"))) > 0
    forms = {c: [form for n in names for form in (n, f"front_{n}", f"back_{n}")] for c, names in dims.ALIASES.items()}
    rank = lambda names: F.array_position(F.array(*map(F.lit, names)), F.col("field"))
    best = [F.min_by(F.when(filled & (rank(names) > 0), F.col("value")), F.when(filled & (rank(names) > 0), rank(names))).alias(f"_{c}") for c, names in forms.items()]
    kept = F.when(~F.col("field").isin(list(dims.ALIASES)), F.struct("field", "value"))
    rows = fields.groupBy(*keys).agg(F.collect_list(kept).alias("_own"), *best)
    typed = []
    for c in dims.ALIASES:
        value = F.col(f"_{c}")
        if c == "nin":
            value = X.normalize_identifier(value)
        elif c in ("dateOfBirth", "expiryDate"):
            value = F.coalesce(X.normalize_date(value, reference_compat), value)
        typed.append(F.struct(F.lit(c).alias("field"), value.alias("value")))
    rows = rows.select(*keys, "_own", F.array(*typed).alias("_typed"))
    return rows.select(*keys, F.explode(F.concat("_own", "_typed")).alias("_f")).select(*keys, "_f.*")


def same_holder(pairs: DataFrame, *keys: str) -> DataFrame:
    """(…keys, same) from (…keys, field, prior, current): shared strong identifiers must all agree; without any, the same
    birth date and one equal name are asked for."""
    both = (X.blank_to_null(F.col("prior")).isNotNull()) & (X.blank_to_null(F.col("current")).isNotNull())
    equal = X.continuity_form(F.col("prior")) == X.continuity_form(F.col("current"))
    strong, name = F.col("field").isin(dims.STRONG_KEYS) & both, F.col("field").isin(dims.NAME_KEYS) & both
    birth = (F.col("field") == "date_of_birth") & both & (F.col("prior") == F.col("current"))
    agg = pairs.groupBy(*keys).agg(F.count_if(strong).alias("strong"), F.count_if(strong & ~equal).alias("clash"), F.count_if(birth).alias("birth"), F.count_if(name & equal).alias("names"))
    return agg.select(*keys, F.when(F.col("clash") > 0, False).when(F.col("strong") > 0, True).otherwise((F.col("birth") > 0) & (F.col("names") > 0)).alias("same"))


def fill_from_prior(current: DataFrame, prior: DataFrame, *keys: str) -> DataFrame:
    """(…keys, field, value, reused): blanks of ``current`` filled from ``prior`` where both are of one holder. A key
    without current rows gets nothing."""
    cur = current.select(*keys, "field", F.col("value").alias("current"), F.lit(True).alias("here"))
    pairs = cur.join(prior.select(*keys, "field", F.col("value").alias("prior")), [*keys, "field"], "full_outer")
    known = pairs.join(same_holder(pairs, *keys), list(keys), "left").join(current.select(*keys).distinct(), list(keys), "left_semi")
    value, old = X.blank_to_null(F.col("current")), X.blank_to_null(F.col("prior"))
    reused = value.isNull() & old.isNotNull() & F.coalesce("same", F.lit(False))
    return known.where(F.coalesce("here", F.lit(False)) | reused).select(*keys, "field", F.when(reused, F.col("prior")).otherwise(F.col("current")).alias("value"), reused.alias("reused"))


def fill_canonical(fields: DataFrame, reused: DataFrame, sources: DataFrame, *keys: str) -> DataFrame:
    """Canonical fields without a value get the reused readings' value if all of them agree and no alias is in conflict."""
    names = F.broadcast(dims.aliases(fields.sparkSession))
    own = F.broadcast(dims.aliases(fields.sparkSession).where("rank % 3 = 0"))
    conflict = sources.where("source = 'conflict'").join(names, sources["field"] == names["name"]).select(*keys, F.col("canonical").alias("field")).distinct()
    candidates = reused.where(X.blank_to_null(F.col("value")).isNotNull()).withColumnRenamed("field", "raw").join(own, F.col("raw") == F.col("name")).groupBy(*keys, "canonical").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    agreed = candidates.where("low = high").select(*keys, F.col("canonical").alias("field"), F.col("low").alias("found")).join(conflict, [*keys, "field"], "left_anti")
    return fields.join(agreed, [*keys, "field"], "left").select(*keys, "field", F.coalesce(X.blank_to_null(F.col("value")), F.col("found")).alias("value"))


def missing_required(fields: DataFrame, *keys: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """(…keys, missing): required facts that no script's field holds, each pair of scripts named once. One aggregation of
    each key's field names."""
    wanted = list(dict.fromkeys([*dims.REQUIRED, *[f for f in extra if f in dims.EITHER_SCRIPT]]))
    filled = F.length(X.trim_unicode(F.col("value"))) > 0
    names = sorted({n for f in wanted for n in dims.EITHER_SCRIPT.get(f, [f])})
    held = fields.groupBy(*keys).agg(*[F.coalesce(F.bool_or((F.col("field") == n) & filled), F.lit(False)).alias(f"_{n}") for n in names])
    out: list[Column] = []
    for i, f in enumerate(wanted):
        either = dims.EITHER_SCRIPT.get(f, [f])
        if not [g for g in wanted[:i] if g in either]:
            out.append(F.when(~F.greatest(*[F.col(f"_{n}") for n in either]) if len(either) > 1 else ~F.col(f"_{f}"), F.lit(f)))
    return held.select(*keys, F.array_compact(F.array(*out)).alias("missing"))


def invalid_values(nin: Column, birth: Column, as_of: Column) -> Column:
    """Names of fields whose value can't be right: a national number that isn't 18 digits, a birth date that isn't a
    date or lies after ``as_of`` (a date)."""
    date = F.try_to_date(birth, "yyyy-MM-dd")
    bad_birth = X.blank_to_null(birth).isNotNull() & (date.isNull() | (date > as_of))
    bad_nin = X.blank_to_null(nin).isNotNull() & ~nin.rlike("^[0-9]{18}$")
    return F.array_compact(F.array(F.when(bad_nin, F.lit("nin")), F.when(bad_birth, F.lit("dateOfBirth"))))


def _bare(field: Column) -> Column:
    return F.regexp_replace(field, "^(front|back)_", "")


def is_identity_field(field: Column) -> Column:
    names = {n for c, ns in dims.ALIASES.items() if c not in ("documentNumber", "expiryDate") for n in [c, *ns]}
    return _bare(field).isin(sorted(names))


def is_optional_field(field: Column) -> Column:
    names = {"documentNumber", "expiryDate", *dims.ALIASES["documentNumber"], *dims.ALIASES["expiryDate"]}
    # Fixed value: fields that a document may lack.
    pattern = r"^(?:date_of_(?:issue|expiry)(?:_printed)?|date_of_birth_printed|sex|gender|nationality|blood_group|place_of_birth_(?:ar|latin)|issuing_authority_(?:ar|latin)|categories|category_entries|restrictions)(?:\.|$)"
    return _bare(field).isin(sorted(names)) | _bare(field).rlike(pattern)


def document_failed(status: Column, report_status: Column, failed_checks: Column, failed_fields: Column) -> Column:
    """Whether a failed report concerns the document itself. ``failed_checks`` is an array with the field of each failed
    check (null: none named); ``failed_fields`` is looked at where there are no such checks."""
    classified = lambda f: f.isNotNull() & (is_identity_field(f) | is_optional_field(f))
    failed = (status == "failed") | (report_status == "failed")
    checks, fields = F.coalesce(failed_checks, F.array().cast("array<string>")), F.coalesce(failed_fields, F.array().cast("array<string>"))
    by_fields = (F.size(fields) == 0) | F.exists(fields, lambda f: ~classified(f))
    return F.coalesce(failed, F.lit(False)) & F.when(F.size(checks) == 0, by_fields).otherwise(F.exists(checks, lambda f: ~classified(f)))


def readable_memory(values: DataFrame, previous: DataFrame, accepted: DataFrame, *keys: str) -> DataFrame:
    """What may be reused later: readable values over what was remembered, for accepted readings of one holder.

    ``accepted`` has (…keys, failed, rejected array, same_capture); a failed reading clears the memory.
    """
    ok = accepted.where("NOT failed").select(*keys, F.coalesce("rejected", F.array().cast("array<string>")).alias("rejected"), "same_capture")
    pairs = values.select(*keys, "field", F.col("value").alias("current")).join(previous.select(*keys, "field", F.col("value").alias("prior")), [*keys, "field"], "full_outer")
    known = pairs.join(same_holder(pairs, *keys), list(keys)).join(ok, list(keys)).where(~F.array_contains("rejected", F.col("field")))
    keep_old = F.coalesce("same_capture", F.lit(False)) | F.col("same")
    value = F.coalesce(X.blank_to_null(F.col("current")), F.when(keep_old, F.col("prior")))
    return known.select(*keys, "field", value.alias("value")).where("value IS NOT NULL")


def last_document_wins(fields: DataFrame, *keys: str) -> DataFrame:
    """(…keys, field, value) of the last document (by ``pos``) that names the field, also if its value is null."""
    return fields.groupBy(*keys, "field").agg(F.max_by(F.struct("value"), "pos").alias("_v")).select(*keys, "field", "_v.value")


def visible_fields(fields: DataFrame, *keys: str) -> DataFrame:
    """Fields with a value that are shown, with their place in the order of display."""
    bare = _bare(F.col("field"))
    shown = fields.where((F.col("value") != "") & ((F.col("kind") == "dz-passport") | ~bare.isin(dims.HIDDEN)) & ((F.col("kind") != "dz-driving-licence") | ~F.col("field").isin(dims.HIDDEN_LICENCE)))
    rank = F.array_position(F.array(*map(F.lit, dims.SHOWN)), bare)
    return shown.select(*keys, "kind", "field", "value", F.when(rank > 0, rank - 1).otherwise(F.lit(len(dims.SHOWN))).cast("int").alias("place"))


def side_for_missing(votes: DataFrame, *keys: str) -> DataFrame:
    """The side with the most missing fields, the first on a tie: from rows (…keys, pos, side, field)."""
    n = votes.groupBy(*keys, "pos", "side").agg(F.countDistinct("field").alias("n"))
    return n.groupBy(*keys).agg(F.min_by("side", F.struct(-F.col("n"), "pos")).alias("side"))


def field_sides(fields: DataFrame, sources: DataFrame, held: DataFrame, *keys: str) -> DataFrame:
    """(…keys, kind, canonical, side): where each traced fact came from. The merged source decides if it is one face;
    a field from both faces or in conflict has no side; without a source a passport's is its only side, and another
    document's the first side that holds any of the fact's names (without the front and back forms).

    ``fields`` has (…keys, kind, field, value) as merged, ``sources`` (…keys, kind, field, source) and ``held`` (…keys,
    kind, side, field, value).
    """
    spark = fields.sparkSession
    names, place = F.broadcast(dims.traced(spark)), F.broadcast(dims.sides(spark))  # fixed tables
    own = F.broadcast(dims.traced(spark).where("rank % 3 = 0").select("canonical", "name"))
    wanted = fields.select(*keys, "kind").distinct().withColumn("canonical", F.explode(F.array(*map(F.lit, dims.TRACED))))
    merged = fields.where(F.col("value") != "").join(names, F.col("field") == F.col("name")).join(sources, [*keys, "kind", "field"], "left")
    best = merged.groupBy(*keys, "kind", "canonical").agg(F.min_by(F.struct("source"), "rank").alias("_s"))
    first = held.where(X.blank_to_null(F.col("value")).isNotNull()).join(own, F.col("field") == F.col("name")).join(place, ["kind", "side"]).groupBy(*keys, "kind", "canonical").agg(F.min_by("side", "pos").alias("first"))
    rows = wanted.join(best, [*keys, "kind", "canonical"], "left").join(first, [*keys, "kind", "canonical"], "left")
    source = F.nullif(F.col("_s.source"), F.lit(""))
    side = F.when(source.isin("front", "back"), source).when(source.isNotNull(), F.lit(None)).when(F.col("kind") == "dz-passport", "single").otherwise(F.col("first"))
    return rows.select(*keys, "kind", "canonical", side.alias("side"))


def distinct_readings(readings: DataFrame, *keys: str) -> DataFrame:
    """(…keys, field, document, side, value) once for each shown value, at the place where it first appeared, with the
    row that came last. ``readings`` has a ``pos``."""
    shown = F.coalesce("value", F.lit(""))
    rows = readings.groupBy(*keys, "field", "document", "side", shown.alias("shown")).agg(F.min("pos").alias("place"), F.max_by(F.struct("value"), "pos").alias("_v"))
    return rows.select(*keys, "field", "document", "side", "_v.value", "place")


def comparison_value(raw: Column) -> Column:
    """A raw JSON value as one text: lists joined by a comma, an object by its category, nothing for other objects."""
    object_text = lambda v: F.when(F.ltrim(v).startswith("{"), F.get_json_object(v, "$.category")).otherwise(v)
    listed = F.array_join(F.filter(F.transform(F.from_json(raw, "array<string>"), object_text), lambda v: v != ""), ", ")
    return F.nullif(F.when(F.ltrim(raw).startswith("["), listed).otherwise(object_text(raw)), F.lit(""))
