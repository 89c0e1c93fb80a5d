"""Record linkage: merging two faces of a document, checking them, and comparing facts across documents.

Readings are long tables: one row for each (…keys, side or document, field, value). All joins are equi-joins on the keys
and the field; names are compared only within such a pair.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idloom import dims
from idloom.functions import text as X


def usable(value: Column, field: Column, failed: Column, unreadable: Column) -> Column:
    """The value, or null if its field failed validation or was unreadable (machine-readable lines fail as one)."""
    bad = F.array_contains(F.coalesce(failed, F.array()), field) | F.array_contains(F.coalesce(unreadable, F.array()), field)
    bad = bad | (field.startswith("mrz_line_") & F.array_contains(F.coalesce(failed, F.array()), "mrz"))
    return F.when(~bad, value)


def comparison_kind(field: Column) -> Column:
    return F.when(field == "nin", "identifier").when(field == "sex", "sex").when(field.isin("date_of_birth", "date_of_expiry"), "date").when(field.endswith("_latin"), "latin").when(field.endswith("_ar"), "arabic").otherwise("text")


def comparable_value(value: Column, kind: Column) -> Column:
    """The value in the form that ``kind`` compares; null if it can't be compared."""
    kinds = ("identifier", "date", "sex", "latin", "arabic")
    return reduce(lambda acc, k: acc.when(kind == k, comparable_as(value, k)), kinds, F.when(kind == "text", comparable_as(value, "text")))


def comparable_as(value: Column, kind: str) -> Column:
    """:func:`comparable_value` of a kind that is known beforehand, so only that form is computed."""
    return F.upper(X.trim_unicode(value)) if kind == "text" else X.shared_value(value, kind)


def same_reading(a: Column, b: Column, kind: Column) -> Column:
    """Whether two readings mean the same: lists and objects (JSON text) by their JSON, texts in the form of ``kind``."""
    structured = a.rlike(r"^\s*[\[{]") | b.rlike(r"^\s*[\[{]")
    form = lambda c: F.to_json(F.try_parse_json(c))
    return F.when(structured, F.coalesce(form(a) == form(b), F.lit(False))).otherwise(comparable_value(a, kind) == comparable_value(b, kind))


def pair_faces(readings: DataFrame, *keys: str) -> DataFrame:
    """(…keys, field, front, back, in_front, in_back) from one pass over rows with side 'front' or 'back'. A field that
    is named on a side but has no value is told from one that isn't named. Repeated names: the least value counts."""
    side = lambda s: F.min(F.when(F.col("side") == s, F.col("value")))
    named = lambda s: F.bool_or(F.col("side") == s)
    return readings.groupBy(*keys, "field").agg(side("front").alias("front"), side("back").alias("back"), named("front").alias("in_front"), named("back").alias("in_back"))


def merge_pairs(pairs: DataFrame, comparable: list[str] | None = None, same: Column | None = None) -> DataFrame:
    """Merged (…, field, value, source) rows of paired faces.

    A field named on both faces that doesn't mean the same there is split into front_ and back_. Equal values are
    ``both``; different ones are null with source ``conflict``; a single one keeps its side; none is ``none``.
    """
    if same is None:
        kind = comparison_kind(F.col("field"))
        same = same_reading(F.col("front"), F.col("back"), kind)
    keys = [c for c in pairs.columns if c not in ("field", "front", "back", "in_front", "in_back")]
    pairs = pairs.withColumn("_same", F.coalesce(same, F.lit(False)))
    same = F.col("_same")
    split = F.col("in_front") & F.col("in_back") & ~(F.col("field").isin(comparable) if comparable is not None else F.lit(True))
    both = F.col("front").isNotNull() & F.col("back").isNotNull()
    row = lambda field, value, source: F.struct(field.alias("field"), value.alias("value"), source.alias("source"))
    side = lambda name: F.when(F.col(name).isNotNull(), F.lit(name)).otherwise("none")
    split_rows = F.array(*[row(F.concat(F.lit(f"{s}_"), F.col("field")), F.col(s), side(s)) for s in ("front", "back")])
    source = F.when(both & same, "both").when(both, "conflict").when(F.col("front").isNotNull(), "front").when(F.col("back").isNotNull(), "back").otherwise("none")
    value = F.when(~(both & ~same), F.coalesce("front", "back"))
    merged = F.when(split, split_rows).otherwise(F.array(row(F.col("field"), value, source)))
    # never empty; explode() would add a filter that evaluates the comparison again
    return pairs.select(*keys, F.explode_outer(merged).alias("_m")).select(*keys, "_m.*")


def outcome_of(a: Column, b: Column, fuzzy: Column | bool, floor_outcome: str, below_outcome: str) -> Column:
    """passed for equal comparable values, not_checked if either is missing; other names give ``floor_outcome`` from the
    similarity floor on and ``below_outcome`` under it, other values fail."""
    fuzzy = F.lit(fuzzy) if isinstance(fuzzy, bool) else fuzzy
    different = F.when(fuzzy, below_outcome).otherwise("failed")
    if floor_outcome != below_outcome:
        different = F.when(fuzzy & (X.similarity(a, b) >= dims.NAME_FLOOR), floor_outcome).otherwise(different)
    # nested, so that Spark drops the comparison where it is only asked whether there is one
    return F.when(a.isNull() | b.isNull(), "not_checked").otherwise(F.when(a == b, "passed").otherwise(different))


def _check(check_id: str, field: str, outcome: Column) -> Column:
    return F.struct(F.lit(check_id).alias("check_id"), F.lit(field).alias("field"), outcome.alias("outcome"))


def face_checks(pairs: DataFrame, document: str, *keys: str) -> DataFrame:
    """Check rows of paired faces of one kind of document, by one aggregation of each document's fields. Names that are
    not on both faces give no row on an ID card, except one ``not_checked`` row if none is; its document number is never
    comparable. A licence's category codes are compared as sets. A wrong name only warns here: the merge reports it as a
    conflict."""
    return _rows_of(_check_lists(pairs, lambda f, side: F.min(F.when(F.col("field") == f, F.col(side))), document, *keys), *keys)


def face_checks_of(readings: DataFrame, document: str, *keys: str) -> DataFrame:
    """The same from the readings themselves (…keys, side, field, value), without pairing them first: one shuffle, of which
    each document's fields are one row."""
    return _rows_of(_check_lists(readings, lambda f, side: F.min(F.when((F.col("side") == side) & (F.col("field") == f), F.col("value"))), document, *keys), *keys)


def face_checks_of_sheets(sheets: DataFrame, document: str, *keys: str) -> DataFrame:
    """The same from sheets: rows (…keys, side, a column for each field that a side may show)."""
    return _rows_of(face_check_lists(sheets, document, *keys), *keys)


def face_check_lists(sheets: DataFrame, document: str, *keys: str) -> DataFrame:
    """(…keys, a column ``check_id|field`` for each check of the document) of sheets: a check's outcome, null where it gives
    no row; for what is reported about each document. The rows should be dealt by the keys already; then nothing is
    shuffled here."""
    return _check_lists(sheets, lambda f, side: _on(sheets, f, side), document, *keys)


def _on(sheets: DataFrame, field: str, side: str) -> Column | None:
    return F.min(F.when(F.col("side") == side, F.col(field))) if field in sheets.columns else None


def _rows_of(lists: DataFrame, *keys: str) -> DataFrame:
    each = [_check(*name.split("|"), F.col(f"`{name}`")) for name in lists.columns if name not in keys]
    # never empty; explode() would add a filter that evaluates every comparison again
    rows = lists.select(*keys, F.explode_outer(F.array(*each)).alias("_c")).select(*keys, "_c.*")
    optional = any(f.nullable for f in lists.schema if f.name not in keys)
    return rows.where(F.col("outcome").isNotNull()) if optional else rows


def _check_lists(source: DataFrame, least: Callable[[str, str], Column | None], document: str, *keys: str, kept: dict[str, Column] | None = None) -> DataFrame:
    rules = dims.FACE_RULES[document]
    names = {f: dims.FACE_NAMES.get(document, {}).get(f, ([f], [f])) for _, f, _, _ in rules}
    sides = [("front", 0), ("back", 1)]
    extra = [("front", "categories"), ("back", "category_entries")] if document == "dz-driving-licence" else []
    wanted = dict.fromkeys([(side, n) for _, f, _, _ in rules for side, i in sides for n in names[f][i]] + extra)
    # what no row can hold isn't carried along, and what it is compared with isn't read
    held = {(side, n): c for side, n in wanted if (c := least(n, side)) is not None}
    given = source.groupBy(*keys).agg(*[c.alias(f"_{side}|{n}") for (side, n), c in held.items()], *[c.alias(name) for name, c in (kept or {}).items()])
    # blanks count as missing, but only once the least of repeated names is chosen
    there = lambda side, n: X.blank_to_null(F.col(f"`_{side}|{n}`"))
    shown = {(side, f): [n for n in names[f][i] if (side, n) in held] for _, f, _, _ in rules for side, i in sides}
    both = [(check_id, f, kind, fuzzy) for check_id, f, kind, fuzzy in rules if shown["front", f] and shown["back", f]]
    raw = [F.coalesce(*[there(side, n) for n in shown[side, f]]).alias(f"{side}_{f}") for _, f, _, _ in both for side, _ in sides]
    lists = [there(side, n).alias(f"{side}_categories") if (side, n) in held else F.lit(None).cast("string").alias(f"{side}_categories") for side, n in extra]
    rows = given.select(*keys, *raw, *lists, *(kept or {}))
    forms = {f"_{side}_{f}": (f"{side}_{f}", kind) for _, f, kind, _ in both for side, _ in sides}
    rows = X.with_shared_values(rows, {n: v for n, v in forms.items() if v[1] != "text"})
    texts = {n: comparable_as(F.col(c), kind) for n, (c, kind) in forms.items() if kind == "text"}
    if lists:  # read only where both sides have one
        front, back = F.col("front_categories"), F.col("back_categories")
        texts |= {"_front_categories": F.when(back.isNotNull(), _texts(front)), "_back_categories": F.when(front.isNotNull(), _texts(back, "$.category"))}
    rows = rows.withColumns(texts)
    out, shared_names = {}, []
    for check_id, f, _, fuzzy in rules:
        on_card = document == "dz-id" and fuzzy
        if not (shown["front", f] and shown["back", f]):
            if not on_card:
                out[f"{check_id}|{f}"] = F.lit("not_checked")
            continue
        outcome = outcome_of(F.col(f"_front_{f}"), F.col(f"_back_{f}"), fuzzy, "warning", "warning")
        if on_card:
            shared = F.col(f"front_{f}").isNotNull() & F.col(f"back_{f}").isNotNull()
            shared_names.append(shared)
            outcome = F.when(shared, outcome)
        out[f"{check_id}|{f}"] = outcome
    if document == "dz-id":
        out["cross.id.names|surname_ar"] = F.when(~reduce(lambda x, y: x | y, shared_names, F.lit(False)), "not_checked")
    if lists:
        out["cross.driving_licence.categories|categories"] = category_check(F.col("_front_categories"), F.col("_back_categories"))
    number = {"dz-id": "cross.id.document_number", "id-passport": "cross.person.document_numbers"}.get(document)
    if number:
        out[f"{number}|document_number"] = F.lit("not_checked")
    return rows.select(*keys, *(kept or {}), *[c.alias(name) for name, c in out.items()])


def _texts(raw: Column, path: str | None = None) -> Column:
    """The texts in a JSON list (or at a path in its objects), without what isn't a text; null if it isn't a list."""
    items = F.try_variant_get(F.try_parse_json(raw), "$", "array<variant>")
    if path:
        items = F.transform(F.filter(items, lambda v: F.schema_of_variant(v).startswith("OBJECT")), lambda v: F.try_variant_get(v, path, "variant"))
    return F.transform(F.filter(items, lambda v: v.isNotNull() & (F.schema_of_variant(v) == "STRING")), lambda v: F.try_variant_get(v, "$", "string"))


def category_check(front: Column, back: Column) -> Column:
    """Outcome of comparing two lists of licence categories as sets of upper-case codes."""
    codes = lambda c: F.array_sort(F.array_distinct(F.transform(F.filter(c, lambda v: v.isNotNull()), lambda v: F.upper(X.trim_unicode(v)))))
    return F.when(front.isNull() | back.isNull(), "not_checked").otherwise(F.when(codes(front) == codes(back), "passed").otherwise("failed"))


def merge_conflict_checks(merged: DataFrame, checks: DataFrame, *keys: str) -> DataFrame:
    """A failed row for each merge conflict whose field has no failed check yet."""
    failed = checks.where("outcome = 'failed'").select(*keys, "field").distinct()
    open_ = merged.where("source = 'conflict'").join(failed, [*keys, "field"], "left_anti")
    return open_.select(*keys, F.concat(F.lit("cross.merge."), F.col("field")).alias("check_id"), "field", F.lit("failed").alias("outcome"))


def open_conflicts(sheets: DataFrame, document: str, comparable: list[str], fields: list[str], only: list[str], *keys: str) -> DataFrame:
    """:func:`merge_conflict_checks` of sheets (…keys, side, a column for each of ``fields``, which both sides name): a
    document's merge and its checks (of the fields ``only``) are made from one row, so that nothing is paired or joined."""
    value = lambda f, side: F.lit(None).cast("string") if (c := _on(sheets, f, side)) is None else c
    each = _check_lists(sheets, lambda f, side: _on(sheets, f, side), document, *keys, kept={f"_m_{s}_{f}": value(f, s) for f in fields for s in ("front", "back")})
    outcomes = lambda f: [F.col(f"`{c}`") for c in each.columns if c.endswith(f"|{f}")]
    told_of = lambda f: reduce(lambda x, y: x | y, [F.coalesce(o == "failed", F.lit(False)) for o in outcomes(f)], F.lit(False))
    found = []
    for f in fields:
        if f in comparable:
            a, b = F.col(f"_m_front_{f}"), F.col(f"_m_back_{f}")
            clash = a.isNotNull() & b.isNotNull() & ~F.coalesce(same_reading(a, b, comparison_kind(F.lit(f))), F.lit(False))
            told = told_of(f) if f in only else F.lit(False)
            # a field that isn't comparable is split where both faces name it, so it can't conflict
            found.append(F.when(clash & ~told, _check(f"cross.merge.{f}", f, F.lit("failed"))))
    return each.select(*keys, F.explode(F.array_compact(F.array(*found))).alias("_c")).select(*keys, "_c.*")


def face_assembly(sides: DataFrame, required: DataFrame, *keys: str) -> DataFrame:
    """One row for each document whose required sides are all ready and belong to the current capture: (…keys, kind,
    capture_ids). ``sides`` has (…keys, kind, side, capture_id, current_capture_id, state)."""
    fresh = (F.col("state") == "ready") & (F.col("capture_id") == F.col("current_capture_id"))
    need = required.groupBy("kind").agg(F.count("*").alias("needed"))
    ready = sides.where(fresh).join(required.select("kind", "side"), ["kind", "side"], "left_semi")
    got = ready.groupBy(*keys, "kind").agg(F.countDistinct("side").alias("got"), F.array_sort(F.collect_set(F.concat_ws("=", "side", "capture_id"))).alias("capture_ids"))
    return got.join(need, "kind").where("got = needed").select(*keys, "kind", "capture_ids")


def pairwise(values: DataFrame, keys: list[str], pos: str, value: str, fuzzy: Column | bool) -> DataFrame:
    """Check rows (…keys, a_pos, b_pos, outcome) of every two positions of a key, a before b. Within a key there are as
    many positions as a session has documents (three), so the pairs are bounded by the rows."""
    a = values.select(*keys, F.col(pos).alias("a_pos"), F.col(value).alias("a_value"))
    b = values.select(*keys, F.col(pos).alias("b_pos"), F.col(value).alias("b_value"))
    pairs = a.join(b, list(keys)).where("a_pos < b_pos")
    return pairs.withColumn("outcome", outcome_of(F.col("a_value"), F.col("b_value"), fuzzy, "warning", "failed"))


def cross_document(readings: DataFrame, *keys: str, scope: str | None = None) -> DataFrame:
    """Comparison of identity facts between all documents of a key: (…keys, fact, a_document, b_document, outcome,
    suggested_document). ``readings`` has (…keys, document, pos, field, value).

    The rows are dealt by the key once; each document becomes one row of facts and each key one row of documents (a
    session has three), within which the pairs are formed.
    """
    least = lambda n: F.min(F.when((F.col("field") == n) & (F.length(X.trim_unicode(F.col("value"))) > 0), F.col("value")))
    return _cross_document(readings.repartition(*keys), least, scope, *keys)


def cross_document_of_sheets(sheets: DataFrame, *keys: str, scope: str | None = None) -> DataFrame:
    """The same from sheets: rows (…keys, document, pos, a column for each field), which should be dealt by the keys."""
    none = F.lit(None).cast("string")
    least = lambda n: F.min(F.when(F.length(X.trim_unicode(F.col(n))) > 0, F.col(n))) if n in sheets.columns else none
    return _cross_document(sheets, least, scope, *keys)


def _cross_document(source: DataFrame, least: Callable[[str], Column], scope: str | None, *keys: str) -> DataFrame:
    facts = [(f, names, k) for f, names, k in dims.IDENTITY_FACTS if scope != "onboarding" or f in dims.ONBOARDING]
    each = source.groupBy(*keys, "document", "pos").agg(*[F.coalesce(*map(least, names)).alias(f) for f, names, _ in facts])
    each = each.select(*keys, F.struct("pos", "document", *[comparable_as(F.col(f), k).alias(f) for f, _, k in facts]).alias("_d"))
    rows = each.groupBy(*keys).agg(F.array_sort(F.collect_list("_d")).alias("_docs"))
    rows = rows.withColumns({f"_s_{f}": odd_one_out(F.col("_docs"), f) for f, _, _ in facts})
    later = lambda a: F.filter("_docs", lambda b: b["pos"] > a["pos"])
    pairs = F.flatten(F.transform("_docs", lambda a: F.transform(later(a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    pairs = rows.select(*keys, *[f"_s_{f}" for f, _, _ in facts], F.explode(pairs).alias("_p"))
    out = []
    for f, _, kind in facts:
        outcome = outcome_of(F.col("_p.a")[f], F.col("_p.b")[f], kind in ("latin", "arabic"), "warning", "failed")
        out.append(F.struct(F.lit(f).alias("fact"), outcome.alias("outcome"), F.col(f"_s_{f}").alias("suggested")))
    found = pairs.select(*keys, F.col("_p.a.document").alias("a_document"), F.col("_p.b.document").alias("b_document"), F.explode_outer(F.array(*out)).alias("_c"))
    suggested = F.when(F.col("_c.outcome") == "failed", F.col("_c.suggested"))
    return found.select(*keys, "_c.fact", "a_document", "b_document", "_c.outcome", suggested.alias("suggested_document"))


def session_facts(readings: DataFrame, *keys: str) -> DataFrame:
    """(…keys, facts): JSON of a document's comparable identity facts, each as [value, side], for the lifecycle's ocr
    events. ``readings`` has (…keys, field, value, side)."""
    facts = [(f, names, k) for f, names, k in dims.IDENTITY_FACTS if f in dims.ONBOARDING]
    held = lambda n, c: F.min(F.when((F.col("field") == n) & (F.length(X.trim_unicode(F.col("value"))) > 0), F.col(c)))
    rows = readings.groupBy(*keys).agg(*[F.coalesce(*[held(n, c) for n in names]).alias(f"{c}_{f}") for f, names, _ in facts for c in ("value", "side")])
    rows = rows.withColumns({f"value_{f}": comparable_as(F.col(f"value_{f}"), k) for f, _, k in facts})
    entries = [F.when(F.col(f"value_{f}").isNotNull(), F.struct(F.lit(f).alias("key"), F.array(f"value_{f}", f"side_{f}").alias("value"))) for f, _, _ in facts]
    return rows.select(*keys, F.to_json(F.map_from_entries(F.array_compact(F.array(*entries)))).alias("facts"))


def odd_one_out(docs: Column, fact: str) -> Column:
    """The document of an array of exactly three whose value differs, where all have one and the others agree."""
    v = [F.get(docs, i)[fact] for i in range(3)]
    name = [F.get(docs, i)["document"] for i in range(3)]
    whole = (F.size(docs) == 3) & v[0].isNotNull() & v[1].isNotNull() & v[2].isNotNull()
    return F.when(whole & (v[0] == v[1]) & (v[0] != v[2]), name[2]).when(whole & (v[0] == v[2]) & (v[0] != v[1]), name[1]).when(whole & (v[1] == v[2]) & (v[0] != v[1]), name[0])


def outliers(values: DataFrame, keys: list[str], member: str, value: str) -> DataFrame:
    """(…keys, suggested): the member that disagrees, where exactly three have values and two of them agree."""
    counts = values.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(member).alias("m"))
    whole = counts.groupBy(*keys).agg(F.sum("n").alias("all"), F.bool_or(F.col(value).isNull()).alias("gap"), F.max("n").alias("top"), F.min(F.when(F.col("n") == 1, F.col("m"))).alias("suggested"))
    return whole.where("all = 3 AND NOT gap AND top = 2").select(*keys, "suggested")


def retry_targets(readings: DataFrame, held: DataFrame, sides: DataFrame, *keys: str) -> DataFrame:
    """Distinct (…keys, check_id, kind, side) that could be photographed again: the reading's own side, else the sides
    that hold the field, else all required sides. ``readings`` has (…keys, check_id, kind, side, field); ``held`` has
    (…keys, kind, side, field)."""
    # A set of sides is one number, a bit for each by its place among the kind's, so that sets are united in place. The sides
    # are a few rows: joined by anything but a broadcast, all readings of a kind would meet in one task.
    need = F.broadcast(sides.groupBy("kind").agg(F.array_sort(F.collect_set("side")).alias("_need")))
    bit = F.expr("shiftleft(1L, CAST(array_position(_need, side) AS INT) - 1)")
    own = F.when(F.array_contains("_need", F.col("side")), bit)
    all_ = F.expr("shiftleft(1L, size(_need)) - 1")
    holds = held.join(need, "kind").groupBy(*keys, "kind", "field").agg(F.bit_or(own).alias("_held"))
    each = readings.join(holds, [*keys, "kind", "field"], "left").join(need, "kind")
    targets = F.when(F.col("side").isNotNull(), own).otherwise(F.coalesce("_held", all_))
    found = each.select(*keys, "check_id", "kind", targets.alias("_t")).groupBy(*keys, "check_id", "kind").agg(F.bit_or("_t").alias("_t")).join(need, "kind")
    chosen = F.filter("_need", lambda s, i: F.getbit("_t", i) == 1)
    return found.select(*keys, "check_id", "kind", F.explode(chosen).alias("side"))


def retryable(targets: DataFrame, attempts: DataFrame, *keys: str) -> DataFrame:
    """(…keys, retryable): whether any target's document and side have attempts left."""
    left = targets.join(attempts, [*keys, "kind", "side"], "left")
    spare = (F.coalesce("document_attempts", F.lit(0)) < dims.MAX_ATTEMPTS) & (F.coalesce("side_attempts", F.lit(0)) < dims.MAX_ATTEMPTS)
    return left.groupBy(*keys).agg(F.bool_or(spare).alias("retryable"))


def retry_choice(targets: DataFrame, exhausted: DataFrame, suggested: DataFrame, *keys: str) -> DataFrame:
    """The target to offer first: a suggested one if it isn't exhausted, else the first by kind and side."""
    open_ = targets.join(exhausted, [*keys, "kind", "side"], "left_anti").join(suggested.select(*keys, "kind").distinct().withColumn("hint", F.lit(0)), [*keys, "kind"], "left")
    best = F.min(F.struct(F.coalesce("hint", F.lit(1)).alias("rank"), "kind", "side"))
    return open_.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.kind", "_b.side")
