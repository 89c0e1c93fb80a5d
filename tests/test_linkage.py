from pyspark.sql import functions as F

from idloom import dims
from idloom.operators import checks, fields, linkage, sweeps, tenancy

READ = "doc string, side string, field string, value string"
LONG = "doc string, field string, value string"


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def faces(spark, rows):
    return linkage.pair_faces(spark.createDataFrame(rows, READ), "doc")


def test_merge_of_faces(spark):
    pairs = faces(
        spark,
        [
            ("d", "front", "date_of_birth", "1/2/2000"), ("d", "back", "date_of_birth", "2000-02-01"),
            ("d", "front", "sex", "M"), ("d", "back", "sex", "F"),
            ("d", "front", "nin", "1"), ("d", "back", "nin", None),
            ("d", "front", "place", "a"), ("d", "back", "place", None),
            ("d", "front", "only", None), ("d", "back", "surname_latin", "Ali"),
        ],
    )
    merged = rows_of(linkage.merge_pairs(pairs, dims.COMPARABLE["dz-id"]), "field", "source")
    assert merged == [("back_place", "none"), ("date_of_birth", "both"), ("front_place", "front"), ("nin", "front"), ("only", "none"), ("sex", "conflict"), ("surname_latin", "back")]


def test_card_checks(spark):
    pairs = faces(spark, [("d", "front", "sex", "M"), ("d", "back", "sex", "male"), ("d", "front", "personal_number", "1"), ("d", "back", "nin", "2"), ("e", "front", "surname_latin", "Benali"), ("e", "back", "surname_latin", "Ben Alli")])
    got = {(r["doc"], r["check_id"]): r["outcome"] for r in linkage.face_checks(pairs, "dz-id", "doc").collect()}
    assert got["d", "cross.id.sex"] == "passed" and got["d", "cross.id.national_number"] == "failed"
    assert got["d", "cross.id.names"] == "not_checked" and ("d", "cross.id.surname_latin") not in got
    assert got["e", "cross.id.surname_latin"] == "warning" and ("e", "cross.id.names") not in got
    assert got["e", "cross.id.document_number"] == "not_checked" and got["e", "cross.id.birth_date"] == "not_checked"


def test_a_wrong_name_blocks_through_the_merge(spark):
    pairs = faces(spark, [("e", "front", "surname_latin", "Benali"), ("e", "back", "surname_latin", "Benalli")])
    found = linkage.merge_conflict_checks(linkage.merge_pairs(pairs, dims.COMPARABLE["dz-id"]), linkage.face_checks(pairs, "dz-id", "doc"), "doc")
    assert rows_of(found, "check_id", "outcome") == [("cross.merge.surname_latin", "failed")]


def test_categories(spark):
    rows = spark.createDataFrame([(1, ["a", "B ", "b"], ["B", "A"]), (2, ["A"], ["B"]), (3, None, ["B"])], "i int, f array<string>, b array<string>")
    assert rows_of(rows.select("i", linkage.category_check(F.col("f"), F.col("b")).alias("o")), "i", "o") == [(1, "passed"), (2, "failed"), (3, "not_checked")]


def test_usable_values(spark):
    rows = spark.createDataFrame([("a", "x", ["a"], None), ("b", "x", None, ["b"]), ("mrz_line_1", "x", ["mrz"], None), ("c", "x", ["a"], [])], "field string, value string, failed array<string>, unreadable array<string>")
    got = rows.select("field", linkage.usable(F.col("value"), F.col("field"), F.col("failed"), F.col("unreadable")).alias("u"))
    assert {r["field"]: r["u"] for r in got.collect()} == {"a": None, "b": None, "mrz_line_1": None, "c": "x"}


def test_cross_document_outlier(spark):
    docs = [("id", 0, "1"), ("driving_licence", 1, "1"), ("passport", 2, "9")]
    rows = [("s", d, p, "nin", v) for d, p, v in docs] + [("s", d, p, "surname_latin", n) for (d, p, _), n in zip(docs, ["Benali", "Benalli", "Smith"], strict=True)]
    out = linkage.cross_document(spark.createDataFrame(rows, "s string, document string, pos int, field string, value string"), "s", scope="onboarding")
    got = {(r["fact"], r["a_document"], r["b_document"]): (r["outcome"], r["suggested_document"]) for r in out.collect()}
    assert got["nin", "id", "driving_licence"] == ("passed", None)
    assert got["nin", "id", "passport"] == ("failed", "passport")
    assert got["lastNameLatin", "id", "driving_licence"][0] == "warning"
    assert got["lastNameLatin", "id", "passport"] == ("failed", None)
    assert got["dateOfBirth", "id", "passport"][0] == "not_checked"
    assert ("sex", "id", "passport") not in got


def test_retry_targets(spark):
    readings = spark.createDataFrame([("s", "c1", "dz-id", "back", "nin"), ("s", "c2", "dz-id", None, "surname_latin"), ("s", "c3", "dz-id", None, "x")], "s string, check_id string, kind string, side string, field string")
    held = spark.createDataFrame([("s", "dz-id", "back", "surname_latin")], "s string, kind string, side string, field string")
    targets = linkage.retry_targets(readings, held, dims.sides(spark), "s")
    assert rows_of(targets, "check_id", "side") == [("c1", "back"), ("c2", "back"), ("c3", "back"), ("c3", "front")]
    tries = spark.createDataFrame([("s", "dz-id", "back", 3, 3), ("s", "dz-id", "front", 3, 1)], "s string, kind string, side string, document_attempts int, side_attempts int")
    assert rows_of(linkage.retryable(targets, tries, "s"), "s", "retryable") == [("s", False)]
    choice = linkage.retry_choice(targets.select("s", "kind", "side").distinct(), spark.createDataFrame([("s", "dz-id", "back")], "s string, kind string, side string"), spark.createDataFrame([("s", "dz-passport")], "s string, kind string"), "s")
    assert rows_of(choice, "kind", "side") == [("dz-id", "front")]


def test_reports(spark):
    rows = spark.createDataFrame([("d", "cross.id.sex", "sex", "passed"), ("d", "cross.id.names", "surname_ar", "not_checked"), ("d", "cross.id.expiry", "date_of_expiry", "not_checked"), ("d", "x", "b", "failed"), ("d", "y", "a", "failed"), ("d", "z", None, "warning")], "doc string, check_id string, field string, outcome string")
    r = checks.report(rows, "doc").first()
    assert (r["passed"], r["warned"], r["failed"], r["not_checked"], r["failed_fields"], r["status"]) == (1, 1, 2, 2, ["a", "b"], "failed")
    c = checks.coverage(rows, "doc").first()
    assert (c["checked"], c["total"], c["not_checked"], c["complete"]) == (4, 5, 1, False)
    assert checks.coverage_warnings(rows, "doc").count() == 1
    assert rows_of(checks.identity_status(rows, "doc"), "identity_status") == [("mismatched",)]


# ---------------------------------------------------------------- fields


def test_payloads(spark):
    payloads = spark.createDataFrame([(1, '{"fields":{"a":{"value":" x "},"b":"  ","c":null,"d":5,"e":{"value":null}}}'), (2, '{"mergedFields":[1],"result":{"fields":{"z":"9"}}}'), (3, "{}"), (4, None)], "i int, p string")
    assert sorted(((r["i"], r["field"], r["value"]) for r in fields.unwrap_fields(payloads, "p", "i").collect()), key=str) == [(1, "a", "x"), (1, "b", None), (1, "c", None), (1, "d", "5"), (1, "e", None), (2, "z", "9")]
    shown = spark.createDataFrame([("x", '["B","C"]'), ("category_entries", '[{"category":"B","date_of_issue":"2020","restrictions":""},{"category":"C"}]'), ("y", '{"value":"q"}')], "f string, v string")
    assert rows_of(shown.select("f", fields.display_value(F.col("f"), F.col("v")).alias("d")), "f", "d") == [("category_entries", "B · 2020\nC"), ("x", "B, C"), ("y", "q")]


def test_canonical_fields(spark):
    rows = spark.createDataFrame([("d", "surname", "last"), ("d", "back_surname_latin", "best"), ("d", "nin", " 12-3 "), ("d", "date_naissance", "01/02/2000"), ("d", "expiry_date", "never")], LONG)
    got = {r["field"]: r["value"] for r in fields.canonicalise(rows, "doc").collect()}
    assert (got["lastNameLatin"], got["nin"], got["dateOfBirth"], got["expiryDate"], got["firstNameLatin"], got["surname"]) == ("best", "123", "2000-02-01", "never", None, "last")


def test_prior_readings(spark):
    prior = spark.createDataFrame([("a", "document_number", "X1"), ("a", "nin", "123"), ("b", "document_number", "X1"), ("b", "nin", "123"), ("c", "date_of_birth", "1"), ("c", "surname_ar", "n"), ("c", "sex", "M")], LONG)
    current = spark.createDataFrame([("a", "document_number", " x1 "), ("a", "nin", ""), ("b", "document_number", "X2"), ("b", "nin", None), ("c", "date_of_birth", "1"), ("c", "surname_ar", " N"), ("c", "sex", None)], LONG)
    got = {(r["doc"], r["field"]): (r["value"], r["reused"]) for r in fields.fill_from_prior(current, prior, "doc").collect()}
    assert got["a", "nin"] == ("123", True) and got["b", "nin"] == (None, False) and got["c", "sex"] == ("M", True)
    assert got["a", "document_number"] == (" x1 ", False)


def test_fill_canonical_skips_conflicts(spark):
    now = spark.createDataFrame([("a", "nin", None), ("b", "nin", None), ("c", "nin", None)], LONG)
    reused = spark.createDataFrame([("a", "personal_number", "1"), ("a", "nin", "1"), ("b", "nin", "1"), ("b", "personal_number", "2"), ("c", "nin", "3")], LONG)
    sources = spark.createDataFrame([("c", "front_nin", "conflict")], "doc string, field string, source string")
    assert sorted(((r["doc"], r["value"]) for r in fields.fill_canonical(now, reused, sources, "doc").collect()), key=str) == [("a", "1"), ("b", None), ("c", None)]


def test_required_and_invalid(spark):
    rows = spark.createDataFrame([("a", "lastNameArabic", "x"), ("a", "firstNameLatin", "x"), ("a", "nin", "1"), ("a", "dateOfBirth", "2"), ("b", "nin", " "), ("b", "firstNameArabic", "x"), ("b", "dateOfBirth", "2")], LONG)
    assert {r["doc"]: r["missing"] for r in fields.missing_required(rows, "doc").collect()} == {"a": [], "b": ["lastNameLatin", "nin"]}
    values = spark.createDataFrame([(1, "1" * 18, "2000-02-01"), (2, "12", "2030-01-01"), (3, "", None), (4, "١" * 18, "2000-02-30")], "i int, n string, b string")
    got = {r["i"]: r["x"] for r in values.select("i", fields.invalid_values(F.col("n"), F.col("b"), F.lit("2026-01-01").cast("date")).alias("x")).collect()}
    assert got == {1: [], 2: ["nin", "dateOfBirth"], 3: [], 4: ["nin", "dateOfBirth"]}


def test_document_failures(spark):
    rows = spark.createDataFrame([(1, "ok", "ok", None, None), (2, "failed", None, ["sex", "front_nin"], None), (3, "ok", "failed", ["shape"], None), (4, "failed", None, [], []), (5, "failed", None, None, ["sex"]), (6, "failed", None, [None], None)], "i int, s string, r string, c array<string>, f array<string>")
    got = {r["i"]: r["x"] for r in rows.select("i", fields.document_failed(F.col("s"), F.col("r"), F.col("c"), F.col("f")).alias("x")).collect()}
    assert got == {1: False, 2: False, 3: True, 4: True, 5: False, 6: True}


def test_memory_of_readings(spark):
    values = spark.createDataFrame([("a", "nin", "1"), ("a", "sex", "M"), ("b", "nin", "1")], LONG)
    before = spark.createDataFrame([("a", "nin", "1"), ("a", "place", "p"), ("b", "place", "p")], LONG)
    accepted = spark.createDataFrame([("a", False, ["sex"], False), ("b", True, [], True)], "doc string, failed boolean, rejected array<string>, same_capture boolean")
    assert rows_of(fields.readable_memory(values, before, accepted, "doc"), "doc", "field", "value") == [("a", "nin", "1"), ("a", "place", "p")]


def test_display_order_and_votes(spark):
    rows = spark.createDataFrame([("d", "dz-id", "sex", "M"), ("d", "dz-id", "front_nin", "1"), ("d", "dz-id", "mrz_line_1", "<"), ("d", "dz-id", "other", "o"), ("d", "dz-id", "nationality", "")], "doc string, kind string, field string, value string")
    assert [r["field"] for r in fields.visible_fields(rows, "doc").orderBy("place", "field").collect()] == ["front_nin", "sex", "other"]
    votes = spark.createDataFrame([("d", 0, "front", "a"), ("d", 1, "back", "b"), ("d", 1, "back", "c"), ("e", 0, "front", "a"), ("e", 1, "back", "b")], "doc string, pos int, side string, field string")
    assert rows_of(fields.side_for_missing(votes, "doc"), "doc", "side") == [("d", "back"), ("e", "front")]


# ---------------------------------------------------------------- sweeps and tenants


def test_expiry_boundary(spark):
    import datetime

    t = datetime.datetime(2026, 1, 1, 12, 0)
    rows = [("due", "capturing", t + datetime.timedelta(minutes=30)), ("later", "capturing", t + datetime.timedelta(minutes=31)), ("busy", "processing", t), ("done", "succeeded", t)]
    sessions = spark.createDataFrame([(i, s, None, t, x, 1, None, None) for i, s, x in rows], "session_id string, status string, reason_code string, updated_at timestamp, expires_at timestamp, version long, webhook_queued_at timestamp, webhook_delivered_at timestamp")
    as_of = t + datetime.timedelta(minutes=30)
    assert {r["session_id"]: (r["status"], r["version"]) for r in sweeps.expire(sessions, as_of).collect()} == {"due": ("expired", 2), "later": ("capturing", 1), "busy": ("processing", 1), "done": ("succeeded", 1)}
    assert {r["session_id"] for r in sweeps.expired(sessions, as_of).collect()} == {"due", "busy"}
    work = spark.createDataFrame([("later", "pending"), ("busy", "ready")], "session_id string, state string")
    assert {r["session_id"] for r in sweeps.pending(sessions, work).collect()} == {"later", "done"}


def test_leases_and_stale_results(spark):
    sides = spark.createDataFrame([("a", "pending", None), ("b", "processing", 0), ("c", "processing", 1), ("d", "ready", 0)], "i string, state string, leased_at_ms long")
    assert {r["i"] for r in sweeps.claimable(sides, 240_000).collect()} == {"a", "b"}
    results = spark.createDataFrame([("s", "c1", "t1"), ("s", "c1", "t0")], "s string, capture_id string, token string")
    assert sweeps.still_current(results, spark.createDataFrame([("s", "c1", "t1")], "s string, capture_id string, token string"), "s").count() == 1


def test_delivery_is_marked_once(spark):
    import datetime

    t = datetime.datetime(2026, 1, 1)
    sessions = spark.createDataFrame([("a", 1, None), ("b", 5, t)], "session_id string, version int, webhook_delivered_at timestamp")
    receipts = spark.createDataFrame([("a", t), ("a", t + datetime.timedelta(1)), ("b", t + datetime.timedelta(1))], "session_id string, at timestamp")
    assert rows_of(sweeps.deliver(sessions, receipts), "session_id", "version", "webhook_delivered_at") == [("a", 2, t), ("b", 5, t)]


def test_signatures_and_destinations(spark):
    import hashlib
    import hmac

    rows = spark.createDataFrame([("body", "key"), ("body", None)], "b string, s string")
    got = [r["h"] for r in rows.select(tenancy.hmac_sha256(F.col("b"), F.col("s")).alias("h")).collect()]
    assert got == [hmac.new(b"key", b"body", hashlib.sha256).hexdigest(), None]
    sessions = spark.createDataFrame([("s", "app", None), ("t", "app", "alt")], "session_id string, application_id string, destination_id string")
    targets = spark.createDataFrame([("app", "main", "m"), ("app", "alt", "a")], "application_id string, destination_id string, url string")
    assert rows_of(tenancy.destinations(sessions, targets), "session_id", "url") == [("s", "m"), ("t", "a")]


def test_application_input(spark):
    rows = spark.createDataFrame([(1, "ok", "https://a/b"), (2, "x", "ftp://a"), (3, "  ", "http://u:p@a"), (4, "fine", None), (5, "fine", "not a url")], "i int, n string, u string")
    got = {r["i"]: r["p"] for r in rows.select("i", tenancy.application_problems(F.col("n"), F.col("u")).alias("p")).collect()}
    assert got == {1: [], 2: ["name", "url0"], 3: ["name", "url0"], 4: [], 5: ["url0"]}


def test_document_rules(spark):
    rows = [(1, "all", ["dz-id"], [], None, ["dz-id"]), (2, "all", ["dz-id", "dz-passport"], [], None, ["dz-id"]), (3, "exact", ["dz-id", "dz-passport"], ["dz-id"], 1, ["dz-id"]), (4, "exact", ["dz-id", "dz-passport"], [], 1, ["dz-id", "dz-passport"]), (5, "optional", ["dz-id", "dz-passport"], ["dz-id"], None, ["dz-passport"]), (6, "optional", ["dz-id"], [], None, ["dz-passport"]), (7, "optional", ["dz-id", "dz-passport"], [], None, ["dz-id", "dz-id"])]
    t = spark.createDataFrame(rows, "i int, m string, d array<string>, r array<string>, n int, c array<string>")
    rule = tenancy.policy(F.col("m"), F.col("d"), F.col("r"), F.col("n"))
    got = {r["i"]: r["x"] for r in t.select("i", tenancy.selection_problem(F.col("c"), rule, F.col("d")).alias("x")).collect()}
    assert got == {1: None, 2: "mandatory_missing", 3: None, 4: "too_many", 5: "mandatory_missing", 6: "too_few_or_not_allowed", 7: "duplicate"}
