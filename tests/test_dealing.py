"""How the linkage operators deal out their rows, and that sheets give what readings give."""

import pytest
from pyspark.sql import functions as F

from idloom import dims
from idloom.operators import checks, linkage
from idloom.plans import linkage_queries as Q

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_retry_targets_hold_no_window_and_meet_by_key(spark):
    readings = spark.createDataFrame([("s", "c1", "dz-id", None, "nin")], "s string, check_id string, kind string, side string, field string").repartition(3)
    held = spark.createDataFrame([("s", "dz-id", "back", "nin"), ("s", "dz-id", "single", "nin"), ("s", "dz-id", "back", "sex")], "s string, kind string, side string, field string")
    targets = linkage.retry_targets(readings, held, dims.sides(spark), "s")
    assert [tuple(r) for r in targets.collect()] == [("s", "c1", "dz-id", "back")]  # a side that the kind doesn't have counts for nothing
    assert "Window" not in plan(targets) and "SortMergeJoin [kind" not in plan(targets)


@pytest.mark.parametrize("name", ["face_checks", "face_report", "coverage_report", "consistency_summary", "face_checks_id", "person_checks", "merge_conflicts", "cross_document"])
def test_documents_are_dealt_once_and_not_expanded_before(spark, name):
    found = plan(Q.QUERIES[name][0](spark, DATA))
    assert found.count("Exchange hashpartitioning") == (2 if name == "cross_document" else 1)
    assert "Generate" not in found[found.index("SortAggregate") :]


def test_lists_report_like_rows(spark):
    rows = Q._readings(spark, DATA, *Q._LICENCE, "categories", "category_entries")
    lists, long = Q._licence_lists(spark, DATA), linkage.face_checks_of(rows, "dz-driving-licence", "doc_id")
    assert rows_of(linkage.face_checks_of_sheets(Q._licence_sheets(spark, DATA), "dz-driving-licence", "doc_id")) == rows_of(long)
    for a, b in ((checks.report_of_lists, checks.report), (checks.coverage_of_lists, checks.coverage), (checks.summary_with_status_of_lists, checks.summary_with_status)):
        assert rows_of(a(lists, "doc_id")) == rows_of(b(long, "doc_id"))


def test_open_conflicts_are_those_of_merge_and_checks(spark):
    names = ["nin", "license_number", "date_of_birth", "surname_latin", "sex"]
    comparable = dims.COMPARABLE["dz-driving-licence"]
    pairs = linkage.pair_faces(Q._readings(spark, DATA, *names), "doc_id")
    found = linkage.face_checks(pairs, "dz-driving-licence", "doc_id")
    for only in (dims.ONBOARDING, ["sex"]):
        want = linkage.merge_conflict_checks(linkage.merge_pairs(pairs, comparable), found.where(F.col("field").isin(only)), "doc_id")
        got = linkage.open_conflicts(Q._sheets(spark, DATA, *names), "dz-driving-licence", comparable, names, only, "doc_id")
        assert want.count() > 0 and rows_of(got) == rows_of(want)


def test_a_streamed_session_takes_rows():
    """Rows of a session aren't made into a frame: its events come and its result goes as rows."""
    import json
    from types import SimpleNamespace

    from pyspark.sql import Row

    from idloom.streaming.lifecycle import L, Sessions

    held = {}
    value = SimpleNamespace(exists=lambda: bool(held), get=lambda: held["v"], update=lambda v: held.update(v=v), clear=held.clear)
    marks = SimpleNamespace(containsKey=lambda k: False, updateValue=lambda k, v: None)
    session = Sessions(timers=False)
    session.init(SimpleNamespace(getValueState=lambda *a: value, getMapState=lambda *a: marks))
    events = [dict.fromkeys(L.FIELDS) | {"seq": i, "type": t, "kind": "passport-only", "at_ms": i} for i, t in ((2, "tick"), (1, "create"))]
    out = list(session.handleInputRows(("s",), iter([Row(event=json.dumps(e)) for e in events]), None))
    assert [json.loads(r["result"])["status"] for r in out] == ["created"] and held
