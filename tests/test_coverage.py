"""Coverage of a document's checks: what it reads, and the forms it compares, made step by step."""

import pytest
from pyspark.sql import functions as F

from idloom.functions import text as X
from idloom.operators import checks, linkage
from idloom.plans import linkage_queries as Q

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_coverage_compares_a_document_once(spark):
    """A filter on the list of checks would be evaluated apart from it, with every comparison in it again."""
    found = plan(Q.coverage_report(spark, DATA))
    assert "Filter (" not in found and found.count("ArrowEvalPython") == 1
    assert "nin#" not in found  # the national number doesn't count for coverage


def test_a_key_without_a_check_that_counts_gives_no_row(spark):
    rows = [(1, "passed", None, "failed"), (2, None, "not_checked", None), (3, None, None, "failed")]
    lists = spark.createDataFrame(rows, "doc int, `cross.id.sex|sex` string, `cross.id.expiry|date_of_expiry` string, `cross.id.names|surname_ar` string")
    got = {r["doc"]: (r["checked"], r["total"], r["not_checked"], r["complete"]) for r in checks.coverage_of_lists(lists, "doc").collect()}
    assert got == {1: (1, 1, 0, True), 2: (0, 1, 1, False)}


def test_sheets_without_a_field_are_not_checked(spark):
    sheets = spark.createDataFrame([("d", "front", "M"), ("d", "back", "F"), ("e", "front", " ")], "doc string, side string, sex string")
    got = {(r["doc"], r["check_id"]): r["outcome"] for r in linkage.face_checks_of_sheets(sheets, "dz-id", "doc").collect()}
    assert len(got) == 12  # six for each card: four fields, names and document number
    assert got["d", "cross.id.sex"] == "failed" and got["e", "cross.id.sex"] == "not_checked"
    assert got["d", "cross.id.expiry"] == got["d", "cross.id.names"] == got["d", "cross.id.document_number"] == "not_checked"


# Texts and what is compared of them, odd ones too.
FORMS = {
    "date": [("29/02/1900", None), (" 29.2.2000\n", "2000-02-29"), ("0000-02-29", "0-02-29"), ("2001.2/3", "2001-02-03"), ("31-04-2001", None), ("00-1-2000", None), ("1/13/2000", None), ("٢٠٠٠-١-٢", "2000-01-02"), ("2000-1-2-3", None), ("12-02-03", None), ("", None), (None, None)],
    "latin": [("Ali", "ALI"), (" bé\tnali-x ", "BE NALI X"), ("A  b", "A B"), ("Ali\u0085", "ALI"), ("ﬁ1", "FI"), ("Aعلي", None), ("12", None), ("ƛ", None), (" é", "E")],
    "arabic": [("بِن  عليّ", "بن علي"), ("ـ", None), ("علي b", None), ("﻿ﻻ", "لا")],
    "sex": [("masculin", "M"), ("FÉMININ", "F"), ("أنثى ", "F"), ("x", None)],
    "identifier": [(" a-1 b ", "A1B"), ("- -", None), ("１٢", "12")],
}


@pytest.mark.parametrize("kind", FORMS)
def test_shared_values_step_by_step(spark, kind):
    rows = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(FORMS[kind])], "i int, v string")
    got = X.with_shared_values(rows, {"step": ("v", kind)}).withColumn("one", X.shared_value(F.col("v"), kind)).orderBy("i").collect()
    assert [r["step"] for r in got] == [r["one"] for r in got] == [want for _, want in FORMS[kind]]
    assert got[0].asDict().keys() == {"i", "v", "step", "one"}
