import json

import numpy as np
from pyspark.sql import functions as F

from idloom import dims, schemas
from idloom.functions import numeric as N
from idloom.operators import fields, image, matching, quality, tenancy
from tests.test_quality import frames


def test_schemas_are_valid(spark):
    for name in (n for n in dir(schemas) if n.isupper()):
        assert schemas.empty(spark, getattr(schemas, name)).count() == 0


def test_comparison_values(spark):
    raw = [json.dumps(["B", {"category": "C"}, "", None]), json.dumps({"category": "A"}), json.dumps({"other": 1}), "text", "", None]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string")
    assert [r["v"] for r in rows.select("i", fields.comparison_value(F.col("r")).alias("v")).orderBy("i").collect()] == ["B, C", "A", None, "text", None, None]


def test_sides_of_fields(spark):
    merged = spark.createDataFrame([("s", "dz-id", "surname_latin", "A"), ("s", "dz-id", "nin", "1"), ("s", "dz-passport", "nin", "1")], "s string, kind string, field string, value string")
    sources = spark.createDataFrame([("s", "dz-id", "surname_latin", "back"), ("s", "dz-id", "nin", "both")], "s string, kind string, field string, source string")
    held = spark.createDataFrame([("s", "dz-id", "back", "sex", "M"), ("s", "dz-id", "front", "given_name_latin", "x"), ("s", "dz-id", "back", "given_name_latin", "x")], "s string, kind string, side string, field string, value string")
    got = {(r["kind"], r["canonical"]): r["side"] for r in fields.field_sides(merged, sources, held, "s").collect()}
    assert (got["dz-id", "lastNameLatin"], got["dz-id", "nin"], got["dz-id", "firstNameLatin"], got["dz-id", "sex"], got["dz-passport", "nin"]) == ("back", None, "front", "back", "single")
    assert {c for _, c in got} == set(dims.TRACED)


def test_profile_paths():
    p = {"image": {"minContrast": 0.3}, "mode": "observe"}
    q = quality.write_limit(p, "image.minContrast", 0.5)
    assert quality.read_limit(q, "image.minContrast") == 0.5 and quality.read_limit(p, "image.minContrast") == 0.3 and quality.read_limit(p, "image.none.x") is None


def test_telemetry(spark):
    r = quality.telemetry(quality.evaluate(frames(spark, {})), "i").first()
    assert r["checks"]["sharpness"] == "fail" and r["failed"] == 1 and r["met"] + r["failed"] + r["warned"] == 17


def test_quads_scale_and_map_back(spark):
    q = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((10.0, 20.0), (90.0, 20.0))])
    r = spark.range(1).select(N.scale_quad(q, F.lit(0.01), F.lit(0.1)).alias("q")).first()["q"]
    assert [(p["x"], p["y"]) for p in r] == [(0.1, 2.0), (0.9, 2.0)]
    corners = np.array([[5, 6], [95, 4], [99, 70], [2, 75]], float)
    back = matching.to_source(np.array([[0, 0], [85, 53]]), corners, 86, 54)
    assert np.allclose(back, corners[[0, 2]])
    assert image.histogram_percentile(np.array([1, 0, 3]), 0.25) == 0


def test_tenants_and_destinations(spark):
    apps = spark.createDataFrame([("a", ["dz-id", "dz-passport"], "https://x", "http://y"), ("b", ["dz-id"], None, "zzz")], "id string, documents array<string>, hook string, back string")
    offered = spark.createDataFrame([("dz-id", True), ("dz-passport", False)], "kind string, available boolean")
    assert [tuple(r) for r in tenancy.unavailable_documents(apps, offered).collect()] == [("a", "dz-passport")]
    assert sorted(tuple(r) for r in tenancy.insecure_destinations(apps, "hook", "back").collect()) == [("a", "http://y"), ("b", "zzz")]


def test_tokens_are_used_once(spark):
    issued = spark.createDataFrame([("t", 100), ("u", 100)], "token string, expires_at_ms long")
    uses = spark.createDataFrame([(1, "t", 50), (2, "t", 60), (3, "u", 100), (4, "none", 1), (5, "t", 50)], "use_id long, token string, at_ms long")
    assert {r["use_id"]: r["accepted"] for r in tenancy.consume_tokens(issued, uses).collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}
