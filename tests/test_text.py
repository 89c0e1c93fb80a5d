import datetime
import random

import pytest
from pyspark.sql import functions as F

from idloom.functions import text as X


def apply(spark, fn, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in rows.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_digits_and_identifiers(spark):
    assert apply(spark, X.fold_digits, ["٠١٢ ۳۴۵ 6", None]) == ["012 345 6", None]
    assert apply(spark, X.normalize_identifier, ["١٢-ab ﹣ ３", " - ", "", None, "é9"]) == ["12AB3", None, None, None, "9"]


def reference_date(digits):
    for y, m, d in ((digits[4:], digits[2:4], digits[:2]), (digits[:4], digits[4:6], digits[6:])):
        try:
            datetime.date(int(y), int(m), int(d))
            return f"{y}-{m}-{d}"
        except ValueError:
            continue
    return None


def test_dates_by_the_eight_digit_rule(spark):
    rng = random.Random(1)
    days = [datetime.date(1900, 1, 1) + datetime.timedelta(rng.randrange(46_000)) for _ in range(300)]
    iso = [d.isoformat() for d in days]
    assert apply(spark, lambda c: X.normalize_date(c, reference_compat=True), iso) == [reference_date(d.replace("-", "")) for d in iso]
    assert apply(spark, X.normalize_date, iso) == iso
    assert apply(spark, X.normalize_date, [d.strftime("%d/%m/%Y") for d in days]) == iso
    assert apply(spark, lambda c: X.normalize_date(c, reference_compat=True), ["2005-03-14"]) == ["0314-05-20"]
    assert apply(spark, X.normalize_date, ["30/02/2020", "1/2/2020", "٢٠٢٠-٠٢-٢٩", "", None, "x"]) == [None, None, "2020-02-29", None, None, None]


@pytest.mark.parametrize(
    ("kind", "value", "want"),
    [
        ("identifier", " ab-1 2 ", "AB12"),
        ("identifier", " - ", None),
        ("date", "1/2/2020", "2020-02-01"),
        ("date", "2020.2.1", "2020-02-01"),
        ("date", "20200201", None),
        ("date", "31/02/2020", None),
        ("sex", "féminin", "F"),
        ("sex", "ذكر", "M"),
        ("sex", "x", None),
        ("latin", "  Éric-Jean  d'A ", "ERIC JEAN D A"),
        ("latin", "علي", None),
        ("latin", "12", None),
        ("arabic", "عَلي  ب", "علي ب"),
        ("arabic", "عـلي", None),  # the stretching sign is a letter of no script
        ("arabic", "أحمد", "احمد"),
        ("arabic", "علي x", None),
    ],
)
def test_shared_values(spark, kind, value, want):
    assert apply(spark, lambda c: X.shared_value(c, kind), [value, None]) == [want, None]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_similarity(spark):
    rng = random.Random(2)
    pairs = [("", ""), ("", "a"), ("علي", "عليا"), (None, "a")] + [tuple("".join(rng.choice("abé") for _ in range(rng.randint(0, 7))) for _ in range(2)) for _ in range(100)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = [r["s"] for r in rows.select("i", X.similarity(F.col("a"), F.col("b")).alias("s")).orderBy("i").collect()]
    for (a, b), s in zip(pairs, got, strict=True):
        if a is None:
            assert s is None
        else:
            assert s == pytest.approx(1.0 if a == b else 0.0 if not a or not b else 1 - distance(a, b) / max(len(a), len(b)))


def test_printed_labels(spark):
    assert apply(spark, X.holds_printed_label, ["Nom: Dupont", "Nominal", "prénom Jean", "تاريخ الميلاد 1", "x"]) == [True, False, True, True, False]
    assert apply(spark, X.is_printed_label, ["NOM.", "Nom Dupont"]) == [True, False]


def test_scripts_names_and_confusables(spark):
    assert apply(spark, lambda c: X.script_share(c, "arabic"), ["علي ab", "12", None]) == [pytest.approx(0.6), None, None]
    assert apply(spark, X.name_form, ["Ali<<Ben  É."]) == ["ALI BEN E"]
    assert apply(spark, X.continuity_form, [" a b ", None]) == ["AB", ""]
    assert apply(spark, X.confusable_letters, ["1O2I3OZ", "12"]) == [["O", "I", "Z"], []]
    assert apply(spark, X.has_digits, ["a١", "b"]) == [True, False]
    assert apply(spark, X.trim_unicode, [" 　 x ﻿"]) == ["x"]


def test_hygiene(spark):
    got = apply(spark, lambda c: X.hygiene_outcomes(c, 10), ["a\x01", " ok ", "n/a", "x" * 11, "**bold", "fine", "é"])
    last = [(o[-1]["check"], o[-1]["outcome"]) for o in got]
    assert last == [("control_chars", "failed"), ("max_length", "passed"), ("placeholder", "failed"), ("max_length", "failed"), ("model_prose", "failed"), ("max_length", "passed"), ("max_length", "passed")]
    assert ("trimmed", "warning") in [(c["check"], c["outcome"]) for c in got[1]]
    assert ("unicode_nfc", "warning") in [(c["check"], c["outcome"]) for c in got[6]]
