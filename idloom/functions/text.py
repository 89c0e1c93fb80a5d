"""Text normalisation and comparison as Column expressions.

Everything runs in the JVM except Unicode normal forms, which Spark has no function for: ``unicode_form`` is an
Arrow-batched function over the standard library.
"""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Digits of the two Arabic-script blocks.
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
EASTERN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
#: Characters that count as white space besides Java's ASCII ``\s``.
WHITE = r"\s ﻿\p{Z}"

# What stands for "nothing" in extracted text.
PLACEHOLDERS = ["", "N/A", "NA", "UNKNOWN", "NONE", "NULL", "-", "--", "?", "???", "غير معروف", "لا يوجد"]

# Words for the two sexes as documents print them.
MALE = ["M", "MALE", "MASCULIN", "ذكر"]
FEMALE = ["F", "FEMALE", "FEMININ", "FÉMININ", "أنثى", "انثى"]

# Labels and titles that are printed on documents.
PRINTED_LABELS = [
    "اللقب",
    "الاسم",
    "الإسم",
    "تاريخ الميلاد",
    "مكان الميلاد",
    "الجنس",
    "فصيلة الدم",
    "زمرة الدم",
    "تاريخ الإصدار",
    "تاريخ الانتهاء",
    "رقم التعريف",
    "سلطة الإصدار",
    "سلطة",
    "SURNAME",
    "GIVEN NAME",
    "GIVEN NAMES",
    "NOM",
    "PRENOM",
    "PRÉNOM",
    "DATE OF BIRTH",
    "PLACE OF BIRTH",
    "NATIONALITY",
    "AUTHORITY",
    "SEX",
]
PRINTED_TITLES = [
    "رخصة السياقة",
    "بطاقة التعريف الوطنية",
    "بطاقة التعريف الوطنية البيومترية",
    "الجمهورية الجزائرية الديمقراطية الشعبية",
    "جواز السفر",
    "بطاقة إقامة",
    "شهادة الميلاد",
    "PERMIS DE CONDUIRE",
    "CARTE NATIONALE D'IDENTITÉ",
    "CARTE D'IDENTITÉ NATIONALE",
    "RÉPUBLIQUE ALGÉRIENNE DÉMOCRATIQUE ET POPULAIRE",
    "PASSEPORT",
    "RESIDENCE CERTIFICATE",
    "BIRTH CERTIFICATE",
]


@cache
def _normaliser(form: str):
    @F.arrow_udf(StringType())
    def normal_form(s: pa.Array) -> pa.Array:
        if pc.all(pc.string_is_ascii(s)).as_py() is not False:
            return s
        coded = s.dictionary_encode()  # a text that a batch repeats is normalised once
        forms = [unicodedata.normalize(form, x) for x in coded.dictionary.to_pylist()]
        return pa.array(forms, s.type).take(coded.indices)

    return normal_form


def unicode_form(c: Column, form: str) -> Column:
    """``c`` in NFC, NFD, NFKC or NFKD."""
    return _normaliser(form)(c)


def _beyond_ascii(c: Column, form: str) -> Column:
    """:func:`fold_digits` and then a normal form; null for ASCII texts, which neither changes and which don't go to Python."""
    return unicode_form(F.when(F.octet_length(c) > F.char_length(c), fold_digits(c)), form)


def trim_unicode(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{WHITE}]+|[{WHITE}]+$", "")


def trim_ascii(c: Column) -> Column:
    """:func:`trim_unicode` of ASCII texts, without a regular expression."""
    return F.trim(c, F.lit(" \t\n\x0b\f\r"))


def blank_to_null(c: Column) -> Column:
    """Null for a text that is empty or white space only; else the text unchanged."""
    return F.when(c.rlike(rf"[^{WHITE}]"), c)


def fold_digits(c: Column) -> Column:
    """Arabic-Indic and Eastern Arabic-Indic digits as ASCII digits."""
    return F.translate(c, ARABIC_DIGITS + EASTERN_DIGITS, "0123456789" * 2)


def normalize_identifier(c: Column, unicode: bool = True) -> Column:
    """ASCII letters and digits only, upper case; null if none are left. ``unicode=False`` skips the compatibility form
    for text that is known to be ASCII."""
    folded = fold_digits(c)
    folded = unicode_form(folded, "NFKC") if unicode else folded
    return F.nullif(F.upper(F.regexp_replace(folded, "[^0-9A-Za-z]", "")), F.lit(""))


def let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once, however often ``fn`` uses it (a one-element transform), so that nested
    expressions don't multiply in the generated code."""
    return F.get(F.transform(F.array(value), fn), 0)


def _iso_if_real(year: Column, month: Column, day: Column, pad_year: bool = True) -> Column:
    """``YYYY-MM-DD`` if the calendar has that day, else null; year 0 counts."""
    y, m, d = F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")
    shown = y if pad_year else year.cast("int").cast("string")
    return F.when(F.try_to_date(F.concat_ws("-", y, m, d), "yyyy-MM-dd").isNotNull(), F.concat_ws("-", shown, m, d))


def normalize_date(c: Column, reference_compat: bool = False, unicode: bool = True) -> Column:
    """An eight-digit date as ``YYYY-MM-DD``, else null.

    With ``reference_compat`` the digits are always tried day first, so an ISO date whose year begins like a day and a
    month (1901-1912, 2001-2012) is misread. By default a text that starts with four digits and a separator is read
    year first.
    """
    digits = F.regexp_replace(normalize_identifier(c, unicode), "[^0-9]", "")
    iso = F.lit(False) if reference_compat else F.coalesce(fold_digits(c).rlike(r"^\s*[0-9]{4}[-/. ]"), F.lit(False))

    def read(v: Column) -> Column:
        part = lambda a, n: F.substring(v["digits"], a, n)
        day_first = _iso_if_real(part(5, 4), part(3, 2), part(1, 2))
        year_first = _iso_if_real(part(1, 4), part(5, 2), part(7, 2))
        return F.when(F.length(v["digits"]) == 8, F.coalesce(F.when(v["iso"], year_first), day_first, year_first))

    return let(F.struct(digits.alias("digits"), iso.alias("iso")), read)


def shared_value(c: Column, kind: str) -> Column:
    """A value in the form in which two readings of one fact are compared; null if it can't be compared.

    Kinds: identifier, date (delimited only), sex, latin, arabic.
    """
    base = F.coalesce(trim_unicode(_beyond_ascii(c, "NFKC")), trim_ascii(c))
    if kind == "date":
        parts = lambda v: F.struct(*[c.alias(p) for p, c in _date_parts(v).items()])
        return let(base, lambda v: let(parts(v), lambda p: _shared_date(p["year"], p["month"], p["day"])))
    return _shared_name(base, F.coalesce(_beyond_ascii(c, "NFKD"), c), kind) if kind in _SCRIPTS else _shared_word(base, kind)


# The scripts of names, and the parts of a date, which is written year first or day first.
_SCRIPTS = {"arabic": "IsArabic", "latin": "IsLatin"}
_DATE_PARTS = {
    "year": r"^(?:(?=\d{4}[-/.]\d{1,2}[-/.]\d{1,2}$)|\d{1,2}[-/.]\d{1,2}[-/.](?=\d{4}$))(\d{4})",
    "month": r"^(?:\d{4}[-/.](?=\d{1,2}[-/.]\d{1,2}$)|\d{1,2}[-/.](?=\d{1,2}[-/.]\d{4}$))(\d{1,2})",
    "day": r"^(?:\d{4}[-/.]\d{1,2}[-/.](?=\d{1,2}$)|(?=\d{1,2}[-/.]\d{1,2}[-/.]\d{4}$))(\d{1,2})",
}


def _shared_word(base: Column, kind: str) -> Column:
    if kind == "identifier":
        return F.nullif(F.upper(F.regexp_replace(base, rf"[{WHITE}-]", "")), F.lit(""))
    word = F.upper(base)
    return F.when(word.isin(MALE), F.lit("M")).when(word.isin(FEMALE), F.lit("F"))


def _shared_name(base: Column, decomposed: Column, kind: str, known: Column | None = None) -> Column:
    """The words of a name in ``kind``'s script; where ``known``, they are just ``base`` in upper case."""
    script = _SCRIPTS[kind]
    # a letter of the script and none of another
    fits = base.rlike(rf"^\P{{L}}*+[\p{{L}}&&\p{{{script}}}][\P{{L}}\p{{{script}}}]*\z")
    plain = F.upper(F.regexp_replace(decomposed, r"\p{M}|ـ", ""))
    name = F.when(fits, F.nullif(F.trim(F.regexp_replace(plain, r"\P{L}+", " ")), F.lit("")))
    return name if known is None else F.when(known, F.upper(base)).otherwise(name)


def _date_parts(base: Column) -> dict[str, Column]:
    """Year, month and day of a delimited date, which may be no day of the calendar; null for other texts."""
    return {p: F.regexp_extract(base, pattern, 1).try_cast("int") for p, pattern in _DATE_PARTS.items()}


def _shared_date(year: Column, month: Column, day: Column) -> Column:
    """``Y-MM-DD`` if the calendar has that day, else null; year 0 counts. Days are counted, as a date that can't be parsed
    costs an exception."""
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    days = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    return F.when(month.between(1, 12) & (day >= 1) & (day <= days), F.concat_ws("-", year.cast("string"), two(month), two(day)))


def with_shared_values(rows: DataFrame, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """``rows`` with the :func:`shared_value` of columns: ``wanted`` has the new column's name, the column and its kind.

    Step by step, each a column of its own, so that Spark generates code for all of it (a :func:`let` runs interpreted)
    and nothing is computed twice.
    """
    names = [n for n, (_, k) in wanted.items() if k in _SCRIPTS]
    dates = [n for n, (_, k) in wanted.items() if k == "date"]
    step = lambda n, name: F.col(f"`{n}|{name}`")
    held = rows.columns
    given = {n: F.col(f"`{c}`") for n, (c, _) in wanted.items()}
    # both forms by one pass through Python
    forms = {f"{n}|base": F.coalesce(trim_unicode(_beyond_ascii(c, "NFKC")), trim_ascii(c)) for n, c in given.items()}
    rows = rows.withColumns(forms | {f"{n}|nfkd": F.coalesce(_beyond_ascii(given[n], "NFKD"), given[n]) for n in names})
    if dates:
        rows = rows.withColumns({f"{n}|{p}": c for n in dates for p, c in _date_parts(step(n, "base")).items()})

    def form(n: str, kind: str) -> Column:
        base = step(n, "base")
        if kind == "date":
            return _shared_date(step(n, "year"), step(n, "month"), step(n, "day"))
        if kind not in _SCRIPTS:
            return _shared_word(base, kind)
        # letters A to Z with single spaces between
        known = base.rlike(r"^[A-Za-z ]+\z") & ~F.contains(base, F.lit("  ")) if kind == "latin" else None
        return _shared_name(base, step(n, "nfkd"), kind, known)

    return rows.select(*[F.col(f"`{c}`") for c in held], *[form(n, k).alias(n) for n, (_, k) in wanted.items()])


def similarity(a: Column, b: Column) -> Column:
    """1 for equal texts, 0 if one is empty, else 1 - edits / longer length."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, F.lit(1.0)).when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).when(a.isNotNull() & b.isNotNull(), 1 - F.levenshtein(a, b) / longer)


def printed_form(c: Column, unicode: bool = True) -> Column:
    """Letters and digits in upper case without marks, single spaces between."""
    plain = F.regexp_replace(unicode_form(c, "NFD") if unicode else c, r"\p{M}", "")
    return F.trim(F.regexp_replace(F.upper(plain), r"[^\p{L}\p{N}]+", " "))


def printed_phrases() -> list[str]:
    def form(x: str) -> str:
        x = "".join(ch for ch in unicodedata.normalize("NFD", x) if not unicodedata.category(ch).startswith("M")).upper()
        return " ".join("".join(ch if unicodedata.category(ch)[0] in "LN" else " " for ch in x).split())

    return list(dict.fromkeys(map(form, PRINTED_LABELS + PRINTED_TITLES)))


def holds_printed_label(c: Column, unicode: bool = True) -> Column:
    """Whether a printed label or title occurs in the text as whole words."""
    text = F.concat(F.lit(" "), printed_form(c, unicode), F.lit(" "))
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(f" {p} ")) for p in printed_phrases()])


def is_printed_label(c: Column) -> Column:
    """Whether the whole text is a printed label or title."""
    return printed_form(c).isin(printed_phrases())


def name_form(c: Column) -> Column:
    """Upper-case A-Z words for loose comparison of transliterated names."""
    plain = F.upper(F.regexp_replace(unicode_form(c, "NFD"), r"[̀-ͯ]", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "[^A-Z\\s]", " "), r"\s+", " "))


def continuity_form(c: Column) -> Column:
    """Upper case without white space; null like empty."""
    return F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), rf"[{WHITE}]+", ""))


def script_shares(c: Column) -> Column:
    """(arabic, latin): shares of the letters that belong to either script; null without letters. The text is read once
    for its letters; the scripts are then told apart among these."""
    own = lambda v, script: F.length(v) - F.length(F.regexp_replace(v, rf"\p{{{script}}}+", ""))
    share = lambda v, script: F.when(F.length(v) > 0, own(v, script) / F.length(v))
    return let(F.regexp_replace(c, r"\P{L}+", ""), lambda v: F.struct(share(v, "IsArabic").alias("arabic"), share(v, "IsLatin").alias("latin")))


def script_share(c: Column, script: str) -> Column:
    """The share of ``arabic`` or ``latin`` letters: see :func:`script_shares`."""
    return script_shares(c)[script]


def hygiene_outcomes(c: Column, max_length: int) -> Column:
    """The checks of one extracted value in order, as an array of (check, outcome); the first failure ends the list."""
    trimmed = trim_unicode(c)
    normal = unicode_form(trimmed, "NFC")
    one = lambda name, outcome: F.struct(F.lit(name).alias("check"), F.lit(outcome).alias("outcome"))
    some = lambda cond, *items: F.when(cond, F.array(*items)).otherwise(F.array().cast("array<struct<check:string,outcome:string>>"))
    # Control characters, and the beginnings of what a model says instead of a value.
    control = c.rlike(r"[\u0000-\u0008\u000B-\u001F\u007F-\u009F]")
    placeholder = F.upper(normal).isin(PLACEHOLDERS) | normal.isin(PLACEHOLDERS)
    long_ = F.length(normal) > max_length
    prose = normal.rlike(r"(?i)^```|\*\*|^Here (is|are)\b|^The \w+ is\b")
    warnings = F.concat(some(c != trimmed, one("trimmed", "warning")), some(normal != trimmed, one("unicode_nfc", "warning")))
    start = F.array(one("control_chars", "passed"))
    after_placeholder = F.concat(start, warnings, F.array(one("placeholder", "passed")))
    after_length = F.concat(after_placeholder, F.array(one("max_length", "passed")))
    return (
        F.when(control, F.array(one("control_chars", "failed")))
        .when(placeholder, F.concat(start, warnings, F.array(one("placeholder", "failed"))))
        .when(long_, F.concat(after_placeholder, F.array(one("max_length", "failed"))))
        .when(prose, F.concat(after_length, F.array(one("model_prose", "failed"))))
        .otherwise(after_length)
    )


def has_digits(c: Column) -> Column:
    return c.rlike(rf"[0-9{ARABIC_DIGITS}{EASTERN_DIGITS}]")


def has_filler(c: Column) -> Column:
    return F.contains(c, F.lit("<"))


def confusable_letters(c: Column) -> Column:
    """Distinct letters of a digit field that are easily misread digits, in order of appearance."""
    # Fixed value: the letters that look like digits.
    return F.array_distinct(F.regexp_extract_all(c, F.lit("([OIZSGB])"), 1))


def only_texts(raw: Column) -> Column:
    """The texts of a JSON list, without its other items; an empty list for what isn't a list."""
    items = F.coalesce(F.try_variant_get(F.try_parse_json(raw), "$", "array<variant>"), F.array().cast("array<variant>"))
    return F.transform(F.filter(items, lambda v: v.isNotNull() & (F.schema_of_variant(v) == "STRING")), lambda v: F.try_variant_get(v, "$", "string"))


def trim_url(c: Column) -> Column:
    """A URL without slashes at its end."""
    return F.regexp_replace(c, "/+$", "")


def url_origin(c: Column) -> Column:
    """Scheme and host (with its port) of a URL; null if it isn't one."""
    scheme, host = F.try_parse_url(c, F.lit("PROTOCOL")), F.try_parse_url(c, F.lit("AUTHORITY"))
    return F.when(scheme.isNotNull() & host.isNotNull(), F.concat(F.lower(scheme), F.lit("://"), F.lower(F.regexp_replace(host, "^[^@]*@", ""))))
