import datetime

import pytest
from pyspark.sql import functions as F

from paperloom.functions import formats, fuzzy
from paperloom.functions import values as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(x):
    if isinstance(x, bool):
        return V.boolean(F.lit(x))
    if isinstance(x, (int, float)):
        return V.number(F.lit(float(x)))
    return V.text(F.lit(x))


@pytest.mark.parametrize("value, present, number, text", [
    ("", False, None, ""), (" ", True, None, " "), ("0", True, None, "0"), (0, False, 0.0, "0"), (2.5, True, 2.5, "2.5"),
    (10, True, 10.0, "10"), (True, True, 1.0, "True"), (False, False, 0.0, "False"), (None, False, None, None),
])
def test_value_semantics(spark, value, present, number, text):
    for v in (lit(value), *([V.Static({str: "string", float: "number", int: "number", bool: "bool"}[type(value)], F.lit(value).cast({str: "string", float: "double", int: "double", bool: "boolean"}[type(value)]))] if value is not None else [])):
        assert one(spark, V.present(v)) is present
        assert one(spark, V.as_number(v)) == number
        assert one(spark, V.as_text(v)) == text


@pytest.mark.parametrize("text, day", [
    ("2024-09-15", (2024, 9, 15)), (" 20240915 ", (2024, 9, 15)), ("03/04/2026", (2026, 3, 4)), ("13/04/2026", (2026, 4, 13)), ("March 4, 2026", (2026, 3, 4)),
    ("Mar 4, 2026", (2026, 3, 4)), ("4 March 2026", (2026, 3, 4)), ("2026/3/4", (2026, 3, 4)), ("soon", None), ("", None), (None, None),
])
def test_dates(spark, text, day):
    assert one(spark, V.as_date(F.lit(text).cast("string"))) == (datetime.date(*day) if day else None)


@pytest.mark.parametrize("text, amount", [
    ("shall not exceed US $96,000", 96000.0), ("twelve (12) months, $1,2o0.50.", 1200.5), ("12 months", 12.0), ("€ 5", 5.0), ("none", None), ("a1", None), ("$.", None), (None, None),
])
def test_to_number(spark, text, amount):
    assert one(spark, V.to_number(F.lit(text).cast("string"))) == amount


@pytest.mark.parametrize("text, key", [("Acme Ltd.", "acme"), (" ACME  Limited Company", "acme"), ("Company", "company"), ("Co Op Works", "co op works"), ("Straße GmbH", "strasse"), (None, None)])
def test_company_key(spark, text, key):
    assert one(spark, V.company_key(F.lit(text).cast("string"))) == key


def test_text_helpers(spark):
    assert one(spark, V.dedup_key(F.lit("ACME ROBOTICS INC. (Provider)"))) == "acme robotics inc"
    assert one(spark, V.tokens(F.lit("vendorName_2"), F.lit("Total, 15"))) == ["vendor", "name", "total"]
    assert one(spark, V.index_free_path(F.lit("line_items.0.amount"))) == "line_items.amount"
    assert [one(spark, V.column_letters(F.lit(n))) for n in (0, 25, 26, 701, 702, 18277)] == ["A", "Z", "AA", "ZZ", "AAA", "ZZZ"]
    assert one(spark, V.slug(F.lit("--Read/Er 2--"))) == "read-er-2" and one(spark, V.slug(F.lit("!!"))) == "engine"
    assert one(spark, V.looks_numeric(F.lit("$1,200"))) is True and one(spark, V.looks_numeric(F.lit("x1"))) is False


@pytest.mark.parametrize("name, good, bad", [
    ("iban", ["DE89 3704 0044 0532 0130 00", "gb82west12345698765432"], ["DE88370400440532013000", "DE", ""]),
    ("luhn", ["4539 1488 0343 6467", "79927398713"], ["79927398714", "0", "12a4"]), ("email", [" a@b.co "], ["a@b", "a b@c.d"]),
    ("url", ["https://x.y"], ["ftp://x"]), ("uuid", ["123e4567-e89b-12d3-a456-426614174000"], ["123e4567"]), ("digits", ["123", "١٢"], ["1.2"]),
    ("alphanumeric", ["aZ9"], ["a-9"]), ("iso_currency", ["eur "], ["EURO"]),
])
def test_formats(spark, name, good, bad):
    for values, want in ((good, True), (bad, False)):
        for v in values:
            assert one(spark, formats.check(F.lit(v), name)) is want, v


def test_formats_of_nothing_and_country(spark):
    assert one(spark, formats.check(F.lit(None).cast("string"), "iban")) is None
    codes = ["DE", "FR"]
    assert one(spark, formats.check(F.lit("de"), "iso_country", codes)) and not one(spark, formats.check(F.lit("XX"), "iso_country", codes))
    for name in ("no such", "iso_country"):
        with pytest.raises(ValueError):
            formats.check(F.lit("x"), name)


def test_similarity(spark):
    rows = spark.createDataFrame([("acme ltd", "acme limited"), ("a", "a"), ("abc", "xyz"), ("a", "abcdefgh"), (None, "a")], "a string, b string")
    got = [r.x for r in rows.select(fuzzy.ratio_at_least(F.col("a"), F.col("b"), 0.8).alias("x")).collect()]
    assert got == [True, True, False, False, None]
    assert spark.createDataFrame([("é",)], "s string").select(fuzzy.without_accents("s")).first()[0] == "e"
