import datetime as dt

import pytest
from pyspark.sql import functions as F

from invoicelens.functions import calendar, convert, text


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(build(F.col("c"))).first()[0]


@pytest.mark.parametrize("cell, expected", [
    (None, 0), ("", 0), ("  ", 0), (" 12.5 ", 12.5), ("12abc", 0), ("abc", 0), ("-2.5", -2.5), ("1e3", 1000), (" 7", 7),
    ("12d", 0), ("12f", 0), ("Infinity", 0), ("-Infinity", 0), ("NaN", 0), ("1e400", 0), ("0x10", 16), ("0XfF", 255), ("0x", 0), ("+.5e1", 5),
])
def test_strict_number(spark, cell, expected):
    assert one(spark, cell, convert.strict_number) == expected


@pytest.mark.parametrize("cell, expected", [("-2.5", -2), ("2.5", 3), ("-2.6", -3), ("x", 0), (None, 0)])
def test_strict_integer_rounds_halves_up(spark, cell, expected):
    assert one(spark, cell, convert.strict_integer) == expected


@pytest.mark.parametrize("cell, expected", [
    ("12abc", 12), ("  -3.5kg", -3.5), (".5", 0.5), ("1.", 1), ("abc", 0), ("", 0), (None, 0), ("1e2x", 100), ("+4", 4),
])
def test_leading_number(spark, cell, expected):
    assert one(spark, cell, convert.leading_number) == expected


def test_amount_that_does_not_fit(spark):
    assert one(spark, "1e20", convert.leading_money) is None
    assert one(spark, "99999999999999.9999", convert.leading_money) is not None


@pytest.mark.parametrize("result, value, expected", [("5", "9", 5), ("0", "9", 9), ("", "9", 9), (None, "9x", 9), ("0.0", "3", 3), ("a", "3", 0)])
def test_formula_number(spark, result, value, expected):
    frame = spark.createDataFrame([(result, value)], "r string, v string")
    assert frame.select(convert.formula_number(F.col("r"), F.col("v"))).first()[0] == expected


@pytest.mark.parametrize("cell, expected", [
    ("2024-02-29", dt.date(2024, 2, 29)), ("2024-02-30", None), ("2024-01-31T10:00:00", dt.date(2024, 1, 31)),
    ("2024-01-31T23:30:00-03:00", dt.date(2024, 2, 1)), ("2024-01-31T23:30:00Z", dt.date(2024, 1, 31)),
    ("3/4/2024", dt.date(2024, 3, 4)), ("pendiente", None), ("", None), (None, None),
])
def test_to_day(spark, cell, expected):
    assert one(spark, cell, convert.to_day) == expected


def test_to_day_does_not_depend_on_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert one(spark, "2024-01-31T23:30:00-03:00", convert.to_day) == dt.date(2024, 2, 1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("cell, expected", [(" a\t", "a"), (" ﻿", None), ("", None), (None, None)])
def test_to_text(spark, cell, expected):
    assert one(spark, cell, convert.to_text) == expected


def test_text_helpers(spark):
    assert one(spark, "a\u0000b", text.without_nul) == "ab"
    assert one(spark, 1234567.891, text.es_ar_number, "double") == "1.234.567,89"
    assert one(spark, 1234.5678, lambda c: text.es_ar_number(c, 3), "double") == "1.234,568"
    assert one(spark, 1234.5, lambda c: text.es_ar_number(c, 3), "double") == "1.234,50"
    assert one(spark, 1234.56, text.pesos, "double") == "$1.234,56"
    assert one(spark, "postgresql://u:p@h/db", text.mask_credentials) == "postgresql:****@h/db"
    assert one(spark, "a:@b:c@d", text.mask_credentials) == "a:@b:****@d"
    assert one(spark, "none", text.mask_credentials) == "none"
    assert one(spark, " a , b", text.split_list) == ["a", "b"] and one(spark, " ", text.split_list) == []
    assert one(spark, "fac123", text.document_type) == "FAC"


@pytest.mark.parametrize("hour, expected", [(7, "night"), (8, "morning"), (16, "morning"), (17, "afternoon"), (22, "afternoon"), (23, "night")])
def test_day_part(spark, hour, expected):
    moment = dt.datetime(2024, 5, 1, hour, 30)
    assert one(spark, moment, calendar.day_part, "timestamp_ntz") == expected


def test_weekday(spark):
    sunday = dt.date(2024, 3, 3)
    assert one(spark, sunday, calendar.weekday_number, "date") == 0
    assert one(spark, sunday, calendar.weekday_name, "date") == "Sunday   "


@pytest.mark.parametrize("convert_cell", [
    convert.to_text, convert.to_day, convert.strict_integer, convert.strict_number, convert.whole_number, convert.leading_money])
def test_a_cell_is_read_once(spark, convert_cell):
    plan = spark.range(1).select(F.col("id").cast("string").alias("c")).select(convert_cell(F.col("c")).alias("x"))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("regexp_replace(") + text.count("regexp_extract(") == 1
