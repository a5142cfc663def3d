"""Plain cells are told by a cheap test; they and all others give what the general way gives, and are converted once."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from invoicelens.functions import convert
from invoicelens.plans.joins import absent_from, first_absent, first_per_key
from invoicelens.sources import workbook as book

CELLS = [  # cell, text, strict number, leading money, whole number, day
    (None, None, 0, D(0), None, None), ("", None, 0, D(0), None, None), ("7", "7", 7, D(7), 7, None),
    ("-7.5", "-7.5", -7.5, D("-7.5"), None, None), ("12.", "12.", 12, D(12), None, None), (" 7 ", "7", 7, D(7), 7, None),
    ("1٣4", "1٣4", 0, D(1), None, None), ("7\u0085", "7\u0085", 0, D(7), None, None), (" 7 ", "7", 7, D(7), 7, None),
    ("1" * 19, "1" * 19, 1111111111111111111.0, None, None, None), ("9" * 400, "9" * 400, 0, None, None, None),
    ("0x1p3", "0x1p3", 0, D(0), None, None), ("1e2", "1e2", 100, D(100), None, None), ("é b ", "é b", 0, D(0), None, None),
    ("2024-02-30", "2024-02-30", 0, D(2024), None, None), ("2024-02-29", "2024-02-29", 0, D(2024), None, dt.date(2024, 2, 29)),
    (" 2024-02-29", "2024-02-29", 0, D(2024), None, dt.date(2024, 2, 29)), ("a\tb", "a\tb", 0, D(0), None, None),
]


def test_plain_and_other_cells(spark):
    cells = spark.createDataFrame([(i, row[0]) for i, row in enumerate(CELLS)], "i int, c string")
    ways = (convert.to_text, convert.strict_number, convert.leading_money, convert.whole_number, convert.to_day)
    found = cells.select("i", "c", *[way(F.col("c")).alias(f"x{k}") for k, way in enumerate(ways)]).orderBy("i").collect()
    assert [tuple(row)[1:] for row in found] == CELLS


@pytest.mark.parametrize("day", ["2000-01-01", "2030-01-01"])
def test_filters_do_not_repeat_conversions(spark, day):
    raw = spark.createDataFrame([("7", "F1", "2001-02-03"), ("0", "F2", "2001-02-03"), ("8", " ", "2001-02-03")],
                                "Cliente string, Comprobante string, Fecha string")
    kept = book.headed_rows(raw).filter(F.col("Fecha") < day).select("Cliente", "Comprobante", "Fecha")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 3
    assert [r[0] for r in kept.collect()] == ([] if day == "2000-01-01" else [7])


def test_plain_cells_need_no_function_over_a_value(spark):
    """The general way comes behind the test for plain cells."""
    cells = spark.range(1).select(F.col("id").cast("string").alias("c"))
    for way in (convert.to_text, convert.strict_number, convert.leading_money, convert.whole_number, convert.to_day):
        plan = cells.select(way(F.col("c")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert "CASE WHEN" in plan.split("transform(")[0]


def test_first_absent_is_absent_first(spark):
    """Stored keys go before the ranking; a row with a NULL key part meets no other, stored or not."""
    rows = spark.createDataFrame([("a", 1, 2), ("a", 1, 1), ("b", 1, 1), ("b", 1, 1), (None, 1, 1), (None, 1, 1), ("c", None, 3)],
                                 "k string, l int, o int")
    stored = spark.createDataFrame([("b", 1), (None, 1), ("c", None), ("z", 9), ("b", 1)], "k string, l int")
    found = first_absent(rows, stored, ["k", "l"], ["o"])
    expected = absent_from(first_per_key(rows, ["k", "l"], ["o"]), stored, ["k", "l"])
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, expected.collect()), key=repr)
    assert sorted(map(tuple, found.collect()), key=repr) == [("a", 1, 1), ("c", None, 3), (None, 1, 1), (None, 1, 1)]


def test_a_load_report_converts_its_rows_once(spark, driver_entry):
    report = driver_entry.queries()["i13_informe_de_carga"](spark, "/root/testdata/sf0.001")
    assert "regexp_extract(" not in report._jdf.queryExecution().optimizedPlan().toString()


def test_first_absent_moves_only_keys(spark):
    rows = spark.range(1000).selectExpr("id % 990 AS k", "'wide' AS cell", "id AS o")
    stored = spark.range(5).selectExpr("id AS k")
    found = first_absent(rows, stored, ["k"], ["o"])
    assert found.count() == 985 and found.agg({"o": "max"}).first()[0] == 989
    plan = found._jdf.queryExecution().executedPlan().toString()
    # Only rows of repeated keys are moved.
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


SPACED = [  # cell, plain, strict number, strict integer, leading money, whole number
    (" 7", True, 7, 7, D(7), 7), ("7  ", True, 7, 7, D(7), 7), ("  -7.50 ", True, -7.5, -7, D("-7.5"), None), (" +7. ", True, 7, 7, D(7), None),
    (" 7 7", False, 0, 0, D(7), None), (" - 7", False, 0, 0, D(0), None), ("   ", False, 0, 0, D(0), None), ("\t7 ", False, 7, 7, D(7), 7),
    ("\u00a07", False, 7, 7, D(7), 7), ("\x017", False, 0, 0, D(0), 7), (" 7f", False, 0, 0, D(7), None), (" 0x10 ", False, 16, 16, D(0), None),
]


def test_digits_with_spaces_around_are_plain(spark):
    """They need no function over a value, and give what the general way gives."""
    cells = spark.createDataFrame([(i, row[0]) for i, row in enumerate(SPACED)], "i int, c string")
    ways = (convert.strict_number, convert.strict_integer, convert.leading_money)
    found = cells.orderBy("i").select("c", F.col("c").rlike(convert.PLAIN_NUMBER), *[way(F.col("c")) for way in ways]).collect()
    assert [tuple(row) for row in found] == [row[:5] for row in SPACED]
    whole = cells.filter(~F.col("c").contains(".")).orderBy("i").select("c", convert.whole_number(F.col("c"))).collect()
    assert [tuple(row) for row in whole] == [(row[0], row[5]) for row in SPACED if "." not in row[0]]
