"""Every registered query against its SQL in another engine."""

import datetime as dt
import decimal

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, decimal.Decimal):
        return "0" if value == 0 else format(value.normalize(), "f")
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return str(value)


def registered():
    from pathlib import Path
    import importlib.util
    path = Path(__file__).resolve().parent.parent / "__spark_entry__.py"
    spec = importlib.util.spec_from_file_location("spark_entry_names", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return sorted(module.oracle_sql())


@pytest.mark.parametrize("key", registered())
def test_same_rows(spark, driver_entry, duck, key):
    frame = driver_entry.queries()[key](spark, SF)
    columns = sorted(frame.columns)
    ours = sorted(tuple(plain(row[c]) for c in columns) for row in frame.collect())
    cursor = duck.execute(driver_entry.oracle_sql()[key])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in cursor.fetchall())
    assert ours == theirs


def test_every_query_of_the_engine_has_sql(driver_entry):
    from oracle import all_sql
    own = {name for name in driver_entry.queries() if not name.startswith("op") and name != "pipeline"}
    assert own == set(all_sql())
    assert not set(driver_entry.oracle_sql()) - set(driver_entry.queries())


def test_entry(spark, driver_entry):
    assert driver_entry.entry(spark).count() > 0
