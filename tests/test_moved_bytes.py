"""What the stored fact and the mapping of the tables move: only what is needed, and all of it."""

import datetime as dt
from pathlib import Path

from pyspark.sql import functions as F

from invoicelens.plans.params import MONTH
from invoicelens.schema import fact_schema
from invoicelens.sources import samples, store

DAYS = (dt.date(2024, 2, 29), None, dt.date(2024, 1, 31), dt.date(2024, 2, 1), dt.date(2024, 2, 1))
TABLES = {
    "nation": ([(1, "N")], "n_nationkey int, n_name string"),
    "customer": ([(1, "C", 1, "S"), (2, "D", 1, "S")], "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string"),
    "supplier": ([(1, "P", 1)], "s_suppkey bigint, s_name string, s_nationkey int"),
    "part": ([(k, f"A{k}", "B", "T", 3, 10.0) for k in (1, 2)],
             "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
    "orders": ([(1, 1, dt.datetime(2024, 1, 1)), (2, 2, dt.datetime(2024, 2, 1)), (3, 9, dt.datetime(2024, 2, 1))],
               "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz"),
    "lineitem": ([(1, 1, 1, 1, 2.0, 20.0, 0.1), (1, 2, 1, 2, 2.0, 20.0, 0.1), (2, 2, 1, 1, 1.0, 10.0, 0.0), (2, 2, 1, 1, 1.0, 10.0, 0.0),
                  (2, 7, 1, 2, 1.0, 10.0, 0.0), (3, 1, 1, 1, 1.0, 10.0, 0.0), (None, 1, 1, 1, 1.0, 10.0, 0.0)],
                 "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double"),
}


def _fact(spark):
    empty = {c: None for c in fact_schema().names}
    rows = [tuple({**empty, "fecha": day, "idunica": str(i)}.values()) for i, day in enumerate(DAYS)]
    return spark.createDataFrame(rows, fact_schema())


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def test_rows_move_without_their_month(spark):
    plan = _optimized(store._laid_out(_fact(spark), 2))
    moved = next(i for i, line in enumerate(plan) if "RepartitionByExpression" in line)
    assert any("Project" in line for line in plan[:moved]) and not any("Project" in line or MONTH in line for line in plan[moved:])


def test_stored_rows_have_their_month_and_are_compressed(spark, tmp_path):
    path = str(tmp_path / "fact")
    store.create_fact(spark, path)
    store.append_fact(_fact(spark), path, 2)
    found = store.read_fact(spark, path).select("idunica", "fecha", MONTH).orderBy("idunica").collect()
    assert [tuple(row) for row in found] == [(str(i), day, day and f"{day:%Y-%m}") for i, day in enumerate(DAYS)]
    files = list(Path(path).rglob("*.parquet"))
    assert files and all(file.name.endswith(".zstd.parquet") for file in files)


def test_lines_meet_their_orders_first(spark, tmp_path):
    for name, (rows, schema) in TABLES.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    fact = samples.sales_fact(spark, str(tmp_path))
    found = fact.orderBy("idunica").select("idunica", "cliente", "articulo", "razon_social").collect()
    assert [tuple(row) for row in found] == [("1-1", 1, "A1", "C"), ("1-2", 1, "A2", "C"), ("2-1", 2, "A2", "D"), ("2-1", 2, "A2", "D")]
    plan = _optimized(fact.filter(F.col("fecha") < "2024-02-01"))
    at = {key: next(line.index("Join") for line in plan if "Join" in line and key in line) for key in ("l_orderkey", "l_partkey", "l_suppkey")}
    assert at["l_orderkey"] > max(at["l_partkey"], at["l_suppkey"])
