"""What jobs leave on disk while they run: shuffle files go with their write, big files are compressed."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from invoicelens.plans.joins import BLOCK, ROW, _marked, first_absent
from invoicelens.session import RELEASE, materialise, releasing_shuffles, shared_folder
from invoicelens.sources.workbook import ORDER


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    rows = spark.range(10_000).repartition(3, "id")
    tables = [materialise(rows) for _ in range(2)]  # the same rows can be written again
    until = time.time() + 20
    while _shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before and [t.count() for t in tables] == [10_000] * 2


def test_the_setting_is_put_back(spark):
    before = spark.conf.get(RELEASE, None)
    with releasing_shuffles(spark), releasing_shuffles(spark):
        assert spark.conf.get(RELEASE) == "true"
    assert spark.conf.get(RELEASE, None) == before


def test_files_with_headers_are_compressed_and_read_whole(spark, driver_entry):
    folder = "/root/testdata/sf0.001"
    before = set(Path(shared_folder(spark)).glob("headed-*"))
    found = driver_entry.queries()["i02_encabezado_por_archivo"](spark, folder)
    plain = driver_entry.queries()["i02_carga_por_encabezado"](spark, folder)
    digest = F.sum(F.xxhash64(*plain.columns).cast("decimal(38,0)"))
    assert found.agg(F.count(F.lit(1)), digest).first() == plain.agg(F.count(F.lit(1)), digest).first()
    (place,) = set(Path(shared_folder(spark)).glob("headed-*")) - before
    files = [f.name for f in place.rglob("part-*")]
    assert files and all(name.endswith(".csv.gz") for name in files)


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return [line for line in plan if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line]


def test_whole_rows_stay_where_they_are_when_most_keys_are_stored(spark):
    """A new load of rows that are nearly all stored moves numbers, no cells."""
    rows = spark.range(200_000).selectExpr("CAST(id % 190000 AS STRING) AS k", "id % 7 AS l", "uuid() AS cell", "-id AS o")
    stored = spark.range(10, 300_000).selectExpr("CAST(id AS STRING) AS k", "id % 7 AS l")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = first_absent(rows, stored, ["k", "l"], ["o"])
        moved = _exchanges(found)
        kept = {(r["k"], r["o"]) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert len(moved) == 1  # the marks
    given = {}
    for i in range(200_000):
        if not (i % 190_000 >= 10 and i % 190_000 % 7 == i % 7):
            key = (str(i % 190_000), i % 7)
            given[key] = min(-i, given.get(key, 0))
    assert kept == {(k, o) for (k, _), o in given.items()}


def test_marks_of_many_blocks_and_none(spark):
    rows = spark.range(3 * BLOCK).withColumnRenamed("id", ROW)
    for gone in ([], [0], [7, 8, BLOCK - 1, BLOCK, 3 * BLOCK - 1]):
        left, marked = _marked(rows, ROW, spark.createDataFrame([(n,) for n in gone], f"{ROW} bigint"))
        assert sorted(r[0] for r in left.filter(marked).collect()) == gone and left.filter(~marked).count() == 3 * BLOCK - len(gone)


def test_new_invoices_are_written_once_and_not_moved(spark, driver_entry):
    found = driver_entry.queries()["i12_insertar_comprobantes"](spark, "/root/testdata/sf0.001")
    assert len(_exchanges(found)) == 1 and not {ROW, ORDER} & set(found.columns)


def test_keys_of_other_types_are_refused(spark):
    with pytest.raises(ValueError):
        first_absent(spark.range(3).selectExpr("id AS k", "id AS o"), spark.range(3).selectExpr("CAST(id AS INT) AS k"), ["k"], ["o"])
