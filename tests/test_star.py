"""The star load, stored partitions, the plain append and what a rewrite keeps."""

import pytest
from pyspark.sql import functions as F

from invoicelens.sources import partitions, samples, star, store, vector_store, workbook

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def raw(spark):
    return samples.headed_workbook(spark, SF).limit(300).cache()


def test_the_same_load_twice_adds_nothing(spark, raw, tmp_path):
    folder = str(tmp_path / "star")
    first, again = star.load_star(raw, folder).first(), star.load_star(raw, folder).first()
    rows = workbook.headed_rows(raw)
    assert first["totalRows"] == rows.count() == first["insertedRows"] + first["skippedRows"] and first["insertedRows"] > 0
    assert (again["insertedRows"], again["skippedRows"]) == (0, first["totalRows"])
    assert star.read_invoices(spark, folder, rows).count() == first["insertedRows"]
    for name in star.DIMENSION_CELLS:
        key = star.DIMENSION_CELLS[name][1]
        stored = star.read_dimension(spark, folder, name, rows.schema)
        assert stored.count() == stored.select(key).distinct().count() > 0


def test_no_valid_rows_is_an_error(raw, tmp_path):
    with pytest.raises(ValueError):
        star.load_star(raw.limit(0), str(tmp_path / "none"))


def files(folder):
    return {str(p): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_a_load_leaves_the_files_of_others(spark, raw, tmp_path):
    """A second load adds files only; one that is run again replaces its own and leaves the same rows."""
    folder = str(tmp_path / "star")
    early, late = raw.filter("Fecha < '1998'"), raw.filter("Fecha >= '1998'")
    star.load_star(early, folder, load_id="one")
    first = files(tmp_path / "star" / star.INVOICES)
    star.load_star(late, folder, load_id="two")
    both = files(tmp_path / "star" / star.INVOICES)
    assert first and first.items() <= both.items() and len(both) > len(first)
    rows = workbook.headed_rows(raw)
    before = sorted(map(str, star.read_invoices(spark, folder, rows).collect()))
    again = star.load_star(late, folder, load_id="two").first()
    after = files(tmp_path / "star" / star.INVOICES)
    assert again["insertedRows"] == 0 and first.items() <= after.items() and set(after) & set(both) == set(first)
    assert sorted(map(str, star.read_invoices(spark, folder, rows).collect())) == before


def test_a_load_that_died_is_replaced(spark, raw, tmp_path):
    """Partitions that an attempt left with a part of its rows hold all of them after the next attempt."""
    folder = str(tmp_path / "star")
    star.load_star(raw.filter("Art % 2 = 0"), folder, load_id="night")
    partly = star.read_invoices(spark, folder, workbook.headed_rows(raw)).count()
    report = star.load_star(raw, folder, load_id="night").first()
    stored = star.read_invoices(spark, folder, workbook.headed_rows(raw))
    assert stored.count() == stored.select("comprobante", "art_id").distinct().count() == partly + report["insertedRows"]
    assert stored.count() == star.load_star(raw, str(tmp_path / "whole")).first()["insertedRows"]


def test_the_input_is_read_once(spark, raw, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def passing(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    cells = raw.drop(workbook.ORDER)
    star.load_star(cells.mapInArrow(passing, cells.schema).withColumn(
        workbook.ORDER, F.struct(F.monotonically_increasing_id())), str(tmp_path / "star"))
    assert seen.value == raw.count()


def test_only_touched_buckets_are_replaced(spark, tmp_path):
    path, schema = str(tmp_path / "table"), "k bigint, v bigint, cubo int"
    empty = spark.createDataFrame([], schema)
    assert partitions.read_stored(spark, path, empty.schema).count() == 0
    bucket = partitions.bucket_of(["k"], 8)
    partitions.replace_partitions(spark.range(100).selectExpr("id k", "0L v").withColumn("cubo", bucket), path, ["cubo"])
    before = files(tmp_path / "table")
    stored = partitions.read_stored(spark, path, empty.schema)
    fresh = spark.range(2).selectExpr("id k", "1L v").withColumn("cubo", bucket)
    hit = partitions.touched(fresh, bucket)
    kept = stored.filter(hit).join(fresh.select("k"), "k", "left_anti").select("k", "v", "cubo")
    partitions.replace_partitions(kept.unionByName(fresh), path, ["cubo"])
    after = files(tmp_path / "table")
    assert 0 < len({f for f in before if before[f] == after.get(f)}) < len(before)
    now = partitions.read_stored(spark, path, empty.schema)
    assert now.count() == 100 and now.filter("v = 1").count() == 2


def test_vectors_are_published_once_per_key(spark, tmp_path):
    path = str(tmp_path / "vectors")
    rows = [([1.0], ("a", "s", 0)), ([2.0], ("b", "s", 0)), ([3.0], ("c", "s", 1))]
    vectors = spark.createDataFrame(rows, "vector array<float>, metadata struct<text:string,source:string,chunkIndex:int>")
    vector_store.publish_vectors(vectors, path)
    vector_store.publish_vectors(vectors.filter("metadata.chunkIndex = 1"), path)
    vector_store.publish_vectors(vectors.limit(0), path)
    assert sorted((r["metadata"]["chunkIndex"], r["vector"][0]) for r in vector_store.read_vectors(spark, path).collect()) == [(0, 2.0), (1, 3.0)]


def test_untouched_vector_buckets_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "vectors")
    rows = spark.range(5000).selectExpr("array(float(id)) vector", "struct('t' text, concat('s', id % 5) source, int(id) chunkIndex) metadata")
    vector_store.publish_vectors(rows, path)
    before = files(tmp_path / "vectors")
    vector_store.publish_vectors(rows.filter("metadata.source = 's1' AND metadata.chunkIndex < 900").withColumn("vector", F.expr("array(float(-1))")), path)
    after = files(tmp_path / "vectors")
    assert len([f for f in before if f not in after]) >= 1
    assert len([f for f in before if before[f] == after.get(f)]) >= len(before) - 2
    now = vector_store.read_vectors(spark, path)
    assert now.count() == 5000 and now.filter("vector[0] = -1").count() == 180


def test_plain_append_and_rewrite(spark, tmp_path):
    path, moved = str(tmp_path / "fact"), str(tmp_path / "moved")
    store.create_fact(spark, path)
    rows = samples.workbook(spark, SF).limit(50).cache()
    star.append_rows(rows, path)
    assert store.read_fact(spark, path).count() == 50
    stored = store.read_fact(spark, path).withColumn("metadata", F.lit('{"a":1}'))
    store.replace_fact(stored, moved)
    kept = store.read_fact(spark, moved)
    assert {r["metadata"] for r in kept.collect()} == {'{"a":1}'}
    assert kept.agg(F.max("created_at")).first() == stored.agg(F.max("created_at")).first()
