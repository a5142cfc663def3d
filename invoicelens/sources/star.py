"""The star load: four dimensions and the invoice fact, from rows with headers."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

from invoicelens.functions.calendar import month_label
from invoicelens.plans.joins import ROW, first_absent
from invoicelens.plans.params import MONTH
from invoicelens.session import discard, materialise
from invoicelens.sources.loads import (
    DIMENSION_CELLS, INVOICE_KEY, LOAD, dimension_rows, invoice_rows, materialise_numbered, upsert_dimension,
)
from invoicelens.sources.partitions import BUCKET, bucket_of, read_stored, replace_partitions, touched
from invoicelens.sources.workbook import ORDER, headed_rows

INVOICES = "fact_comprobante_detalle"
# Part of the stored layout of each dimension.
DIMENSION_BUCKETS = 16


def dimension_schema(name: str, rows: StructType) -> StructType:
    """The columns of a dimension, typed as the cells of ``rows`` are."""
    source, key, attributes = DIMENSION_CELLS[name]
    schema = StructType().add(key, rows[source].dataType)
    for attribute, column in attributes.items():
        schema = schema.add(attribute, rows[column].dataType)
    return schema.add("updated_at", "timestamp_ntz") if attributes and name != "dim_ruta" else schema


def _stored_dimension(spark: SparkSession, folder: str, name: str, rows: StructType) -> DataFrame:
    return read_stored(spark, f"{folder}/{name}", dimension_schema(name, rows).add(BUCKET, "integer"))


def read_dimension(spark: SparkSession, folder: str, name: str, rows: StructType) -> DataFrame:
    return _stored_dimension(spark, folder, name, rows).drop(BUCKET)


def load_dimension(rows: DataFrame, folder: str, name: str, now: Column) -> None:
    """Upsert one dimension; buckets without a key of ``rows`` are neither read nor written."""
    key = DIMENSION_CELLS[name][1]
    bucket = bucket_of([key], DIMENSION_BUCKETS)
    incoming = materialise(dimension_rows(rows, name))
    stored = _stored_dimension(rows.sparkSession, folder, name, rows.schema).filter(touched(incoming, bucket)).drop(BUCKET)
    changed = upsert_dimension(name, stored, incoming, now)
    replace_partitions(changed.withColumn(BUCKET, bucket), f"{folder}/{name}", [BUCKET])
    discard(incoming)


def _stored_invoices(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    schema = invoice_rows(rows).drop(ORDER, ROW).schema.add(MONTH, "string").add(LOAD, "string")
    return read_stored(spark, f"{folder}/{INVOICES}", schema)


def read_invoices(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    return _stored_invoices(spark, folder, rows).drop(MONTH, LOAD)


def load_star(raw: DataFrame, folder: str, now: Column | None = None, load_id: str | None = None) -> DataFrame:
    """Upserts the dimensions in ``folder``, then adds the invoice lines it lacks; returns the one-row report.

    The input is read once, into a table in the shared folder that is deleted at the end and whose writing also counts the
    rows. An input without valid rows is an error. Invoice lines are partitioned by month and load: a load writes partitions
    of its own only, and one that is run again after it died replaces just these. ``load_id`` names the load, and must come
    with the same rows again; without it a hash of the rows does, whatever their order.
    """
    started = time.monotonic()
    spark = raw.sparkSession
    rows, total, content = materialise_numbered(headed_rows(raw))
    if total == 0:
        raise ValueError("the input has no valid rows")
    load_id = load_id or content
    moment = F.current_timestamp().cast("timestamp_ntz") if now is None else now
    for name in DIMENSION_CELLS:
        load_dimension(rows, folder, name, moment)

    stored = _stored_invoices(spark, folder, rows)
    others, own = stored.filter(F.col(LOAD) != load_id), stored.filter(F.col(LOAD) == load_id)
    seen = Observation()
    lines = first_absent(invoice_rows(rows), others, INVOICE_KEY, [ORDER]).drop(ORDER, ROW).observe(seen, F.count(F.lit(1)).alias("n"))
    before, retried = 0, not own.isEmpty()
    if retried:
        # Lines that an earlier attempt of this load has left are written again, but not reported as new.
        lines = materialise(lines)
        before = own.select(*INVOICE_KEY).join(lines.select(*INVOICE_KEY), list(INVOICE_KEY), "left_semi").count()
    placed = lines.withColumn(MONTH, month_label(F.col("fecha_entrega"))).withColumn(LOAD, F.lit(load_id))
    replace_partitions(placed, f"{folder}/{INVOICES}", [MONTH, LOAD])
    kept = seen.get["n"]
    discard(rows)
    if retried:
        discard(lines)
    report = (total, kept - before, total - kept + before, 0, int((time.monotonic() - started) * 1000))
    return spark.createDataFrame([report], "totalRows bigint, insertedRows bigint, skippedRows bigint, failedChunks int, durationMs bigint")


def append_rows(raw: DataFrame, path: str) -> None:
    """The plain append of a workbook to the sales fact: nothing is rejected and no key is looked up."""
    from invoicelens.sources import store, workbook
    store.append_fact(workbook.rows_as_they_come(raw), path)
