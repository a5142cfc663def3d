"""Audits and profiles of loaded data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from invoicelens.functions.convert import leading_money
from invoicelens.functions.text import es_ar_number
from invoicelens.sources.workbook import missing_id

# The amounts that must agree between a workbook and its loaded table.
RECONCILED = ("importe", "descuento", "neto", "pr_costo_uni_neto", "facturacion", "cmv", "d1", "d2")


def _totals(rows: DataFrame, label: str, value=F.col) -> DataFrame:
    """One row per field, from one pass over ``rows``."""
    wide = "decimal(38,4)"
    sums = rows.agg(
        F.count(F.lit(1)).cast(wide).alias("COUNT"),
        *[F.coalesce(F.sum(value(c)), F.lit(0)).cast(wide).alias(c.upper()) for c in RECONCILED],
    )
    return sums.unpivot([], list(sums.columns), "campo", label)


def reconcile(workbook: DataFrame, table: DataFrame, tolerance: str = "0.01") -> DataFrame:
    """Count and sums of the workbook's rows with an id against the loaded table."""
    source = _totals(workbook.filter(~missing_id()), "origen", lambda c: leading_money(F.col(c)))
    pairs = source.join(_totals(table, "destino"), "campo")
    diff = F.col("origen") - F.col("destino")
    return pairs.select(
        "campo",
        es_ar_number(F.col("origen"), 3).alias("origen"),
        es_ar_number(F.col("destino"), 3).alias("destino"),
        diff.cast("decimal(38,4)").alias("diferencia"),
        F.when(F.abs(diff) < F.lit(tolerance).cast("decimal(38,4)"), "OK").otherwise("ERROR").alias("estado"),
    )


def missing_key_counts(workbook: DataFrame) -> DataFrame:
    missing = F.count_if(missing_id())
    return workbook.agg(
        F.count(F.lit(1)).alias("filas"),
        missing.alias("sin_idunica"),
        (F.count(F.lit(1)) - missing).alias("con_idunica"),
    )


def missing_key_rows(workbook: DataFrame, order: Sequence[str], limit: int = 5) -> DataFrame:
    """The first offenders, in file order."""
    return workbook.filter(missing_id()).orderBy(*order).limit(limit)


def profile(rows: DataFrame, order: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Row count, headers and the first two rows, as text."""
    columns = list(columns or rows.columns)
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    first = rows.orderBy(*order).limit(2).select(F.struct(*order).alias("_at"), line.alias("_line"))
    pair = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_line"))), lambda r: r["_line"])).scalar()
    counted = rows.agg(F.count(F.lit(1)).alias("filas"))
    return counted.select(
        "filas",
        F.lit("|".join(columns)).alias("encabezados"),
        F.get(pair, F.lit(0)).alias("fila_1"),
        F.get(pair, F.lit(1)).alias("fila_2"),
    )
