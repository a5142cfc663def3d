"""Load jobs: the sales fact, the dimensions, and the invoice fact that refers to them."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F

from invoicelens.functions.text import document_type
from invoicelens.plans.joins import ROW, any_null, first_absent, numbered
from invoicelens.schema import FACT_KEY, LOAD, WORKBOOK_COLUMNS
from invoicelens.session import discard, materialise
from invoicelens.sources import store
from invoicelens.sources.workbook import ORDER, accepted, positional_rows, rejected

INVOICE_KEY = ("comprobante", "art_id")


REPORT = ("totalRows bigint, insertedRows bigint, skippedRows bigint, rejectedRows bigint, failedChunks int, "
          "durationMs bigint")


# Sales fact

def new_sales(rows: DataFrame, stored: DataFrame, order: str = ORDER) -> DataFrame:
    """Accepted rows whose (comprobante, articulo) is neither stored nor earlier in the file.

    The accepted rows are written to the shared folder, since the look-up reads their keys first; ``numbered`` rows are there.
    """
    batch = accepted(rows) if ROW in rows.columns else numbered(accepted(rows))
    return first_absent(batch, stored, FACT_KEY, [order]).select(*WORKBOOK_COLUMNS)


def materialise_numbered(rows: DataFrame, **also: Column) -> tuple:
    """``rows`` as a ``numbered`` table in the shared folder, how many they are, a hash of their content, and the aggregates in ``also``.

    All come from the one job that writes the table. The hash covers every column but the place in the file, and is the same
    for the same rows in any order.
    """
    cells = [c for c in rows.columns if c != ORDER]
    seen = Observation()
    digest = F.sum(F.xxhash64(*cells).cast("decimal(38,0)")).alias("content")
    table = numbered(rows.observe(seen, F.count(F.lit(1)).alias("n"), digest, *[c.alias(name) for name, c in also.items()]))
    found = seen.get
    return table, found["n"], f"{found['n']}-{found['content'] or 0}", *[found[name] for name in also]


def load_sales(raw: DataFrame, path: str, load_id: str | None = None) -> DataFrame:
    """Load workbook rows into the fact at ``path``; returns the one-row load report.

    The input is read once: typed rows are written to the shared folder. The rows to add are counted by their numbers and go
    from there into the fact. Rows with a NULL key part never conflict with another load's, but a load that is
    run again adds only those that its earlier attempt has not: equal rows are matched one to one within the load.
    ``load_id`` names the load; without it a hash of the rows does.
    """
    started = time.monotonic()
    refused = F.count(F.col("motivo_rechazo"))
    rows, total, content, rejections = materialise_numbered(positional_rows(raw), refused=refused)
    load_id = load_id or content
    batch = accepted(rows)
    stored = store.read_fact(raw.sparkSession, path)
    unkeyed = any_null(FACT_KEY)
    own = stored.filter((F.col(LOAD) == load_id) & unkeyed).select(*WORKBOOK_COLUMNS)
    named = first_absent(batch.filter(~unkeyed), stored, FACT_KEY, [ORDER]).select(*WORKBOOK_COLUMNS)
    unnamed = materialise(batch.filter(unkeyed).select(*WORKBOOK_COLUMNS).exceptAll(own))
    fresh = named.unionByName(unnamed)
    added = fresh.count()
    store.append_fact(fresh.withColumn(LOAD, F.lit(load_id)), path)
    for table in (rows, unnamed):
        discard(table)
    report = (total, added, total - rejections - added, rejections, 0, int((time.monotonic() - started) * 1000))
    return raw.sparkSession.createDataFrame([report], REPORT)


def load_report(rows: DataFrame, inserted: DataFrame, started: float | None = None) -> DataFrame:
    """Rows seen, inserted, skipped on a key conflict and rejected.

    A failed job raises, so no part of a finished load has failed.
    """
    refused = F.col("motivo_rechazo").isNotNull() if "motivo_rechazo" in rows.columns else F.lit(False)
    seen = rows.agg(F.count(F.lit(1)).alias("totalRows"), F.count(F.when(refused, 1)).alias("rejectedRows"))
    added = inserted.agg(F.count(F.lit(1)).alias("n")).scalar()
    elapsed = int((time.monotonic() - started) * 1000) if started is not None else None
    return seen.withColumn("insertedRows", added).select(
        "totalRows",
        "insertedRows",
        (F.col("totalRows") - F.col("rejectedRows") - F.col("insertedRows")).alias("skippedRows"),
        "rejectedRows",
        F.lit(0).alias("failedChunks"),
        F.lit(elapsed).cast("long").alias("durationMs"),
    )


# Dimensions

# Per dimension the header of its key, the key, and the header of each attribute.
DIMENSION_CELLS = {
    "dim_cliente": ("Cliente", "cliente_id", {
        "razon_social": "Razon_Social", "direccion": "Direccion",
        "subcanal": "subcanal", "segmento": "segmentoproducto",
    }),
    "dim_articulo": ("Art", "art_id", {
        "nombre": "articulo", "linea": "linea", "rubro": "rubro", "descripcion": "descripcion",
        "capacidad_art": "capacidad_art", "peso_unitario_g": "peso",
    }),
    "dim_vendedor": ("cod_ven", "cod_ven", {}),
    "dim_ruta": ("reparto", "reparto_id", {"camion": "camion", "chofer_id": "chofer"}),
}

# Attributes that an incoming row overwrites even with NULL.
OVERWRITTEN = {"dim_cliente": {"razon_social"}, "dim_ruta": {"camion", "chofer_id"}}


def dimension_rows(rows: DataFrame, name: str, order: Sequence[str] = (ORDER,)) -> DataFrame:
    """One row per key with the attributes of the first row of the file that has it."""
    source, key, attributes = DIMENSION_CELLS[name]
    if not attributes:
        return rows.select(F.col(source).alias(key)).distinct()
    cells = [F.col(column).alias(attribute) for attribute, column in attributes.items()]
    first = F.min_by(F.struct(*cells), F.struct(*order))
    out = rows.groupBy(F.col(source).alias(key)).agg(first.alias("_first")).select(key, "_first.*")
    if name == "dim_articulo":
        out = out.withColumn("peso_unitario_g", F.when(F.col("peso_unitario_g") > 0, F.col("peso_unitario_g")))
    return out


def upsert_dimension(name: str, stored: DataFrame, incoming: DataFrame, now: Column | None = None) -> DataFrame:
    """The dimension after the upsert, as a new snapshot.

    Attributes keep their stored value where the incoming one is NULL, except those that are
    always overwritten. The seller list only grows.
    """
    _, key, attributes = DIMENSION_CELLS[name]
    if not attributes:
        return stored.select(key).union(incoming.select(key).join(stored.select(key), key, "left_anti"))
    old, new = stored.alias("old"), incoming.withColumn("_arrived", F.lit(True)).alias("new")
    joined = old.join(new, key, "full_outer")
    arrived = F.col("new._arrived").isNotNull()
    overwritten = OVERWRITTEN.get(name, set())
    cells = [
        (F.when(arrived, F.col(f"new.{a}")).otherwise(F.col(f"old.{a}")) if a in overwritten
         else F.coalesce(F.col(f"new.{a}"), F.col(f"old.{a}"))).alias(a)
        for a in attributes
    ]
    if name != "dim_ruta":
        moment = F.current_timestamp() if now is None else now
        cells.append(F.when(arrived, moment).otherwise(F.col("old.updated_at")).alias("updated_at"))
    return joined.select(key, *cells)


# Invoice fact

def invoice_rows(rows: DataFrame) -> DataFrame:
    """The 20 columns of ``fact_comprobante_detalle``; names and source headers are fixed values."""
    source = {
        "comprobante": F.col("Comprobante"),
        "tipo_comprobante": document_type(F.col("Comprobante")),
        "id_unica": F.col("IDUNICA"),
        "fecha_entrega": F.col("Fecha"),
        "fecha_pedido": F.col("fecha_pedido"),
        "cliente_id": F.col("Cliente"),
        "art_id": F.col("Art"),
        "cod_ven": F.col("cod_ven"),
        "reparto_id": F.col("reparto"),
        "cantidad": F.col("Cantidad"),
        "importe": F.col("Importe"),
        "neto": F.col("neto"),
        "facturacion": F.col("facturacion"),
        "cmv": F.col("CMV"),
        "pr_costo_uni_neto": F.col("pr_costo_uni_neto"),
        "descuento_pct": F.col("descuento"),
        "d1": F.col("d1"),
        "d2": F.col("d2"),
        "valordesc": F.col("valordesc"),
        "motivo_devolucion": F.col("motivodev"),
    }
    place = [c for c in rows.columns if c in (ORDER, ROW)]
    return rows.select(*[column.alias(name) for name, column in source.items()], *place)


def new_invoices(rows: DataFrame, stored: DataFrame, order: str = ORDER) -> DataFrame:
    """Invoice lines that an insert without conflicts adds; the key is (comprobante, art_id).

    The lines are written to the shared folder, since the look-up reads their keys first.
    """
    return first_absent(numbered(invoice_rows(rows)), stored, INVOICE_KEY, [order]).drop(order, ROW)


__all__ = [
    "DIMENSION_CELLS", "LOAD", "accepted", "dimension_rows", "invoice_rows", "load_report", "load_sales",
    "materialise_numbered", "new_invoices", "new_sales", "rejected", "upsert_dimension",
]
