"""Rejections and returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from invoicelens.functions.metrics import is_rejected, percent, summarise
from invoicelens.plans.catalogue import indicator
from invoicelens.plans.params import IndicatorRequest


@indicator("rechazos_devoluciones")
def rejections(fact: DataFrame, req: IndicatorRequest) -> DataFrame:
    rows = summarise(req.in_period(fact.filter(is_rejected())), {"motivo_rechazo": "motivodev"}, {
        "cantidad_facturas_rechazadas": "invoices", "valor_rechazado": "all_amount",
    })
    return req.top(rows, "cantidad_facturas_rechazadas", ["motivo_rechazo"])


@indicator("tasa_devolucion_vendedor")
def return_rate(fact: DataFrame, req: IndicatorRequest) -> DataFrame:
    """Invoices first, then sellers: two distinct counts without repeating each line per count."""
    invoices = req.in_period(fact).groupBy("cod_ven", "comprobante").agg(F.max(is_rejected()).alias("_rejected"))
    known = F.col("comprobante").isNotNull()
    rows = invoices.groupBy("cod_ven").agg(
        F.count(F.when(known & F.col("_rejected"), 1)).alias("facturas_rechazadas"),
        F.count("comprobante").alias("total_facturas"),
    )
    rate = percent(F.col("facturas_rechazadas"), F.col("total_facturas"))
    return req.top(rows.withColumn("pct_rechazo", rate), "pct_rechazo", ["cod_ven"])
