"""Concentration, mix, rotation and weekdays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from invoicelens.functions.calendar import weekday_name, weekday_number
from invoicelens.functions.metrics import AGGREGATES, mean_money, metric, percent, summarise
from invoicelens.operators.indicators.profitability import FULL_SPLIT
from invoicelens.plans.catalogue import indicator
from invoicelens.plans.joins import not_in
from invoicelens.plans.params import IndicatorRequest, sort_key, top


@indicator("indice_concentracion_pareto")
def concentration(fact: DataFrame, req: IndicatorRequest) -> DataFrame:
    """Each customer's share of the grand totals.

    The totals are one more group of the same scan. They sort first, so the rows that carry
    the totals to the report are the report itself and that one row.
    """
    keys = ["cliente", "razon_social"]
    groups = req.in_period(fact).withColumn("_customer", F.struct(*keys)).rollup("_customer").agg(
        F.grouping("_customer").alias("_is_total"),
        *[AGGREGATES[name]().alias(name) for name in ("sales", "commercial", "samples")],
    ).select(
        "_is_total",
        *[F.col(f"_customer.{k}").alias(k) for k in keys],
        F.col("sales").alias("venta_neta"),
        metric("net").alias("rentabilidad_real_neta"),
    )
    order = [F.col("_is_total").desc(), sort_key("venta_neta", True), *[sort_key(k, False) for k in keys]]
    report = groups.orderBy(*order).limit(req.limite + 1)
    everywhere = Window.partitionBy()

    def total(name: str):
        return F.max(F.when(F.col("_is_total") == 1, F.col(name))).over(everywhere)

    shares = report.select(
        "_is_total", *keys, "venta_neta",
        percent(F.col("venta_neta"), total("venta_neta")).alias("pct_del_total_venta"),
        "rentabilidad_real_neta",
        percent(F.col("rentabilidad_real_neta"), total("rentabilidad_real_neta")).alias("pct_del_total_rentabilidad"),
    )
    return top(shares.filter("_is_total = 0").drop("_is_total"), "venta_neta", keys, req.limite)


@indicator("cumplimiento_mix_ideal")
def mix(fact: DataFrame, req: IndicatorRequest) -> DataFrame:
    period = req.in_period(fact)
    whole = summarise(period, {}, {"total": "sales"}).scalar()
    rows = summarise(period, {"categoria": "linea"}, FULL_SPLIT)
    rows = rows.withColumn("peso_en_el_mix", percent(F.col("venta_neta"), whole))
    return req.top(rows, "peso_en_el_mix", ["categoria"])


@indicator("productos_sin_rotacion")
def without_rotation(fact: DataFrame, req: IndicatorRequest) -> DataFrame:
    """Products of any time that have no sale in the period."""
    keys = ["art", "articulo"]
    sold = req.in_period(fact.filter("importe > 0"))
    rows = not_in(fact.select(*keys).distinct(), sold, "art")
    return top(rows.select(*keys), [], keys, req.limite)


@indicator("dias_semana_mas_ventas")
def weekdays(fact: DataFrame, req: IndicatorRequest) -> DataFrame:
    sold = req.in_period(fact.filter("importe > 0")).withColumns({
        "dia_semana": weekday_name(F.col("fecha")), "num_dia": weekday_number(F.col("fecha")),
    })
    rows = summarise(sold, {"dia_semana": "dia_semana", "num_dia": "num_dia"}, {
        "facturas": "invoices", "venta_total": "all_amount", "_lines": "amount_lines",
    })
    mean = mean_money(F.col("venta_total"), F.col("_lines"))
    return top(rows.withColumn("ticket_promedio", mean).drop("_lines"), "num_dia", [], None, down=False)
