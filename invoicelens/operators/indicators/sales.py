"""Sales totals, rankings and evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from invoicelens.functions.calendar import day_label, month_label
from invoicelens.functions.metrics import percent, summarise
from invoicelens.plans.catalogue import indicator
from invoicelens.plans.params import IndicatorRequest, day_range, top


@indicator("venta_total")
def total(fact: DataFrame, req: IndicatorRequest) -> DataFrame:
    return summarise(req.in_period(fact), {}, {"venta_bruta": "all_amount", "venta_facturada": "all_amount"})


def _sales_by(fact: DataFrame, req: IndicatorRequest, name: str, column: str) -> DataFrame:
    rows = summarise(req.in_period(fact), {name: column}, {"venta_facturada": "all_amount"})
    return req.top(rows, "venta_facturada", [name])


@indicator("venta_por_vendedor")
def by_seller(fact: DataFrame, req: IndicatorRequest) -> DataFrame:
    return _sales_by(fact, req, "cod_ven", "cod_ven")


@indicator("venta_por_categoria")
def by_category(fact: DataFrame, req: IndicatorRequest) -> DataFrame:
    return _sales_by(fact, req, "rubro", "rubro")


@indicator("venta_marcas_foco")
def focus_brands(fact: DataFrame, req: IndicatorRequest) -> DataFrame:
    """The named brands, or every brand when none is named."""
    if req.marcas_foco:
        fact = fact.filter(F.col("linea").isin(*req.marcas_foco))
    return _sales_by(fact, req, "marca_foco", "linea")


@indicator("producto_mas_vendido")
def best_sellers(fact: DataFrame, req: IndicatorRequest) -> DataFrame:
    rows = summarise(req.in_period(fact), {"art": "art", "articulo": "articulo"}, {
        "volumen_unidades": "all_units", "venta_total": "all_amount",
    })
    return req.top(rows, "volumen_unidades", ["art", "articulo"])


@indicator("evolucion_precio_promedio")
def mean_price(fact: DataFrame, req: IndicatorRequest) -> DataFrame:
    rows = summarise(req.in_period(fact), {"art": "art", "articulo": "articulo"}, {
        "venta_total": "all_amount", "unidades_vendidas": "all_units", "precio_promedio": "mean_price",
    })
    return req.top(rows, "precio_promedio", ["art", "articulo"])


EVOLUTION = {
    "venta_neta": "sales",
    "descuentos_pesos": "discounts",
    "rentabilidad_comercial": "commercial",
    "margen_pct_comercial": "commercial_pct",
    "cmv_muestras": "samples_or_zero",
    "rentabilidad_real_neta": "net",
    "margen_pct_real": "net_pct",
}


@indicator("evolucion_diaria_ventas")
def daily(fact: DataFrame, req: IndicatorRequest) -> DataFrame:
    rows = summarise(req.in_period(fact), {"fecha": "fecha"}, EVOLUTION)
    first = top(rows, "fecha", [], req.limite, down=False)
    return first.select(day_label(F.col("fecha")).alias("fecha_formateada"), *EVOLUTION)


@indicator("evolucion_mensual_ventas")
def monthly(fact: DataFrame, req: IndicatorRequest) -> DataFrame:
    months = req.in_period(fact).withColumn("mes", month_label(F.col("fecha")))
    return top(summarise(months, {"mes": "mes"}, EVOLUTION), "mes", [], req.limite, down=False)


@indicator("comparativo_periodos")
def period_comparison(fact: DataFrame, req: IndicatorRequest) -> DataFrame:
    """Two periods in one scan that reads only the days of either."""
    req.require("fecha_inicio", "fecha_fin", "fecha_inicio_anterior", "fecha_fin_anterior")
    now = day_range(fact, req.fecha_inicio, req.fecha_fin)
    before = day_range(fact, req.fecha_inicio_anterior, req.fecha_fin_anterior)
    sold = fact.filter("importe > 0")
    # A period without sales counts 0, unless nothing was ever sold.
    nothing = F.when(sold.exists(), F.lit(0).cast("decimal(18,4)"))

    def part(condition, value):
        return F.coalesce(F.sum(F.when(condition, value)), nothing)

    sales, margin = F.col("importe"), F.col("importe") - F.col("cmv")
    totals = sold.filter(now | before).agg(
        part(now, sales).alias("venta_periodo_actual"),
        part(before, sales).alias("venta_periodo_anterior"),
        part(now, margin).alias("margen_actual"),
        part(before, margin).alias("margen_anterior"),
    )
    change = F.col("venta_periodo_actual") - F.col("venta_periodo_anterior")
    return totals.withColumn("variacion_porcentual", percent(change, F.col("venta_periodo_anterior")))
