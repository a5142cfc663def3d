"""The earlier tools, kept for their callers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from invoicelens.functions.metrics import cost_of_units, measure, metric, ratio, summarise
from invoicelens.operators.tools_live import Day, _rfm
from invoicelens.plans.params import between_days, or_default, sort_key, top
from invoicelens.plans.ranking import with_row_number

# Columns to group by, and the names of the orders.
GROUPABLE = ("cod_ven", "rubro", "articulo", "cliente", "descripcion", "subcanal", "segmentoproducto", "linea")
ORDERABLE = {"ventas": "ventas_totales_brutas", "margen": "margen_total", "cantidad": "cantidad_total"}


def health_metrics_v1(fact: DataFrame, start: Day = None, end: Day = None) -> DataFrame:
    return summarise(between_days(fact.filter("descuento < 100"), start, end), {}, {
        "ingresos_totales": "all_amount",
        "cmv_total": "all_unit_cost",
        "utilidad_bruta": "amount_margin",
        "margen_bruto_porcentaje": "amount_margin_ratio",
    })


def rfm_analysis(fact: DataFrame, limit: int | None = None, as_of: Day = None) -> DataFrame:
    names = ("cliente_id", "cliente_nombre", "recencia_dias", "frecuencia_compras", "valor_monetario")
    rows = _rfm(fact.filter("cliente IS NOT NULL AND importe > 0"), as_of, names)
    return top(rows, "valor_monetario", ["cliente_id"], or_default(limit, 50))


def breakeven_point(fact: DataFrame, fixed_costs: float, start: Day = None, end: Day = None) -> DataFrame:
    """Sales at which profit is zero. No row when the period has no net sales."""
    if fixed_costs is None:
        raise ValueError("fixed_costs is required")
    totals = measure(between_days(fact.filter("descuento < 100"), start, end), [], ["all_amount", "all_unit_cost"])
    sales = F.coalesce(F.col("all_amount").cast("double"), F.lit(0.0))
    cost = F.coalesce(F.col("all_unit_cost").cast("double"), F.lit(0.0))
    share = 1 - cost / F.nullif(sales, F.lit(0.0))
    return totals.select(
        (F.lit(float(fixed_costs)) / F.nullif(share, F.lit(0.0))).alias("punto_equilibrio_pesos"),
        F.lit(float(fixed_costs)).alias("costos_fijos_ingresados"),
        sales.alias("ventas_periodo"),
        cost.alias("cmv_periodo"),
    ).filter("ventas_periodo <> 0")


def mean_ticket(fact: DataFrame, start: Day = None, end: Day = None) -> DataFrame:
    sold = between_days(fact.filter("importe > 0"), start, end)
    return sold.agg(_ticket(F.sum("importe"), sold).alias("ticket_promedio"))


def _ticket(total: Column, sold: DataFrame) -> Column:
    """Mean amount per line id. The ids are counted apart from the sum, so they cross the shuffle bare."""
    ids = sold.select("idunica").distinct().agg(F.count("idunica")).scalar()
    return ratio(total, ids)


def _return_index():
    amount = F.col("importe")
    back = F.abs(F.sum(F.when(amount < 0, amount).otherwise(0)))
    return ratio(back, F.sum(F.when(amount > 0, amount).otherwise(0))) * 100


def return_index(fact: DataFrame, start: Day = None, end: Day = None) -> DataFrame:
    return between_days(fact, start, end).agg(_return_index().alias("indice_devoluciones_pct"))


def pareto_share(fact: DataFrame, start: Day = None, end: Day = None, share: float = 0.20) -> DataFrame:
    """Part of the positive margin that the best ``share`` of the customers bring, in percent."""
    margins = (
        between_days(fact, start, end).filter("cliente IS NOT NULL")
        .groupBy("cliente").agg(F.sum(F.col("importe") - cost_of_units()).alias("margen"))
        .filter("margen > 0")
    )
    ranked = with_row_number(margins, [sort_key("margen", True), sort_key("cliente", False)])
    best = F.col("rn") <= F.greatest(F.lit(1), F.round(F.col("n") * F.lit(share)))
    kept = F.sum(F.when(best, F.col("margen")))
    return ranked.agg((ratio(kept, F.sum("margen")) * 100).alias("concentracion_pareto_20_pct"))


def additional_kpis(fact: DataFrame, start: Day = None, end: Day = None) -> DataFrame:
    """The three above in one row; ticket and returns share a scan."""
    is_sale = F.col("importe") > 0
    period = between_days(fact, start, end)
    ticket = _ticket(F.sum(F.when(is_sale, F.col("importe"))), period.filter(is_sale))
    return period.agg(
        ticket.alias("ticket_promedio"), _return_index().alias("indice_devoluciones_pct")
    ).withColumn("concentracion_pareto_20_pct", pareto_share(fact, start, end).scalar())


def sales_aggregations(fact: DataFrame, group_by: str, limit: int | None = None, start: Day = None,
                       end: Day = None, order_by: str | None = None) -> DataFrame:
    if group_by not in GROUPABLE:
        raise ValueError(f"cannot group by {group_by!r}")
    known = between_days(fact.filter(F.col(group_by).isNotNull()), start, end)
    rows = summarise(known, {"categoria": group_by}, {
        "clientes_compradores": "customers",
        "cantidad_total": "all_units",
        "ventas_totales_brutas": "all_amount",
        "importe_neta": "all_amount",
        "total_descuentos_pesos": "all_discounts",
        "porcentaje_descuentos_sobre_ventas": "discount_ratio",
        "margen_total": "amount_margin",
        "margen_porcentaje": "amount_margin_ratio",
    })
    return top(rows, ORDERABLE.get(order_by, "ventas_totales_brutas"), ["categoria"], or_default(limit, 20))
