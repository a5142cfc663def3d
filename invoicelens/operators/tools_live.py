"""The analytic tools in use."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from invoicelens.functions.calendar import as_day, days_between
from invoicelens.functions.metrics import cost_of_units, percent, sum_where, summarise
from invoicelens.plans.params import DIMENSIONS, between_days, day_range, dimension, or_default, sort_key, top
from invoicelens.plans.ranking import with_tile

Day = str | dt.date | None


def health_metrics(fact: DataFrame, start: Day = None, end: Day = None) -> DataFrame:
    """Income, discounts, cost and margin of the period's sales.

    The marketing cost (lines at 100 % discount) covers all history. One scan serves both.
    """
    in_period = F.lit(True) if day_range(fact, start, end) is None else day_range(fact, start, end)
    counted = (F.col("importe") > 0) & in_period
    given = F.col("descuento") >= 100
    rate = F.col("descuento").cast("double") / 100
    waived = F.col("importe").cast("double") / F.nullif(1 - rate, F.lit(0.0)) * rate
    totals = fact.filter(counted | given).agg(
        sum_where(counted, F.col("importe")).alias("ingresos_brutos"),
        sum_where(counted, waived.cast("decimal(28,8)")).alias("monto_descuentos"),
        sum_where(counted, cost_of_units()).alias("cmv_comercial"),
        sum_where(given, cost_of_units()).alias("costo_inversion_marketing"),
    )
    profit = F.col("ingresos_brutos") - F.col("cmv_comercial")
    return totals.select(
        "ingresos_brutos", "monto_descuentos", "cmv_comercial",
        profit.alias("utilidad_bruta"),
        percent(profit, F.col("ingresos_brutos")).alias("margen_bruto_pct"),
        "costo_inversion_marketing",
    )


def _rfm(sold: DataFrame, as_of: Day, names: tuple[str, str, str, str, str]) -> DataFrame:
    key, label, recency, frequency, amount = names
    rows = summarise(sold, {key: "cliente"}, {label: "name", recency: "last_day", frequency: "tickets", amount: "all_amount"})
    return rows.withColumn(recency, days_between(as_day(as_of), F.col(recency)))


RFM_NAMES = ("id", "nombre", "recencia", "frecuencia", "monetario")


def customer_analytics(fact: DataFrame, kind: str, limit: int = 10, days_idle: int = 60,
                       as_of: Day = None) -> DataFrame:
    """``rfm``, ``dormidos`` or ``campeones``."""
    if kind == "rfm":
        rows = _rfm(fact.filter("importe > 0"), as_of, RFM_NAMES)
        return top(rows, "monetario", ["id"], limit)
    keys = {"cliente": "cliente", "razon_social": "razon_social"}
    if kind == "dormidos":
        rows = summarise(fact, keys, {"ultima_vta": "last_day"})
        asleep = rows.filter(F.col("ultima_vta") < F.date_sub(as_day(as_of), days_idle))
        return top(asleep, "ultima_vta", list(keys), limit)
    if kind == "campeones":
        return top(summarise(fact, keys, {"total": "all_amount"}), "total", list(keys), limit)
    raise ValueError(f"unknown kind: {kind!r}")


def profitability(fact: DataFrame, group_by: str, start: Day = None, end: Day = None, limit: int = 20) -> DataFrame:
    """Commercial against real profit by dimension.

    Discounts are those of all lines. Sample cost is not defaulted, so a group without samples
    has no real profit and sorts first.
    """
    return top(_profit_rows(fact, group_by, start, end), "rentabilidad_real_neta", ["dimension"], limit)


def _profit_rows(fact: DataFrame, group_by: str, start: Day, end: Day) -> DataFrame:
    if group_by not in ("vendedor", "articulo", "linea", "subcanal", "fecha"):
        raise ValueError(f"cannot group by {group_by!r}")
    key = dimension(group_by)
    known = between_days(fact, start, end).filter(key.isNotNull()).withColumn("dimension", key)
    base = summarise(known, {"dimension": "dimension"}, {
        "ventas_brutas": "sales", "descuentos_totales": "all_discounts",
        "costo_de_ventas": "cost", "costo_muestras": "samples",
    })
    net_sales = F.col("ventas_brutas") - F.col("descuentos_totales")
    return (
        base.withColumn("ventas_netas", net_sales)
        .withColumn("utilidad_bruta", F.col("ventas_netas") - F.col("costo_de_ventas"))
        .withColumn("rentabilidad_real_neta", F.col("utilidad_bruta") - F.col("costo_muestras"))
        .withColumn("margen_bruto_pct", percent(F.col("utilidad_bruta"), F.col("ventas_netas")))
        .withColumn("margen_real_pct", percent(F.col("rentabilidad_real_neta"), F.col("ventas_netas")))
    )


def sales_opportunities(fact: DataFrame, start: Day = None, end: Day = None, group_by: str | None = None,
                        limit: int | None = 20) -> DataFrame:
    """Brands that the best (customer, entity) pairs did not buy in the period.

    The pairs are at most ``limit`` rows and travel as one array. The fact is then reduced to
    one row per brand with those of the named customers who bought it, and each brand row
    unfolds into the pairs that are missing.
    """
    column = F.col(DIMENSIONS.get(group_by or "vendedor", "cod_ven"))
    period = between_days(fact, start, end)
    pairs = (
        period.filter(column.isNotNull())
        .groupBy(F.col("razon_social").alias("cliente"), column.alias("entidad"))
        .agg(F.sum("facturacion").alias("_bought"))
    )
    best = top(pairs, "_bought", ["cliente", "entidad"], or_default(limit, 20))
    chosen = best.agg(F.struct(
        F.collect_list(F.struct("entidad", "cliente")).alias("pairs"),
        F.collect_set("cliente").alias("names"),
    )).scalar()

    condition = day_range(fact, start, end)
    is_named = F.array_contains(chosen["names"], F.col("razon_social"))
    bought = is_named if condition is None else is_named & condition
    brands = (
        fact.filter(F.col("linea").isNotNull() & (F.col("linea") != ""))
        .groupBy(F.col("linea").alias("marca_ausente"))
        .agg(F.collect_set(F.when(bought, F.col("razon_social"))).alias("_buyers"))
    )
    unfolded = brands.select("marca_ausente", "_buyers", F.explode(chosen["pairs"]).alias("_pair"))
    has_it = F.coalesce(F.array_contains("_buyers", F.col("_pair.cliente")), F.lit(False))
    rows = unfolded.filter(~has_it).select(
        F.col("_pair.entidad").alias("entidad"),
        F.col("_pair.cliente").alias("cliente"),
        "marca_ausente",
        F.lit("Oportunidad de Venta").alias("accion_sugerida"),
        F.lit("Sin compras detectadas en el periodo").alias("observacion"),
    )
    return rows.orderBy(*[sort_key(c, False) for c in ("entidad", "marca_ausente", "cliente")])


def seller_performance(fact: DataFrame, start: Day = None, end: Day = None, limit: int | None = 20) -> DataFrame:
    rows = summarise(between_days(fact, start, end), {"codigo_vendedor": "cod_ven"}, {
        "total_operaciones": "invoices",
        "volumen_unidades": "all_units",
        "venta_neta_total": "all_net",
        "total_descuentos_aplicados": "all_valordesc",
        "ticket_promedio": "mean_net_ticket",
    })
    return top(rows, "venta_neta_total", ["codigo_vendedor"], or_default(limit, 20))


def churn_risk(fact: DataFrame, as_of: Day = None, min_recency: int = 45, top_tiles: int = 1,
               tiles: int = 4) -> DataFrame:
    """Customers with a high amount and an old last purchase.

    "High" is the first ``top_tiles`` of ``tiles`` groups of equal size by amount.
    """
    rows = _rfm(fact.filter("importe > 0"), as_of, RFM_NAMES)
    order = [sort_key("monetario", True), sort_key("id", False)]
    tiled = with_tile(rows, order, "grupo_monto", tiles)
    risky = (F.col("grupo_monto") <= top_tiles) & (F.col("recencia") > min_recency)
    return tiled.withColumn("clasificacion", F.when(risky, F.lit("Riesgo Crítico de Fuga")))


def leak_measure(fact: DataFrame, group_by: str, start: Day = None, end: Day = None, limit: int | None = None) -> DataFrame:
    """Gross sales against real profit of every group, with the parts due to discounts and samples.

    The largest leak comes first; ``limit`` keeps the first groups only.
    """
    rows = _profit_rows(fact, group_by, start, end)
    leak = F.col("ventas_brutas") - F.col("rentabilidad_real_neta")
    measured = rows.select(
        "dimension", "ventas_brutas", "rentabilidad_real_neta",
        leak.alias("fuga"),
        percent(leak, F.col("ventas_brutas")).alias("fuga_pct"),
        "descuentos_totales",
        percent(F.col("descuentos_totales"), F.col("ventas_brutas")).alias("impacto_descuentos_pct"),
        "costo_muestras",
        percent(F.col("costo_muestras"), F.col("ventas_brutas")).alias("impacto_muestras_pct"),
    )
    return top(measured, "fuga", ["dimension"], limit)
