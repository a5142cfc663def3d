"""Customer behaviour."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from invoicelens.functions.calendar import days_between, month_label
from invoicelens.functions.metrics import mean_money, measure, metric, percent, ratio, summarise
from invoicelens.plans.catalogue import indicator
from invoicelens.plans.joins import not_in
from invoicelens.plans.params import MONTH, IndicatorRequest, or_default, sort_key, top
from invoicelens.plans.ranking import with_tile

CUSTOMER = ["cliente", "razon_social"]
BY_CUSTOMER = {name: name for name in CUSTOMER}


@indicator("clientes_dto_arriba_stnd")
def above_standard_discount(fact: DataFrame, req: IndicatorRequest) -> DataFrame:
    grouped = measure(req.in_period(fact), CUSTOMER, ["discount_ratio"])
    above = grouped.filter(ratio(metric("all_discounts"), metric("all_amount")) > F.lit(req.min_descuento))
    rows = above.select(*CUSTOMER, metric("discount_ratio").alias("pct_descuento_otorgado"))
    return req.top(rows, "pct_descuento_otorgado", CUSTOMER)


@indicator("clientes_no_compran_marca")
def not_buying_brand(fact: DataFrame, req: IndicatorRequest) -> DataFrame:
    """Customers of the period who never bought the brand, in any period."""
    req.require("marca")
    active = req.in_period(fact).select(*CUSTOMER).distinct()
    buyers = fact.filter(F.col("linea") == F.lit(req.marca))
    return top(not_in(active, buyers, "cliente").select(*CUSTOMER), [], CUSTOMER, req.limite)


@indicator("clientes_campeones")
def champions(fact: DataFrame, req: IndicatorRequest) -> DataFrame:
    rows = summarise(req.in_period(fact), BY_CUSTOMER, {
        "frecuencia_compras": "sale_invoices",
        "venta_neta": "sales",
        "descuentos_pesos": "discounts",
        "rentabilidad_comercial": "commercial",
        "cmv_muestras": "samples_or_zero",
        "rentabilidad_real_neta": "net",
    })
    return req.top(rows, ["frecuencia_compras", "venta_neta"], CUSTOMER)


@indicator("clientes_compradores")
def buyers(fact: DataFrame, req: IndicatorRequest) -> DataFrame:
    return summarise(req.in_period(fact), {}, {"clientes_compradores_unicos": "customers"})


@indicator("nuevos_clientes_periodo")
def new_customers(fact: DataFrame, req: IndicatorRequest) -> DataFrame:
    """Customers whose first day in the period is their first day ever.

    One scan: both minima come from the same aggregate, and the minimum over a customer's
    names is taken on the grouped rows.
    """
    days = fact.groupBy(*CUSTOMER).agg(
        F.min("fecha").alias("_first"),
        F.min(F.when(req.period_condition(), F.col("fecha"))).alias("primera_compra"),
    )
    ever = F.min("_first").over(Window.partitionBy("cliente"))
    fresh = days.filter(F.col("cliente").isNotNull()).withColumn("_ever", ever).filter("primera_compra = _ever")
    return top(fresh.select(*CUSTOMER, "primera_compra"), "primera_compra", CUSTOMER, req.limite, down=False)


@indicator("clientes_dormidos")
def dormant(fact: DataFrame, req: IndicatorRequest) -> DataFrame:
    """Over all history, whatever the period."""
    idle = days_between(req.today(), F.col("ultima_compra"))
    rows = summarise(fact, BY_CUSTOMER, {"ultima_compra": "last_day"}).withColumn("dias_sin_comprar", idle)
    asleep = rows.filter(F.col("dias_sin_comprar") > or_default(req.dias_sin_compra, 60))
    return top(asleep, "dias_sin_comprar", CUSTOMER, req.limite)


@indicator("reactivacion_clientes")
def reactivated(fact: DataFrame, req: IndicatorRequest) -> DataFrame:
    """Customers of the period without a purchase in the days before its first sale."""
    period = req.in_period(fact)
    first, days = period.agg(F.min("fecha")).scalar(), or_default(req.dias_previos, 90)
    earlier = fact.filter((F.col("fecha") >= F.date_sub(first, days)) & (F.col("fecha") < first))
    if MONTH in fact.columns:  # whole months are skipped as well
        earlier = earlier.filter(F.col(MONTH).between(month_label(F.date_sub(first, days)), month_label(first)))
    back = period.groupBy(*CUSTOMER).agg(F.min("fecha").alias("fecha_reactivacion"))
    rows = not_in(back, earlier, "cliente").select(*CUSTOMER, "fecha_reactivacion")
    return top(rows, "fecha_reactivacion", CUSTOMER, req.limite, down=False)


@indicator("frecuencia_compra_cliente")
def purchase_frequency(fact: DataFrame, req: IndicatorRequest) -> DataFrame:
    rows = summarise(req.in_period(fact), BY_CUSTOMER, {
        "total_compras": "invoices", "primera_compra": "first_day", "ultima_compra": "last_day",
    }).filter("total_compras > 1")
    span = days_between(F.col("ultima_compra"), F.col("primera_compra")).cast("decimal(10,0)")
    gap = mean_money(span, F.col("total_compras") - 1)
    return req.top(rows.withColumn("dias_entre_compras", gap), "dias_entre_compras", CUSTOMER)


@indicator("venta_cruzada")
def cross_selling(fact: DataFrame, req: IndicatorRequest) -> DataFrame:
    rows = summarise(req.in_period(fact.filter("importe > 0")), BY_CUSTOMER, {
        "lineas_distintas_compradas": "brands", "venta_total": "all_amount",
    })
    return req.top(rows.filter("lineas_distintas_compradas > 1"), "lineas_distintas_compradas", CUSTOMER)


@indicator("mix_cliente")
def customer_mix(fact: DataFrame, req: IndicatorRequest) -> DataFrame:
    req.require("cliente_id")
    own = req.in_period(fact.filter((F.col("cliente") == F.lit(req.cliente_id)) & (F.col("importe") > 0)))
    lines = own.groupBy("cliente", "linea").agg(F.sum("importe").alias("venta_linea"))
    whole = F.sum("venta_linea").over(Window.partitionBy("cliente"))
    rows = lines.select("linea", "venta_linea", percent(F.col("venta_linea"), whole).alias("pct_del_cliente"))
    return top(rows, "venta_linea", ["linea"], None)


@indicator("rfm_segmentacion")
def rfm_segments(fact: DataFrame, req: IndicatorRequest) -> DataFrame:
    """Quartile scores, 1 best; worst customers first."""
    rows = summarise(req.in_period(fact.filter("importe > 0")), BY_CUSTOMER, {
        "_last": "last_day", "frecuencia": "invoices", "monto_total": "all_amount",
    }).withColumn("recencia_dias", days_between(req.today(), F.col("_last"))).drop("_last")
    ties = [sort_key(k, False) for k in CUSTOMER]
    for score, column, down in (
        ("r_score", "recencia_dias", False),
        ("f_score", "frecuencia", True),
        ("m_score", "monto_total", True),
    ):
        rows = with_tile(rows, [sort_key(column, down), *ties], score)
    shown = rows.select(*CUSTOMER, "recencia_dias", "frecuencia", "monto_total", "r_score", "f_score", "m_score")
    return top(shown, ["m_score", "f_score", "r_score"], CUSTOMER, req.limite)
