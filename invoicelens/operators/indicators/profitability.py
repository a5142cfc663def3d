"""Profitability, discounts and free samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from invoicelens.functions.metrics import is_sample, measure, metric, ratio, summarise
from invoicelens.plans.catalogue import indicator
from invoicelens.plans.params import IndicatorRequest, top


@indicator("rentabilidad_vendedor")
def by_seller(fact: DataFrame, req: IndicatorRequest) -> DataFrame:
    rows = summarise(req.in_period(fact), {"cod_ven": "cod_ven"}, {
        "venta_neta_comercial": "sales",
        "cmv_comercial": "cost",
        "rentabilidad_comercial": "gross",
        "margen_pct_comercial": "gross_pct",
        "items_muestra_gratis": "sample_lines",
        "cmv_muestras_gratis": "samples",
        "rentabilidad_real_total": "all_gross",
        "margen_pct_real": "all_gross_pct",
    })
    return req.top(rows, "rentabilidad_comercial", ["cod_ven"])


def _losing(fact: DataFrame, req: IndicatorRequest, keys: list[str]) -> DataFrame:
    rows = summarise(req.in_period(fact), {k: k for k in keys}, {
        "venta_neta": "all_sales",
        "descuentos_pesos": "discounts",
        "cmv_ventas": "cost",
        "rentabilidad_comercial": "commercial",
        "cmv_muestras": "samples_or_zero",
        "rentabilidad_real_neta": "net",
    })
    return req.top(rows.filter(F.col("rentabilidad_real_neta") <= 0), "rentabilidad_real_neta", keys)


@indicator("clientes_no_rentables")
def losing_customers(fact: DataFrame, req: IndicatorRequest) -> DataFrame:
    return _losing(fact, req, ["cliente", "razon_social"])


@indicator("productos_no_rentables")
def losing_products(fact: DataFrame, req: IndicatorRequest) -> DataFrame:
    return _losing(fact, req, ["art", "articulo"])


@indicator("aumentar_margen_sin_caida_ventas")
def high_volume_low_margin(fact: DataFrame, req: IndicatorRequest) -> DataFrame:
    shown = {
        "volumen_unidades": "all_units",
        "venta_neta": "sales",
        "descuentos_pesos": "discounts",
        "pct_descuento": "discount_pct",
        "rentabilidad_comercial": "commercial",
        "margen_pct_comercial": "commercial_pct",
    }
    keys = ["art", "articulo"]
    grouped = measure(req.in_period(fact), keys, [*shown.values(), "units"])
    kept = grouped.filter(
        (metric("units") > F.lit(req.min_unidades))
        & (ratio(metric("commercial"), metric("sales")) < F.lit(req.max_margen))
    )
    rows = kept.select(*keys, *[metric(m).alias(name) for name, m in shown.items()])
    return req.top(rows, "volumen_unidades", keys)


@indicator("margen_por_articulo")
def by_product(fact: DataFrame, req: IndicatorRequest) -> DataFrame:
    rows = summarise(req.in_period(fact.filter(F.col("importe") >= 0)), {"art": "art", "articulo": "articulo"}, {
        "volumen_unidades": "units",
        "venta_neta": "sales",
        "descuentos_pesos": "discounts",
        "pct_descuento": "discount_pct",
        "cmv_ventas": "cost",
        "rentabilidad_comercial": "commercial",
        "margen_pct_comercial": "commercial_pct",
        "cmv_muestras": "samples_or_zero",
        "rentabilidad_real_neta": "net",
        "margen_pct_real": "net_pct",
    })
    return req.top(rows, "rentabilidad_real_neta", ["art", "articulo"])


@indicator("margen_total")
def overall(fact: DataFrame, req: IndicatorRequest) -> DataFrame:
    return summarise(req.in_period(fact), {}, {
        "venta_neta_comercial": "sales",
        "cmv_comercial": "cost",
        "rentabilidad_comercial": "gross",
        "margen_pct_comercial": "gross_pct",
        "items_muestra_gratis": "sample_lines",
        "cmv_muestras_gratis": "samples",
        "venta_neta_total": "all_sales",
        "cmv_total": "all_cost",
        "rentabilidad_real_total": "all_gross",
        "margen_pct_real": "all_gross_on_all_pct",
    })


@indicator("margen_descuentos_por_proveedor")
def by_supplier_brand(fact: DataFrame, req: IndicatorRequest) -> DataFrame:
    rows = summarise(req.in_period(fact), {"proveedor_proxy": "linea"}, {
        "venta_neta": "sales",
        "descuentos_otorgados": "discounts",
        "pct_descuento": "discount_pct",
        "rentabilidad_comercial": "commercial",
        "cmv_muestras": "samples_or_zero",
        "rentabilidad_real_neta": "net",
        "margen_pct_real": "net_pct",
    })
    return req.top(rows, "rentabilidad_real_neta", ["proveedor_proxy"])


# Shared by the reports that split discount, commercial margin, samples and net margin.
FULL_SPLIT = {
    "venta_neta": "sales",
    "descuentos_pesos": "discounts",
    "pct_descuento": "discount_pct",
    "rentabilidad_comercial": "commercial",
    "margen_pct_comercial": "commercial_pct",
    "cmv_muestras": "samples_or_zero",
    "rentabilidad_real_neta": "net",
    "margen_pct_real": "net_pct",
}


@indicator("ganancia_por_categoria")
def by_brand(fact: DataFrame, req: IndicatorRequest) -> DataFrame:
    known = req.in_period(fact.filter(F.col("linea").isNotNull()))
    rows = summarise(known, {"categoria": "linea"}, {**FULL_SPLIT, "cmv_ventas": "cost"})
    return top(rows, "rentabilidad_real_neta", ["categoria"], req.limite)


@indicator("margen_por_segmento")
def by_segment(fact: DataFrame, req: IndicatorRequest) -> DataFrame:
    known = req.in_period(fact.filter(F.col("segmentoproducto").isNotNull()))
    rows = summarise(known, {"segmentoproducto": "segmentoproducto"},
                     {"clientes_compradores": "sale_customers", **FULL_SPLIT})
    return req.top(rows, "rentabilidad_real_neta", ["segmentoproducto"])


@indicator("rentabilidad_bruta_discriminada")
def commercial_against_real(fact: DataFrame, req: IndicatorRequest) -> DataFrame:
    return summarise(req.in_period(fact), {}, {
        "venta_neta_comercial": "sales",
        "cmv_ventas_reales": "cost",
        "rentabilidad_comercial": "gross",
        "margen_pct_comercial": "gross_pct",
        "cantidad_items_muestra": "sample_lines",
        "cmv_muestras_gratis": "samples",
        "pct_muestras_sobre_venta": "samples_pct",
        "rentabilidad_real_total": "all_gross",
        "margen_pct_real": "all_gross_pct",
        "impacto_muestras_en_resultado": "sample_impact",
    })


@indicator("rentabilidad_vendedor_discriminada")
def by_seller_split(fact: DataFrame, req: IndicatorRequest) -> DataFrame:
    rows = summarise(req.in_period(fact), {"cod_ven": "cod_ven"}, {
        "facturas_emitidas": "sale_invoices",
        "venta_neta_comercial": "sales",
        "descuentos_pesos": "discounts",
        "pct_descuento": "discount_pct",
        "cmv_ventas": "cost",
        "rentabilidad_comercial": "gross",
        "margen_pct_comercial": "gross_pct",
        "items_muestra_gratis": "sample_lines",
        "cmv_muestras": "samples",
        "pct_muestras_sobre_venta": "samples_pct",
        "pct_costo_comercial_total": "strict_spend_pct",
        "rentabilidad_real": "all_gross",
        "margen_pct_real": "all_gross_pct",
    })
    return req.top(rows, "rentabilidad_comercial", ["cod_ven"])


@indicator("descuentos_por_vendedor")
def discounts_by_seller(fact: DataFrame, req: IndicatorRequest) -> DataFrame:
    rows = summarise(req.in_period(fact), {"cod_ven": "cod_ven"}, {
        "facturas_emitidas": "sale_invoices",
        "venta_neta": "sales",
        "descuento_pesos": "discounts",
        "pct_descuento": "discount_pct",
        "items_muestra_gratis": "sample_lines",
        "cmv_muestras": "samples",
        "pct_muestras": "samples_pct",
        "costo_comercial_total_pesos": "commercial_spend",
        "pct_costo_comercial_total": "commercial_spend_pct",
    })
    return req.top(rows, "pct_costo_comercial_total", ["cod_ven"])


@indicator("descuentos_detalle")
def sample_lines(fact: DataFrame, req: IndicatorRequest) -> DataFrame:
    rows = req.in_period(fact.filter(is_sample())).select(
        "cod_ven",
        F.col("razon_social").alias("cliente"),
        "articulo",
        "linea",
        "fecha",
        "cantidad",
        F.col("pr_costo_uni_neto").alias("costo_unitario"),
        F.col("cmv").alias("costo_total_muestra"),
    )
    ties = ["cod_ven", "cliente", "articulo", "linea", "fecha", "cantidad", "costo_unitario"]
    return req.top(rows, "costo_total_muestra", ties)


@indicator("inversion_dtos")
def discount_total(fact: DataFrame, req: IndicatorRequest) -> DataFrame:
    return summarise(req.in_period(fact), {}, {"inversion_total_descuentos": "all_discounts"})


@indicator("pct_venta_sin_dto")
def undiscounted_share(fact: DataFrame, req: IndicatorRequest) -> DataFrame:
    no_discount = F.col("d1").isNull() | (F.col("d1") == 0)
    plain = F.sum(F.when(no_discount, F.col("importe")).otherwise(0))
    return req.in_period(fact).agg((ratio(plain, F.sum("importe")) * 100).alias("pct_ventas_sin_descuento"))
