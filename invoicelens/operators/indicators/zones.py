"""Zones, channels and drivers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from invoicelens.functions.metrics import summarise
from invoicelens.operators.indicators.profitability import FULL_SPLIT
from invoicelens.plans.catalogue import indicator
from invoicelens.plans.params import IndicatorRequest

NET_SPLIT = {
    "venta_neta": "sales",
    "descuentos_pesos": "discounts",
    "rentabilidad_comercial": "commercial",
    "cmv_muestras": "samples_or_zero",
    "rentabilidad_real_neta": "net",
}


@indicator("potencial_venta_zonas")
def zones(fact: DataFrame, req: IndicatorRequest) -> DataFrame:
    rows = summarise(req.in_period(fact.filter("reparto IS NOT NULL")), {"zona": "reparto"},
                     {"clientes_activos": "sale_customers", **NET_SPLIT})
    return req.top(rows, "rentabilidad_real_neta", ["zona"])


@indicator("rentabilidad_volumen_subcanal")
def channels(fact: DataFrame, req: IndicatorRequest) -> DataFrame:
    rows = summarise(req.in_period(fact.filter("subcanal IS NOT NULL")), {"subcanal": "subcanal"},
                     {**FULL_SPLIT, "cmv_ventas": "cost", "total_kilos_vendidos": "kilos"})
    return req.top(rows, "rentabilidad_real_neta", ["subcanal"])


@indicator("ticket_promedio_subcanal")
def channel_ticket(fact: DataFrame, req: IndicatorRequest) -> DataFrame:
    rows = summarise(req.in_period(fact.filter("importe > 0")), {"subcanal": "subcanal"}, {
        "cantidad_facturas_emitidas": "invoices", "importe_total": "all_amount",
        "ticket_promedio_pesos": "mean_ticket",
    })
    return req.top(rows, "ticket_promedio_pesos", ["subcanal"])


@indicator("ticket_promedio_cliente")
def customer_ticket(fact: DataFrame, req: IndicatorRequest) -> DataFrame:
    keys = {"cod_cliente": "cliente", "razon_social": "razon_social", "subcanal": "subcanal"}
    rows = summarise(req.in_period(fact.filter("importe > 0")), keys, {
        "cantidad_compras": "invoices", "importe_total": "all_amount", "ticket_promedio_pesos": "mean_ticket",
    })
    return req.top(rows.filter("cantidad_compras > 1"), "ticket_promedio_pesos", list(keys))


@indicator("rendimiento_chofer")
def drivers(fact: DataFrame, req: IndicatorRequest) -> DataFrame:
    rows = summarise(req.in_period(fact.filter("chofer IS NOT NULL")), {"chofer": "chofer"},
                     {"facturas_entregadas": "sale_invoices", "clientes_atendidos": "sale_customers", **NET_SPLIT})
    return req.top(rows, "rentabilidad_real_neta", ["chofer"])
