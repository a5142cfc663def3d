"""SQL of the tools and of the building blocks."""

from __future__ import annotations

from oracle.base import AS_OF, CV, D, MU, MUN, NM, PERIOD, RC, RC0, RN, VN, days, first, mean, over_fact, pct, pos, ratio

UNIT_COST = "cantidad * pr_costo_uni_neto"
RATE = "(CAST(descuento AS DOUBLE) / 100)"
MARGIN = f"(SUM(importe) - SUM({UNIT_COST}))"


def _rfm(names: tuple[str, ...], where: str, tail: str = "") -> str:
    key, label, recency, frequency, amount = names
    return f"""SELECT cliente AS {key}, MAX(razon_social) AS {label}, {AS_OF} - MAX(fecha) AS {recency},
 COUNT(DISTINCT idunica) AS {frequency}, SUM(importe) AS {amount} FROM v WHERE {where} GROUP BY cliente {tail}"""


RFM = ("id", "nombre", "recencia", "frecuencia", "monetario")
NETAS = f"({VN} - SUM(d1))"
BRUTA = f"({VN} - SUM(d1) - {CV})"
REAL = f"({VN} - SUM(d1) - {CV} - {MUN})"


def _profit(column: str, period: str) -> str:
    return f"""SELECT {column} AS dimension, {VN} AS ventas_brutas, SUM(d1) AS descuentos_totales, {NETAS} AS ventas_netas,
 {CV} AS costo_de_ventas, {BRUTA} AS utilidad_bruta, {MUN} AS costo_muestras, {REAL} AS rentabilidad_real_neta,
 {pct(BRUTA, NETAS)} AS margen_bruto_pct, {pct(REAL, NETAS)} AS margen_real_pct
FROM v WHERE {column} IS NOT NULL AND {period} GROUP BY {column} {first('rentabilidad_real_neta', 'dimension', 20)}"""


BACK_PCT = f"{ratio('ABS(SUM(CASE WHEN importe < 0 THEN importe ELSE 0 END))', 'SUM(CASE WHEN importe > 0 THEN importe ELSE 0 END)')} * 100"
TICKET = f"{ratio('SUM(importe)', 'COUNT(DISTINCT idunica)')}"


def _pareto(where: str) -> str:
    return f"""SELECT {ratio('SUM(CASE WHEN rn <= GREATEST(1, ROUND(n * 0.20)) THEN margen END)', 'SUM(margen)')} * 100 AS concentracion_pareto_20_pct
FROM (SELECT margen, ROW_NUMBER() OVER (ORDER BY margen DESC, cliente) AS rn, COUNT(*) OVER () AS n
 FROM (SELECT cliente, SUM(importe - ({UNIT_COST})) AS margen FROM v WHERE cliente IS NOT NULL AND {where} GROUP BY cliente) c
 WHERE margen > 0) r"""


def _aggregation(column: str, where: str, metric: str) -> str:
    return f"""SELECT {column} AS categoria, COUNT(DISTINCT cliente) AS clientes_compradores, SUM(cantidad) AS cantidad_total,
 SUM(importe) AS ventas_totales_brutas, SUM(importe) AS importe_neta, SUM(d1) AS total_descuentos_pesos,
 {ratio('SUM(d1)', 'SUM(importe)')} * 100 AS porcentaje_descuentos_sobre_ventas, {MARGIN} AS margen_total,
 {ratio(MARGIN, 'SUM(importe)')} * 100 AS margen_porcentaje
FROM v WHERE {column} IS NOT NULL AND {where} GROUP BY {column} {first(metric, 'categoria', 20)}"""


def _seller(where: str) -> str:
    return f"""SELECT cod_ven AS codigo_vendedor, COUNT(DISTINCT comprobante) AS total_operaciones, SUM(cantidad) AS volumen_unidades,
 SUM(neto) AS venta_neta_total, SUM(valordesc) AS total_descuentos_aplicados,
 {mean('SUM(neto)', 'COUNT(DISTINCT comprobante)')} AS ticket_promedio
FROM v WHERE {where} GROUP BY cod_ven {first('venta_neta_total', 'codigo_vendedor', 20)}"""


def _daily(shown: str, tail: str = "") -> str:
    return f"SELECT fecha, {shown} FROM v GROUP BY fecha {tail}"


LEAK = f"({VN} - {REAL})"

BODIES = {
    "a1_health_metrics": f"""SELECT SUM(importe) AS ingresos_brutos,
 SUM(CAST(CAST(importe AS DOUBLE) / NULLIF(1 - {RATE}, 0) * {RATE} AS DECIMAL(28,8))) AS monto_descuentos,
 SUM({UNIT_COST}) AS cmv_comercial, {MARGIN} AS utilidad_bruta, {pct(MARGIN, 'SUM(importe)')} AS margen_bruto_pct,
 (SELECT SUM({UNIT_COST}) FROM v WHERE descuento >= 100) AS costo_inversion_marketing
FROM v WHERE importe > 0 AND {PERIOD}""",
    "a2_customer_analytics_rfm": _rfm(RFM, "importe > 0", first("monetario", "id")),
    "a3_customer_analytics_dormidos": f"""SELECT cliente, razon_social, MAX(fecha) AS ultima_vta FROM v GROUP BY cliente, razon_social
HAVING MAX(fecha) < {AS_OF} - 60 {first('ultima_vta', 'cliente, razon_social')}""",
    "a4_customer_analytics_campeones": f"""SELECT cliente, razon_social, SUM(importe) AS total FROM v GROUP BY cliente, razon_social
{first('total', 'cliente, razon_social', 10)}""",
    "a5_profitability_vendedor": _profit("cod_ven", PERIOD),
    "a5_profitability_fecha": _profit("fecha", days("2001-05-01", "2001-06-30")),
    "a6_sales_opportunities": f"""SELECT m.entidad, m.cliente, m.linea AS marca_ausente,
 'Oportunidad de Venta' AS accion_sugerida, 'Sin compras detectadas en el periodo' AS observacion
FROM (SELECT c.cliente, c.entidad, l.linea FROM (
  SELECT razon_social AS cliente, cod_ven AS entidad, SUM(facturacion) AS total FROM v WHERE cod_ven IS NOT NULL AND {PERIOD}
  GROUP BY razon_social, cod_ven {first('total', 'cliente, entidad', 20)}) c
 CROSS JOIN (SELECT DISTINCT linea FROM v WHERE linea IS NOT NULL AND linea <> '') l) m
LEFT JOIN (SELECT DISTINCT razon_social AS cliente, linea FROM v WHERE {PERIOD}) r ON m.cliente = r.cliente AND m.linea = r.linea
WHERE r.linea IS NULL""",
    "a7_seller_performance": _seller(PERIOD),
    "l1_health_metrics_v1": f"""SELECT SUM(importe) AS ingresos_totales, SUM({UNIT_COST}) AS cmv_total, {MARGIN} AS utilidad_bruta,
 {ratio(MARGIN, 'SUM(importe)')} * 100 AS margen_bruto_porcentaje FROM v WHERE descuento < 100 AND {PERIOD}""",
    "l2_rfm_analysis": _rfm(("cliente_id", "cliente_nombre", "recencia_dias", "frecuencia_compras", "valor_monetario"),
                            "cliente IS NOT NULL AND importe > 0", first("valor_monetario", "cliente_id")),
    "l3_breakeven_point": f"""SELECT 5000000.0 / (1 - cmv_periodo / ventas_periodo) AS punto_equilibrio_pesos,
 CAST(5000000 AS DOUBLE) AS costos_fijos_ingresados, ventas_periodo, cmv_periodo
FROM (SELECT CAST(SUM(importe) AS DOUBLE) AS ventas_periodo, CAST(SUM({UNIT_COST}) AS DOUBLE) AS cmv_periodo
 FROM v WHERE descuento < 100 AND {PERIOD}) t WHERE ventas_periodo <> 0""",
    "l4_ticket_promedio": f"SELECT {TICKET} AS ticket_promedio FROM v WHERE importe > 0",
    "l5_indice_devoluciones": f"SELECT {BACK_PCT} AS indice_devoluciones_pct FROM v",
    "l6_concentracion_pareto": _pareto("TRUE"),
    "l7_additional_kpis": f"""SELECT (SELECT {TICKET} FROM v WHERE importe > 0 AND {PERIOD}) AS ticket_promedio,
 (SELECT {BACK_PCT} FROM v WHERE {PERIOD}) AS indice_devoluciones_pct, ({_pareto(PERIOD)}) AS concentracion_pareto_20_pct""",
    "l8_sales_aggregations": _aggregation("rubro", "TRUE", "margen_total"),
    "l8_sales_aggregations_cliente": _aggregation("cliente", days("2000-01-01"), "cantidad_total"),
    "e4_riesgo_de_fuga": f"""SELECT *, CASE WHEN grupo_monto <= 1 AND recencia > 45 THEN 'Riesgo Crítico de Fuga' END AS clasificacion
FROM (SELECT *, NTILE(4) OVER (ORDER BY monetario DESC NULLS FIRST, id) AS grupo_monto FROM ({_rfm(RFM, 'importe > 0')}) r) t""",
    "e5_deteccion_de_fugas": f"""SELECT cod_ven AS dimension, {VN} AS ventas_brutas, {REAL} AS rentabilidad_real_neta, {LEAK} AS fuga,
 {pct(LEAK, VN)} AS fuga_pct, SUM(d1) AS descuentos_totales, {pct('SUM(d1)', VN)} AS impacto_descuentos_pct,
 {MUN} AS costo_muestras, {pct(MUN, VN)} AS impacto_muestras_pct
FROM v WHERE cod_ven IS NOT NULL AND {PERIOD} GROUP BY cod_ven""",
    "b01_filtro_fecha_herramienta": f"SELECT COUNT(*) AS filas, MAX(fecha) AS ultima FROM v WHERE {days(end='1999-12-31')}",
    "b02_filtro_fecha_indicador": f"SELECT rubro, SUM(importe) AS venta_facturada FROM v GROUP BY rubro {first('venta_facturada', 'rubro')}",
    "b03_dimensiones": """SELECT MAX(cod_ven) AS vendedor, MAX(razon_social) AS cliente, MAX(articulo) AS articulo,
 MAX(rubro) AS rubro, MAX(subcanal) AS subcanal, MAX(linea) AS linea, MAX(chofer) AS chofer,
 MAX(segmentoproducto) AS segmento, MAX(fecha) AS fecha FROM v""",
    "b04_agregado_condicional": _daily(f"{MUN} AS muestras, {NM} AS items_muestra, {pos('cantidad')} AS unidades"),
    "b05_ventas_descuentos_costo": _daily(f"{VN} AS vn, {D} AS d, {CV} AS cv"),
    "b06_rentabilidad_comercial": _daily(f"{RC0} AS rc0, {RC} AS rc"),
    "b07_rentabilidad_neta": _daily(f"{MU} AS mu, {RN} AS rn"),
    "b08_porcentaje": _daily(f"{pct(D, VN)} AS pct_descuento, {pct(RN, VN)} AS pct_neto"),
    "b09_primeros_n": _daily(f"{MUN} AS muestras", first("muestras", "fecha")),
    "b10_limite_por_defecto": _seller("TRUE"),
    "b11_parametros": f"""SELECT linea AS marca_foco, SUM(importe) AS venta_facturada FROM v WHERE linea IN ('Brand#3', 'it''s') AND {PERIOD}
GROUP BY linea {first('venta_facturada', 'marca_foco')}""",
    "b12_sin_datos": f"""SELECT cod_ven, {VN} AS venta_neta_comercial, {CV} AS cmv_comercial, {RC0} AS rentabilidad_comercial,
 {pct(RC0, VN)} AS margen_pct_comercial, {NM} AS items_muestra_gratis, {MUN} AS cmv_muestras_gratis,
 SUM(facturacion - cmv) AS rentabilidad_real_total, {pct('SUM(facturacion - cmv)', VN)} AS margen_pct_real
FROM v WHERE {days('2030-01-01')} GROUP BY cod_ven""",
}


def sql() -> dict[str, str]:
    return {key: over_fact(body) for key, body in BODIES.items()}
