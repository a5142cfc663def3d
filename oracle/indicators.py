"""SQL of the named indicators."""

from __future__ import annotations

from oracle.base import (
    AS_OF, CV, D, MU, MUN, NM, PERIOD, RC, RC0, RN, VN, days, first, mean, over_fact, pct, pos, ratio,
)

BACK = "motivodev IS NOT NULL AND motivodev NOT IN ('', '0')"
C = "cliente, razon_social"
P = "art, articulo"

SPLIT = f"""{VN} AS venta_neta, {D} AS descuentos_pesos, {pct(D, VN)} AS pct_descuento,
 {RC} AS rentabilidad_comercial, {pct(RC, VN)} AS margen_pct_comercial, {MU} AS cmv_muestras,
 {RN} AS rentabilidad_real_neta, {pct(RN, VN)} AS margen_pct_real"""
NET = f"""{VN} AS venta_neta, {D} AS descuentos_pesos, {RC} AS rentabilidad_comercial,
 {MU} AS cmv_muestras, {RN} AS rentabilidad_real_neta"""
EVOLUTION = f"""{VN} AS venta_neta, {D} AS descuentos_pesos, {RC} AS rentabilidad_comercial,
 {pct(RC, VN)} AS margen_pct_comercial, {MU} AS cmv_muestras, {RN} AS rentabilidad_real_neta,
 {pct(RN, VN)} AS margen_pct_real"""


def _seller(where: str, tail: str) -> str:
    return f"""SELECT cod_ven, {VN} AS venta_neta_comercial, {CV} AS cmv_comercial, {RC0} AS rentabilidad_comercial,
 {pct(RC0, VN)} AS margen_pct_comercial, {NM} AS items_muestra_gratis, {MUN} AS cmv_muestras_gratis,
 SUM(facturacion - cmv) AS rentabilidad_real_total, {pct('SUM(facturacion - cmv)', VN)} AS margen_pct_real
FROM v WHERE {where} GROUP BY cod_ven {tail}"""


def _losing(keys: str, down: bool) -> str:
    return f"""SELECT {keys}, SUM(facturacion) AS venta_neta, {D} AS descuentos_pesos, {CV} AS cmv_ventas,
 {RC} AS rentabilidad_comercial, {MU} AS cmv_muestras, {RN} AS rentabilidad_real_neta
FROM v GROUP BY {keys} HAVING {RN} <= 0 {first('rentabilidad_real_neta', keys, down=down)}"""


def _amount(name: str, column: str, where: str = "TRUE", down: bool = True) -> str:
    return f"""SELECT {column} AS {name}, SUM(importe) AS venta_facturada FROM v WHERE {where}
GROUP BY {column} {first('venta_facturada', name, down=down)}"""


def _ntile(column: str, order: str) -> str:
    return f"NTILE(4) OVER (ORDER BY {column} {order}, cliente, razon_social)"


NOW, BEFORE = "fecha BETWEEN DATE '2000-01-01' AND DATE '2001-06-30'", "fecha BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'"
A = f"SUM(CASE WHEN {NOW} THEN importe ELSE 0 END)"
B = f"SUM(CASE WHEN {BEFORE} THEN importe ELSE 0 END)"
REJ = f"COUNT(DISTINCT CASE WHEN {BACK} THEN comprobante END)"
INV, SINV, SCLI = ("COUNT(DISTINCT comprobante)", "COUNT(DISTINCT comprobante) FILTER (WHERE importe > 0)",
                   "COUNT(DISTINCT cliente) FILTER (WHERE importe > 0)")

BODIES = {
    "k01_rentabilidad_vendedor": _seller("TRUE", first("rentabilidad_comercial", "cod_ven")),
    "k01_rentabilidad_vendedor_periodo_asc": _seller(PERIOD, first("rentabilidad_comercial", "cod_ven", down=False)),
    "k02_clientes_no_rentables": _losing(C, True),
    "k03_productos_no_rentables": _losing(P, False),
    "k04_aumentar_margen_sin_caida_ventas": f"""SELECT {P}, SUM(cantidad) AS volumen_unidades, {VN} AS venta_neta,
 {D} AS descuentos_pesos, {pct(D, VN)} AS pct_descuento, {RC} AS rentabilidad_comercial, {pct(RC, VN)} AS margen_pct_comercial
FROM v GROUP BY {P} HAVING {pos('cantidad')} > 600 AND {ratio(RC, VN)} < 0.15 {first('volumen_unidades', P)}""",
    "k05_margen_por_articulo": f"""SELECT {P}, {pos('cantidad')} AS volumen_unidades, {CV} AS cmv_ventas, {SPLIT}
FROM v WHERE importe >= 0 AND {PERIOD} GROUP BY {P} {first('rentabilidad_real_neta', P)}""",
    "k06_margen_total": f"""SELECT {VN} AS venta_neta_comercial, {CV} AS cmv_comercial, {RC0} AS rentabilidad_comercial,
 {pct(RC0, VN)} AS margen_pct_comercial, {NM} AS items_muestra_gratis, {MUN} AS cmv_muestras_gratis,
 SUM(facturacion) AS venta_neta_total, SUM(cmv) AS cmv_total, SUM(facturacion - cmv) AS rentabilidad_real_total,
 {pct('SUM(facturacion - cmv)', 'SUM(facturacion)')} AS margen_pct_real FROM v""",
    "k07_margen_descuentos_por_proveedor": f"""SELECT linea AS proveedor_proxy, {VN} AS venta_neta,
 {D} AS descuentos_otorgados, {pct(D, VN)} AS pct_descuento, {RC} AS rentabilidad_comercial, {MU} AS cmv_muestras,
 {RN} AS rentabilidad_real_neta, {pct(RN, VN)} AS margen_pct_real
FROM v WHERE {PERIOD} GROUP BY linea {first('rentabilidad_real_neta', 'proveedor_proxy')}""",
    "k08_ganancia_por_categoria": f"""SELECT linea AS categoria, {CV} AS cmv_ventas, {SPLIT}
FROM v WHERE linea IS NOT NULL GROUP BY linea {first('rentabilidad_real_neta', 'categoria')}""",
    "k09_margen_por_segmento": f"""SELECT segmentoproducto, {SCLI} AS clientes_compradores, {SPLIT}
FROM v WHERE segmentoproducto IS NOT NULL GROUP BY segmentoproducto {first('rentabilidad_real_neta', 'segmentoproducto')}""",
    "k10_clientes_dto_arriba_stnd": f"""SELECT {C}, {ratio('SUM(d1)', 'SUM(importe)')} * 100 AS pct_descuento_otorgado
FROM v GROUP BY {C} HAVING {ratio('SUM(d1)', 'SUM(importe)')} > 0.05 {first('pct_descuento_otorgado', C)}""",
    "k11_clientes_no_compran_marca": f"""SELECT DISTINCT {C} FROM v
WHERE cliente NOT IN (SELECT cliente FROM v WHERE linea = 'Brand#2') AND {PERIOD}
ORDER BY cliente ASC NULLS LAST, razon_social ASC NULLS LAST LIMIT 50""",
    "k12_clientes_campeones": f"""SELECT {C}, {SINV} AS frecuencia_compras, {NET} FROM v GROUP BY {C}
ORDER BY frecuencia_compras DESC NULLS FIRST, venta_neta DESC NULLS FIRST, cliente, razon_social LIMIT 50""",
    "k13_clientes_compradores": f"SELECT COUNT(DISTINCT cliente) AS clientes_compradores_unicos FROM v WHERE {PERIOD}",
    "k14_nuevos_clientes_periodo": f"""SELECT {C}, MIN(fecha) AS primera_compra FROM v
WHERE {days('1995-06-01', '2001-06-30')} GROUP BY {C}
HAVING MIN(fecha) = (SELECT MIN(f2.fecha) FROM v f2 WHERE f2.cliente = v.cliente) {first('primera_compra', C, down=False)}""",
    "k15_clientes_dormidos": f"""SELECT {C}, MAX(fecha) AS ultima_compra, {AS_OF} - MAX(fecha) AS dias_sin_comprar
FROM v GROUP BY {C} HAVING MAX(fecha) < {AS_OF} - 60 {first('dias_sin_comprar', C)}""",
    "k16_reactivacion_clientes": f"""SELECT {C}, MIN(fecha) AS fecha_reactivacion FROM v
WHERE {PERIOD} AND cliente NOT IN (SELECT cliente FROM v
 WHERE fecha >= (SELECT MIN(fecha) FROM v WHERE {PERIOD}) - 90 AND fecha < (SELECT MIN(fecha) FROM v WHERE {PERIOD}))
GROUP BY {C} {first('fecha_reactivacion', C, down=False)}""",
    "k17_frecuencia_compra_cliente": f"""SELECT {C}, {INV} AS total_compras, MIN(fecha) AS primera_compra,
 MAX(fecha) AS ultima_compra, {mean('(MAX(fecha) - MIN(fecha))', f'({INV} - 1)')} AS dias_entre_compras
FROM v GROUP BY {C} HAVING {INV} > 1 {first('dias_entre_compras', C)}""",
    "k18_venta_cruzada": f"""SELECT {C}, COUNT(DISTINCT linea) AS lineas_distintas_compradas, SUM(importe) AS venta_total
FROM v WHERE importe > 0 AND {PERIOD} GROUP BY {C} HAVING COUNT(DISTINCT linea) > 1 {first('lineas_distintas_compradas', C)}""",
    "k19_mix_cliente": f"""SELECT linea, SUM(importe) AS venta_linea, {pct('SUM(importe)', 'SUM(SUM(importe)) OVER ()')} AS pct_del_cliente
FROM v WHERE cliente = 7 AND importe > 0 GROUP BY linea {first('venta_linea', 'linea', None)}""",
    "k20_rfm_segmentacion": f"""SELECT *, {_ntile('recencia_dias', 'ASC NULLS LAST')} AS r_score,
 {_ntile('frecuencia', 'DESC NULLS FIRST')} AS f_score, {_ntile('monto_total', 'DESC NULLS FIRST')} AS m_score
FROM (SELECT {C}, {AS_OF} - MAX(fecha) AS recencia_dias, {INV} AS frecuencia, SUM(importe) AS monto_total
 FROM v WHERE importe > 0 GROUP BY {C}) r
ORDER BY m_score DESC, f_score DESC, r_score DESC, cliente, razon_social LIMIT 50""",
    "k21_venta_total": f"SELECT SUM(importe) AS venta_bruta, SUM(importe) AS venta_facturada FROM v WHERE {PERIOD}",
    "k22_venta_por_vendedor": _amount("cod_ven", "cod_ven"),
    "k23_venta_por_categoria": _amount("rubro", "rubro", down=False),
    "k24_venta_marcas_foco": _amount("marca_foco", "linea", "linea IN ('Brand#1', 'Brand#2', 'Brand#7')"),
    "k25_producto_mas_vendido": f"""SELECT {P}, SUM(cantidad) AS volumen_unidades, SUM(importe) AS venta_total
FROM v GROUP BY {P} {first('volumen_unidades', P)}""",
    "k26_evolucion_precio_promedio": f"""SELECT {P}, SUM(importe) AS venta_total, SUM(cantidad) AS unidades_vendidas,
 {ratio('SUM(importe)', 'SUM(cantidad)')} AS precio_promedio FROM v GROUP BY {P} {first('precio_promedio', P)}""",
    "k27_evolucion_diaria_ventas": f"""SELECT strftime(fecha, '%d/%m/%Y') AS fecha_formateada, {EVOLUTION}
FROM v WHERE {PERIOD} GROUP BY fecha {first('fecha', '', down=False)}""",
    "k28_evolucion_mensual_ventas": f"""SELECT strftime(fecha, '%Y-%m') AS mes, {EVOLUTION}
FROM v GROUP BY strftime(fecha, '%Y-%m') {first('mes', '', down=False)}""",
    "k29_comparativo_periodos": f"""SELECT {A} AS venta_periodo_actual, {B} AS venta_periodo_anterior,
 {pct(f'({A} - {B})', B)} AS variacion_porcentual,
 SUM(CASE WHEN {NOW} THEN importe - cmv ELSE 0 END) AS margen_actual,
 SUM(CASE WHEN {BEFORE} THEN importe - cmv ELSE 0 END) AS margen_anterior FROM v WHERE importe > 0""",
    "k30_inversion_dtos": "SELECT SUM(d1) AS inversion_total_descuentos FROM v",
    "k31_pct_venta_sin_dto": f"""SELECT {ratio('SUM(CASE WHEN d1 = 0 OR d1 IS NULL THEN importe ELSE 0 END)', 'SUM(importe)')} * 100
 AS pct_ventas_sin_descuento FROM v""",
    "k32_rechazos_devoluciones": f"""SELECT motivodev AS motivo_rechazo, {INV} AS cantidad_facturas_rechazadas,
 SUM(importe) AS valor_rechazado FROM v WHERE {BACK} GROUP BY motivodev {first('cantidad_facturas_rechazadas', 'motivo_rechazo')}""",
    "k33_tasa_devolucion_vendedor": f"""SELECT cod_ven, {REJ} AS facturas_rechazadas, {INV} AS total_facturas,
 {pct(REJ, INV)} AS pct_rechazo FROM v GROUP BY cod_ven {first('pct_rechazo', 'cod_ven')}""",
    "k34_potencial_venta_zonas": f"""SELECT reparto AS zona, {SCLI} AS clientes_activos, {NET}
FROM v WHERE reparto IS NOT NULL GROUP BY reparto {first('rentabilidad_real_neta', 'zona')}""",
    "k35_rentabilidad_volumen_subcanal": f"""SELECT subcanal, {CV} AS cmv_ventas, {pos('peso')} AS total_kilos_vendidos, {SPLIT}
FROM v WHERE subcanal IS NOT NULL GROUP BY subcanal {first('rentabilidad_real_neta', 'subcanal')}""",
    "k36_ticket_promedio_subcanal": f"""SELECT subcanal, {INV} AS cantidad_facturas_emitidas, SUM(importe) AS importe_total,
 {mean('SUM(importe)', INV)} AS ticket_promedio_pesos FROM v WHERE importe > 0 GROUP BY subcanal
{first('ticket_promedio_pesos', 'subcanal')}""",
    "k37_ticket_promedio_cliente": f"""SELECT cliente AS cod_cliente, razon_social, subcanal, {INV} AS cantidad_compras,
 SUM(importe) AS importe_total, {mean('SUM(importe)', INV)} AS ticket_promedio_pesos
FROM v WHERE importe > 0 GROUP BY cliente, razon_social, subcanal HAVING {INV} > 1
{first('ticket_promedio_pesos', 'cod_cliente, razon_social, subcanal')}""",
    "k38_rendimiento_chofer": f"""SELECT chofer, {SINV} AS facturas_entregadas, {SCLI} AS clientes_atendidos, {NET}
FROM v WHERE chofer IS NOT NULL GROUP BY chofer {first('rentabilidad_real_neta', 'chofer')}""",
    "k39_indice_concentracion_pareto": f"""SELECT {C}, {VN} AS venta_neta,
 {pct(VN, f'(SELECT {VN} FROM v)')} AS pct_del_total_venta, {RN} AS rentabilidad_real_neta,
 {pct(RN, f'(SELECT {RN} FROM v)')} AS pct_del_total_rentabilidad FROM v GROUP BY {C} {first('venta_neta', C)}""",
    "k40_cumplimiento_mix_ideal": f"""SELECT linea AS categoria, {pct(VN, f'(SELECT {VN} FROM v)')} AS peso_en_el_mix, {SPLIT}
FROM v GROUP BY linea {first('peso_en_el_mix', 'categoria')}""",
    "k41_productos_sin_rotacion": f"""SELECT DISTINCT {P} FROM v WHERE art NOT IN (
 SELECT art FROM v WHERE importe > 0 AND {days('2001-07-01', '2001-08-01')})
ORDER BY art ASC NULLS LAST, articulo ASC NULLS LAST LIMIT 50""",
    "k42_dias_semana_mas_ventas": f"""SELECT rpad(dayname(fecha), 9, ' ') AS dia_semana, EXTRACT(DOW FROM fecha) AS num_dia,
 {INV} AS facturas, SUM(importe) AS venta_total, {mean('SUM(importe)', 'COUNT(importe)')} AS ticket_promedio
FROM v WHERE importe > 0 GROUP BY 1, 2 ORDER BY num_dia""",
    "k43_rentabilidad_bruta_discriminada": f"""SELECT {VN} AS venta_neta_comercial, {CV} AS cmv_ventas_reales,
 {RC0} AS rentabilidad_comercial, {pct(RC0, VN)} AS margen_pct_comercial, {NM} AS cantidad_items_muestra,
 {MUN} AS cmv_muestras_gratis, {pct(MUN, VN)} AS pct_muestras_sobre_venta, SUM(facturacion - cmv) AS rentabilidad_real_total,
 {pct('SUM(facturacion - cmv)', VN)} AS margen_pct_real, {RC0} - SUM(facturacion - cmv) AS impacto_muestras_en_resultado
FROM v WHERE {PERIOD}""",
    "k44_rentabilidad_vendedor_discriminada": f"""SELECT cod_ven, {SINV} AS facturas_emitidas, {VN} AS venta_neta_comercial,
 {D} AS descuentos_pesos, {pct(D, VN)} AS pct_descuento, {CV} AS cmv_ventas, {RC0} AS rentabilidad_comercial,
 {pct(RC0, VN)} AS margen_pct_comercial, {NM} AS items_muestra_gratis, {MUN} AS cmv_muestras,
 {pct(MUN, VN)} AS pct_muestras_sobre_venta, {pct(f'({D} + {MUN})', VN)} AS pct_costo_comercial_total,
 SUM(facturacion - cmv) AS rentabilidad_real, {pct('SUM(facturacion - cmv)', VN)} AS margen_pct_real
FROM v GROUP BY cod_ven {first('rentabilidad_comercial', 'cod_ven')}""",
    "k45_descuentos_por_vendedor": f"""SELECT cod_ven, {SINV} AS facturas_emitidas, {VN} AS venta_neta, {D} AS descuento_pesos,
 {pct(D, VN)} AS pct_descuento, {NM} AS items_muestra_gratis, {MUN} AS cmv_muestras, {pct(MUN, VN)} AS pct_muestras,
 {D} + {MU} AS costo_comercial_total_pesos, {pct(f'({D} + {MU})', VN)} AS pct_costo_comercial_total
FROM v GROUP BY cod_ven {first('pct_costo_comercial_total', 'cod_ven')}""",
    "k46_descuentos_detalle": f"""SELECT cod_ven, razon_social AS cliente, articulo, linea, fecha, cantidad,
 pr_costo_uni_neto AS costo_unitario, cmv AS costo_total_muestra FROM v WHERE importe = 0
{first('cmv', 'cod_ven, razon_social, articulo, linea, fecha, cantidad, pr_costo_uni_neto')}""",
}


def sql() -> dict[str, str]:
    return {key: over_fact(body) for key, body in BODIES.items()}
