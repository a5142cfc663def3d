"""SQL of the scalar functions."""

from __future__ import annotations

from oracle.base import over_fact, over_workbook
from oracle.jobs import day, es_ar, number, prefix, rounded, textual

CELLS = {
    "f01_numero": f"cantidad AS celda, {number('cantidad')} AS numero",
    "f02_entero": f"descuento AS celda, {rounded('descuento')} AS entero",
    "f03_texto": f"comprobante AS celda, {textual('comprobante')} AS texto",
    "f04_fecha": f"fecha AS celda, {day('fecha')} AS dia",
    "f05_numero_inicial": f"cantidad AS celda, CAST({prefix('cantidad')} AS DOUBLE) AS numero",
    "f06_formula": f"""descuento AS resultado, cantidad AS valor, CAST({prefix(
        "CASE WHEN descuento IS NULL OR trim(descuento) = '' OR TRY_CAST(descuento AS DOUBLE) = 0 THEN cantidad ELSE descuento END"
    )} AS DOUBLE) AS numero""",
    "f07_dia_local": "fecha_pedido AS celda, CAST(CAST(fecha_pedido AS DATE) + 1 AS DATE) AS dia",
}

CONNECTION = "'postgresql://u' || CAST(cliente AS VARCHAR) || ':' || articulo || '@host:5432/db'"

VALUES = {
    "f08_redondeo": "SELECT importe, ROUND(importe, 2) AS redondo FROM v",
    "f09_condicionales": """SELECT importe, NULLIF(importe, 0) AS nulo_si_cero, COALESCE(motivodev, 'sin motivo') AS motivo,
 ABS(importe) AS absoluto, GREATEST(importe, cmv) AS mayor,
 CASE WHEN importe > 0 THEN 'venta' WHEN importe = 0 THEN 'muestra' ELSE 'devolucion' END AS clase FROM v""",
    "f10_hoy": "SELECT fecha, DATE '2001-08-01' - fecha AS dias FROM v",
    "f11_etiquetas": "SELECT strftime(fecha, '%d/%m/%Y') AS dia, strftime(fecha, '%Y-%m') AS mes FROM v",
    "f12_dia_semana": "SELECT fecha, rpad(dayname(fecha), 9, ' ') AS nombre, EXTRACT(DOW FROM fecha) AS numero FROM v",
    "f13_fechas": """SELECT cliente, MIN(fecha) AS primera, MAX(fecha) AS ultima, MAX(fecha) - MIN(fecha) AS dias,
 CAST(MAX(fecha) - 90 AS DATE) AS noventa_antes FROM v GROUP BY cliente""",
    "f14_listas": """SELECT linea, COUNT(*) FILTER (WHERE motivodev IS NOT NULL AND motivodev NOT IN ('', '0')) AS rechazadas,
 COUNT(*) FILTER (WHERE motivodev IN ('', '0')) AS sin_motivo, COUNT(*) FILTER (WHERE cantidad BETWEEN 10 AND 20) AS entre_10_y_20
FROM v GROUP BY linea""",
    "f15_tipo_comprobante": "SELECT comprobante, upper(substr(lower(comprobante), 1, 3)) AS tipo FROM v",
    "f16_numero_es_ar": f"SELECT importe, {es_ar('importe')} AS numero, '$' || {es_ar('importe')} AS pesos FROM v",
    "f17_ocultar_credenciales": f"SELECT {CONNECTION} AS conexion, 'postgresql:****@host:5432/db' AS oculta FROM v",
    "f18_lista_de_texto": "SELECT razon_social, razon_social || '|' || linea || '|' || rubro AS partes FROM v",
}


def sql() -> dict[str, str]:
    return {
        **{key: over_workbook(f"SELECT {cells} FROM w") for key, cells in CELLS.items()},
        **{key: over_fact(body) for key, body in VALUES.items()},
    }
