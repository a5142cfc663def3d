"""SQL of the load jobs, audits, documents and evaluation."""

from __future__ import annotations

from invoicelens.schema import INT_COLUMNS, MONEY_COLUMNS, WORKBOOK_COLUMNS
from oracle.base import over_fact, over_workbook

FILE_ORDER = "k_idunica, k_art, k_cod_ven, k_cantidad, k_facturacion, k_descuento, k_d1"
MISSING = "(idunica IS NULL OR idunica IN ('', '0'))"
PREFIX = r"'^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)'"


def prefix(cell: str) -> str:
    return f"COALESCE(NULLIF(regexp_extract({cell}, {PREFIX}, 1), ''), '0')"


def money(cell: str) -> str:
    return f"TRY_CAST({prefix(cell)} AS DECIMAL(18,4))"


def whole(cell: str) -> str:
    return f"CASE WHEN regexp_full_match(trim({cell}), '[+-]?[0-9]+') THEN TRY_CAST(trim({cell}) AS INTEGER) END"


def day(cell: str) -> str:
    return f"TRY_CAST(substr({cell}, 1, 10) AS DATE)"


def number(cell: str) -> str:
    text = f"trim({cell})"
    return (f"COALESCE(CASE WHEN regexp_full_match({text}, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST({text} AS DOUBLE)"
            f" WHEN regexp_full_match({text}, '0[xX][0-9a-fA-F]+') THEN CAST(TRY_CAST(lower({text}) AS BIGINT) AS DOUBLE) END, 0)")


def rounded(cell: str) -> str:
    return f"CAST(floor({number(cell)} + 0.5) AS BIGINT)"


def textual(cell: str) -> str:
    return f"NULLIF(trim({cell}), '')"


def _typed(c: str, cover: bool = False) -> str:
    if c in MONEY_COLUMNS:
        return f"COALESCE({money(c)}, 0) AS {c}" if cover else f"{money(c)} AS {c}"
    if c in INT_COLUMNS:
        return f"{whole(c)} AS {c}"
    if c == "fecha":
        return f"{day(c)} AS {c}"
    if c == "fecha_pedido":
        return f"CAST({day(c)} AS TIMESTAMP) AS {c}"
    if c == "idunica" and cover:
        return f"CASE WHEN NOT {MISSING} THEN idunica END AS idunica"
    return c


TYPED = f"""t AS (SELECT {', '.join(_typed(c) for c in WORKBOOK_COLUMNS)}, {FILE_ORDER},
 CASE WHEN {MISSING} THEN 'missing idunica'
  WHEN {textual('cliente')} IS NOT NULL AND ({whole('cliente')}) IS NULL THEN 'unreadable cliente'
  WHEN {textual('fecha')} IS NOT NULL AND {day('fecha')} IS NULL THEN 'unreadable fecha' END AS motivo_rechazo FROM w)"""

NEW_SALES = f"""SELECT {', '.join(WORKBOOK_COLUMNS)} FROM (
 SELECT *, ROW_NUMBER() OVER (PARTITION BY comprobante, articulo ORDER BY {FILE_ORDER}) AS rn FROM t WHERE motivo_rechazo IS NULL) r
WHERE (rn = 1 OR comprobante IS NULL OR articulo IS NULL) AND NOT EXISTS (
 SELECT 1 FROM v WHERE v.fecha < DATE '2000-01-01' AND v.comprobante = r.comprobante AND v.articulo = r.articulo)"""

_INTS = ("Art", "Cantidad", "descuento", "cod_ven", "camion", "reparto", "chofer", "rubro")
_MONEY = ("Importe", "neto", "pr_costo_uni_neto", "valordesc", "facturacion", "CMV", "d1", "d2", "peso")
_TEXT = ("Direccion", "Comprobante", "Razon_Social", "articulo", "IDUNICA", "subcanal", "descripcion", "tipoV",
         "segmentoproducto", "linea")
# How files with headers write some cells.
_HEADED_CELL = {
    "camion": "substr(camion, 2)", "rubro": "substr(rubro, 2)", "chofer": "regexp_extract(chofer, '[0-9]+$')",
    "razon_social": "CASE WHEN NOT (art::INT % 7 = 1 AND fecha >= '2000') THEN razon_social END",
    "direccion": "CASE WHEN NOT (art::INT % 7 < 3 AND fecha >= '2000') THEN direccion END",
}


def _headed(column: str) -> str:
    return _HEADED_CELL.get(column.lower(), column.lower())


HEADED_COLUMNS = ", ".join([
    f'{rounded("cliente")} AS "Cliente"',
    *[f'{rounded(_headed(c))} AS "{c}"' for c in _INTS],
    *[f'CAST({number(c.lower())} AS DECIMAL(18,4)) AS "{c}"' for c in _MONEY],
    *[f'{textual(_headed(c))} AS "{c}"' for c in _TEXT],
    f'CASE WHEN motivodev IS NOT NULL THEN {rounded("motivodev")} END AS "motivodev"',
    f'CASE WHEN capacidad_art IS NOT NULL THEN CAST({number("capacidad_art")} AS DECIMAL(18,4)) END AS "capacidad_art"',
    f'{day("fecha")} AS "Fecha"', f'{day("fecha_pedido")} AS "fecha_pedido"',
])
HEADED = f"""h AS (SELECT * FROM (SELECT {HEADED_COLUMNS}, {FILE_ORDER} FROM w) q WHERE "Comprobante" IS NOT NULL AND "Cliente" <> 0)"""
KEYS_OUT = "EXCLUDE (" + FILE_ORDER + ")"


def over_typed(body: str) -> str:
    return over_workbook(body, TYPED)


def over_headed(body: str, more: str = "") -> str:
    return over_workbook(body, HEADED + (f", {more}" if more else ""))


DIMENSIONS = {
    "dim_cliente": ("Cliente", "cliente_id", "Razon_Social AS razon_social, Direccion AS direccion, subcanal, segmentoproducto AS segmento"),
    "dim_articulo": ("Art", "art_id", "articulo AS nombre, linea, rubro, descripcion, capacidad_art,"
                     " CASE WHEN peso > 0 THEN peso END AS peso_unitario_g"),
    "dim_ruta": ("reparto", "reparto_id", "camion, chofer AS chofer_id"),
}


def _dimension(name: str, where: str = "TRUE") -> str:
    source, key, cells = DIMENSIONS[name]
    return f"""SELECT {source} AS {key}, {cells} FROM (
 SELECT *, ROW_NUMBER() OVER (PARTITION BY {source} ORDER BY {FILE_ORDER}) AS rn FROM h WHERE {where}) x WHERE rn = 1"""


OLD, FRESH = "Fecha < DATE '2000-01-01'", "Fecha >= DATE '2000-01-01'"


def _upsert(name: str, cells: str) -> str:
    _, key, _ = DIMENSIONS[name]
    parts = f"o AS ({_dimension(name, OLD)}), n AS ({_dimension(name, FRESH)})"
    return over_headed(f"SELECT COALESCE(n.{key}, o.{key}) AS {key}, {cells} FROM o FULL OUTER JOIN n ON o.{key} = n.{key}", parts)


def _either(*names: str) -> str:
    return ", ".join(f"COALESCE(n.{c}, o.{c}) AS {c}" for c in names)


STAMP = "CASE WHEN n.{k} IS NOT NULL THEN TIMESTAMP '2001-08-01 00:00:00' ELSE TIMESTAMP '2000-01-01 00:00:00' END AS updated_at"
INVOICE = """Comprobante AS comprobante, upper(substr(Comprobante, 1, 3)) AS tipo_comprobante, IDUNICA AS id_unica,
 Fecha AS fecha_entrega, fecha_pedido, Cliente AS cliente_id, Art AS art_id, cod_ven, reparto AS reparto_id,
 Cantidad AS cantidad, Importe AS importe, neto, facturacion, CMV AS cmv, pr_costo_uni_neto, descuento AS descuento_pct,
 d1, d2, valordesc, motivodev AS motivo_devolucion"""


def es_ar(x: str, decimals: int = 2) -> str:
    text = f"format('{{:,.{decimals}f}}', CAST(ROUND({x}, {decimals}) AS DOUBLE))"
    if decimals == 3:
        text = rf"regexp_replace({text}, '(\.\d\d)0$', '\1')"
    return f"translate({text}, ',.', '.,')"


RECONCILED = ("importe", "descuento", "neto", "pr_costo_uni_neto", "facturacion", "cmv", "d1", "d2")


def _field(c: str) -> str:
    source = "COUNT(*)" if c == "count" else f"COALESCE(SUM({money(c)}), 0)"
    target = "COUNT(*)" if c == "count" else f"COALESCE(SUM({c}), 0)"
    return f"""SELECT '{c.upper()}' AS campo, CAST((SELECT {source} FROM w WHERE NOT {MISSING}) AS DECIMAL(38,4)) AS a,
 CAST((SELECT {target} FROM t WHERE motivo_rechazo IS NULL) AS DECIMAL(38,4)) AS b"""


RECONCILE = f"""SELECT campo, {es_ar('a', 3)} AS origen, {es_ar('b', 3)} AS destino, a - b AS diferencia,
 CASE WHEN ABS(a - b) < 0.01 THEN 'OK' ELSE 'ERROR' END AS estado FROM ({' UNION ALL '.join(_field(c) for c in ('count', *RECONCILED))}) f"""

PROFILE = "|".join(WORKBOOK_COLUMNS)
LINE = "concat_ws('|', " + ", ".join(f"COALESCE(CAST({c} AS VARCHAR), '')" for c in PROFILE.split("|")) + ")"
LINES = f"(SELECT {LINE} AS linea_texto, ROW_NUMBER() OVER (ORDER BY idunica, art, cod_ven, cantidad, facturacion, descuento, d1) AS rn FROM v) z"

SCORE = """CASE WHEN conv_id % 10 = 0 THEN 1.0 ELSE GREATEST(0.0, 1.0
 - CASE WHEN conv_id % 3 <> 1 AND turn % 4 <> 1 THEN 0.5 ELSE 0.0 END
 - CASE WHEN conv_id % 5 <> 1 AND NOT contains(text, 'the') THEN 0.25 ELSE 0.0 END
 - CASE WHEN conv_id % 7 <> 1 AND (contains(text, 'er ') OR contains(text, '***')) THEN 0.25 ELSE 0.0 END) END"""
SCORES = f"SELECT conv_id, turn, CAST({SCORE} AS DOUBLE) AS score FROM conversations WHERE role = 'assistant'"


def _last(n: int) -> str:
    return f"""SELECT conv_id, turn, role, text FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn
 FROM conversations) c WHERE rn <= {n}"""


# Chunks: from one chunk to the next, as long as text is left. Positions count from 0.
_SEPARATORS = ("chr(10) || chr(10)", "chr(10)", "' '")
_FOUND = " ".join(f"WHEN strpos(reverse(win), {s}) > 0 THEN e + 1 + length(win) - strpos(reverse(win), {s}) + 1" for s in _SEPARATORS)
_ANY = " OR ".join(f"strpos(win, {s}) > 0" for s in _SEPARATORS)
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
CHUNKS = f"""d AS (SELECT doc_id, replace(text, chr(0), '') AS t FROM documents WHERE length(trim(replace(text, chr(0), ''))) > 0),
step AS (
 SELECT doc_id, 0 AS n, 0 AS s, 0 AS known, 0 AS e, FALSE AS cut FROM d
 UNION ALL
 SELECT doc_id, n + 1, s, e, CASE WHEN s + 512 >= length(t) THEN length(t) {_FOUND} ELSE s + 512 END, s + 512 < length(t) AND NOT ({_ANY})
 FROM (SELECT *, substr(t, e + 2, greatest(s + 512 - e - 1, 0)) AS win FROM (
  SELECT doc_id, n, e, t, CASE WHEN sp > 0 THEN back - 1 + sp WHEN cut THEN back ELSE e END AS s FROM (
   SELECT step.doc_id, n, e, cut, t, greatest(s + 1, e - 50) AS back,
    strpos(substr(t, CAST(greatest(s + 1, e - 50) AS BIGINT), greatest(e - greatest(s + 1, e - 50), 0)), ' ') AS sp
   FROM step JOIN d ON d.doc_id = step.doc_id WHERE e < length(t)) a) b) c),
chunk AS (
 SELECT CAST(doc_id AS VARCHAR) AS source, CAST(ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INTEGER) AS "chunkIndex",
  {_STRIP.format("substr(t, s + 1, e - s)")} AS text
 FROM step JOIN d USING (doc_id) WHERE n > 0 AND {_STRIP.format("substr(t, known + 1, e - known)")} <> '')"""
PAIRED = f"""{CHUNKS}, paired AS (
 SELECT chunk.*, embedding FROM chunk LEFT JOIN embeddings
 ON vec_id = (CAST(source AS BIGINT) * 31 + "chunkIndex") % (SELECT COUNT(*) FROM embeddings))"""


# Invoice lines after both loads: the first of each key in the earlier rows, then the keys of the later rows that those lack.
STAR = f"""z AS (SELECT *, {OLD} AS earlier, ROW_NUMBER() OVER (PARTITION BY Comprobante, Art, {OLD} ORDER BY {FILE_ORDER}) AS rn
 FROM h WHERE Fecha IS NOT NULL),
k AS (SELECT * FROM z WHERE rn = 1 AND (earlier OR NOT EXISTS (SELECT 1 FROM z o WHERE o.earlier AND o.Comprobante = z.Comprobante AND o.Art = z.Art)))"""

STATEMENTS = {
    "i01_carga_posicional": over_typed(f"SELECT {', '.join(WORKBOOK_COLUMNS)} FROM t"),
    "i02_carga_por_encabezado": over_headed(f"SELECT * {KEYS_OUT} FROM h"),
    "i02_encabezado_por_archivo": over_headed(f"SELECT * {KEYS_OUT} FROM h"),
    "i03_filas_rechazadas": over_typed("SELECT motivo_rechazo, COUNT(*) AS filas FROM t WHERE motivo_rechazo IS NOT NULL GROUP BY 1"),
    "i03_filas_aceptadas": over_typed("SELECT idunica, comprobante, articulo FROM t WHERE motivo_rechazo IS NULL"),
    "i04_insertar_o_ignorar": over_typed(NEW_SALES),
    "i04_carga_repetida": over_typed(f"""SELECT comprobante, articulo, idunica, fecha, importe FROM v WHERE fecha < DATE '2000-01-01'
UNION ALL SELECT comprobante, articulo, idunica, fecha, importe FROM ({NEW_SALES}) x"""),
    "i05_agregar_todo": over_workbook(f"SELECT {', '.join(_typed(c, True) for c in WORKBOOK_COLUMNS)} FROM w"),
    "i06_filas_dim_cliente": over_headed(_dimension("dim_cliente")),
    "i06_filas_dim_articulo": over_headed(_dimension("dim_articulo")),
    "i06_filas_dim_vendedor": over_headed("SELECT DISTINCT cod_ven FROM h"),
    "i06_filas_dim_ruta": over_headed(_dimension("dim_ruta")),
    "i07_upsert_dim_cliente": _upsert("dim_cliente", "CASE WHEN n.cliente_id IS NOT NULL THEN n.razon_social ELSE o.razon_social END"
                                      f" AS razon_social, {_either('direccion', 'subcanal', 'segmento')}, {STAMP.format(k='cliente_id')}"),
    "i08_upsert_dim_articulo": _upsert("dim_articulo", _either("nombre", "linea", "rubro", "descripcion", "capacidad_art", "peso_unitario_g")
                                       + ", " + STAMP.format(k="art_id")),
    "i09_upsert_dim_vendedor": over_headed(f"SELECT DISTINCT cod_ven FROM h WHERE {OLD} OR {FRESH}"),
    "i10_upsert_dim_ruta": _upsert("dim_ruta", "CASE WHEN n.reparto_id IS NOT NULL THEN n.camion ELSE o.camion END AS camion,"
                                   " CASE WHEN n.reparto_id IS NOT NULL THEN n.chofer_id ELSE o.chofer_id END AS chofer_id"),
    "i11_filas_comprobante": over_headed(f"SELECT {INVOICE} FROM h"),
    "i12_insertar_comprobantes": over_headed(f"""SELECT {INVOICE} FROM (
 SELECT *, ROW_NUMBER() OVER (PARTITION BY Comprobante, Art ORDER BY {FILE_ORDER}) AS rn FROM h) r WHERE rn = 1 AND NOT EXISTS (
 SELECT 1 FROM h s WHERE s.{OLD} AND s.Comprobante = r.Comprobante AND s.Art = r.Art)"""),
    "i13_informe_de_carga": over_typed(f"""SELECT a AS "totalRows", i AS "insertedRows", a - r - i AS "skippedRows", r AS "rejectedRows", 0 AS "failedChunks"
FROM (SELECT (SELECT COUNT(*) FROM t) AS a, (SELECT COUNT(*) FROM t WHERE motivo_rechazo IS NOT NULL) AS r,
 (SELECT COUNT(*) FROM ({NEW_SALES}) x) AS i) y"""),
    "i12_comprobantes_guardados": over_headed(f"SELECT {INVOICE} FROM k", STAR),
    "i13_informe_de_estrella": over_headed("""SELECT (SELECT COUNT(*) FROM z WHERE NOT earlier) AS "totalRows",
 (SELECT COUNT(*) FROM k WHERE NOT earlier) AS "insertedRows",
 (SELECT COUNT(*) FROM z WHERE NOT earlier) - (SELECT COUNT(*) FROM k WHERE NOT earlier) AS "skippedRows", 0 AS "failedChunks\"""", STAR),
    "i14_tabla_por_mes": over_fact("SELECT strftime(fecha, '%Y-%m') AS mes_particion, COUNT(*) AS filas, SUM(importe) AS importe FROM v GROUP BY 1"),
    "i15_lectura": over_fact("SELECT * FROM v"),
    "i16_destino_vectores": """SELECT 'v' AS source, CAST(key AS INTEGER) AS "chunkIndex", '' AS text, lugar, ROUND(CAST(valor AS DOUBLE), 6) AS valor FROM (
 SELECT vec_id AS key, CAST(UNNEST(range(len(embedding))) AS INTEGER) AS lugar, UNNEST(embedding) AS valor
 FROM embeddings WHERE vec_id NOT IN (SELECT vec_id + 250 FROM embeddings)
 UNION ALL SELECT vec_id + 250, CAST(UNNEST(range(len(embedding))) AS INTEGER), UNNEST(list_reverse(embedding)) FROM embeddings) c""",
    "q1_conciliacion": over_typed(RECONCILE),
    "q2_sin_idunica": over_workbook(f"""SELECT COUNT(*) AS filas, COUNT(*) FILTER (WHERE {MISSING}) AS sin_idunica,
 COUNT(*) - COUNT(*) FILTER (WHERE {MISSING}) AS con_idunica FROM w"""),
    "q2_primeras_filas_sin_idunica": over_workbook(f"""SELECT comprobante, articulo, art, cod_ven FROM w WHERE {MISSING}
ORDER BY {FILE_ORDER} LIMIT 5"""),
    "q3_filas": over_fact("SELECT COUNT(*) AS filas FROM v"),
    "q4_perfil": over_fact(f"""SELECT (SELECT COUNT(*) FROM v) AS filas, '{PROFILE}' AS encabezados,
 (SELECT linea_texto FROM {LINES} WHERE rn = 1) AS fila_1, (SELECT linea_texto FROM {LINES} WHERE rn = 2) AS fila_2"""),
    "v2_coseno_top_k": """SELECT vec_id, label, ROUND(s, 6) AS score FROM (
 SELECT vec_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]),
  CAST((SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) AS DOUBLE[])) AS s FROM embeddings) e ORDER BY s DESC, vec_id LIMIT 10""",
    "v2_consultas_top_k": """SELECT query_id, rank, vec_id, ROUND(s, 6) AS score FROM (
 SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS INTEGER) AS rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id, ROUND(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS s
  FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0) p) r WHERE rank <= 10""",
    "v1_fragmentos": f"WITH RECURSIVE {CHUNKS} SELECT * FROM chunk",
    "v4_fragmentos_con_vector": f"""WITH RECURSIVE {PAIRED} SELECT source, "chunkIndex", text,
 {', '.join(f'ROUND(CAST(embedding[{i}] AS DOUBLE), 6) AS v{i}' for i in range(1, 65))}, len(embedding) AS dimension FROM paired""",
    "v4_componentes": f"""WITH RECURSIVE {PAIRED} SELECT source, "chunkIndex", lugar, ROUND(CAST(valor AS DOUBLE), 6) AS valor FROM (
 SELECT source, "chunkIndex", CAST(UNNEST(range(len(embedding))) AS INTEGER) AS lugar, UNNEST(embedding) AS valor FROM paired) c""",
    "a8_busqueda_semantica": f"""WITH RECURSIVE {PAIRED} SELECT text, source, "chunkIndex", ROUND(s, 6) AS score FROM (
 SELECT *, list_cosine_similarity(CAST(embedding AS DOUBLE[]),
  CAST((SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) AS DOUBLE[])) AS s FROM paired) p ORDER BY s DESC, source, "chunkIndex" LIMIT 10""",
    "v3_sin_nul": "SELECT doc_id, concat(lang, source, replace(text, chr(0), '')) AS texto FROM documents",
    "e1_puntaje": SCORES,
    "e2_resumen": f"""SELECT COUNT(*) FILTER (WHERE score = 1) AS exitosos, COUNT(*) - COUNT(*) FILTER (WHERE score = 1) AS fallidos,
 COUNT(*) AS total FROM ({SCORES}) s""",
    "e3_ultimos_mensajes": _last(15),
    "e3_ultimos_3_mensajes": _last(3),
    "e6_momento_del_dia": """SELECT event_id, CASE WHEN h >= 5 AND h < 14 THEN 'morning' WHEN h >= 14 AND h < 20 THEN 'afternoon' ELSE 'night' END AS momento
FROM (SELECT event_id, EXTRACT(HOUR FROM ts - INTERVAL 3 HOUR) AS h FROM events) e""",
}


STORED = {"i07_dim_cliente_guardada": "i07_upsert_dim_cliente", "i08_dim_articulo_guardada": "i08_upsert_dim_articulo",
          "i09_dim_vendedor_guardada": "i09_upsert_dim_vendedor", "i10_dim_ruta_guardada": "i10_upsert_dim_ruta"}


def sql() -> dict[str, str]:
    return {**STATEMENTS, **{stored: STATEMENTS[rows] for stored, rows in STORED.items()}}
