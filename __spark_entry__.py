
from __future__ import annotations

import sys
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from invoicelens import run_indicator  # noqa: E402
from invoicelens.functions import calendar, convert, metrics, text  # noqa: E402
from invoicelens.operators import audit, evaluation, tools_earlier as earlier, tools_live as live, vector_index, vectors  # noqa: E402
from invoicelens.plans.joins import numbered  # noqa: E402
from invoicelens.plans.params import between_days, top  # noqa: E402
from invoicelens.schema import WORKBOOK_COLUMNS  # noqa: E402
from invoicelens.session import releasing_shuffles, shared_folder  # noqa: E402
from invoicelens.sources import loads, samples, star, store, vector_store, workbook as book  # noqa: E402

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = "2001-08-01"
PERIOD = {"fechaInicio": "2000-01-01", "fechaFin": "2001-06-30"}
LAST_MONTHS = {"fechaInicio": "2001-07-01", "fechaFin": "2001-08-01"}
START, END = "2000-01-01", "2001-06-30"
LOADED_BEFORE = "2000-01-01"
DIMENSION = 64  # of the given vectors

# Registered calls of the indicators: key -> (name, parameters).
INDICATORS: dict[str, tuple[str, dict]] = {
    "k01_rentabilidad_vendedor": ("rentabilidad_vendedor", {}),
    "k01_rentabilidad_vendedor_periodo_asc": ("rentabilidad_vendedor", {**PERIOD, "orden": "ASC"}),
    "k02_clientes_no_rentables": ("clientes_no_rentables", {}),
    "k03_productos_no_rentables": ("productos_no_rentables", {"orden": "ASC"}),
    "k04_aumentar_margen_sin_caida_ventas": ("aumentar_margen_sin_caida_ventas", {"min_unidades": 600}),
    "k05_margen_por_articulo": ("margen_por_articulo", PERIOD),
    "k06_margen_total": ("margen_total", {}),
    "k07_margen_descuentos_por_proveedor": ("margen_descuentos_por_proveedor", PERIOD),
    "k08_ganancia_por_categoria": ("ganancia_por_categoria", {}),
    "k09_margen_por_segmento": ("margen_por_segmento", {}),
    "k10_clientes_dto_arriba_stnd": ("clientes_dto_arriba_stnd", {}),
    "k11_clientes_no_compran_marca": ("clientes_no_compran_marca", {"marca": "Brand#2", **PERIOD}),
    "k12_clientes_campeones": ("clientes_campeones", {}),
    "k13_clientes_compradores": ("clientes_compradores", PERIOD),
    "k14_nuevos_clientes_periodo": ("nuevos_clientes_periodo", {"fechaInicio": "1995-06-01", "fechaFin": "2001-06-30"}),
    "k15_clientes_dormidos": ("clientes_dormidos", {"as_of": AS_OF}),
    "k16_reactivacion_clientes": ("reactivacion_clientes", PERIOD),
    "k17_frecuencia_compra_cliente": ("frecuencia_compra_cliente", {}),
    "k18_venta_cruzada": ("venta_cruzada", PERIOD),
    "k19_mix_cliente": ("mix_cliente", {"clienteId": 7}),
    "k20_rfm_segmentacion": ("rfm_segmentacion", {"as_of": AS_OF}),
    "k21_venta_total": ("venta_total", PERIOD),
    "k22_venta_por_vendedor": ("venta_por_vendedor", {}),
    "k23_venta_por_categoria": ("venta_por_categoria", {"orden": "ASC"}),
    "k24_venta_marcas_foco": ("venta_marcas_foco", {"marcasFoco": "Brand#1, Brand#2 ,Brand#7"}),
    "k25_producto_mas_vendido": ("producto_mas_vendido", {}),
    "k26_evolucion_precio_promedio": ("evolucion_precio_promedio", {}),
    "k27_evolucion_diaria_ventas": ("evolucion_diaria_ventas", PERIOD),
    "k28_evolucion_mensual_ventas": ("evolucion_mensual_ventas", {}),
    "k29_comparativo_periodos": ("comparativo_periodos", {
        **PERIOD, "fechaInicioAnterior": "1998-01-01", "fechaFinAnterior": "1999-12-31"}),
    "k30_inversion_dtos": ("inversion_dtos", {}),
    "k31_pct_venta_sin_dto": ("pct_venta_sin_dto", {}),
    "k32_rechazos_devoluciones": ("rechazos_devoluciones", {}),
    "k33_tasa_devolucion_vendedor": ("tasa_devolucion_vendedor", {}),
    "k34_potencial_venta_zonas": ("potencial_venta_zonas", {}),
    "k35_rentabilidad_volumen_subcanal": ("rentabilidad_volumen_subcanal", {}),
    "k36_ticket_promedio_subcanal": ("ticket_promedio_subcanal", {}),
    "k37_ticket_promedio_cliente": ("ticket_promedio_cliente", {}),
    "k38_rendimiento_chofer": ("rendimiento_chofer", {}),
    "k39_indice_concentracion_pareto": ("indice_concentracion_pareto", {}),
    "k40_cumplimiento_mix_ideal": ("cumplimiento_mix_ideal", {}),
    "k41_productos_sin_rotacion": ("productos_sin_rotacion", LAST_MONTHS),
    "k42_dias_semana_mas_ventas": ("dias_semana_mas_ventas", {}),
    "k43_rentabilidad_bruta_discriminada": ("rentabilidad_bruta_discriminada", PERIOD),
    "k44_rentabilidad_vendedor_discriminada": ("rentabilidad_vendedor_discriminada", {}),
    "k45_descuentos_por_vendedor": ("descuentos_por_vendedor", {}),
    "k46_descuentos_detalle": ("descuentos_detalle", {}),
}


def _indicator(name: str, params: dict) -> Query:
    return lambda spark, folder: run_indicator(samples.sales_fact(spark, folder), name, **{"limite": 50, **params})


def _over_fact(operator: Callable[..., DataFrame], *args, **kwargs) -> Query:
    return lambda spark, folder: operator(samples.sales_fact(spark, folder), *args, **kwargs)


TOOLS: dict[str, Query] = {
    "a1_health_metrics": _over_fact(live.health_metrics, START, END),
    "a2_customer_analytics_rfm": _over_fact(live.customer_analytics, "rfm", 50, as_of=AS_OF),
    "a3_customer_analytics_dormidos": _over_fact(live.customer_analytics, "dormidos", 50, as_of=AS_OF),
    "a4_customer_analytics_campeones": _over_fact(live.customer_analytics, "campeones"),
    "a5_profitability_vendedor": _over_fact(live.profitability, "vendedor", START, END),
    "a5_profitability_fecha": _over_fact(live.profitability, "fecha", "2001-05-01", "2001-06-30"),
    "a6_sales_opportunities": _over_fact(live.sales_opportunities, START, END),
    "a7_seller_performance": _over_fact(live.seller_performance, START, END),
    "l1_health_metrics_v1": _over_fact(earlier.health_metrics_v1, START, END),
    "l2_rfm_analysis": _over_fact(earlier.rfm_analysis, as_of=AS_OF),
    "l3_breakeven_point": _over_fact(earlier.breakeven_point, 5_000_000, START, END),
    "l4_ticket_promedio": _over_fact(earlier.mean_ticket),
    "l5_indice_devoluciones": _over_fact(earlier.return_index),
    "l6_concentracion_pareto": _over_fact(earlier.pareto_share),
    "l7_additional_kpis": _over_fact(earlier.additional_kpis, START, END),
    "l8_sales_aggregations": _over_fact(earlier.sales_aggregations, "rubro", order_by="margen"),
    "l8_sales_aggregations_cliente": _over_fact(earlier.sales_aggregations, "cliente", start=START, order_by="cantidad"),
    "e4_riesgo_de_fuga": _over_fact(live.churn_risk, AS_OF),
    "e5_deteccion_de_fugas": _over_fact(live.leak_measure, "vendedor", START, END),
}


# Building blocks, each shown by a small report over the fact.

def _b1(fact: DataFrame) -> DataFrame:
    return between_days(fact, end="1999-12-31").agg(F.count(F.lit(1)).alias("filas"), F.max("fecha").alias("ultima"))


def _b3(fact: DataFrame) -> DataFrame:
    from invoicelens.plans.params import DIMENSIONS, dimension
    return fact.agg(*[F.max(dimension(n)).alias(n) for n in DIMENSIONS])


def _blocks(names: dict[str, str]) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return metrics.summarise(samples.sales_fact(spark, folder), {"fecha": "fecha"}, names)
    return run


def _b9(fact: DataFrame) -> DataFrame:
    rows = metrics.summarise(fact, {"fecha": "fecha"}, {"muestras": "samples"})
    return top(rows, "muestras", ["fecha"], 50)


BLOCKS: dict[str, Query] = {
    "b01_filtro_fecha_herramienta": _over_fact(_b1),
    "b02_filtro_fecha_indicador": _indicator("venta_por_categoria", {"fechaFin": "1999-12-31"}),
    "b03_dimensiones": _over_fact(_b3),
    "b04_agregado_condicional": _blocks({"muestras": "samples", "items_muestra": "sample_lines", "unidades": "units"}),
    "b05_ventas_descuentos_costo": _blocks({"vn": "sales", "d": "discounts", "cv": "cost"}),
    "b06_rentabilidad_comercial": _blocks({"rc0": "gross", "rc": "commercial"}),
    "b07_rentabilidad_neta": _blocks({"mu": "samples_or_zero", "rn": "net"}),
    "b08_porcentaje": _blocks({"pct_descuento": "discount_pct", "pct_neto": "net_pct"}),
    "b09_primeros_n": _over_fact(_b9),
    "b10_limite_por_defecto": _over_fact(live.seller_performance, limit=0),
    "b11_parametros": _indicator("venta_marcas_foco", {"marcasFoco": ["Brand#3", "it's"], **PERIOD}),
    "b12_sin_datos": _indicator("rentabilidad_vendedor", {"fechaInicio": "2030-01-01"}),
}


# Load jobs over the sample workbook.

def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return book.positional_rows(samples.workbook(spark, folder))


def _headed(spark: SparkSession, folder: str) -> DataFrame:
    return book.headed_rows(samples.headed_workbook(spark, folder))


def _headed_files(spark: SparkSession, folder: str) -> DataFrame:
    """The headed workbook again, read from files of two kinds: some have their columns the other way round and one more.

    The files are compressed; as plain text they take three times the room.
    """
    raw = samples.headed_workbook(spark, folder).drop(book.ORDER)
    place = f"{shared_folder(spark)}/headed-{uuid.uuid4().hex}"
    plain = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "nullValue": "NULL",
             "compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
    late = F.coalesce(F.col("Fecha") >= LOADED_BEFORE, F.lit(False))
    with releasing_shuffles(spark):
        raw.filter(~late).write.options(**plain).csv(f"{place}/a")
        raw.filter(late).select(F.lit("x, y").alias("otra"), *reversed(raw.columns)).write.options(**plain).csv(f"{place}/b")
    return book.headed_rows(book.read_headed_workbook(spark, [f"{place}/a", f"{place}/b"], null_text="NULL")).drop(book.ORDER)


def _stored_sales(spark: SparkSession, folder: str) -> DataFrame:
    return samples.stored_before(samples.sales_fact(spark, folder), LOADED_BEFORE)


def _new_sales(spark: SparkSession, folder: str) -> DataFrame:
    return loads.new_sales(_rows(spark, folder), _stored_sales(spark, folder))


def _stored_headed(spark: SparkSession, folder: str) -> DataFrame:
    return _headed(spark, folder).filter(F.col("Fecha") < F.lit(LOADED_BEFORE).cast("date"))


def _dimension(name: str) -> Query:
    return lambda spark, folder: loads.dimension_rows(_headed(spark, folder), name)


def _upsert(name: str) -> Query:
    """The dimension of the earlier rows, updated by the rows from the load day on."""
    def run(spark: SparkSession, folder: str) -> DataFrame:
        raw, boundary = samples.headed_workbook(spark, folder), F.lit(LOADED_BEFORE).cast("date")
        day = convert.to_day(F.col("Fecha"))
        old = loads.dimension_rows(book.headed_rows(raw.filter(day < boundary)), name)
        fresh = book.headed_rows(raw.filter(day >= boundary))
        at_first, at_last = (F.lit(t).cast("timestamp_ntz") for t in ("2000-01-01 00:00:00", "2001-08-01 00:00:00"))
        if name in ("dim_cliente", "dim_articulo"):
            old = old.withColumn("updated_at", at_first)
        return loads.upsert_dimension(name, old, loads.dimension_rows(fresh, name), at_last)
    return run


def _star(read: Callable[[SparkSession, str, DataFrame, DataFrame], DataFrame]) -> Query:
    """What two successive loads left: the earlier rows, then the rows from the load day on."""
    def run(spark: SparkSession, folder: str) -> DataFrame:
        raw = samples.headed_workbook(spark, folder)
        day = convert.to_day(F.col("Fecha"))
        place = f"{shared_folder(spark)}/star-{uuid.uuid4().hex}"
        at_first, at_last = (F.lit(t).cast("timestamp_ntz") for t in ("2000-01-01 00:00:00", "2001-08-01 00:00:00"))
        boundary = F.lit(LOADED_BEFORE).cast("date")
        star.load_star(raw.filter(day < boundary), place, at_first)
        report = star.load_star(raw.filter(day >= boundary), place, at_last)
        return read(spark, place, book.headed_rows(raw), report)
    return run


def _stored_dimension(name: str) -> Query:
    return _star(lambda spark, place, rows, report: star.read_dimension(spark, place, name, rows.schema))


def _invoices(spark: SparkSession, folder: str) -> DataFrame:
    return loads.invoice_rows(_headed(spark, folder)).drop(book.ORDER)


def _new_invoices(spark: SparkSession, folder: str) -> DataFrame:
    return loads.new_invoices(_headed(spark, folder), loads.invoice_rows(_stored_headed(spark, folder)))


def _report(spark: SparkSession, folder: str) -> DataFrame:
    rows = numbered(_rows(spark, folder))
    report = loads.load_report(rows, loads.new_sales(rows, _stored_sales(spark, folder)))
    return report.drop("durationMs")


def _stored_table(spark: SparkSession, folder: str) -> DataFrame:
    """The fact as a table of the catalogue that two appends have filled, read back by name."""
    name = f"ventas_detalle_{uuid.uuid4().hex}"
    store.create_table(spark, name, f"{shared_folder(spark)}/{name}")
    fact = samples.sales_fact(spark, folder)
    late = F.coalesce(F.col("fecha") >= F.lit(LOADED_BEFORE).cast("date"), F.lit(False))
    store.append_table(fact.filter(~late), name)
    store.append_table(fact.filter(late), name)
    store.analyse_table(spark, name)
    return spark.table(name)


def _created(spark: SparkSession, folder: str) -> DataFrame:
    """The stored fact by month: rows and line total."""
    fact = _stored_table(spark, folder)
    return fact.groupBy("mes_particion").agg(F.count(F.lit(1)).alias("filas"), F.sum("importe").alias("importe"))


def _read_back(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of the fact as ``read_fact`` finds it after two appends."""
    path = f"{shared_folder(spark)}/fact-{uuid.uuid4().hex}"
    fact = samples.sales_fact(spark, folder)
    late = F.coalesce(F.col("fecha") >= F.lit(LOADED_BEFORE).cast("date"), F.lit(False))
    store.create_fact(spark, path)
    store.append_fact(fact.filter(~late), path)
    store.append_fact(fact.filter(late), path)
    return store.read_fact(spark, path).select(*WORKBOOK_COLUMNS)


def _loaded_again(spark: SparkSession, folder: str) -> DataFrame:
    """The sales fact after the workbook was loaded twice over an earlier part: keys and amounts of every row."""
    path = f"{shared_folder(spark)}/sales-{uuid.uuid4().hex}"
    raw = samples.workbook(spark, folder)
    store.create_fact(spark, path)
    store.append_fact(_stored_sales(spark, folder), path)
    for _ in range(2):
        loads.load_sales(raw, path)
    return store.read_fact(spark, path).select("comprobante", "articulo", "idunica", "fecha", "importe")


def _sink(spark: SparkSession, folder: str) -> DataFrame:
    """The vector store after two publishes, the second of which replaces half of the keys and adds as many: one row per component."""
    stored = table_vectors(spark, folder)
    moved = stored.select(
        F.reverse("vector").alias("vector"),
        F.struct("metadata.text", "metadata.source", (F.col("metadata.chunkIndex") + 250).alias("chunkIndex")).alias("metadata"),
    )
    path = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    vector_store.publish_vectors(stored, path)
    vector_store.publish_vectors(moved, path)
    return _components(vector_store.read_vectors(spark, path))


def _components(stored: DataFrame) -> DataFrame:
    """One row per component of each vector; a chunk without a vector keeps one row."""
    rows = stored.select("metadata.source", "metadata.chunkIndex", "metadata.text", F.posexplode_outer("vector").alias("lugar", "valor"))
    return rows.withColumn("valor", F.round(F.col("valor").cast("double"), 6))


def table_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return samples.table(spark, folder, "embeddings").select(
        F.col("embedding").alias("vector"),
        F.struct(F.lit("").alias("text"), F.lit("v").alias("source"),
                 F.col("vec_id").cast("int").alias("chunkIndex")).alias("metadata"),
    )


LOADS: dict[str, Query] = {
    "i01_carga_posicional": lambda s, f: _rows(s, f).drop(book.ORDER, "motivo_rechazo"),
    "i02_carga_por_encabezado": lambda s, f: _headed(s, f).drop(book.ORDER),
    "i02_encabezado_por_archivo": _headed_files,
    "i03_filas_rechazadas": lambda s, f: loads.rejected(_rows(s, f)).groupBy("motivo_rechazo").agg(F.count(F.lit(1)).alias("filas")),
    "i03_filas_aceptadas": lambda s, f: loads.accepted(_rows(s, f)).select("idunica", "comprobante", "articulo"),
    "i04_insertar_o_ignorar": _new_sales,
    "i04_carga_repetida": _loaded_again,
    "i05_agregar_todo": lambda s, f: book.rows_as_they_come(samples.workbook(s, f)),
    "i06_filas_dim_cliente": _dimension("dim_cliente"),
    "i06_filas_dim_articulo": _dimension("dim_articulo"),
    "i06_filas_dim_vendedor": _dimension("dim_vendedor"),
    "i06_filas_dim_ruta": _dimension("dim_ruta"),
    "i07_upsert_dim_cliente": _upsert("dim_cliente"),
    "i08_upsert_dim_articulo": _upsert("dim_articulo"),
    "i09_upsert_dim_vendedor": _upsert("dim_vendedor"),
    "i10_upsert_dim_ruta": _upsert("dim_ruta"),
    "i07_dim_cliente_guardada": _stored_dimension("dim_cliente"),
    "i08_dim_articulo_guardada": _stored_dimension("dim_articulo"),
    "i09_dim_vendedor_guardada": _stored_dimension("dim_vendedor"),
    "i10_dim_ruta_guardada": _stored_dimension("dim_ruta"),
    "i12_comprobantes_guardados": _star(lambda spark, place, rows, report: star.read_invoices(spark, place, rows)),
    "i13_informe_de_estrella": _star(lambda spark, place, rows, report: report.drop("durationMs")),
    "i11_filas_comprobante": _invoices,
    "i12_insertar_comprobantes": _new_invoices,
    "i13_informe_de_carga": _report,
    "i14_tabla_por_mes": _created,
    "i15_lectura": _read_back,
    "i16_destino_vectores": _sink,
}


# Audits.

AUDITS: dict[str, Query] = {
    "q1_conciliacion": lambda s, f: audit.reconcile(samples.workbook(s, f), loads.accepted(_rows(s, f))),
    "q2_sin_idunica": lambda s, f: audit.missing_key_counts(samples.workbook(s, f)),
    "q2_primeras_filas_sin_idunica": lambda s, f: audit.missing_key_rows(samples.workbook(s, f), [book.ORDER])
    .select("comprobante", "articulo", "art", "cod_ven"),
    "q3_filas": _over_fact(store.row_count),
    "q4_perfil": lambda s, f: audit.profile(samples.sales_fact(s, f), samples.FILE_ORDER, WORKBOOK_COLUMNS),
}


# Documents, vectors, evaluation.

def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.chunk_documents(samples.table(spark, folder, "documents"), "doc_id", "text")


def _first_vector(spark: SparkSession, folder: str) -> list[float]:
    """The stored vector with the smallest id, as the query vector: one row."""
    return samples.table(spark, folder, "embeddings").agg(F.min_by("embedding", "vec_id")).first()[0]


def _nearest(spark: SparkSession, folder: str) -> DataFrame:
    found = vectors.nearest(samples.table(spark, folder, "embeddings"), _first_vector(spark, folder), ["vec_id"], 10)
    return found.withColumn("score", F.round("score", 6))


def _many_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The ten closest vectors of every vector whose id is divisible by 100, exactly, through a stored index."""
    rows = samples.table(spark, folder, "embeddings")
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    vector_index.write_index(rows, path, vector_index.fit_centres(rows, ["vec_id"], 16))
    queries = rows.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    found = vector_index.search_index(spark, path, queries, "query_id", ["vec_id"])
    return found.withColumn("score", F.round("score", 6))


def _paired(spark: SparkSession, folder: str) -> DataFrame:
    chunks = _chunks(spark, folder)
    return vectors.pair_with_vectors(chunks, samples.chunk_vectors(chunks, folder))


def _paired_flat(spark: SparkSession, folder: str) -> DataFrame:
    return _components(_paired(spark, folder)).drop("text")


def _paired_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Each chunk with its whole vector, a column per component."""
    at = [F.round(F.get("vector", F.lit(i)).cast("double"), 6).alias(f"v{i + 1}") for i in range(DIMENSION)]
    return _paired(spark, folder).select(
        "metadata.source", "metadata.chunkIndex", "metadata.text", *at, F.size("vector").cast("bigint").alias("dimension"))


def _vector_query(spark: SparkSession, folder: str) -> DataFrame:
    found = vectors.vector_query(_paired(spark, folder), _first_vector(spark, folder), 10)
    return found.withColumn("score", F.round("score", 6))


def _clean(spark: SparkSession, folder: str) -> DataFrame:
    dirty = F.concat_ws("\u0000", "lang", "source", F.col("text"))
    return samples.table(spark, folder, "documents").select("doc_id", text.without_nul(dirty).alias("texto"))


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.score_runs(samples.recorded_runs(spark, folder)).select("conv_id", "turn", "score")


DOCUMENTS: dict[str, Query] = {
    "v1_fragmentos": _chunks,
    "v2_coseno_top_k": _nearest,
    "v2_consultas_top_k": _many_nearest,
    "v3_sin_nul": _clean,
    "v4_fragmentos_con_vector": _paired_texts,
    "v4_componentes": _paired_flat,
    "a8_busqueda_semantica": _vector_query,
    "e1_puntaje": _scores,
    "e2_resumen": lambda s, f: evaluation.run_summary(_scores(s, f).withColumn("succeeded", F.col("score") == 1)),
    "e3_ultimos_mensajes": lambda s, f: evaluation.last_messages(samples.table(s, f, "conversations")),
    "e3_ultimos_3_mensajes": lambda s, f: evaluation.last_messages(samples.table(s, f, "conversations"), 3),
    "e6_momento_del_dia": lambda s, f: samples.table(s, f, "events")
    .select("event_id", calendar.day_part(F.col("ts")).alias("momento")),
}


# Scalar functions, over the cells of the sample workbook or the fact.

def _cells(**build) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        cells = samples.workbook(spark, folder)
        return cells.select(*[make().alias(name) for name, make in build.items()])
    return run


def _values(**build) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return samples.sales_fact(spark, folder).select(*[make().alias(name) for name, make in build.items()])
    return run


def _col(name: str):
    return lambda: F.col(name)


def _connection():
    return F.concat(F.lit("postgresql://u"), F.col("cliente").cast("string"), F.lit(":"), F.col("articulo"), F.lit("@host:5432/db"))


FUNCTIONS: dict[str, Query] = {
    "f01_numero": _cells(celda=_col("cantidad"), numero=lambda: convert.strict_number(F.col("cantidad"))),
    "f02_entero": _cells(celda=_col("descuento"), entero=lambda: convert.strict_integer(F.col("descuento"))),
    "f03_texto": _cells(celda=_col("comprobante"), texto=lambda: convert.to_text(F.col("comprobante"))),
    "f04_fecha": _cells(celda=_col("fecha"), dia=lambda: convert.to_day(F.col("fecha"))),
    "f05_numero_inicial": _cells(celda=_col("cantidad"), numero=lambda: convert.leading_number(F.col("cantidad"))),
    "f06_formula": _cells(
        resultado=_col("descuento"), valor=_col("cantidad"),
        numero=lambda: convert.formula_number(F.col("descuento"), F.col("cantidad"))),
    "f07_dia_local": _cells(celda=_col("fecha_pedido"), dia=lambda: convert.to_day(F.concat(F.col("fecha_pedido"), F.lit("T23:30:00-03:00")))),
    "f08_redondeo": _values(importe=_col("importe"), redondo=lambda: F.round("importe", 2)),
    "f09_condicionales": _values(
        importe=_col("importe"),
        nulo_si_cero=lambda: F.nullif(F.col("importe"), F.lit(0).cast("decimal(18,4)")),
        motivo=lambda: F.coalesce(F.col("motivodev"), F.lit("sin motivo")),
        absoluto=lambda: F.abs("importe"),
        mayor=lambda: F.greatest(F.col("importe"), F.col("cmv")),
        clase=lambda: F.when(metrics.is_sale(), "venta").when(metrics.is_sample(), "muestra").otherwise("devolucion")),
    "f10_hoy": _values(fecha=_col("fecha"), dias=lambda: calendar.days_between(calendar.as_day(AS_OF), F.col("fecha"))),
    "f11_etiquetas": _values(dia=lambda: calendar.day_label(F.col("fecha")), mes=lambda: calendar.month_label(F.col("fecha"))),
    "f12_dia_semana": _values(
        fecha=_col("fecha"), nombre=lambda: calendar.weekday_name(F.col("fecha")),
        numero=lambda: calendar.weekday_number(F.col("fecha"))),
    "f13_fechas": lambda s, f: samples.sales_fact(s, f).groupBy("cliente").agg(
        F.min("fecha").alias("primera"), F.max("fecha").alias("ultima"),
        F.datediff(F.max("fecha"), F.min("fecha")).alias("dias"), F.date_sub(F.max("fecha"), 90).alias("noventa_antes")),
    "f14_listas": lambda s, f: samples.sales_fact(s, f).groupBy("linea").agg(
        F.count(F.when(metrics.is_rejected(), 1)).alias("rechazadas"),
        F.count(F.when(F.col("motivodev").isin("", "0"), 1)).alias("sin_motivo"),
        F.count(F.when(F.col("cantidad").between(10, 20), 1)).alias("entre_10_y_20")),
    "f15_tipo_comprobante": _values(comprobante=_col("comprobante"), tipo=lambda: text.document_type(F.lower("comprobante"))),
    "f16_numero_es_ar": _values(importe=_col("importe"), numero=lambda: text.es_ar_number(F.col("importe")), pesos=lambda: text.pesos(F.col("importe"))),
    "f17_ocultar_credenciales": _values(conexion=_connection, oculta=lambda: text.mask_credentials(_connection())),
    "f18_lista_de_texto": _values(
        razon_social=_col("razon_social"),
        partes=lambda: F.array_join(text.split_list(F.concat_ws(" , ", "razon_social", "linea", "rubro")), "|")),
}


def entry(spark: SparkSession) -> DataFrame:
    """Seller profitability, commercial and real, at the smallest scale."""
    return INDICATOR_QUERIES["k01_rentabilidad_vendedor"](spark, "/root/testdata/sf0.001")


INDICATOR_QUERIES: dict[str, Query] = {key: _indicator(*call) for key, call in INDICATORS.items()}


def _llm():
    """The queries over documents, or nothing where that subpackage or a library that it needs is left out."""
    try:
        from invoicelens.llm import queries as llm_queries
    except ImportError:
        return None
    return llm_queries


def queries() -> dict[str, Query]:
    own = {**INDICATOR_QUERIES, **TOOLS, **BLOCKS, **LOADS, **AUDITS, **DOCUMENTS, **FUNCTIONS}
    llm = _llm()
    return {**own, **llm.queries()} if llm else own


def oracle_sql() -> dict[str, str]:
    from oracle import all_sql
    llm = _llm()
    return {**all_sql(), **llm.oracle_sql()} if llm else all_sql()
