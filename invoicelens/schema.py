"""Table layouts."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 4)

# The 35 workbook columns by position (1-based in the source file).
WORKBOOK_COLUMNS = (
    "cliente", "direccion", "fecha", "comprobante", "art", "cantidad", "importe",
    "razon_social", "motivodev", "descuento", "cod_ven", "articulo", "neto", "camion",
    "comentario", "idunica", "subcanal", "reparto", "pr_costo_uni_neto", "chofer",
    "valordesc", "facturacion", "cmv", "d1", "d2", "peso", "rubro", "descripcion",
    "capacidad_art", "usuariopicking", "nombrepicking", "tipov", "segmentoproducto",
    "linea", "fecha_pedido",
)

INT_COLUMNS = ("cliente", "art", "cod_ven", "reparto")
MONEY_COLUMNS = (
    "cantidad", "importe", "descuento", "neto", "pr_costo_uni_neto", "valordesc",
    "facturacion", "cmv", "d1", "d2", "peso", "capacidad_art",
)
DATE_COLUMNS = ("fecha", "fecha_pedido")

# Header texts of the header-named workbook.
HEADER_COLUMNS = (
    "Cliente", "Direccion", "Fecha", "Comprobante", "Art", "Cantidad", "Importe",
    "Razon_Social", "motivodev", "descuento", "cod_ven", "articulo", "neto", "camion",
    "IDUNICA", "subcanal", "reparto", "pr_costo_uni_neto", "chofer", "valordesc",
    "facturacion", "CMV", "d1", "d2", "peso", "rubro", "descripcion", "capacidad_art",
    "tipoV", "segmentoproducto", "linea", "fecha_pedido",
)

FACT_KEY = ("comprobante", "articulo")
# The load that brought a stored row.
LOAD = "carga"


def fact_type(column: str) -> T.DataType:
    if column in INT_COLUMNS:
        return T.IntegerType()
    if column in MONEY_COLUMNS:
        return MONEY
    if column == "fecha":
        return T.DateType()
    if column == "fecha_pedido":
        return T.TimestampNTZType()
    return T.StringType()


def workbook_schema() -> T.StructType:
    """Positional workbook as read from delimited text: every cell is a string."""
    return T.StructType([T.StructField(c, T.StringType()) for c in WORKBOOK_COLUMNS])


def fact_schema() -> T.StructType:
    """``ventas_detalle``: the business columns, without the store's own bookkeeping columns."""
    return T.StructType([T.StructField(c, fact_type(c)) for c in WORKBOOK_COLUMNS])


def vector_schema() -> T.StructType:
    return T.StructType([
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("metadata", T.StructType([
            T.StructField("text", T.StringType()),
            T.StructField("source", T.StringType()),
            T.StructField("chunkIndex", T.IntegerType()),
        ])),
    ])


def ground_truth_type() -> T.StructType:
    return T.StructType([
        T.StructField("should_call_tool", T.StringType()),
        T.StructField("expected_answer_contains", T.StringType()),
        T.StructField("forbidden_words", T.ArrayType(T.StringType())),
    ])
