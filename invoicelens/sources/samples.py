"""Sample tables mapped to the sales model.

The mapping stands in for the company's own invoice lines. Attribute tables are joined to the
smaller side first (customers to orders), so that invoice lines shuffle as rarely as possible, and
lines meet their orders before they get other attributes: they shuffle narrow, and only those of
the orders that a date filter leaves go on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from invoicelens.schema import HEADER_COLUMNS, WORKBOOK_COLUMNS, fact_type


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


# How a line's cells follow from the joined tables. Plain SQL, so that any
# engine can repeat the mapping.
LINE_CELLS = {
    "cls": "(l_orderkey * 31 + l_linenumber * 17 + l_partkey) % 40",
    "qty": "CAST(l_quantity AS DECIMAL(9,2))",
    "bruto": "CAST(l_extendedprice AS DECIMAL(12,2))",
    "disc": "CAST(l_discount AS DECIMAL(4,2))",
    "dto": "CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2))",
    "cu": "CAST(CAST(p_retailprice AS DECIMAL(9,2)) * CAST(1 + (p_partkey % 5) * "
          "CAST(0.35 AS DECIMAL(3,2)) AS DECIMAL(4,2)) AS DECIMAL(12,4))",
}

FACT_CELLS = {
    "idunica": "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING)",
    "cliente": "CAST(o_custkey AS INT)",
    "direccion": "n_name",
    "fecha": "CAST(o_orderdate AS DATE)",
    "comprobante": "(CASE WHEN cls = 2 THEN 'NCR' ELSE 'FAC' END) || CAST(l_orderkey AS STRING)",
    "art": "CAST(l_partkey AS INT)",
    "cantidad": "CAST(CASE WHEN cls = 2 THEN -qty ELSE qty END AS DECIMAL(18,4))",
    "importe": "CAST(CASE WHEN cls <= 1 THEN 0 WHEN cls = 2 THEN -(bruto - dto) ELSE bruto - dto END AS DECIMAL(18,4))",
    "razon_social": "c_name",
    "motivodev": "CASE WHEN cls = 2 THEN CAST(1 + l_linenumber % 3 AS STRING) WHEN cls = 3 THEN '0' WHEN cls = 4 THEN '' END",
    "descuento": "CAST(CASE WHEN cls <= 1 THEN 100 ELSE disc * 100 END AS DECIMAL(18,4))",
    "cod_ven": "CAST(l_suppkey AS INT)",
    "articulo": "p_name",
    "neto": "CAST(CASE WHEN cls <= 1 THEN 0 WHEN cls = 2 THEN -(bruto - dto) ELSE bruto - dto END AS DECIMAL(18,4))",
    "camion": "'T' || CAST(s_nationkey AS STRING)",
    "subcanal": "c_mktsegment",
    "reparto": "CAST(s_nationkey AS INT)",
    "pr_costo_uni_neto": "CAST(cu AS DECIMAL(18,4))",
    "chofer": "s_name",
    "valordesc": "CAST(CASE WHEN cls <= 2 THEN 0 ELSE dto END AS DECIMAL(18,4))",
    "facturacion": "CAST(CASE WHEN cls <= 1 THEN 0 WHEN cls = 2 THEN -bruto ELSE bruto END AS DECIMAL(18,4))",
    "cmv": "CAST(CASE WHEN cls = 2 THEN -qty * cu ELSE qty * cu END AS DECIMAL(18,4))",
    "d1": "CAST(CASE WHEN cls <= 2 THEN 0 ELSE dto END AS DECIMAL(18,4))",
    "d2": "CAST(0 AS DECIMAL(18,4))",
    "peso": "CAST(qty * p_size AS DECIMAL(18,4))",
    "rubro": "'R' || CAST(p_size % 10 AS STRING)",
    "segmentoproducto": "p_type",
    "linea": "p_brand",
    "fecha_pedido": "o_orderdate",
}


def sales_fact(spark: SparkSession, folder: str) -> DataFrame:
    """``ventas_detalle`` over the sample tables; columns they lack are typed NULLs."""
    customers = (
        table(spark, folder, "customer")
        .join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    orders = table(spark, folder, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    lines = (
        table(spark, folder, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    )
    cells = lines.withColumns({name: F.expr(sql) for name, sql in LINE_CELLS.items()})
    return cells.select(*[
        F.expr(FACT_CELLS[c]).alias(c) if c in FACT_CELLS else F.lit(None).cast(fact_type(c)).alias(c)
        for c in WORKBOOK_COLUMNS
    ])


# Order of the rows in the sample file: unique up to rows that are equal in every column.
FILE_ORDER = ("idunica", "art", "cod_ven", "cantidad", "facturacion", "descuento", "d1")

# Defects written into the sample workbook, again as plain SQL over the fact.
WORKBOOK_DEFECTS = {
    "idunica": "CASE WHEN art % 97 = 3 THEN '' WHEN art % 97 = 4 THEN NULL WHEN art % 97 = 5 THEN '0' ELSE idunica END",
    "cliente": "CASE WHEN art % 89 = 1 THEN '0' WHEN art % 89 = 2 THEN CAST(cliente AS STRING) || 'x' ELSE ' ' || CAST(cliente AS STRING) END",
    "comprobante": "CASE WHEN art % 83 = 1 THEN '  ' WHEN art % 83 = 2 THEN NULL ELSE comprobante END",
    "articulo": "CASE WHEN art % 79 = 1 THEN NULL ELSE articulo END",
    "cantidad": "CASE WHEN art % 73 = 1 THEN CAST(cantidad AS STRING) || ' u.' WHEN art % 73 = 2 THEN 'sin dato' "
                "WHEN art % 73 = 3 THEN '12d' WHEN art % 73 = 4 THEN 'Infinity' WHEN art % 73 = 5 THEN '0x10' WHEN art % 73 = 6 THEN '12f' ELSE CAST(cantidad AS STRING) END",
    "descuento": "CASE WHEN art % 71 = 1 THEN '-2.5' WHEN art % 71 = 2 THEN '' "
                 "WHEN art % 71 = 3 THEN '-Infinity' WHEN art % 71 = 4 THEN '7f' WHEN art % 71 = 5 THEN '0X1f' ELSE CAST(descuento AS STRING) END",
    "fecha": "CASE WHEN art % 67 = 1 THEN 'pendiente' WHEN art % 67 = 2 THEN CAST(fecha AS STRING) || 'T10:00:00' ELSE CAST(fecha AS STRING) END",
    "fecha_pedido": "CAST(CAST(fecha_pedido AS DATE) AS STRING)",
    "peso": "CASE WHEN art % 61 = 1 THEN '-1' ELSE CAST(peso AS STRING) END",
}


def workbook_cell(column: str) -> str:
    """SQL text of one sample workbook cell over the fact."""
    return WORKBOOK_DEFECTS.get(column, f"CAST({column} AS STRING)")


def workbook(spark: SparkSession, folder: str) -> DataFrame:
    """The sample workbook: 35 text cells per row, with defects, and the file order columns."""
    fact = sales_fact(spark, folder)
    return fact.select(
        *[F.expr(workbook_cell(c)).alias(c) for c in WORKBOOK_COLUMNS],
        F.struct(*FILE_ORDER).alias("orden_archivo"),
    )


# Samples for the other operators

# Cells that files with headers write another way. Their trucks, drivers and categories are numbers, and some
# later rows lack a name or an address.
HEADED_CELLS = {
    "camion": "substr(camion, 2)",
    "rubro": "substr(rubro, 2)",
    "chofer": "regexp_extract(chofer, '([0-9]+)$', 1)",
    "razon_social": "CASE WHEN CAST(art AS INT) % 7 = 1 AND fecha >= '2000' THEN NULL ELSE razon_social END",
    "direccion": "CASE WHEN CAST(art AS INT) % 7 < 3 AND fecha >= '2000' THEN '' ELSE direccion END",
}


def headed_workbook(spark: SparkSession, folder: str) -> DataFrame:
    """The sample workbook under header names; the two columns without a header are left out."""
    names = {h.lower(): h for h in HEADER_COLUMNS}
    rows = workbook(spark, folder)
    rows = rows.select(*[F.expr(HEADED_CELLS.get(c, f"`{c}`")).alias(c) for c in WORKBOOK_COLUMNS], "orden_archivo")
    return rows.select(*[F.col(c).alias(names[c]) for c in WORKBOOK_COLUMNS if c in names], "orden_archivo")


def stored_before(rows: DataFrame, day: str) -> DataFrame:
    """The part of a table that an earlier load brought."""
    return rows.filter(F.col("fecha") < F.lit(day).cast("date"))


def chunk_vectors(chunks: DataFrame, folder: str) -> DataFrame:
    """A stored vector for every chunk, picked by its document and index."""
    stored = table(chunks.sparkSession, folder, "embeddings").select("vec_id", "embedding")
    picked = (F.col("source").cast("bigint") * 31 + F.col("chunkIndex")) % stored.agg(F.count(F.lit(1))).scalar()
    return chunks.select("source", "chunkIndex", picked.alias("vec_id")).join(stored, "vec_id").drop("vec_id")


def recorded_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Assistant turns as recorded answers, with tool calls and a ground truth."""
    profit, health = F.lit("getProfitabilityAnalysis"), F.lit("getHealthMetrics")
    truth = F.struct(
        F.when(F.col("conv_id") % 3 != 1, profit).alias("should_call_tool"),
        F.when(F.col("conv_id") % 5 != 1, F.lit("the")).alias("expected_answer_contains"),
        F.when(F.col("conv_id") % 7 != 1, F.array(F.lit("er "), F.lit("***"))).alias("forbidden_words"),
    )
    answers = table(spark, folder, "conversations").filter(F.col("role") == "assistant")
    return answers.select(
        "conv_id", "turn", F.col("text").alias("output_text"),
        F.when(F.col("turn") % 4 == 1, F.array(profit)).otherwise(F.array(health)).alias("tool_calls"),
        F.when(F.col("conv_id") % 10 != 0, truth).alias("ground_truth"),
    )
