"""Workbook rows: reading, typing and the split of rejected rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from invoicelens.functions import convert
from invoicelens.schema import (
    DATE_COLUMNS, HEADER_COLUMNS, INT_COLUMNS, MONEY_COLUMNS, WORKBOOK_COLUMNS, workbook_schema,
)
from invoicelens.session import materialise

ORDER = "orden_archivo"


def read_workbook(spark: SparkSession, path: str, header: bool = True, separator: str = ",") -> DataFrame:
    """Positional text cells of delimited files, with each row's place in its file.

    Rows are ordered by file, block and position in the block, so that files may be split.
    """
    rows = spark.read.csv(path, schema=workbook_schema(), header=header, sep=separator,
                          enforceSchema=True, quote='"', escape='"', multiLine=False)
    return rows.select("*", _file_position())


def read_headed_workbook(spark: SparkSession, path: str | list[str], separator: str = ",", null_text: str = "") -> DataFrame:
    """Text cells of delimited files under the known header names, each file by its own first line.

    Files may order their columns as they like, lack some and have others; of equal names the first counts. Cells of a name
    that a file lacks are NULL, and so are cells of ``null_text``. Lines equal to the file's header are no rows. The header lines are gathered in a pass of their
    own and joined to the rows by file.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", "^\ufeff", "").alias("line"), _file_position())
    heads = materialise(
        lines.filter((F.col(f"{ORDER}.block") == 0) & (F.col("line") != ""))
        .groupBy(F.col(f"{ORDER}.file").alias("file")).agg(F.min_by("line", f"{ORDER}.row").alias("head")))
    widest = heads.agg(F.max(F.size(F.split("head", re.escape(separator), -1)))).first()[0] or 1
    cells = ", ".join(f"c{i} string" for i in range(widest))
    options = {"sep": separator, "quote": '"', "escape": '"', "nullValue": null_text}

    def cut(line: str) -> Column:
        # Within a function over one value, so that a line is parsed once and not once per cell.
        read = F.array(F.from_csv(F.col(line), cells, options))
        return F.get(F.transform(read, lambda row: F.array(*[row[f"c{i}"] for i in range(widest)])), F.lit(0))

    names = F.transform(cut("head"), lambda name: F.trim(name))
    places = heads.select("file", "head", *[F.array_position(names, h).cast("int").alias(f"at_{h}") for h in HEADER_COLUMNS])
    rows = lines.filter(F.col("line") != "").join(places, F.col(f"{ORDER}.file") == F.col("file")).filter(F.col("line") != F.col("head"))
    read = rows.withColumn("cells", cut("line"))
    return read.select(*[F.get("cells", F.col(f"at_{h}") - 1).alias(h) for h in HEADER_COLUMNS], ORDER)


def _file_position() -> Column:
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    ).alias(ORDER)


def _typed(column: str) -> Column:
    cell = F.col(column)
    if column in MONEY_COLUMNS:
        return convert.leading_money(cell)
    if column in INT_COLUMNS:
        return convert.whole_number(cell)
    if column == "fecha":
        return convert.to_day(cell)
    if column == "fecha_pedido":
        return convert.to_day(cell).cast("timestamp_ntz")
    return cell


def missing_id() -> Column:
    """No usable line id: NULL, empty and 0 all count as missing."""
    return F.col("idunica").isNull() | F.col("idunica").isin("", "0")


def positional_rows(raw: DataFrame) -> DataFrame:
    """Typed rows, with the reason why a row cannot be loaded (NULL for a good row).

    Cells are converted once; a cell with content that came out NULL is unreadable. The last
    branch of the reason never applies: its row counter keeps the optimizer from moving filters
    on the reason below the conversions, which would repeat all of them there.
    """
    checked = (*INT_COLUMNS, *MONEY_COLUMNS, *DATE_COLUMNS)
    extra = [c for c in raw.columns if c not in WORKBOOK_COLUMNS]
    blank = {c: convert.to_text(F.col(c)).isNull() for c in (*INT_COLUMNS, *DATE_COLUMNS)}
    typed = raw.select(
        *[_typed(c).alias(c) for c in WORKBOOK_COLUMNS], *extra,
        *[empty.alias(f"_blank_{c}") for c, empty in blank.items()],
    )
    reason = F.when(missing_id(), F.lit("missing idunica"))
    for c in checked:
        unread = F.col(c).isNull() & ~F.col(f"_blank_{c}") if c in blank else F.col(c).isNull()
        reason = reason.when(unread, F.lit(f"unreadable {c}"))
    held = reason.when(F.monotonically_increasing_id() < 0, F.lit("never"))
    return typed.select(*WORKBOOK_COLUMNS, *extra, held.alias("motivo_rechazo"))


def accepted(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("motivo_rechazo").isNull()).drop("motivo_rechazo")


def rejected(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("motivo_rechazo").isNotNull())


def rows_as_they_come(raw: DataFrame) -> DataFrame:
    """Typed rows for the plain append: nothing is rejected, an unreadable date is NULL."""
    unnamed = missing_id()
    typed = [
        F.when(~unnamed, F.col("idunica")).alias(c) if c == "idunica"
        else F.coalesce(_typed(c), F.lit(0)).cast("decimal(18,4)").alias(c) if c in MONEY_COLUMNS
        else _typed(c).alias(c)
        for c in WORKBOOK_COLUMNS
    ]
    return raw.select(*typed)


# Headers of whole numbers, amounts and dates.
_HEADED_INTS = ("Cliente", "Art", "Cantidad", "descuento", "cod_ven", "camion", "reparto", "chofer", "rubro")
_HEADED_MONEY = ("Importe", "neto", "pr_costo_uni_neto", "valordesc", "facturacion", "CMV", "d1", "d2", "peso")
_HEADED_DATES = ("Fecha", "fecha_pedido")


def headed_rows(raw: DataFrame) -> DataFrame:
    """Typed rows by header name. A header that is absent gives empty cells.

    Rows without an invoice id or with customer 0 are dropped. The row counter in that condition is always true; it keeps the
    optimizer from moving this filter and later ones below the conversions, which would repeat them there.
    """
    present = set(raw.columns)

    def typed(name: str) -> Column:
        cell = F.col(f"`{name}`") if name in present else F.lit(None).cast("string")
        if name in _HEADED_INTS:
            return convert.strict_integer(cell)
        if name in _HEADED_MONEY:
            return convert.strict_number(cell).try_cast("decimal(18,4)")
        if name == "motivodev":
            return F.when(cell.isNotNull(), convert.strict_integer(cell))
        if name == "capacidad_art":
            return F.when(cell.isNotNull(), convert.strict_number(cell).try_cast("decimal(18,4)"))
        if name in _HEADED_DATES:
            return convert.to_day(cell)
        return convert.to_text(cell)

    order = [ORDER] if ORDER in present else []
    rows = raw.select(*[typed(n).alias(n) for n in HEADER_COLUMNS], *order)
    kept = F.col("Comprobante").isNotNull() & (F.col("Cliente") != 0) & (F.monotonically_increasing_id() >= 0)
    return rows.withColumn("_kept", kept).filter("_kept").drop("_kept")
