"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def without_nul(text: Column) -> Column:
    """U+0000 removed."""
    return F.translate(text, "\u0000", "")


def es_ar_number(value: Column, most_decimals: int = 2) -> Column:
    """``1.234,56``: dot for thousands, comma for decimals, at least two decimals."""
    pattern = "#,##0.00" + "#" * (most_decimals - 2)
    text = F.call_function("format_number", F.round(value, most_decimals), F.lit(pattern))
    return F.translate(text, ",.", ".,")


def pesos(value: Column) -> Column:
    """An amount as ``$1.234,56``."""
    return F.concat(F.lit("$"), es_ar_number(value))


def mask_credentials(connection: Column) -> Column:
    """The part between the first usable ':' and the next '@' hidden."""
    return F.regexp_replace(connection, r"(?s)^(.*?):[^@]+@", "$1:****@")


def split_list(text: Column) -> Column:
    """Comma-separated text as an array of trimmed parts; blank text is an empty array."""
    parts = F.transform(F.split(text, ","), lambda part: F.trim(part))
    return F.when(F.trim(text) == "", F.array().cast("array<string>")).otherwise(parts)


def document_type(comprobante: Column) -> Column:
    """First three characters of the invoice id in capitals."""
    return F.upper(F.substring(comprobante, 1, 3))
