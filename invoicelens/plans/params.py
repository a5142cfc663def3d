"""Request parameters: validation, period filters and ranking."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields
from functools import reduce
from operator import and_
from typing import ClassVar

from pyspark.sql import Column, DataFrame, functions as F

from invoicelens.functions.calendar import as_day

MONTH = "mes_particion"

# Dimension names accepted by the grouped tools, and the fact column of each.
DIMENSIONS = {
    "vendedor": "cod_ven",
    "cliente": "razon_social",
    "articulo": "articulo",
    "rubro": "rubro",
    "subcanal": "subcanal",
    "linea": "linea",
    "chofer": "chofer",
    "segmento": "segmentoproducto",
    "fecha": "fecha",
}


def dimension(name: str) -> Column:
    """The grouping expression of a dimension name."""
    if name not in DIMENSIONS:
        raise ValueError(f"unknown dimension: {name!r}")
    column = F.col(DIMENSIONS[name])
    return F.to_date(column) if name == "fecha" else column


def _day(value: str | dt.date | None) -> dt.date | None:
    if value is None or value == "":
        return None
    if isinstance(value, dt.datetime):
        return value.date()
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)


def day_range(fact: DataFrame, start=None, end=None) -> Column | None:
    """Condition for ``start`` to ``end``, both included, each optional; None without bounds.

    On a table partitioned by month it names the months of the range as well.
    """
    start, end = _day(start), _day(end)
    parts = []
    for bound, meets in ((start, Column.__ge__), (end, Column.__le__)):
        if bound is not None:
            parts.append(meets(F.col("fecha"), F.lit(bound)))
            if MONTH in fact.columns:
                parts.append(meets(F.col(MONTH), F.lit(f"{bound:%Y-%m}")))
    return reduce(and_, parts) if parts else None


def between_days(fact: DataFrame, start=None, end=None) -> DataFrame:
    """Rows from ``start`` to ``end``."""
    condition = day_range(fact, start, end)
    return fact if condition is None else fact.filter(condition)


def or_default(value: int | None, default: int) -> int:
    """``default`` for a missing value and for zero."""
    return value if value else default


def check_limit(value: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        raise ValueError(f"limit must be a whole number of rows, got {value!r}")
    return value


def descending(order: str | None) -> bool:
    """Everything but 'ASC' is descending."""
    return order != "ASC"


def sort_key(name: str, down: bool) -> Column:
    """NULL counts as the largest value: first when descending, last when ascending."""
    column = F.col(name)
    return column.desc_nulls_first() if down else column.asc_nulls_last()


def top(rows: DataFrame, metrics: str | Sequence[str], keys: Sequence[str], limit: int | None,
        down: bool = True) -> DataFrame:
    """The first ``limit`` rows by ``metrics``; ties go to the smaller ``keys``."""
    metrics = [metrics] if isinstance(metrics, str) else list(metrics)
    order = [sort_key(m, down) for m in metrics] + [sort_key(k, False) for k in keys]
    ranked = rows.orderBy(*order)
    return ranked if limit is None else ranked.limit(check_limit(limit))


@dataclass(frozen=True)
class IndicatorRequest:
    """Parameters of one indicator call."""

    marca: str | None = None
    marcas_foco: Sequence[str] | str | None = None
    cliente_id: int | None = None
    dias_sin_compra: int | None = None
    dias_previos: int | None = None
    fecha_inicio_anterior: str | dt.date | None = None
    fecha_fin_anterior: str | dt.date | None = None
    fecha_inicio: str | dt.date | None = None
    fecha_fin: str | dt.date | None = None
    limite: int | None = None
    orden: str | None = "DESC"
    as_of: str | dt.date | None = None
    # Thresholds; the defaults are the catalogue's fixed values.
    min_unidades: float = 1000
    max_margen: float = 0.15
    min_descuento: float = 0.05

    # Spelling of the public parameter names.
    _PUBLIC: ClassVar[Mapping[str, str]] = {
        "marcasFoco": "marcas_foco",
        "clienteId": "cliente_id",
        "diasSinCompra": "dias_sin_compra",
        "diasPrevios": "dias_previos",
        "fechaInicioAnterior": "fecha_inicio_anterior",
        "fechaFinAnterior": "fecha_fin_anterior",
        "fechaInicio": "fecha_inicio",
        "fechaFin": "fecha_fin",
    }

    @classmethod
    def build(cls, params: Mapping[str, object]) -> "IndicatorRequest":
        named = {cls._PUBLIC.get(key, key): value for key, value in params.items()}
        unknown = set(named) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        return cls(**named)

    def __post_init__(self):
        limit = 10 if self.limite is None else check_limit(self.limite)
        if limit > 50:
            raise ValueError("limite must not exceed 50")
        object.__setattr__(self, "limite", limit)
        for name in ("fecha_inicio", "fecha_fin", "fecha_inicio_anterior", "fecha_fin_anterior"):
            object.__setattr__(self, name, _day(getattr(self, name)))
        brands = self.marcas_foco
        if isinstance(brands, str):
            brands = [] if not brands.strip() else [b.strip() for b in brands.split(",")]
        object.__setattr__(self, "marcas_foco", tuple(brands or ()))

    def require(self, *names: str) -> None:
        missing = [n for n in names if not getattr(self, n)]
        if missing:
            raise ValueError(f"missing parameters: {missing}")

    def in_period(self, fact: DataFrame) -> DataFrame:
        """Rows of the period. An end without a start filters nothing."""
        if self.fecha_inicio is None:
            return fact
        return between_days(fact, self.fecha_inicio, self.fecha_fin)

    def period_condition(self) -> Column:
        """The same period as a condition."""
        day = F.col("fecha")
        if self.fecha_inicio is None:
            return F.lit(True)
        if self.fecha_fin is None:
            return day >= F.lit(self.fecha_inicio)
        return day.between(F.lit(self.fecha_inicio), F.lit(self.fecha_fin))

    def top(self, rows: DataFrame, metrics, keys: Sequence[str]) -> DataFrame:
        return top(rows, metrics, keys, self.limite, descending(self.orden))

    def today(self) -> Column:
        return as_day(self.as_of)
