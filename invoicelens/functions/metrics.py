"""The metric library.

A report names metrics; ``summarise`` works out which aggregates they need, runs them in one
pass with map-side partial sums, and derives the rest on the grouped rows. ``importe`` tells
the kind of a line: positive is a sale, zero a free sample, negative a return.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F


def is_sale() -> Column:
    return F.col("importe") > 0


def is_sample() -> Column:
    return F.col("importe") == 0


def is_rejected() -> Column:
    """A line with a real return reason: NULL, '' and '0' mean that there is none."""
    return F.col("motivodev").isNotNull() & ~F.col("motivodev").isin("", "0")


def sum_where(condition: Column, value: Column) -> Column:
    """Sum over the rows that meet ``condition``; NULL where none does."""
    return F.sum(F.when(condition, value))


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` as a double; NULL where ``b`` is zero."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def percent(a: Column, b: Column) -> Column:
    """``a`` as a percentage of ``b``, two decimals, half away from zero.

    The quotient passes through twelve decimals, so that an exact tie stays a tie.
    """
    return F.round((ratio(a, b) * 100).cast("decimal(38,12)"), 2)


def mean_money(total: Column, count: Column) -> Column:
    """``total / count`` in decimal arithmetic, two decimals."""
    return F.round(total / F.nullif(count, F.lit(0)).cast("decimal(20,0)"), 2)


def _gross() -> Column:
    return F.col("facturacion") - F.col("cmv")


def _after_discount() -> Column:
    return F.col("facturacion") - F.col("cmv") - F.col("d1")


def cost_of_units() -> Column:
    return F.col("cantidad") * F.col("pr_costo_uni_neto")


# Aggregates. Thunks, because a Column needs a running session.
AGGREGATES: Mapping[str, Callable[[], Column]] = {
    "sales": lambda: sum_where(is_sale(), F.col("facturacion")),
    "discounts": lambda: sum_where(is_sale(), F.col("d1")),
    "cost": lambda: sum_where(is_sale(), F.col("cmv")),
    "gross": lambda: sum_where(is_sale(), _gross()),
    "commercial": lambda: sum_where(is_sale(), _after_discount()),
    "units": lambda: sum_where(is_sale(), F.col("cantidad")),
    "kilos": lambda: sum_where(is_sale(), F.col("peso")),
    "samples": lambda: sum_where(is_sample(), F.col("cmv")),
    "sample_lines": lambda: F.count(F.when(is_sample(), F.lit(1))),
    "sale_invoices": lambda: F.count_distinct(F.when(is_sale(), F.col("comprobante"))),
    "sale_customers": lambda: F.count_distinct(F.when(is_sale(), F.col("cliente"))),
    "all_sales": lambda: F.sum("facturacion"),
    "all_discounts": lambda: F.sum("d1"),
    "all_cost": lambda: F.sum("cmv"),
    "all_gross": lambda: F.sum(_gross()),
    "all_units": lambda: F.sum("cantidad"),
    "all_amount": lambda: F.sum("importe"),
    "all_net": lambda: F.sum("neto"),
    "all_valordesc": lambda: F.sum("valordesc"),
    "all_unit_cost": lambda: F.sum(cost_of_units()),
    "invoices": lambda: F.count_distinct("comprobante"),
    "tickets": lambda: F.count_distinct("idunica"),
    "customers": lambda: F.count_distinct("cliente"),
    "brands": lambda: F.count_distinct("linea"),
    "amount_lines": lambda: F.count("importe"),
    "name": lambda: F.max("razon_social"),
    "first_day": lambda: F.min("fecha"),
    "last_day": lambda: F.max("fecha"),
}

DISTINCT_COUNTS = {"sale_invoices", "sale_customers", "invoices", "tickets", "customers", "brands"}

# Derived on the grouped rows: what each one needs, then the expression.
DERIVED: Mapping[str, tuple[tuple[str, ...], Callable[..., Column]]] = {
    "samples_or_zero": (("samples",), lambda s: F.coalesce(s, F.lit(0))),
    "net": (("commercial", "samples_or_zero"), lambda c, s: c - s),
    "discount_pct": (("discounts", "sales"), percent),
    "gross_pct": (("gross", "sales"), percent),
    "commercial_pct": (("commercial", "sales"), percent),
    "net_pct": (("net", "sales"), percent),
    "samples_pct": (("samples", "sales"), percent),
    "all_gross_pct": (("all_gross", "sales"), percent),
    "all_gross_on_all_pct": (("all_gross", "all_sales"), percent),
    "sample_impact": (("gross", "all_gross"), lambda a, b: a - b),
    "commercial_spend": (("discounts", "samples_or_zero"), lambda d, s: d + s),
    "commercial_spend_pct": (("commercial_spend", "sales"), percent),
    # Not defaulted: NULL for a group without samples.
    "strict_spend": (("discounts", "samples"), lambda d, s: d + s),
    "strict_spend_pct": (("strict_spend", "sales"), percent),
    "amount_margin": (("all_amount", "all_unit_cost"), lambda a, c: a - c),
    "amount_margin_ratio": (("amount_margin", "all_amount"), lambda m, a: ratio(m, a) * 100),
    "discount_ratio": (("all_discounts", "all_amount"), lambda d, a: ratio(d, a) * 100),
    "mean_price": (("all_amount", "all_units"), ratio),
    "mean_ticket": (("all_amount", "invoices"), mean_money),
    "mean_net_ticket": (("all_net", "invoices"), mean_money),
}


def _needed(metric: str) -> list[str]:
    if metric in AGGREGATES:
        return [metric]
    return [base for part in DERIVED[metric][0] for base in _needed(part)]


def metric(name: str) -> Column:
    """The metric as an expression over the grouped rows that ``measure`` returns."""
    if name in AGGREGATES:
        return F.col(name)
    parts, build = DERIVED[name]
    return build(*[metric(p) for p in parts])


def measure(fact: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per group with the aggregates that ``metrics`` rest on.

    Distinct counts are taken apart from the sums and joined to them per group. Together, every
    (group, counted value) pair would carry all sums through the shuffle; apart, the pairs are
    bare and the sums are one partial row per group and task.
    """
    bases = list(dict.fromkeys(base for name in metrics for base in _needed(name)))
    counts = [b for b in bases if b in DISTINCT_COUNTS]
    sums = [b for b in bases if b not in DISTINCT_COUNTS]

    def grouped(names: Sequence[str]) -> DataFrame:
        return fact.groupBy(*by).agg(*[AGGREGATES[n]().alias(n) for n in names])

    if not by or not counts or not sums:
        return grouped(bases)
    keys = {column: f"_same_{column}" for column in by}
    counted = grouped(counts).withColumnsRenamed(keys)
    same = reduce(and_, [F.col(column).eqNullSafe(F.col(other)) for column, other in keys.items()])
    return grouped(sums).join(counted, same).drop(*keys.values())


def summarise(fact: DataFrame, by: Mapping[str, str], show: Mapping[str, str]) -> DataFrame:
    """Group ``fact`` and show metrics: ``by`` and ``show`` map output names to columns/metrics."""
    grouped = measure(fact, list(by.values()), list(show.values()))
    keys = [F.col(column).alias(name) for name, column in by.items()]
    return grouped.select(*keys, *[metric(m).alias(name) for name, m in show.items()])
