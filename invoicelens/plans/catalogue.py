"""Registry of named indicators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from invoicelens.plans.params import IndicatorRequest

Indicator = Callable[[DataFrame, IndicatorRequest], DataFrame]
_CATALOGUE: dict[str, Indicator] = {}


def indicator(name: str) -> Callable[[Indicator], Indicator]:
    def add(build: Indicator) -> Indicator:
        if name in _CATALOGUE:
            raise ValueError(f"indicator registered twice: {name}")
        _CATALOGUE[name] = build
        return build
    return add


def _loaded() -> dict[str, Indicator]:
    from invoicelens.operators import indicators  # noqa: F401  registers on import
    return _CATALOGUE


def indicator_names() -> list[str]:
    return sorted(_loaded())


def run_indicator(fact: DataFrame, name: str, **params) -> DataFrame:
    """Plan one indicator over ``fact``. Parameters take the public or the snake-case names."""
    build = _loaded().get(name)
    if build is None:
        raise ValueError(f"unknown indicator: {name!r}")
    return build(fact, IndicatorRequest.build(params))
