"""SQL for each registered query, for comparison in another engine."""

from __future__ import annotations

from oracle import functions, indicators, jobs, tools


def all_sql() -> dict[str, str]:
    return {**indicators.sql(), **tools.sql(), **jobs.sql(), **functions.sql()}
