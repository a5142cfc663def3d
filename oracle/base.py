"""Pieces of SQL text that the statements share."""

from __future__ import annotations

from invoicelens.schema import WORKBOOK_COLUMNS, INT_COLUMNS, MONEY_COLUMNS
from invoicelens.sources.samples import FACT_CELLS, LINE_CELLS, workbook_cell

_SQL_TYPES = {**{c: "INTEGER" for c in INT_COLUMNS}, **{c: "DECIMAL(18,4)" for c in MONEY_COLUMNS}}


def _fact_cells() -> str:
    return ",\n ".join(
        f"{FACT_CELLS[c]} AS {c}" if c in FACT_CELLS else f"CAST(NULL AS {_SQL_TYPES.get(c, 'VARCHAR')}) AS {c}"
        for c in WORKBOOK_COLUMNS
    )


FACT = f"""SELECT {_fact_cells()}
FROM (SELECT *, {', '.join(f'{sql} AS {name}' for name, sql in LINE_CELLS.items())}
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
 JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey) x"""

WORKBOOK = "SELECT " + ",\n ".join(f"{workbook_cell(c)} AS {c}" for c in WORKBOOK_COLUMNS) + \
    ",\n art AS k_art, cod_ven AS k_cod_ven, cantidad AS k_cantidad, facturacion AS k_facturacion," \
    " descuento AS k_descuento, d1 AS k_d1, idunica AS k_idunica FROM v"


def over_fact(body: str, ctes: str = "") -> str:
    return f"WITH v AS ({FACT}){', ' + ctes if ctes else ''}\n{body}"


def over_workbook(body: str, ctes: str = "") -> str:
    return over_fact(body, f"w AS ({WORKBOOK})" + (f", {ctes}" if ctes else ""))


def pos(x: str) -> str:
    return f"SUM({x}) FILTER (WHERE importe > 0)"


VN, D, CV = pos("facturacion"), pos("d1"), pos("cmv")
RC0, RC = pos("facturacion - cmv"), pos("facturacion - cmv - d1")
MUN = "SUM(cmv) FILTER (WHERE importe = 0)"
MU = f"COALESCE({MUN}, 0)"
RN = f"({RC} - {MU})"
NM = "COUNT(*) FILTER (WHERE importe = 0)"


def ratio(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def pct(a: str, b: str) -> str:
    return f"ROUND(CAST({ratio(a, b)} * 100 AS DECIMAL(38,12)), 2)"


def mean(total: str, count: str) -> str:
    return f"ROUND(CAST(CAST({total} AS DOUBLE) / NULLIF({count}, 0) AS DECIMAL(38,8)), 2)"


def days(start: str | None = None, end: str | None = None) -> str:
    parts = ([f"fecha >= DATE '{start}'"] if start else []) + ([f"fecha <= DATE '{end}'"] if end else [])
    return " AND ".join(parts) or "TRUE"


PERIOD = days("2000-01-01", "2001-06-30")
AS_OF = "DATE '2001-08-01'"


def first(metric: str, keys: str, n: int | None = 50, down: bool = True) -> str:
    order = f"{metric} DESC NULLS FIRST" if down else f"{metric} ASC NULLS LAST"
    ties = ", ".join(f"{k.strip()} ASC NULLS LAST" for k in keys.split(",") if k.strip())
    return f"ORDER BY {order}{', ' + ties if ties else ''}" + (f" LIMIT {n}" if n is not None else "")
