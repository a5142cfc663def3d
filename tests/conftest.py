import datetime as dt
import importlib.util
import sys
from decimal import Decimal
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from invoicelens.schema import MONEY_COLUMNS, fact_schema  # noqa: E402
from invoicelens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")), spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def driver_entry():
    spec = importlib.util.spec_from_file_location("spark_entry", ROOT / "__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


@pytest.fixture(scope="session")
def make_fact(spark):
    """A fact from dicts; columns left out are NULL."""
    schema = fact_schema()

    def build(*rows):
        filled = []
        for row in rows:
            cells = {f.name: row.get(f.name) for f in schema}
            for c in MONEY_COLUMNS:
                if cells[c] is not None:
                    cells[c] = Decimal(str(cells[c]))
            if isinstance(cells["fecha"], str):
                cells["fecha"] = dt.date.fromisoformat(cells["fecha"])
            filled.append(tuple(cells[f.name] for f in schema))
        return spark.createDataFrame(filled, schema)

    return build


@pytest.fixture(scope="session")
def small_fact(make_fact):
    """Sales, samples, returns; NULLs in every key; ties; one customer under two names."""
    def row(cliente, razon, comp, art, importe, **more):
        base = dict(cliente=cliente, razon_social=razon, comprobante=comp, art=art, articulo=f"p{art}", importe=importe,
                    facturacion=importe, cmv=more.pop("cmv", 6), d1=more.pop("d1", 0), cantidad=more.pop("cantidad", 1),
                    pr_costo_uni_neto=6, idunica=f"{comp}-{art}", fecha=more.pop("fecha", "2024-01-10"),
                    descuento=100 if importe == 0 else 0, neto=importe, valordesc=0, cod_ven=more.pop("cod_ven", 1),
                    linea=more.pop("linea", "A"))
        return {**base, **more}

    return make_fact(
        row(1, "uno", "FAC1", 1, 10, d1=1),
        row(1, "uno", "FAC1", 2, 20, linea="B"),
        row(1, "uno bis", "FAC2", 1, 10, fecha="2024-02-01"),
        row(2, "dos", "FAC3", 1, 0, fecha="2024-02-02", cod_ven=2),
        row(2, "dos", "FAC4", 3, -10, motivodev="2", fecha="2024-02-03", cod_ven=2, linea=None),
        row(3, "tres", "FAC5", None, 10, d1=None, fecha="2024-03-01", cod_ven=None, motivodev="0", linea=""),
        row(3, "tres", "FAC6", 2, 5, cmv=9, fecha="2024-03-05", motivodev="", linea="B"),
        row(None, "sin codigo", "FAC7", 2, 5, cmv=9, fecha="2024-03-05"),
    )
