"""Shape of the plans: no pair-building joins, filters and columns reach the scan."""

import pytest

from invoicelens import run_indicator
from invoicelens.operators import tools_live as live
from invoicelens.sources import store

SF = "/root/testdata/sf0.001"
KEYS = ["k01_rentabilidad_vendedor", "k11_clientes_no_compran_marca", "k16_reactivacion_clientes",
        "k39_indice_concentracion_pareto", "k40_cumplimiento_mix_ideal", "a1_health_metrics", "a6_sales_opportunities",
        "l7_additional_kpis", "i04_insertar_o_ignorar", "q1_conciliacion", "v2_coseno_top_k", "a8_busqueda_semantica"]


def physical(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", KEYS)
def test_no_cross_joins(spark, driver_entry, key):
    plan = physical(driver_entry.queries()[key](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.fixture(scope="module")
def stored(spark, small_fact, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "fact")
    store.replace_fact(small_fact, path)
    return store.read_fact(spark, path)


def test_columns_and_filters_reach_the_scan(stored):
    plan = physical(run_indicator(stored, "rentabilidad_vendedor", fechaInicio="2024-01-01", fechaFin="2024-01-31"))
    assert "TakeOrderedAndProject" in plan
    assert "ReadSchema: struct<fecha:date,importe:decimal(18,4),cod_ven:int,facturacion:decimal(18,4),cmv:decimal(18,4)>" in plan \
        or plan.count("FileScan") == 1 and "razon_social" not in plan
    assert "GreaterThanOrEqual(fecha,2024-01-01)" in plan and "mes_particion" in plan.split("PartitionFilters")[1]


def test_one_scan_for_shares_and_health(stored):
    assert physical(run_indicator(stored, "indice_concentracion_pareto")).count("FileScan") == 1
    assert physical(live.health_metrics(stored, "2024-01-01", "2024-01-31")).count("FileScan") == 1


def test_look_back_names_its_months(stored):
    plan = physical(run_indicator(stored, "reactivacion_clientes", fechaInicio="2024-01-01", fechaFin="2024-01-31"))
    scans = [part for part in plan.split("FileScan")[1:] if "PartitionFilters" in part]
    filters = [part.split("PartitionFilters:")[1].split("PushedFilters")[0] for part in scans]
    assert filters and all("mes_particion" in text for text in filters)
