"""Hand-computed cases: NULLs, samples, returns, ties, empty periods, bad input."""

import datetime as dt
from decimal import Decimal as D

import pytest

from invoicelens import indicator_names, run_indicator
from invoicelens.operators import tools_earlier as earlier, tools_live as live
from invoicelens.plans.params import IndicatorRequest


def rows(frame):
    return [r.asDict() for r in frame.collect()]


def test_catalogue_is_complete():
    assert len(indicator_names()) == 46


def test_seller_report(small_fact):
    first, second, third = rows(run_indicator(small_fact, "rentabilidad_vendedor"))
    # A seller without sales has NULL profit and sorts first when descending.
    assert first["cod_ven"] == 2 and first["rentabilidad_comercial"] is None
    assert first["items_muestra_gratis"] == 1 and first["cmv_muestras_gratis"] == D(6)
    assert first["rentabilidad_real_total"] == D(-22) and first["margen_pct_real"] is None
    assert second["cod_ven"] == 1 and second["rentabilidad_comercial"] == D(14)
    assert second["margen_pct_comercial"] == D("28.00")
    assert third["cod_ven"] is None and third["rentabilidad_comercial"] == D(4)


def test_null_operand_drops_the_line_from_profit_after_discount(small_fact):
    by_name = {r["razon_social"]: r for r in rows(run_indicator(small_fact, "clientes_campeones"))}
    assert by_name["tres"]["venta_neta"] == D(15)
    assert by_name["tres"]["rentabilidad_comercial"] == D(-4)


def test_losing_customers_need_a_sale(small_fact):
    found = rows(run_indicator(small_fact, "clientes_no_rentables"))
    assert [r["razon_social"] for r in found] == ["tres", "sin codigo"]


def test_descending_and_ascending_nulls(small_fact):
    down = rows(run_indicator(small_fact, "venta_por_vendedor"))
    up = rows(run_indicator(small_fact, "venta_por_vendedor", orden="ASC"))
    assert [r["cod_ven"] for r in down] == [1, None, 2]
    assert [r["cod_ven"] for r in up] == [2, None, 1]


def test_not_in_with_null_on_the_right_returns_nothing(small_fact):
    assert rows(run_indicator(small_fact, "clientes_no_compran_marca", marca="A")) == []
    found = rows(run_indicator(small_fact, "clientes_no_compran_marca", marca="B"))
    assert [r["cliente"] for r in found] == [2]
    # Nobody bought it: every customer stays, also the one without a code.
    assert len(rows(run_indicator(small_fact, "clientes_no_compran_marca", marca="Z"))) == 5


def test_products_without_rotation_null_trap(small_fact):
    assert rows(run_indicator(small_fact, "productos_sin_rotacion")) == []
    found = rows(run_indicator(small_fact, "productos_sin_rotacion", fechaInicio="2024-01-01", fechaFin="2024-02-28"))
    assert [r["art"] for r in found] == [3]


def test_new_customers_use_all_names_of_a_customer(small_fact):
    found = rows(run_indicator(small_fact, "nuevos_clientes_periodo", fechaInicio="2024-02-01", fechaFin="2024-12-31"))
    assert [(r["cliente"], r["primera_compra"]) for r in found] == [
        (2, dt.date(2024, 2, 2)), (3, dt.date(2024, 3, 1))]


def test_reactivation(small_fact):
    params = dict(fechaInicio="2024-03-01", fechaFin="2024-03-31")
    # Nobody bought in the ten days before, so the customer without a code stays too.
    found = rows(run_indicator(small_fact, "reactivacion_clientes", diasPrevios=10, **params))
    assert [r["cliente"] for r in found] == [3, None]
    assert [r["cliente"] for r in rows(run_indicator(small_fact, "reactivacion_clientes", **params))] == [3]
    assert rows(run_indicator(small_fact, "reactivacion_clientes", fechaInicio="2030-01-01")) == []


def test_dormant_default_of_sixty_days(small_fact):
    found = rows(run_indicator(small_fact, "clientes_dormidos", as_of="2024-04-03", diasSinCompra=0))
    assert [(r["razon_social"], r["dias_sin_comprar"]) for r in found] == [("uno", 84), ("uno bis", 62)]


def test_end_date_alone_filters_nothing_in_indicators(small_fact):
    whole = rows(run_indicator(small_fact, "venta_total"))
    assert rows(run_indicator(small_fact, "venta_total", fechaFin="2024-01-10")) == whole
    assert rows(earlier.mean_ticket(small_fact, end="2024-01-10")) == [{"ticket_promedio": 15.0}]


def test_return_rate(small_fact):
    found = {r["cod_ven"]: r for r in rows(run_indicator(small_fact, "tasa_devolucion_vendedor"))}
    assert (found[2]["facturas_rechazadas"], found[2]["total_facturas"], found[2]["pct_rechazo"]) == (1, 2, D("50.00"))
    assert found[None]["facturas_rechazadas"] == 0


def test_mix_and_concentration(small_fact):
    mix = rows(run_indicator(small_fact, "mix_cliente", clienteId=1))
    assert [(r["linea"], r["pct_del_cliente"]) for r in mix] == [("A", D("50.00")), ("B", D("50.00"))]
    shares = rows(run_indicator(small_fact, "indice_concentracion_pareto", limite=2))
    assert len(shares) == 2 and shares[0]["razon_social"] == "dos" and shares[0]["venta_neta"] is None
    assert shares[1]["pct_del_total_venta"] == D("50.00")


def test_rfm_tiles_equal_the_built_in(spark, small_fact):
    found = rows(run_indicator(small_fact, "rfm_segmentacion", as_of="2024-04-01", limite=50))
    small_fact.createOrReplaceTempView("ventas")
    expected = spark.sql("""
        WITH rfm AS (SELECT cliente, razon_social, datediff(DATE '2024-04-01', max(fecha)) r,
                     count(DISTINCT comprobante) f, sum(importe) m FROM ventas WHERE importe > 0 GROUP BY 1, 2)
        SELECT razon_social, ntile(4) OVER (ORDER BY r, cliente NULLS LAST, razon_social) r,
          ntile(4) OVER (ORDER BY f DESC, cliente NULLS LAST, razon_social) f,
          ntile(4) OVER (ORDER BY m DESC, cliente NULLS LAST, razon_social) m FROM rfm""").collect()
    assert {(r["razon_social"], r["r_score"], r["f_score"], r["m_score"]) for r in found} == \
        {(r["razon_social"], r["r"], r["f"], r["m"]) for r in expected}


def test_comparison_counts_zero_for_an_empty_period(small_fact, make_fact):
    params = dict(fechaInicio="2024-01-01", fechaFin="2024-01-31", fechaInicioAnterior="2023-01-01",
                  fechaFinAnterior="2023-12-31")
    only, = rows(run_indicator(small_fact, "comparativo_periodos", **params))
    assert only["venta_periodo_actual"] == D(30) and only["venta_periodo_anterior"] == 0
    assert only["variacion_porcentual"] is None
    nothing, = rows(run_indicator(make_fact(), "comparativo_periodos", **params))
    assert nothing["venta_periodo_actual"] is None


def test_bad_input(small_fact):
    for name, params in [
        ("nada", {}), ("clientes_no_compran_marca", {}), ("mix_cliente", {}), ("comparativo_periodos", {}),
        ("venta_total", {"limite": 51}), ("venta_total", {"limite": -1}), ("venta_total", {"otro": 1}),
    ]:
        with pytest.raises(ValueError):
            run_indicator(small_fact, name, **params)
    with pytest.raises(ValueError):
        live.profitability(small_fact, "rubro")
    with pytest.raises(ValueError):
        live.customer_analytics(small_fact, "otro")


def test_brand_list_text():
    assert IndicatorRequest.build({"marcasFoco": " a, b ,c"}).marcas_foco == ("a", "b", "c")
    assert IndicatorRequest.build({"marcasFoco": "  "}).marcas_foco == ()
    assert IndicatorRequest.build({}).limite == 10 and IndicatorRequest.build({"limite": 0}).limite == 0


def test_opportunities(small_fact):
    found = rows(live.sales_opportunities(small_fact, "2024-01-01", "2024-01-31", limit=5))
    assert found == []
    found = rows(live.sales_opportunities(small_fact, "2024-02-01", "2024-02-28", "otra cosa", 1))
    assert [(r["entidad"], r["cliente"], r["marca_ausente"]) for r in found] == [(1, "uno bis", "B")]


def test_health_ignores_dates_for_marketing(small_fact):
    only, = rows(live.health_metrics(small_fact, "2024-01-01", "2024-01-31"))
    assert only["ingresos_brutos"] == D(30) and only["costo_inversion_marketing"] == D(6)


def test_profitability_without_samples_is_null_and_first(small_fact):
    found = rows(live.profitability(small_fact, "linea"))
    assert found[0]["rentabilidad_real_neta"] is None and found[0]["dimension"] in ("", "B")
    assert found[-1]["dimension"] == "A" and found[-1]["costo_muestras"] == D(6)


def test_breakeven_without_sales_has_no_row(small_fact):
    assert rows(earlier.breakeven_point(small_fact, 100, "2030-01-01")) == []
    only, = rows(earlier.breakeven_point(small_fact, 100, "2024-01-01", "2024-01-31"))
    assert only["punto_equilibrio_pesos"] == pytest.approx(100 / (1 - 12 / 30))


def test_pareto_share_keeps_at_least_one(make_fact):
    lines = [dict(cliente=c, importe=m, cantidad=0, pr_costo_uni_neto=0) for c, m in
             [(1, 50), (2, 30), (3, 20), (4, -5)]]
    only, = rows(earlier.pareto_share(make_fact(*lines)))
    assert only["concentracion_pareto_20_pct"] == pytest.approx(50.0)


def test_empty_period_gives_no_groups(small_fact):
    assert rows(run_indicator(small_fact, "ganancia_por_categoria", fechaInicio="2030-01-01")) == []


def test_the_largest_leaks_are_shown(make_fact):
    """More groups than any default limit; the least profitable ones leak most."""
    rows = [dict(cod_ven=n, importe=100, facturacion=100, cmv=10, d1=n, cantidad=1, fecha="2024-01-10", idunica=str(n)) for n in range(40)]
    rows += [dict(cod_ven=n, importe=0, facturacion=0, cmv=1, d1=0, cantidad=1, fecha="2024-01-10", idunica=f"m{n}") for n in range(40)]
    from invoicelens.operators import tools_live
    shown = [r["dimension"] for r in tools_live.leak_measure(make_fact(*rows), "vendedor").collect()]
    assert shown == list(range(39, -1, -1))
    assert [r["dimension"] for r in tools_live.leak_measure(make_fact(*rows), "vendedor", limit=3).collect()] == [39, 38, 37]
