import csv
import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from invoicelens.operators import audit
from invoicelens.plans.params import MONTH, between_days
from invoicelens.schema import HEADER_COLUMNS, WORKBOOK_COLUMNS
from invoicelens.sources import loads, store, workbook as book
from invoicelens.streaming.incremental import load_new_files


def write_csv(path, rows, columns=WORKBOOK_COLUMNS):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="") as out:
        writer = csv.writer(out)
        writer.writerow(columns)
        for row in rows:
            writer.writerow([row.get(c, "") for c in columns])
    return str(path)


def line(comprobante, articulo, **more):
    return {"cliente": "1", "fecha": "2024-01-05", "comprobante": comprobante, "articulo": articulo, "art": "7",
            "idunica": f"{comprobante}-{articulo}", "importe": "10.5", "cantidad": "2", "cod_ven": "3", **more}


ROWS = [
    line("F1", "a", importe="1"), line("F1", "a", importe="2"), line("F1", "b"), line("F2", "a", fecha="2024-02-05"),
    line("F3", ""), line("F3", ""), line("F4", "a", idunica=""), line("F5", "a", cliente="x1"),
    line("F6", "a", fecha="mal"), line("F7", "a", cantidad="12 u."), line("F8", "a", importe="1e30"),
]


def test_load_and_reload(spark, tmp_path):
    path = str(tmp_path / "fact")
    store.create_fact(spark, path)
    raw = book.read_workbook(spark, write_csv(tmp_path / "in" / "m.csv", ROWS))
    report = loads.load_sales(raw, path).first().asDict()
    assert (report["totalRows"], report["insertedRows"], report["skippedRows"], report["rejectedRows"]) == (11, 6, 1, 4)
    stored = {(r["comprobante"], r["articulo"]): r for r in store.read_fact(spark, path).collect()}
    assert stored[("F1", "a")]["importe"] == D(1)
    assert stored[("F7", "a")]["cantidad"] == D(12) and stored[("F7", "a")]["fecha"] == dt.date(2024, 1, 5)
    assert stored[("F1", "a")]["metadata"] == "{}" and stored[("F1", "a")]["created_at"] is not None
    again = loads.load_sales(raw, path).first()
    # The two rows without a product never conflict, but the same load doesn't bring them again.
    assert again["insertedRows"] == 0 and again["skippedRows"] == 7
    assert store.row_count(store.read_fact(spark, path)).first()[0] == 6
    another = loads.load_sales(raw, path, load_id="another").first()
    assert another["insertedRows"] == 2 and another["skippedRows"] == 5
    assert store.row_count(store.read_fact(spark, path)).first()[0] == 8


def test_a_load_that_died_is_completed(spark, tmp_path):
    """Of five equal rows without a product two were stored when the load died: three are missing."""
    path = str(tmp_path / "fact")
    store.create_fact(spark, path)
    raw = book.read_workbook(spark, write_csv(tmp_path / "m.csv", [line("F1", "")] * 5 + [line("F1", "a"), line("F2", "", importe="3")]))
    good = book.accepted(book.positional_rows(raw)).select(*WORKBOOK_COLUMNS)
    left = good.filter("comprobante = 'F1' AND articulo IS NULL").limit(2).unionByName(good.filter("articulo = 'a'"))
    store.append_fact(left.withColumn("carga", F.lit("night")), path)
    report = loads.load_sales(raw, path, load_id="night").first()
    assert (report["insertedRows"], report["skippedRows"]) == (4, 3)
    counts = {(r["comprobante"], r["articulo"]): r["count"] for r in store.read_fact(spark, path).groupBy("comprobante", "articulo").count().collect()}
    assert counts == {("F1", None): 5, ("F1", "a"): 1, ("F2", None): 1}


def test_the_input_is_read_once(spark, tmp_path):
    path = str(tmp_path / "fact")
    store.create_fact(spark, path)
    raw = book.read_workbook(spark, write_csv(tmp_path / "m.csv", ROWS))
    seen = spark.sparkContext.accumulator(0)

    def passing(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    loads.load_sales(raw.drop(book.ORDER).mapInArrow(passing, raw.drop(book.ORDER).schema).withColumn(
        book.ORDER, F.struct(F.monotonically_increasing_id())), path)
    assert seen.value == len(ROWS)


def test_nothing_to_load(spark, tmp_path):
    path = str(tmp_path / "fact")
    store.create_fact(spark, path)
    raw = book.read_workbook(spark, write_csv(tmp_path / "m.csv", []))
    report = loads.load_sales(raw, path).first()
    assert (report["totalRows"], report["insertedRows"], report["skippedRows"], report["rejectedRows"]) == (0, 0, 0, 0)
    assert store.read_fact(spark, path).count() == 0


def test_a_table_of_the_catalogue(spark, tmp_path, small_fact):
    store.create_table(spark, "ventas_prueba", str(tmp_path / "table"))
    store.append_table(small_fact, "ventas_prueba")
    store.append_table(small_fact.filter("cliente = 1"), "ventas_prueba")
    store.analyse_table(spark, "ventas_prueba")
    table = spark.table("ventas_prueba")
    assert table.count() == small_fact.count() + 3 and table.filter("created_at IS NULL").count() == 0
    plan = between_days(table, "2024-02-01", "2024-02-28")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(" + MONTH in plan
    facts = {r[0]: r[1] for r in spark.sql("DESCRIBE EXTENDED ventas_prueba cliente").collect()}
    assert facts["distinct_count"] == "3" and facts["num_nulls"] == "1"
    store.create_table(spark, "ventas_prueba", str(tmp_path / "table"))
    assert spark.table("ventas_prueba").count() == 0


def test_reasons(spark, tmp_path):
    raw = book.read_workbook(spark, write_csv(tmp_path / "m.csv", ROWS))
    bad = {r["comprobante"]: r["motivo_rechazo"] for r in book.rejected(book.positional_rows(raw)).collect()}
    assert bad == {"F4": "missing idunica", "F5": "unreadable cliente", "F6": "unreadable fecha", "F8": "unreadable importe"}


def test_conversions_run_once(spark, tmp_path):
    """The filter on the reason stays above the conversions."""
    raw = book.read_workbook(spark, write_csv(tmp_path / "m.csv", ROWS))
    good = book.accepted(book.positional_rows(raw))
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    first = next(l for l in plan.splitlines() if "Filter" in l)
    assert "regexp" not in first


def test_plain_append_keeps_everything(spark, tmp_path):
    raw = book.read_workbook(spark, write_csv(tmp_path / "m.csv", ROWS))
    rows = {r["comprobante"]: r for r in book.rows_as_they_come(raw).collect()}
    assert len(book.rows_as_they_come(raw).collect()) == len(ROWS)
    assert rows["F4"]["idunica"] is None and rows["F6"]["fecha"] is None


def test_file_order_decides(spark, tmp_path):
    write_csv(tmp_path / "in" / "a.csv", [line("F1", "a", importe="1")])
    write_csv(tmp_path / "in" / "b.csv", [line("F1", "a", importe="2")] + [line(f"X{i}", "a") for i in range(50)])
    rows = book.positional_rows(book.read_workbook(spark, str(tmp_path / "in")))
    store.create_fact(spark, str(tmp_path / "fact"))
    fresh = loads.new_sales(rows, store.read_fact(spark, str(tmp_path / "fact")))
    assert fresh.filter("comprobante = 'F1'").first()["importe"] == D(1) and fresh.count() == 51


def test_headed_rows(spark, tmp_path):
    names = [h for h in HEADER_COLUMNS if h != "linea"]
    base = {"Cliente": "1.5", "Comprobante": " F1 ", "Cantidad": "-2.5", "Importe": "3.25", "Fecha": "2024-01-01"}
    path = write_csv(tmp_path / "h.csv", [base, {**base, "Comprobante": " "}, {**base, "Cliente": "0.2"}], names)
    only, = book.headed_rows(book.read_headed_workbook(spark, path)).collect()
    assert (only["Cliente"], only["Comprobante"], only["Cantidad"], only["Importe"]) == (2, "F1", -2, D("3.25"))
    assert only["linea"] is None and only["motivodev"] is None and only["descuento"] == 0


def test_headers_of_each_file(spark, tmp_path):
    cells = {"Comprobante": "F1", "Cliente": "7", "Importe": "20", "otra": 'x "y", z'}
    write_csv(tmp_path / "in" / "a.csv", [cells], ["Comprobante", "Cliente", "Importe"])
    write_csv(tmp_path / "in" / "b.csv", [{**cells, "Comprobante": "F2"}] * 2, ["otra", "Importe", "Comprobante", " Cliente "])
    (tmp_path / "in" / "b.csv").write_text((tmp_path / "in" / "b.csv").read_text().replace('z",20,F2,', 'z",20,F2,7'))
    (tmp_path / "in" / "c.csv").write_text("\ufeffCliente,Comprobante,Cliente\n7,F3,9\n\n")
    (tmp_path / "in" / "d.csv").write_text("")
    rows = book.headed_rows(book.read_headed_workbook(spark, str(tmp_path / "in"))).collect()
    got = sorted((r["Comprobante"], r["Cliente"], r["Importe"]) for r in rows)
    assert got == [("F1", 7, D(20)), ("F2", 7, D(20)), ("F2", 7, D(20)), ("F3", 7, D(0))]


def test_dimension_upserts(spark):
    old = spark.createDataFrame([(1, "uno", "calle", "x", "s", dt.datetime(2020, 1, 1)), (2, "dos", None, None, None, dt.datetime(2020, 1, 1))],
                                "cliente_id int, razon_social string, direccion string, subcanal string, segmento string, updated_at timestamp_ntz")
    new = spark.createDataFrame([(1, None, None, "y", None), (3, "tres", None, None, None)],
                                "cliente_id int, razon_social string, direccion string, subcanal string, segmento string")
    now = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz")
    got = {r["cliente_id"]: tuple(r)[1:] for r in loads.upsert_dimension("dim_cliente", old, new, now).collect()}
    assert got[1] == (None, "calle", "y", "s", dt.datetime(2024, 1, 1))
    assert got[2] == ("dos", None, None, None, dt.datetime(2020, 1, 1))
    assert got[3][0] == "tres" and len(got) == 3
    routes_old = spark.createDataFrame([(1, 5, 6)], "reparto_id int, camion int, chofer_id int")
    routes_new = spark.createDataFrame([(1, 9, None)], "reparto_id int, camion int, chofer_id int")
    assert [tuple(r) for r in loads.upsert_dimension("dim_ruta", routes_old, routes_new).collect()] == [(1, 9, None)]
    sellers = loads.upsert_dimension("dim_vendedor", spark.createDataFrame([(1,)], "cod_ven int"),
                                     spark.createDataFrame([(1,), (2,)], "cod_ven int"))
    assert sorted(r[0] for r in sellers.collect()) == [1, 2]


def test_first_row_of_the_file_names_the_dimension(spark):
    rows = spark.createDataFrame([(1, "b", 0, 2), (1, "a", 5, 1), (2, "c", 3, 3)],
                                 "Art int, articulo string, peso int, orden_archivo int").selectExpr(
        "*", "'l' linea", "1 rubro", "'d' descripcion", "1.0 capacidad_art")
    got = {r["art_id"]: (r["nombre"], r["peso_unitario_g"]) for r in loads.dimension_rows(rows, "dim_articulo").collect()}
    assert got == {1: ("a", 5), 2: ("c", 3)}


def test_reconciliation(spark, tmp_path):
    good = [r for r in ROWS if r["comprobante"] in ("F1", "F2") and r["importe"] != "2"]
    raw = book.read_workbook(spark, write_csv(tmp_path / "m.csv", good))
    table = book.accepted(book.positional_rows(raw))
    assert {r["estado"] for r in audit.reconcile(raw, table).collect()} == {"OK"}
    off = audit.reconcile(raw, table.withColumn("importe", F.col("importe") + F.lit("0.005").cast("decimal(18,4)")))
    states = {r["campo"]: (r["estado"], r["diferencia"]) for r in off.collect()}
    assert states["IMPORTE"] == ("ERROR", D("-0.0150")) and states["COUNT"][0] == "OK"


def test_month_pruning(spark, tmp_path, small_fact):
    path = str(tmp_path / "fact")
    store.replace_fact(small_fact, path)
    pruned = between_days(store.read_fact(spark, path), "2024-02-01", "2024-02-28")
    assert pruned.count() == 3
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(" + MONTH in plan and "PushedFilters: [IsNotNull(fecha)" in plan


def test_incremental_files(spark, tmp_path):
    path, progress, folder = str(tmp_path / "fact"), str(tmp_path / "progress"), tmp_path / "in"
    store.create_fact(spark, path)
    write_csv(folder / "1.csv", [line("F1", "a"), line("F1", "a")])
    assert load_new_files(spark, str(folder), path, progress).awaitTermination(120)
    write_csv(folder / "2.csv", [line("F1", "a"), line("F2", "a")])
    assert load_new_files(spark, str(folder), path, progress).awaitTermination(120)
    assert sorted(r["comprobante"] for r in store.read_fact(spark, path).collect()) == ["F1", "F2"]
