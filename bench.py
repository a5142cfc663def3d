"""Times the headline queries and prints one JSON line.

The fact is published once as a table partitioned by month, as the stored table that every
query reads; its build is timed as ``publish_fact``. Each query then runs once to warm up and
five times for its median. Results go to the ``noop`` sink, so whole results are computed.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import DataFrame

from invoicelens import build_session, run_indicator
from invoicelens.operators import tools_earlier as earlier, tools_live as live, vectors
from invoicelens.plans.joins import insert_or_ignore
from invoicelens.schema import FACT_KEY
from invoicelens.sources import samples, store

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))
AS_OF = "2001-08-01"


def main() -> None:
    spark = build_session(
        "bench", f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS, spark__ui__enabled="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    path = tempfile.mkdtemp(prefix="run-") + "/fact"
    started = time.perf_counter()
    store.replace_fact(samples.sales_fact(spark, SF_DIR), path)
    timings = {"publish_fact": round(time.perf_counter() - started, 3)}
    fact = store.read_fact(spark, path)
    business = [c for c in fact.columns if c not in ("created_at", "metadata")]
    earlier_part = samples.stored_before(fact, "2000-01-01")

    queries = {
        "k01_rentabilidad_vendedor": lambda: run_indicator(fact, "rentabilidad_vendedor", limite=50),
        "k11_clientes_no_compran_marca": lambda: run_indicator(fact, "clientes_no_compran_marca", marca="Brand#2"),
        "k20_rfm_segmentacion": lambda: run_indicator(fact, "rfm_segmentacion", as_of=AS_OF, limite=50),
        "k12_clientes_campeones": lambda: run_indicator(fact, "clientes_campeones", limite=50),
        "k16_reactivacion_clientes": lambda: run_indicator(
            fact, "reactivacion_clientes", fechaInicio="2001-01-01", fechaFin="2001-06-30", limite=50),
        "k38_rendimiento_chofer": lambda: run_indicator(fact, "rendimiento_chofer", limite=50),
        "a6_sales_opportunities": lambda: live.sales_opportunities(fact, "2000-01-01", "2001-06-30"),
        "l4_ticket_promedio": lambda: earlier.mean_ticket(fact),
        "v1_fragmentos": lambda: vectors.chunk_documents(samples.table(spark, SF_DIR, "documents"), "doc_id", "text"),
        "v2_coseno_top_k": lambda: vectors.nearest(samples.table(spark, SF_DIR, "embeddings"), [1.0] * 64, ["vec_id"], 10),
        "l6_concentracion_pareto": lambda: earlier.pareto_share(fact),
        "i04_insertar_o_ignorar": lambda: insert_or_ignore(
            fact.select(*business), earlier_part, FACT_KEY, list(samples.FILE_ORDER)),
    }
    for name, build in queries.items():
        _timed(build)
        timings[name] = round(statistics.median(_timed(build) for _ in range(RUNS)), 3)
    print(json.dumps({
        "metric": "sum of the median query times", "unit": "sec",
        "value": round(sum(v for k, v in timings.items() if k != "publish_fact"), 3),
        "queries": timings, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(CPUS), "runs": RUNS,
        "settings": {"shuffle_partitions": CPUS, "adaptive": "true", "driver_memory": "12g"},
    }))


def _timed(build) -> float:
    started = time.perf_counter()
    frame: DataFrame = build()
    frame.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


if __name__ == "__main__":
    main()
