"""Cosine search for a table of queries, over stored vectors partitioned by their nearest centre.

The centres are fitted on a bounded sample; every vector is in the index, under the centre that its direction is closest to.
A query looks at the rows of its ``probes`` closest centres, or at all rows, which makes the search exact.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

SAMPLE, ROUNDS, MOST_CENTRES = 20_000, 10, 4096
# Rows and queries that one task compares at a time, and queries whose scores it holds at once.
BLOCK, SLICE = 8192, 256
CENTRE = "centro"
# Scores are compared at this many decimals, so that equal vectors tie wherever they are scored.
DECIMALS = 9


def _direction_finder():
    """A function from vectors to the places of those that have a direction, and these as rows of length 1.

    It is made anew, so that tasks get it with the functions that use it and need not import this package.
    """
    def directions(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        wide = [i for i, v in enumerate(vectors) if v is not None and len(v) > 0]
        if not wide:
            return np.array([], dtype=int), np.zeros((0, 0))
        matrix = np.array([vectors.iloc[i] for i in wide], dtype=np.float64)
        length = np.sqrt((matrix * matrix).sum(axis=1))
        good = np.isfinite(length) & (length > 0)
        return np.array(wide)[good], matrix[good] / length[good, None]

    return directions


def fit_centres(vectors: DataFrame, keys: Sequence[str], count: int = 64, embedding: str = "embedding",
                sample: int = SAMPLE) -> np.ndarray:
    """At most ``count`` centres of length 1, by k-means over the directions of at most ``sample`` vectors.

    The sample is taken by a hash of the key, so it doesn't depend on files or partitions. A threshold on the hash, from the
    number of rows, keeps what reaches the driver near the sample's size.
    """
    if not 0 < count <= MOST_CENTRES:
        raise ValueError(f"count must be between 1 and {MOST_CENTRES}")
    place = F.pmod(F.xxhash64(*keys), F.lit(1 << 40))
    part = min(1.0, 1.2 * sample / max(vectors.count(), 1))
    chosen = vectors.select(place.alias("at"), *keys, embedding).filter(F.col("at") <= int(part * (1 << 40)))
    _, points = _direction_finder()(chosen.orderBy("at", *keys, embedding).limit(sample).select(embedding).toPandas()[embedding])
    if len(points) == 0:
        return np.zeros((0, 0))
    first = np.sort(np.unique(points, axis=0, return_index=True)[1])[:count]
    centres = points[first]
    for _ in range(ROUNDS):
        nearest = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        length = np.sqrt((sums * sums).sum(axis=1))
        centres = np.where(length[:, None] > 0, sums / np.maximum(length, 1e-300)[:, None], centres)
    return centres


def closest_centres(centres: np.ndarray, probes: int = 1):
    """A pandas UDF from vectors to the numbers of their closest centres; none for a vector without direction."""
    directions = _direction_finder()

    @F.pandas_udf("array<int>")
    def closest(vectors: pd.Series) -> pd.Series:
        found: list = [[] for _ in range(len(vectors))]
        places, rows = directions(vectors)
        if len(places) and len(centres):
            order = np.argsort(-(rows @ centres.T), axis=1, kind="stable")[:, :probes]
            for place, numbers in zip(places, order.tolist()):
                found[place] = numbers
        return pd.Series(found)

    return closest


def _assigned(vectors: DataFrame, centres: np.ndarray, embedding: str) -> DataFrame:
    number = F.get(closest_centres(centres)(F.col(embedding)), F.lit(0))
    return vectors.withColumn(CENTRE, F.coalesce(number, F.lit(-1)))


def write_index(vectors: DataFrame, path: str, centres: np.ndarray, embedding: str = "embedding") -> None:
    """Store every vector under its centre, and the centres beside them. Vectors without direction are kept under -1."""
    spark = vectors.sparkSession
    table = [(i, [float(x) for x in row]) for i, row in enumerate(centres)]
    spark.createDataFrame(table, f"{CENTRE} int, vector array<double>").write.mode("overwrite").parquet(f"{path}/centros")
    # A partitioned table without rows has no file to tell its columns.
    vectors.filter(F.lit(False)).coalesce(1).write.mode("overwrite").parquet(f"{path}/columnas")
    _write(_assigned(vectors, centres, embedding), path, "overwrite")


def add_to_index(vectors: DataFrame, path: str, embedding: str = "embedding") -> None:
    """Append vectors under the centres of the index; a key that it already has is not looked for."""
    _write(_assigned(vectors, read_centres(vectors.sparkSession, path), embedding), path, "append")


def _write(rows: DataFrame, path: str, mode: str) -> None:
    rows.hint("rebalance", CENTRE).write.mode(mode).partitionBy(CENTRE).parquet(f"{path}/filas")


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Every row of the index, with the number of its centre."""
    schema = spark.read.parquet(f"{path}/columnas").schema.add(CENTRE, "integer")
    return spark.read.schema(schema).parquet(f"{path}/filas")


def read_centres(spark: SparkSession, path: str) -> np.ndarray:
    """The centres, at most ``MOST_CENTRES`` rows."""
    return np.array([r["vector"] for r in spark.read.parquet(f"{path}/centros").orderBy(CENTRE).collect()])


def search_index(spark: SparkSession, path: str, queries: DataFrame, query_key: str, keys: Sequence[str], top_k: int = 10,
                 probes: int | None = None, embedding: str = "embedding") -> DataFrame:
    """(query_key, rank, keys, score): the ``top_k`` closest rows of each query; ties go to the smaller keys.

    ``queries`` has ``query_key``, unique, and ``embedding``; it may have any number of rows. ``probes`` is the number of
    centres whose rows a query is held against; None takes all and is exact. Rows of a centre and queries meet in blocks of
    bounded size, so neither a centre with a third of all rows nor many queries gather in one task. Each block gives at most
    ``top_k`` rows per query. Queries and rows without direction are left out.
    """
    centres = read_centres(spark, path)
    asked = queries.select(F.col(query_key).alias("_query"), F.col(embedding).alias("_wanted"))
    looked_at = closest_centres(centres, len(centres) if probes is None else probes)(F.col("_wanted"))
    probed = [r[0] for r in asked.select(F.explode(looked_at).alias(CENTRE)).distinct().collect()]
    rows = read_rows(spark, path).filter(F.col(CENTRE).isin(probed)).select(*keys, embedding, CENTRE)
    blocks = {r[CENTRE]: -(-r["count"] // BLOCK) for r in rows.groupBy(CENTRE).count().collect()}
    groups = max(-(-asked.count() // BLOCK), 1)

    # Blocks of rows by their place in the scan, which a task that runs again finds unchanged.
    found = rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_block", F.pmod("_at", _of_centre(blocks)))
    found = found.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).drop("_at")
    asked = asked.withColumn("_group", F.pmod(F.xxhash64("_query"), F.lit(groups)).cast("int"))
    asked = asked.withColumn(CENTRE, F.explode(looked_at))
    asked = asked.withColumn("_block", F.explode(F.when(_of_centre(blocks) > 0, F.sequence(F.lit(0).cast("bigint"), _of_centre(blocks) - 1))))
    meeting = [CENTRE, "_block", "_group"]
    key_fields = [f for f in rows.schema if f.name in keys]
    schema = StructType([asked.schema["_query"], *key_fields]).add("score", "double")
    best = asked.groupBy(*meeting).cogroup(found.groupBy(*meeting)).applyInPandas(
        _best_of_block(list(keys), embedding, top_k), schema)
    order = Window.partitionBy("_query").orderBy(F.col("score").desc(), *keys)
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)
    return ranked.select(F.col("_query").alias(query_key), "rank", *keys, "score")


def measured_recall(spark: SparkSession, path: str, queries: DataFrame, query_key: str, keys: Sequence[str],
                    probes: int, top_k: int = 10, embedding: str = "embedding") -> float | None:
    """The part of the exact results that a search with ``probes`` centres finds; None where there are no results.

    How many centres are needed depends on how the vectors lie, so measure it with some queries before choosing.
    """
    exact, some = (search_index(spark, path, queries, query_key, keys, top_k, p, embedding).select(query_key, *keys)
                   for p in (None, probes))
    hit = exact.join(some.withColumn("_hit", F.lit(1.0)), [query_key, *keys], "left")
    return hit.agg(F.avg(F.coalesce("_hit", F.lit(0.0)))).first()[0]


def _of_centre(blocks: dict[int, int]) -> Column:
    """The number of blocks of a row's centre; 0 for a centre without rows."""
    if not blocks:
        return F.lit(0).cast("bigint")
    known = F.create_map(*[F.lit(number) for pair in blocks.items() for number in pair])
    return F.coalesce(F.try_element_at(known, F.col(CENTRE)), F.lit(0)).cast("bigint")


def _best_of_block(keys: list[str], embedding: str, top_k: int):
    directions = _direction_finder()

    def best(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(keys, kind="stable", ignore_index=True)
        at_row, matrix = directions(rows[embedding])
        at_query, wanted = directions(asked["_wanted"])
        picked: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for start in range(0, len(at_query) if len(at_row) else 0, SLICE):
            scores = np.round(wanted[start:start + SLICE] @ matrix.T, DECIMALS)
            for i, line in enumerate(scores):
                least = np.partition(line, -top_k)[-top_k] if len(line) > top_k else -np.inf
                candidates = np.flatnonzero(line >= least)
                chosen = candidates[np.argsort(-line[candidates], kind="stable")[:top_k]]
                picked.append((np.full(len(chosen), at_query[start + i]), at_row[chosen], line[chosen]))
        if not picked:
            picked.append((np.array([], dtype=int), np.array([], dtype=int), np.array([])))
        query, row, score = (np.concatenate(part) for part in zip(*picked))
        out = rows[keys].iloc[row].reset_index(drop=True)
        out.insert(0, "_query", asked["_query"].iloc[query].to_numpy())
        return out.assign(score=score)

    return best
