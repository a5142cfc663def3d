"""Exact top-k by inner product, with candidates ruled out by a table of distances to pivots.

Every vector is stored with its length and its distances to the pivots. By the triangle inequality the largest difference of
two vectors' distances to a pivot bounds their own distance from below, and with both lengths their inner product from above.
For each query the candidates of a batch are evaluated in the order of these bounds until the next bound is less than the
query's k-th best score so far. That score starts from a few other queries, which are candidates as well.

Queries are searched in blocks of bounded size: a block is sent to all tasks, and each task goes over its part of the
vectors once per block. Nothing else passes through the driver but a bounded sample, from which the pivots come; they
affect the order of evaluation only.

Defined results: vectors that are NULL, or hold a NULL or non-finite component, take no part. A shorter vector has zeros in
place of what it lacks; an empty one scores 0. Rows with one id are rows of their own, and a query leaves out its own row
only. A NULL id is no query and, as a candidate, comes last among ties. No rows give no rows. Only the two named columns are
read. A score beyond a long raises an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from invoicelens.session import materialise

from .batches import ship_package

SCALE = 1024
N_PIVOTS, PIVOT_SAMPLE = 32, 512
BLOCK_BYTES = 16 << 20
#: Queries of a block that give the first k-th best scores, and candidates evaluated at a time.
SEEDS, CHUNK = 256, 128
_LAST = np.iinfo(np.int64).max
#: Up to here sums of products of whole numbers are exact in doubles.
_EXACT = float(1 << 52)


def scaled(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (row, id, v): whole components as doubles, for the vectors that take part."""
    component = F.col("given")
    finite = ~F.exists(component, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    given = vectors.select(vectors[id_col].cast("bigint").alias("id"), vectors[vector_col].cast("array<double>").alias("given"))
    # From 2**52 on a double is whole already, and may be beyond the range of a long.
    whole = F.transform(component, lambda x: F.when(F.abs(x * SCALE) < _EXACT, F.floor(x * SCALE).cast("double")).otherwise(x * SCALE))
    return given.filter(component.isNotNull() & finite).select(F.monotonically_increasing_id().alias("row"), "id", whole.alias("v"))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """``count`` rows of ``sample``, each the farthest from those before it."""
    if not len(sample):
        return sample
    chosen, away = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(count, len(sample)):
        away = np.minimum(away, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
        chosen.append(int(away.argmax()))
    return sample[chosen]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of ``width`` components, zeros in place of those that lack."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.linalg.norm(rows - p, axis=1) for p in pivots], axis=1) if len(pivots) else np.zeros((len(rows), 0))


def with_distances(vectors: DataFrame, pivots: np.ndarray, width: int) -> DataFrame:
    """The vectors with ``length`` and ``apart``, their distances to the pivots."""
    def run(batches):
        for batch in batches:
            rows = _matrix(batch.column(2), width)
            away, lengths = distances(rows, pivots), np.linalg.norm(rows, axis=1)
            if not np.isfinite(lengths).all():
                raise ValueError("a score is beyond a long")
            starts = np.arange(len(rows) + 1, dtype=np.int32) * away.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(lengths),
                 pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(away.ravel()))],
                names=["row", "id", "v", "length", "apart"])

    return vectors.mapInArrow(run, "row bigint, id bigint, v array<double>, length double, apart array<double>")


def products(rows: np.ndarray, query: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products as whole numbers; beyond what doubles hold exactly, by unbounded integers."""
    if exact:
        return (rows @ query).astype(np.int64)
    whole = [int(x) for x in query]
    made = [sum(int(a) * b for a, b in zip(row, whole)) for row in rows]
    if any(abs(m) > _LAST for m in made):
        raise ValueError("a score is beyond a long")
    return np.array(made, np.int64)


class Block:
    """Queries with the k-th best score that each is known to reach."""

    def __init__(self, numbers, ids, rows, lengths, apart, k: int):
        self.numbers, self.ids, self.rows, self.lengths, self.apart, self.k = numbers, ids, rows, lengths, apart, k
        self.floor = np.full(len(numbers), -np.inf)
        longest = lengths.max(initial=0.0)
        if 1 < len(numbers) and longest * longest < _EXACT:
            seeds = min(SEEDS, len(numbers))
            scores = rows @ rows[:seeds].T
            scores[np.arange(seeds), np.arange(seeds)] = -np.inf
            if seeds > k:
                self.floor = np.sort(scores, axis=1)[:, -k]

    def search(self, numbers, ids, rows, lengths, apart) -> list[tuple[np.ndarray, ...]]:
        """For each query the best ``k`` of these candidates that may be among its best of all."""
        out, longest = [], lengths.max(initial=0.0)
        table = np.ascontiguousarray(apart.T)
        for q in range(len(self.numbers)):
            away = np.zeros(len(numbers))
            for p in range(len(table)):
                np.maximum(away, np.abs(table[p] - self.apart[q, p]), out=away)
            bound = (self.lengths[q] ** 2 + lengths ** 2 - away ** 2) / 2
            # Room for rounding in the distances; inner products are never above the product of the lengths.
            bound = np.minimum(bound, self.lengths[q] * lengths)
            bound += 1 + 1e-9 * (self.lengths[q] ** 2 + lengths ** 2)
            floor, exact = self.floor[q], self.lengths[q] * longest < _EXACT
            open_ = np.flatnonzero((bound >= floor) & (numbers != self.numbers[q]))
            open_ = open_[np.argsort(-bound[open_], kind="stable")]
            scores, at = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for start in range(0, len(open_), CHUNK):
                some = open_[start:start + CHUNK]
                if bound[some[0]] < floor:
                    break
                made = products(rows[some], self.rows[q], exact)
                scores, at = np.concatenate([scores, made]), np.concatenate([at, some])
                best = np.lexsort((ids[at], -scores))[:self.k]
                scores, at = scores[best], at[best]
                if len(scores) == self.k:
                    floor = max(floor, scores[-1])
            good = scores >= floor
            if good.any():
                out.append((np.full(good.sum(), self.numbers[q]), np.full(good.sum(), self.ids[q]), ids[at[good]], scores[good]))
        return out


def _columns(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
    ids = batch.column(1).fill_null(_LAST).to_numpy(zero_copy_only=False)
    apart = batch.column(4)
    away = apart.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return batch.column(0).to_numpy(), ids, _matrix(batch.column(2), width), batch.column(3).to_numpy(), away


def _search_block(stored: DataFrame, block: DataFrame, width: int, k: int) -> DataFrame:
    """Rows (row, query_id, vec_id, score): each task's best for the queries of one block."""
    spark = stored.sparkSession
    sent = spark.sparkContext.broadcast(block.toArrow().combine_chunks())
    schema = "row bigint, query_id bigint, vec_id bigint, score bigint"

    def run(batches):
        queries, held = None, []
        for batch in batches:
            if queries is None:
                table = sent.value.to_batches()
                queries = Block(*_columns(table[0], width), k) if table else None
                if queries is None:
                    return
            for row, query, vec, score in queries.search(*_columns(batch, width)):
                held.append((row, query, vec, score))
            if held:
                row, query, vec, score = (np.concatenate(c) for c in zip(*held))
                order = np.lexsort((vec, -score, row))
                row, query, vec, score = row[order], query[order], vec[order], score[order]
                starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                nth = np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)]))
                keep = nth < k
                held = [(row[keep], query[keep], vec[keep], score[keep])]
                # What this task has found is a floor for its later batches.
                full = np.flatnonzero(nth == k - 1)
                place = np.searchsorted(queries.numbers, row[full])
                queries.floor[place] = np.maximum(queries.floor[place], score[full])
        for row, query, vec, score in held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(row), pa.array(query), pa.array(vec, mask=vec == _LAST), pa.array(score)],
                names=["row", "query_id", "vec_id", "score"])

    return stored.mapInArrow(run, schema)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
          n_pivots: int = N_PIVOTS) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each query the ``k`` other rows of highest score, ties to the smaller id.

    ``is_query`` is a condition on ``id``.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    base = materialise(scaled(vectors, id_col, vector_col))
    size = base.agg(F.max(F.size("v")).alias("width"), F.count(F.when(is_query, 1)).alias("queries")).first()
    width, n_queries = size["width"] or 0, size["queries"]
    sample = base.orderBy(F.xxhash64("row"), "row").limit(PIVOT_SAMPLE).select("row", "id", "v").toArrow().combine_chunks()
    held = [_matrix(b.column(2), width) for b in sample.to_batches()]
    pivots = choose_pivots(held[0], n_pivots) if held else np.zeros((0, width))
    stored = materialise(with_distances(base, pivots, width))
    per_block = max(1, BLOCK_BYTES // (8 * (width + n_pivots + 4)))
    found = None
    for lowest, highest in _blocks(stored.filter(is_query), n_queries, per_block):
        block = stored.filter(is_query).filter(F.col("row").between(lowest, highest)).orderBy("row")
        part = _search_block(stored, block, width, k)
        part = part if n_queries <= per_block else materialise(part)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "row bigint, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _blocks(queries: DataFrame, count: int, per_block: int) -> list[tuple[int, int]]:
    """Ranges of row numbers that hold at most about ``per_block`` queries each."""
    if count == 0:
        return []
    parts = -(-count // per_block)
    if parts == 1:
        return [(0, _LAST)]
    # Twice as many cuts as needed, with the error of the quantiles below half a block.
    cuts = queries.approxQuantile("row", [i / (2 * parts) for i in range(1, 2 * parts)], 1 / (8 * parts))
    edges = sorted({int(c) for c in cuts})
    return list(zip([0, *[e + 1 for e in edges]], [*edges, _LAST]))
