"""Stored chunk vectors, in buckets of neighbouring chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from invoicelens.schema import vector_schema
from invoicelens.session import discard, materialise
from invoicelens.sources.partitions import BUCKET, bucket_of, read_stored, replace_partitions, touched

KEY = ("source", "chunkIndex")
# Part of the stored layout. A bucket holds runs of chunks of one source: a published document touches one bucket per run,
# and a source with a third of all chunks still spreads over all buckets.
BUCKETS, RUN = 256, 1024


def _keys() -> list:
    return [F.col(f"metadata.{k}").alias(f"_{k}") for k in KEY]


def _bucket() -> Column:
    return bucket_of([F.col("metadata.source"), F.floor(F.col("metadata.chunkIndex") / RUN)], BUCKETS)


def upsert_vectors(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored vectors with those of ``incoming`` added; an equal (source, chunkIndex) is replaced.

    A key that comes more than once in ``incoming`` is taken once, with the largest text and vector. Only the keys of the
    incoming side take part in the join.
    """
    one = F.max(F.struct("metadata.text", "vector", "metadata")).alias("one")
    incoming = incoming.groupBy(*_keys()).agg(one).select("one.vector", "one.metadata")
    keys = incoming.select(*_keys())
    named = [f"_{k}" for k in KEY]
    kept = stored.withColumns({f"_{k}": F.col(f"metadata.{k}") for k in KEY}).join(keys, named, "left_anti")
    return kept.drop(*named).unionByName(incoming)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Write whole buckets: those that ``vectors`` fall in hold exactly these afterwards, others stay as they are."""
    replace_partitions(vectors.withColumn(BUCKET, _bucket()), path, [BUCKET])


def _read(spark: SparkSession, path: str) -> DataFrame:
    return read_stored(spark, path, vector_schema().add(BUCKET, "integer"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path).drop(BUCKET)


def publish_vectors(incoming: DataFrame, path: str) -> None:
    """Add ``incoming`` to the store at ``path``; equal keys are replaced.

    Only the buckets of the incoming keys are read and written. The incoming rows are written to the shared folder once,
    since they may be costly to make and are read for their buckets and for the rows. A batch without rows changes nothing.
    """
    incoming = materialise(incoming.select("vector", "metadata"))
    stored = _read(incoming.sparkSession, path).filter(touched(incoming, _bucket())).drop(BUCKET)
    write_vectors(upsert_vectors(stored, incoming), path)
    discard(incoming)
