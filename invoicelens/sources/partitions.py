"""Stored tables of which a job replaces only the partitions it has rows for.

Writes use Spark's dynamic partition overwrite: rows are staged first, and partitions are swapped when the whole job has
succeeded, so the rows may come from the table that is written. Files of other partitions are not touched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from invoicelens.session import COMPRESSION, exists, releasing_shuffles

BUCKET = "cubo"


def read_stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table at ``path``; no rows where nothing was ever written."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def replace_partitions(rows: DataFrame, path: str, partitions: Sequence[str]) -> None:
    """Write ``rows``; each partition that they fall in gets exactly them.

    The rebalance gathers a partition's rows in few files and splits a partition that is too large for one task.
    """
    writer = rows.hint("rebalance", *partitions).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    with releasing_shuffles(rows.sparkSession):
        writer.partitionBy(*partitions).option("compression", COMPRESSION).parquet(path)


def bucket_of(keys: Sequence[Column | str], buckets: int) -> Column:
    """The bucket of a key. Its number of buckets is part of a table's layout and never changes."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def touched(rows: DataFrame, bucket: Column) -> Column:
    """A condition on the stored bucket column: those that ``rows`` fall in, as constants, so that others aren't read."""
    numbers = [r[0] for r in rows.select(bucket).distinct().collect()]
    return F.col(BUCKET).isin(numbers)
