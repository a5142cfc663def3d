"""Session settings the jobs are written for."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    # A larger limit sorts, instead of keeping that many rows of each task in memory.
    "spark.sql.execution.topKSortFallbackThreshold": "100000",
    # Plans are built from many small expressions; recording a call site for each is slow.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


COMPRESSION = "zstd"  # of the tables that are written
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app_name: str = "invoicelens", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@cache
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="invoicelens-")


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may go without that setting; it then gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder(spark.sparkContext.applicationId)


@contextmanager
def releasing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files of a query that has ended are deleted at once.

    Otherwise they stay on the executors' disks until the driver happens to collect garbage. Meant for writes: each plans its
    rows anew, so nothing reads its shuffles afterwards.
    """
    before = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(RELEASE)
        else:
            spark.conf.set(RELEASE, before)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The result survives the loss of any executor, and every later reader sees the same rows.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/invoicelens-{uuid.uuid4().hex}"
    with releasing_shuffles(spark):
        df.write.option("compression", COMPRESSION).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _place(spark: SparkSession, path: str) -> tuple:
    """A path and its file system, which may be a remote one."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, files = _place(spark, path)
    return files.exists(place)


def discard(table: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote and nothing reads any more."""
    folder = shared_folder(table.sparkSession)
    for path in {file.rpartition("/")[0] for file in table.inputFiles()}:
        if path.rpartition("/")[2].startswith("invoicelens-") and path.rpartition("/")[0].rpartition(":")[2].lstrip("/") == folder.rpartition(":")[2].lstrip("/"):
            place, files = _place(table.sparkSession, path)
            files.delete(place, True)
