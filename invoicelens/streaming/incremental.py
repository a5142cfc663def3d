"""The sales load over a folder that receives workbook files.

Each run takes the files that arrived since the last one, in micro-batches, through the same
insert-or-ignore load, and then stops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from invoicelens.schema import workbook_schema
from invoicelens.sources.loads import load_sales
from invoicelens.sources.workbook import ORDER


def load_new_files(spark: SparkSession, folder: str, fact_path: str, progress: str, files_per_batch: int = 100):
    """Start the run; ``progress`` is the folder that remembers which files were loaded."""
    rows = (
        spark.readStream.schema(workbook_schema())
        .option("header", True).option("maxFilesPerTrigger", files_per_batch)
        .csv(folder)
        .select("*", F.struct(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        ).alias("_file"))
    )

    def load(batch: DataFrame, batch_id: int) -> None:
        # A batch that is run again has the same number, so it adds nothing twice.
        place = F.struct("_file.file", "_file.block", F.monotonically_increasing_id().alias("row"))
        load_sales(batch.withColumn(ORDER, place).drop("_file"), fact_path, f"{progress}#{batch_id}")

    return (
        rows.writeStream.foreachBatch(load)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
