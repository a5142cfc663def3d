"""Global ranks without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from invoicelens.session import materialise


def with_row_number(rows: DataFrame, order: Sequence[Column], name: str = "rn", total: str = "n") -> DataFrame:
    """Add the 1-based position of each row in a total order, and the row count.

    ``order`` must be unique per row. The rows are range-partitioned on it, so equal leading
    values split on the later columns; each range is sorted where it lies and written once.
    Positions follow from the sizes of the ranges, which are one row per range.
    """
    placed = (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    placed = materialise(placed)
    part, offset = F.shiftright(F.col("_at"), 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    by_part = Window.orderBy("_part")
    starts = sizes.select(
        "_part",
        (F.sum("_size").over(by_part) - F.col("_size")).alias("_before"),
        F.sum("_size").over(Window.partitionBy()).alias(total),
    )
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_before") + offset + 1)
        .drop("_part", "_at", "_before")
    )


def tile(position: Column, count: Column, tiles: int) -> Column:
    """Tile number of a position: the first ``count % tiles`` tiles hold one row more."""
    small = F.floor(count / tiles)
    larger = F.pmod(count, F.lit(tiles))
    in_larger = larger * (small + 1)
    return F.when(
        position <= in_larger,
        F.floor((position - 1) / (small + 1)) + 1,
    ).otherwise(larger + F.floor((position - 1 - in_larger) / F.greatest(small, F.lit(1))) + 1).cast("int")


def with_tile(rows: DataFrame, order: Sequence[Column], name: str, tiles: int = 4) -> DataFrame:
    ranked = with_row_number(rows, order, "_rn", "_n")
    return ranked.withColumn(name, tile(F.col("_rn"), F.col("_n"), tiles)).drop("_rn", "_n")
