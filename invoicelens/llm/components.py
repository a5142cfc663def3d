"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from invoicelens.session import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for the nodes of ``edges`` (a, b); the component is its smallest node.

    Minima are taken with partial aggregation and joined back, so a node with very many neighbours never meets in one task.
    Each round is written to the shared folder. Loops and NULL ends are left out; no edges give no rows.
    """
    current = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                          .filter(F.col("a") != F.col("b")).distinct())
    while not _is_star(current):
        both = current.union(current.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Now every edge points to a smaller node.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        pointed = large.join(least, "a")
        small = pointed.select(F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b"))
        current = materialise(small.union(least.select("a", F.col("m").alias("b"))).distinct())
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def _is_star(edges: DataFrame) -> bool:
    """Whether each node points to one root: no root points on, and no node points twice."""
    roots = edges.select(F.col("b").alias("a"), F.lit(1).alias("of"))
    found = edges.select("a", F.lit(2).alias("of")).union(roots.distinct())
    return found.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
