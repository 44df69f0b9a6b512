"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.tables import drop_table, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (or smaller) neighbours of each node on its smallest neighbour."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    met = both.join(least, "a")
    kept = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) if large else met.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return kept.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) of every node of the edges (a, b).

    Each step aggregates by node; no component is gathered anywhere. Converges in a number of steps that grows
    with the logarithm of the longest path. A null end or an edge to itself links nothing.
    """
    now = materialise(edges.select("a", "b").where("a <> b").distinct())
    mark = None
    while True:
        after = materialise(_star(_star(now, True), False))
        row = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_table(now)
        now = after
        if tuple(row) == mark:
            break
        mark = tuple(row)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())
