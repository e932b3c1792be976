"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import drop_table, write_table


def _contracted(edges: DataFrame, both: DataFrame) -> DataFrame:
    """Large star: every larger neighbour of a node moves to the smallest node next to it; then the small star."""
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    large = both.join(least, F.col("a") == F.col("n")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    down = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
    joined = large.join(down, F.col("a") == F.col("n"))
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select(F.col("n").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected `edges` (a, b): root is the smallest node of its component.

    Each round writes its edges; it ends when they are stars that no round changes. Roots are included. The
    number of rounds grows with the logarithm of the longest path.
    """
    now = write_table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    mark = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == tuple(state):
            break
        mark = tuple(state)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        new = write_table(_contracted(now, both), "edges")
        drop_table(now)
        now = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
