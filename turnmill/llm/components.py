"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.llm.scratch import materialise

MAX_ROUNDS = 50


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; the root is the component's least node.

    ``edges`` has LONG columns ``a`` and ``b``.  Each round points every node at
    the least neighbour it knows; the table shrinks to stars in a number of
    rounds that follows the logarithm of a component's size.  Minima are
    aggregated before each shuffle, so a hub is no single task's work, and each
    round is a written table.
    """
    edges = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "edges")
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
    mark = state(edges)
    for _ in range(MAX_ROUNDS):
        both = edges.union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))  # v has the neighbour u
        least = both.groupBy("v").agg(F.min("u").alias("m")).withColumn("m", F.least("m", "v"))
        large = both.join(least, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).union(least.select("v", F.col("m").alias("u")))
        edges = materialise(small.filter("v <> u").distinct(), "edges")
        now = state(edges)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).union(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
