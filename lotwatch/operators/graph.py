"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import release, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b) that have an edge to another: root is the least node reachable.

    Alternates large-star and small-star contraction until only stars are left; the rounds grow with the
    logarithm of the longest chain. Every round is aggregations and joins on the node, written to the
    shared folder, and the round before it is deleted.
    """
    state, table = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), None
    while True:
        state = written(state, "components")
        if table is not None:
            release(table)
        table = state
        # Done when every node is either a root or has one edge, to a root: one aggregation that begins in the tasks.
        ends = state.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(state.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty():
            out = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out._lotwatch_path = table._lotwatch_path
            return out
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
