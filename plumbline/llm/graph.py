"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of the edges (a, b) of longs; comp is the component's smallest node.

    Each round names every node after the smallest neighbour of its smallest neighbour, then
    renames the ends of all edges and drops loops and repeats. A star or a dense group is one
    node after a round, a chain a fraction of its nodes, so edges vanish quickly; the smallest
    node of a component keeps its name throughout. Names are written between rounds; hubs only
    meet saved tables in plain equi-joins and aggregates with a map-side step, which Spark splits.
    """
    ends = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    loops = edges.where("a = b").select(F.col("a").alias("node"))
    left = saved(ends.where("a < b").distinct(), "edges")
    named = saved(left.select(F.col("a").alias("node")).union(left.select("b")).union(loops).distinct().select(
        "node", F.col("node").alias("comp")), "names")
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        up = saved(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("up")), "up")
        over = up.select(F.col("a").alias("up"), F.col("up").alias("top"))
        name = saved(up.join(over, "up").select("a", "top"), "top")
        first = name.select("a", F.col("top").alias("new_a"))
        second = name.select(F.col("a").alias("b"), F.col("top").alias("new_b"))
        new = left.join(first, "a").join(second, "b").where("new_a <> new_b")
        left = saved(new.select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b")).distinct(), "edges")
        named = saved(named.join(name.withColumnRenamed("a", "comp"), "comp", "left").select(
            "node", F.coalesce("top", "comp").alias("comp")), "names")
    return named
