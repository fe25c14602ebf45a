"""Connected components by random contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.runtime import stored


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; nodes of one component share a root.

    In each round every node points to the neighbour (or itself) of the lowest random rank, and the
    edges are rewritten to what their ends point to. At least about half of the nodes that still
    have edges go in a round, whatever the shape of the graph, so rounds are logarithmic. A node's
    choice is a minimum with map-side combining: a hub with millions of edges is no hot group. Loops,
    repeated edges and both directions of an edge are allowed; edges with a null end are ignored.
    An empty input gives an empty result.
    """
    steps: list[DataFrame] = []
    left = stored(edges.filter("a <> b").select("a", "b").distinct())
    while not left.isEmpty():
        salt = len(steps)
        rank = lambda c: F.struct(F.xxhash64(F.lit(salt), F.col(c)).alias("r"), F.col(c).alias("n"))
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = stored(both.groupBy("a").agg(F.min(rank("b")).alias("best"))
                      .select("a", F.least(rank("a"), F.col("best"))["n"].alias("to")))
        steps.append(step)
        ends = left.join(step, "a").select(F.col("to").alias("x"), F.col("b").alias("a"))
        left = stored(ends.join(step, "a").select(F.col("x").alias("a"), F.col("to").alias("b"))
                      .filter("a <> b").distinct())
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = steps[0].select(F.col("a").alias("node"), F.col("to").alias("root"))
    for step in steps[1:]:
        step = step.select(F.col("a").alias("root"), F.col("to"))
        out = out.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return out
