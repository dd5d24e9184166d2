"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzline.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) for every node of `edges` (a, b bigint).

    Alternating large-star and small-star steps: every step replaces edges by edges to smaller
    nodes with the same components, and the edges do not grow in number. Groups are only
    aggregated to their minimum and joined back, so a hub's edges never meet in one task beyond
    Spark's own skew handling. Each round is written to the shared folder. The joins' sides are dealt
    alike already, so they are merged: a table broadcast in each of many rounds fills the driver's memory.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    while True:  # each round moves an edge to a smaller node, until none can move
        # large star: the larger neighbours of each node go to the smallest of all its neighbours
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small star: the smaller neighbours of each node, and itself, go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least.hint("merge"), "a")
        edges = materialize(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        # none can where each node is either a root, or has one edge in all, to a root
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).union(edges.select(F.col("b").alias("node"), F.lit(0).alias("up")))
        movable = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n")).where("up > 0 AND n > 1")
        if movable.agg(F.count("*")).first()[0] == 0:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots).distinct()
