"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _done(edges: DataFrame) -> bool:
    """Whether the edges are stars: every node has one least neighbour at most, which has none itself."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("top")), F.struct(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("top")))).alias("e"))
    nodes = ends.groupBy("e.n").agg(F.sum("e.up").alias("up"), F.max("e.top").alias("top"))
    return nodes.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("top") > 0))).limit(1).count() == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root): a row per node of the edges (a, b), columns of one type that has an order; root is the least node of its component.

    Every round keeps each node's least neighbour only, by two joins on nodes; a node with very many neighbours
    is one row on the aggregated side, and its edges are on the side that AQE splits. Rounds grow with the
    logarithm of the longest path. Each round's edges are a table in the shared folder. No edges, no rows;
    repeated edges and loops count for nothing.
    """
    apart = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = stored(apart.distinct(), "edges")
    while not _done(now):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
        small = large.join(least, F.col("u") == F.col("n")).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = stored(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        discard(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
