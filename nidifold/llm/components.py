"""Connected components of a graph whose edges lie in a DataFrame, by alternating large-star and small-star steps.

Every step is a minimum per node and a join; hot nodes are joined by a broadcast of the few of them. Nothing but counts
reaches the driver, and the number of steps grows with the logarithm of the graph's size. A step's tables are deleted when
the next one's are written, and edges that are stars already take no step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, last_kept, staged


def _star(edges: DataFrame, large: bool, label: str) -> DataFrame:
    """One step. Large: each node's greater neighbours are linked to the least of the node and its neighbours (an edge may
    come again). Small: the node and its lesser neighbours are."""
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = edges.select(F.inline(ways)) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n")), f"{label}-least")
    joined = join_counted(both, least, ["a"], "n", edges.count() * (2 if large else 1))
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return staged(out.filter(F.col("a") != F.col("b")), label)
    out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return staged(out.filter(F.col("a") != F.col("b")).distinct(), label)


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node has one edge to a lesser node, or edges to greater ones only. ``edges`` (a > b) are distinct."""
    ends = F.array(*[F.struct(F.col(x).alias("node"), F.lit(up).alias("up")) for x, up in (("a", 1), ("b", 0))])
    each = edges.select(F.inline(ends)).groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return not each.filter("up > 1 OR (up = 1 AND least = 0)").count()


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least reachable node) for each node with an edge; ``edges`` has columns a and b of one type."""
    spark = edges.sparkSession
    with last_kept(spark):
        edges = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct(), "edges")
        # At the end each node has one edge, to its component; then neither step changes anything.
        while not _are_stars(edges):
            with last_kept(spark):
                edges = _star(_star(edges, True, "large-star"), False, "small-star")
        own = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
        out = staged(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(own), "components")
    return out
