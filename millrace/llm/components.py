"""Connected components by alternating stars, in joins and grouped minima.

Each round turns every node's neighbours into a star around the smallest of them, first
towards smaller ones among the larger (large star), then among the smaller (small star).
After some rounds, about the logarithm of the longest path, each component is one star
around its smallest node. A node's neighbours are never gathered: only their minimum is,
and that is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import written


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for each node of ``edges (a, b)``: the smallest node reachable.

    The two columns have one orderable type. Edges with a null or of a node to itself are
    left out, and so are nodes that have no other. Each round is written to the shared folder.
    """
    pairs = edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    stars = written(pairs.distinct(), "stars")
    while not _are_stars(stars):
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = moved.unionByName(least.withColumnRenamed("m", "b"))
        stars = written(small.distinct(), "stars")
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour and no larger, or only larger ones."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"))
    )
    of_node = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return not of_node.agg(F.bool_or(F.expr("ups > 1 or (ups = 1 and least = 0)"))).first()[0]
