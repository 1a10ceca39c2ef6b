"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleweave.operators.joins import skew_join
from tripleweave.session import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; the root is the smallest node reachable.

    Each round writes its edges as a table. Minima are taken per node before any join, and the joins are
    splittable, so that a node with very many neighbours is no bottleneck. The number of rounds grows with
    the logarithm of the component size. Self-loops and repeats are allowed; no edges give no rows.
    """
    now = cut(edges.select("a", "b").filter("a <> b").distinct())
    before = None
    while (state := _state(now)) != before:
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = skew_join(both.filter("b > a"), low, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        down = cut(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = skew_join(down, low, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        now = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
