"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _with_least(pairs: DataFrame) -> DataFrame:
    """``(u, v)`` with the least of ``u`` and its ``v``. Pre-aggregated, then joined, so a hub is no single task."""
    least = pairs.groupBy("u").agg(F.min("v").alias("least"))
    return pairs.join(least, "u").withColumn("least", F.least("u", "least"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    marked = _with_least(down)
    linked = marked.select(F.col("v").alias("u"), F.col("least").alias("v")).union(marked.select("u", F.col("least").alias("v")))
    return linked.where("u != v").distinct()


def roots(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of an edge list ``(u, v)``: the least node of its component.

    Two shuffled steps a round; the number of rounds grows with the logarithm of the longest chain. Edges between a
    node and itself and repeated edges are harmless. No edges give no rows.
    """
    edges = cut(edges.where("u != v").distinct())
    mark = None
    while True:
        edges = cut(_small_star(_large_star(edges)))
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
