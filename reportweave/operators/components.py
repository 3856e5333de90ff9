"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import materialize


def ordered_edges(edges: DataFrame) -> DataFrame:
    """(u, v) with u >= v of edges(a, b), each once."""
    both = edges.filter("a is not null and b is not null")
    return both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def star_roots(now: DataFrame, cut: Callable[[DataFrame], DataFrame] = materialize, max_rounds: int = 60) -> DataFrame:
    """(node, root) of ordered_edges that have been written."""
    for _ in range(max_rounds):
        inner = now.filter("u <> v")
        ends = inner.selectExpr("u", "1 as up", "0 as down").unionByName(inner.selectExpr("v as u", "0 as up", "1 as down"))
        if ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)").isEmpty():  # all trees are stars
            return inner.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        both = inner.unionByName(inner.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(now.filter("u = v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = cut(small.distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def connected_components(edges: DataFrame, cut: Callable[[DataFrame], DataFrame] = materialize, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges(a, b); root is the least node of the component.

    Nodes are of any type that can be ordered and compared. Each round relinks every node to the least of its
    neighbours, first among the larger ones, then among the smaller ones; the forest is a set of stars after a
    number of rounds logarithmic in the longest path. `cut` writes a round's edges to reliable storage; minima are
    aggregated before they are shuffled, so a hub's neighbours never gather in one task. Self-loops add their node.
    """
    return star_roots(cut(ordered_edges(edges)), cut, max_rounds)
