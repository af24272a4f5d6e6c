"""Connected components of an edge table, in rounds of star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Shelf


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least).distinct()


def components(edges: DataFrame, shelf: Shelf, name: str) -> DataFrame:
    """(node, root) for every node that has an edge to another; root is the smallest node of its component.

    ``edges`` has the columns a and b; loops and nulls are ignored. Each round is a few joins on
    node; the number of rounds grows with the logarithm of the longest path.
    """
    now = shelf.save(edges.filter("a != b").select("a", "b").distinct(), f"{name}-0")
    mark, step = None, 0
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or seen[0] == 0:
            break
        mark, step = seen, step + 1
        now = shelf.save(_small_star(_large_star(now)), f"{name}-{step}")
        shelf.drop(f"{name}-{step - 1}")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b"))).distinct()
