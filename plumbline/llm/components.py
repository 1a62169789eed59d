"""Connected components of links, by alternating stars; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _least(edges: DataFrame) -> DataFrame:
    """(u, v, m): each link from either end with the least of u and its neighbours. Sums and joins, so that hot
    vertices are combined before the shuffle and split in the join."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u")


def large_star(edges: DataFrame) -> DataFrame:
    return _least(edges).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return joined.select(F.col("v").alias("a"), "m").union(joined.select(F.col("u").alias("a"), "m")).filter("a <> m").select(F.col("a").alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each end of an edge (u, v); root is the least node of the component."""
    now = common.materialize(edges.filter("u <> v").select("u", "v"), "edges")
    mark = None
    for _ in range(rounds):
        now = common.materialize(small_star(large_star(now)), "stars")
        stamp = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if stamp == mark:
            break
        mark = stamp
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
