"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, looked_up, stored

ROUNDS_MOST = 60


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node it is connected with) for every node that has an edge (a, b).

    Large star: every larger neighbour of a node is tied to the smallest node of its neighbourhood.
    Small star: a node and its smaller neighbours are tied to the smallest of them. Both keep the
    components, and repeated they leave one star for each, in a number of rounds that grows with the
    logarithm of a component's size. Each round is written to the shared folder, so the plan stays
    short and a lost executor costs one task. Minima are aggregated before the shuffle and looked up
    by node, hubs by broadcast, so the neighbours of a hub are never one task's group.
    """
    spark = edges.sparkSession
    now, path = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _signature(now)
    for _ in range(ROUNDS_MOST):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = looked_up(both, least, "a", "n", 2 * seen[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        tied = looked_up(large, small, "a", "n", seen[0])
        new = tied.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).distinct()
        after, after_path = stored(new, "edges")
        discard(spark, path)
        now, path = after, after_path
        if (is_now := _signature(now)) == seen:
            break
        seen = is_now
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
