"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm._common import discard, written

MAX_ROUNDS = 60


def _smallest(edges: DataFrame) -> DataFrame:
    """For each node u, the smallest of u and its neighbours (partial aggregation carries hot nodes)."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    hop = both.join(_smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hop.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _smallest(down)
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = low.select("u", F.col("m").alias("v"))
    return moved.union(own).where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(u, v) of longs, u <> v -> (node, component), component = the smallest node reachable.

    Alternates large-star and small-star steps, writing the edges after each round, until the edges
    are stars around the smallest node. Nodes without an edge are not returned; no edges, no rows.
    """
    now = written(edges.select("u", "v").where("u <> v").distinct(), "cc")
    sign = lambda df: df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v") % 1000003), F.lit(0))).first()
    before = sign(now)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        last, now = now, written(_small_star(_large_star(now)), "cc")
        discard(last)
        after = sign(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
