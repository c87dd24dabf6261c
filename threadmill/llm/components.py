"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stages import remove, written

MAX_ROUNDS = 60


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())


def _star(near: DataFrame) -> DataFrame:
    """near: (u, v). For each u the least of u and its v; joined back to every v of u."""
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return near.join(least, "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): each node of ``edges`` (columns a, b) and the least node it is connected to.

    Two shuffles of the edges a round, whose result is written; the round before it goes. The rounds grow
    with the logarithm of the nodes. No group is collected: stars are an aggregate and an equi-join, which
    AQE can split. Edges with a null end or from a node to itself are left out.
    """
    now, at = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _fingerprint(now)
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _star(large)
        later, there = written(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        remove(edges.sparkSession, at)
        now, at = later, there
        before, mark = mark, _fingerprint(now)
        if mark == before:
            roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    raise RuntimeError(f"components have not settled after {MAX_ROUNDS} rounds")
