"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, shuffled


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node of its component.

    Each round hangs all neighbours of a node on its smallest neighbour, first the larger ones, then the
    smaller ones; the trees get flat in a logarithmic number of rounds. A round is two aggregations and two
    joins on plain longs, so a hub is combined before the shuffle and split by the adaptive join; nothing is
    broadcast. The edges are written after each round. Self-loops and nulls are dropped; an empty table gives an empty result.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    now = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _digest(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(shuffled(low), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(shuffled(low), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = saved(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        after = _digest(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())
