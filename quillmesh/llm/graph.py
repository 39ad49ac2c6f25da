"""Connected components of an edge table, as rounds of joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.session import materialize


def _both(edges: DataFrame) -> DataFrame:
    pairs = F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return edges.select(F.explode(pairs).alias("e")).select("e.*")


def _digest(edges: DataFrame) -> tuple:
    """Number and combined hash of distinct edges: equal before and after a round once nothing moves."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component`` (smallest node reachable) of undirected edges ``a, b`` (bigint, not null).

    Large-star / small-star contraction: every round hangs nodes on the smallest neighbour seen, so the number
    of rounds follows the logarithm of the longest path. Each round is a written table in the shared scratch
    folder, which lost executors do not take along. Minima are combined before each shuffle; the join by node
    is an equi-join whose hot keys the adaptive planner splits. No edges give no rows; loops are ignored.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    after = _digest(edges)
    for _ in range(rounds):
        # large star: neighbours above a node move to the smallest node of its neighbourhood
        least = _both(edges).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = _both(edges).join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: a node and its smaller neighbours hang on the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        new = materialize(small.where("a <> b").distinct(), "edges")
        before, edges, after = after, new, _digest(new)
        if before == after:
            break
    else:
        raise RuntimeError("the components did not settle")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
