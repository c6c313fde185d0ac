"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Each node hands its neighbours on to its smallest one.

    Large star: the larger neighbours of a node go to the smallest; small star:
    the smaller ones and the node itself.  Joined on keys that partial sums
    found, never collected, so a node with very many neighbours can be split.
    """
    if small:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct()
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    pairs = near.join(least, "u")
    if small:
        linked = pairs.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        linked = pairs.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return linked.where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``edges(a, b)``.

    ``component`` is the smallest node that can be reached.  Self loops are
    left out; repeated edges and either direction do no harm; no edges give an
    empty result.  Each round is written to the shared folder.
    """
    now = staged(edges.where("a <> b").select("a", "b").distinct())
    seen = None
    for _ in range(rounds):
        after = staged(_star(_star(now, small=False), small=True))
        state = after.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        discard(now)
        now = after
        if state.n == 0 or tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
