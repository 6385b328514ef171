"""Connected components of an edge table by alternating stars; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartier.session import checkpointed

MAX_ROUNDS = 60


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One star step on (u, v) rows: every wanted neighbour of ``u`` is tied to the smallest one.

    The smallest neighbour is found by a combining aggregation and joined back from a checkpoint, so that both join
    sides are plain exchanges and a hub with very many neighbours is split by adaptive execution.
    """
    low = checkpointed(pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
    joined = pairs.join(low, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    tied = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(low.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with a link to another.

    ``edges`` has long columns u and v, in any order and repeated at will. Each large star hangs larger neighbours
    on the smallest one, each small star joins the smaller ones; the rounds end when no edge changes.
    """
    down = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = checkpointed(down.distinct())
    mark = _mark(now)
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        big = checkpointed(_star(both, large=True).where("u != v").distinct())
        now = checkpointed(_star(big, large=False).where("u != v").distinct())
        last, mark = mark, _mark(now)
        if mark == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    raise RuntimeError("components did not settle")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
