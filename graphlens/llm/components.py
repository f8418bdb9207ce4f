"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm.common import checkpointed


def _both_ways(edges: DataFrame) -> DataFrame:
    ends = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))
    return edges.select(ends.alias("e")).select("e.u", "e.v")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Edges (a, b) of any sortable type -> node, root (the smallest node of its component), one
    row for each node that has an edge to another node.

    Each round links every node's larger neighbours to its smallest one, and then its smaller
    neighbours; the edges become stars in a logarithmic number of rounds. A round is written to
    the checkpoint folder. No group is gathered: all steps are sums, minima and joins."""
    now = checkpointed(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(max_rounds):
        near = _both_ways(now)
        low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = near.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.where(F.col("a") != F.col("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        now = checkpointed(small.where(F.col("a") != F.col("b")).distinct())
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = tuple(seen)
    raise RuntimeError("components did not settle")
