"""Traversals of general graphs: breadth-first search with parents, and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.session import rounds
from graphlens.session import settled as checkpointed


#: Levels of a search after which the order of discovery is numbered anew.
RENUMBER = 8


def renumbered(rows: DataFrame, by: str, order: str) -> DataFrame:
    """``rows`` with ``order``, an array of struct(rank, eord), replaced by one entry that sorts alike within ``by``. Rows are dealt
    out by range of that order, so no task sees them all; the numbers hold once the result is written, as it is here."""
    dealt = rows.repartitionByRange(by, order).sortWithinPartitions(by, order)
    number = F.array(F.struct(F.lit(0).alias("rank"), F.monotonically_increasing_id().alias("eord")))
    return checkpointed(dealt.withColumn(order, number))


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, stop: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """node, depth, parent, kind (and ``by``): breadth-first search from the seeds (column id; column
    ord, if any). With ``by``, a column of the seeds, each of its values is a search of its own.

    A node is visited once, at its least depth; among several ways in, the one of the parent that
    was found first, then of the smallest (rank, ord) of the edge wins, as in a first-in-first-out
    queue. Edges have src, dst and may have kind, rank and ord. Nodes in ``stop`` (column id) are
    visited but not left. The search ends where nothing new is found, or at ``max_depth`` if one is given."""
    for name, value in (("kind", F.lit("")), ("rank", F.lit(0)), ("ord", F.lit(0).cast("long"))):
        if name not in edges.columns:
            edges = edges.withColumn(name, value)
    edges = edges.select("src", "dst", "kind", "rank", F.col("ord").alias("eord"))
    if stop is not None:
        edges = edges.join(stop.select(F.col("id").alias("src")), "src", "left_anti")
    edges = checkpointed(edges)
    start = seeds if "ord" in seeds.columns else seeds.withColumn("ord", F.lit(0).cast("long"))
    start = start.withColumn("_by", F.col(by) if by else F.lit(0))
    key = start.schema["id"].dataType
    front = start.groupBy("_by", F.col("id").alias("node")).agg(F.min("ord").alias("o"))
    front = front.select("_by", "node", F.lit(0).alias("depth"), F.lit(None).cast(key).alias("parent"), F.lit("").alias("kind"), F.array(F.struct(F.lit(0).alias("rank"), F.col("o").cast("long").alias("eord"))).alias("found"))
    front = checkpointed(front)
    seen = front.drop("found")
    for depth in rounds(max_depth):
        # ``found`` is the order of discovery: the parent's, then the edge's.
        step = front.select("_by", "node", "found").join(edges, F.col("node") == F.col("src"))
        step = step.select("_by", "dst", F.col("node").alias("parent"), edges["kind"].alias("kind"), F.concat("found", F.array(F.struct("rank", F.col("eord").cast("long").alias("eord")))).alias("found"))
        new = step.groupBy("_by", F.col("dst").alias("node")).agg(F.min(F.struct("found", "parent", "kind")).alias("w"))
        new = new.join(seen.select("_by", "node"), ["_by", "node"], "left_anti").select("_by", "node", F.lit(depth).alias("depth"), "w.parent", "w.kind", "w.found")
        front = checkpointed(new)
        if front.isEmpty():
            break
        seen = seen.unionByName(front.drop("found"))
        if depth % RENUMBER == 0:
            front = renumbered(front, "_by", "found")
        if depth % 16 == 0:
            seen = checkpointed(seen)
    return seen.withColumnRenamed("_by", by) if by else seen.drop("_by")


def distances(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """node, depth: least hops from any seed."""
    return bfs(edges, seeds, max_depth).select("node", "depth")


def paths(visits: DataFrame, targets: DataFrame, max_depth: int | None = None) -> DataFrame:
    """target, pos, node: the way from a seed to each target (column id) along the parents of a
    breadth-first search; pos counts from 0 at the seed."""
    links = checkpointed(visits.select("node", "parent", "depth"))
    at = links.join(targets.select(F.col("id").alias("node")).distinct(), "node").select(F.col("node").alias("target"), F.col("depth").alias("pos"), "node", "parent")
    out = at = checkpointed(at)
    for depth in rounds(max_depth):
        at = at.where(F.col("parent").isNotNull()).select("target", F.col("parent").alias("node")).join(links, "node").select("target", F.col("depth").alias("pos"), "node", "parent")
        at = checkpointed(at)
        if at.isEmpty():
            break
        out = out.unionByName(at)
        if depth % 16 == 0:
            out = checkpointed(out)
    return out.select("target", "pos", "node")


def collapse_steps(steps: DataFrame, key: str, order: str, *same: str) -> DataFrame:
    """Keeps of neighbouring rows that agree in some columns the first, and numbers what is left from 1."""
    w = Window.partitionBy(key).orderBy(order)
    now = F.struct(*[F.col(c) for c in same])
    kept = steps.withColumn("_new", ~F.coalesce(F.lag(now).over(w).eqNullSafe(now), F.lit(False)) | (F.row_number().over(w) == 1)).where("_new").drop("_new")
    return kept.withColumn("step", F.row_number().over(w))


def first_after(events: DataFrame, key: str, order: list[str], start: Column, target: Column, barrier: Column, value: str) -> DataFrame:
    """For each row that is a start: the first later row of its key that is a target, unless a
    barrier comes before it (null then). Adds ``hit``."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    mark = F.when(target | barrier, F.struct(target.alias("is_target"), F.col(value).alias("v")))
    nxt = F.first(mark, ignorenulls=True).over(w)
    return events.withColumn("_next", nxt).where(start).withColumn("hit", F.when(F.col("_next.is_target"), F.col("_next.v"))).drop("_next")


def bounded_chain(start: DataFrame, hops: list[DataFrame]) -> DataFrame:
    """Unrolled joins: start (id) along each hop (src, dst) in turn; keeps the chain of nodes."""
    out = start.select("id", F.array("id").alias("chain"))
    for hop in hops:
        out = out.join(hop.select(F.col("src").alias("id"), F.col("dst").alias("next")), "id").select(F.col("next").alias("id"), F.concat("chain", F.array("next")).alias("chain"))
    return out
