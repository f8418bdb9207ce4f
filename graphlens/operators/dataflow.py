"""Def-use data flow over ordered statements.

Mentions are rows (fn, sid, phase, var, is_def): one for each definition or use of a variable, in
the order of sid and, within a statement, phase. Edges are rows (fn, src, dst, var, flow).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.operators.calculus import lookup

# Roles of a use.
FLOW_ID = {"value": 1, "index": 2, "size": 3, "base": 4}


def def_use(mentions: DataFrame, kill: Column | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """Edges from the last definition before a use to it: an as-of match by a window, no join.

    ``kill``, if given, marks rows of a (fn, var) after which earlier definitions do not reach."""
    w = Window.partitionBy("fn", "var").orderBy("sid", "phase").rowsBetween(Window.unboundedPreceding, -1)
    event = F.when(F.col("is_def"), F.col("sid"))
    if kill is not None:
        mark = F.when(F.col("is_def") | kill, F.struct(event.alias("sid")))
        last = F.last(mark, ignorenulls=True).over(w)["sid"]
    else:
        last = F.last(event, ignorenulls=True).over(w)
    used = F.col("is_use") if "is_use" in mentions.columns else ~F.col("is_def")
    rows = mentions.withColumn("src", last).where(used & F.col("src").isNotNull())
    return rows.select("fn", "src", F.col("sid").alias("dst"), "var", *extra)


def first_edges(edges: DataFrame, *order: str) -> DataFrame:
    """One edge of each (fn, src, dst, var, flow), the first by some columns."""
    w = Window.partitionBy("fn", "src", "dst", "var", "flow").orderBy(*order)
    return edges.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def degrees(edges: DataFrame) -> DataFrame:
    """fn, sid, in_degree, out_degree of all statements with an edge: one shuffle for both ends."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("sid"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("sid"), F.lit(1).alias("i"), F.lit(0).alias("o"))))
    return edges.select("fn", ends.alias("e")).groupBy("fn", F.col("e.sid").alias("sid")).agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


def variables(mentions: DataFrame) -> DataFrame:
    """fn, sid, def_vars, use_vars (sorted), def_count, use_count; uses as a base do not count."""
    uses = ~F.col("is_def")
    counted = uses & (F.col("flow") != "base") if "flow" in mentions.columns else uses
    out = mentions.groupBy("fn", "sid").agg(F.array_sort(F.collect_set(F.when(F.col("is_def"), F.col("var")))).alias("def_vars"), F.array_sort(F.collect_set(F.when(counted, F.col("var")))).alias("use_vars"))
    return out.withColumn("def_count", F.size("def_vars").cast("long")).withColumn("use_count", F.size("use_vars").cast("long"))


def merge_guards(edges: DataFrame, guards: DataFrame) -> DataFrame:
    """Adds guard_kind, has_lower, has_upper and upper_norm to edges: the kind of the variable's own
    guard, else of all variables' (``*``), else of the aggregate (``__agg__``); bounds of all joined."""
    at = guards.select("fn", F.col("sid").alias("dst"), F.col("var").alias("gvar"), "kind", "lower", "upper", "norm")
    both = edges.join(at, ["fn", "dst"], "left").where(F.col("gvar").isNull() | (F.col("gvar") == F.col("var")) | F.col("gvar").cast("string").isin("*", "__agg__"))
    rank = F.when(F.col("gvar") == F.col("var"), 0).when(F.col("gvar").cast("string") == "*", 1).otherwise(2)
    keys = [c for c in edges.columns]
    kind = F.min_by("kind", F.when(F.coalesce("kind", F.lit(0)) > 0, rank))
    out = both.groupBy(*keys).agg(F.coalesce(kind, F.lit(0)).alias("guard_kind"), F.coalesce(F.max("lower"), F.lit(0)).alias("has_lower"), F.coalesce(F.max("upper"), F.lit(0)).alias("has_upper"), F.coalesce(F.max("norm"), F.lit(0.0)).alias("upper_norm"))
    # A left join keeps edges whose only guards are of other variables out; they have none.
    return edges.join(out, keys, "left").fillna({"guard_kind": 0, "has_lower": 0, "has_upper": 0, "upper_norm": 0.0})


def sink_flags(calls: DataFrame, unbounded: list[str], bounded: list[str]) -> DataFrame:
    """fn, sid, is_sink_call_unbounded, is_sink_call_bounded: by lower-cased call names."""
    name = F.lower("name")
    return calls.groupBy("fn", "sid").agg(F.max(name.isin(*unbounded).cast("int")).alias("is_sink_call_unbounded"), F.max(name.isin(*bounded).cast("int")).alias("is_sink_call_bounded"))


def flow_id(role: Column | str) -> Column:
    return lookup(role, FLOW_ID, 1)


def write_targets(calls: DataFrame, slots: DataFrame) -> DataFrame:
    """Call arguments (fn, sid, name, pos, var) and slots (name, dst) -> the variables calls write."""
    return calls.join(F.broadcast(slots.select(F.lower("name").alias("_n"), "dst")), F.lower("name") == F.col("_n")).where(F.col("pos") == F.col("dst")).select("fn", "sid", "var").distinct()


def argument_roles(calls: DataFrame, slots: DataFrame) -> DataFrame:
    """Adds role to call arguments (fn, sid, name, pos, is_index, var): an index keeps that role; the
    size slot is size, the target slot base, all else value. A variable has one role in a call, by
    that order."""
    s = F.broadcast(slots.select(F.lower("name").alias("_n"), F.col("dst").alias("_d"), F.col("size").alias("_s")))
    rows = calls.join(s, F.lower("name") == F.col("_n"), "left")
    rank = F.when(F.col("is_index"), 0).when(F.col("pos") == F.col("_s"), 1).when(F.col("pos") == F.col("_d"), 2).otherwise(3)
    out = rows.groupBy("fn", "sid", "name", "var").agg(F.min(rank).alias("r"))
    return out.withColumn("role", F.element_at(F.array(*[F.lit(x) for x in ("index", "size", "base", "value")]), F.col("r") + 1)).drop("r")
