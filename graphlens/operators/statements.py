"""Statement order, guards and their contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.operators.graph import closure
from graphlens.operators.calculus import lookup

# Fixed values.
NODE_TYPE_ID = {"FunctionEntry": 1, "ParameterDeclaration": 2, "VariableDeclaration": 3, "ArrayDeclaration": 4, "PointerDeclaration": 5, "AssignmentExpression": 6, "IfStatement": 10, "ForStatement": 11, "WhileStatement": 12, "DoWhileStatement": 13, "SwitchStatement": 14, "BreakStatement": 20, "ContinueStatement": 21, "StandardLibCall": 30, "UserDefinedCall": 31, "CallExpression": 32}
GUARD_KIND = {"IfStatement": 1, "ForStatement": 2, "WhileStatement": 2, "DoWhileStatement": 2, "SwitchStatement": 4}


def number(rows: DataFrame, fn: str, *order: str | Column) -> DataFrame:
    """Adds sid: position within a function from 0."""
    return rows.withColumn("sid", F.row_number().over(Window.partitionBy(fn).orderBy(*order)) - 1)


def order_edges(rows: DataFrame, scope: list[str], *order: str | Column, key: str = "sid") -> DataFrame:
    """src, dst: each row of a scope with the one before it."""
    w = Window.partitionBy(*scope).orderBy(*order)
    return rows.select(*scope, F.lag(key).over(w).alias("src"), F.col(key).alias("dst")).where(F.col("src").isNotNull())


def guard_edges(blocks: DataFrame) -> DataFrame:
    """Rows (fn, control, branch, sid, path) of guarded statements -> fn, src, dst, branch: from each
    control statement to the first statement of each branch."""
    return blocks.groupBy("fn", "control", "branch").agg(F.min_by("sid", "path").alias("dst")).withColumnRenamed("control", "src")


def train_mask(node_type: Column) -> Column:
    """0 for statements that are not learned from."""
    return F.when(node_type.isin("BreakStatement", "ContinueStatement"), 0).otherwise(1)


def node_type_id(node_type: Column | str) -> Column:
    return lookup(node_type, NODE_TYPE_ID, 0)


def comparison_guards(comparisons: DataFrame) -> DataFrame:
    """Leaf comparisons of a condition (cond, op, left, right; operands as text) -> cond, var, lower,
    upper, norm. ``x >= 0`` and ``x > 0`` bound below; ``x < K`` and ``x <= K`` with K > 0 bound
    above, at 1 / K; flipped forms likewise. And and or are alike: all leaves count."""
    turn = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
    number_ = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^\\\\s*(\\\\d+)[uUlL]*\\\\s*$', 1) AS BIGINT)")
    is_name = lambda c: F.col(c).rlike(r"^[A-Za-z_]\w*([.]\w+|->\w+)*$")
    straight = comparisons.where(is_name("left")).select("cond", F.col("left").alias("var"), "op", number_("right").alias("k"), F.col("right").alias("bound"))
    flipped = comparisons.where(is_name("right") & ~is_name("left")).select("cond", F.col("right").alias("var"), lookup("op", turn).alias("op"), number_("left").alias("k"), F.col("left").alias("bound"))
    rows = straight.unionByName(flipped)
    lower = (F.col("op").isin(">", ">=") & (F.col("k") == 0)).cast("int")
    above = F.col("op").isin("<", "<=") & F.coalesce(F.col("k") > 0, F.col("bound").isNotNull())
    norm = F.when(F.col("op").isin("<", "<=") & (F.col("k") > 0), 1.0 / F.col("k")).otherwise(F.lit(0.0))
    out = rows.groupBy("cond", "var").agg(F.max(F.coalesce(lower, F.lit(0))).alias("lower"), F.max(above.cast("int")).alias("upper"), F.max(norm).alias("norm"))
    return out.where("lower = 1 or upper = 1")


def for_header_lower(headers: DataFrame) -> DataFrame:
    """For headers (cond, init_var, init_value, inc_var, inc_op, inc_value) -> cond, var: bounded below
    by a start of at least 0 and steps that do not go down, both on one variable."""
    up = (F.col("inc_op") == "++") | ((F.col("inc_op") == "+=") & (F.col("inc_value") >= 0))
    return headers.where((F.col("init_var") == F.col("inc_var")) & (F.col("init_value") >= 0) & up).select("cond", F.col("init_var").alias("var"), F.lit(1).alias("lower"))


def context(active: DataFrame) -> DataFrame:
    """Guards active at each statement (fn, sid, depth, var, lower, upper, norm) -> fn, sid, strength,
    norm: of several guards on one variable the innermost holds; strength is 1 for a lower bound
    plus 2 for an upper one; the norm is the largest, if any bound is an upper one."""
    inner = active.groupBy("fn", "sid", "var").agg(F.max_by(F.struct("lower", "upper", "norm"), "depth").alias("g"))
    out = inner.groupBy("fn", "sid").agg(F.max("g.lower").alias("lower"), F.max("g.upper").alias("upper"), F.max("g.norm").alias("norm"))
    return out.select("fn", "sid", (F.col("lower") + 2 * F.col("upper")).alias("strength"), F.when(F.col("upper") == 1, F.col("norm")).otherwise(0.0).alias("norm"))


def guard_map(edges: DataFrame, guards: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Spreads guards (start, kind, var, lower, upper, norm) from the first statement of a block over
    everything its edges (src, dst) reach -> node, var, kind, lower, upper, norm; bounds of several
    guards are joined, and the kind is the smallest."""
    reach = closure(edges, guards.select(F.col("start").alias("id")).distinct(), max_depth).select(F.col("seed").alias("start"), "node")
    joined = reach.join(guards, "start")
    return joined.groupBy("node", "var").agg(F.min("kind").alias("kind"), F.max("lower").alias("lower"), F.max("upper").alias("upper"), F.max("norm").alias("norm"))


def islands(rows: DataFrame, scope: str, order: str, is_label: Column) -> DataFrame:
    """Adds label_at: the last label row at or before each row of a scope (case bodies)."""
    w = Window.partitionBy(scope).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("label_at", F.last(F.when(is_label, F.col(order)), ignorenulls=True).over(w))
