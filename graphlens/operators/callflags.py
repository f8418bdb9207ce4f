"""Calls of a template tree: their arguments, features and places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.functions.knowledge import CALL_CATEGORY, LIFTABLE_CATEGORIES, UNBOUNDED_SINKS
from graphlens.operators import graph
from graphlens.operators.calculus import lookup
from graphlens.session import settled as checkpointed

# Target and size argument of the calls whose sizes are looked at.
SLOTS = {"memcpy": (0, 2), "memmove": (0, 2), "strncpy": (0, 2), "memset": (0, 2), "snprintf": (0, 1), "vsnprintf": (0, 1), "fgets": (0, 1), "read": (1, 2), "recv": (1, 2), "connect": (1, 2)}
VARARGS = "printf fprintf vprintf vfprintf sprintf snprintf vsprintf vsnprintf".split()
ALLOCATORS = "malloc calloc realloc alloca _alloca new new[]".split()


def call_arguments(tree: DataFrame) -> DataFrame:
    """call, pos, arg, node_type, code, name: the children of calls' parameter lists from 0."""
    lists = tree.where("node_type = 'ParameterList'").select(F.col("id").alias("parent"), F.col("parent").alias("call"))
    calls = tree.where(F.col("node_type").isin("StandardLibCall", "UserDefinedCall")).select(F.col("id").alias("call"))
    rows = tree.join(lists, "parent").join(calls, "call", "left_semi")
    pos = F.row_number().over(Window.partitionBy("call").orderBy("path")) - 1
    return rows.select("call", pos.alias("pos"), F.col("id").alias("arg"), "node_type", F.coalesce("code", F.lit("")).alias("code"), "name")


def full_name(code: Column) -> Column:
    """base.field of an lvalue's code, one level: casts, address, subscripts and dereferences peeled off."""
    c = F.regexp_replace(code, r"\s+", "")
    c = F.regexp_replace(c, r"^(?:\([A-Za-z_][\w *]*\))+", "")
    c = F.regexp_replace(c, r"^[&*(]+|\)+$", "")
    c = F.regexp_replace(c, r"\[[^\]]*\]", "")
    return F.regexp_extract(F.replace(c, F.lit("->"), F.lit(".")), r"^([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?)", 1)


def size_kind(code: Column) -> Column:
    """0 none, 1 number, 2 expression, 3 sizeof alone, 4 sizeof within arithmetic."""
    c = F.regexp_replace(F.coalesce(code, F.lit("")), r"\s+", "")
    rest = F.regexp_replace(c, r"sizeof\([^()]*\)", "SZ")
    return F.when(c == "", 0).when(F.contains(c, F.lit("sizeof")), F.when(rest.rlike(r"[+\-*/]"), 4).otherwise(3)).when(c.rlike(r"^\d+$"), 1).otherwise(2)


def flags(calls: DataFrame, args: DataFrame) -> DataFrame:
    """calls (call, name) with arguments (call, pos, code) -> call, has_varargs, danger_unbounded,
    alloc_sizeof_state, dst_is_field, size_kind, len_linked_to_dst, len_linked_extended,
    sizeof_non_dst, size_is_base_struct, size_mismatch_field."""
    low = F.lower("name")
    slot = lambda k: lookup(low, {n: v[k] for n, v in SLOTS.items()})
    packed = args.groupBy("call").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pos", "code")))).alias("a"))
    rows = calls.join(packed, "call", "left").withColumn("dst", F.try_element_at("a", slot(0))).withColumn("size", F.regexp_replace(F.try_element_at("a", slot(1)), r"\s+", ""))
    rows = rows.withColumn("full", F.coalesce(full_name(F.col("dst")), F.lit(""))).withColumn("all", F.array_join(F.map_values("a"), ","))
    base, field = F.split_part("full", F.lit("."), F.lit(1)), F.split_part("full", F.lit("."), F.lit(2))
    is_field = field != ""
    size = F.coalesce("size", F.lit(""))
    has = lambda *parts: F.contains(F.replace(size, F.lit("->"), F.lit(".")), F.concat(*parts))
    named = F.col("full") != ""
    linked = named & (has(F.lit("sizeof("), "full", F.lit(")")) | has(F.lit("sizeof(*"), "full", F.lit(")")) | has(F.lit("sizeof("), "full", F.lit("[0])")))
    extended = is_field & has(F.lit("sizeof("), base, F.lit("."), field, F.lit(")"))
    whole = is_field & has(F.lit("sizeof("), base, F.lit(")"))
    sized = F.contains(size, F.lit("sizeof("))
    one = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    return rows.select(
        "call", one(low.isin(*VARARGS)).alias("has_varargs"), one(low.isin(*UNBOUNDED_SINKS)).alias("danger_unbounded"),
        F.when(low.isin(*ALLOCATORS), F.when(F.col("all").rlike(r"\bsizeof\s*\("), 2).otherwise(1)).otherwise(0).alias("alloc_sizeof_state"), one(is_field).alias("dst_is_field"), size_kind(size).alias("size_kind"),
        one(linked | extended).alias("len_linked_to_dst"), one(extended).alias("len_linked_extended"), one(sized & ~(linked | extended)).alias("sizeof_non_dst"), one(whole).alias("size_is_base_struct"),
        one(is_field & (whole | (sized & ~(linked | extended)))).alias("size_mismatch_field"),
    )


def macro_values(tree: DataFrame) -> DataFrame:
    """call, name, value: what the macros' constants stand for: the only literal in a macro call's block, or that of the only
    macro used there, followed until a literal is reached. Macros that stand for more, or for each other in a circle, have none."""
    blocks = tree.where("node_type = 'CompoundStatement'").join(tree.where("node_type = 'ParameterList'").select(F.col("id").alias("parent"), F.col("parent").alias("call")), "parent").select("call", F.col("id").alias("block"))
    near = graph.owner(tree.join(blocks.select(F.col("block").alias("id"), F.lit(True).alias("is_block")), "id", "left"), tree.select("id", "parent").where(F.col("parent").isNotNull()), F.coalesce("is_block", F.lit(False)))
    inside = tree.join(near.where(F.col("owner") != F.col("id")), "id").withColumnRenamed("owner", "block").join(blocks, "block")
    parts = inside.where(F.col("node_type").isin("Literal", "Identifier", "StandardLibCall", "UserDefinedCall")).groupBy("call").agg(F.count("*").alias("n"), F.first("value").alias("value"), F.first("name").alias("refers"))
    rows = tree.select(F.col("id").alias("call"), "name", "doc").join(parts.where("n = 1"), "call")
    known = rows.groupBy("doc", "name").agg(F.min("value").alias("value"), F.min(F.when(F.col("value").isNull(), F.col("refers"))).alias("refers"))
    # Names are followed until none leads to a value that was not there before.
    while True:
        at = known.select("doc", F.col("name").alias("refers"), F.col("value").alias("next"))
        step = checkpointed(known.join(at, ["doc", "refers"], "left").select("doc", "name", F.coalesce("value", "next").alias("value"), "refers"))
        if step.where(F.col("value").isNotNull()).count() == known.where(F.col("value").isNotNull()).count():
            break
        known = step
    return rows.select("call", "doc", "name").join(known.select("doc", "name", "value"), ["doc", "name"]).where(F.col("value").isNotNull()).select("call", "name", "value")


def macro_calls(tree: DataFrame) -> DataFrame:
    """call: calls with a block directly below their parameter list stand for a macro's constant."""
    lists = tree.where("node_type = 'ParameterList'").select(F.col("id").alias("parent"), F.col("parent").alias("call"))
    return tree.where("node_type = 'CompoundStatement'").join(lists, "parent").select("call").distinct()


def first_calls(tree: DataFrame, tops: DataFrame) -> DataFrame:
    """top, call: the first call in pre-order below each top (column id), macro constants aside."""
    links = tree.where(F.col("parent").isNotNull()).select(F.col("parent").alias("src"), F.col("id").alias("dst"))
    below = graph.closure(links, tops.select("id"))
    calls = tree.where(F.col("node_type").isin("StandardLibCall", "UserDefinedCall")).select(F.col("id").alias("node"), "path").join(macro_calls(tree).withColumnRenamed("call", "node"), "node", "left_anti")
    return below.join(calls, "node").groupBy(F.col("seed").alias("top")).agg(F.min_by("node", "path").alias("call"))


def nearest_call(tree: DataFrame) -> DataFrame:
    """id, call: the enclosing call of each node, itself included."""
    links = tree.select("id", "parent").where(F.col("parent").isNotNull())
    return graph.owner(tree, links, F.col("node_type").isin("StandardLibCall", "UserDefinedCall")).select("id", F.col("owner").alias("call"))


def lifted(conditions: DataFrame) -> DataFrame:
    """Conditions (cond, call, name) whose call has an effect, which becomes a statement before them."""
    return conditions.where(lookup(F.lower("name"), CALL_CATEGORY, 0).isin(*LIFTABLE_CATEGORIES))


def split_assignments(tree: DataFrame) -> DataFrame:
    """assign, part, node: assignments whose value is a call give two statements, the call first."""
    rhs = tree.where(F.col("node_type").isin("StandardLibCall", "UserDefinedCall")).select(F.col("id").alias("call"), F.col("parent").alias("assign"))
    a = tree.where("node_type = 'AssignmentExpression'").select(F.col("id").alias("assign")).join(rhs, "assign")
    return a.select("assign", F.posexplode(F.array("call", "assign")).alias("part", "node"))


def array_lengths(tree: DataFrame, fns: DataFrame) -> DataFrame:
    """fn, name, length of declared arrays; ``fns``: id, fn."""
    return tree.where("node_type = 'ArrayDeclaration'").join(fns, "id").select("fn", "name", "length")


def contains_sizeof(tree: DataFrame) -> DataFrame:
    """id: nodes with a sizeof at or below them."""
    links = tree.where(F.col("parent").isNotNull()).select(F.col("id").alias("src"), F.col("parent").alias("dst"))
    return graph.closure(links, tree.where("node_type = 'SizeOfExpression'").select("id")).select(F.col("node").alias("id")).distinct()


def has_indexing(code: Column) -> Column:
    """a[i] or *(p + i)."""
    return code.rlike(r"\w\s*\[[^\]]+\]") | code.rlike(r"\*\s*\(\s*\w+\s*[+-]")


def condition_of(tree: DataFrame) -> DataFrame:
    """control, cond: the condition's place depends on the statement: the second child of a for, the
    last of a do, else the first."""
    kinds = tree.where(F.col("node_type").isin("IfStatement", "WhileStatement", "SwitchStatement", "ForStatement", "DoWhileStatement")).select(F.col("id").alias("parent"), F.col("node_type").alias("control_type"))
    w = Window.partitionBy("parent").orderBy("path")
    kids = tree.join(kinds, "parent").withColumn("pos", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("parent")))
    at = F.when(F.col("control_type") == "ForStatement", 2).when(F.col("control_type") == "DoWhileStatement", F.col("n")).otherwise(1)
    return kids.where(F.col("pos") == at).select(F.col("parent").alias("control"), F.col("id").alias("cond"))


def return_edges(order: DataFrame, splits: DataFrame) -> DataFrame:
    """fn, src, dst, var: from a call statement to the assignment right after it that takes its value.
    ``splits``: fn, call_sid, assign_sid; ``order``: fn, src, dst."""
    e = splits.select("fn", F.col("call_sid").alias("src"), F.col("assign_sid").alias("dst"))
    return e.join(order, ["fn", "src", "dst"], "left_semi").withColumn("var", F.concat(F.lit("$ret@"), F.col("src").cast("string")))


def ordered_names(tree: DataFrame, fns: DataFrame, kind: str) -> DataFrame:
    """fn, names: distinct names of declarations of a kind, in the order they are first seen."""
    rows = tree.where(F.col("node_type") == kind).join(fns, "id").groupBy("fn", "name").agg(F.min("path").alias("first"))
    return rows.groupBy("fn").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "name"))), lambda s: s["name"]).alias("names"))
