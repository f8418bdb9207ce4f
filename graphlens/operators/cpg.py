"""A code property graph as DataFrames, with what the evidence steps share."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.functions.text import strip_quotes
from graphlens.operators import graph
from graphlens.session import settled as checkpointed

ASSIGN = "<operator>.assignment"
FIELD_ACCESS = ("<operator>.fieldAccess", "<operator>.indirectFieldAccess")
ARRAY_INIT = "<operator>.arrayInitializer"


def is_internal(name: Column, external: Column) -> Column:
    """Whether a method's name is its own code's: no operator, no global scope, not external."""
    return ~name.startswith("<operator>") & ~name.startswith("<global>") & ~F.coalesce(external, F.lit(False))


def base_name(path: Column, default: Column) -> Column:
    """The last part of a path; the default's where there is no real path."""
    own = F.when(path.isNotNull() & (path != "") & ~path.startswith("<"), path)
    return F.coalesce(F.element_at(F.split(F.coalesce(own, default), "/"), -1), F.lit(""))


class Cpg:
    """nodes (id, doc, ord, label, name, code, line, ...) and edges (src, dst, label, ord) of many documents."""

    def __init__(self, nodes: DataFrame, edges: DataFrame) -> None:
        self.nodes = checkpointed(nodes.withColumn("name", F.coalesce("name", F.lit(""))).withColumn("code", F.coalesce("code", F.lit(""))))
        self.edges = checkpointed(graph.valid_edges(edges))

    def label(self, *labels: str) -> DataFrame:
        return self.nodes.where(F.col("label").isin(*labels))

    def ids(self, name: str, *columns: str, where: Column | None = None) -> DataFrame:
        """Nodes under another key name, with some columns prefixed by it."""
        df = self.nodes if where is None else self.nodes.where(where)
        return df.select(F.col("id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])

    @cached_property
    def parent(self) -> DataFrame:
        """id, parent: the first AST parent."""
        return checkpointed(graph.parents(self.edges, "AST", last=False))

    @cached_property
    def method_of(self) -> DataFrame:
        """id, owner: the enclosing method."""
        return checkpointed(graph.owner(self.nodes, graph.parents(self.edges, "AST"), F.col("label") == "METHOD"))

    @cached_property
    def below(self) -> DataFrame:
        """top, node, depth: every node with itself and all of its AST ancestors. Trees are as deep
        as code is nested, so this holds a small multiple of the nodes."""
        return checkpointed(graph.ancestry(self.nodes, self.edges, "AST"))

    @cached_property
    def methods(self) -> DataFrame:
        """Internal methods: doc, method, name, ord, line."""
        return checkpointed(self.label("METHOD").where(is_internal(F.col("name"), F.col("is_external"))).select("doc", F.col("id").alias("method"), F.col("name").alias("method_name"), F.col("ord").alias("method_ord"), F.col("line").alias("method_line")))

    @cached_property
    def by_name(self) -> DataFrame:
        """doc, method_name, method: the first internal method of each name."""
        return checkpointed(self.methods.groupBy("doc", "method_name").agg(F.min_by("method", "method_ord").alias("method")))

    @cached_property
    def calls(self) -> DataFrame:
        """call, doc, name, code, line, ord, owner, target, internal."""
        target = graph.first_out(self.edges, "CALL").withColumnRenamed("id", "call")
        internal = self.methods.select(F.col("method").alias("target"), F.lit(True).alias("internal"))
        own = self.method_of.withColumnRenamed("id", "call")
        rows = self.label("CALL").select(F.col("id").alias("call"), "doc", "name", "code", "line", "ord")
        return checkpointed(rows.join(own, "call", "left").join(target, "call", "left").join(internal, "target", "left").withColumn("internal", F.coalesce("internal", F.lit(False))))

    @cached_property
    def args(self) -> DataFrame:
        """call, idx, pos, arg, arg_label, arg_name, arg_code, arg_ord: arguments in order."""
        edges = self.edges.where("label = 'ARGUMENT'").join(self.ids("dst", "argument_index", "label", "name", "code", "ord", "canonical_name"), "dst")
        idx = F.coalesce("dst_argument_index", F.lit(999))
        pos = F.row_number().over(Window.partitionBy("src").orderBy(idx, "ord"))
        out = edges.select(F.col("src").alias("call"), idx.alias("idx"), pos.alias("pos"), F.col("dst").alias("arg"), F.col("dst_label").alias("arg_label"), F.col("dst_name").alias("arg_name"), F.col("dst_code").alias("arg_code"), F.col("dst_ord").alias("arg_ord"), F.col("dst_canonical_name").alias("arg_field"))
        return checkpointed(out)

    @cached_property
    def params(self) -> DataFrame:
        """method, idx, param, param_name: the last parameter of each index."""
        p = self.ids("dst", "index", "name", where=F.col("label") == "METHOD_PARAMETER_IN")
        rows = self.edges.where("label = 'AST'").join(p, "dst")
        return checkpointed(rows.groupBy(F.col("src").alias("method"), F.col("dst_index").alias("idx")).agg(F.max_by(F.struct(F.col("dst").alias("param"), F.col("dst_name").alias("param_name")), "ord").alias("p")).select("method", "idx", "p.*"))

    @cached_property
    def receiver(self) -> DataFrame:
        """assign, slot, method: what an assignment's target belongs to: the first child of a field
        access, else the target itself, as code."""
        first = graph.first_out(self.edges, "AST").select(F.col("id").alias("arg"), "target").join(self.ids("target", "code"), "target").select("arg", F.col("target_code").alias("inner"))
        lhs = self.args.where("pos = 1").join(self.calls.where(F.col("name") == ASSIGN).select("call", "owner"), "call").join(first, "arg", "left")
        field = (F.col("arg_label") == "CALL") & F.col("arg_name").isin(*FIELD_ACCESS)
        return checkpointed(lhs.select(F.col("call").alias("assign"), F.when(field & F.col("inner").isNotNull(), F.col("inner")).otherwise(F.col("arg_code")).alias("slot"), F.col("owner").alias("method"), F.col("arg_label").alias("lhs_label")))

    @cached_property
    def tokens(self) -> DataFrame:
        """top, symbol, literal: upper-cased codes and names, and literals, in each subtree."""
        n = self.ids("node", "code", "name", "label")
        rows = self.below.join(n, "node")
        symbol = F.explode(F.array_distinct(F.filter(F.array(F.upper("node_code"), F.upper("node_name")), lambda x: x != "")))
        literal = F.when(F.col("node_label") == "LITERAL", strip_quotes("node_code"))
        return rows.select("top", literal.alias("literal"), symbol.alias("symbol")).distinct()

    @cached_property
    def conditions(self) -> DataFrame:
        """cs, cond, owner, cs_line, cs_ord: control structures with their first condition."""
        cs = self.ids("cs", "line", "ord", "code", where=F.col("label") == "CONTROL_STRUCTURE")
        cond = graph.first_out(self.edges, "CONDITION").select(F.col("id").alias("cs"), F.col("target").alias("cond"))
        return checkpointed(cs.join(cond, "cs", "left").join(self.method_of.withColumnRenamed("id", "cs"), "cs", "left"))

    @cached_property
    def assigned(self) -> DataFrame:
        """arg, target, target_name, assign: where the value of an expression is assigned to."""
        uses = self.args.where("pos > 1").join(self.calls.where(F.col("name").startswith(ASSIGN)).select("call"), "call").select("call", "arg", "arg_ord")
        lhs = self.args.where("pos = 1").select("call", F.col("arg").alias("target"), F.coalesce(F.nullif("arg_name", F.lit("")), F.col("arg_code")).alias("target_name"))
        rows = uses.join(lhs, "call")
        return checkpointed(rows.groupBy("arg").agg(F.min_by(F.struct("target", "target_name", F.col("call").alias("assign")), "call").alias("t")).select("arg", "t.*"))

    @cached_property
    def files(self) -> DataFrame:
        """method, file: base name of the method's file, else of the first real one of the document."""
        first = self.label("FILE").where(~F.col("name").startswith("<") & (F.col("name") != "")).groupBy("doc").agg(F.min_by("name", "ord").alias("f"))
        rows = self.label("METHOD").join(first, "doc", "left")
        return rows.select(F.col("id").alias("method"), base_name(F.col("filename"), F.col("f")).alias("file"))
