"""Graph views and reducers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.operators.graph import of_label
from graphlens.session import settled as checkpointed

DEFAULT_VIEWS = {"ast": ("AST",), "cfg": ("CFG",), "dfg": ("REACHING_DEF",), "cg": ("CALL",)}
# Labels that carry no code of their own.
NOISE_LABELS = """BINDING BLOCK DEPENDENCY FILE IMPORT META_DATA METHOD_PARAMETER_OUT METHOD_REF METHOD_RETURN
    MODIFIER NAMESPACE NAMESPACE_BLOCK TYPE TYPE_DECL TYPE_REF""".split()


def label_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("label").agg(F.count("*").alias("n"))


def induced(nodes: DataFrame, edges: DataFrame, *labels: str, extra: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges of some labels, and the nodes at their ends with those of ``extra`` (column id)."""
    kept = of_label(edges, *labels)
    ends = kept.select(F.col("src").alias("id")).union(kept.select(F.col("dst").alias("id")))
    ends = ends.union(extra.select("id")) if extra is not None else ends
    return nodes.join(ends.distinct(), "id", "left_semi"), kept


def induce(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The subgraph on some nodes."""
    ids = ids.select("id").distinct()
    inner = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes.join(ids, "id", "left_semi"), inner


def lift(calls: DataFrame, owners: DataFrame) -> DataFrame:
    """src, dst, weight: edges between the owners of both ends, with how many edges each stands for."""
    a = owners.select(F.col("id").alias("src"), F.col("owner").alias("a"))
    b = owners.select(F.col("id").alias("dst"), F.col("owner").alias("b"))
    both = calls.join(a, "src").join(b, "dst").where(F.col("a").isNotNull() & F.col("b").isNotNull())
    return both.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count("*").alias("weight"))


def scope(nodes: DataFrame, edges: DataFrame, owners: DataFrame, method: Column | str) -> tuple[DataFrame, DataFrame]:
    """The part of a graph that one owner owns."""
    ids = owners.where(F.col("owner") == method).select("id")
    return induce(nodes, edges, ids)


def ego(nodes: DataFrame, edges: DataFrame, centre: Column | str) -> tuple[DataFrame, DataFrame]:
    """Edges at a node, and the nodes at their ends, the node itself in any case."""
    own = edges.where((F.col("src") == centre) | (F.col("dst") == centre))
    ends = own.select(F.col("src").alias("id")).union(own.select(F.col("dst").alias("id"))).union(nodes.where(F.col("id") == centre).select("id"))
    return nodes.join(ends.distinct(), "id", "left_semi"), own


def contract(nodes: DataFrame, edges: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """Drops the nodes that ``keep`` refuses and links survivors through paths of dropped ones."""
    marked = nodes.select("id", keep.alias("keep"))
    kept = nodes.where(keep)
    steps = edges.select("src", "dst").distinct().join(marked.select(F.col("id").alias("dst"), F.col("keep").alias("stays")), "dst").select("src", "dst", "stays")
    steps = checkpointed(steps)
    front = checkpointed(steps.join(kept.select(F.col("id").alias("src")), "src", "left_semi"))
    out, seen = front.where("stays").select("src", "dst"), front.where("not stays").select("src", "dst")
    front = seen
    while not front.isEmpty():
        new = front.withColumnRenamed("dst", "mid").join(steps.withColumnRenamed("src", "mid"), "mid").select("src", "dst", "stays").distinct()
        new = checkpointed(new)
        out = out.union(new.where("stays").select("src", "dst"))
        front = checkpointed(new.where("not stays").select("src", "dst").join(seen, ["src", "dst"], "left_anti"))
        seen = seen.union(front)
    return kept, out.where(F.col("src") != F.col("dst")).distinct()


def is_noise() -> Column:
    return F.col("label").isin(*NOISE_LABELS) | ((F.col("label") == "CALL") & F.coalesce(F.col("name").startswith("<operator>"), F.lit(False)))


def picker(nodes: DataFrame) -> DataFrame:
    """name, first, n: each name with the first node (by ord) and how many there are, in the order of names."""
    return nodes.groupBy("name").agg(F.min("ord").alias("first"), F.count("*").alias("n")).orderBy("name")


def focus(nodes: DataFrame, name: str, default: str) -> DataFrame:
    """One row: the first node of a name, or the default."""
    return nodes.where(F.col("name") == name).agg(F.min_by("id", "ord").alias("id")).select(F.coalesce("id", F.lit(default)).alias("focus"))


def statement_view(statements: DataFrame, parent: DataFrame, order: DataFrame, guard: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The statement graph of functions for display: nodes (fn, sid, caption) and edges (fn, src, dst, label) of the
    three families, guards with their branch."""
    nodes = statements.select("fn", "sid", F.concat_ws(": ", "node_type", F.nullif("code", F.lit(""))).alias("caption"))
    tagged = lambda df, label: df.select("fn", "src", "dst", label.alias("label"))
    branch = F.concat(F.lit("guard "), F.coalesce(F.col("branch").cast("string"), F.lit("")))
    return nodes, tagged(parent, F.lit("parent")).unionByName(tagged(order, F.lit("next"))).unionByName(tagged(guard, F.trim(branch)))


def flow_view(statements: DataFrame, flow: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The def-use graph for display: statements at an end of an edge with their code, and edges labelled by the
    variable, or by the kind of flow where there is none."""
    edges = flow.select("fn", "src", "dst", F.coalesce(F.nullif("var", F.lit("")), "flow").alias("label"))
    ends = edges.select("fn", F.col("src").alias("sid")).union(edges.select("fn", F.col("dst").alias("sid"))).distinct()
    return ends.join(statements.select("fn", "sid", F.coalesce("code", F.lit("")).alias("caption")), ["fn", "sid"], "left"), edges


def search(nodes: DataFrame, query: str, *columns: str) -> DataFrame:
    """Nodes with the query in one of some columns, case aside; a blank query finds nothing."""
    wanted = query.strip().lower()
    if not wanted:
        return nodes.limit(0)
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(wanted)), F.lit(False))
    return nodes.where(hit)


def neighbourhood(edges: DataFrame, centre: DataFrame, hops: int) -> DataFrame:
    """id, hop: nodes within some hops of the centre (column id), edges taken both ways."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    front = centre.select("id").distinct().withColumn("hop", F.lit(0))
    known = front
    for hop in range(1, hops + 1):
        new = front.join(both, front["id"] == both["src"]).select(F.col("dst").alias("id")).distinct()
        front = checkpointed(new.join(known.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop)))
        known = known.unionByName(front)
    return known


def summary(nodes: DataFrame, edges: DataFrame, method_label: str = "METHOD") -> DataFrame:
    """One row: nodes, edges and methods."""
    n = nodes.agg(F.count("*").alias("n_nodes"), F.count_if(F.col("label") == method_label).alias("n_methods"))
    return n.join(F.broadcast(edges.agg(F.count("*").alias("n_edges"))))


def properties_panel(props: Column | str, hidden: tuple[str, ...] = (), width: int = 200) -> Column:
    """A map of shown properties, values cut at ``width`` characters."""
    shown = F.map_filter(props, lambda k, v: ~k.isin(*hidden) & v.isNotNull() & (v != "") if hidden else v.isNotNull() & (v != ""))
    return F.transform_values(shown, lambda k, v: F.left(v, F.lit(width)))
