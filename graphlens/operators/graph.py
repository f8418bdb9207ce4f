"""Graph and tree primitives.

Nodes have a key ``id``, a ``label`` and an ordinal ``ord``; edges have ``src``, ``dst``, ``label``
and ``ord``. Keys may be of any sortable type; where ids are unique only per document, callers use
a struct or a composed key. Ordinals hold the order of the document: "first" and "last" mean by
``ord``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.session import rounds
from graphlens.session import settled as checkpointed


def of_label(edges: DataFrame, *labels: str) -> DataFrame:
    return edges.where(F.col("label").isin(*labels))


def valid_edges(edges: DataFrame) -> DataFrame:
    """Edges with both ends and a label."""
    return edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & F.col("label").isNotNull())


def adjacency(edges: DataFrame) -> DataFrame:
    """Per label: edges, and how many nodes have out- and in-edges."""
    return valid_edges(edges).groupBy("label").agg(F.count("*").alias("n_edges"), F.count_distinct("src").alias("n_src"), F.count_distinct("dst").alias("n_dst"))


def out_neighbours(nodes: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """id, neighbour, ord along edges of a label."""
    return nodes.select("id").join(of_label(edges, label).select(F.col("src").alias("id"), F.col("dst").alias("neighbour"), "ord"), "id")


def in_neighbours(nodes: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """id, neighbour, ord against edges of a label."""
    return nodes.select("id").join(of_label(edges, label).select(F.col("dst").alias("id"), F.col("src").alias("neighbour"), "ord"), "id")


def parents(edges: DataFrame, label: str, last: bool = True) -> DataFrame:
    """id, parent: one parent for each child, by the last edge or the first."""
    pick = F.max_by if last else F.min_by
    return of_label(edges, label).groupBy(F.col("dst").alias("id")).agg(pick("src", F.struct("ord", "src")).alias("parent"))


def first_out(edges: DataFrame, label: str) -> DataFrame:
    """id, target: the target of a node's first out-edge of a label (call target, declaration, condition)."""
    return of_label(edges, label).groupBy(F.col("src").alias("id")).agg(F.min_by("dst", F.struct("ord", "dst")).alias("target"))


def arguments(edges: DataFrame, index: Column, label: str, missing: int = 999) -> DataFrame:
    """call, pos, arg: arguments in the order of their index, those without one last, ties by ord."""
    order = Window.partitionBy("src").orderBy(F.coalesce(index, F.lit(missing)), "ord", "dst")
    return of_label(edges, label).select(F.col("src").alias("call"), F.row_number().over(order).alias("pos"), F.col("dst").alias("arg"))


def argument_of(edges: DataFrame, label: str) -> DataFrame:
    """arg, call: the calls in which each node is an argument, each once."""
    return of_label(edges, label).select(F.col("dst").alias("arg"), F.col("src").alias("call")).distinct()


def with_body(nodes: DataFrame, edges: DataFrame, label: str, excluded: Column | None = None) -> DataFrame:
    """Nodes with an edge of a label to something, without the excluded ones."""
    rows = nodes if excluded is None else nodes.where(~F.coalesce(excluded, F.lit(False)))
    return rows.join(of_label(edges, label).select(F.col("src").alias("id")).distinct(), "id", "left_semi")


def named(nodes: DataFrame, pattern: str) -> DataFrame:
    """Nodes whose name holds a match of a regular expression."""
    return nodes.where(F.coalesce(F.col("name").rlike(pattern), F.lit(False)))


def last_by_index(edges: DataFrame, index: Column, label: str) -> DataFrame:
    """owner, index, param: for each index the last edge wins."""
    return of_label(edges, label).groupBy(F.col("src").alias("owner"), index.alias("index")).agg(F.max_by("dst", F.struct("ord", "dst")).alias("param"))


def closure(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """seed, node, depth: everything reachable from each seed (column ``id``), the seed itself at
    depth 0, with the least depth. Cycle-safe: a node enters a seed's set once.

    A frontier loop: each round joins the newest nodes with the edges and drops what is known, until
    nothing is new or a depth that the caller gives is reached."""
    steps = edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).distinct()
    front = checkpointed(seeds.select(F.col("id").alias("seed"), F.col("id").alias("node")).distinct().withColumn("depth", F.lit(0)))
    known = front
    for depth in rounds(max_depth):
        new = front.join(steps, "node").select("seed", F.col("next").alias("node")).distinct()
        front = checkpointed(new.join(known.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        known = known.unionByName(front)
        if depth % 8 == 0:
            known = checkpointed(known)
    return known


def places(edges: DataFrame, label: str) -> DataFrame | None:
    """root, node, depth, path of every node of a label's trees (see ``forest``), if the edges form trees: each node has
    one parent at most and none is on a circle. Else None, and closures are needed."""
    tree = of_label(edges, label).select("src", "dst", "label", "ord")
    n, children = tree.agg(F.count("*"), F.count_distinct("dst")).first()
    if n != children:
        return None
    found = checkpointed(forest(tree, label))
    return found if found.where("depth > 0").count() == n else None


def _below(tree: DataFrame, tops: DataFrame) -> DataFrame:
    """top, node, depth: the nodes of a forest below some of its nodes (top, root, path), found by their path's prefixes of the
    tops' lengths. One join, whatever the depth; as many rows are made as a node has prefixes of these lengths."""
    tops = checkpointed(tops.select("top", "root", F.col("path").alias("prefix"), F.size("path").alias("at")))
    lengths = tops.agg(F.array_sort(F.collect_set("at")).alias("lengths"))
    rows = tree.where("depth > 0").join(F.broadcast(lengths)).select("root", "node", "depth", "path", F.explode(F.filter("lengths", lambda x: x < F.col("depth"))).alias("at"))
    rows = rows.select("root", "node", F.slice("path", F.lit(1), F.col("at")).alias("prefix"), (F.col("depth") - F.col("at")).alias("depth"))
    return rows.join(tops.drop("at"), ["root", "prefix"]).select("top", "node", "depth")


def descendants(edges: DataFrame, roots: DataFrame, label: str, max_depth: int | None = None) -> DataFrame:
    """root, node, depth: all below each root, without the root itself. In trees by a test on paths, else by closure."""
    tree = places(edges, label)
    if tree is None:
        return closure(of_label(edges, label), roots, max_depth).where("depth > 0").withColumnRenamed("seed", "root")
    tops = roots.select(F.col("id").alias("node")).distinct().join(tree, "node").select(F.col("node").alias("top"), "root", "path")
    found = _below(tree, tops).withColumnRenamed("top", "root")
    return found if max_depth is None else found.where(F.col("depth") <= max_depth)


def ancestry(nodes: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """top, node, depth: every node (id) with itself and with all that it lies below."""
    tree = places(edges, label)
    if tree is None:
        up = of_label(edges, label).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        return closure(up, nodes.select("id")).select(F.col("node").alias("top"), F.col("seed").alias("node"), "depth")
    own = nodes.select(F.col("id").alias("top"), F.col("id").alias("node"), F.lit(0).alias("depth")).distinct()
    below = tree.where("depth > 0").select("root", "node", "depth", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("depth") - 1), lambda k: F.slice("path", F.lit(1), k))).alias("at", "path"))
    above = below.join(tree.select("root", "path", F.col("node").alias("top")), ["root", "path"]).select("top", "node", (F.col("depth") - F.col("at")).cast("int").alias("depth"))
    return own.unionByName(above.join(nodes.select(F.col("id").alias("node")).distinct(), "node", "left_semi").select("top", "node", "depth"))


def owner(nodes: DataFrame, parent_of: DataFrame, is_owner: Column, max_rounds: int = 64) -> DataFrame:
    """id, owner: the nearest node that is an owner, itself included; null if there is none.

    Pointer jumping: each round doubles the distance looked up, so a tree of depth d takes log d
    rounds."""
    now = nodes.select("id", is_owner.alias("found")).join(parent_of, "id", "left").select("id", "found", F.when(F.col("found"), F.col("id")).otherwise(F.col("parent")).alias("at"))
    now = checkpointed(now)
    for _ in range(max_rounds):
        there = now.select(F.col("id").alias("at"), F.col("found").alias("there"), F.col("at").alias("beyond"))
        step = now.join(there, "at", "left")
        done = F.col("found") | F.coalesce("there", F.lit(False))
        now = checkpointed(step.select("id", done.alias("found"), F.when(F.col("found"), F.col("at")).otherwise(F.col("beyond")).alias("at")))
        if now.where(~F.col("found") & F.col("at").isNotNull()).isEmpty():
            break
    return now.select("id", F.when(F.col("found"), F.col("at")).alias("owner"))


def dominates(edges: DataFrame, pairs: DataFrame, label: str = "DOMINATE", max_depth: int | None = None) -> DataFrame:
    """pairs (a, b) -> adds dominated: whether b is reachable from a along a label, a itself included. In trees a test on
    the two paths of each pair, else by closure."""
    tree = places(edges, label)
    if tree is not None:
        at = lambda c: tree.select(F.col("node").alias(c), F.struct("root", "path").alias(f"_{c}"))
        both = pairs.join(at("a"), "a", "left").join(at("b"), "b", "left")
        inside = (F.col("_a.root") == F.col("_b.root")) & (F.slice("_b.path", F.lit(1), F.size("_a.path")) == F.col("_a.path"))
        hit = (F.col("a") == F.col("b")) | (inside if max_depth is None else inside & (F.size("_b.path") - F.size("_a.path") <= max_depth))
        return both.select(*[F.col(c) for c in pairs.columns], F.coalesce(hit, F.lit(False)).alias("dominated"))
    reach = closure(of_label(edges, label), pairs.select(F.col("a").alias("id")), max_depth).select(F.col("seed").alias("a"), F.col("node").alias("b"), F.lit(True).alias("_hit"))
    return pairs.join(reach, ["a", "b"], "left").withColumn("dominated", F.coalesce("_hit", F.lit(False))).drop("_hit")


def roots(edges: DataFrame, label: str) -> DataFrame:
    """id: ends of edges of a label that are never a child."""
    tree = of_label(edges, label)
    return tree.select(F.col("src").alias("id")).distinct().join(tree.select(F.col("dst").alias("id")), "id", "left_anti")


def forest(edges: DataFrame, label: str) -> DataFrame:
    """root, node, depth, path: the trees below all roots in pre-order; ``path`` holds the child
    positions from the root, so sorting by it is pre-order and a prefix test finds descendants.

    Pointer jumping: a row is a way up from a node, and each round puts the way up from its top before
    it, so a tree of depth d takes log d rounds. Ways that run in a circle reach no root and end when they
    are longer than there are edges; nodes with no other way up belong to no tree."""
    tree = of_label(edges, label)
    position = F.row_number().over(Window.partitionBy("src").orderBy("ord", "dst"))
    top = roots(edges, label).select(F.col("id").alias("top"), F.lit(True).alias("whole"))
    ways = tree.select(F.col("src").alias("top"), F.col("dst").alias("node"), F.array(position).alias("path"))
    ways = checkpointed(ways.join(top, "top", "left").select("top", "node", "path", F.coalesce("whole", F.lit(False)).alias("whole")))
    length, n = 1, None
    while not ways.where("not whole").isEmpty():
        n = ways.count() if n is None else n
        if length > n:
            break
        up = ways.select(F.col("node").alias("top"), F.col("top").alias("over"), F.col("path").alias("before"), F.col("whole").alias("whole_over"))
        on = ways.where("not whole").join(up, "top").select(F.col("over").alias("top"), "node", F.concat("before", "path").alias("path"), F.col("whole_over").alias("whole"))
        ways, length = checkpointed(ways.where("whole").unionByName(on)), 2 * length
    below = ways.where("whole").select(F.col("top").alias("root"), "node", F.size("path").alias("depth"), "path")
    return top.select(F.col("top").alias("root"), F.col("top").alias("node"), F.lit(0).alias("depth"), F.array().cast("array<int>").alias("path")).unionByName(below)


def flatten(nodes: DataFrame, edges: DataFrame, blacklist: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Nodes without the labels in ``blacklist`` and edges between nodes that are left."""
    kept = nodes.where(~F.col("label").isin(*blacklist)) if blacklist else nodes
    ids = kept.select("id")
    inner = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return kept, inner


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").unionByName(edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti"))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows``, or an error at run time if a key repeats."""
    n = F.count("*").over(Window.partitionBy(*keys))
    check = F.when(n > 1, F.raise_error(F.concat(F.lit("duplicate id "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys])))).otherwise(F.lit(True))
    return rows.withColumn("_ok", check).where("_ok").drop("_ok")


def tree_text(tree: DataFrame, caption: Column) -> DataFrame:
    """root, text: a forest (root, node, depth, path and what ``caption`` reads) drawn with box
    characters. A tree is one row, so trees are expected to be functions or files."""
    last = F.row_number().over(Window.partitionBy("root", F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0)))).orderBy(F.desc("path"))) == 1
    marked = tree.withColumn("caption", caption).withColumn("last", (F.col("depth") > 0) & last)
    rows = marked.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("path", "depth", "caption", "last"))).alias("rows"))
    lasts = F.filter("rows", lambda r: r["last"])["path"]
    bars = lambda r: F.array_join(F.transform(F.filter(F.sequence(F.lit(0), F.size(r["path"])), lambda k: (k >= 1) & (k < F.size(r["path"]))), lambda k: F.when(F.array_contains(lasts, F.slice(r["path"], F.lit(1), k)), F.lit("    ")).otherwise(F.lit("│   "))), "")
    line = lambda r: F.concat(bars(r), F.when(r["depth"] == 0, F.lit("")).when(r["last"], F.lit("└── ")).otherwise(F.lit("├── ")), r["caption"])
    return rows.select("root", F.array_join(F.transform("rows", line), "\n").alias("text"))
