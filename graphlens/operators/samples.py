"""Training records as graph samples: schema-free JSON to feature matrices, edge lists and labels.

Records are read as variants, so no schema is needed. A graph is told by its record alone, so a record stays in its row and nothing is
shuffled; its nodes and edges, and their leaves at any depth, are read by a small function over batches of rows. A graph comes back as one struct:

x_names, x (a row for each node), src, dst, edge_names, edge_attr (a row for each edge).

Only numeric leaves count, booleans as 1 and 0, under dotted names; a name that a node or an edge lacks is 0. If two
leaves of one node have the same dotted name, the larger counts. A graph without nodes has one featureless node.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAPH = "struct<x_names:array<string>,x:array<array<double>>,src:array<bigint>,dst:array<bigint>,edge_names:array<string>,edge_attr:array<array<double>>>"
# Fields of an edge object that are features by themselves; words in names that tell the label, safe ones first.
EDGE_FIELDS = ("edge_type", "guard_kind", "guard_branch")
SAFE = ("patched", "good", "safe", "fixed")
UNSAFE = ("bad", "vuln", "unpatched", "unsafe")
#: What Spark trims from texts before a cast, and the texts that it takes for true.
BLANK = "".join(map(chr, range(33)))
TRUE = ("t", "true", "y", "yes", "1")


def _kind(v: Column, name: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(name), F.lit(False))


def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _leaves(v, skip: tuple[str, ...] = ()) -> dict[str, float]:
    """The numeric leaves of a value under dotted names; a number that stands alone has the empty name."""
    out: dict[str, float] = {}
    todo = [("", v)]
    while todo:
        name, v = todo.pop()
        if isinstance(v, dict | list):
            ahead = f"{name}." if name else ""
            todo += [(ahead + str(k), x) for k, x in (v.items() if isinstance(v, dict) else enumerate(v))]
        elif v is not None and not isinstance(v, str) and name not in skip:
            out[name] = max(_double(v), out.get(name, -math.inf))
    return out


def _bigint(v) -> int:
    """A number, also one in a text, as Spark casts it; true is 1; anything else is 0."""
    if isinstance(v, str):
        v = v.strip(BLANK)
        if not re.fullmatch(r"[+-]?[0-9]{1,4000}", v):
            return int(v.lower() in TRUE)
        n = int(v)
        return n if -(2**63) <= n < 2**63 else 0
    if not isinstance(v, int | float) or v != v:
        return 0
    # What is too large for a key is still true.
    return int(v) if -(2.0**63) <= v < 2.0**63 else 1


def _double(v) -> float:
    if isinstance(v, str):
        v = v.strip(BLANK)
        if m := re.fullmatch(r"([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)[dDfF]?|([+-]?inf(?:inity)?|nan)", v, re.IGNORECASE):
            return float(m[1] or m[2])
        v = v.lower() in TRUE
    try:
        return float(v) if isinstance(v, int | float) else 0.0
    except OverflowError:
        return math.inf if v > 0 else -math.inf


def _ends(e) -> tuple[int, int]:
    if isinstance(e, list) and len(e) > 1:
        return _bigint(e[0]), _bigint(e[1])
    return (_bigint(e.get("src")), _bigint(e.get("dst"))) if isinstance(e, dict) else (0, 0)


def _edge_features(e) -> dict[str, float]:
    """Features of an edge. Leaves of its nested features do not replace those of its own."""
    own, nested = {}, None
    if isinstance(e, list) and len(e) > 2:
        if isinstance(e[2], dict):
            nested = e[2].get("feat", e[2])
        else:
            own["edge_type"] = _double(e[2])
    elif isinstance(e, dict):
        own = {f: _double(e[f]) for f in EDGE_FIELDS if f in e}
        # An empty attr gives way to feat, as a missing one does.
        inner = e.get("attr") or e.get("feat")
        nested = inner if isinstance(inner, dict) else None
    return _leaves(nested, ("src", "dst")) | own if nested is not None else own


def _node_rows(items: list) -> tuple[list[str], list[dict[str, float]]]:
    """Feature names, and those of each node: the leaves of ``feat``, or of the node where that is no object. Without nodes a featureless one."""
    rows = [_leaves(v["feat"] if isinstance(v, dict) and isinstance(v.get("feat"), dict) else v) for v in items]
    return sorted(set().union(*rows)), rows or [{}]


def _list(v) -> list:
    return v if isinstance(v, list) else []


def _section(section, families: list[str] | None) -> tuple:
    parts = section if isinstance(section, dict) else {}
    fams = sorted(f for f in parts if f.startswith("edges_")) if families is None else sorted(families)
    lists = [(f"fam_{f}", [v] if isinstance(v := parts.get(f), dict) else _list(v)) for f in fams]
    edges = [({flag: 1.0} | _edge_features(e), *_ends(e)) for flag, items in lists for e in items]
    flags = [flag for flag, _ in lists]
    names = flags + sorted(set().union(*(f for f, _, _ in edges)).difference(flags))
    return *_node_rows(_list(parts.get("nodes"))), [s for _, s, _ in edges], [d for _, _, d in edges], names or ["edge_attr"], [f for f, _, _ in edges]


def _configured(record, node_keys: list[str], edge_keys: dict[str, list[str]]) -> tuple:
    nodes = [v for k in dict.fromkeys(node_keys) for v in _list(record.get(k))]
    fams = sorted(edge_keys)
    edges = [(fam, e, _double(e[2] if len(e) > 2 else None) if isinstance(e, list) and len(e) > 1 else _double(e.get("attr")) if isinstance(e, dict) else 0.0) for fam in fams for field in edge_keys[fam] for e in _list(record.get(field))]
    valued = any(value != 0 for _, _, value in edges)
    ends = [_ends(e) for _, e, _ in edges]
    rows = [[float(fam == f) for f in fams] + [value] * valued for fam, _, value in edges]
    return *_node_rows(nodes), [s for s, _ in ends], [d for _, d in ends], (fams or ["edge_attr"]) + ["value"] * valued, rows


def _as_array(graphs: list[tuple | None]) -> pa.Array:
    """Graphs (names, rows, sources, targets, names, rows; a row holds values, or values by name, others being 0) as an array of GRAPH."""
    there = [g or ([], [], [], [], [], []) for g in graphs]
    lists = lambda sizes, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), pa.int32()), values)
    column = lambda i, kind: lists([len(g[i]) for g in there], pa.array([v for g in there for v in g[i]], kind))
    text = lambda i: lists([len(g[i]) for g in there], pa.array([v.encode("utf-8", "replace") for g in there for v in g[i]], pa.binary()).cast(pa.string()))

    def matrix(names: int, i: int) -> pa.Array:
        rows = [[r.get(c, 0.0) for c in g[names]] if isinstance(r, dict) else r for g in there for r in g[i]]
        return lists([len(g[i]) for g in there], lists([len(r) for r in rows], pa.array([v for r in rows for v in r], pa.float64())))

    columns = [text(0), matrix(0, 1), column(2, pa.int64()), column(3, pa.int64()), text(4), matrix(4, 5)]
    return pa.StructArray.from_arrays(columns, ["x_names", "x", "src", "dst", "edge_names", "edge_attr"], mask=pa.array([g is None for g in graphs]))


def _graph(text: Column, make: Callable[[object], tuple | None]) -> Column:
    """The graph of each JSON text, null where the text is or ``make`` finds none. Spark has found the texts to be JSON; what follows the value plays no part."""

    @F.arrow_udf(GRAPH)
    def run(texts: pa.Array) -> pa.Array:
        read = json.JSONDecoder(strict=False).raw_decode
        return _as_array([None if t is None else make(read(t.lstrip())[0]) for t in texts.to_pylist()])

    return run(text)


def section_graphs(rows: DataFrame, families: list[str] | None = None) -> DataFrame:
    """Sections (key, section: a variant with ``nodes`` and lists of edges) -> key, graph.

    Edge families are the members whose name starts with ``edges_``, or those given. An edge is [src, dst],
    [src, dst, type], [src, dst, {features}] or an object with src, dst, its own features and attr or feat; each
    has a 1 in its family's column."""
    return rows.select("key", _graph(F.to_json("section"), lambda v: _section(v, families)).alias("graph"))


def record_label(record: Column, path: Column, keyword: str | None = None, keyword_label: int = 1) -> Column:
    """0 or 1: an explicit ``label`` (a number, a truth value or digits in a text); else, if a keyword is given, whether the file name
    holds it; else the first word of either kind in the file name, then in the path; else 0."""
    kind, text = F.schema_of_variant(_get(record, "$.label")), F.trim(_get(record, "$.label", "string"))
    number = (_get(record, "$.label", "double").cast("bigint") != 0).cast("int")
    label = F.when(kind == "BOOLEAN", _get(record, "$.label", "boolean").cast("int")).when(kind == "STRING", F.when(text.rlike(r"\A\d+\z"), (~text.rlike(r"\A0+\z")).cast("int"))).when(kind != "VOID", number)
    named = F.coalesce(*[F.nullif(_get(record, f"$.{f}", "string"), F.lit("")) for f in ("file", "filename", "source_template")], F.lit(""))
    name = F.lower(F.when(F.coalesce(path, F.lit("")) != "", F.element_at(F.split(path, "/"), -1)).otherwise(named))
    if keyword:
        rule = F.when(F.contains(name, F.lit(keyword.lower())), F.lit(int(keyword_label != 0))).otherwise(F.lit(int(keyword_label == 0)))
        return F.coalesce(label, rule)
    tell = lambda s: F.when(s.rlike("|".join(SAFE)), 0).when(s.rlike("|".join(UNSAFE)), 1)
    return F.coalesce(label, tell(name), tell(F.lower(F.coalesce(path, F.lit("")))), F.lit(0))


def record_samples(rows: DataFrame, key: str, json: str, path: str | None = None, keyword: str | None = None, keyword_label: int = 1) -> DataFrame:
    """Training records (JSON texts) -> key, label, file, function_name, ast_graph, dfg_graph (null where there is no flow section).
    A text that is no JSON object gives a sample with one featureless node."""
    where = F.col(path).cast("string") if path else F.lit(None).cast("string")
    records = rows.select(F.col(key).alias("key"), where.alias("path"), F.col(json).alias("text"), F.try_parse_json(json).alias("found"))
    records = records.select("key", "path", F.when(F.col("found").isNotNull(), F.col("text")).otherwise("{}").alias("text"), F.coalesce("found", F.parse_json(F.lit("{}"))).alias("record"))
    r = F.col("record")
    first = lambda *names: F.coalesce(*[F.nullif(_get(r, f"$.{n}", "string"), F.lit("")) for n in names])
    about = [record_label(r, F.col("path"), keyword, keyword_label).alias("label"), first("file", "filename", "source_template").alias("file"), first("function_name", "function").alias("function_name")]
    part = lambda v, name: v.get(name) if isinstance(v, dict) else None
    # A flow section without members is none.
    flow = lambda v: _section(v, ["edges_dfg"]) if isinstance(v, dict) and v else None
    ast, dfg = _graph(F.col("text"), lambda v: _section(part(v, "ast"), None)), _graph(F.col("text"), lambda v: flow(part(v, "dfg")))
    return records.select("key", "text", *about).select(F.col("key").alias(key), "label", "file", "function_name", ast.alias("ast_graph"), dfg.alias("dfg_graph"))


def configured_samples(rows: DataFrame, key: str, json: str, node_keys: list[str], edge_keys: dict[str, list[str]], strict: bool = False) -> DataFrame:
    """JSON texts -> key, graph, rest (the members that are neither nodes nor edges, as JSON texts by name).

    A record with ``x`` and ``edge_index`` holds its tensors itself. Otherwise the node lists are put one after the other, and the
    edges of each family, a name for a list of members, get a 1 in its column, families in sorted order; a column ``value`` follows if any edge of the
    graph has an attribute other than 0. A text that is no JSON object is left out if strict, else an empty graph."""
    v = F.try_parse_json(json)
    records = rows.select(F.col(key).alias("key"), v.alias("record"), F.col(json).alias("text"))
    records = records.where(_kind(F.col("record"), "OBJECT")) if strict else records
    fine = _kind(F.col("record"), "OBJECT")
    records = records.select("key", F.when(fine, F.col("record")).otherwise(F.parse_json(F.lit("{}"))).alias("record"), F.when(fine, F.col("text")).otherwise("{}").alias("text"))
    r = F.col("record")
    direct = (_get(r, "$.x").isNotNull() & _get(r, "$.edge_index").isNotNull()).alias("direct")
    records = records.select("*", direct, _get(r, "$", "map<string,variant>").alias("members"))
    ends = lambda i: F.coalesce(F.get(_get(r, "$.edge_index", "array<array<bigint>>"), F.lit(i)), F.array().cast("array<bigint>"))
    flat = F.transform(_get(r, "$.edge_attr", "array<double>"), lambda a: F.array(a))
    rows_ = F.when(_kind(_get(r, "$.edge_attr[0]"), "ARRAY"), _get(r, "$.edge_attr", "array<array<double>>"))
    attr = F.coalesce(rows_, flat, F.transform(ends(0), lambda _: F.array(F.lit(0.0))))
    none = F.lit(None).cast("array<string>")
    tensors = F.struct(none.alias("x_names"), _get(r, "$.x", "array<array<double>>").alias("x"), ends(0).alias("src"), ends(1).alias("dst"), none.alias("edge_names"), attr.alias("edge_attr")).cast(GRAPH)
    graph = F.coalesce("tensors", _graph(F.col("other"), lambda v: _configured(v, node_keys, edge_keys)))
    declared = [*dict.fromkeys(node_keys), *{f for fs in edge_keys.values() for f in fs}]
    kept = lambda name: ~F.when(F.col("direct"), name.isin("x", "edge_index", "edge_attr")).otherwise(name.isin(declared))
    rest = F.transform_values(F.map_filter("members", lambda k, _: kept(k)), lambda _, v: F.to_json(v))
    parts = records.select("key", F.when(F.col("direct"), tensors).alias("tensors"), F.when(~F.col("direct"), F.col("text")).alias("other"), rest.alias("rest"))
    return parts.select(F.col("key").alias(key), graph.alias("graph"), F.when(F.size("rest") > 0, F.col("rest")).alias("rest"))


def feature_names(samples: DataFrame, *graphs: str) -> dict[str, tuple[list[str], list[str]]]:
    """Sorted node and edge feature names of each graph column over all samples; their number is that of different names."""
    out = {}
    for g in graphs:
        found = [samples.select(F.explode(f"{g}.{c}").alias("n")).agg(F.array_sort(F.collect_set("n")).alias("n")).first()["n"] for c in ("x_names", "edge_names")]
        out[g] = (found[0], found[1])
    return out


def harmonised(samples: DataFrame, names: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """The samples with the same feature columns in all graphs; a feature that a graph lacks is 0."""

    def wide(rows: Column, own: Column, wanted: list[str]) -> Column:
        places = F.transform(F.array(*[F.lit(n) for n in wanted]).cast("array<string>"), lambda n: F.array_position(own, n).cast("int"))
        value = lambda r, p: F.when(p > 0, F.get(r, p - 1)).otherwise(F.lit(0.0))
        return F.transform(rows, lambda r: F.transform(places, lambda p: F.coalesce(value(r, p), F.lit(0.0))))

    for g, (x, e) in names.items():
        c = F.col(g)
        graph = F.struct(F.array(*[F.lit(n) for n in x]).cast("array<string>").alias("x_names"), wide(c["x"], c["x_names"], x).alias("x"), c["src"].alias("src"), c["dst"].alias("dst"), F.array(*[F.lit(n) for n in e]).cast("array<string>").alias("edge_names"), wide(c["edge_attr"], c["edge_names"], e).alias("edge_attr"))
        samples = samples.withColumn(g, F.when(c.isNotNull(), graph))
    return samples
