"""Property-graph documents in GraphSON: a raw object, any depth of ``@value`` wrapping, a list of
such, or one under ``export``. Vertices become ``nodes``, edges ``edges``; both keep the order of
the document in ``ord``. Keys are ``document#id``, as ids are unique within a document only.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlens.session import checkpointed

#: Levels of ``@value`` around a value that are opened at a time.
WRAPS = 6
#: Levels of a lone ``@value`` or ``export`` around a graph that are entered at once; deeper ones take rounds.
STRAIGHT = 3
# Property -> column, type.
PROPERTIES = {
    "NAME": ("name", "string"), "CODE": ("code", "string"), "LINE_NUMBER": ("line", "int"), "CANONICAL_NAME": ("canonical_name", "string"), "FILENAME": ("filename", "string"),
    "IS_EXTERNAL": ("is_external", "boolean"), "ARGUMENT_INDEX": ("argument_index", "int"), "INDEX": ("index", "int"), "CONTROL_STRUCTURE_TYPE": ("control_type", "string"),
    "TYPE_FULL_NAME": ("type_full_name", "string"), "SIGNATURE": ("signature", "string"), "AST_PARENT_FULL_NAME": ("ast_parent_full_name", "string"),
    "METHOD_FULL_NAME": ("method_full_name", "string"), "ALIAS_TYPE_FULL_NAME": ("alias_type_full_name", "string"),
}


def unwrapped(v: str | Column, kind: str, path: str = "$", wraps: int = WRAPS) -> Column:
    """A value at a path, under up to ``wraps`` ``@value`` levels; lists of one count as their
    element, empty lists as null. ``opened`` deals with values under more."""
    paths = [path + '["@value"]' * n + "[0]" * last for n in range(wraps, -1, -1) for last in (1, 0)]
    return F.coalesce(*[F.try_variant_get(v, p, kind) for p in paths])


def _straightened(x: Column, kind: str) -> Column:
    """A wrapped value. One under more than WRAPS levels, or wrapped inside a list, is opened as often as it names ``@value``, twice for lists, in its row."""
    at = lambda v, n: F.try_variant_get(v, "$" + '["@value"]' * n, "variant")
    def under_more_than(wraps: int) -> Column:
        more = ["$" + '["@value"]' * (wraps + 1), *("$" + '["@value"]' * n + '[0]["@value"]' for n in range(wraps + 1))]
        return F.coalesce(*[F.try_variant_get(x, p, "variant") for p in more]).isNotNull()

    times = F.when(under_more_than(WRAPS), 2 * F.regexp_count(F.to_json(x), F.lit('"@value"'))).otherwise(0)

    def inner(v: Column, _: Column) -> Column:
        listed = F.try_variant_get(v, '$[0]["@value"]', "variant").isNotNull() & F.try_variant_get(v, "$[1]", "variant").isNull()
        deepest = F.coalesce(*[at(v, n) for n in range(WRAPS, 0, -1)])
        return F.when(at(v, 1).isNotNull(), deepest).when(listed, F.try_variant_get(v, "$[0]", "variant")).otherwise(v)

    def told(v: Column, wraps: int) -> Column:
        """A null has no text, and is not told by its wrapper's."""
        null = F.is_variant_null(F.coalesce(*[at(v, n) for n in range(wraps, 0, -1)]))
        return F.when(~null, unwrapped(v, kind, wraps=wraps)) if kind == "string" else unwrapped(v, kind, wraps=wraps)

    any_depth = F.aggregate(F.array_repeat(F.lit(0), times), x, inner, lambda v: told(v, WRAPS))
    # Most values are under one or two levels, where few looks tell them.
    return F.when(~under_more_than(1), told(x, 1)).when(~under_more_than(2), told(x, 2)).otherwise(any_depth)


def opened(rows: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Members (doc, ord, v, others) -> the same without v, and a column for each field: name -> (path, type), the path being ``$.a`` or ``$.a.b``.
    Every member is read once and in its row, however deep its values are wrapped."""
    others = [c for c in rows.columns if c != "v"]
    places = {c: path.split(".")[1:] for c, (path, _) in fields.items()}
    tops = list(dict.fromkeys(p[0] for p in places.values()))
    below = {t: [p[1] for p in places.values() if p[0] == t and len(p) > 1] for t in tops}
    parts = lambda v, names: F.try_variant_get(v, "$", "struct<" + ",".join(f"`{n}`:variant" for n in names) + ">")
    rows = rows.select(*others, parts("v", tops).alias("_top"))
    rows = rows.select(*others, F.col("_top").alias("_0"), *[parts(F.col(f"_top.`{t}`"), names).alias(f"_below_{t}") for t, names in below.items() if names])
    # A generator keeps what is asked of the fields from being moved ahead of it, where each mention of a field would look it up again.
    own = {c: F.col(f"_below_{p[0]}.`{p[1]}`") if len(p) > 1 else F.col(f"_0.`{p[0]}`") for c, p in places.items()}
    rows = rows.select(*others, F.inline(F.array(F.struct(*[x.alias(f"_{c}") for c, x in own.items()]))))
    wraps = lambda x: F.coalesce(F.try_variant_get(x, '$["@value"]', "variant"), F.try_variant_get(x, "$[0]", "variant")).isNotNull()
    value = lambda x, kind: F.when(wraps(x), _straightened(x, kind)).otherwise(F.try_variant_get(x, "$", kind))
    return rows.select(*others, *[value(F.col(f"_{c}"), kind).alias(c) for c, (_, kind) in fields.items()])


def joined_scalar(v: str, path: str) -> Column:
    """A property whose several values are joined by a slash."""
    lists = [F.try_variant_get(v, path + '["@value"]' * n, "array<string>") for n in range(WRAPS, -1, -1)]
    return F.coalesce(F.array_join(F.coalesce(*lists), "/"), unwrapped(v, "string", path))


def read_documents(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """doc, v (variant; null where the text is no JSON) of all JSON files below a path."""
    files = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.json").option("wholetext", True).text(path)
    return files.select(F.col("_metadata.file_path").alias("doc"), F.try_parse_json("value").alias("v"))


def _has() -> Column:
    """Whether v has vertices or edges. The first of a list is asked for ahead of the list, as what is got is copied."""
    return F.coalesce(*[F.try_variant_get("v", p, "variant") for p in ("$.vertices[0]", "$.edges[0]", "$.vertices", "$.edges")]).isNotNull()


def _read(docs: DataFrame) -> DataFrame:
    """doc, v, has, is_json, written once: v is the graph of a document (has), or what is left of it when no single way leads on. A member
    ``@value`` or ``export`` that stands alone is entered at once, several levels deep, without a row or a shuffle for each level."""
    at = docs.select("doc", "v", F.col("v").isNotNull().alias("is_json"), _has().alias("has"))
    for _ in range(STRAIGHT):
        one, other = F.try_variant_get("v", '$["@value"]', "variant"), F.try_variant_get("v", "$.export", "variant")
        at = at.select("doc", "v", "is_json", "has", F.when(~F.col("has"), one).alias("a"), F.when(~F.col("has"), other).alias("b"))
        alone = F.coalesce(F.when(F.col("b").isNull(), F.col("a")), F.when(F.col("a").isNull(), F.col("b")))
        at = at.select("doc", "is_json", "has", F.coalesce(alone, F.col("v")).alias("v"))
        at = at.select("doc", "v", "is_json", (F.col("has") | _has()).alias("has"))
    return checkpointed(at)


def _bodies(read: DataFrame) -> DataFrame:
    """One row for each graph of a document: doc, part, v with vertices and edges. ``part`` numbers the graphs
    in the order of the document. Each round opens one level of lists, ``@value`` and ``export``."""
    spark, only = read.sparkSession, read.where("has").select("doc", F.lit(0).cast("long").alias("part"), "v")
    at, out = read.where(~F.col("has") & F.col("v").isNotNull()).select("doc", F.array().cast("array<int>").alias("place"), "v"), None
    while not at.isEmpty():
        has = _has()
        here = at.where(has)
        out = here if out is None else out.unionByName(here)
        member = spark.tvf.variant_explode(F.col("v").outer()).select("pos", "key", F.col("value").alias("_value"))
        # Scalars have no members and end here.
        inner = at.where(~has).lateralJoin(member).where(F.col("key").isNull() | F.col("key").isin("@value", "export"))
        at = checkpointed(inner.select("doc", F.concat("place", F.array(F.coalesce("pos", F.lit(0)))).alias("place"), F.col("_value").alias("v")))
    if out is None:
        return only
    part = F.dense_rank().over(Window.partitionBy("doc").orderBy("place")) - 1
    return only.unionByName(out.select("doc", part.cast("long").alias("part"), "v"))


def _members(bodies: DataFrame, field: str) -> DataFrame:
    rows = bodies.select("doc", "part", F.try_variant_get("v", f"$.{field}", "variant").alias("_list")).where(F.col("_list").isNotNull())
    member = bodies.sparkSession.tvf.variant_explode(F.col("_list").outer()).select("pos", F.col("value").alias("_value"))
    return rows.lateralJoin(member).select("doc", (F.col("part") * (1 << 32) + F.col("pos")).alias("ord"), F.col("_value").alias("v"))


NODE = {"node_id": ("$.id", "bigint"), "label": ("$.label", "string")} | {c: (f"$.properties.{p}", t) for p, (c, t) in PROPERTIES.items()}
EDGE = {"label": ("$.label", "string"), "out": ("$.outV", "bigint"), "in": ("$.inV", "bigint"), "variable": ("$.properties.VARIABLE", "string")}


def load(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (doc, v) -> nodes and edges. Edges without both ends or a label are dropped."""
    bodies = _bodies(_read(docs))
    nodes = opened(_members(bodies, "vertices"), NODE).where(F.col("node_id").isNotNull())
    nodes = nodes.select(F.concat_ws("#", "doc", F.col("node_id").cast("string")).alias("id"), "doc", "ord", *NODE)
    end = lambda c: F.concat_ws("#", "doc", F.col(c).cast("string"))
    edges = opened(_members(bodies, "edges"), EDGE).where(F.col("out").isNotNull() & F.col("in").isNotNull() & F.col("label").isNotNull())
    return nodes, edges.select("doc", "ord", "label", end("out").alias("src"), end("in").alias("dst"), "variable")


_NEEDS = {"vertices": ("$.id", "$.label"), "edges": ("$.label", "$.outV", "$.inV")}


def _incomplete(field: str) -> Column:
    lacks = functools.reduce(operator.or_, [F.try_variant_get("v", p, "variant").isNull() for p in _NEEDS[field]])
    return F.when(lacks, F.lit(f"incomplete {field}"))


def _whole_problems(read: DataFrame, bodies: DataFrame) -> DataFrame:
    bad = read.where(~F.col("is_json")).select("doc", F.lit("not JSON").alias("problem"))
    # A document that is one graph needs no look for others.
    rest = read.where(F.col("is_json") & ~F.col("has")).select("doc")
    return bad.unionByName(rest.join(bodies.select("doc"), "doc", "left_anti").select("doc", F.lit("no graph").alias("problem")))


def validate(docs: DataFrame) -> DataFrame:
    """doc, problem: documents that are no JSON, hold no graph, or have members without their fields."""
    read = _read(docs)
    bodies = _bodies(read)
    out = _whole_problems(read, bodies)
    for field in _NEEDS:
        out = out.unionByName(_members(bodies, field).select("doc", _incomplete(field).alias("problem")).where("problem IS NOT NULL").distinct())
    return out


def outcomes(docs: DataFrame) -> DataFrame:
    """doc, ok, error, n_nodes, n_edges of every document: a broken one is a row, and keeps no other from being read. Members are opened once,
    for their number and their problems, and are summed up by document before any shuffle."""
    read = _read(docs)
    bodies = _bodies(read)
    fields = {"vertices": {"node_id": NODE["node_id"]}, "edges": {c: EDGE[c] for c in ("label", "out", "in")}}
    said = _whole_problems(read, bodies).select("doc", F.lit(0).alias("vertices"), F.lit(0).alias("edges"), "problem")
    for field, wanted in fields.items():
        members = opened(_members(bodies, field).withColumn("problem", _incomplete(field)), wanted)
        good = functools.reduce(operator.and_, [F.col(c).isNotNull() for c in wanted]).cast("int")
        said = said.unionByName(members.select("doc", *[(good if f == field else F.lit(0)).alias(f) for f in fields], "problem"))
    found = said.groupBy("doc").agg(F.sum("vertices").alias("n_nodes"), F.sum("edges").alias("n_edges"), F.nullif(F.array_join(F.array_sort(F.collect_set("problem")), "; "), F.lit("")).alias("error"))
    rows = read.select("doc").join(found, "doc", "left")
    return rows.select("doc", F.col("error").isNull().alias("ok"), "error", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def count_methods(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("doc").agg(F.count_if(F.col("label") == "METHOD").alias("n"))


def merge_files(rows: DataFrame, key: str = "key", value: str = "value", order: str = "file_ord") -> DataFrame:
    """Of each key the value of the last file."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))
