"""Feature and label preparation, evaluation metrics and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.session import checkpointed

# Words in names that tell the label; the safe ones are tried first.
SAFE_WORDS = ("good", "safe", "patched", "benign", "fixed")
UNSAFE_WORDS = ("bad", "vulnerable", "unsafe", "malicious")


def flatten_json(rows: DataFrame, key: str, json: str) -> DataFrame:
    """key, name, value: numeric leaves of a JSON text under dotted names; booleans are 1 and 0,
    strings and nulls drop out. Arrays count their elements from 0. Each round opens one level, until none is left."""
    return flatten_variants(rows.select(key, F.try_parse_json(json).alias("v")), [key], "v").where(F.col("name") != "")


def flatten_variants(rows: DataFrame, keys: list[str], variant: str) -> DataFrame:
    """keys, name, value as in ``flatten_json``, of a variant column; a number that stands alone has the empty name."""
    at = rows.select(*keys, F.lit("").alias("name"), F.col(variant).alias("v"))
    out = None
    while out is None or not at.isEmpty():
        kind = F.schema_of_variant("v")
        leaf = at.where(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY"))
        value = F.coalesce(F.try_variant_get("v", "$", "double"), F.try_variant_get("v", "$", "boolean").cast("int").cast("double"))
        leaf = leaf.where(~F.schema_of_variant("v").isin("STRING", "VOID")).select(*keys, "name", value.alias("value"))
        out = leaf if out is None else out.unionByName(leaf)
        inner = at.where(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
        at = checkpointed(_children(inner, keys))
    return out


def _children(inner: DataFrame, keys: list[str]) -> DataFrame:
    """The members of objects and arrays, one level down."""
    member = inner.sparkSession.tvf.variant_explode(F.col("v").outer()).select(F.col("pos").alias("_pos"), F.col("key").alias("_key"), F.col("value").alias("_value"))
    name = F.concat(F.when(F.col("name") == "", F.lit("")).otherwise(F.concat("name", F.lit("."))), F.coalesce("_key", F.col("_pos").cast("string")))
    return inner.lateralJoin(member).select(*keys, name.alias("name"), F.col("_value").alias("v"))


def column_union(features: DataFrame, by: str | None = None) -> DataFrame:
    """names: the sorted union of feature names."""
    agg = F.array_sort(F.collect_set("name")).alias("names")
    return features.groupBy(by).agg(agg) if by else features.agg(agg)


def matrix(features: DataFrame, key: list[str], names: list[str]) -> DataFrame:
    """One column for each name, missing values 0."""
    wide = features.groupBy(*key).pivot("name", names).agg(F.first("value"))
    return wide.fillna(0.0, subset=names)


def one_hot(rows: DataFrame, column: str, values: list[str], prefix: str = "is_") -> DataFrame:
    """One 0/1 column for each value."""
    return rows.select("*", *[(F.coalesce(F.col(column) == v, F.lit(False))).cast("int").alias(f"{prefix}{v}") for v in values])


def harmonise(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union by name; features that a frame lacks are 0."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.fillna(0, subset=[c for c in out.columns if c not in keys])


def normalise_edges(rows: DataFrame, edge: str) -> DataFrame:
    """Edges given as [src, dst, ...] or {src, dst, ...} JSON texts -> src, dst, attrs (a variant)."""
    v = F.try_parse_json(edge)
    pick = lambda *paths: F.coalesce(*[F.try_variant_get(v, p, "bigint") for p in paths])
    rest = F.coalesce(F.try_variant_get(v, "$[2]", "variant"), F.try_variant_get(v, "$.attr", "variant"))
    return rows.withColumn("src", pick("$[0]", "$.src", "$.source")).withColumn("dst", pick("$[1]", "$.dst", "$.destination", "$.target")).withColumn("attrs", rest)


def keyword_label(name: Column | str) -> Column:
    """0 if a safe word occurs, else 1 if an unsafe one does, else null; safe words come first, so
    "unsafe" counts as safe, as it holds that word."""
    text = F.lower(F.col(name) if isinstance(name, str) else name)
    return F.when(text.rlike("|".join(SAFE_WORDS)), 0).when(text.rlike("|".join(UNSAFE_WORDS)), 1)


def infer_label(explicit: Column, positive_keyword: Column, keyword_known: Column, filename: Column, path: Column) -> Column:
    """The first that tells: an explicit label, a keyword partition (its absence means the other
    label), the file name, the path."""
    partition = F.when(keyword_known, positive_keyword.cast("int"))
    return F.coalesce(explicit.cast("int"), partition, keyword_label(filename), keyword_label(path))


def collate(rows: DataFrame, batch: Column, order: str, *columns: str) -> DataFrame:
    """batch, n and an array of each column, in order: samples of a batch side by side."""
    packed = F.array_sort(F.collect_list(F.struct(order, *columns))).alias("x")
    out = rows.groupBy(batch.alias("batch")).agg(F.count("*").alias("n"), packed)
    side = lambda c: F.transform("x", lambda s: s[c]).alias(c)
    return out.select("batch", "n", *[side(c) for c in columns])


def dims(rows: DataFrame, vector: str, *by: str) -> DataFrame:
    """The width that vectors need, by some columns."""
    return rows.groupBy(*by).agg(F.max(F.size(vector)).alias("dim"))


def graph_tables(graphs: DataFrame, graph: str, nodes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """Graphs with arrays of nodes and of edges -> node rows (graph_id, pos, node) and edge rows (graph_id, pos, edge);
    graph_id is made from the graph's key."""
    key = F.xxhash64(graph).alias("graph_id")
    return graphs.select(key, F.posexplode(nodes).alias("pos", "node")), graphs.select(key, F.posexplode(edges).alias("pos", "edge"))


def counts(rows: DataFrame, column: str | Column, name: str | None = None) -> DataFrame:
    """value, n: how often each value occurs, most often first."""
    c = F.col(column) if isinstance(column, str) else column
    name = name or str(column)
    return rows.groupBy(c.alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first(name))


def success_summary(rows: DataFrame, ok: Column, *by: str) -> DataFrame:
    """success_rate and n, by some columns."""
    agg = [F.round(F.avg(ok.cast("int")), 6).alias("success_rate"), F.count("*").alias("n")]
    return rows.groupBy(*by).agg(*agg) if by else rows.agg(*agg)


def samples(records: DataFrame, key: str, nodes: str, edges: str, features: list[str], label: Column) -> DataFrame:
    """Training records -> key, x (a row of numbers for each node, in the order of the array), src, dst (places of the
    ends among the nodes), label, n_nodes. Nodes are structs with ``sid`` and the features, edges structs with ``src`` and
    ``dst``; an edge with an end that is no node drops out. Missing features count as 0."""
    sids = F.transform(nodes, lambda s: s["sid"])
    kept = F.filter(edges, lambda e: F.array_contains(sids, e["src"]) & F.array_contains(sids, e["dst"]))
    end = lambda c: F.transform(kept, lambda e: (F.array_position(sids, e[c]) - 1).cast("int"))
    x = F.transform(nodes, lambda s: F.array(*[F.coalesce(s[f].cast("double"), F.lit(0.0)) for f in features]))
    return records.select(key, x.alias("x"), F.coalesce(end("src"), F.array().cast("array<int>")).alias("src"), F.coalesce(end("dst"), F.array().cast("array<int>")).alias("dst"), label.alias("label"), F.size(nodes).alias("n_nodes"))


def convert(rows: DataFrame, json: str, config: dict[str, tuple[str, str]]) -> DataFrame:
    """Samples from JSON texts by a configuration: column -> (path, type). A path may lead to a tensor (an array type)
    or to a list of node or edge objects (a type such as array<struct<...>>). A value that does not fit is null."""
    v = F.try_parse_json(json)
    return rows.select("*", *[F.try_variant_get(v, path, kind).alias(name) for name, (path, kind) in config.items()])


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """label, n, weight: total / (C * sqrt(n)), scaled so that the weights sum to C."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    raw = counts.withColumn("c", F.count("*").over(every)).withColumn("raw", F.sum("n").over(every) / (F.col("c") * F.sqrt(F.col("n"))))
    return raw.select(label, "n", (F.col("raw") * F.col("c") / F.sum("raw").over(every)).alias("weight"))


def split(rows: DataFrame, by: str, order: Column, ratio: float) -> DataFrame:
    """Adds part: the first round(n * ratio) rows of each data set by an order are train, at least one
    and at most all but one; a single row is train."""
    w = Window.partitionBy(by)
    n = F.count("*").over(w)
    cut = F.greatest(F.least(F.round(n * ratio), n - 1), F.lit(1))
    return rows.withColumn("part", F.when(F.row_number().over(w.orderBy(order)) <= cut, "train").otherwise("test"))


def label_stats(rows: DataFrame, by: str, label: str) -> DataFrame:
    """Rows and positives by data set and over all (rollup)."""
    return rows.rollup(by).agg(F.count("*").alias("n"), F.sum(F.col(label)).alias("positives"))


def pool(rows: DataFrame, by: str, vector: str) -> DataFrame:
    """by, dim, mean, max of vectors."""
    return rows.select(by, F.posexplode(vector).alias("dim", "x")).groupBy(by, "dim").agg(F.avg("x").alias("mean"), F.max("x").alias("max"))


def message_pass(edges: DataFrame, features: DataFrame) -> DataFrame:
    """One sum aggregation over in-neighbours: features (id, dim, x) and edges (src, dst)."""
    return edges.join(features.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id"), "dim").agg(F.sum("x").alias("x"))


def softmax(logits: Column | str) -> Column:
    """struct(probs, predicted, confidence) of an array of logits."""
    bound = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))

    def out(x: Column, e: Column, total: Column) -> Column:
        probs = F.transform(e, lambda v: v / total)
        return F.struct(probs.alias("probs"), (F.array_position(x, F.array_max(x)) - 1).cast("int").alias("predicted"), (F.lit(1.0) / total).alias("confidence"))

    # Each part is named by a function's parameter, as an expression inside a function runs again for each element.
    exps = lambda x: bound(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top)))
    summed = lambda x, e: bound(F.aggregate(e, F.lit(0.0), lambda a, v: a + v), lambda total: out(x, e, total))
    return bound(F.col(logits) if isinstance(logits, str) else logits, lambda x: bound(exps(x), lambda e: summed(x, e)))


def confusion(rows: DataFrame, truth: str, predicted: str, *by: str) -> DataFrame:
    """n, accuracy and the four cells."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    n = lambda c: F.count_if(c)
    agg = [F.count("*").alias("n"), n(t & p).alias("tp"), n(~t & ~p).alias("tn"), n(~t & p).alias("fp"), n(t & ~p).alias("fn"), F.round(F.avg((F.col(truth) == F.col(predicted)).cast("double")), 6).alias("accuracy")]
    return rows.groupBy(*by).agg(*agg) if by else rows.agg(*agg)


def misclassified(rows: DataFrame, truth: str, predicted: str, confidence: str, key: str, top: int = 20) -> DataFrame:
    """The wrong predictions of highest confidence."""
    return rows.where(F.col(truth) != F.col(predicted)).orderBy(F.desc(confidence), key).limit(top)


def latest_checkpoint(files: DataFrame, path: str = "path", pattern: str = r"(\d+)\.[A-Za-z]+$") -> DataFrame:
    """The path with the largest number before its suffix."""
    n = F.expr(f"try_cast(regexp_extract({path}, '{pattern}', 1) AS BIGINT)".replace("\\", "\\\\"))
    return files.agg(F.max_by(path, n).alias("path"))


def flag_sums(rows: DataFrame, **flags: Column) -> DataFrame:
    return rows.agg(*[F.sum(c.cast("int")).alias(k) for k, c in flags.items()])


def degree_stats(rows: DataFrame, by: str, *columns: str) -> DataFrame:
    agg = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", lambda c: F.round(F.avg(c), 6)), ("max", F.max), ("min", F.min))]
    return rows.groupBy(by).agg(*agg)


def histogram(rows: DataFrame, value: str, low: int = 10, high: int = 50) -> DataFrame:
    """bin, n: as many equal bins as distinct values, between two bounds."""
    lo, hi, d = F.min(value).alias("lo"), F.max(value).alias("hi"), F.count_distinct(value).alias("d")
    span = rows.agg(lo, hi, d)
    k = F.greatest(F.least("d", F.lit(high)), F.lit(low))
    at = F.least(F.floor((F.col(value) - F.col("lo")) * k / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))), k - 1)
    return rows.where(F.col(value).isNotNull()).crossJoin(F.broadcast(span)).groupBy(F.coalesce(at, F.lit(0)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def compare(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, verdict (equal, changed, only_a, only_b) of two tables."""
    left = a.select(*keys, F.struct(*values).alias("va"), F.lit(True).alias("ina"))
    right = b.select(*keys, F.struct(*values).alias("vb"), F.lit(True).alias("inb"))
    verdict = F.when(F.col("ina").isNull(), "only_b").when(F.col("inb").isNull(), "only_a").when(F.col("va").eqNullSafe(F.col("vb")), "equal").otherwise("changed")
    return left.join(right, keys, "full").select(*keys, verdict.alias("verdict"))


def differences(a: DataFrame, b: DataFrame, key: str, items: str) -> DataFrame:
    """key, missing, added, size_delta of the array column in two tables."""
    both = a.select(key, F.col(items).alias("x")).join(b.select(key, F.col(items).alias("y")), key)
    return both.select(key, F.array_sort(F.array_except("x", "y")).alias("missing"), F.array_sort(F.array_except("y", "x")).alias("added"), (F.size("y") - F.size("x")).alias("size_delta"))


def pairs(a: DataFrame, b: DataFrame, path: str = "path") -> DataFrame:
    """name, a, b: files of two runs by base name; b is null where there is none."""
    base = F.element_at(F.split(path, "/"), -1)
    return a.select(base.alias("name"), F.col(path).alias("a")).join(b.select(base.alias("name"), F.col(path).alias("b")), "name", "left")


def downsample(rows: DataFrame, by: str, order: str, max_points: int) -> DataFrame:
    """Every ceil(n / max_points)-th row of a series."""
    w = Window.partitionBy(by)
    stride = F.ceil(F.count("*").over(w) / max_points)
    return rows.withColumn("_at", F.row_number().over(w.orderBy(order)) - 1).withColumn("_by", stride).where(F.col("_at") % F.col("_by") == 0).drop("_at", "_by")
