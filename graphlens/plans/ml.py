"""Feature, label and metric operators over events, labels, embeddings and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlens.operators import mlprep
from graphlens.plans.registry import query
from graphlens.session import table

TYPES = ["click", "error", "purchase", "signup", "view"]
_K = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"


@query("n01_flatten", f"SELECT event_id, 'k' AS name, {_K} AS value FROM events")
def n01(spark, d):
    return mlprep.flatten_json(table(spark, d, "events").select("event_id", "props"), "event_id", "props")


@query("n02_columns", "SELECT event_type, 'k' AS names FROM events GROUP BY 1")
def n02(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", F.explode(F.map_keys(F.from_json("props", "map<string,string>"))).alias("name"))
    return mlprep.column_union(e, "event_type").select("event_type", F.array_join("names", ",").alias("names"))


@query("n03_matrix", "SELECT user_id, coalesce(round(sum(value) FILTER (event_type = 'click'), 6), 0) AS click, coalesce(round(sum(value) FILTER (event_type = 'view'), 6), 0) AS \"view\" FROM events GROUP BY 1")
def n03(spark, d):
    long = table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("name")).agg(F.round(F.sum("value"), 6).alias("value"))
    return mlprep.matrix(long, ["user_id"], ["click", "view"])


@query("n04_edges", "SELECT l_orderkey AS src, l_partkey AS dst, count(*) AS n FROM lineitem GROUP BY ALL")
def n04(spark, d):
    li = table(spark, d, "lineitem")
    as_list = F.to_json(F.array("l_orderkey", "l_partkey"))
    as_object = F.to_json(F.struct(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")))
    rows = mlprep.normalise_edges(li.select(F.when(F.col("l_linenumber") % 2 == 0, as_list).otherwise(as_object).alias("e")), "e")
    return rows.groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("n05_one_hot", "SELECT user_id, " + ", ".join(f"sum((event_type = '{t}')::INTEGER)::BIGINT AS is_{t}" for t in TYPES) + " FROM events GROUP BY 1")
def n05(spark, d):
    e = mlprep.one_hot(table(spark, d, "events").select("user_id", "event_type"), "event_type", TYPES)
    return e.groupBy("user_id").agg(*[F.sum(f"is_{t}").alias(f"is_{t}") for t in TYPES])


@query("n06_label", "SELECT p_partkey, CASE WHEN p_size = 1 THEN 1 WHEN p_type IN ('PROMO', 'SMALL') THEN (p_type = 'PROMO')::INTEGER WHEN p_name LIKE '%red%' THEN NULL END AS label FROM part")
def n06(spark, d):
    t = F.col("p_type")
    label = mlprep.infer_label(F.when(F.col("p_size") == 1, 1), t == "PROMO", t.isin("PROMO", "SMALL"), F.col("p_name"), F.lit(""))
    return table(spark, d, "part").select("p_partkey", label.alias("label"))


@query("n09_harmonise", "SELECT 'c' AS kind, c_custkey AS id, c_acctbal AS balance, 0.0::DOUBLE AS price FROM customer UNION ALL SELECT 'p', p_partkey, 0, p_retailprice FROM part")
def n09(spark, d):
    c = table(spark, d, "customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    p = table(spark, d, "part").select(F.lit("p").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"))
    return mlprep.harmonise([c, p], ["kind", "id"])


@query("n10_collate", "SELECT event_id // 32 AS batch, count(*) AS n, string_agg(event_type, ',' ORDER BY event_id) AS types FROM events GROUP BY 1")
def n10(spark, d):
    b = mlprep.collate(table(spark, d, "events"), F.floor(F.col("event_id") / 32), "event_id", "event_type")
    return b.select("batch", "n", F.array_join("event_type", ",").alias("types"))


@query("n11_dims", "SELECT label, max(len(embedding))::INTEGER AS dim FROM embeddings GROUP BY 1")
def n11(spark, d):
    return mlprep.dims(table(spark, d, "embeddings"), "embedding", "label")


@query("n12_weights", "WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1), r AS (SELECT *, count(*) OVER () AS k, (sum(n) OVER ())::BIGINT / (count(*) OVER () * sqrt(n)) AS raw FROM c) SELECT quality, n, round(raw * k / sum(raw) OVER (), 9) AS weight FROM r")
def n12(spark, d):
    return mlprep.class_weights(table(spark, d, "labels"), "quality").withColumn("weight", F.round("weight", 9))


@query("n13_split", "WITH x AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY (doc_id * 1103515245 + 12345) % 2147483648, doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT doc_id, CASE WHEN r <= greatest(least(round(n * 0.8), n - 1), 1) THEN 'train' ELSE 'test' END AS part FROM x")
def n13(spark, d):
    order = F.struct((F.col("doc_id") * 1103515245 + 12345) % 2147483648, F.col("doc_id"))
    return mlprep.split(table(spark, d, "documents").select("doc_id", "source"), "source", order, 0.8).select("doc_id", "part")


@query("n14_label_stats", "SELECT quality, count(*) AS n, sum(toxic)::BIGINT AS positives FROM labels GROUP BY ROLLUP (quality)")
def n14(spark, d):
    return mlprep.label_stats(table(spark, d, "labels"), "quality", "toxic")


@query("n16_pool", "SELECT label, dim::INTEGER AS dim, round(avg(x), 6) AS mean, round(max(x), 6) AS max FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL")
def n16(spark, d):
    v = table(spark, d, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return mlprep.pool(v, "label", "v").select("label", "dim", F.round("mean", 6).alias("mean"), F.round("max", 6).alias("max"))


@query("n15_message_pass", "SELECT l_orderkey AS id, 0 AS dim, round(sum(p_retailprice), 3) AS x FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def n15(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_orderkey").alias("dst"))
    f = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit(0).alias("dim"), F.col("p_retailprice").alias("x"))
    return mlprep.message_pass(e, f).withColumn("x", F.round("x", 3))


@query("n21_softmax", "WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings), m AS (SELECT vec_id, e, list_max(e) AS t FROM x) SELECT vec_id, (list_position(e, t) - 1)::INTEGER AS predicted, round(1 / list_sum(list_transform(e, lambda v: exp(v - t))), 6) AS confidence FROM m")
def n21(spark, d):
    s = mlprep.softmax(F.transform("embedding", lambda x: x.cast("double")))
    return table(spark, d, "embeddings").select("vec_id", s.alias("s")).select("vec_id", "s.predicted", F.round("s.confidence", 6).alias("confidence"))


@query("n19_confusion", "SELECT count(*) AS n, count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality <> 1 AND toxic <> 1) AS tn, count(*) FILTER (quality <> 1 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic <> 1) AS fn, round(avg((quality = toxic)::INTEGER), 6) AS accuracy FROM labels")
def n19(spark, d):
    return mlprep.confusion(table(spark, d, "labels"), "quality", "toxic")


@query("n19_top", "SELECT doc_id, quality, toxic FROM labels WHERE quality <> toxic ORDER BY (doc_id * 7919) % 1000 DESC, doc_id LIMIT 20")
def n19b(spark, d):
    rows = table(spark, d, "labels").withColumn("confidence", (F.col("doc_id") * 7919) % 1000)
    return mlprep.misclassified(rows, "quality", "toxic", "confidence", "doc_id").select("doc_id", "quality", "toxic")


@query("n20_accuracy", "SELECT round(avg((quality = toxic)::INTEGER), 6) AS accuracy FROM labels")
def n20(spark, d):
    return mlprep.confusion(table(spark, d, "labels"), "quality", "toxic").select("accuracy")


@query("n22_latest", "SELECT max(doc_id)::VARCHAR AS n FROM documents")
def n22(spark, d):
    files = table(spark, d, "documents").select(F.concat(F.lit("run/epoch_"), F.col("doc_id").cast("string"), F.lit(".pt")).alias("path"))
    return mlprep.latest_checkpoint(files).select(F.regexp_extract("path", r"(\d+)", 1).alias("n"))


@query("n24_extract", "SELECT count(*) AS n_nodes, sum(n)::BIGINT AS n_edges FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)")
def n24(spark, d):
    docs = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("edges")).withColumn("nodes", F.array("l_orderkey"))
    n, e = mlprep.graph_tables(docs, "l_orderkey", "nodes", "edges")
    n, e = n.groupBy("graph_id").agg(F.count("*").alias("nodes")), e.groupBy("graph_id").agg(F.count("*").alias("edges"))
    return n.join(e, "graph_id").agg(F.sum("nodes").alias("n_nodes"), F.sum("edges").alias("n_edges"))


@query("n25_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def n25(spark, d):
    return mlprep.counts(table(spark, d, "events"), "event_type")


@query("n26_flags", "SELECT sum((event_type = 'error')::INTEGER)::BIGINT AS errors, sum((value > 100)::INTEGER)::BIGINT AS large FROM events")
def n26(spark, d):
    return mlprep.flag_sums(table(spark, d, "events"), errors=F.col("event_type") == "error", large=F.col("value") > 100)


@query("n27_degrees", "SELECT event_type, round(avg(value), 6) AS value_mean, max(value) AS value_max, min(value) AS value_min FROM events GROUP BY 1")
def n27(spark, d):
    return mlprep.degree_stats(table(spark, d, "events"), "event_type", "value")


@query("n28_calls", "SELECT CASE WHEN p_size > 30 THEN NULL ELSE p_name END AS name, count(*) AS n FROM part GROUP BY 1")
def n28(spark, d):
    return mlprep.counts(table(spark, d, "part"), F.when(F.col("p_size") <= 30, F.col("p_name")), "name")


@query("n29_histogram", "WITH s AS (SELECT min(p_size) AS lo, max(p_size) AS hi, greatest(least(count(DISTINCT p_size), 50), 10) AS k FROM part) SELECT coalesce(least(floor((p_size - lo) * k / nullif(hi - lo, 0)::DOUBLE), k - 1), 0)::BIGINT AS bin, count(*) AS n FROM part, s GROUP BY 1")
def n29(spark, d):
    return mlprep.histogram(table(spark, d, "part"), "p_size")


@query("n30_compare", "WITH a AS (SELECT o_orderkey, o_totalprice AS v FROM orders WHERE o_orderstatus <> 'P'), b AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE o_totalprice END AS v FROM orders WHERE o_orderstatus <> 'O') SELECT CASE WHEN a.o_orderkey IS NULL THEN 'only_b' WHEN b.o_orderkey IS NULL THEN 'only_a' WHEN a.v = b.v THEN 'equal' ELSE 'changed' END AS verdict, count(*) AS n FROM a FULL JOIN b USING (o_orderkey) GROUP BY 1")
def n30(spark, d):
    o = table(spark, d, "orders")
    a = o.where("o_orderstatus <> 'P'").select("o_orderkey", F.col("o_totalprice").alias("v"))
    b = o.where("o_orderstatus <> 'O'").select("o_orderkey", F.when(F.col("o_orderpriority") == "5-LOW", 0.0).otherwise(F.col("o_totalprice")).alias("v"))
    return mlprep.compare(a, b, ["o_orderkey"], ["v"]).groupBy("verdict").agg(F.count("*").alias("n"))


@query("n32_differences", "WITH a AS (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linestatus = 'O') SELECT k.l_orderkey, (SELECT count(*) FROM (SELECT l_partkey FROM a WHERE a.l_orderkey = k.l_orderkey EXCEPT SELECT l_partkey FROM b WHERE b.l_orderkey = k.l_orderkey)) AS missing, ((SELECT count(*) FROM b WHERE b.l_orderkey = k.l_orderkey) - (SELECT count(*) FROM a WHERE a.l_orderkey = k.l_orderkey)) AS size_delta FROM (SELECT l_orderkey FROM a INTERSECT SELECT l_orderkey FROM b) k")
def n32(spark, d):
    side = lambda c: table(spark, d, "lineitem").where(c).groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("x"))
    out = mlprep.differences(side("l_returnflag = 'A'"), side("l_linestatus = 'O'"), "l_orderkey", "x")
    return out.select("l_orderkey", F.size("missing").cast("long").alias("missing"), F.col("size_delta").cast("long"))


@query("n31_pairs", "SELECT split_part(url, '/', -1) AS name, count(*) AS n FROM pages GROUP BY 1")
def n31(spark, d):
    p = table(spark, d, "pages").select(F.col("url").alias("path"))
    once = p.groupBy(F.element_at(F.split("path", "/"), -1).alias("name")).agg(F.min("path").alias("path"))
    return mlprep.pairs(p, once.select("path")).groupBy("name").agg(F.count("*").alias("n"))


@query("n33_summary", "SELECT o_orderstatus, round(avg((o_totalprice > 100000)::INTEGER), 6) AS success_rate, count(*) AS n FROM orders GROUP BY 1")
def n33(spark, d):
    return mlprep.success_summary(table(spark, d, "orders"), F.col("o_totalprice") > 100000, "o_orderstatus")
