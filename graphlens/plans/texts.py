"""Text functions over names, urls and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphlens.functions import text
from graphlens.plans.registry import query
from graphlens.session import table
from graphlens.sources import artifacts, graphson


@query("f02_upper_snake", "SELECT c_custkey, upper(regexp_replace(replace(c_name, '#', 'IdTag'), '([^A-Z])([A-Z])', '\\1_\\2', 'g')) AS snake FROM customer")
def f02(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.upper_snake(F.replace("c_name", F.lit("#"), F.lit("IdTag"))).alias("snake"))


@query("f03_tokens", "SELECT c_mktsegment, token, count(*) AS n FROM (SELECT c_mktsegment, unnest(list_distinct([upper(c_mktsegment), 'MSG_' || upper(c_mktsegment), 'MACHINERY'])) AS token FROM customer) GROUP BY ALL")
def f03(spark, d):
    tokens = F.array_distinct(F.array(text.upper_snake("c_mktsegment"), F.concat(F.lit("MSG_"), F.upper("c_mktsegment")), F.lit("MACHINERY")))
    return table(spark, d, "customer").select("c_mktsegment", F.explode(tokens).alias("token")).groupBy("c_mktsegment", "token").agg(F.count("*").alias("n"))


@query("f04_strip", """SELECT p_partkey, p_name AS plain FROM part""")
def f04(spark, d):
    quoted = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('"'), "p_name", F.lit('"'))).otherwise(F.concat(F.lit(" '"), "p_name", F.lit("'")))
    return table(spark, d, "part").select("p_partkey", text.strip_quotes(quoted).alias("plain"))


@query("s04_join", "SELECT l_orderkey, string_agg(l_partkey::VARCHAR, '/' ORDER BY l_linenumber, l_partkey) AS joined FROM lineitem GROUP BY 1")
def s04(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    values = F.transform("x", lambda s: s["l_partkey"].cast("string"))
    wrapped = F.to_json(F.struct(F.struct(F.struct(values.alias("@value")).alias("CODE")).alias("properties")))
    return rows.select("l_orderkey", F.parse_json(wrapped).alias("v")).select("l_orderkey", graphson.joined_scalar("v", "$.properties.CODE").alias("joined"))


@query("s11_merge", "SELECT l_orderkey, l_linenumber, max(l_partkey) AS value FROM lineitem GROUP BY ALL")
def s11(spark, d):
    rows = table(spark, d, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("key"), F.col("l_partkey").alias("value"), F.col("l_partkey").alias("file_ord"))
    return graphson.merge_files(rows).select("key.*", "value")


@query("s12_count_methods", "SELECT count(*) AS n FROM events WHERE event_type = 'signup'")
def s12(spark, d):
    rows = table(spark, d, "events").select(F.lit("all").alias("doc"), F.when(F.col("event_type") == "signup", "METHOD").otherwise("CALL").alias("label"))
    return graphson.count_methods(rows).select("n")


@query("s14_extension", "SELECT page_id, coalesce(nullif(lower(regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '\\.([A-Za-z0-9]+)$', 1)), ''), '') IN ('html', 'htm') AS supported FROM pages")
def s14(spark, d):
    path = F.element_at(F.split(F.element_at(F.split("url", r"\?"), 1), "#"), 1)
    return table(spark, d, "pages").select("page_id", artifacts.is_supported(path, ".HTML", "htm").alias("supported"))


@query("s16_unique_names", "SELECT p_partkey, CASE WHEN r = 0 THEN p_name ELSE p_name || '_' || r END AS name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS r FROM part)")
def s16(spark, d):
    rank = F.row_number().over(Window.partitionBy("p_name").orderBy("p_partkey")) - 1
    return table(spark, d, "part").withColumn("r", rank).select("p_partkey", text.unique_names(F.col("r"), F.col("p_name")).alias("name"))


@query("s17_sanitize", "SELECT page_id, left(coalesce(nullif(trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '._-'), ''), 'unnamed'), 120) AS file FROM pages")
def s17(spark, d):
    return table(spark, d, "pages").select("page_id", text.sanitize_filename("url").alias("file"))


@query("s18_token", "SELECT page_id, left(regexp_replace(url, '[^\\p{L}\\p{N}_-]', '_', 'g'), 100) AS token FROM pages")
def s18(spark, d):
    return table(spark, d, "pages").select("page_id", text.sanitize_token("url").alias("token"))


@query("s19_last_name", "SELECT page_id, list_filter(regexp_split_to_array(url, '[\\s(){}\\[\\]<>;,.:=+\\-*/%&|^!~?\"''#@\\\\]+'), lambda w: w <> '')[-1] AS name FROM pages")
def s19(spark, d):
    return table(spark, d, "pages").select("page_id", text.name_from_code("url").alias("name"))


@query("s20_markdown", "SELECT p_partkey, '## Code' || chr(10) || chr(10) || '```c' || chr(10) || p_name || chr(10) || '```' || chr(10) || chr(10) || '## AST' || chr(10) || chr(10) || '```json' || chr(10) || p_type || chr(10) || '```' || chr(10) || chr(10) || '## DFG' || chr(10) || chr(10) || '```json' || chr(10) || p_size || chr(10) || '```' || chr(10) AS doc FROM part")
def s20(spark, d):
    return table(spark, d, "part").select("p_partkey", artifacts.to_markdown(F.col("p_name"), F.col("p_type"), F.col("p_size").cast("string")).alias("doc"))


_LABEL = "CASE p_size % 5 WHEN 0 THEN '0x' || p_size WHEN 1 THEN p_size::VARCHAR || 'U' WHEN 2 THEN '''a''' WHEN 3 THEN 'default' ELSE 'NAME_' || p_size END"


@query("a08_case_int", "SELECT p_partkey, (CASE p_size % 5 WHEN 0 THEN (p_size // 10) * 16 + p_size % 10 WHEN 1 THEN p_size WHEN 2 THEN 97 WHEN 3 THEN -1 END)::BIGINT AS value FROM part")
def a08(spark, d):
    n = F.col("p_size").cast("string")
    label = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("0x"), n)).when(F.col("p_size") % 5 == 1, F.concat(n, F.lit("U"))).when(F.col("p_size") % 5 == 2, "'a'").when(F.col("p_size") % 5 == 3, "default").otherwise(F.concat(F.lit("NAME_"), n))
    return table(spark, d, "part").select("p_partkey", text.case_int(label).alias("value"))


@query("a09_case_label", "SELECT p_partkey, p_type AS label FROM part")
def a09(spark, d):
    return table(spark, d, "part").select("p_partkey", text.case_label(F.concat(F.lit(" case  "), "p_type", F.lit(" :"))).alias("label"))


@query("a23_array_size", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS state, CASE p_size % 3 WHEN 1 THEN least(p_size * 2, 100) / 100.0 ELSE 0 END::DOUBLE AS norm FROM part")
def a23(spark, d):
    n = F.col("p_size").cast("string")
    decl = F.when(F.col("p_size") % 3 == 0, "int x").when(F.col("p_size") % 3 == 1, F.concat(F.lit("char b["), n, F.lit("][2]"))).otherwise(F.concat(F.lit("char b["), n, F.lit("][N]")))
    return table(spark, d, "part").select("p_partkey", text.array_size(decl).alias("s")).select("p_partkey", "s.state", "s.norm")


@query("a24_strip_sizeof", "SELECT p_partkey, p_name || ' * ' AS rest FROM part")
def a24(spark, d):
    return table(spark, d, "part").select("p_partkey", text.strip_sizeof(F.concat("p_name", F.lit(" * sizeof (struct f(x(y)))"))).alias("rest"))


@query("a25_arguments", "SELECT p_partkey, 3 AS n, 'g(' || p_type || ', 2)' AS second, (p_size % 7 + 4)::INTEGER AS closes FROM part")
def a25(spark, d):
    args = text.split_arguments(F.concat(F.lit("a, g("), "p_type", F.lit(", 2), b")))
    pad = F.repeat(F.lit("x"), F.col("p_size") % 7)
    return table(spark, d, "part").select("p_partkey", F.size(args).alias("n"), F.element_at(args, 2).alias("second"), text.matching_paren(F.concat(F.lit("f("), pad, F.lit("y)z"))).alias("closes"))


@query("a26_norm", "SELECT p_partkey, least(greatest(p_size * 3 - 10, 0), 100) / 100.0::DOUBLE AS norm FROM part")
def a26(spark, d):
    return table(spark, d, "part").select("p_partkey", text.norm_value(F.col("p_size") * 3 - 10).alias("norm"))
