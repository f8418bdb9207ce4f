"""Calls, samples, views and exports over tables: parts as calls, orders as records, events as statements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlens.functions.knowledge import KnowledgeBase
from graphlens.operators import callflags, mlprep, shape, statements, template, views
from graphlens.plans.commerce import edges as commerce_edges
from graphlens.plans.commerce import nodes as commerce_nodes
from graphlens.plans.registry import query
from graphlens.plans.sequences import _DU, _E, events, mentions
from graphlens.session import table
from graphlens.sources import artifacts, graphson


@query("n07_samples", "SELECT l_orderkey, any_value(o_orderstatus = 'F')::INTEGER AS label, count(*)::INTEGER AS n_nodes, (count(*) - 1)::INTEGER AS n_edges, sum(l_quantity) AS quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem) JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def n07(spark, d):
    """Orders as records: lines in a row are nodes, neighbours are linked, and one edge leads nowhere."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("x"))
    records = lines.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), "l_orderkey")
    nodes = F.transform("x", lambda s, i: F.struct((i * 10).alias("sid"), s["l_quantity"].alias("quantity"), F.lit(None).cast("int").alias("missing")))
    links = F.transform(nodes, lambda s: F.struct(s["sid"].alias("src"), (s["sid"] + 10).alias("dst")))
    records = records.select("l_orderkey", "o_orderstatus", nodes.alias("nodes"), links.alias("links"))
    out = mlprep.samples(records.withColumn("label", (F.col("o_orderstatus") == "F").cast("int")), "l_orderkey", "nodes", "links", ["quantity", "missing"], F.col("label"))
    total = F.aggregate("x", F.lit(0.0), lambda a, r: a + r[0] + r[1])
    return out.select("l_orderkey", "label", "n_nodes", F.size("src").alias("n_edges"), total.alias("quantity"))


@query("t20_call_names", "SELECT user_id AS doc, event_type AS name, min(event_id) AS first FROM events WHERE event_type <> 'error' GROUP BY ALL")
def t20(spark, d):
    label = F.when(F.col("event_type") == "error", "BLOCK").otherwise("CALL")
    return template.call_names(table(spark, d, "events").select(F.col("user_id").alias("doc"), label.alias("label"), F.col("event_type").alias("name"), F.col("event_id").alias("ord")))


_KIND = {"ECONOMY": "IfStatement", "SMALL": "Literal", "STANDARD": "ArrayDeclaration", "MEDIUM": "StandardLibCall", "LARGE": "Label"}


@query("t26_kinds", "SELECT p_type IN ('ECONOMY', 'LARGE') AS statement, p_type IN ('SMALL', 'MEDIUM') AS expression, p_type = 'STANDARD' AS declaration, count(*) AS n FROM part GROUP BY ALL")
def t26(spark, d):
    kind = F.coalesce(*[F.when(F.col("p_type") == k, v) for k, v in _KIND.items()], F.lit("ParameterList"))
    return table(spark, d, "part").select(template.is_statement(kind).alias("statement"), template.is_expression(kind).alias("expression"), template.is_declaration(kind).alias("declaration")).groupBy("statement", "expression", "declaration").agg(F.count("*").alias("n"))


@query("a10_guard_facts", """SELECT p_partkey AS cond, 'x' AS var, CASE WHEN p_size % 4 = 1 THEN 1 ELSE 0 END AS lower, CASE WHEN p_size % 4 = 1 THEN 0 ELSE 1 END AS upper, CASE WHEN p_size % 4 = 1 THEN 0 ELSE round(1.0 / p_size, 9) END::DOUBLE AS norm
    FROM part WHERE p_size % 4 <> 3 AND p_size > 0""")
def a10(spark, d):
    """x < size, x >= 0, size > x, and x >= size, which bounds nothing."""
    n, m = F.col("p_size").cast("string"), F.col("p_size") % 4
    op = F.when(m == 0, "<").when(m == 1, ">=").when(m == 2, ">").otherwise(">=")
    rows = table(spark, d, "part").where("p_size > 0").select(F.col("p_partkey").alias("cond"), op.alias("op"), F.when(m == 2, n).otherwise("x").alias("left"), F.when(m == 1, "0").when(m == 2, "x").otherwise(n).alias("right"))
    return statements.comparison_guards(rows).withColumn("norm", F.round("norm", 9))


@query("a11_for_header", "SELECT p_partkey AS cond, 'i' AS var, 1 AS lower FROM part WHERE p_size % 3 = 0 OR (p_size % 3 = 1 AND p_size > 20)")
def a11(spark, d):
    """i = 0 with i++; i = 3 with i += size - 21; i = 3 with j++."""
    m = F.col("p_size") % 3
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("cond"), F.lit("i").alias("init_var"), F.when(m == 0, 0).otherwise(3).alias("init_value"), F.when(m == 2, "j").otherwise("i").alias("inc_var"), F.when(m == 1, "+=").otherwise("++").alias("inc_op"), (F.col("p_size") - 21).alias("inc_value"))
    return statements.for_header_lower(rows)


@query("a16_lifted", "SELECT p_partkey AS cond FROM part WHERE p_type IN ('ECONOMY', 'PROMO')")
def a16(spark, d):
    name = F.when(F.col("p_type") == "ECONOMY", "MALLOC").when(F.col("p_type") == "SMALL", "atoi").when(F.col("p_type") == "PROMO", "recv").when(F.col("p_type") == "LARGE", "printf").otherwise("helper")
    return callflags.lifted(table(spark, d, "part").select(F.col("p_partkey").alias("cond"), name.alias("name"))).select("cond")


@query("a28_full_name", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'p.f' WHEN 1 THEN 'buf' WHEN 2 THEN 'q' ELSE 's.a' END AS name FROM part")
def a28(spark, d):
    n, m = F.col("p_size").cast("string"), F.col("p_size") % 4
    code = F.when(m == 0, F.concat(F.lit("(char *) p -> f["), n, F.lit("]"))).when(m == 1, F.concat(F.lit("&buf["), n, F.lit("]"))).when(m == 2, "*q").otherwise("s.a.b")
    return table(spark, d, "part").select("p_partkey", callflags.full_name(code).alias("name"))


@query("d15_return_edges", f"WITH {_E} SELECT a.fn, a.sid AS src, b.sid AS dst, '$ret@' || a.sid AS var FROM e a JOIN e b ON a.fn = b.fn AND b.sid = a.sid + 1 WHERE a.event_type = 'signup' AND b.event_type = 'purchase'")
def d15(spark, d):
    """A signup is a call, the purchase right after it takes its value; one two places on would not be next to it."""
    e = events(spark, d)
    a = e.where("event_type = 'signup'").select("fn", F.col("sid").alias("call_sid"))
    b = e.where("event_type = 'purchase'").select("fn", F.col("sid").alias("assign_sid"))
    near = a.withColumn("assign_sid", F.explode(F.array(F.col("call_sid") + 1, F.col("call_sid") + 2))).join(b, ["fn", "assign_sid"])
    return callflags.return_edges(statements.order_edges(e, ["fn"], "sid"), near)


@query("d22_indexing", "SELECT p_partkey, p_size % 3 < 2 AS indexed FROM part")
def d22(spark, d):
    n, m = F.col("p_size").cast("string"), F.col("p_size") % 3
    code = F.when(m == 0, F.concat(F.lit("a ["), n, F.lit("]"))).when(m == 1, F.concat(F.lit("*(p + "), n, F.lit(")"))).otherwise(F.concat(F.lit("*p + "), n))
    return table(spark, d, "part").select("p_partkey", callflags.has_indexing(code).alias("indexed"))


@query("d25_ordered_names", "SELECT fn, string_agg(name, ',' ORDER BY first) AS names FROM (SELECT o_custkey AS fn, o_orderstatus AS name, min(o_orderkey) AS first FROM orders GROUP BY ALL) GROUP BY 1")
def d25(spark, d):
    o = table(spark, d, "orders")
    tree = o.select(F.col("o_orderkey").alias("id"), F.lit("ParameterDeclaration").alias("node_type"), F.col("o_orderstatus").alias("name"), F.array("o_orderkey").alias("path"))
    return callflags.ordered_names(tree, o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("fn")), "ParameterDeclaration").select("fn", F.array_join("names", ",").alias("names"))


@query("a31_array_lengths", "SELECT p_brand AS fn, p_name AS name, p_size::VARCHAR AS length FROM part WHERE p_type = 'ECONOMY'")
def a31(spark, d):
    p = table(spark, d, "part")
    tree = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_type") == "ECONOMY", "ArrayDeclaration").otherwise("VariableDeclaration").alias("node_type"), F.col("p_name").alias("name"), F.col("p_size").cast("string").alias("length"))
    return callflags.array_lengths(tree, p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("fn")))


@query("s21_relative_output", "SELECT page_id, regexp_replace(url, '^https?://', '') || '.json' AS out FROM pages")
def s21(spark, d):
    path = F.concat(F.lit("/data/in/"), F.regexp_replace("url", "^https?://", ""))
    return table(spark, d, "pages").select("page_id", artifacts.relative_output(path, "/data/in").alias("out"))


@query("v05_views", "SELECT (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1)) + (SELECT count(DISTINCT l_partkey) FROM lineitem) + (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS n_nodes, (SELECT 2 * count(*) FROM lineitem) AS n_edges")
def v05(spark, d):
    kept, inner = views.induced(commerce_nodes(spark, d), commerce_edges(spark, d), "CALL", "SUPPLY")
    return kept.agg(F.count("*").alias("n_nodes")).join(F.broadcast(inner.agg(F.count("*").alias("n_edges"))))


@query("v15_statement_view", f"WITH {_E} SELECT label, count(*) AS n FROM (SELECT 'next' AS label FROM e WHERE sid > 0 UNION ALL SELECT 'parent' FROM e WHERE sid > 0 UNION ALL SELECT 'guard ' || (k % 2) FROM e WHERE event_type = 'error') GROUP BY 1")
def v15(spark, d):
    e = events(spark, d)
    parent = e.where("sid > 0").select("fn", F.lit(0).alias("src"), F.col("sid").alias("dst"))
    guard = e.where("event_type = 'error'").select("fn", F.col("sid").alias("src"), (F.col("sid") + 1).alias("dst"), (F.col("k") % 2).alias("branch"))
    shown = e.select("fn", "sid", F.col("event_type").alias("node_type"), F.lit("").alias("code"))
    return views.statement_view(shown, parent, statements.order_edges(e, ["fn"], "sid"), guard)[1].groupBy("label").agg(F.count("*").alias("n"))


@query("v16_flow_view", f"WITH {_DU} SELECT (SELECT count(*) FROM (SELECT fn, src AS s FROM du UNION SELECT fn, dst FROM du)) AS n_nodes, count(*) AS n_edges, count(DISTINCT CASE WHEN var = 0 THEN 'value' ELSE var::VARCHAR END) AS n_labels FROM du")
def v16(spark, d):
    from graphlens.operators import dataflow

    flow = dataflow.def_use(mentions(spark, d)).withColumn("flow", F.lit("value")).withColumn("var", F.when(F.col("var") != 0, F.col("var").cast("string")).otherwise(""))
    nodes, links = views.flow_view(events(spark, d).withColumn("code", F.col("event_type")), flow)
    return nodes.agg(F.count("*").alias("n_nodes")).join(F.broadcast(links.agg(F.count("*").alias("n_edges"), F.count_distinct("label").alias("n_labels"))))


@query("v21_properties", "SELECT p_partkey, left(p_name, 8) AS name, left(p_brand, 8) AS brand, 2 AS n FROM part")
def v21(spark, d):
    props = F.create_map(F.lit("NAME"), F.col("p_name"), F.lit("BRAND"), F.col("p_brand"), F.lit("TYPE"), F.col("p_type"), F.lit("EMPTY"), F.lit(""))
    rows = table(spark, d, "part").select("p_partkey", views.properties_panel(props, ("TYPE",), 8).alias("m"))
    return rows.select("p_partkey", F.col("m")["NAME"].alias("name"), F.col("m")["BRAND"].alias("brand"), F.size("m").alias("n"))


@query("p01_findings", "SELECT o_orderkey AS pkg, count(l_orderkey) AS n_checks, count(*) FILTER (l_returnflag IN ('A', 'R')) AS n_missing, coalesce(string_agg(DISTINCT CASE WHEN l_returnflag IN ('A', 'R') THEN l_linestatus END, ',' ORDER BY CASE WHEN l_returnflag IN ('A', 'R') THEN l_linestatus END), '') AS remedies FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def p01(spark, d):
    flag = F.col("l_returnflag")
    status = F.when(flag == "A", "UNVERIFIED").when(flag == "R", "WEAKLY_RELATED").otherwise("SATISFIED")
    checks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("pkg"), F.col("l_linenumber").alias("check"), status.alias("status"), F.col("l_linestatus").alias("remedy"))
    out = shape.findings(table(spark, d, "orders").select(F.col("o_orderkey").alias("pkg")), checks)
    return out.select("pkg", F.coalesce("n_checks", F.lit(0)).alias("n_checks"), F.coalesce("n_missing", F.lit(0)).alias("n_missing"), F.coalesce(F.array_join("remedies", ","), F.lit("")).alias("remedies"))


@query("p02_traces", "SELECT l_orderkey AS slot, l_suppkey AS callback, string_agg('CALL EXACT ' || printf('%.2f', l_quantity / 100), ';' ORDER BY l_quantity DESC) AS notes, count(DISTINCT l_linenumber)::INTEGER AS n_sites FROM lineitem GROUP BY ALL")
def p02(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("slot"), F.col("l_suppkey").alias("callback"), F.lit("CALL").alias("kind"), F.lit("EXACT").alias("match"), (F.col("l_quantity") / 100).alias("weight"), F.col("l_linenumber").alias("site"))
    return shape.traces(rows).select("slot", "callback", F.array_join("notes", ";").alias("notes"), F.size("sites").alias("n_sites"))


@query("p08_export", """WITH t AS (SELECT 'packages' AS name, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders UNION ALL SELECT 'sinks', count(*), sum(p_partkey)::BIGINT FROM part UNION ALL SELECT 'candidates', count(*), sum(n_nationkey)::BIGINT FROM nation)
SELECT 'full' AS which, * FROM t UNION ALL SELECT 'fragments', * FROM t WHERE name = 'sinks' UNION ALL SELECT 'packages', * FROM t WHERE name = 'packages'""")
def p08(spark, d):
    """The rows of each export, read back from their JSON."""
    tables = {"packages": table(spark, d, "orders"), "sinks": table(spark, d, "part"), "candidates": table(spark, d, "nation")}
    rows = reduce(DataFrame.unionByName, [shape.exported(tables, w).withColumn("which", F.lit(w)) for w in ("full", "fragments", "packages")])
    key = F.coalesce(*[F.get_json_object("row", f"$.{k}").cast("long") for k in ("o_orderkey", "p_partkey", "n_nationkey")])
    return rows.groupBy("which", "name").agg(F.count("*").alias("n"), F.sum(key).alias("keys"))


_LINES = "l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_quantity, l_tax, l_discount) AS pos FROM lineitem)"


def _lines(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_tax", "l_discount")
    return table(spark, d, "lineitem").withColumn("pos", F.row_number().over(w))


def _checks(spark, d):
    """Orders as packages: a line expects a check by its part; returned ones lack it, linked statuses observe it."""
    lines = _lines(spark, d).select(F.col("l_orderkey").alias("pkg"), "pos", F.concat(F.lit("C"), (F.col("l_partkey") % 4).cast("string")).alias("check"), "l_returnflag", "l_linestatus", "l_quantity")
    basis = F.when(F.col("l_returnflag") == "R", "NEGATIVE_EVIDENCE_FOUND").otherwise("UNVERIFIED")
    missing = lines.where("l_returnflag IN ('A', 'R')").select("pkg", "pos", "check", basis.alias("basis"))
    expected = lines.groupBy("pkg", "check").agg(F.min("pos").alias("pos"))
    matched = F.when(F.col("l_linestatus") == "O", F.col("check"))
    observed = lines.where("l_quantity > 10").select("pkg", "pos", F.lit("BOUND").alias("kind"), F.when(F.col("l_quantity") > 30, "STRONG").otherwise("WEAK").alias("strength"), matched.alias("matched"), F.col("pos").cast("string").alias("evidence"))
    return expected, observed, missing


_CHECKS = f"""{_LINES},
c AS (SELECT l_orderkey AS pkg, pos, 'C' || (l_partkey % 4) AS chk, l_returnflag AS f, l_linestatus AS s, l_quantity AS q FROM l),
m AS (SELECT pkg, chk, arg_min(CASE f WHEN 'R' THEN 'NEGATIVE' ELSE 'UNVERIFIED' END, pos) AS basis FROM c WHERE f IN ('A', 'R') GROUP BY ALL),
o AS (SELECT pkg, chk, arg_min('BOUND ' || CASE WHEN q > 30 THEN 'STRONG' ELSE 'WEAK' END, pos) AS seen, min(pos)::VARCHAR AS ev FROM c WHERE q > 10 AND s = 'O' GROUP BY ALL),
e AS (SELECT pkg, chk, min(pos) AS pos FROM c GROUP BY ALL),
k AS (SELECT e.pkg, 0 AS part, e.pos, e.chk AS id, coalesce(m.basis, 'SATISFIED') AS status, o.seen AS observed, o.ev AS evidence FROM e LEFT JOIN m ON m.pkg = e.pkg AND m.chk = e.chk LEFT JOIN o ON o.pkg = e.pkg AND o.chk = e.chk
  UNION ALL SELECT pkg, 1, pos, 'BOUND', CASE WHEN q > 30 THEN 'SATISFIED' ELSE 'WEAKLY_RELATED' END, 'BOUND ' || CASE WHEN q > 30 THEN 'STRONG' ELSE 'WEAK' END, pos::VARCHAR FROM c WHERE q > 10 AND s <> 'O')"""


@query("p01_checks", f"WITH {_CHECKS} SELECT pkg, part, pos::BIGINT AS pos, id, status, observed, evidence FROM k")
def p01_checks(spark, d):
    return shape.check_rows(*_checks(spark, d)).select("pkg", "place.part", "place.pos", "id", "status", "observed", "evidence")


@query("p01_details", f"""WITH {_CHECKS},
t AS (SELECT l_orderkey AS pkg, count(*) AS n, count(*) FILTER (pos > 1 AND l_linestatus = 'F') AS sinks, arg_max(l_linenumber, pos) FILTER (pos > 1 AND l_linestatus = 'F') AS at_, count(DISTINCT l_suppkey % 3) AS fns FROM l GROUP BY 1),
r AS (SELECT pkg, string_agg(rem, ';' ORDER BY pos) AS remedies FROM (SELECT pkg, min(pos) AS pos, CASE chk WHEN 'C1' THEN 'bound it' ELSE 'add the check ' || chk END AS rem FROM c WHERE f IN ('A', 'R') GROUP BY pkg, rem) GROUP BY pkg)
SELECT o_orderkey AS pkg, n::INTEGER AS n_steps, sinks::INTEGER AS n_sinks, at_ AS location, (SELECT count(*) FROM k WHERE k.pkg = o_orderkey)::INTEGER AS n_checks, coalesce(remedies, '') AS remedies,
  CASE WHEN o_totalprice >= 160000 THEN 'high' WHEN o_totalprice >= 120000 THEN 'medium' WHEN o_totalprice >= 80000 THEN 'low' ELSE 'very_low' END AS label,
  'field f of ' || o_orderstatus || ' (text) comes from outside and reaches ' || CASE WHEN fns > 1 THEN 'through ' || fns || ' functions ' ELSE '' END || 'api (SHELL) without enough checks' AS summary
FROM orders JOIN t ON t.pkg = o_orderkey LEFT JOIN r ON r.pkg = o_orderkey""")
def p01_details(spark, d):
    expected, observed, missing = _checks(spark, d)
    lines = _lines(spark, d).select(F.col("l_orderkey").alias("pkg"), "pos", F.concat(F.lit("fn"), (F.col("l_suppkey") % 3).cast("string")).alias("function"), F.col("l_linenumber").alias("line"), F.when(F.col("l_linestatus") == "F", "sink:system").otherwise("assign").alias("operation"))
    steps = shape.with_roles(lines, "pkg", ["pos"], F.col("operation").startswith("sink"))
    o = table(spark, d, "orders")
    packages = o.select(F.col("o_orderkey").alias("pkg"), F.col("o_orderstatus").alias("action"), F.lit("f").alias("field"), F.lit("text").alias("semantic"), F.lit("api").alias("api"), F.lit("SHELL").alias("domain"), (F.col("o_totalprice") / 200000).alias("confidence"))
    remedies = spark.createDataFrame([("C1", "bound it")], "check string, remedy string")
    out = shape.finding_details(packages, steps, shape.check_rows(expected, observed, missing), missing, remedies).where(F.col("trace").isNotNull())
    sinks = F.size(F.filter("trace", lambda s: s["role"] == "sink"))
    return out.select("pkg", F.size("trace").alias("n_steps"), sinks.alias("n_sinks"), "location", F.size("checks").alias("n_checks"), F.coalesce(F.array_join("remedies", ";"), F.lit("")).alias("remedies"), F.col("confidence_label").alias("label"), "summary")


@query("p02_decisions", f"""WITH {_LINES}, t AS (SELECT l_orderkey, l_suppkey % 2 AS callback, string_agg(CASE WHEN i = 1 THEN 'source' WHEN l_returnflag = 'R' THEN 'sink' ELSE 'step' END || ':' || l_linenumber, ',' ORDER BY i) AS trace
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 2 ORDER BY pos) AS i FROM l) GROUP BY ALL)
SELECT o_orderkey AS slot, CASE o_orderstatus WHEN 'F' THEN 'info' WHEN 'O' THEN 'warn' ELSE 'none' END AS tone, CASE o_orderstatus WHEN 'F' THEN 'handler found' WHEN 'O' THEN 'several candidates' ELSE 'no handler settled' END AS title,
  CASE WHEN o_totalprice >= 160000 THEN 'high' WHEN o_totalprice >= 120000 THEN 'medium' WHEN o_totalprice >= 80000 THEN 'low' ELSE 'very_low' END AS label, trace
FROM orders LEFT JOIN t ON l_orderkey = o_orderkey AND callback = o_custkey % 2""")
def p02_decisions(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "RESOLVED").when(F.col("o_orderstatus") == "O", "AMBIGUOUS").otherwise("UNRESOLVED")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("slot"), F.col("o_orderpriority").alias("action"), status.alias("status"), F.lit("").alias("reason"), (F.col("o_custkey") % 2).alias("chosen"), (F.col("o_totalprice") / 200000).alias("top"))
    records = _lines(spark, d).select(F.col("l_orderkey").alias("slot"), (F.col("l_suppkey") % 2).alias("callback"), "pos", F.when(F.col("l_returnflag") == "R", "HANDLER_REF").otherwise("CHAIN_CALL").alias("step"), F.lit("").alias("code"), F.col("l_linenumber").alias("line"))
    shown = F.array_join(F.transform("trace", lambda s: F.concat_ws(":", s["role"], s["line"].cast("string"))), ",")
    return shape.resolution_decisions(rows, records).select("slot", "tone", "title", "label", shown.alias("trace"))


def _graph_texts(spark, d):
    """Orders as GraphSON texts with their lines as calls; every 7th is cut off, every 11th holds no graph, every 13th a vertex without an id."""
    lines = _lines(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("pos", "l_partkey"))).alias("x"))
    vertex = F.concat_ws(",", F.array(F.lit('{"id":0,"label":"METHOD","properties":{"NAME":"order"}}')), F.transform("x", lambda s: F.concat(F.lit('{"id":{"@type":"g:Int64","@value":'), s["pos"].cast("string"), F.lit('},"label":"CALL","properties":{"CODE":{"@value":{"@value":["p'), s["l_partkey"].cast("string"), F.lit('"]}}}}'))))
    edge = F.concat_ws(",", F.transform("x", lambda s: F.concat(F.lit('{"label":"AST","outV":0,"inV":'), s["pos"].cast("string"), F.lit(',"properties":{}}'))))
    k = F.col("l_orderkey")
    extra = F.when(k % 13 == 0, F.lit(',{"label":"CALL"}')).otherwise("")
    text = F.concat(F.lit('{"export":{"@value":{"vertices":['), vertex, extra, F.lit('],"edges":['), edge, F.lit("]}}}"))
    return lines.select(k.alias("doc"), F.when(k % 7 == 0, F.lit('{"vertices": [')).when(k % 11 == 0, F.lit('{"a": 1}')).otherwise(text).alias("json")).select("doc", F.try_parse_json("json").alias("v"))


_BAD = "CASE WHEN l_orderkey % 7 = 0 THEN 'not JSON' WHEN l_orderkey % 11 = 0 THEN 'no graph' WHEN l_orderkey % 13 = 0 THEN 'incomplete vertices' END"


@query("s10_outcomes", f"SELECT l_orderkey AS doc, {_BAD} IS NULL AS ok, {_BAD} AS error, CASE WHEN l_orderkey % 7 = 0 OR l_orderkey % 11 = 0 THEN 0 ELSE count(*) + 1 END AS n_nodes, CASE WHEN l_orderkey % 7 = 0 OR l_orderkey % 11 = 0 THEN 0 ELSE count(*) END AS n_edges FROM lineitem GROUP BY 1")
def s10(spark, d):
    return graphson.outcomes(_graph_texts(spark, d))


@query("s01_tables", "SELECT l_orderkey::VARCHAR AS doc, count(*) AS n, min('p' || l_partkey) AS first FROM lineitem WHERE l_orderkey % 7 <> 0 AND l_orderkey % 11 <> 0 GROUP BY 1")
def s01_tables(spark, d):
    """The reader over documents of orders: their lines come back as nodes with their code."""
    docs = _graph_texts(spark, d).withColumn("doc", F.col("doc").cast("string"))
    nodes, edges = graphson.load(docs)
    back = edges.select(F.col("dst").alias("id")).join(nodes, "id").where("label = 'CALL'")
    return back.groupBy("doc").agg(F.count("*").alias("n"), F.min("code").alias("first"))


@query("r04_reverse", "SELECT * FROM (VALUES ('numeric', '15', 'RemoteStartTransaction'), ('numeric', '41', 'SetChargingProfile'), ('symbol', 'ACTION_REMOTE_START', 'RemoteStartTransaction'), ('symbol', 'ACTION_SET_CHARGING_PROFILE', 'SetChargingProfile'), ('symbol', 'MSG_SET_PROFILE', 'SetChargingProfile'), ('name', 'UPDATEFIRMWARE', 'UpdateFirmware'), ('name', 'DATATRANSFER', 'DataTransfer'), ('name', 'SETCHARGINGPROFILE', 'SetChargingProfile'), ('name', 'REMOTESTARTTRANSACTION', 'RemoteStartTransaction')) t(\"by\", key, action)")
def r04(spark, d):
    return KnowledgeBase(spark).reverse()
