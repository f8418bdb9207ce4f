"""Graph operators over the commerce graph: regions, nations, customers, orders, parts, suppliers.

TREE edges lead region -> nation -> customer -> order and nation -> supplier, CALL edges from an
order to its parts in the order of line numbers, SUPPLY edges from an order to its suppliers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.operators import cpg, graph, traverse, views
from graphlens.plans.registry import query
from graphlens.session import table

_KEYS = {"R": ("region", "r_regionkey", "r_name"), "N": ("nation", "n_nationkey", "n_name"), "C": ("customer", "c_custkey", "c_name"), "O": ("orders", "o_orderkey", "o_orderstatus"), "P": ("part", "p_partkey", "p_name"), "S": ("supplier", "s_suppkey", "s_name")}


def _id(label: str, key: str):
    return F.concat(F.lit(f"{label}:"), F.col(key).cast("string"))


def nodes(spark: SparkSession, d: str, labels: str = "RNCOPS") -> DataFrame:
    parts = [table(spark, d, t).select(_id(x, k).alias("id"), F.lit(x).alias("label"), F.col(n).alias("name"), F.col(k).cast("long").alias("ord")) for x, (t, k, n) in _KEYS.items() if x in labels]
    return reduce(DataFrame.unionByName, parts)


def edges(spark: SparkSession, d: str, labels: tuple[str, ...] = ("TREE", "CALL", "SUPPLY")) -> DataFrame:
    tree = lambda t, a, ak, b, bk: table(spark, d, t).select(_id(a, ak).alias("src"), _id(b, bk).alias("dst"), F.lit("TREE").alias("label"), F.col(bk).cast("long").alias("ord"))
    line = lambda x, k, label: table(spark, d, "lineitem").select(_id("O", "l_orderkey").alias("src"), _id(x, k).alias("dst"), F.lit(label).alias("label"), F.col("l_linenumber").cast("long").alias("ord"))
    parts = []
    if "TREE" in labels:
        parts += [tree("nation", "R", "n_regionkey", "N", "n_nationkey"), tree("customer", "N", "c_nationkey", "C", "c_custkey"), tree("orders", "C", "o_custkey", "O", "o_orderkey"), tree("supplier", "N", "s_nationkey", "S", "s_suppkey")]
    if "CALL" in labels:
        parts.append(line("P", "l_partkey", "CALL"))
    if "SUPPLY" in labels:
        parts.append(line("S", "l_suppkey", "SUPPLY"))
    return reduce(DataFrame.unionByName, parts)


_EDGES = """
tree AS (SELECT 'R:' || n_regionkey AS src, 'N:' || n_nationkey AS dst, 'TREE' AS label, n_nationkey::BIGINT AS ord FROM nation
   UNION ALL SELECT 'N:' || c_nationkey, 'C:' || c_custkey, 'TREE', c_custkey FROM customer
   UNION ALL SELECT 'C:' || o_custkey, 'O:' || o_orderkey, 'TREE', o_orderkey FROM orders
   UNION ALL SELECT 'N:' || s_nationkey, 'S:' || s_suppkey, 'TREE', s_suppkey FROM supplier),
calls AS (SELECT 'O:' || l_orderkey AS src, 'P:' || l_partkey AS dst, 'CALL' AS label, l_linenumber::BIGINT AS ord FROM lineitem),
supply AS (SELECT 'O:' || l_orderkey AS src, 'S:' || l_suppkey AS dst, 'SUPPLY' AS label, l_linenumber::BIGINT AS ord FROM lineitem)"""


@query("g01_adjacency", f"WITH {_EDGES} SELECT label, count(*) AS n_edges, count(DISTINCT src) AS n_src, count(DISTINCT dst) AS n_dst FROM (FROM tree UNION ALL FROM calls UNION ALL FROM supply) GROUP BY label")
def g01(spark, d):
    return graph.adjacency(edges(spark, d))


@query("g02_out_neighbours", "SELECT 'N:' || n_nationkey AS id, count(*) AS n, min(s_suppkey)::BIGINT AS first FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def g02(spark, d):
    near = graph.out_neighbours(nodes(spark, d, "N"), edges(spark, d, ("TREE",)).where(F.col("dst").startswith("S:")), "TREE")
    return near.groupBy("id").agg(F.count("*").alias("n"), F.min("ord").alias("first"))


@query("g03_in_neighbours", "SELECT 'P:' || p_partkey AS id, count(DISTINCT l_orderkey) AS n FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def g03(spark, d):
    return graph.in_neighbours(nodes(spark, d, "P"), edges(spark, d, ("CALL",)), "CALL").groupBy("id").agg(F.count_distinct("neighbour").alias("n"))


@query(
    "g04_descendants",
    """SELECT 'R:' || n_regionkey AS root, label, count(*) AS n FROM (
    SELECT n_regionkey, 'N' AS label FROM nation
    UNION ALL SELECT n_regionkey, 'C' FROM nation JOIN customer ON c_nationkey = n_nationkey
    UNION ALL SELECT n_regionkey, 'S' FROM nation JOIN supplier ON s_nationkey = n_nationkey
    UNION ALL SELECT n_regionkey, 'O' FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey) GROUP BY ALL""",
)
def g04(spark, d):
    below = graph.descendants(edges(spark, d, ("TREE",)), nodes(spark, d, "R"), "TREE")
    return below.groupBy("root", F.substring("node", 1, 1).alias("label")).agg(F.count("*").alias("n"))


def owners(spark, d, label: str = "N", labels: str = "RNCOS") -> DataFrame:
    e = edges(spark, d, ("TREE",))
    return graph.owner(nodes(spark, d, labels), graph.parents(e, "TREE"), F.col("label") == label)


@query("g05_owner", "SELECT 'O:' || o_orderkey AS id, 'N:' || c_nationkey AS owner FROM orders JOIN customer ON o_custkey = c_custkey")
def g05(spark, d):
    return owners(spark, d).where(F.col("id").startswith("O:"))


@query("g06_last_parent", "SELECT 'P:' || l_partkey AS id, arg_max('O:' || l_orderkey, {'o': l_linenumber, 's': 'O:' || l_orderkey}) AS parent FROM lineitem GROUP BY 1")
def g06(spark, d):
    return graph.parents(edges(spark, d, ("CALL",)), "CALL")


@query("g07_first_parent", "SELECT 'P:' || l_partkey AS id, arg_min('O:' || l_orderkey, {'o': l_linenumber, 's': 'O:' || l_orderkey}) AS parent FROM lineitem GROUP BY 1")
def g07(spark, d):
    return graph.parents(edges(spark, d, ("CALL",)), "CALL", last=False)


@query("g08_internal", "SELECT 'P:' || p_partkey AS id FROM part WHERE NOT starts_with(p_name, 'small') AND p_size > 10")
def g08(spark, d):
    name = F.when(F.col("p_name").startswith("small"), F.concat(F.lit("<operator>."), "p_name")).otherwise(F.col("p_name"))
    return table(spark, d, "part").where(cpg.is_internal(name, F.col("p_size") <= 10)).select(_id("P", "p_partkey").alias("id"))


@query("g09_filenames", "SELECT page_id, coalesce(nullif(split_part(split_part(url, '?', 1), '/', -1), ''), 'index') AS file FROM pages")
def g09(spark, d):
    path = F.element_at(F.split("url", r"\?"), 1)
    named = F.when(~path.endswith("/"), path)
    return table(spark, d, "pages").select("page_id", cpg.base_name(named, F.lit("site/index")).alias("file"))


@query("g10_first_call", "SELECT 'O:' || l_orderkey AS id, arg_min('P:' || l_partkey, {'o': l_linenumber, 'p': 'P:' || l_partkey}) AS target FROM lineitem GROUP BY 1")
def g10(spark, d):
    return graph.first_out(edges(spark, d, ("CALL",)), "CALL")


@query("g11_arguments", "SELECT 'O:' || l_orderkey AS call, row_number() OVER (PARTITION BY l_orderkey ORDER BY coalesce(CASE WHEN l_linenumber < 5 THEN l_linenumber END, 999), l_linenumber, 'P:' || l_partkey)::INTEGER AS pos, 'P:' || l_partkey AS arg FROM lineitem")
def g11(spark, d):
    return graph.arguments(edges(spark, d, ("CALL",)), F.when(F.col("ord") < 5, F.col("ord")), "CALL")


@query("g12_in_method", "SELECT 'N:' || c_nationkey AS owner, count(*) AS n_calls FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def g12(spark, d):
    own = owners(spark, d).select(F.col("id").alias("src"), "owner")
    return edges(spark, d, ("CALL",)).join(own, "src").groupBy("owner").agg(F.count("*").alias("n_calls"))


@query("g13_parameters", "SELECT 'O:' || l_orderkey AS owner, l_linenumber::BIGINT AS index, max('P:' || l_partkey) AS param FROM lineitem GROUP BY 1, 2")
def g13(spark, d):
    return graph.last_by_index(edges(spark, d, ("CALL",)), F.col("ord"), "CALL")


@query("g14_argument_of", "SELECT 'P:' || l_partkey AS arg, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1")
def g14(spark, d):
    calls = nodes(spark, d, "O").where("name = 'F'").select(F.col("id").alias("src"))
    return graph.argument_of(edges(spark, d, ("CALL",)).join(calls, "src", "left_semi"), "CALL").groupBy("arg").agg(F.count("*").alias("n"))


@query("g15_reaching_out", "SELECT 'C:' || o_custkey AS id, count(*) AS n FROM orders GROUP BY 1")
def g15(spark, d):
    return graph.out_neighbours(nodes(spark, d, "C"), edges(spark, d, ("TREE",)), "TREE").groupBy("id").agg(F.count("*").alias("n"))


@query("g16_first_ref", "SELECT 'O:' || l_orderkey AS id, arg_min('S:' || l_suppkey, {'o': l_linenumber, 'p': 'S:' || l_suppkey}) AS target FROM lineitem GROUP BY 1")
def g16(spark, d):
    return graph.first_out(edges(spark, d, ("SUPPLY",)), "SUPPLY")


@query("g17_condition", "SELECT 'C:' || o_custkey AS id, 'O:' || min(o_orderkey) AS target FROM orders GROUP BY o_custkey")
def g17(spark, d):
    return graph.first_out(edges(spark, d, ("TREE",)).where(F.col("src").startswith("C:")), "TREE")


@query("g18_dominates", "SELECT 'R:' || r AS a, dominated, count(*) AS n FROM (SELECT r_regionkey AS r, n_regionkey = r_regionkey AS dominated FROM region, customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY ALL")
def g18(spark, d):
    # A pair for each region and customer: the stated query, five rows for each customer.
    pairs = nodes(spark, d, "C").select(F.col("id").alias("b")).crossJoin(F.broadcast(nodes(spark, d, "R").select(F.col("id").alias("a"))))
    return graph.dominates(edges(spark, d, ("TREE",)), pairs, "TREE").groupBy("a", "dominated").agg(F.count("*").alias("n"))


@query(
    "g19_forest",
    """WITH x AS (SELECT n_regionkey AS r, 1 AS depth FROM nation
    UNION ALL SELECT n_regionkey, 2 FROM nation JOIN customer ON c_nationkey = n_nationkey UNION ALL SELECT n_regionkey, 2 FROM nation JOIN supplier ON s_nationkey = n_nationkey
    UNION ALL SELECT n_regionkey, 3 FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
    UNION ALL SELECT DISTINCT n_regionkey, 0 FROM nation)
    SELECT 'R:' || r AS root, count(*) AS n, max(depth)::INTEGER AS height FROM x GROUP BY r""",
)
def g19(spark, d):
    return graph.forest(edges(spark, d, ("TREE",)), "TREE").groupBy("root").agg(F.count("*").alias("n"), F.max("depth").alias("height"))


@query(
    "g20_flatten",
    f"""WITH {_EDGES} SELECT 'nodes' AS kind, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier) AS n
    UNION ALL SELECT 'edges', count(*) FROM tree WHERE src NOT LIKE 'C:%'
    UNION ALL SELECT 'dangling', count(*) FROM lineitem""",
)
def g20(spark, d):
    e = edges(spark, d, ("TREE", "CALL"))
    kept, inner = graph.flatten(nodes(spark, d), e, ("O",))
    lost = graph.dangling(kept, graph.of_label(e, "CALL"))
    return reduce(DataFrame.unionByName, [x.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, x in (("nodes", kept), ("edges", inner), ("dangling", lost))])


@query("g21_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def g21(spark, d):
    return graph.duplicates(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("g22_functions", "SELECT 'N:' || n_nationkey AS root, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) + (SELECT count(*) FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey) AS n FROM nation")
def g22(spark, d):
    below = graph.descendants(edges(spark, d, ("TREE",)), nodes(spark, d, "N"), "TREE").groupBy("root").agg(F.count("*").alias("n"))
    return nodes(spark, d, "N").select(F.col("id").alias("root")).join(below, "root", "left").fillna(0)


@query("g23_with_body", "SELECT 'C:' || c_custkey AS id FROM customer WHERE c_mktsegment <> 'MACHINERY' AND EXISTS (FROM orders WHERE o_custkey = c_custkey)")
def g23(spark, d):
    rows = table(spark, d, "customer").select(_id("C", "c_custkey").alias("id"), "c_mktsegment")
    return graph.with_body(rows, edges(spark, d, ("TREE",)), "TREE", excluded=F.col("c_mktsegment") == "MACHINERY").select("id")


@query("g24_name_filter", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)BOLT|ring|Red')")
def g24(spark, d):
    return graph.named(nodes(spark, d, "P"), "(?i)BOLT|ring|Red").select(F.col("ord").alias("p_partkey"), F.col("name").alias("p_name"))


@query(
    "g25_tree_text",
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS p, count(*) OVER (PARTITION BY n_regionkey) AS c FROM nation)
    SELECT 'R:' || r_regionkey AS root, 'R:' || r_regionkey || chr(10) || string_agg(CASE WHEN p = c THEN '└── ' ELSE '├── ' END || 'N:' || n_nationkey, chr(10) ORDER BY p) AS text
    FROM region JOIN n ON n_regionkey = r_regionkey GROUP BY r_regionkey""",
)
def g25(spark, d):
    return graph.tree_text(graph.forest(edges(spark, d, ("TREE",)).where(F.col("src").startswith("R:")), "TREE"), F.col("node"))


@query(
    "v01_label_counts",
    "SELECT 'R' AS label, count(*) AS n FROM region UNION ALL SELECT 'N', count(*) FROM nation UNION ALL SELECT 'C', count(*) FROM customer UNION ALL SELECT 'O', count(*) FROM orders UNION ALL SELECT 'P', count(*) FROM part UNION ALL SELECT 'S', count(*) FROM supplier",
)
def v01(spark, d):
    return views.label_counts(nodes(spark, d))


@query("v02_induced", "SELECT label, count(*) AS n FROM (SELECT DISTINCT 'O' AS label, l_orderkey FROM lineitem UNION ALL SELECT DISTINCT 'S', l_suppkey FROM lineitem UNION ALL SELECT 'R', r_regionkey FROM region) GROUP BY 1")
def v02(spark, d):
    kept, _ = views.induced(nodes(spark, d), edges(spark, d), "SUPPLY", extra=nodes(spark, d, "R"))
    return views.label_counts(kept)


@query("v03_views", "SELECT 'TREE' AS view, (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM supplier) AS n UNION ALL SELECT 'CALL+SUPPLY', 2 * count(*) FROM lineitem")
def v03(spark, d):
    e = edges(spark, d)
    one = graph.of_label(e, "TREE").agg(F.count("*").alias("n")).select(F.lit("TREE").alias("view"), "n")
    return one.unionByName(graph.of_label(e, "CALL", "SUPPLY").agg(F.count("*").alias("n")).select(F.lit("CALL+SUPPLY").alias("view"), "n"))


@query("v04_lifted_calls", "SELECT 'N:' || c_nationkey AS src, 'N:' || s_nationkey AS dst, count(*) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2")
def v04(spark, d):
    return views.lift(edges(spark, d, ("SUPPLY",)), owners(spark, d))


@query("v06_picker", "SELECT p_name AS name, min(p_partkey) AS first, count(*) AS n FROM part GROUP BY 1")
def v06(spark, d):
    return views.picker(nodes(spark, d, "P"))


@query("v07_noise", "SELECT event_type IN ('error', 'view') AS noise, count(*) AS n FROM events GROUP BY 1")
def v07(spark, d):
    kind = F.col("event_type")
    label = F.when(kind == "error", "BLOCK").when(kind.isin("view", "click"), "CALL").otherwise("METHOD")
    rows = table(spark, d, "events").select(label.alias("label"), F.when(kind == "view", "<operator>.assignment").when(kind == "click", "open").alias("name"))
    return rows.groupBy(views.is_noise().alias("noise")).agg(F.count("*").alias("n"))


@query("v08_induce", "SELECT count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE p_size > 25 AND o_orderstatus = 'O'")
def v08(spark, d):
    ids = table(spark, d, "part").where("p_size > 25").select(_id("P", "p_partkey").alias("id")).union(nodes(spark, d, "O").where("name = 'O'").select("id"))
    _, inner = views.induce(nodes(spark, d), edges(spark, d, ("CALL",)), ids)
    return inner.agg(F.count("*").alias("n"))


@query("v09_scope", "SELECT label, count(*) AS n FROM (SELECT 'N' AS label UNION ALL SELECT 'C' FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'S' FROM supplier WHERE s_nationkey = 3 UNION ALL SELECT 'O' FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3) GROUP BY 1")
def v09(spark, d):
    kept, _ = views.scope(nodes(spark, d, "RNCOS"), edges(spark, d, ("TREE",)), owners(spark, d), F.lit("N:3"))
    return views.label_counts(kept)


@query("v10_ego", "SELECT id FROM (SELECT 'N:4' AS id UNION ALL SELECT 'R:' || n_regionkey FROM nation WHERE n_nationkey = 4 UNION ALL SELECT 'C:' || c_custkey FROM customer WHERE c_nationkey = 4 UNION ALL SELECT 'S:' || s_suppkey FROM supplier WHERE s_nationkey = 4)")
def v10(spark, d):
    kept, _ = views.ego(nodes(spark, d, "RNCOS"), edges(spark, d, ("TREE",)), F.lit("N:4"))
    return kept.select("id")


@query("v11_contract", "SELECT 'C:' || o_custkey AS src, count(DISTINCT l_partkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def v11(spark, d):
    e = edges(spark, d, ("TREE", "CALL")).where(F.col("src").startswith("C:") | F.col("src").startswith("O:"))
    _, out = views.contract(nodes(spark, d, "COP"), e, F.col("label") != "O")
    return out.groupBy("src").agg(F.count("*").alias("n"))


@query("v12_search", "SELECT 'P:' || p_partkey AS id FROM part WHERE contains(lower(p_name), 'blue')")
def v12(spark, d):
    return views.search(nodes(spark, d, "P"), " BLUE ", "name", "label").select("id")


@query(
    "v13_neighbourhood",
    """SELECT id, min(hop)::INTEGER AS hop FROM (SELECT 'N:0' AS id, 0 AS hop UNION ALL SELECT 'R:' || n_regionkey, 1 FROM nation WHERE n_nationkey = 0
    UNION ALL SELECT 'C:' || c_custkey, 1 FROM customer WHERE c_nationkey = 0 UNION ALL SELECT 'S:' || s_suppkey, 1 FROM supplier WHERE s_nationkey = 0
    UNION ALL SELECT 'O:' || o_orderkey, 2 FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 0
    UNION ALL SELECT 'N:' || a.n_nationkey, 2 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE b.n_nationkey = 0) GROUP BY id""",
)
def v13(spark, d):
    return views.neighbourhood(edges(spark, d, ("TREE",)), nodes(spark, d, "N").where("id = 'N:0'"), 2)


@query("v14_pipeline", "SELECT count(*) AS n FROM (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_nationkey = 5)")
def v14(spark, d):
    own = owners(spark, d).where("owner = 'N:5'").select("id").union(nodes(spark, d, "P").select("id"))
    kept, inner = views.induce(nodes(spark, d), edges(spark, d, ("TREE", "CALL")), own)
    _, out = views.contract(kept, inner, F.col("label") != "O")
    return out.where(F.col("src").startswith("C:") & F.col("dst").startswith("P:")).agg(F.count("*").alias("n"))


@query("v17_nonempty", "SELECT 'O:' || o_orderkey AS id FROM orders WHERE EXISTS (FROM lineitem WHERE l_orderkey = o_orderkey)")
def v17(spark, d):
    return graph.with_body(nodes(spark, d, "O"), edges(spark, d, ("CALL",)), "CALL").select("id")


@query("v19_summary", "SELECT (SELECT count(*) FROM orders) + (SELECT count(*) FROM part) AS n_nodes, (SELECT count(*) FROM orders) AS n_methods, (SELECT count(*) FROM lineitem) AS n_edges")
def v19(spark, d):
    return views.summary(nodes(spark, d, "OP"), edges(spark, d, ("CALL",)), "O")


@query("v20_focus", "SELECT coalesce((SELECT 'P:' || min(p_partkey) FROM part WHERE p_name = 'red widget'), 'P:0') AS focus")
def v20(spark, d):
    return views.focus(nodes(spark, d, "P"), "red widget", "P:0")


def _handoffs() -> str:
    return """h AS (SELECT DISTINCT u AS src, v AS dst FROM (SELECT user_id AS u, lead(user_id) OVER (ORDER BY ts, event_id) AS v FROM events WHERE event_type = 'purchase') WHERE v IS NOT NULL AND u <> v)"""


def handoffs(spark, d) -> DataFrame:
    """User -> user of the next purchase: the events are dealt out by day, and each day's last
    purchase meets the first of the next day with one, so no window holds all rows."""
    from pyspark.sql import Window

    e = table(spark, d, "events").where("event_type = 'purchase'").select("user_id", "ts", "event_id", F.to_date("ts").alias("day"))
    w = Window.partitionBy("day").orderBy("ts", "event_id")
    inner = e.select("day", F.col("user_id").alias("src"), F.lead("user_id").over(w).alias("dst"))
    ends = e.groupBy("day").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first"), F.max_by("user_id", F.struct("ts", "event_id")).alias("last"))
    across = ends.select(F.col("last").alias("src"), F.lead("first").over(Window.orderBy("day")).alias("dst"))
    return inner.select("src", "dst").union(across).where(F.col("dst").isNotNull() & (F.col("src") != F.col("dst"))).distinct()


_REACH = f"""WITH RECURSIVE {_handoffs()}, s AS (SELECT min(user_id) AS u FROM events), r AS (SELECT u AS node, 0 AS depth FROM s UNION SELECT h.dst, r.depth + 1 FROM r JOIN h ON r.node = h.src WHERE r.depth < 6)"""


@query("f28_taint", _REACH + " SELECT node, min(depth)::INTEGER AS depth FROM r GROUP BY node")
def f28(spark, d):
    seed = table(spark, d, "events").agg(F.min("user_id").alias("id"))
    return traverse.distances(handoffs(spark, d), seed)


@query("f30_path", _REACH + ", m AS (SELECT node, min(depth) AS depth FROM r GROUP BY node) SELECT node AS target, (depth + 1)::BIGINT AS n_steps FROM m")
def f30(spark, d):
    seed = table(spark, d, "events").agg(F.min("user_id").alias("id"))
    seen = traverse.bfs(handoffs(spark, d), seed)
    return traverse.paths(seen, seen.select(F.col("node").alias("id"))).groupBy("target").agg(F.count("*").alias("n_steps"))


@query("f16_bounded", "SELECT 'C:' || o_custkey AS root, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_size = 7 GROUP BY 1")
def f16(spark, d):
    hops = [edges(spark, d, ("TREE",)).where(F.col("src").startswith("C:")), edges(spark, d, ("CALL",))]
    chains = traverse.bounded_chain(nodes(spark, d, "C"), hops)
    want = table(spark, d, "part").where("p_size = 7").select(_id("P", "p_partkey").alias("id"))
    return chains.join(want, "id", "left_semi").groupBy(F.col("chain")[0].alias("root")).agg(F.count("*").alias("n"))
