"""Statement and data-flow operators over event sequences: a user's events in the order of time are
a function's statements; purchases and signups define, clicks and views use, errors guard or kill;
the variable is the last digit of the event's number k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphlens.functions import text
from graphlens.operators import dataflow, evaluate, mlprep, rules, shape, statements, traverse
from graphlens.plans.registry import query
from graphlens.session import table

_E = """e AS (SELECT event_id, ts, user_id AS fn, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS sid FROM events)"""


def events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "ts", F.col("user_id").alias("fn"), "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return statements.number(e, "fn", "ts", "event_id").withColumn("sid", F.col("sid").cast("long"))


def mentions(spark, d) -> DataFrame:
    return events(spark, d).select("fn", "sid", F.lit(0).alias("phase"), (F.col("k") % 10).alias("var"), F.col("event_type").isin("purchase", "signup").alias("is_def"), F.col("event_type").isin("click", "view").alias("is_use"), (F.col("event_type") == "error").alias("is_kill"), "value", "event_type")


@query("a01_numbering", f"WITH {_E} SELECT event_id, sid FROM e")
def a01(spark, d):
    return events(spark, d).select("event_id", "sid")


@query("a05_order", f"WITH {_E} SELECT fn, lag(sid) OVER (PARTITION BY fn ORDER BY ts, event_id) AS src, sid AS dst FROM e QUALIFY src IS NOT NULL")
def a05(spark, d):
    return statements.order_edges(events(spark, d), ["fn"], "ts", "event_id")


@query("a06_guard", f"WITH {_E}, b AS (SELECT fn, sid, event_type, last_value(CASE WHEN event_type = 'error' THEN sid END IGNORE NULLS) OVER (PARTITION BY fn ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS control FROM e) SELECT fn, control AS src, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS branch, min(sid) AS dst FROM b WHERE control IS NOT NULL GROUP BY ALL")
def a06(spark, d):
    e = events(spark, d)
    w = W.partitionBy("fn").orderBy("sid").rowsBetween(W.unboundedPreceding, -1)
    control = F.last(F.when(F.col("event_type") == "error", F.col("sid")), ignorenulls=True).over(w)
    blocks = e.select("fn", "sid", F.col("sid").alias("path"), control.alias("control"), (F.col("event_type") == "view").cast("int").alias("branch")).where(F.col("control").isNotNull())
    return statements.guard_edges(blocks)


@query("a12_context", f"WITH {_E}, g AS (SELECT fn, k % 10 AS var, sid AS gsid, value FROM e WHERE event_type = 'error'), x AS (SELECT e.fn, e.sid, g.var, g.gsid, g.value FROM e JOIN g ON e.fn = g.fn AND e.k % 10 = g.var AND g.gsid < e.sid), i AS (SELECT fn, sid, arg_max(value, gsid) AS v FROM x GROUP BY ALL) SELECT fn, sid, CASE WHEN v > 50 THEN 3 ELSE 1 END AS strength, CASE WHEN v > 50 THEN round(1 / v, 6) ELSE 0 END AS norm FROM i")
def a12(spark, d):
    m = mentions(spark, d)
    w = W.partitionBy("fn", "var").orderBy("sid").rowsBetween(W.unboundedPreceding, -1)
    g = F.last(F.when(F.col("is_kill"), F.struct("sid", "value")), ignorenulls=True).over(w)
    active = m.withColumn("g", g).where(F.col("g").isNotNull()).select("fn", "sid", F.col("g.sid").alias("depth"), "var", F.lit(1).alias("lower"), (F.col("g.value") > 50).cast("int").alias("upper"), F.when(F.col("g.value") > 50, 1 / F.col("g.value")).otherwise(0.0).alias("norm"))
    return statements.context(active).withColumn("norm", F.round("norm", 6))


@query("a13_upper_norm", f"WITH {_E} SELECT fn, round(max(CASE WHEN event_type = 'error' THEN least(value, 100) / 100 END), 6) AS norm FROM e GROUP BY fn")
def a13(spark, d):
    return events(spark, d).groupBy("fn").agg(F.round(F.max(F.when(F.col("event_type") == "error", text.norm_value("value"))), 6).alias("norm"))


@query("a14_flags", f"WITH {_E} SELECT event_id, (event_type NOT IN ('error', 'signup'))::INTEGER AS train_mask, coalesce(max((event_type = 'signup')::INTEGER) OVER (PARTITION BY fn ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS in_loop FROM e")
def a14(spark, d):
    w = W.partitionBy("fn").orderBy("sid").rowsBetween(W.unboundedPreceding, -1)
    loop = F.max((F.col("event_type") == "signup").cast("int")).over(w)
    kind = F.when(F.col("event_type") == "error", "BreakStatement").when(F.col("event_type") == "signup", "ContinueStatement").otherwise("AssignmentExpression")
    return events(spark, d).select("event_id", statements.train_mask(kind).alias("train_mask"), F.coalesce(loop, F.lit(0)).alias("in_loop"))


_DU = f"""{_E}, m AS (SELECT fn, sid, k % 10 AS var, event_type IN ('purchase', 'signup') AS is_def, event_type IN ('click', 'view') AS is_use, event_type FROM e),
du AS (SELECT * FROM (SELECT fn, last_value(CASE WHEN is_def THEN sid END IGNORE NULLS) OVER (PARTITION BY fn, var ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS src, sid AS dst, var, is_use, event_type FROM m) WHERE is_use AND src IS NOT NULL)"""


@query("d01_def_use", f"WITH {_DU} SELECT fn, src, dst, var FROM du")
def d01(spark, d):
    return dataflow.def_use(mentions(spark, d))


@query("d01_def_use_kill", f"WITH {_E}, m AS (SELECT fn, sid, k % 10 AS var, event_type FROM e), x AS (SELECT fn, sid, var, event_type, max(CASE WHEN event_type IN ('purchase', 'signup') THEN sid END) OVER w AS d, max(CASE WHEN event_type = 'error' THEN sid END) OVER w AS q FROM m WINDOW w AS (PARTITION BY fn, var ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT fn, d AS src, sid AS dst, var FROM x WHERE event_type IN ('click', 'view') AND d IS NOT NULL AND (q IS NULL OR q < d)")
def d01k(spark, d):
    return dataflow.def_use(mentions(spark, d), kill=F.col("is_kill"))


@query("d02_first_edges", f"WITH {_DU}, y AS (SELECT fn, src, var, event_type AS flow, min(dst) AS first, count(*) AS n FROM du GROUP BY ALL) SELECT fn, src, var, flow, first FROM y")
def d02(spark, d):
    e = dataflow.def_use(mentions(spark, d), extra=("event_type",)).withColumnRenamed("event_type", "flow")
    once = dataflow.first_edges(e.select("fn", "src", F.lit(0).alias("dst"), "var", "flow", F.col("dst").alias("at")), "at")
    return once.select("fn", "src", "var", "flow", F.col("at").alias("first"))


@query("d03_roles", f"WITH {_DU} SELECT CASE event_type WHEN 'click' THEN 'value' ELSE 'index' END AS role, CASE event_type WHEN 'click' THEN 1 ELSE 2 END AS flow_id, count(*) AS n FROM du GROUP BY ALL")
def d03(spark, d):
    e = dataflow.def_use(mentions(spark, d), extra=("event_type",)).withColumn("role", F.when(F.col("event_type") == "click", "value").otherwise("index"))
    return e.groupBy("role", dataflow.flow_id("role").alias("flow_id")).agg(F.count("*").alias("n"))


@query("d04_merge", f"""WITH {_DU}, g AS (SELECT fn, k % 10 AS var, max(value) AS v FROM e WHERE event_type = 'error' GROUP BY ALL)
    SELECT du.fn, src, dst, du.var, CASE WHEN g.v IS NULL THEN 0 WHEN g.v > 50 THEN 2 ELSE 1 END AS guard_kind, CASE WHEN g.v IS NULL THEN 0 ELSE 1 END AS has_lower, CASE WHEN g.v > 50 THEN 1 ELSE 0 END AS has_upper, coalesce(round(CASE WHEN g.v > 50 THEN 1 / g.v ELSE 0 END, 6), 0) AS upper_norm FROM du LEFT JOIN g ON du.fn = g.fn AND du.var = g.var""")
def d04(spark, d):
    m = mentions(spark, d)
    e = dataflow.def_use(m)
    g = m.where("is_kill").groupBy("fn", "var").agg(F.max("value").alias("v"))
    big = F.col("v") > 50
    at = e.select("fn", F.col("dst").alias("sid"), "var").distinct().join(g, ["fn", "var"]).select("fn", "sid", "var", F.when(big, 2).otherwise(1).alias("kind"), F.lit(1).alias("lower"), big.cast("int").alias("upper"), F.when(big, 1 / F.col("v")).otherwise(0.0).alias("norm"))
    return dataflow.merge_guards(e, at).withColumn("upper_norm", F.round("upper_norm", 6))


@query("d05_guard_map", """SELECT 'N:' || n AS guard, count(*) AS n_reached, max(lower)::INTEGER AS lower FROM (SELECT c_nationkey AS n, 1 AS lower FROM customer JOIN orders ON o_custkey = c_custkey UNION ALL SELECT c_nationkey, 1 FROM customer UNION ALL SELECT s_nationkey, 1 FROM supplier UNION ALL SELECT n_nationkey, 1 FROM nation) GROUP BY n""")
def d05(spark, d):
    from graphlens.plans.commerce import edges, nodes

    guards = nodes(spark, d, "N").select(F.col("id").alias("start"), F.lit(1).alias("kind"), F.col("id").alias("var"), F.lit(1).alias("lower"), F.lit(0).alias("upper"), F.lit(0.0).alias("norm"))
    spread = statements.guard_map(edges(spark, d, ("TREE",)), guards)
    return spread.groupBy(F.col("var").alias("guard")).agg(F.count("*").alias("n_reached"), F.max("lower").alias("lower"))


@query("d09_writes", "SELECT DISTINCT l_orderkey AS fn, l_partkey AS var FROM lineitem WHERE (l_returnflag = 'A' AND l_linenumber = 1) OR (l_returnflag = 'R' AND l_linenumber = 2)")
def d09(spark, d):
    calls = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("fn"), F.lit(0).alias("sid"), F.col("l_returnflag").alias("name"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("var"))
    slots = spark.createDataFrame([("A", 1), ("R", 2)], "name string, dst int")
    return dataflow.write_targets(calls, slots).select("fn", "var")


@query("d08_argument_roles", """WITH x AS (SELECT l_orderkey AS fn, l_partkey AS var, min(CASE WHEN l_linestatus = 'O' AND l_linenumber > 5 THEN 0 WHEN l_returnflag = 'A' AND l_linenumber = 2 THEN 1 WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN 2 ELSE 3 END) AS r FROM lineitem GROUP BY l_orderkey, l_returnflag, l_partkey) SELECT (['index', 'size', 'base', 'value'])[r + 1] AS role, count(*) AS n FROM x GROUP BY 1""")
def d08(spark, d):
    calls = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("fn"), F.lit(0).alias("sid"), F.col("l_returnflag").alias("name"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("var"), ((F.col("l_linestatus") == "O") & (F.col("l_linenumber") > 5)).alias("is_index"))
    slots = spark.createDataFrame([("A", 1, 2)], "name string, dst int, size int")
    return dataflow.argument_roles(calls, slots).groupBy("role").agg(F.count("*").alias("n"))


@query("d16_sinks", f"WITH {_E} SELECT fn, sid, (event_type IN ('error'))::INTEGER AS is_sink_call_unbounded, (event_type IN ('click', 'view'))::INTEGER AS is_sink_call_bounded FROM e")
def d16(spark, d):
    return dataflow.sink_flags(events(spark, d).withColumn("name", F.col("event_type")), ["error"], ["click", "view"])


@query("d18_degrees", f"WITH {_DU} SELECT fn, sid, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT fn, src AS sid, 0 AS i, 1 AS o FROM du UNION ALL SELECT fn, dst, 1, 0 FROM du) GROUP BY ALL")
def d18(spark, d):
    return dataflow.degrees(dataflow.def_use(mentions(spark, d)))


@query("d19_counts", f"WITH {_E} SELECT fn, sid // 10 AS block, count(DISTINCT CASE WHEN event_type IN ('purchase', 'signup') THEN k % 10 END) AS def_count, count(DISTINCT CASE WHEN event_type IN ('click', 'view') THEN k % 10 END) AS use_count, coalesce(string_agg(DISTINCT CASE WHEN event_type IN ('purchase', 'signup') THEN (k % 10)::VARCHAR END, ',' ORDER BY CASE WHEN event_type IN ('purchase', 'signup') THEN (k % 10)::VARCHAR END), '') AS defs FROM e GROUP BY ALL")
def d19(spark, d):
    m = mentions(spark, d).where("is_def or is_use or is_kill").withColumn("var", F.when(~F.col("is_kill"), F.col("var").cast("string"))).withColumn("sid", F.floor(F.col("sid") / 10))
    return dataflow.variables(m).select("fn", F.col("sid").alias("block"), "def_count", "use_count", F.array_join("def_vars", ",").alias("defs"))


@query("f08_first_via", f"WITH {_E}, s AS (SELECT fn, sid, event_id FROM e WHERE event_type = 'signup'), n AS (SELECT s.event_id, min(CASE WHEN e.event_type = 'purchase' THEN e.sid END) AS p, min(CASE WHEN e.event_type = 'error' THEN e.sid END) AS x FROM s LEFT JOIN e ON s.fn = e.fn AND e.sid > s.sid GROUP BY 1) SELECT event_id, CASE WHEN p IS NOT NULL AND (x IS NULL OR p < x) THEN p END AS hit FROM n")
def f08(spark, d):
    t = F.col("event_type")
    return traverse.first_after(events(spark, d), "fn", ["sid"], t == "signup", t == "purchase", t == "error", "sid").select("event_id", "hit")


@query("f30_collapse", f"WITH {_E}, l AS (SELECT fn, sid, event_type, lag(event_type) OVER (PARTITION BY fn ORDER BY sid) AS p FROM e) SELECT fn, sid, row_number() OVER (PARTITION BY fn ORDER BY sid)::INTEGER AS step FROM l WHERE p IS DISTINCT FROM event_type")
def f30c(spark, d):
    return traverse.collapse_steps(events(spark, d), "fn", "sid", "event_type").select("fn", "sid", "step")


@query("f44_ids", f"WITH {_E} SELECT event_id, printf('EV-%04d', sid + 1) AS id FROM e")
def f44(spark, d):
    return rules.prefixed_ids(events(spark, d), "EV", "fn", "sid").select("event_id", "id")


@query("p05_snippets", """WITH m AS (SELECT user_id, (floor(epoch(ts))::BIGINT // 60) % 1440 AS line FROM events), g AS (SELECT *, coalesce((line - lag(line) OVER w > 4)::INTEGER, 0) AS f FROM m WINDOW w AS (PARTITION BY user_id ORDER BY line)),
    h AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY line) AS g FROM g) SELECT user_id, greatest(min(line) - 3, 1) AS first, least(max(line) + 3, 1440) AS last, count(*) AS n FROM h GROUP BY user_id, g""")
def p05(spark, d):
    refs = table(spark, d, "events").select("user_id", (F.floor(F.unix_timestamp("ts") / 60) % 1440).cast("long").alias("line"))
    out = shape.snippets(refs, "user_id", "line", 3, F.lit(1440))
    return out.select("user_id", F.col("first").cast("long"), F.col("last").cast("long"), "n")


@query("n34_downsample", f"WITH {_E}, s AS (SELECT *, count(*) OVER (PARTITION BY fn) AS c FROM e) SELECT event_id FROM s WHERE sid % ceil(c / 20.0)::BIGINT = 0")
def n34(spark, d):
    return mlprep.downsample(events(spark, d), "fn", "sid", 20).select("event_id")


@query("e03_stats", "SELECT event_type, count(value) AS n, round(min(value), 6) AS lo, round(max(value), 6) AS hi, round(avg(value), 6) AS mean, round(median(value), 6) AS mid FROM events GROUP BY 1")
def e03(spark, d):
    return evaluate.stats(table(spark, d, "events"), "value", "event_type")


@query("t14_islands", f"WITH {_E}, x AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN sid END IGNORE NULLS) OVER (PARTITION BY fn ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS label_at FROM e) SELECT fn, label_at, count(*) AS n FROM x GROUP BY ALL")
def t14(spark, d):
    return statements.islands(events(spark, d), "fn", "sid", F.col("event_type") == "signup").groupBy("fn", "label_at").agg(F.count("*").alias("n"))
