"""The evidence calculus over line items: a part is to be resolved, its suppliers are the candidates,
and each line is evidence whose weight follows the return flag, whose provenance group is the order
and whose match strength follows the line status. Rules and checks run over parts, orders and events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.functions.knowledge import BOUNDED_SINKS, CALL_CATEGORY, KnowledgeBase
from graphlens.operators import calculus, evaluate, rules, shape
from graphlens.operators.calculus import lookup
from graphlens.plans.registry import query
from graphlens.session import parts_for, table

_KIND = {"A": "ENUM_CASE", "N": "REGISTRATION_INIT", "R": "NAME_MATCH"}


def evidence(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    kind = lookup("l_returnflag", _KIND)
    match = F.when(F.col("l_linestatus") == "F", "RESOLVED_VALUE").otherwise("HEURISTIC_SUBSTRING")
    return li.select(
        F.col("l_partkey").alias("slot"), F.col("l_suppkey").alias("callback"), kind.alias("kind"), lookup(kind, calculus.KIND_WEIGHT).alias("weight"), match.alias("match"), F.col("l_orderkey").alias("group"),
        F.when(F.col("l_linenumber") > 4, F.col("l_linenumber")).alias("site"), F.array(F.col("l_tax"), F.col("l_discount")).alias("nodes"), F.col("l_returnflag").alias("extractor"), (F.col("l_quantity") > 45).alias("conflicting"),
    )


_EV = """ev AS (SELECT l_partkey AS slot, l_suppkey AS callback, CASE l_returnflag WHEN 'A' THEN 'ENUM_CASE' WHEN 'N' THEN 'REGISTRATION_INIT' ELSE 'NAME_MATCH' END AS kind,
    CASE l_returnflag WHEN 'A' THEN 0.85 WHEN 'N' THEN 0.80 ELSE 0.70 END::DOUBLE AS weight, CASE l_returnflag WHEN 'A' THEN 4 WHEN 'N' THEN 3 ELSE 1 END AS krank,
    l_linestatus = 'F' AS strong, CASE WHEN l_linestatus = 'F' THEN 0.95 ELSE 0.70 END::DOUBLE AS mult, l_orderkey AS grp, CASE WHEN l_linenumber > 4 THEN l_linenumber ELSE -1 END AS site,
    list_sort([l_tax, l_discount]) AS nodes, l_returnflag AS extractor, l_quantity > 45 AS bad FROM lineitem),
sc AS (SELECT *, round(weight * mult, 6) AS pre, CASE WHEN bad THEN round(weight * least(mult, 0.7::DOUBLE) * 0.5::DOUBLE, 6) ELSE round(weight * mult, 6) END AS score FROM ev),
gm AS (SELECT slot, callback, grp, max(score) AS g, bool_or(strong) AS strong FROM sc GROUP BY ALL),
no AS (SELECT slot, callback, least(1 - product(1 - g), 0.99::DOUBLE) AS c, bool_or(strong) AS strong FROM gm GROUP BY ALL),
cf AS (SELECT slot, callback, round(CASE WHEN strong THEN c ELSE least(c, 0.85::DOUBLE) END, 6) AS confidence FROM no),
be AS (SELECT slot, callback, max(weight) AS best_weight, max(CASE WHEN true THEN krank END) AS kr FROM ev GROUP BY ALL),
br AS (SELECT e.slot, e.callback, max(e.krank) AS best_rank FROM ev e JOIN be USING (slot, callback) WHERE e.weight = be.best_weight GROUP BY ALL),
rk AS (SELECT cf.*, row_number() OVER (PARTITION BY slot ORDER BY confidence DESC, best_rank DESC, callback)::INTEGER AS rank FROM cf JOIN br USING (slot, callback)),
se AS (SELECT *, lead(confidence) OVER (PARTITION BY slot ORDER BY rank) AS runner_up, count(*) OVER (PARTITION BY slot) AS n_candidates FROM rk)"""
_SELECT = "SELECT slot, CASE WHEN confidence < 0.5 THEN 'UNRESOLVED' WHEN confidence - runner_up < 0.15 THEN 'AMBIGUOUS' ELSE 'RESOLVED' END AS status, CASE WHEN confidence < 0.5 THEN 'LOW_CONFIDENCE' END AS reason, CASE WHEN confidence >= 0.5 AND (runner_up IS NULL OR confidence - runner_up >= 0.15) THEN callback END AS chosen, confidence AS top, runner_up, round(confidence - runner_up, 6) AS margin, n_candidates FROM se WHERE rank = 1"


@query("r01_dedup", f"WITH {_EV} SELECT slot, callback, kind, site, count(*) AS n, max(w) AS weight FROM (SELECT slot, callback, kind, site, nodes, max(weight) AS w FROM ev GROUP BY ALL) GROUP BY slot, callback, kind, site")
def r01(spark, d):
    return calculus.dedupe(evidence(spark, d)).groupBy("slot", "callback", "kind", F.coalesce("site", F.lit(-1)).alias("site")).agg(F.count("*").alias("n"), F.max("weight").alias("weight"))


@query("r02_match_tables", "SELECT l_linestatus, CASE WHEN l_linestatus = 'F' THEN 3 ELSE 1 END AS rank, CASE WHEN l_linestatus = 'F' THEN 0.95 ELSE 0.70 END::DOUBLE AS mult, count(*) AS n FROM lineitem GROUP BY ALL")
def r02(spark, d):
    m = F.when(F.col("l_linestatus") == "F", "RESOLVED_VALUE").otherwise("HEURISTIC_SUBSTRING")
    return table(spark, d, "lineitem").groupBy("l_linestatus", lookup(m, calculus.MATCH_RANK).alias("rank"), lookup(m, calculus.MATCH_MULTIPLIER).alias("mult")).agg(F.count("*").alias("n"))


@query("r03_consistency", "SELECT CASE WHEN s_nationkey IS NULL THEN 'PARTIAL' WHEN c_nationkey = s_nationkey THEN 'CONSISTENT' ELSE 'CONFLICTING' END AS state, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal > 1000 GROUP BY 1")
def r03(spark, d):
    c = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    s = table(spark, d, "supplier").where("s_acctbal > 1000").select("s_suppkey", "s_nationkey")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(c, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    implied = F.array(F.array("c_nationkey"), F.when(F.col("s_nationkey").isNotNull(), F.array("s_nationkey")))
    none = F.lit(None).cast("int")
    return rows.groupBy(calculus.consistency(none, none, implied).alias("state")).agg(F.count("*").alias("n"))


@query("r05_scores", f"WITH {_EV} SELECT kind, strong, bad, max(pre) AS pre, max(score) AS score, count(*) AS n FROM sc GROUP BY ALL")
def r05(spark, d):
    s = calculus.score(evidence(spark, d))
    return s.groupBy("kind", (F.col("match") == "RESOLVED_VALUE").alias("strong"), F.col("conflicting").alias("bad")).agg(F.max("score_pre_penalty").alias("pre"), F.max("score").alias("score"), F.count("*").alias("n"))


@query("r06_group_max", f"WITH {_EV} SELECT slot, callback, grp AS \"group\", g, strong FROM gm")
def r06(spark, d):
    return calculus.group_max(calculus.score(evidence(spark, d))).select("slot", "callback", "group", "g", "strong")


@query("r07_noisy_or", f"WITH {_EV} SELECT slot, callback, confidence FROM cf")
def r07(spark, d):
    return calculus.noisy_or(calculus.group_max(calculus.score(evidence(spark, d))))


@query("r08_ranking", f"WITH {_EV} SELECT slot, callback, confidence, rank FROM rk")
def r08(spark, d):
    return calculus.corroborate(evidence(spark, d)).select("slot", "callback", "confidence", "rank")


@query("r09_status", f"WITH {_EV} {_SELECT}")
def r09(spark, d):
    return calculus.select(calculus.corroborate(evidence(spark, d)))


@query("r10_cascade", f"WITH {_EV}, ca AS (SELECT slot, callback, best_weight AS confidence, best_rank FROM be JOIN br USING (slot, callback)) SELECT slot, callback, confidence, row_number() OVER (PARTITION BY slot ORDER BY confidence DESC, best_rank DESC, callback)::INTEGER AS rank FROM ca")
def r10(spark, d):
    return calculus.cascade(evidence(spark, d)).select("slot", "callback", "confidence", "rank")


@query("r11_conflict", f"WITH {_EV} SELECT slot, string_agg(callback::VARCHAR, ',' ORDER BY rank) AS competing, round(max(confidence) FILTER (rank = 1) - max(confidence) FILTER (rank = 2), 6) AS margin FROM rk WHERE rank <= 3 GROUP BY slot HAVING count(*) > 1")
def r11(spark, d):
    out = calculus.conflicts(calculus.corroborate(evidence(spark, d)))
    return out.select("slot", F.array_join(F.transform("competing", lambda c: c["callback"].cast("string")), ",").alias("competing"), "margin")


@query("r12_best", f"WITH {_EV} SELECT slot, callback, best_weight FROM be")
def r12(spark, d):
    return calculus.best_evidence(evidence(spark, d)).select("slot", "callback", "best_weight")


@query("e04_records", f"WITH {_EV}, t AS (SELECT slot, callback, max(score) AS best FROM sc GROUP BY ALL) SELECT se.slot, confidence AS top, runner_up, round(confidence - best, 6) AS lift FROM se JOIN t USING (slot, callback) WHERE rank = 1")
def e04(spark, d):
    ev = evidence(spark, d)
    c = calculus.corroborate(ev)
    scores = calculus.score(ev).select("slot", "callback", "score")
    best = scores.repartition(parts_for(scores), "slot", "callback").groupBy("slot", "callback").agg(F.max("score").alias("best_score"))
    return evaluate.records(c.join(best, ["slot", "callback"]), calculus.select(c)).select("slot", "top", "runner_up", "lift")


@query("e05_histograms", f"WITH {_EV}, o AS ({_SELECT}) SELECT 'total' AS name, NULL AS value, count(*) AS n FROM o UNION ALL SELECT 'status', status, count(*) FROM o GROUP BY ALL UNION ALL SELECT 'reason', reason, count(*) FROM o GROUP BY ALL")
def e05(spark, d):
    return evaluate.histograms(calculus.select(calculus.corroborate(evidence(spark, d))), "status", "reason")


@query("e06_nested", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def e06(spark, d):
    return evaluate.nested_histogram(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


_REASONS = {"1-URGENT": "EXTERNAL_DEFINITION", "2-HIGH": "UNRESOLVED_INDIRECT_CALL", "3-MEDIUM": "REGISTRAR_STORE_NOT_REACHED", "4-NOT SPECIFIED": "NO_EVIDENCE", "5-LOW": "LOW_CONFIDENCE"}


@query("e01_classify", """SELECT tier, category, class_confidence, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN 'POLICY' WHEN o_orderstatus = 'F' THEN NULL WHEN o_orderpriority = '1-URGENT' THEN 'ANALYSIS_SCOPE' WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 'POTENTIALLY_SUPPORTABLE' WHEN o_orderpriority = '5-LOW' THEN 'POLICY' WHEN o_totalprice > 200000 THEN 'ANALYSIS_SCOPE' ELSE 'UNKNOWN' END AS tier,
    CASE WHEN o_orderstatus = 'P' THEN 'COMPETING_CANDIDATES' WHEN o_orderstatus = 'F' THEN NULL WHEN o_orderpriority = '1-URGENT' THEN 'EXTERNAL_DEFINITION' WHEN o_orderpriority = '2-HIGH' THEN 'INDIRECT_CALL' WHEN o_orderpriority = '3-MEDIUM' THEN 'VARIABLE_INDEX_CORRELATION' WHEN o_orderpriority = '5-LOW' THEN 'LOW_CONFIDENCE' WHEN o_totalprice > 200000 THEN 'CROSS_TU_REGISTRATION' END AS category,
    CASE WHEN o_orderstatus = 'P' THEN 'HIGH' WHEN o_orderstatus = 'F' THEN NULL WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN 'HIGH' WHEN o_orderpriority = '2-HIGH' THEN 'MEDIUM' WHEN o_orderpriority = '3-MEDIUM' THEN 'LOW' WHEN o_totalprice > 200000 THEN 'MEDIUM' ELSE 'LOW' END AS class_confidence FROM orders) GROUP BY ALL""")
def e01(spark, d):
    status = lookup("o_orderstatus", {"P": "AMBIGUOUS", "F": "RESOLVED", "O": "UNRESOLVED"})
    rows = table(spark, d, "orders").select(status.alias("status"), lookup("o_orderpriority", _REASONS).alias("reason"), (F.col("o_totalprice") > 200000).alias("referenced"))
    return rules.classify_outcome(rows).groupBy("tier", "category", "class_confidence").agg(F.count("*").alias("n"))


@query("e02_referenced", "SELECT t.token, count(DISTINCT p_partkey) AS n, coalesce(bool_or(p_size = 50), false) AS any_large FROM (VALUES ('RED'), ('BOLT'), ('ZZZ')) t(token) LEFT JOIN part ON contains(upper(p_name), t.token) GROUP BY 1")
def e02(spark, d):
    tokens = ["RED", "BOLT", "ZZZ"]
    rows = evaluate.token_hits(table(spark, d, "part").select("p_partkey", "p_size", "p_name"), "p_name", tokens)
    found = rows.groupBy("token").agg(F.count_distinct("p_partkey").alias("n"), F.bool_or(F.col("p_size") == 50).alias("any_large"))
    return spark.createDataFrame([(t,) for t in tokens], "token string").join(found, "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("any_large", F.lit(False)).alias("any_large"))


_CALLS = {"ECONOMY": "system", "SMALL": "STRCPY", "STANDARD": "fopen", "MEDIUM": "mysql_query", "LARGE": "helper", "PROMO": "memcpy"}
_CALL_CASE = "CASE p_type WHEN 'ECONOMY' THEN 'system' WHEN 'SMALL' THEN 'STRCPY' WHEN 'STANDARD' THEN 'fopen' WHEN 'MEDIUM' THEN 'mysql_query' WHEN 'LARGE' THEN 'helper' ELSE 'memcpy' END"
_DOMAIN_CASE = "CASE p_type WHEN 'ECONOMY' THEN 'COMMAND_EXECUTION' WHEN 'SMALL' THEN 'MEMORY_UNSAFE_OPERATION' WHEN 'STANDARD' THEN 'FILE_WRITE' WHEN 'MEDIUM' THEN 'database_query_execution' WHEN 'LARGE' THEN 'UNKNOWN_SINK' ELSE 'MEMORY_UNSAFE_OPERATION' END"


def calls(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", "p_size", lookup("p_type", _CALLS).alias("name"))


@query("k01_field_profiles", "SELECT * FROM (VALUES ('DataTransfer', 'data', 'vendor_controlled_payload', 3::BIGINT), ('RemoteStartTransaction', 'idTag', 'remote_authorization_id', 2), ('SetChargingProfile', 'csChargingProfiles.chargingSchedule', 'charging_schedule_payload', 2), ('SetChargingProfile', 'csChargingProfiles.chargingSchedule.length', 'profile_copy_length', 1), ('UpdateFirmware', 'location', 'firmware_download_url', 4)) t(action, field, semantic, n_checks)")
def k01(spark, d):
    return KnowledgeBase(spark).fields.select("action", "field", "semantic", F.size("checks").cast("long").alias("n_checks"))


@query("k04_sink", f"SELECT {_DOMAIN_CASE} AS domain, CASE p_type WHEN 'ECONOMY' THEN 'HIGH' WHEN 'MEDIUM' THEN 'HIGH' WHEN 'STANDARD' THEN 'MEDIUM' WHEN 'LARGE' THEN NULL ELSE 'MEDIUM_HIGH' END AS severity, count(*) AS n FROM part GROUP BY ALL")
def k04(spark, d):
    return rules.map_sinks(calls(spark, d), KnowledgeBase(spark).apis).groupBy("domain", "severity").agg(F.count("*").alias("n"))


_ROOT_DOMAIN = "CASE p_type WHEN 'ECONOMY' THEN 'untrusted_ocpp_field_to_dangerous_sink,remote_id_to_command_injection' WHEN 'STANDARD' THEN '' WHEN 'LARGE' THEN '' WHEN 'MEDIUM' THEN 'untrusted_payload_to_sql_injection' ELSE 'remote_length_to_unbounded_profile_copy' END"


@query("k06_root_causes", f"SELECT p_partkey, CASE WHEN p_size > 25 AND p_type = 'ECONOMY' THEN 'untrusted_ocpp_field_to_dangerous_sink,missing_firmware_integrity_verification,remote_id_to_command_injection' WHEN p_size > 25 AND {_ROOT_DOMAIN} <> '' THEN 'missing_firmware_integrity_verification,' || {_ROOT_DOMAIN} WHEN p_size > 25 THEN 'missing_firmware_integrity_verification' ELSE {_ROOT_DOMAIN} END AS causes FROM part")
def k06(spark, d):
    kb = KnowledgeBase(spark)
    rows = rules.map_sinks(calls(spark, d), kb.apis).select("p_partkey", "domain", F.when(F.col("p_size") > 25, F.array(F.lit("SIGNATURE_VERIFICATION"))).otherwise(F.array().cast("array<string>")).alias("missing"))
    return rules.root_causes(rows, kb.causes).select("p_partkey", F.array_join("causes", ",").alias("causes"))


@query("f32_prefer", "WITH x AS (SELECT DISTINCT l_orderkey, l_partkey, l_returnflag = 'R' AS p FROM lineitem) SELECT l_orderkey, count(*) AS n FROM (SELECT *, bool_or(p) OVER (PARTITION BY l_orderkey) AS s FROM x) WHERE p = s GROUP BY 1")
def f32(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_returnflag") == "R").alias("p")).distinct()
    return rules.prefer(rows, "l_orderkey", F.col("p")).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("f36_first_rule", "SELECT p_partkey, CASE WHEN p_name LIKE 'red%' THEN 'NULL_CHECK' WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'URL_SCHEME_CHECK' WHEN p_size < 20 THEN 'LENGTH_CHECK' END AS rule FROM part")
def f36(spark, d):
    r = [("NULL_CHECK", F.col("p_name").startswith("red")), ("URL_SCHEME_CHECK", F.col("p_type").isin("ECONOMY", "PROMO")), ("LENGTH_CHECK", F.col("p_size") < 20)]
    return rules.first_rule(table(spark, d, "part"), r).select("p_partkey", "rule")


@query("f37_conditions", "SELECT p_partkey AS cond, CASE WHEN p_type = 'ECONOMY' THEN 'LENGTH_CHECK' WHEN p_type = 'SMALL' THEN 'URL_SCHEME_CHECK' WHEN p_size > 40 THEN 'NULL_CHECK' WHEN p_size > 20 THEN 'URL_SCHEME_CHECK' WHEN p_size > 10 THEN 'LENGTH_BOUND_CHECK' END AS check_type FROM part WHERE p_type IN ('ECONOMY', 'SMALL') OR p_size > 10")
def f37(spark, d):
    none = F.array().cast("array<string>")
    size = F.col("p_size")
    rows = table(spark, d, "part").select(
        F.col("p_partkey").alias("cond"),
        F.when(F.col("p_type") == "ECONOMY", F.array(F.lit("strnlen"))).when(F.col("p_type") == "SMALL", F.array(F.lit("StrNCmp"))).otherwise(none).alias("calls"),
        F.when(size > 20, F.array(F.lit("<operator>.equals"))).when(size > 10, F.array(F.lit("<operator>.lessThan"))).otherwise(none).alias("operators"),
        F.when(size > 40, F.array(F.lit("NULL"))).otherwise(none).alias("identifiers"),
        F.when(size > 20, F.array(F.lit("https://x"))).otherwise(none).alias("literals"),
    )
    return rules.classify_conditions(rows, KnowledgeBase(spark).patterns).select("cond", "check_type")


@query("f38_ordered", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN true WHEN o_orderstatus = 'O' THEN false ELSE coalesce(day(o_orderdate) <= month(o_orderdate), false) END AS before FROM orders")
def f38(spark, d):
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").select("o_orderkey", rules.ordered_before(s == "F", s == "O", F.dayofmonth("o_orderdate"), F.month("o_orderdate")).alias("before"))


@query("f39_negative", """SELECT slot, "check", domain FROM (SELECT l_orderkey AS slot, c.chk AS "check", arg_min(dm, {'n': l_linenumber, 'd': dm}) AS domain FROM (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'COMMAND_EXECUTION' WHEN 'R' THEN 'database_query_execution' ELSE 'FILE_WRITE' END AS dm FROM lineitem) JOIN (VALUES ('SAFE_DOWNLOAD_API_NO_SHELL', 'COMMAND_EXECUTION'), ('SQL_PARAMETERIZATION', 'database_query_execution'), ('RS_NO_SHELL_EXECUTION', 'COMMAND_EXECUTION')) c(chk, nd) ON dm = c.nd GROUP BY ALL)""")
def f39(spark, d):
    checks = KnowledgeBase(spark).checks.select("check", F.explode("negative_domains").alias("negative_domain"))
    dom = F.coalesce(lookup("l_returnflag", {"A": "COMMAND_EXECUTION", "R": "database_query_execution"}), F.lit("FILE_WRITE"))
    reached = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("slot"), dom.alias("domain"), F.col("l_linenumber").alias("ord"))
    return rules.negative_evidence(reached, checks)


@query("f40_match", """WITH x AS (SELECT o_orderkey AS slot, chk FROM orders, (VALUES ('A'), ('N'), ('R')) c(chk)),
    o AS (SELECT l_orderkey AS slot, l_returnflag AS chk, max(CASE WHEN l_linestatus = 'F' THEN 4 WHEN l_quantity > 25 THEN 3 ELSE 2 END) AS s FROM lineitem GROUP BY ALL),
    n AS (SELECT DISTINCT l_orderkey AS slot, l_returnflag AS chk FROM lineitem WHERE l_discount >= 0.1)
    SELECT chk AS "check", CASE WHEN n.slot IS NOT NULL THEN 'NEGATIVE_EVIDENCE_FOUND' WHEN s IS NULL THEN 'UNVERIFIED' WHEN s = 4 THEN 'SATISFIED' WHEN s = 3 THEN 'PARTIALLY_SATISFIED' ELSE 'WEAKLY_RELATED' END AS status, count(*) AS n FROM x LEFT JOIN o USING (slot, chk) LEFT JOIN n USING (slot, chk) GROUP BY ALL""")
def f40(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("slot"), F.col("l_returnflag").alias("check"), "l_linestatus", "l_quantity", "l_discount")
    expected = table(spark, d, "orders").select(F.col("o_orderkey").alias("slot"), F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R"))).alias("check"))
    strength = F.when(F.col("l_linestatus") == "F", "STRONG").when(F.col("l_quantity") > 25, "PARTIAL").otherwise("WEAK")
    observed = li.select("slot", "check", strength.alias("strength"), F.lit(True).alias("before_sink"))
    out = rules.match_checks(expected, observed, li.where("l_discount >= 0.1").select("slot", "check"))
    return out.groupBy("check", "status").agg(F.count("*").alias("n"))


@query("f41_strength", "SELECT l_returnflag, max(CASE l_returnflag WHEN 'A' THEN 4 WHEN 'N' THEN 3 ELSE 2 END) AS rank FROM lineitem GROUP BY 1")
def f41(spark, d):
    s = lookup("l_returnflag", {"A": "STRONG", "N": "PARTIAL", "R": "WEAK"})
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.max(rules.strength_rank(s)).alias("rank"))


@query("f43_confidence", "SELECT o_orderkey, round(0.9 * 0.15 + 0.85 * 0.2 + CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0.5 END * 0.15 + CASE WHEN o_totalprice > 250000 THEN 0.8 ELSE 0.95 END * 0.25 + CASE o_orderpriority WHEN '5-LOW' THEN 0.4 ELSE 1 END * 0.1 + 0.75 * 0.1 + 0.05, 3)::DOUBLE AS confidence FROM orders")
def f43(spark, d):
    when = lambda c, a, b: F.when(c, F.lit(a)).otherwise(F.lit(b))
    parts = {"handler": F.lit(0.9), "field": F.lit(0.85), "semantic": when(F.col("o_orderstatus") == "F", 1.0, 0.5), "flow": when(F.col("o_totalprice") > 250000, 0.8, 0.95), "sink": when(F.col("o_orderpriority") == "5-LOW", 0.4, 1.0), "checks": F.lit(0.75), "trace": F.lit(1.0)}
    return table(spark, d, "orders").select("o_orderkey", rules.package_confidence(**parts).alias("confidence"))


@query("a20_categories", f"SELECT category, count(*) AS n FROM (SELECT CASE lower({_CALL_CASE}) WHEN 'strcpy' THEN 2 WHEN 'memcpy' THEN 2 ELSE 0 END AS category FROM part) GROUP BY 1")
def a20(spark, d):
    c = calls(spark, d).select(lookup(F.lower("name"), CALL_CATEGORY, 0).alias("category"), F.lower("name").isin(*BOUNDED_SINKS).alias("b"))
    return c.groupBy("category").agg(F.count("*").alias("n"))


@query("p03_decisions", f"WITH {_EV}, o AS ({_SELECT}), c AS (SELECT o.slot, o.status, rk.callback, rk.rank FROM o JOIN rk USING (slot)) SELECT slot::VARCHAR AS action, status, CASE status WHEN 'RESOLVED' THEN 0 WHEN 'AMBIGUOUS' THEN 1 ELSE 2 END AS rank, callback::VARCHAR AS candidate FROM c WHERE c.rank = 1 OR status = 'AMBIGUOUS'")
def p03(spark, d):
    c = calculus.corroborate(evidence(spark, d))
    ids = c.groupBy("slot").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "callback"))), lambda x: x["callback"].cast("string")).alias("candidates"))
    res = calculus.select(c).join(ids, "slot").select(F.col("slot").cast("string").alias("action"), "status", "candidates")
    return shape.decisions(res)


@query("p04_bucket", f"WITH {_EV} SELECT CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' WHEN confidence >= 0.4 THEN 'low' ELSE 'very_low' END AS bucket, count(*) AS n FROM cf GROUP BY 1")
def p04(spark, d):
    conf = calculus.noisy_or(calculus.group_max(calculus.score(evidence(spark, d))))
    return conf.groupBy(shape.bucket("confidence").alias("bucket")).agg(F.count("*").alias("n"))


@query("p06_status_counts", f"WITH {_EV}, o AS ({_SELECT}) SELECT count(*) FILTER (status = 'RESOLVED') AS n_resolved, count(*) FILTER (status = 'AMBIGUOUS') AS n_ambiguous, count(*) FILTER (status = 'UNRESOLVED') AS n_unresolved FROM o")
def p06(spark, d):
    return shape.status_counts(calculus.select(calculus.corroborate(evidence(spark, d))))


@query("p07_report_rows", "SELECT o_orderpriority AS \"check\", count(*) AS n, bool_or(o_orderpriority IN ('1-URGENT', '2-HIGH')) AS is_missing FROM orders GROUP BY 1")
def p07(spark, d):
    missing = spark.createDataFrame([("1-URGENT", "none seen"), ("2-HIGH", "weak")], "check string, reason string")
    rows = shape.report_rows(table(spark, d, "orders").select(F.col("o_orderpriority").alias("check")), F.broadcast(missing))
    return rows.groupBy("check").agg(F.count("*").alias("n"), F.bool_or("is_missing").alias("is_missing"))


_CHOSEN = f"""WITH {_EV}, ch AS (SELECT slot, callback AS chosen FROM se WHERE rank = 1 AND confidence >= 0.5 AND (runner_up IS NULL OR confidence - runner_up >= 0.15))"""


@query("f22_handler_map", _CHOSEN + """ SELECT ev.slot, ev.callback, arg_max(kind, weight * 10 + krank) AS kind, max(weight) AS weight FROM ev JOIN ch ON ch.slot = ev.slot AND ch.chosen = ev.callback GROUP BY ALL""")
def f22(spark, d):
    ev = evidence(spark, d)
    return calculus.handler_map(ev, calculus.select(calculus.corroborate(ev)))


@query("f21_candidates", _CHOSEN + """ SELECT rk.slot, rk.callback, confidence, chosen IS NOT NULL AS chosen, s_name AS name, 'n' || s_nationkey AS file,
  row_number() OVER (PARTITION BY rk.slot ORDER BY chosen IS NOT NULL DESC, confidence DESC, s_name NULLS LAST, 'n' || s_nationkey NULLS LAST, rk.callback)::INTEGER AS place
FROM rk LEFT JOIN ch ON ch.slot = rk.slot AND ch.chosen = rk.callback LEFT JOIN supplier ON s_suppkey = rk.callback""")
def f21(spark, d):
    candidates = calculus.corroborate(evidence(spark, d))
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("callback"), F.col("s_name").alias("name"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("file"))
    return calculus.public_candidates(candidates, calculus.select(candidates), names)
