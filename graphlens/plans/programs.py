"""The evidence pipeline over small programs built by hand, each a document of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.functions.knowledge import KnowledgeBase
from graphlens.operators import evidence
from graphlens.plans.registry import query
from graphlens.sources import graphson
from graphlens.sources.builder import Builder


def firmware() -> Builder:
    """A string dispatches to a handler, whose field reaches a shell through a helper."""
    b = Builder()
    b.file("main.c")

    def download():
        cmd, url = b.ident("cmd"), b.ident("url")
        b.built = cmd
        b.edge("REACHING_DEF", url, cmd)
        return b.call("sprintf", cmd, b.lit('"wget %s"'), url)

    def shell():
        cmd = b.ident("cmd")
        b.edge("REACHING_DEF", b.built, cmd)
        return b.call("system", cmd)

    b.define("download_firmware", "url", download, shell)

    def bind():
        b.url = b.ident("firmware_url")
        return b.assign(b.url, b.field(b.ident("req"), "location"))

    def check():
        u = b.ident("firmware_url")
        b.edge("REACHING_DEF", b.url, u)
        return b.control("IF", b.op("equals", u, b.ident("NULL")), b.node("RETURN", CODE="return;"))

    def go():
        u = b.ident("firmware_url")
        b.edge("REACHING_DEF", b.url, u)
        return b.call("download_firmware", u)

    b.define("handle_update_firmware", "req", bind, check, go)
    b.define("dispatch", "action req", lambda: b.control("IF", b.op("equals", b.call("strcmp", b.ident("action"), b.lit('"UpdateFirmware"')), b.lit("0")), b.call("handle_update_firmware", b.ident("req"))))
    return b


def checked_profile() -> Builder:
    """A length is checked, in a way that dominates the copy."""
    b = Builder()
    b.file("main.c")

    def bound():
        b.test = b.op("greaterEqualsThan", b.ident("schedule_length"), b.lit("256"))
        b.guard = b.control("IF", b.test, b.node("RETURN", CODE="return -1;"))
        return b.guard

    def copy():
        c = b.call("memcpy", b.ident("g_profile_buffer"), b.ident("schedule"), b.ident("schedule_length"))
        b.edge("DOMINATE", b.test, c)
        return c

    b.define("store_charging_profile", "schedule schedule_length", lambda: b.control("IF", b.op("equals", b.ident("schedule"), b.ident("NULL")), b.node("RETURN", CODE="return -1;")), bound, copy)
    made = {}

    def take(name):
        def run():
            made[name] = b.ident(name)
            return b.assign(made[name], b.field(b.field(b.ident("request"), "charging_schedule"), name))

        return run

    def store():
        args = []
        for name in ("schedule", "schedule_length"):
            args.append(b.ident(name))
            b.edge("REACHING_DEF", made[name], args[-1])
        return b.call("store_charging_profile", *args)

    b.define("handle_set_charging_profile", "request", take("schedule"), take("schedule_length"), store)
    return b


def two_registrations() -> Builder:
    """Two callbacks are registered under one number."""
    b = Builder()
    b.file("main.c")
    b.define("process_a", "x")
    b.define("process_b", "x")
    b.define("init", "", lambda: b.assign(b.ident("table"), b.array(b.array(b.lit("41"), b.ref("process_a")), b.array(b.lit("41"), b.ref("process_b")))))
    return b


def designated() -> Builder:
    b = Builder()
    b.file("main.c")
    b.define("on_start", "x")
    item = lambda: b.array(b.block(b.assign(b.ident("handler"), b.ref("on_start"))), b.block(b.assign(b.ident("action"), b.ident("ACTION_REMOTE_START"))))
    b.define("init", "", lambda: b.assign(b.ident("table"), b.array(item())))
    return b


def registrar(search: bool = False) -> Builder:
    """A call registers a callback under an id; the callee stores both in one slot, or looks for the slot."""
    b = Builder()
    b.file("main.c")
    b.define("on_scp", "x")
    slot = lambda f: b.field(b.index(b.ident("table"), b.ident("n")), f)
    if search:
        b.define("register_handler", "id cb", lambda: b.control("FOR", b.op("lessThan", b.ident("i"), b.lit("9")), b.control("IF", b.op("equals", slot("action"), b.ident("id")), b.assign(slot("fn"), b.ident("cb")))))
    else:
        b.define("store", "key fn", lambda: b.assign(slot("action"), b.ident("key")), lambda: b.assign(slot("fn"), b.ident("fn")))
        b.define("register_handler", "id cb", lambda: b.call("store", b.ident("id"), b.ident("cb")))
    b.define("init", "", lambda: b.call("register_handler", b.ident("MSG_SET_PROFILE"), b.ref("on_scp")))
    return b


def switch_case() -> Builder:
    """A case label leads to a handler; the next label is another one's."""
    b = Builder()
    b.file("main.c")
    b.define("handle_data_transfer", "p")
    b.define("other", "p")
    b.define("dispatch", "id p", lambda: b.control("SWITCH", b.ident("id"), b.case("ACTION_DATA_TRANSFER", b.call("handle_data_transfer", b.ident("p"))), b.case("ACTION_OTHER", b.call("other", b.ident("p")))))
    return b


PROGRAMS = {"firmware": firmware, "checked_profile": checked_profile, "two_registrations": two_registrations, "designated": designated, "registrar": registrar, "registrar_search": lambda: registrar(True), "switch_case": switch_case}


def documents(spark: SparkSession) -> DataFrame:
    rows = [(name, make().json(wrap=i % 2 == 0)) for i, (name, make) in enumerate(PROGRAMS.items())]
    return spark.createDataFrame(rows, "doc string, json string").select("doc", F.try_parse_json("json").alias("v"))


def run(spark: SparkSession, *names: str, **options) -> evidence.Result:
    nodes, edges = graphson.load(documents(spark).where(F.col("doc").isin(*names)) if names else documents(spark))
    return evidence.analyze(nodes, edges, KnowledgeBase(spark), **options)


@query("s01_graphson", "SELECT * FROM (VALUES ('firmware', 39::BIGINT, 3::BIGINT, 73::BIGINT), ('checked_profile', 41, 2, 83), ('two_registrations', 18, 3, 23), ('designated', 18, 2, 25), ('registrar', 34, 4, 59), ('registrar_search', 34, 3, 55), ('switch_case', 22, 3, 32)) t(doc, n_nodes, n_methods, n_edges)")
def s01(spark, d):
    nodes, edges = graphson.load(documents(spark))
    n = nodes.groupBy("doc").agg(F.count("*").alias("n_nodes"), F.count_if(F.col("label") == "METHOD").alias("n_methods"))
    return n.join(edges.groupBy("doc").agg(F.count("*").alias("n_edges")), "doc")


@query("s05_validate", "SELECT 'x' AS doc, 'not JSON' AS problem UNION ALL SELECT 'y', 'no graph'")
def s05(spark, d):
    bad = spark.createDataFrame([("x", "{"), ("y", '{"a": 1}')], "doc string, json string").select("doc", F.try_parse_json("json").alias("v"))
    return graphson.validate(documents(spark).unionByName(bad))


@query("f20_resolution", "SELECT * FROM (VALUES ('checked_profile', 'SetChargingProfile', 'RESOLVED', NULL, 0.595::DOUBLE), ('designated', 'RemoteStartTransaction', 'RESOLVED', NULL, 0.8), ('firmware', 'UpdateFirmware', 'RESOLVED', NULL, 0.9595), ('registrar', 'SetChargingProfile', 'RESOLVED', NULL, 0.7), ('registrar_search', 'SetChargingProfile', 'UNRESOLVED', 'REGISTRAR_SEARCH_THEN_WRITE', NULL), ('switch_case', 'DataTransfer', 'RESOLVED', NULL, 0.7225), ('two_registrations', 'SetChargingProfile', 'AMBIGUOUS', NULL, 0.8)) t(doc, action, status, reason, top)")
def f20(spark, d):
    g = run(spark).resolutions
    return g.where("status <> 'UNRESOLVED' OR reason <> 'NO_EVIDENCE'").select("doc", "action", "status", "reason", "top")


@query("f01_evidence", "SELECT * FROM (VALUES ('checked_profile', 'csChargingProfiles.chargingSchedule', 'memcpy', 'MEMORY_UNSAFE_OPERATION', 'schedule', 'SCP_CHARGING_SCHEDULE_NOT_NULL,SCP_PROFILE_LENGTH_BOUND'), ('checked_profile', 'csChargingProfiles.chargingSchedule.length', 'memcpy', 'MEMORY_UNSAFE_OPERATION', 'schedule_length', ''), ('firmware', 'location', 'system', 'COMMAND_EXECUTION', 'firmware_url', 'HOST_ALLOWLIST,SAFE_DOWNLOAD_API_NO_SHELL,SIGNATURE_VERIFICATION,URL_SCHEME_VALIDATION')) t(doc, field, api, domain, variable, missing)")
def f01(spark, d):
    return run(spark, "firmware", "checked_profile").packages.select("doc", "field", "api", "domain", "variable", F.array_join("missing", ",").alias("missing"))


def guarded_copy() -> Builder:
    """A function with a loop, a guard with both branches, a subscript and a copy."""
    b = Builder()
    b.file("main.c")

    def local(name, type_):
        return lambda: b.node("LOCAL", NAME=name, CODE=f"{type_} {name}", TYPE_FULL_NAME=type_)

    def loop():
        test = b.op("lessThan", b.ident("i"), b.lit("10"))
        start, step = b.assign(b.ident("i"), b.lit("0")), b.op("postIncrement", b.ident("i"))
        body = b.block(b.assign(b.index(b.ident("buf"), b.ident("i")), b.ident("n")))
        c = b.node("CONTROL_STRUCTURE", CONTROL_STRUCTURE_TYPE="FOR", CODE="for (...)")
        for x in (start, test, step, body):
            b.edge("AST", c, x)
        return c

    def branch():
        c = b.node("CONTROL_STRUCTURE", CONTROL_STRUCTURE_TYPE="IF", CODE="if (n < 8)")
        other = b.node("CONTROL_STRUCTURE", CONTROL_STRUCTURE_TYPE="ELSE", CODE="else")
        b.edge("AST", other, b.block(b.assign(b.ident("n"), b.lit("1"))))
        for x in (b.op("lessThan", b.ident("n"), b.lit("8")), b.block(b.call("memcpy", b.ident("buf"), b.ident("src"), b.ident("n"))), other):
            b.edge("AST", c, x)
        return c

    b.define("copy_bad", "src n", local("buf", "char[16]"), local("i", "int"), loop, branch, lambda: b.call("finish", b.ident("buf")))
    return b


def guarded(spark: SparkSession):
    from graphlens.operators import cstatements, template

    doc = spark.createDataFrame([("guarded", guarded_copy().json())], "doc string, json string").select("doc", F.try_parse_json("json").alias("v"))
    nodes, edges = graphson.load(doc)
    tree = template.convert(nodes, edges)
    return tree, cstatements.Functions(tree, template.functions(tree))


@query("t01_template", "SELECT * FROM (VALUES ('AssignmentExpression', 3::BIGINT), ('ArrayDeclaration', 1), ('ArraySubscriptExpression', 1), ('BinaryExpression', 2), ('CompoundStatement', 4), ('ForStatement', 1), ('FunctionDefinition', 1), ('Identifier', 12), ('IfStatement', 1), ('Literal', 4), ('ParameterDeclaration', 2), ('ParameterList', 3), ('StandardLibCall', 1), ('UnaryExpression', 1), ('UserDefinedCall', 1), ('VariableDeclaration', 1)) t(node_type, n)")
def t01(spark, d):
    return guarded(spark)[0].groupBy("node_type").agg(F.count("*").alias("n"))


@query("a03_statements", "SELECT * FROM (VALUES (0, 'FunctionEntry', NULL), (1, 'ParameterDeclaration', 0), (2, 'ParameterDeclaration', 0), (3, 'ArrayDeclaration', 0), (4, 'VariableDeclaration', 0), (5, 'ForStatement', 0), (6, 'AssignmentExpression', 5), (7, 'IfStatement', 0), (8, 'StandardLibCall', 7), (9, 'AssignmentExpression', 7), (10, 'UserDefinedCall', 0)) t(sid, node_type, parent_sid)")
def a03(spark, d):
    return guarded(spark)[1].statements.select("sid", "node_type", "parent_sid")


@query("a05_statement_edges", "SELECT * FROM (VALUES ('guard', 5, 6, 2), ('guard', 7, 8, 0), ('guard', 7, 9, 1), ('order', 1, 2, NULL), ('order', 3, 4, NULL), ('order', 4, 5, NULL), ('order', 5, 7, NULL), ('order', 7, 10, NULL)) t(kind, src, dst, branch)")
def a05(spark, d):
    f = guarded(spark)[1]
    order = f.order_edges().select(F.lit("order").alias("kind"), "src", "dst", F.lit(None).cast("int").alias("branch"))
    return order.unionByName(f.guard_edges().select(F.lit("guard").alias("kind"), "src", "dst", F.col("branch").cast("int")))


@query("d01_program", "SELECT * FROM (VALUES (0, 6, 'n', 'value'), (0, 8, 'n', 'size'), (0, 8, 'src', 'value'), (3, 6, 'buf', 'base'), (5, 6, 'i', 'index'), (6, 8, 'buf', 'base'), (8, 10, 'buf', 'value')) t(src, dst, var, flow)")
def d01(spark, d):
    return guarded(spark)[1].def_use.select("src", "dst", "var", "flow")


@query("d26_records", "SELECT 'copy_bad' AS function_name, 1 AS label, 11 AS n_nodes, 7 AS n_flow, 10 AS n_parent, 5 AS n_order, 3 AS n_guard, 11 AS n_flow_nodes, 3 AS strength, 0.1::DOUBLE AS norm")
def d26(spark, d):
    from graphlens.operators import cstatements

    out = cstatements.validated_records(cstatements.training_records(guarded(spark)[1], with_label=True))
    sizes = {"n_nodes": "nodes", "n_flow": "edges_dfg", "n_parent": "edges_ast_pc", "n_order": "edges_ast_sb", "n_guard": "edges_ast_guard", "n_flow_nodes": "dfg_nodes"}
    inner = F.filter("nodes", lambda n: n["sid"] == 6)[0]["feat"]
    return out.select("function_name", "label", *[F.size(c).alias(n) for n, c in sizes.items()], inner["ctx_guard_strength"].alias("strength"), inner["ctx_upper_bound_norm"].alias("norm"))


@query("a21_call_flags", "SELECT * FROM (VALUES (0::BIGINT, 1, 0, 0, 0, 3, 1, 0, 0, 0), (1, 0, 0, 0, 0, 4, 1, 0, 0, 0), (2, 0, 0, 1, 1, 3, 0, 1, 1, 0), (3, 0, 0, 0, 1, 3, 1, 0, 0, 0), (4, 0, 1, 0, 0, 0, 0, 0, 0, 0), (5, 0, 0, 0, 0, 1, 0, 0, 0, 0), (6, 0, 0, 0, 0, 0, 0, 0, 0, 0)) t(call, varargs, unbounded, non_dst, field, kind, linked, base, mismatch, alloc)")
def a21(spark, d):
    from graphlens.operators import callflags

    rows = [(0, "snprintf", ["buf", "sizeof(buf)", '"%s"']), (1, "memcpy", ["buf", "src", "sizeof(*buf) * 2"]), (2, "memset", ["s.name", "0", "sizeof(s)"]), (3, "memcpy", ["p->name", "q", "sizeof(p->name)"]), (4, "gets", ["buf"]), (5, "read", ["fd", "buf", "16"]), (6, "malloc", ["n"])]
    calls = spark.createDataFrame([(i, n) for i, n, _ in rows], "call long, name string")
    args = spark.createDataFrame([(i, k, c) for i, _, a in rows for k, c in enumerate(a)], "call long, pos int, code string")
    f = callflags.flags(calls, args)
    return f.select("call", F.col("has_varargs").alias("varargs"), F.col("danger_unbounded").alias("unbounded"), F.col("sizeof_non_dst").alias("non_dst"), F.col("dst_is_field").alias("field"), F.col("size_kind").alias("kind"), F.col("len_linked_to_dst").alias("linked"), F.col("size_is_base_struct").alias("base"), F.col("size_mismatch_field").alias("mismatch"), (F.col("alloc_sizeof_state") == 2).cast("int").alias("alloc"))


@query("a17_calls_in_tree", "SELECT 'first' AS what, 'memcpy' AS name, 1::BIGINT AS n UNION ALL SELECT 'args', 'memcpy', 3 UNION ALL SELECT 'args', 'finish', 1 UNION ALL SELECT 'inside', 'memcpy', 5 UNION ALL SELECT 'inside', 'finish', 3 UNION ALL SELECT 'conditions', NULL, 2")
def a17(spark, d):
    from graphlens.operators import callflags

    tree = guarded(spark)[0]
    name = tree.select(F.col("id").alias("call"), "name")
    say = lambda what, df: df.join(name, "call").groupBy("name").agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "name", "n")
    first = say("first", callflags.first_calls(tree, tree.where("node_type = 'IfStatement'")))
    inside = say("inside", callflags.nearest_call(tree).where(F.col("call").isNotNull()))
    conds = callflags.condition_of(tree).agg(F.count("*").alias("n")).select(F.lit("conditions").alias("what"), F.lit(None).cast("string").alias("name"), "n")
    return first.unionByName(say("args", callflags.call_arguments(tree).select("call"))).unionByName(inside).unionByName(conds)


@query("e08_evaluation", "SELECT * FROM (VALUES ('total', NULL, 28::BIGINT), ('status', 'RESOLVED', 5), ('status', 'AMBIGUOUS', 1), ('status', 'UNRESOLVED', 22), ('tier', 'UNKNOWN', 21), ('tier', 'POLICY', 1), ('tier', 'POTENTIALLY_SUPPORTABLE', 1), ('tier', NULL, 5)) t(name, value, n)")
def e08(spark, d):
    from graphlens import jobs

    nodes, edges = graphson.load(documents(spark))
    return jobs.evaluation(nodes, edges, KnowledgeBase(spark))["histograms"].where("name <> 'reason'")
