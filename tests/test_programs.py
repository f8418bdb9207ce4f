"""Statement graphs of programs built by hand."""

from pyspark.sql import functions as F

from graphlens.operators import cstatements, mlprep, template, views
from graphlens.sources import graphson
from graphlens.sources.builder import Builder


def functions_of(spark, b):
    doc = spark.createDataFrame([("d", b.json())], "doc string, json string").select("doc", F.try_parse_json("json").alias("v"))
    tree = template.convert(*graphson.load(doc))
    return tree, cstatements.Functions(tree, template.functions(tree))


def test_switch_statements_follow_their_labels(spark):
    b = Builder()

    def switch():
        c = b.node("CONTROL_STRUCTURE", CONTROL_STRUCTURE_TYPE="SWITCH", CODE="switch (x)")
        label = lambda code, name="case": b.node("JUMP_TARGET", NAME=name, CODE=code)
        body = b.block(label("case 7:"), b.call("one"), b.call("two"), label("case NAMED:"), b.call("three"), label("default:", "default"), b.call("four"))
        b.edge("AST", c, b.ident("x"))
        b.edge("AST", c, body)
        return c

    b.define("f", "x", switch, lambda: b.call("after"))
    tree, fns = functions_of(spark, b)
    label_of = {r["name"]: r["label"] for r in tree.where("node_type = 'UserDefinedCall'").join(tree.select(F.col("id").alias("parent"), F.col("code").alias("label")), "parent", "left").collect()}
    assert (label_of["one"], label_of["two"], label_of["three"], label_of["four"]) == ("case 7:", "case 7:", "case NAMED:", "default:")
    sid = {r["name"]: r["sid"] for r in fns.statements.where("rank = 2").collect()}
    guards = {(r["dst"], r["branch"], r["kind"]) for r in fns.guard_edges().collect()}
    assert guards == {(sid["one"], 7, 4), (sid["three"], 0, 4), (sid["four"], -1, 4)}
    order = {(r["src"], r["dst"]) for r in fns.order_edges().collect()}
    switch_sid = next(r["sid"] for r in fns.statements.where("node_type = 'SwitchStatement'").collect())
    assert (sid["one"], sid["two"]) in order and (switch_sid, sid["after"]) in order and (sid["two"], sid["three"]) not in order


def test_pointer_identifiers_are_wrapped(spark):
    b = Builder()

    def use():
        p = b.ident("p")
        b.vertices[p - 1]["properties"]["TYPE_FULL_NAME"] = "char*"
        return b.assign(p, b.ident("NULL"))

    b.define("f", "", use)
    tree, _ = functions_of(spark, b)
    rows = {(r["node_type"], r["name"], r["value"]) for r in tree.collect()}
    assert ("PointerDereference", None, None) in rows and ("Identifier", "p", None) in rows and ("Literal", "NULL", "NULL") in rows
    assert ("ParameterDeclaration", "<empty>", None) in rows


def test_records_hold_guards_flags_splits_and_lifts(spark):
    """p = malloc(n); for (i = 0; i < 10; i++) buf[i] = n; if (n < 8 && recv(s, buf, 4)) strcpy(buf, q);"""
    b = Builder()

    def loop():
        c = b.node("CONTROL_STRUCTURE", CONTROL_STRUCTURE_TYPE="FOR", CODE="for (...)")
        start, test, step = b.assign(b.ident("i"), b.lit("0")), b.op("lessThan", b.ident("i"), b.lit("10")), b.op("postIncrement", b.ident("i"))
        for x in (start, test, step, b.block(b.assign(b.index(b.ident("buf"), b.ident("i")), b.ident("n")))):
            b.edge("AST", c, x)
        return c

    def branch():
        c = b.node("CONTROL_STRUCTURE", CONTROL_STRUCTURE_TYPE="IF", CODE="if (...)")
        test = b.op("logicalAnd", b.op("lessThan", b.ident("n"), b.lit("8")), b.call("recv", b.ident("s"), b.ident("buf"), b.lit("4")))
        for x in (test, b.block(b.call("strcpy", b.ident("buf"), b.ident("q")))):
            b.edge("AST", c, x)
        return c

    local = lambda: b.node("LOCAL", NAME="buf", CODE="char[16] buf", TYPE_FULL_NAME="char[16]")
    b.define("f_bad", "n", local, lambda: b.assign(b.ident("p"), b.call("malloc", b.ident("n"))), loop, branch)
    _, fns = functions_of(spark, b)
    r = cstatements.validated_records(cstatements.training_records(fns, with_label=True)).collect()[0]
    kinds = "FunctionEntry ParameterDeclaration ArrayDeclaration StandardLibCall AssignmentExpression ForStatement AssignmentExpression StandardLibCall IfStatement StandardLibCall".split()
    assert [n["node_type"] for n in r["nodes"]] == kinds and (r["function_name"], r["label"]) == ("f_bad", 1)
    feat = [n["feat"] for n in r["nodes"]]
    assert len(feat[0]) == 20 and all(len(n["feat"]) == 13 for n in r["dfg_nodes"])
    assert [(f["ctx_guard_strength"], f["ctx_upper_bound_norm"]) for f in feat] == [(0, 0.0)] * 6 + [(3, 0.1), (0, 0.0), (0, 0.0), (2, 0.125)]
    assert [f["in_loop"] for f in feat] == [0] * 6 + [1, 0, 0, 0] and feat[3]["alloc_sizeof_state"] == 1 and feat[9]["call_flag_danger_unbounded"] == 1
    assert {(e["src"], e["dst"]) for e in r["edges_ast_sb"]} == {(2, 3), (3, 4), (4, 5), (5, 7), (7, 8)}
    assert {(e["src"], e["dst"], e["guard_kind"]) for e in r["edges_ast_guard"]} == {(5, 6, 2), (8, 9, 1)}
    flow = {(e["src"], e["dst"], e["var"], e["flow_id"]): (e["guard_kind"], e["has_lower_guard"], e["has_upper_guard"], e["upper_guard_norm"]) for e in r["edges_dfg"]}
    loop_guard, none = (2, 1, 1, 0.1), (0, 0, 0, 0.0)
    assert flow == {(0, 3, "n", 1): none, (3, 4, "$ret@3", 1): none, (2, 6, "buf", 4): loop_guard, (5, 6, "i", 2): loop_guard, (0, 6, "n", 1): loop_guard, (6, 7, "buf", 4): none, (7, 9, "buf", 4): none}
    sinks = {n["sid"]: n["feat"] for n in r["dfg_nodes"]}
    assert (sinks[6]["is_buffer_access"], sinks[6]["is_sink_assign"]) == (1, 1) and sinks[9]["call_danger_unbounded"] == 1 and sinks[7]["is_sink_call_bounded"] == 1
    nodes, edges = views.statement_view(fns.statements, fns.parent_edges(), fns.order_edges(), fns.guard_edges())
    assert nodes.count() == 10 and {e["label"] for e in edges.collect()} == {"parent", "next", "guard 0", "guard 2"}
    shown, links = views.flow_view(fns.statements, fns.def_use)
    assert shown.count() == 8 and "$ret@3" in {e["label"] for e in links.collect()}
    s = mlprep.samples(cstatements.training_records(fns), "fn", "nodes", "edges_dfg", ["sid"], F.lit(1)).collect()[0]
    assert s["n_nodes"] == 10 and sorted(zip(s["src"], s["dst"], strict=True)) == sorted((a, d) for a, d, _, _ in flow) and s["x"][4] == [4.0]
