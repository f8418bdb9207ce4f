"""Operators on small hand-made inputs."""

import pytest
from pyspark.sql import functions as F

from graphlens.functions import text
from graphlens.operators import calculus, graph, shape, statements, traverse, views


def edges(spark, *rows):
    return spark.createDataFrame([(a, b, x, i) for i, (a, b, x) in enumerate(rows)], "src string, dst string, label string, ord long")


def nodes(spark, *rows):
    return spark.createDataFrame([(n, x, n, i) for i, (n, x) in enumerate(rows)], "id string, label string, name string, ord long")


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_closure_is_cycle_safe(spark):
    e = edges(spark, ("a", "b", "X"), ("b", "c", "X"), ("c", "a", "X"))
    assert pairs(graph.closure(e, nodes(spark, ("a", "N")))) == {("a", "a", 0), ("a", "b", 1), ("a", "c", 2)}


def test_last_and_first_parent(spark):
    e = edges(spark, ("p", "x", "AST"), ("q", "x", "AST"))
    assert pairs(graph.parents(e, "AST")) == {("x", "q")}
    assert pairs(graph.parents(e, "AST", last=False)) == {("x", "p")}


def test_owner_of_deep_chain(spark):
    chain = [(f"n{i}", f"n{i + 1}", "AST") for i in range(20)]
    ns = nodes(spark, ("n0", "METHOD"), *[(f"n{i}", "BLOCK") for i in range(1, 21)], ("lone", "BLOCK"))
    got = dict(pairs(graph.owner(ns, graph.parents(edges(spark, *chain), "AST"), F.col("label") == "METHOD")))
    assert got["n20"] == "n0" and got["n0"] == "n0" and got["lone"] is None


def test_forest_paths_are_preorder(spark):
    e = edges(spark, ("r", "a", "AST"), ("r", "b", "AST"), ("a", "c", "AST"))
    rows = sorted((tuple(r["path"]), r["node"]) for r in graph.forest(e, "AST").collect())
    assert [n for _, n in rows] == ["r", "a", "c", "b"]
    text_ = graph.tree_text(graph.forest(e, "AST"), F.col("node")).first()["text"]
    assert text_ == "r\n├── a\n│   └── c\n└── b"


def test_require_unique_raises(spark):
    with pytest.raises(Exception, match="duplicate id"):
        graph.require_unique(nodes(spark, ("a", "N"), ("a", "N")), "id").collect()


def test_contract_links_through_dropped(spark):
    ns = nodes(spark, ("a", "K"), ("x", "D"), ("y", "D"), ("b", "K"))
    _, out = views.contract(ns, edges(spark, ("a", "x", "E"), ("x", "y", "E"), ("y", "x", "E"), ("y", "b", "E")), F.col("label") == "K")
    assert pairs(out) == {("a", "b")}


def test_bfs_parents_follow_discovery_order(spark):
    e = edges(spark, ("s", "b", "E"), ("s", "a", "E"), ("a", "t", "E"), ("b", "t", "E"))
    seen = {r["node"]: (r["depth"], r["parent"]) for r in traverse.bfs(e, nodes(spark, ("s", "N")), 5).collect()}
    assert seen["t"] == (2, "b")  # b was found first
    way = traverse.paths(traverse.bfs(e, nodes(spark, ("s", "N")), 5), spark.createDataFrame([("t",)], "id string"), 5)
    assert sorted((r["pos"], r["node"]) for r in way.collect()) == [(0, "s"), (1, "b"), (2, "t")]


def test_bfs_does_not_leave_stops(spark):
    e = edges(spark, ("s", "a", "E"), ("a", "b", "E"))
    seen = traverse.bfs(e, nodes(spark, ("s", "N")), 5, stop=spark.createDataFrame([("a",)], "id string"))
    assert {r["node"] for r in seen.collect()} == {"s", "a"}


def evidence(spark, *rows):
    return spark.createDataFrame([("s", c, k, float(w), m, g, None, [i], "x", bad) for i, (c, k, w, m, g, bad) in enumerate(rows)], "slot string, callback long, kind string, weight double, match string, group string, site long, nodes array<int>, extractor string, conflicting boolean")


E, H = "EXACT_IDENTIFIER", "HEURISTIC_SUBSTRING"


@pytest.mark.parametrize(
    ("rows", "confidence", "status"),
    [
        ([(1, "ENUM_CASE", 0.85, E, "a", False), (1, "REGISTRATION_INIT", 0.80, E, "b", False)], 0.97, "RESOLVED"),
        ([(1, "ENUM_CASE", 0.80, E, "a", False), (1, "REGISTRATION_INIT", 0.85, E, "a", False)], 0.85, "RESOLVED"),
        ([(1, "NAME_MATCH", 0.70, H, g, False) for g in "abcd"], 0.85, "RESOLVED"),
        ([(1, "REGISTRATION_INIT", 0.80, E, "a", True)], 0.28, "UNRESOLVED"),
        ([(1, "NAME_MATCH", 0.65, H, "a", False)], 0.455, "UNRESOLVED"),
        ([(1, "REGISTRATION_INIT", 0.80, E, "a", False), (2, "REGISTRATION_INIT", 0.80, E, "b", False)], 0.80, "AMBIGUOUS"),
    ],
)
def test_calculus_vectors(spark, rows, confidence, status):
    out = calculus.select(calculus.corroborate(evidence(spark, *rows))).first()
    assert (out["top"], out["status"]) == (confidence, status)


def test_cascade_takes_the_best(spark):
    rows = [(1, "ENUM_CASE", 0.85, E, "a", False), (1, "NAME_MATCH", 0.70, H, "b", False)]
    assert calculus.cascade(evidence(spark, *rows)).first()["confidence"] == 0.85


def test_guards_of_comparisons(spark):
    rows = [("c", ">=", "i", "0"), ("c", "<", "i", "10"), ("c", ">", "20", "j"), ("c", ">=", "k", "1"), ("c", "<", "n", "MAX")]
    got = {r["var"]: (r["lower"], r["upper"], r["norm"]) for r in statements.comparison_guards(spark.createDataFrame(rows, "cond string, op string, left string, right string")).collect()}
    assert got == {"i": (1, 1, 0.1), "j": (0, 1, 0.05), "n": (0, 1, 0.0)}


def test_text_functions(spark):
    df = spark.createDataFrame([("memcpy(buf, f(a, b), sizeof(struct x(y)) * 2)",)], "c string")
    row = df.select(text.split_arguments(F.lit("buf, f(a, b), n")).alias("a"), text.strip_sizeof("c").alias("s"), text.matching_paren(F.lit("f(a(b))c")).alias("m"), text.upper_snake(F.lit("SetChargingProfile")).alias("u"), text.case_int(F.lit("'\\n'")).alias("n"), text.case_int(F.lit("010")).alias("o")).first()
    assert row["a"] == ["buf", "f(a, b)", "n"] and row["s"] == "memcpy(buf, f(a, b),  * 2)" and row["m"] == 7
    assert (row["u"], row["n"], row["o"]) == ("SET_CHARGING_PROFILE", 10, 8)


def test_no_finding_row(spark):
    none = spark.createDataFrame([], "action string, status string, candidates array<string>")
    assert shape.decisions(none).first()["status"] == "NO_FINDING"
