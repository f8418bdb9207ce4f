"""Searches over chains longer than any bound they had."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from graphlens.operators import graph, mlprep, statements, views
from graphlens.plans import QUERIES
from graphlens.sources import graphson


def test_taint_reaches_the_end_of_a_long_chain(spark, tmp_path):
    start, n = datetime(2024, 1, 1), 12
    rows = [(i, i + 1, start + timedelta(minutes=i), "purchase") for i in range(n)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    assert {r["node"]: r["depth"] for r in QUERIES["f28_taint"](spark, str(tmp_path)).collect()} == {i + 1: i for i in range(n)}
    assert {r["target"]: r["n_steps"] for r in QUERIES["f30_path"](spark, str(tmp_path)).collect()} == {i + 1: i + 1 for i in range(n)}


def chain(spark, n, label="AST"):
    nodes = spark.createDataFrame([(f"n{i:04}", "METHOD" if i in (0, n) else "BLOCK", i) for i in range(n + 1)], "id string, label string, ord long")
    return nodes, spark.createDataFrame([(f"n{i:04}", f"n{i + 1:04}", label, i) for i in range(n)], "src string, dst string, label string, ord long")


def test_forest_of_a_long_chain(spark):
    _, edges = chain(spark, 500)
    rows = sorted((r["depth"], r["node"], len(r["path"])) for r in graph.forest(edges, "AST").collect())
    assert rows == [(i, f"n{i:04}", i) for i in range(501)]


def test_forest_leaves_circles_out(spark):
    edges = spark.createDataFrame([("a", "b", "T", 0), ("b", "c", "T", 1), ("x", "y", "T", 2), ("y", "x", "T", 3), ("y", "z", "T", 4), ("a", "d", "T", 5)], "src string, dst string, label string, ord long")
    got = {r["node"]: (r["root"], r["path"]) for r in graph.forest(edges, "T").collect()}
    assert got == {"a": ("a", []), "b": ("a", [1]), "c": ("a", [1, 1]), "d": ("a", [2])}


def test_searches_run_past_their_old_bounds(spark):
    nodes, edges = chain(spark, 66)
    start = spark.createDataFrame([("n0000", "g", "x", 1, 0, 0.0)], "start string, kind string, var string, lower int, upper int, norm double")
    assert statements.guard_map(edges.select("src", "dst"), start).count() == 67
    kept, links = views.contract(nodes, edges, F.col("label") == "METHOD")
    assert kept.count() == 2 and [tuple(r) for r in links.collect()] == [("n0000", "n0066")]


def test_json_of_any_depth(spark):
    deep = "1"
    for i in range(12):
        deep = f'{{"k{i}": {deep}}}' if i % 2 else f"[0, {deep}]"
    rows = spark.createDataFrame([(1, deep), (2, "7"), (3, None), (4, '{"a": [], "b": {}, "c": null, "d": "x", "e": true}')], "id long, j string")
    got = {(r["id"], r["name"]): r["value"] for r in mlprep.flatten_json(rows, "id", "j").collect()}
    assert got[1, "k11.1.k9.1.k7.1.k5.1.k3.1.k1.1"] == 1.0 and got[4, "e"] == 1.0 and len(got) == 8


def test_graphs_in_lists_of_any_length_and_depth(spark):
    graph_of = lambda i: {"vertices": [{"id": i, "label": "FILE", "properties": {"NAME": {"@value": {"@value": [f"f{i}"]}}}}], "edges": []}
    doc = {"@value": {"@value": {"export": {"@value": {"@value": [[graph_of(i)] for i in range(1500)]}}}}}
    nodes, _ = graphson.load(spark.createDataFrame([("d", json.dumps(doc))], "doc string, j string").select("doc", F.try_parse_json("j").alias("v")))
    got = nodes.orderBy("ord").collect()
    assert [r["node_id"] for r in got] == list(range(1500)) and len({r["ord"] for r in got}) == 1500 and got[7]["name"] == "f7"
    too_deep = {"vertices": [{"id": {"@value": {"@value": {"@value": {"@value": {"@value": {"@value": {"@value": 1}}}}}}}, "label": "FILE"}], "edges": []}
    with pytest.raises(Exception, match="levels of @value"):
        graphson.load(spark.createDataFrame([("d", json.dumps(too_deep))], "doc string, j string").select("doc", F.try_parse_json("j").alias("v")))[0].collect()
