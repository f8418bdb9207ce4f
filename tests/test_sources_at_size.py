"""GraphSON documents are read once, whatever is asked of them."""

import json

from pyspark.sql import functions as F

from graphlens.sources import graphson

GRAPH = {"vertices": [{"id": 1, "label": "FILE", "properties": {"NAME": {"@value": {"@value": ["f"]}}}}], "edges": [{"label": "AST", "outV": 1, "inV": 1}]}


def read(spark, docs):
    rows = spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v)) for k, v in docs.items()], "doc string, j string")
    return rows.select("doc", F.try_parse_json("j").alias("v"))


def wrapped(v, levels, key="@value"):
    return v if levels == 0 else {key: wrapped(v, levels - 1, key)}


def test_ways_to_a_graph(spark):
    """Lone wrappers of few and many levels, two ways in one document, lists, texts without a graph."""
    docs = {f"w{n}": wrapped(GRAPH, n) for n in range(8)}
    docs |= {"both": {"@value": {"export": GRAPH}, "export": {"@value": GRAPH}}, "list": [GRAPH, {"@value": [GRAPH]}], "empty": {"vertices": [], "edges": []}, "none": {"a": 1}, "scalar": "7", "null": "null", "inner": {"export": None, "@value": GRAPH}, "broken": "{"}
    got = {r["doc"]: (r["n_nodes"], r["n_edges"], r["error"]) for r in graphson.outcomes(read(spark, docs)).collect()}
    want = {f"w{n}": (1, 1, None) for n in range(8)} | {"both": (2, 2, None), "list": (2, 2, None), "empty": (0, 0, None), "inner": (1, 1, None), "broken": (0, 0, "not JSON")}
    assert got == want | {k: (0, 0, "no graph") for k in ("none", "scalar", "null")}
    nodes, _ = graphson.load(read(spark, docs))
    assert {(r["doc"], r["ord"], r["name"]) for r in nodes.collect()} == {(k, i << 32, "f") for k, v in want.items() for i in range(v[0])}


def test_documents_are_parsed_once(spark):
    """Each further pass over the documents parsed them and built their rows again."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        seen.add(1)
        return text

    docs = spark.createDataFrame([(str(i), json.dumps({"export": GRAPH})) for i in range(20)], "doc string, j string")
    graphson.outcomes(docs.select("doc", F.try_parse_json(told.asNondeterministic()("j")).alias("v"))).collect()
    assert seen.value == 20


def test_members_are_opened_in_their_rows(spark):
    """However deep values are wrapped, no job runs, and nothing is written, before the rows are asked for."""

    def under(levels, value, listed=False):
        for _ in range(levels):
            value = {"@type": "t", "@value": [value] if listed else value}
        return value

    vertices = [{"id": under(n, n), "label": under(n % 4, ["CALL"]), "properties": {"CODE": under(n, f"c{n}", n % 2), "NAME": under(2, f"n{n}")}} for n in range(30)]
    odd = [7, None, "x", [1], {"id": 30, "label": None, "properties": [1]}, {"id": {"@value": None}, "label": {"@value": {"@value": None}}, "properties": {"NAME": {"@value": None}}}, {"id": 31, "properties": {"CODE": [{"@value": under(8, "d")}], "NAME": [{"@value": "e"}, {"@value": "f"}], "LINE_NUMBER": {"@value": "4"}}}]
    rows = spark.createDataFrame([("d", i, json.dumps(v)) for i, v in enumerate(vertices + odd)], "doc string, ord long, j string").select("doc", "ord", F.try_parse_json("j").alias("v")).localCheckpoint()
    sc = spark.sparkContext
    sc.setJobGroup("opened", "members")
    try:
        members = graphson.opened(rows, graphson.NODE)
        assert len(sc.statusTracker().getJobIdsForGroup("opened")) == 0
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    got = [(r["node_id"], r["label"], r["code"], r["name"], r["line"]) for r in members.orderBy("ord").collect()]
    assert got[:30] == [(n, "CALL", f"c{n}", f"n{n}", None) for n in range(30)]
    none = (None,) * 5
    assert got[30:34] == [none] * 4 and got[34] == (30, None, None, None, None) and got[35] == none
    assert got[36][0] == 31 and got[36][2] == "d" and got[36][4] == 4
