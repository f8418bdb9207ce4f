"""Training records as samples, held against rows worked out by hand."""

import json

import pytest

from graphlens.operators import samples


def frame(spark, records, paths=None):
    rows = [(i, r if isinstance(r, str) or r is None else json.dumps(r), (paths or {}).get(i)) for i, r in enumerate(records)]
    return spark.createDataFrame(rows, "id long, json string, path string")


def graphs(df, column="graph"):
    return {r["id"]: r[column].asDict() if r[column] is not None else None for r in df.collect()}


EMPTY = {"x_names": [], "x": [[]], "src": [], "dst": [], "edge_names": ["edge_attr"], "edge_attr": []}


def test_sections_of_any_schema(spark):
    ast = {
        "nodes": [{"feat": {"a": 1, "deep": {"b": [2, True], "text": "no"}, "none": None}}, {"size": 3.5, "feat": 7}, "word", 4],
        "edges_b": [[0, 1], [1, 2, 9], [2, 0, {"feat": {"w": 5, "deep": {"v": 6}}}], [3, 1, {"w": 2}], [7]],
        "edges_a": {"src": 1, "dst": 3, "edge_type": "4", "guard_kind": True, "attr": {"edge_type": 8, "src": 5, "extra": 1.5}},
        "edges_c": "nothing", "other": [[0, 0]],
    }
    flow = {"nodes": [{"feat": {"z": 1}}, {}], "edges_dfg": [{"src": 0, "dst": 1, "attr": {}, "feat": {"k": 3}}, {"src": "1"}, 5], "edges_more": [[0, 0]]}
    out = samples.record_samples(frame(spark, [{"ast": ast, "dfg": flow, "function": "f", "file": "bad.c"}]), "id", "json")
    row = out.collect()[0]
    assert (row["label"], row["function_name"], row["file"]) == (1, "f", "bad.c")
    g = row["ast_graph"]
    assert g["x_names"] == ["", "a", "deep.b.0", "deep.b.1", "feat", "size"]
    assert g["x"] == [[0, 1, 2, 1, 0, 0], [0, 0, 0, 0, 7, 3.5], [0] * 6, [4, 0, 0, 0, 0, 0]]
    assert g["edge_names"] == ["fam_edges_a", "fam_edges_b", "fam_edges_c", "deep.v", "edge_type", "extra", "guard_kind", "w"]
    assert list(zip(g["src"], g["dst"], strict=True)) == [(1, 3), (0, 1), (1, 2), (2, 0), (3, 1), (0, 0)]
    assert g["edge_attr"] == [[1, 0, 0, 0, 4, 1.5, 1, 0], [0, 1, 0, 0, 0, 0, 0, 0], [0, 1, 0, 0, 9, 0, 0, 0], [0, 1, 0, 6, 0, 0, 0, 5], [0, 1, 0, 0, 0, 0, 0, 2], [0, 1, 0, 0, 0, 0, 0, 0]]
    g = row["dfg_graph"]
    assert (g["x_names"], g["x"], g["edge_names"]) == (["z"], [[1], [0]], ["fam_edges_dfg", "k"])
    assert list(zip(g["src"], g["dst"], strict=True)) == [(0, 1), (1, 0), (0, 0)] and g["edge_attr"] == [[1, 3], [1, 0], [1, 0]]


def test_records_without_sections(spark):
    """Records under other names load as one featureless node and no flow graph."""
    df = samples.record_samples(frame(spark, [{"ast_result": {"nodes": [{}]}}, "no json", None, {"ast": {"nodes": []}, "dfg": {}}, {"ast": 5, "dfg": {"x": 1}}]), "id", "json")
    assert graphs(df, "ast_graph") == dict.fromkeys(range(5), EMPTY)
    flow = graphs(df, "dfg_graph")
    assert [flow[i] for i in range(4)] == [None] * 4 and flow[4] == EMPTY | {"edge_names": ["fam_edges_dfg"]}


@pytest.mark.parametrize(("keyword", "want"), [(None, [1, 0, 1, 0, 0, 1, 0, 1, 0, 0]), ("Case", [1, 0, 1, 0, 1, 0, 0, 0, 0, 0])])
def test_labels(spark, keyword, want):
    records = [{"label": True}, {"label": 0, "file": "bad"}, {"label": " 7 "}, {"label": "00"}, {"file": "good_case.c"}, {"filename": "VULN.c"}, {"file": "unpatched.c"}, {"label": "x"}, {"label": 0.5}, {}]
    df = samples.record_samples(frame(spark, records, {7: "unsafe_no/bad/x.json", 9: "dir/x.json"}), "id", "json", "path", keyword)
    got = {r["id"]: r["label"] for r in df.collect()}
    # unsafe holds safe, which is looked for first.
    assert [got[i] for i in range(10)] == [0 if i == 7 and keyword is None else w for i, w in enumerate(want)]


def test_configured_samples(spark):
    records = [
        {"n1": [{"feat": {"a": 1}}], "n2": [{"b": 2}], "e1": [[0, 1], [1, 0, 2.5]], "e2": [{"src": 1, "dst": 1}, {"attr": "x"}, 7], "name": "r", "more": {"k": [1]}},
        {"n1": [{"a": 1}], "e1": [[0, 0]]},
        {"x": [[1, 2]], "edge_index": [[0, 0], [0, 0]], "edge_attr": [0.5, 1.5], "y": 3},
        {"x": [[1]], "edge_index": [[0], [0]]},
        "broken",
        {"other": 1},
    ]
    make = lambda strict: samples.configured_samples(frame(spark, records), "id", "json", ["n1", "n2", "n1"], {"late": ["e2"], "early": ["e1", "missing"]}, strict)
    got = graphs(make(False))
    assert got[0] == {"x_names": ["a", "b"], "x": [[1, 0], [0, 2]], "src": [0, 1, 1, 0, 0], "dst": [1, 0, 1, 0, 0], "edge_names": ["early", "late", "value"], "edge_attr": [[1, 0, 0], [1, 0, 2.5], [0, 1, 0], [0, 1, 0], [0, 1, 0]]}
    assert got[1]["edge_names"] == ["early", "late"] and got[1]["edge_attr"] == [[1, 0]]
    assert got[2] == {"x_names": None, "x": [[1, 2]], "src": [0, 0], "dst": [0, 0], "edge_names": None, "edge_attr": [[0.5], [1.5]]}
    assert got[3]["edge_attr"] == [[0.0]]
    nothing = EMPTY | {"edge_names": ["early", "late"]}
    assert got[4] == nothing and got[5] == nothing
    assert {r["id"]: r["rest"] for r in make(True).collect()} == {0: {"name": '"r"', "more": '{"k":[1]}'}, 1: None, 2: {"y": "3"}, 3: None, 5: {"other": "1"}}


def test_harmonised_columns(spark):
    records = [{"ast": {"nodes": [{"feat": {"a": 1}}], "edges_p": [[0, 0, 3]]}}, {"ast": {"nodes": [{"feat": {"b": 2}}, {}]}, "dfg": {"nodes": [{"c": 1}]}}]
    df = samples.record_samples(frame(spark, records), "id", "json")
    names = samples.feature_names(df, "ast_graph", "dfg_graph")
    assert names == {"ast_graph": (["a", "b"], ["edge_attr", "edge_type", "fam_edges_p"]), "dfg_graph": (["c"], ["fam_edges_dfg"])}
    out = samples.harmonised(df, names)
    got = graphs(out, "ast_graph")
    assert got[0]["x"] == [[1, 0]] and got[0]["edge_attr"] == [[0, 3, 1]] and got[1]["x"] == [[0, 2], [0, 0]]
    assert graphs(out, "dfg_graph")[0] is None


def test_records_stay_in_their_rows(spark):
    """Rows of features were dealt out and joined again for each record, with a job for each level."""
    deep = {"a": {"b": {"c": {"d": [{"e": 7}]}}}}
    records = [{"ast": {"nodes": [deep, {"big": 10**400, "small": -(10**400), "a.b": 1, "a": {"b": 2}}], "edges_p": [{"src": " 1 ", "dst": "yes", "guard_kind": "1.5e1", "attr": deep}, [1e30, 1.9, None]]}}]
    frames = [samples.record_samples(frame(spark, records), "id", "json"), samples.configured_samples(frame(spark, records), "id", "json", ["ast"], {})]
    for df in frames:
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    g = frames[0].first()["ast_graph"]
    assert g["x_names"] == ["a.b", "a.b.c.d.0.e", "big", "small"] and g["x"] == [[0, 7, 0, 0], [2, 0, float("inf"), float("-inf")]]
    assert (g["src"], g["dst"]) == ([1, 1], [1, 1]) and g["edge_names"] == ["fam_edges_p", "a.b.c.d.0.e", "edge_type", "guard_kind"]
    assert g["edge_attr"] == [[1, 7, 0, 15], [1, 0, 0, 0]]
    trailing = samples.record_samples(frame(spark, [' {"ast": {"nodes": [{"a": 1}]}} rest', '{"ast": {"nodes": [{"a": 1, "a": 2}]}}']), "id", "json")
    assert {r["id"]: r["ast_graph"]["x"] for r in trailing.collect()} == {0: [[1]], 1: [[]]}


def test_configured_lists_are_put_together_in_their_rows(spark):
    """Lists of several names, in the order given, with an empty one between and an edge list of two families."""
    records = [{"b": [{"k": 2}], "a": [{"k": 1}, {}], "none": [], "e": [[0, 1, "2.5"], {"src": "1", "dst": True, "attr": False}], "n": None}, {"x": [[1]], "edge_index": [[0], [0]], "a": 1}]
    df = samples.configured_samples(frame(spark, records), "id", "json", ["b", "none", "a"], {"p": ["e"], "q": ["none", "e"]})
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    got = graphs(df)
    assert (got[0]["x_names"], got[0]["x"], got[0]["edge_names"]) == (["k"], [[2], [1], [0]], ["p", "q", "value"])
    assert list(zip(got[0]["src"], got[0]["dst"], strict=True)) == [(0, 1), (1, 1)] * 2 and got[0]["edge_attr"] == [[1, 0, 2.5], [1, 0, 0], [0, 1, 2.5], [0, 1, 0]]
    assert got[1]["x"] == [[1]] and {r["id"]: r["rest"] for r in df.collect()} == {0: {"n": "null"}, 1: {"a": "1"}}


def test_numbers_are_read_as_spark_casts_them():
    assert [samples._bigint(v) for v in ("9" * 30, 10**30, " -7 ", "1.5", "YES", -1.9, None, [1], True)] == [0, 1, -7, 0, 1, -1, 0, 0, 1]
    assert [samples._double(v) for v in ("1.5d", "1_0", ".5", "t", None, False)] == [1.5, 0, 0.5, 1, 0, 0]
