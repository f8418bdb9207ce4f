"""Batches through a tool, broken documents, deeply wrapped values, training from files."""

import json
import sys

import pytest
from pyspark.sql import functions as F

from graphlens import jobs
from graphlens.operators import rules
from graphlens.sources import backends, graphson
from graphlens.sources.builder import Builder

TOOL = """
import sys, time
text = open(sys.argv[1]).read()
if "slow" in text: time.sleep(60)
if "fail" in text: sys.exit("cannot read this")
if "quiet" in text: sys.exit(0)
if "file" in text: open(sys.argv[2], "w").write('{"from": "file"}')
else: print('{"from": "output"}')
"""


@pytest.fixture
def tool(tmp_path, monkeypatch):
    monkeypatch.setattr(backends, "BACKENDS", {})
    (tmp_path / "tool.py").write_text(TOOL)
    backends.register("tool", [sys.executable, str(tmp_path / "tool.py"), "{input}", "{output}"])
    backends.register("absent", ["/no/such/tool", "{input}"])
    return tmp_path


def test_every_file_gets_an_outcome(spark, tool):
    for name in ("slow", "fail", "quiet", "file", "output"):
        (tool / f"{name}.c").write_text(name)
    (tool / "skipped.txt").write_text("output")
    files = backends.source_files(spark, str(tool), ".C")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in backends.run_batch(files, "tool", timeout=5, per_task=2).collect()}
    assert {k: r["ok"] for k, r in rows.items()} == {"slow.c": False, "fail.c": False, "quiet.c": False, "file.c": True, "output.c": True}
    assert rows["slow.c"]["error"] == "timed out after 5 s" and 5 <= rows["slow.c"]["seconds"] < 30
    assert rows["fail.c"]["error"] == "exit code 1: cannot read this" and rows["quiet.c"]["error"] == "no output"
    docs = {r["doc"].rsplit("/", 1)[1]: r["f"] for r in backends.documents(backends.run_batch(files, "tool", timeout=5)).select("doc", F.try_variant_get("v", "$.from", "string").alias("f")).collect()}
    assert docs == {"file.c": "file", "output.c": "output"}
    assert "FileNotFoundError" in backends.run_batch(files, "absent").first()["error"]


def test_unknown_backends_are_named(spark, tool):
    with pytest.raises(ValueError, match="no backend 'other'; there are: absent, tool"):
        backends.backend("other")
    with pytest.raises(ValueError, match="input"):
        backends.register("bad", ["tool"])


def deep(value, levels):
    for _ in range(levels):
        value = {"@type": "x", "@value": value}
    return value


def test_values_at_any_depth_and_broken_documents(spark):
    node = lambda levels: {"id": deep(1, levels), "label": "METHOD", "properties": {"NAME": deep([deep("f", levels)], 2), "LINE_NUMBER": deep(7, levels)}}
    edge = lambda levels: {"label": "AST", "outV": deep(1, levels), "inV": deep(2, 1), "properties": {}}
    docs = {f"d{n}": json.dumps({"vertices": [node(n), {"id": 2, "label": "BLOCK", "properties": {}}], "edges": [edge(n)]}) for n in (0, 1, 6, 7, 25)}
    docs |= {"broken": "{", "empty": "{}", "odd": json.dumps({"vertices": [{"label": "X"}], "edges": []}), "none": None}
    df = spark.createDataFrame(list(docs.items()), "doc string, json string").select("doc", F.try_parse_json("json").alias("v"))
    nodes, edges = graphson.load(df)
    assert {r["doc"]: (r["node_id"], r["name"], r["line"]) for r in nodes.where("label = 'METHOD'").collect()} == {f"d{n}": (1, "f", 7) for n in (0, 1, 6, 7, 25)}
    assert {(r["doc"], r["src"], r["dst"]) for r in edges.collect()} == {(f"d{n}", f"d{n}#1", f"d{n}#2") for n in (0, 1, 6, 7, 25)}
    told = {r["doc"]: (r["ok"], r["error"], r["n_nodes"], r["n_edges"]) for r in graphson.outcomes(df).collect()}
    assert told == {f"d{n}": (True, None, 2, 1) for n in (0, 1, 6, 7, 25)} | {"broken": (False, "not JSON", 0, 0), "none": (False, "not JSON", 0, 0), "empty": (False, "no graph", 0, 0), "odd": (False, "incomplete vertices", 0, 0)}


def test_equal_rows_keep_their_causes(spark):
    causes = spark.createDataFrame([("C1", 1, ["a"], []), ("C2", 0, [], ["m"])], "id string, ord int, domains array<string>, checks array<string>")
    rows = spark.createDataFrame([(1, "a", ["m"]), (1, "a", ["m"]), (2, None, None), (3, "z", [])], "k int, domain string, missing array<string>")
    got = sorted((r["k"], r["causes"]) for r in rules.root_causes(rows, causes).collect())
    assert got == [(1, ["C2", "C1"]), (1, ["C2", "C1"]), (2, []), (3, [])]


def test_jobs_from_sources_to_scores(spark, tool, tmp_path):
    b = Builder()
    b.define("copy_bad", "n", lambda: b.assign(b.ident("p"), b.call("malloc", b.ident("n"))), lambda: b.call("free", b.ident("p")))
    (tmp_path / "graph.json").write_text(b.json())
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.c").write_text("any")
    backends.register("copy", ["sh", "-c", f"cat {tmp_path}/graph.json", "{input}"])
    for section in jobs.SECTIONS:
        jobs.run_section(section)(spark, str(tmp_path / "in"), str(tmp_path / section), backend="copy")
    full = spark.read.json(str(tmp_path / "full" / "full")).collect()
    assert [r["function_name"] for r in full] == ["copy_bad"]
    assert spark.read.json(str(tmp_path / "dfg" / "dfg")).columns == sorted(jobs.SECTIONS["dfg"])
    record = full[0].asDict(True)
    for i in range(6):
        kept = {"function_name": f"f{i}", "file": "bad.c" if i % 2 else "good.c", "ast": {"nodes": record["nodes"][: 2 + i % 3]} | {k: record[k] for k in record if k.startswith("edges_ast")}, "dfg": {"nodes": record["dfg_nodes"], "edges_dfg": record["edges_dfg"]}}
        (tmp_path / "records").mkdir(exist_ok=True)
        (tmp_path / "records" / f"{i}.json").write_text(json.dumps(kept))
    losses = jobs.run_training(spark, str(tmp_path / "records"), str(tmp_path / "run"), "late_fusion", 2, hidden=4, layers=2)
    assert len(losses) == 2
    jobs.run_scoring(spark, str(tmp_path / "records"), str(tmp_path / "scores"), str(tmp_path / "run"))
    told = spark.read.json(str(tmp_path / "scores" / "predictions"))
    assert told.count() == 6 and spark.read.json(str(tmp_path / "scores" / "confusion")).first()["n"] == 6
