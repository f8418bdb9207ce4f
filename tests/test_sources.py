"""Readers, writers, streams and jobs."""

import json

from pyspark.sql import functions as F

from graphlens import jobs
from graphlens.plans import programs
from graphlens.sources import artifacts, graphson
from graphlens.streaming import documents


def test_all_wrappings_read_alike(spark):
    raw, wrapped = programs.designated().done(), programs.designated().wrapped()
    docs = {"raw": raw, "wrapped": wrapped, "export": {"export": wrapped}, "list": [raw], "deep": {"@value": {"@value": raw}}}
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in docs.items()], "doc string, json string").select("doc", F.try_parse_json("json").alias("v"))
    nodes, edges = graphson.load(df)
    n = {r["doc"]: (r["n"], r["m"]) for r in nodes.groupBy("doc").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "METHOD").alias("m")).collect()}
    e = {r["doc"]: r["n"] for r in edges.groupBy("doc").agg(F.count("*").alias("n")).collect()}
    assert set(n) == set(docs) and len(set(n.values())) == 1 and len(set(e.values())) == 1
    assert nodes.where("label = 'METHOD_REF' AND code = 'on_start'").count() == len(docs)


def test_edges_without_ends_are_dropped(spark):
    doc = {"vertices": [{"id": 1, "label": "METHOD"}, {"label": "CALL"}], "edges": [{"label": "AST", "outV": 1, "inV": 1}, {"label": "AST", "outV": 1}, {"outV": 1, "inV": 1}]}
    df = spark.createDataFrame([("d", json.dumps(doc))], "doc string, json string").select("doc", F.try_parse_json("json").alias("v"))
    nodes, edges = graphson.load(df)
    assert (nodes.count(), edges.count()) == (1, 1)
    assert {r["problem"] for r in graphson.validate(df).collect()} == {"incomplete vertices", "incomplete edges"}


def test_function_records_get_folders_of_their_own(spark, tmp_path):
    rows = spark.createDataFrame([("a/b", 0), ("a/b", 1), ("", 2)], "function_name string, ord int")
    artifacts.write_functions(rows, str(tmp_path / "out"))
    assert {p.name for p in (tmp_path / "out").glob("file=*")} == {"file=a_b", "file=a_b_1", "file=unnamed"}


def test_broken_records(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"a": 1}')
    (tmp_path / "bad.json").write_text('{"a": ')
    assert artifacts.read_records(spark, str(tmp_path), "a int").count() == 2
    assert artifacts.read_records(spark, str(tmp_path), "a int", strict=True).count() == 1


def test_stream_of_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("designated", "switch_case"):
        (tmp_path / "in" / f"{name}.json").write_text(programs.PROGRAMS[name]().json())
    seen = []
    stream = documents.document_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    q = documents.analyze_stream(stream, lambda nodes, edges, k: seen.append((k, nodes.where("label = 'METHOD'").count(), edges.count() > 0)), str(tmp_path / "state"))
    q.awaitTermination(120)
    assert [k for k, _, _ in seen] == [0, 1] and all(ok for _, _, ok in seen) and sum(n for _, n, _ in seen) == 5


def test_event_windows(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert documents.event_counts(e).agg(F.sum("n")).first()[0] == e.count()


def test_evidence_job(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p.json").write_text(programs.designated().json())
    jobs.run_evidence(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    got = spark.read.json(str(tmp_path / "out" / "resolutions")).where("status = 'RESOLVED'").collect()
    assert [(r["action"], r["top"]) for r in got] == [("RemoteStartTransaction", 0.8)]
