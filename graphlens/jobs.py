"""Job entry points: the analyses over files, from a command line.

    python -m graphlens.jobs evidence|template|functions|ast|dfg|full|evaluate INPUT OUTPUT [--backend NAME --command ...]
    python -m graphlens.jobs train|score INPUT OUTPUT [--model FOLDER] [--mode ast|dfg|late_fusion] [--epochs N]

INPUT is a folder of property graphs, or of source files if a backend makes graphs of them; for train and score a folder
of training records.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.functions.knowledge import KnowledgeBase
from graphlens.operators import calculus, cstatements, evaluate, evidence, graphnet, rules, samples, template
from graphlens.session import checkpointed
from graphlens.sources import artifacts, backends, graphson


def load(spark: SparkSession, path: str, backend: str | None = None, extensions: tuple[str, ...] = ("c", "h", "cpp", "java")) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the graphs below a path, or of those that a backend makes of the source files there."""
    if not backend:
        return graphson.load(graphson.read_documents(spark, path))
    batch = checkpointed(backends.run_batch(backends.source_files(spark, path, *extensions), backend))
    return graphson.load(backends.documents(batch))


def run_evidence(spark: SparkSession, source: str, out: str, backend: str | None = None) -> None:
    nodes, edges = load(spark, source, backend)
    artifacts.write_json(evidence.analyze(nodes, edges, KnowledgeBase(spark)).tables(), out)


def run_template(spark: SparkSession, source: str, out: str, backend: str | None = None) -> None:
    artifacts.write_shards(template.convert(*load(spark, source, backend)), out)


def run_functions(spark: SparkSession, source: str, out: str, backend: str | None = None, with_label: bool = False) -> None:
    tree = template.convert(*load(spark, source, backend))
    fns = cstatements.Functions(tree, template.functions(tree))
    artifacts.write_functions(cstatements.training_records(fns, with_label).withColumn("ord", F.col("fn")), out)


#: Job -> the fields of a training record that it writes.
SECTIONS = {"ast": ("fn", "function_name", "nodes", "edges_ast_pc", "edges_ast_sb", "edges_ast_guard"), "dfg": ("fn", "function_name", "dfg_nodes", "edges_dfg"), "full": ()}


def run_section(section: str):
    """A job that writes one section of the functions' records, or all of them in one table."""

    def run(spark: SparkSession, source: str, out: str, backend: str | None = None) -> None:
        tree = template.convert(*load(spark, source, backend))
        records = cstatements.training_records(cstatements.Functions(tree, template.functions(tree)))
        artifacts.write_json({section: records.select(*SECTIONS[section]) if SECTIONS[section] else records}, out)

    return run


def read_samples(spark: SparkSession, source: str) -> DataFrame:
    """Samples of the training records in the JSON files below a path; the file's path may tell the label."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("wholetext", True).text(source)
    rows = files.select(F.col("_metadata.file_path").alias("path"), "value").withColumn("key", F.col("path"))
    return checkpointed(samples.record_samples(rows, "key", "value", "path"))


def run_training(spark: SparkSession, source: str, out: str, mode: str = "late_fusion", epochs: int = 10, **sizes: int) -> list[float]:
    """Weights of each epoch below OUTPUT/model, with the feature names that they belong to, and the losses."""
    rows = read_samples(spark, source)
    names = samples.feature_names(rows, *graphnet.BRANCHES[mode])
    shape = graphnet.shape_of(mode, names, **sizes)
    _, losses = graphnet.fit(checkpointed(samples.harmonised(rows, names)), shape, epochs=epochs, folder=f"{out}/model")
    kept = [(mode, g, x, e, shape.hidden, shape.layers, shape.fusion_depth, shape.classes) for g, (x, e) in names.items()]
    spark.createDataFrame(kept, "mode string, graph string, x array<string>, e array<string>, hidden int, layers int, fusion_depth int, classes int").coalesce(1).write.mode("overwrite").json(f"{out}/shape")
    spark.createDataFrame([(i, x) for i, x in enumerate(losses, 1)], "epoch int, loss double").coalesce(1).write.mode("overwrite").json(f"{out}/losses")
    return losses


def run_scoring(spark: SparkSession, source: str, out: str, model: str = "", epoch: int | None = None) -> None:
    """Predictions of a trained model, the last epoch's if none is named, and how they agree with the labels."""
    kept = {r["graph"]: r for r in spark.read.json(f"{model}/shape").collect()}
    names = {g: (list(r["x"] or []), list(r["e"] or [])) for g, r in kept.items()}
    first = next(iter(kept.values()))
    shape = graphnet.shape_of(first["mode"], names, hidden=first["hidden"], layers=first["layers"], fusion_depth=first["fusion_depth"], classes=first["classes"])
    told = checkpointed(graphnet.predict(samples.harmonised(read_samples(spark, source), names), graphnet.load(spark, f"{model}/model", epoch), shape))
    artifacts.write_json({"predictions": told, "confusion": graphnet.mlprep.confusion(told, "label", "predicted")}, out)


def referenced(nodes: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """doc, action: actions whose name, symbols or number occur in a document's code."""
    from graphlens.operators import handlers

    said = nodes.where(F.col("label").isin("LITERAL", "IDENTIFIER", "CALL", "FIELD_IDENTIFIER", "JUMP_TARGET")).select("doc", "label", F.coalesce("code", F.lit("")).alias("code"))
    names = handlers.tokens(kb).unionByName(kb.actions.select("action", F.upper("action").alias("token"))).distinct()
    tokens = sorted({r["token"] for r in names.select("token").collect() if r["token"]})
    numbers = F.broadcast(kb.actions.select("action", F.explode(F.transform("numeric", lambda n: n.cast("string"))).alias("number")))
    by_name = evaluate.token_hits(said, "code", tokens).select("doc", "token").distinct().join(F.broadcast(names), "token").select("doc", "action")
    return by_name.unionByName(said.where("label = 'LITERAL'").join(numbers, F.trim("code") == F.col("number")).select("doc", "action")).distinct()


def evaluation(nodes: DataFrame, edges: DataFrame, kb: KnowledgeBase, policy: calculus.Policy = calculus.Policy()) -> dict[str, DataFrame]:
    """Outcomes of a corpus: records by document and action, histograms and distributions."""
    result = evidence.analyze(nodes, edges, kb, policy)
    said = referenced(nodes, kb).withColumn("referenced", F.lit(True))
    records = result.resolutions.join(said, ["doc", "action"], "left").withColumn("referenced", F.coalesce("referenced", F.lit(False)))
    records = rules.classify_outcome(records)
    best = calculus.score(result.evidence).groupBy("slot", "callback").agg(F.max("score").alias("best_score"))
    lifted = evaluate.records(result.candidates.join(best, ["slot", "callback"]), records)
    resolved = lifted.where("status = 'RESOLVED'")
    return {
        "records": lifted.orderBy("doc", "action"), "histograms": evaluate.histograms(lifted, "status", "reason", "tier"), "backends": evaluate.nested_histogram(lifted.where("status <> 'RESOLVED'"), "category", "class_confidence"),
        "confidence": evaluate.stats(resolved, "top"), "lift": evaluate.stats(resolved, "lift"), "margin": evaluate.stats(lifted, "margin"), "close": lifted.agg(F.count_if(F.col("margin") < policy.ambiguity_margin).alias("within_margin")),
    }


def run_evaluation(spark: SparkSession, source: str, out: str, backend: str | None = None) -> None:
    artifacts.write_json(evaluation(*load(spark, source, backend), KnowledgeBase(spark)), out)


def main(argv: list[str] | None = None) -> None:
    jobs = {"evidence": run_evidence, "template": run_template, "functions": run_functions, "evaluate": run_evaluation} | {c: run_section(c) for c in SECTIONS}
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("job", choices=[*jobs, "train", "score"])
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--backend", help="name of the tool that makes graphs of source files")
    p.add_argument("--command", nargs="+", help="the tool's command, with {input} and {output}")
    p.add_argument("--mode", choices=sorted(graphnet.BRANCHES), default="late_fusion")
    p.add_argument("--epochs", type=int, default=10)
    p.add_argument("--model", help="folder of a trained model")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName(f"graphlens-{a.job}").getOrCreate()
    if a.command:
        backends.register(a.backend or "command", a.command)
    if a.job == "train":
        run_training(spark, a.input, a.output, a.mode, a.epochs)
    elif a.job == "score":
        run_scoring(spark, a.input, a.output, a.model or a.input)
    else:
        jobs[a.job](spark, a.input, a.output, backend=a.backend or ("command" if a.command else None))


if __name__ == "__main__":
    main()
