"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, mixing.

Each stage reads what the stage before it wrote. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.llm import decontaminate, line_dedup, mixing, simhash, toxicity
from graphlens.llm.common import checkpointed, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a toxicity score below 0.5; the model is fitted to the labelled rows of documents."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that are boilerplate; n_chars follows the text."""
    found = line_dedup.dedup_lines(docs)
    new = {"text": F.col("kept"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))}
    return found.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts whose five-word shingles are linked by a Jaccard similarity of 0.8 or more."""
    return simhash.drop_similar_texts(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, with their size, how often they are taken and the words taken."""
    out = mixing.mix(docs).where(F.col("copies") > 0)
    return out.select("row.*", F.col("size").alias("n_words"), "copies", "taken")


STAGES = [
    ("toxicity", toxic),
    ("line dedup", lines),
    ("near-dedup", near_duplicates),
    ("decontamination", benchmark),
    ("mixture", mixture),
]
#: A trained score and XXH64 fingerprints are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return docs
