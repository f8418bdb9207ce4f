"""Sinks for results, and readers of training records and graph summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlens.functions.text import sanitize_filename, unique_names


def write_json(tables: dict[str, DataFrame], folder: str) -> None:
    """One JSON folder for each record list."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")


def write_functions(records: DataFrame, folder: str, name: str = "function_name", order: str = "ord") -> None:
    """Training records in a folder for each function; repeated names get _1, _2, ..."""
    safe = sanitize_filename(name)
    rank = F.row_number().over(Window.partitionBy(safe).orderBy(order)) - 1
    records.withColumn("file", unique_names(rank, safe)).write.mode("overwrite").partitionBy("file").json(folder)


def write_shards(df: DataFrame, folder: str, rows: int = 200_000) -> None:
    """Parquet with zstd, at most some rows in a file."""
    df.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows).parquet(folder)


def write_csv(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(folder)


def read_records(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON training records below a path. A broken file is a row with its text in _corrupt_record,
    or is left out if strict."""
    reader = spark.read.option("recursiveFileLookup", True).option("multiLine", True)
    if strict:
        return reader.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return reader.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def read_graphs(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Graphs from JSON lines (also gzip) or whole JSON files, as variants."""
    text = spark.read.option("wholetext", not lines).text(path)
    return text.select(F.try_parse_json("value").alias("g")).where(F.col("g").isNotNull()).withColumn("graph_id", F.xxhash64(F.to_json("g")))


def source_files(spark: SparkSession, root: str, *extensions: str) -> DataFrame:
    """path of all files below a root with one of some extensions, case aside."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    return files.where(is_supported(F.col("path"), *extensions))


def is_supported(path: Column, *extensions: str) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)).isin(*[e.lower().lstrip(".") for e in extensions])


def relative_output(path: Column, root: str, suffix: str = ".json") -> Column:
    """Where a file's result goes: its path below the root, its own suffix kept, so that a.c and a.h differ."""
    return F.concat(F.regexp_replace(path, "^" + root.rstrip("/") + "/", ""), F.lit(suffix))


def to_markdown(code: Column, ast: Column, dfg: Column) -> Column:
    block = lambda title, kind, c: F.concat(F.lit(f"## {title}\n\n```{kind}\n"), c, F.lit("\n```\n"))
    return F.concat_ws("\n", block("Code", "c", code), block("AST", "json", ast), block("DFG", "json", dfg))
