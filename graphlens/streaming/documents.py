"""Streams: graph documents that arrive as files, and windowed counts of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphlens.sources import graphson


def document_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """doc, json of new files in a folder."""
    return spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", files_per_trigger).text(folder).select(F.col("_metadata.file_path").alias("doc"), F.col("value").alias("json"))


def analyze_stream(stream: DataFrame, handle: Callable[[DataFrame, DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls ``handle`` with nodes, edges and the batch's number for each batch of documents. A batch
    that is repeated after a failure has the same number, so a handler that writes by it is exact."""

    def batch(rows: DataFrame, number: int) -> None:
        nodes, edges = graphson.load(rows.select("doc", F.try_parse_json("json").alias("v")))
        handle(nodes, edges, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events by type and time window, with a watermark for late ones."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("window.start", "event_type", "n", "total")
