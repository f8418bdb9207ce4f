"""Session helpers."""

from __future__ import annotations

import itertools
import tempfile
from collections.abc import Iterable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

#: A side with at most this many rows may be broadcast.
MAX_BROADCAST_ROWS = 200_000
#: Rows that a task sorts or sums up, where a step is dealt out by their number.
ROWS_IN_PART = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the folder in spark.checkpoint.dir, with its lineage cut. A local
    session without that setting gets a temporary folder; a cluster without it is an error."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if sc.master != "local" and not (sc.master or "").startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="graphlens-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """A checkpoint whose inferred size and constraints are forgotten as well. In a long chain of
    checkpoints both grow with every join, the size as a product, until the optimizer's rules that
    read them take longer than the work itself."""
    spark, done = df.sparkSession, checkpointed(df)
    rows = done._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, done._jdf.schema(), False), spark)


def rounds(bound: int | None = None) -> Iterable[int]:
    """1, 2, ... for a frontier loop, which ends by itself unless a bound is given."""
    return itertools.count(1) if bound is None else range(1, bound + 1)


def small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows that it is small."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def parts_for(df: DataFrame, rows: int = ROWS_IN_PART) -> int:
    """Partitions that hold about ``rows`` rows of ``df`` each, so that a task's memory stays the same at any size."""
    return max(1, -(-df.count() // rows))
