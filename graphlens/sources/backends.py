"""Batches of files through an external tool: a command for each file, run in tasks, and a record of how each went.

A backend is a command with ``{input}`` and ``{output}`` for the paths of a file and of its result. A file that makes
the tool fail, that takes longer than the limit, or that yields nothing is a row with ``ok`` false and the reason, and stops no
other file. The input and the output of a command are files of the task that runs it, so a task that runs again starts afresh.
"""

from __future__ import annotations

import os
import subprocess
import tempfile
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.sources.artifacts import is_supported

TIMEOUT = 300.0
#: Characters of a tool's complaint that a row keeps.
COMPLAINT = 2000
BACKENDS: dict[str, list[str]] = {}


def register(name: str, command: list[str]) -> None:
    """Makes a backend known by a name."""
    if not any("{input}" in c for c in command):
        raise ValueError("a backend's command holds {input}")
    BACKENDS[name] = list(command)


def backend(name: str) -> list[str]:
    if name not in BACKENDS:
        raise ValueError(f"no backend {name!r}; there are: {', '.join(sorted(BACKENDS)) or 'none'}")
    return BACKENDS[name]


def source_files(spark: SparkSession, root: str, *extensions: str) -> DataFrame:
    """path, content of the files below a root with one of some extensions."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    return files.where(is_supported(F.col("path"), *extensions)) if extensions else files


def _one(command: list[str], path: str, content: bytes, timeout: float) -> tuple[bool, str | None, str | None]:
    with tempfile.TemporaryDirectory() as folder:
        source, result = os.path.join(folder, os.path.basename(path) or "input"), os.path.join(folder, "result.out")
        with open(source, "wb") as f:
            f.write(content)
        try:
            done = subprocess.run([c.format(input=source, output=result) for c in command], capture_output=True, timeout=timeout, cwd=folder)
        except subprocess.TimeoutExpired:
            return False, f"timed out after {timeout:g} s", None
        except OSError as e:
            return False, f"{type(e).__name__}: {e}", None
        if done.returncode:
            return False, f"exit code {done.returncode}: {done.stderr.decode(errors='replace')[-COMPLAINT:].strip()}", None
        if os.path.exists(result):
            with open(result, encoding="utf-8", errors="replace") as f:
                out = f.read()
        else:
            out = done.stdout.decode(errors="replace")
        return (True, None, out) if out.strip() else (False, "no output", None)


def run_batch(files: DataFrame, name: str, timeout: float = TIMEOUT, per_task: int = 16) -> DataFrame:
    """path, ok, error, seconds, output of each file (path, content). Files are dealt out over tasks by path, about
    ``per_task`` to each, as a file takes long compared with a row."""
    command = backend(name)
    tasks = max(1, -(-files.count() // per_task))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                start = time.monotonic()
                ok, error, output = _one(command, path, bytes(content), timeout)
                yield pd.DataFrame({"path": [path], "ok": [ok], "error": [error], "seconds": [time.monotonic() - start], "output": [output]})

    return files.select("path", "content").repartition(tasks, "path").mapInPandas(run, "path string, ok boolean, error string, seconds double, output string")


def documents(batch: DataFrame) -> DataFrame:
    """doc, v of the files that went well, for the GraphSON reader; a result that is no JSON has a null v."""
    return batch.where("ok").select(F.col("path").alias("doc"), F.try_parse_json("output").alias("v"))
