"""Corpus evaluation: statistics, histograms, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stats(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """count, min, max, mean and median of a column to six places; nulls do not count."""
    r = lambda c: F.round(c, 6)
    agg = [F.count(value).alias("n"), r(F.min(value)).alias("lo"), r(F.max(value)).alias("hi"), r(F.avg(value)).alias("mean"), r(F.median(value)).alias("mid")]
    return rows.groupBy(*by).agg(*agg) if by else rows.agg(*agg)


def token_hits(rows: DataFrame, text: str, tokens: list[str]) -> DataFrame:
    """Rows with each token (upper case) that occurs in their text, case aside, in one pass over the rows. The tokens
    come from a knowledge base and stand in the plan."""
    hit = F.filter(F.array(*[F.lit(t) for t in tokens]).cast("array<string>"), lambda t: F.contains(F.upper(F.col(text)), t))
    return rows.withColumn("token", F.explode(hit))


def histograms(rows: DataFrame, *columns: str) -> DataFrame:
    """name, value, n: a histogram of each column and the total, in one pass (grouping sets)."""
    tagged = F.explode(F.array(F.struct(F.lit("total").alias("name"), F.lit(None).cast("string").alias("value")), *[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns]))
    return rows.select(tagged.alias("h")).groupBy("h.name", "h.value").agg(F.count("*").alias("n"))


def nested_histogram(rows: DataFrame, outer: str, inner: str) -> DataFrame:
    return rows.groupBy(outer, inner).agg(F.count("*").alias("n"))


def records(candidates: DataFrame, selection: DataFrame) -> DataFrame:
    """Selections with the lift of the first candidate over its best single evidence (best_score)."""
    top = candidates.where("rank = 1").select("slot", "best_score")
    return selection.join(top, "slot", "left").withColumn("lift", F.when(F.col("best_score") > 0, F.round(F.col("top") - F.col("best_score"), 6)))


def markdown(title: str, tables: dict[str, DataFrame]) -> str:
    """A report of small result tables."""
    out = [f"# {title}", ""]
    for name, df in tables.items():
        rows = df.collect()
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]
        out.append("")
    return "\n".join(out)
