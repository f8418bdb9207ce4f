"""Spans of regular expressions in whole texts, with DataFrame functions only.

Patterns are written with possessive quantifiers and look-behind where that leaves the matches as
they are and keeps the time linear and the stack flat for very long texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Matches whose offsets are summed in one go. Two levels keep a text with very many matches cheap.
BLOCK = 256


def _running(sizes: Column, start: Column) -> Column:
    """sizes: struct(gap, n) -> struct(start, end) of each, counted from ``start``."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, s: Column) -> Column:
        at = acc["at"] + s["gap"]
        return F.struct((at + s["n"]).alias("at"), F.concat(acc["out"], F.array(F.struct(at.alias("start"), (at + s["n"]).alias("end")))).alias("out"))

    return F.aggregate(sizes, F.struct(start.alias("at"), none.alias("out")), step, lambda acc: acc["out"])


FOUND = "array<struct<start:int,end:int,text:string,group:string,left:string,right:string>>"


def with_matches(df: DataFrame, out: str, text: str, pattern: str, group: int = 0, guard: Column | None = None) -> DataFrame:
    """Adds column ``out``: struct(start, end, text, group, left, right) of all leftmost
    non-overlapping matches, with offsets in code points, one group, and the pieces of text before
    and after. ``guard`` is a cheap condition that every text with a match meets.

    The pieces between matches and the matches alternate, so running sums of their lengths give
    the offsets. Each regular expression runs once: its result is a column of its own."""
    none = F.array().cast("array<string>")
    hit = F.lit(True) if guard is None else guard
    df = df.withColumn("_found", F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    some = F.size("_found") > 0
    df = df.withColumn("_part", F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(none) if group else F.col("_found"))
    df = df.withColumn("_gaps", F.when(some, F.split(text, pattern, -1)).otherwise(none))
    found, gaps = F.col("_found"), F.col("_gaps")
    df = df.withColumn("_sizes", F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, gap: F.struct(F.length(gap).alias("gap"), F.length(m).alias("n"))))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int")), lambda i: F.slice("_sizes", i * BLOCK + 1, F.lit(BLOCK)))
    df = df.withColumn("_blocks", F.when(some, blocks).otherwise(F.array().cast("array<array<struct<gap:int,n:int>>>")))
    total = lambda b: F.aggregate(b, F.lit(0), lambda acc, s: acc + s["gap"] + s["n"])
    df = df.withColumn("_bases", _running(F.transform("_blocks", lambda b: F.struct(F.lit(0).alias("gap"), total(b).alias("n"))), F.lit(0)))
    df = df.withColumn("_at", F.flatten(F.zip_with("_blocks", "_bases", lambda b, base: _running(b, base["start"]))))
    texts = F.zip_with(found, "_part", lambda m, g: F.struct(m.alias("text"), g.alias("group")))
    sides = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), F.slice(gaps, F.lit(2), F.size(found)), lambda x, y: F.struct(x.alias("left"), y.alias("right")))
    both = F.zip_with(texts, sides, lambda t, x: F.struct(t["text"].alias("text"), t["group"].alias("group"), x["left"].alias("left"), x["right"].alias("right")))
    whole = F.zip_with("_at", both, lambda p, t: F.struct(p["start"].alias("start"), p["end"].alias("end"), t["text"].alias("text"), t["group"].alias("group"), t["left"].alias("left"), t["right"].alias("right")))
    whole = F.when(some, whole).otherwise(F.array().cast(FOUND))
    return df.withColumn(out, whole).drop("_found", "_part", "_gaps", "_sizes", "_blocks", "_bases", "_at")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, sorted, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, kind: str) -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
