"""Mixing sources to target weights by hash-threshold histograms.

Every row has a 48-bit hash of its id and text. Word counts are summed by source and the leading
bits of the hash; a running sum over those buckets finds the bucket in which a source's budget
ends. Only rows of that boundary bucket are summed again by the next bits, and so on until the
hash is used up. Rows below the resulting threshold are taken by a filter; nothing is sorted.

Null texts have size 0. Null sources form one source, last in the order. Rows equal in id and text
share a hash and are taken or left together; at the boundary the nearer side is chosen. An empty
table gives an empty result. Other columns of the input play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlens.llm.common import checkpointed, join_small, table

BITS, LEVELS = 12, 4
WEIGHTS = (5, 2, 1)
_BLANK = " \t\n\u000b\f\r"


def n_words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null: 0."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANK))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, r"[\x20\x09-\x0D]+"))).cast("long")


def row_hash(doc_id: Column, text: Column) -> Column:
    """48 bits of md5 over id and text."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, 12), 16, 10).cast("long")


def targets(totals: DataFrame, share: float = 1.5, max_repeats: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size -> adds target: weighted shares of ``share`` times all words, none over
    ``max_repeats`` times its source. One row per source goes through the windows below.

    A level L with target = min(cap, L * weight) is found in closed form: with sources in the order
    of cap / weight, the first one at which the rest, dealt by weight, needs no more than its cap."""
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    order = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(by_source) - 1) % len(weights) + 1).cast("int"))
    t = totals.withColumn("weight", w).withColumn("cap", (F.col("source_size") * max_repeats).cast("long"))
    t = t.withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    everything = Window.partitionBy()
    t = t.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    t = t.withColumn("capped", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = t.withColumn("open", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    t = t.withColumn("at", (F.col("budget") - F.col("capped")) / F.col("open"))
    t = t.withColumn("level", F.min(F.when(F.col("at") <= F.col("ratio"), F.struct("ratio", "at"))).over(everything)["at"])
    target = F.when(F.col("level").isNull() | (F.col("level") * F.col("weight") >= F.col("cap")), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight"))
    return t.select("source", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, share: float = 1.5, max_repeats: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, size, h -> source key, source_size, target, whole (copies of every row), below (rows
    with a smaller hash get one more copy). Sources are keyed by ``sk``, which is never null."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("sk")
    bucket = F.shiftright("h", BITS * (LEVELS - 1))
    histogram = checkpointed(sized.groupBy(key, "source", bucket.alias("b")).agg(F.sum("size").alias("v")))
    goal = targets(histogram.groupBy("source").agg(F.sum("v").alias("source_size")), share, max_repeats, weights)
    goal = goal.withColumn("whole", F.least(F.floor(F.try_divide("target", "source_size")), F.lit(max_repeats)))
    goal = goal.withColumn("whole", F.coalesce("whole", F.lit(max_repeats)).cast("long"))
    goal = goal.withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    goal = checkpointed(goal.select(key, "source_size", "target", "whole", "left"))
    state, done = goal.select("sk", "left", F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("prefix")), None
    for level in range(LEVELS):
        if level:
            shift = BITS * (LEVELS - 1 - level)
            at = sized.select(key, "size", F.shiftright("h", shift + BITS).alias("prefix"), F.shiftright("h", shift).alias("b"))
            histogram = join_small(at, state.select("sk", "prefix"), ["sk", "prefix"]).groupBy("sk", "b").agg(F.sum("size").alias("v"))
        run = Window.partitionBy("sk").orderBy("b")
        h = histogram.select("sk", "b", "v").withColumn("upto", F.sum("v").over(run)).withColumnRenamed("v", "in_b")
        h = h.join(state, "sk").where(F.col("before") + F.col("upto") > F.col("left"))
        first = h.groupBy("sk").agg(F.min(F.struct("b", "upto", "in_b", "left", "before")).alias("f"))
        state = first.select("sk", F.col("f.left").alias("left"), (F.col("f.before") + F.col("f.upto") - F.col("f.in_b")).alias("before"), F.col("f.b").alias("prefix"), F.col("f.in_b").alias("in_b"))
        if level == LEVELS - 1:
            nearer = F.col("before") + F.col("in_b") - F.col("left") < F.col("left") - F.col("before")
            done = state.select("sk", (F.col("prefix") + nearer.cast("long")).alias("below"))
        else:
            state = checkpointed(state.select("sk", "left", "before", "prefix"))
    # A source without a boundary has nothing left to take.
    return checkpointed(goal.join(done, "sk", "left").select("sk", "source_size", "target", "whole", F.coalesce("below", F.lit(0)).cast("long").alias("below")))


def mix(docs: DataFrame, share: float = 1.5, max_repeats: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """All rows of ``docs`` (doc_id, text, source): row (struct of the input's columns), size,
    source_size, target, copies, taken."""
    facts = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("h"))
    small = checkpointed(facts)
    limits = thresholds(small, share, max_repeats, weights)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), n_words(F.col("text")).alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("h"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("sk"))
    return _taken(join_small(rows, limits, ["sk"]))


def _taken(joined: DataFrame) -> DataFrame:
    copies = F.col("whole") + (F.col("h") < F.col("below")).cast("long")
    return joined.withColumn("copies", copies).withColumn("taken", (F.col("size") * F.col("copies")).cast("long"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    facts = checkpointed(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("h")))
    limits = thresholds(facts)
    keyed = facts.withColumn("sk", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")))
    return _taken(join_small(keyed, limits, ["sk"])).select("doc_id", "size", "source_size", "target", "taken")


#: {docs} is the table or query to mix; {out} the columns to return from f (with its copies).
MIX_SQL = r"""
WITH d AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size_,
             ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')), 1, 12))::BIGINT AS h_
           FROM {docs}),
s AS (SELECT source, sum(size_)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight, 2 * source_size AS cap FROM s),
r AS (SELECT *, cap::DOUBLE / weight AS ratio, (sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE AS budget FROM w),
l AS (SELECT *, (budget - coalesce((sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0))
             / (sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS at_ FROM r),
v AS (SELECT arg_min(at_, ratio) AS level FROM l WHERE at_ <= ratio),
t AS (SELECT source, source_size, weight, CASE WHEN level IS NULL OR level * weight >= cap THEN cap::DOUBLE ELSE level * weight END AS target FROM l, v),
g AS (SELECT source, h_, sum(size_)::BIGINT AS v FROM d GROUP BY source, h_),
c AS (SELECT g.*, (sum(g.v) OVER (PARTITION BY g.source ORDER BY g.h_))::BIGINT AS upto, t.source_size, t.target,
        coalesce(least(floor(t.target / nullif(t.source_size, 0))::BIGINT, 2), 2) AS whole
      FROM g JOIN t ON g.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, target - whole * source_size AS left_ FROM c),
y AS (SELECT source, min(struct_pack(h := h_, upto := upto, v := v, l := left_)) AS b FROM x WHERE upto > left_ GROUP BY source),
z AS (SELECT source, b.h + CASE WHEN b.upto - b.l < b.l - (b.upto - b.v) THEN 1 ELSE 0 END AS below FROM y),
f AS (SELECT d.*, x.source_size, x.target, x.whole + CASE WHEN d.h_ < coalesce(z.below, 0) THEN 1 ELSE 0 END AS copies
      FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.h_ = x.h_ LEFT JOIN z ON d.source IS NOT DISTINCT FROM z.source)
SELECT {out} FROM f
"""
SQL = {"op2_mix": MIX_SQL.format(docs="documents", out="doc_id, size_ AS size, source_size, target, (size_ * copies)::BIGINT AS taken")}
