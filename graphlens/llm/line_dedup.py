"""Cross-site line removal by distinct-site spread.

Every line is a 128-bit pair of hashes of its trimmed text. One aggregation builds a HyperLogLog
sketch of the sites of each line where the texts are read, and merges them by line. Lines whose
estimate lies near the threshold get an exact distinct count. A line on at least ``min_sites`` sites
is boilerplate: it stays where it occurs first (in the row with the smallest id, at its first
position there) and is removed elsewhere, so that copies of whole documents keep one whole copy.

Blank lines never count and are never removed. A null source is a site of its own. A null text
stays null, an empty one empty. Rows equal in id and text are treated alike. An empty table gives
an empty result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.llm.common import checkpointed, join_small, row_key, table

MIN_SITES = 8
#: log2 of the registers of a sketch, and the band around the threshold that is counted exactly
#: (over 30 standard errors at this size).
LG_K, BAND = 12, 0.5


def _lines(docs: DataFrame) -> DataFrame:
    """k, doc_id, site, pos, a, b: a row for each line that is not blank."""
    trimmed = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(" \t\r\u000b\f")))
    marks = F.transform(trimmed, lambda x, i: F.struct(i.alias("pos"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), (x == "").alias("blank")))
    rows = docs.select(row_key().alias("k"), "doc_id", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("site"), F.explode(marks).alias("m"))
    return rows.select("k", "doc_id", "site", "m.pos", "m.a", "m.b", "m.blank").where(~F.col("blank")).drop("blank")


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """k, pos, first: the places of the lines on at least ``min_sites`` sites, and where each such line occurs first."""
    lines = _lines(docs)
    guess = lines.groupBy("a", "b").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("n"))
    spread = checkpointed(guess.where(F.col("n") >= min_sites * (1 - BAND)).select("a", "b", (F.col("n") > min_sites * (1 + BAND)).alias("sure")))
    here = checkpointed(join_small(lines, spread, ["a", "b"]))
    exact = here.where(~F.col("sure")).select("a", "b", "site").distinct().groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites)
    found = checkpointed(spread.where("sure").select("a", "b").unionByName(exact.select("a", "b")))
    here = join_small(here.drop("sure", "site"), found, ["a", "b"])
    first = here.groupBy("a", "b").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k", "pos")).alias("first"))
    return join_small(here, checkpointed(first), ["a", "b"]).select("k", "pos", "first")


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """row (struct of the input's columns), kept (text without removed lines), n_lines, n_removed."""
    other = (F.col("k") != F.col("first.k")) | (F.col("pos") != F.col("first.pos"))
    gone = checkpointed(boilerplate(docs, min_sites).where(other).groupBy("k").agg(F.collect_set("pos").alias("gone")))
    rows = join_small(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key().alias("k")), gone, ["k"], "left")
    lines = F.split(F.col("row.text"), "\n", -1)
    kept = F.array_join(F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), F.coalesce(F.array_contains("gone", i), F.lit(False)).alias("no"))), lambda s: ~s["no"])["x"], "\n")
    return rows.select("row", F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(kept).alias("kept"), F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select(F.col("row.doc_id").alias("doc_id"), F.when(F.col("row.text").isNull(), F.lit(0)).otherwise(F.col("n_lines")).cast("long").alias("n_lines"), "n_removed", F.col("kept").alias("text"))


#: {docs}: the table or query; {out}: columns of f (with its kept text).
LINES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r_, * FROM {docs}),
e AS (SELECT r_, doc_id, coalesce('s' || source, '') AS site, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM d),
n AS (SELECT r_, doc_id, site, pos, line, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS t FROM e),
b AS (SELECT t, arg_min(r_, struct_pack(d := doc_id, p := pos)) AS fr, arg_min(pos, struct_pack(d := doc_id, p := pos)) AS fp FROM n WHERE t <> '' GROUP BY t HAVING count(DISTINCT site) >= {min_sites}),
m AS (SELECT n.*, b.t IS NOT NULL AND NOT (n.r_ = b.fr AND n.pos = b.fp) AS gone FROM n LEFT JOIN b ON n.t = b.t),
g AS (SELECT r_, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS kept, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_removed FROM m GROUP BY r_),
f AS (SELECT d.*, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(g.kept, '') END AS kept, CASE WHEN d.text IS NULL THEN 0 ELSE g.n_lines END AS n_lines, g.n_removed FROM d JOIN g USING (r_))
SELECT {out} FROM f
"""
SQL = {"op10_line_dedup": LINES_SQL.format(docs="documents", min_sites=MIN_SITES, out="doc_id, n_lines, n_removed, kept AS text")}
