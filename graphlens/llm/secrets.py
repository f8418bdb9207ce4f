"""Secret scans: regular expressions, and sliding-window entropy of candidate strings.

Candidates are runs of one character class (hexadecimal, base64) of at least ``WINDOW`` characters.
A window moves along each; the sum of n * log2(n) over its character counts changes only by the
character that enters and the one that leaves, which gives the Shannon entropy at every step.
A run whose highest entropy reaches its class's threshold is reported as kind ``entropy`` unless
the allow list knows its make, or a base span overlaps it.

All steps are DataFrame functions, row by row. A null text counts as empty; it has no spans and
the digest of the empty text. Texts and candidates of any length are read whole, in time that grows
in proportion. Equal rows get equal spans. Other columns play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.llm.common import table
from graphlens.llm.spans import joined, of_kind, with_matches

KINDS = ("assign", "access", "hex")
WINDOW = 20
#: Least window entropy, in bits, by class.
THRESHOLDS = {"hex": 2.8, "base64": 3.7}

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]++"
# Maximal runs, so the short ones, which would be dropped, need not match at all.
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
CANDIDATES = {"hex": r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{20,}+", "base64": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"}

#: The characters of each class, whose places in it number the cells of the counts.
ALPHABETS = {
    "hex": "0123456789abcdefABCDEF",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-",
}

# Makes of strings that are random-looking but no secrets: expressions over the whole
# candidate, and stand-ins within it, in lower case.
ALLOWED = (
    r"[0-9]++",  # numbers
    r"[A-Za-z_-]++",  # words, also joined ones
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",  # uuids
)
STAND_INS = ("example", "sample", "placeholder", "changeme", "lorem", "abcdefgh", "12345678")
#: Paths and slugs are allowed if all their parts are at most so long.
SHORT_NAME = 12


def allowed(text: Column) -> Column:
    """Whether the allow list knows a candidate's make."""
    names = F.forall(F.split(text, "[/-]"), lambda part: F.length(part).between(1, SHORT_NAME)) & ~F.contains(text, F.lit("+"))
    known = (text.rlike("[/-]") & names) | text.rlike("^(?:" + "|".join(ALLOWED) + ")$")
    for word in STAND_INS:
        known = known | F.contains(F.lower(text), F.lit(word))
    return known


def window_entropy(text: Column, alphabet: str, width: int = WINDOW) -> Column:
    """The highest Shannon entropy of ``width`` neighbouring characters of an alphabet, by incremental counts.

    The counts are a string with a letter for each character of the alphabet; a step writes the letter of
    the character that enters and that of the one that leaves, and changes the sum by their two terms."""
    term = lambda n: n * math.log2(n) if n else 0.0
    gain = F.array(*[F.lit(term(n + 1) - term(n)) for n in range(width + 1)])
    codes = F.transform(F.split(text, ""), lambda c: F.position(c, F.lit(alphabet)))
    moves = F.zip_with(codes, F.slice(F.concat(F.array_repeat(F.lit(0), width), codes), F.lit(1), F.length(text)), lambda new, old: F.struct(new.alias("new"), old.alias("old")))
    zero = F.struct(F.lit(0).alias("i"), F.lit("A" * len(alphabet)).alias("n"), F.lit(0.0).alias("s"), F.lit(1e9).alias("low"))
    count = lambda n, at: F.ascii(F.substring(n, at, F.lit(1))) - ord("A")
    written = lambda n, at, value: F.overlay(n, F.char(value + ord("A")), at, F.lit(1))

    def step(acc: Column, move: Column) -> Column:
        n, new, old = acc["n"], move["new"], move["old"]
        had, gone = count(n, new), count(n, old)
        more, less = F.element_at(gain, had + 1), F.element_at(gain, gone)
        s = acc["s"] + F.when(old == new, F.lit(0.0)).when(old == 0, more).otherwise(more - less)
        entered = written(n, new, had + 1)
        counts = F.when(old == new, n).when(old == 0, entered).otherwise(written(entered, old, gone - 1))
        return F.struct((acc["i"] + 1).alias("i"), counts.alias("n"), s.alias("s"), F.when(acc["i"] + 1 >= width, F.least(acc["low"], s)).otherwise(acc["low"]).alias("low"))

    return F.lit(math.log2(width)) - F.aggregate(moves, zero, step, lambda acc: acc["low"]) / width


def secrets(docs: DataFrame) -> DataFrame:
    """row (struct of the input's columns), base and more: arrays of struct(start, rank, kind, end)."""
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce("text", F.lit("")).alias("t"))
    df = with_matches(df, "_assign", "t", ASSIGN, group=2, guard=F.col("t").rlike("(?i:passw|secret|token|api_?key)"))
    df = with_matches(df, "_access", "t", ACCESS, guard=F.contains("t", F.lit("AKIA")))
    df = with_matches(df, "_hex", "t", HEX)
    for name, pattern in CANDIDATES.items():
        df = with_matches(df, f"_{name}_run", "t", pattern)
    spans = lambda found, kind, rank: F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end")))
    good = {"assign": F.filter("_assign", lambda m: F.length(m["group"]) >= 6), "access": F.filter("_access", lambda m: F.length(m["text"]) >= 20), "hex": F.col("_hex")}
    own = F.concat(*[spans(good[k], k, r) for r, k in enumerate(KINDS)])
    df = df.select("row", own.alias("base"), *[f"_{name}_run" for name in CANDIDATES])

    def fresh(name: str) -> Column:
        apart = F.filter(f"_{name}_run", lambda c: ~F.exists("base", lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])))
        return F.filter(F.filter(apart, lambda c: ~allowed(c["text"])), lambda c: window_entropy(c["text"], ALPHABETS[name]) >= THRESHOLDS[name])

    more = F.array_distinct(F.concat(*[spans(fresh(name), "entropy", len(KINDS)) for name in CANDIDATES]))
    return df.select("row", "base", more.alias("more"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [of_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS]
    return out.select(F.col("row.doc_id").alias("doc_id"), *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "more")).alias("spans"))
