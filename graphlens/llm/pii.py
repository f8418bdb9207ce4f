"""Personal data by regular expressions and bootstrapped contextual extraction.

Base spans (e-mail, ip, card, phone) are seeds. The words before and after a seed are its lexical
patterns. Tokens with a digit or an at sign outside all base spans are candidates, with patterns
of their own. Patterns and instances form a graph. In each generation the patterns with enough
different known instances are scored in ``ROUNDS`` rounds: a pattern's score is the mean score of its
instances, an instance's the noisy-or of the scores of its other patterns, of those of high score; so no
pattern vouches for itself. Known instances stay at 1, the rest start at 0. Candidates after a word of high score, and of a plausible make for the kind, become known
instances of that kind, and with them their other contexts gain support. Generations go on until none
finds a new instance. What stands after a pattern of high score at the end becomes a span.

All steps are DataFrame functions. A null text counts as empty; it has no spans and the digest of
the empty text. Texts and words of any length are read whole. Rows equal in id and text are learned
from once and all get the same spans. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.llm.common import checkpointed, join_small, row_key, table
from graphlens.llm.spans import joined, of_kind, with_matches

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: A pattern's least number of different seeds and least score.
SUPPORT, CONFIDENCE = 5, 0.9
#: Context words of more characters stand in patterns by their digest.
LONGEST = 40

_LOCAL = "A-Za-z0-9._%+-"
# Possessive forms, and starts at the beginning of a run or right after the last match: the same
# matches as the plain expressions, in linear time.
EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"


def luhn(digits: Column) -> Column:
    """Whether a text of at most 19 digits passes the Luhn test."""
    at = F.sequence(F.lit(1), F.length(digits))
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    value = lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
    return F.aggregate(at, F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, doubled(value(i))).otherwise(value(i))) % 10 == 0


def _edge(piece: Column, last: bool) -> Column:
    """The last or first word of a piece of text, letters only, lower case; empty if there is none."""
    plain = F.trim(F.translate(piece, "\t\n\u000b\f\r", "     "))
    word = F.lower(F.regexp_replace(F.substring_index(plain, " ", -1 if last else 1), r"[^\p{L}]+", ""))
    return F.when(F.length(word) > LONGEST, F.sha2(word, 256)).otherwise(word)


def _mentions(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(KINDS.index(kind) if kind else -1).alias("rank"), m["text"].alias("token"), _edge(m["left"], True).alias("left"), _edge(m["right"], False).alias("right")))


def base(docs: DataFrame) -> DataFrame:
    """k, doc_id, seeds and others: the base spans and the candidate tokens of each row, with contexts."""
    df = docs.select(row_key().alias("k"), "doc_id", F.coalesce("text", F.lit("")).alias("t"))
    df = with_matches(df, "_email", "t", EMAIL, guard=F.contains("t", F.lit("@")))
    df = with_matches(df, "_ip", "t", IP, guard=F.col("t").rlike(r"[0-9]\.[0-9]"))
    df = with_matches(df, "_card", "t", CARD, guard=F.col("t").rlike(r"[0-9](?:[\x20-]?[0-9]){11}"))
    df = with_matches(df, "_phone", "t", PHONE, guard=F.contains("t", F.lit("+")))
    df = with_matches(df, "_token", "t", TOKEN, guard=F.contains("t", F.lit("@")) | F.col("t").rlike("[0-9]"))
    digits = lambda m: F.regexp_replace(m["text"], "[^0-9]", "")
    in_range = lambda m, lo, hi: F.length(digits(m)).between(lo, hi)
    good = {
        "email": F.col("_email"),
        "ip": F.filter("_ip", lambda m: m["text"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
        "card": F.filter("_card", lambda m: F.when(in_range(m, 12, 19), luhn(digits(m))).otherwise(F.lit(False))),
        "phone": F.filter("_phone", lambda m: in_range(m, 9, 15)),
    }
    return df.select("k", "doc_id", F.concat(*[_mentions(good[k], k) for k in KINDS]).alias("seeds"), _mentions(F.col("_token"), "").alias("others"))


def _plausible() -> Column:
    n = F.length(F.regexp_replace("token", "[^0-9]", ""))
    parts = F.length(F.regexp_replace("token", "[^.:]", ""))
    make = {"email": F.contains("token", F.lit("@")), "ip": (n >= 4) & (parts >= 3), "card": n.between(12, 19), "phone": n.between(7, 15)}
    return F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in make.items()], F.lit(False))


def scored_patterns(graph: DataFrame, known: DataFrame, sizes: DataFrame) -> DataFrame:
    """pat, kind, score of the patterns that at least SUPPORT different known instances of a kind share.
    graph: pat, token; known: token, kind; sizes: pat, n (instances of any kind)."""
    edges = join_small(graph, known, ["token"])
    support = edges.groupBy("pat", "kind").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= SUPPORT)
    strong = checkpointed(support.join(sizes, "pat"))
    open_ = join_small(graph, strong.select("pat", "kind"), ["pat"])
    open_ = checkpointed(open_.join(known, ["token", "kind"], "left_anti"))
    score = strong.withColumn("score", F.col("seeds") / F.col("n"))
    for _ in range(ROUNDS - 1):
        # Only patterns of high score speak for an instance: two weak ones that always stand together would else lift each other.
        own = F.when(F.col("score") >= CONFIDENCE, F.log(1 - F.least("score", F.lit(0.999)))).otherwise(F.lit(0.0))
        said = join_small(open_, score.select("pat", "kind", own.alias("own")), ["pat", "kind"])
        instances = said.groupBy("token", "kind").agg(F.sum("own").alias("l"), F.count("*").alias("pats")).where("pats > 1")
        # What a pattern gains from an instance comes from the instance's other patterns alone.
        gained = said.join(instances, ["token", "kind"]).groupBy("pat", "kind").agg(F.sum(1 - F.exp(F.least(F.col("l") - F.col("own"), F.lit(0.0)))).alias("gain"))
        score = checkpointed(strong.join(gained, ["pat", "kind"], "left").withColumn("score", (F.col("seeds") + F.coalesce("gain", F.lit(0.0))) / F.col("n")).drop("gain"))
    return score.select("pat", "kind", "score")


def discovered(rows: DataFrame) -> DataFrame:
    """The output of base() -> k, more (spans that patterns of high score find)."""
    once = rows.where((F.size("seeds") > 0) | (F.size("others") > 0)).groupBy("k").agg(F.first("seeds").alias("seeds"), F.first("others").alias("others"))
    apart = F.filter("others", lambda c: ~F.exists("seeds", lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])))
    said = once.select("k", F.explode(F.concat("seeds", apart)).alias("m")).select("k", "m.*")
    pats = F.array_compact(F.array(*[F.when(F.col(c) != "", F.concat(F.lit(f"{c}:"), F.col(c))) for c in ("left", "right")]))
    said = checkpointed(said.withColumn("pats", pats).drop("left", "right"))
    graph = checkpointed(said.select(F.explode("pats").alias("pat"), "token").distinct())
    sizes = checkpointed(graph.groupBy("pat").agg(F.count("*").alias("n")))
    known = checkpointed(said.where(F.col("kind") != "").select("token", "kind").distinct())
    loose = checkpointed(said.where(F.col("kind") == "").select("k", "start", "end", "token", F.explode("pats").alias("pat")))
    found = 0
    while True:
        score = scored_patterns(graph, known, sizes)
        # A word after an identifier says less than one before it: alone it finds nothing.
        sure = score.where((F.col("score") >= CONFIDENCE) & F.col("pat").startswith("left:"))
        hits = checkpointed(join_small(loose, checkpointed(sure), ["pat"]).where(_plausible()))
        known = checkpointed(known.unionByName(hits.select("token", "kind")).distinct())
        now = hits.select("token", "kind").distinct().count()
        if now == found:
            break
        found = now
    rank = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(KINDS)])
    best = hits.groupBy("k", "start", "end").agg(F.max(F.struct("score", (-rank).alias("r"), "kind")).alias("b"))
    span = F.struct("start", (-F.col("b.r")).alias("rank"), F.col("b.kind").alias("kind"), "end")
    return best.groupBy("k").agg(F.collect_list(span).alias("more"))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base and more: arrays of struct(start, rank, kind, end)."""
    rows = checkpointed(base(docs))
    own = F.transform("seeds", lambda m: F.struct(m["start"].alias("start"), m["rank"].alias("rank"), m["kind"].alias("kind"), m["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    # Only rows with a candidate can gain a span, so rows that share a key for having no text at all do not meet in one task.
    open_, rest = (rows.where(F.size("others") > 0), rows.where(F.size("others") <= 0))
    found = open_.select("k", "doc_id", own.alias("base")).join(checkpointed(discovered(rows)), "k", "left").select("doc_id", "base", F.coalesce("more", none).alias("more"))
    return found.unionByName(rest.select("doc_id", own.alias("base"), none.alias("more")))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = personal_data(table(spark, sf_dir, "documents"))
    counts = [of_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "more")).alias("spans"))
