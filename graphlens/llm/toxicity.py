"""Toxicity scores by a counterfactual-regularised classifier.

A logistic model over the presence of words and word prefixes is fitted to labelled rows. Each
fitted text that mentions a group also has a counterpart in which its identity terms are swapped
for others of the same kind; the squared change of the model's logit between the two is a penalty,
so a neutral mention of a group does not move the score.

Fitting reads a bounded sample: of each label at most ``MAX_PER_CLASS`` different pairs of id and text, those
with the smallest hash of their id. Features come from statistics over that sample. Rows without a
label, a label other than 0 or 1, or without an id do not take part; if an id has several labels, the
largest holds. Repeated rows count once. With no labelled rows every score is 0. A null or empty text is
scored as one without words. Texts of any length are read whole. Scores depend on the text alone, so
equal texts score alike. Other columns pass through.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphlens.llm.common import checkpointed, fold, table

MAX_PER_CLASS = 8000
#: Partitions of the sample.
SAMPLE_PARTS = 64
MAX_FEATURES = 6000
MIN_DF = 4
PREFIXES = (4, 5, 6, 7)
#: Standard errors taken off a feature's log odds ratio before it counts.
DOUBT = 1.5
L2, PENALTY, ROUNDS, RATE = 1e-3, 1.0, 300, 0.05
#: 0: every row weighs the same; 1: both classes weigh the same.
BALANCE = 0.5
#: Scale of the features of identity terms, whose own log odds play no part.
TERM_SCALE = 0.5
#: Words whose features a worker remembers at most.
CACHE = 400_000
_WORD = re.compile(r"[^\W\d_]+")

# Terms that name groups of people, by kind and language. Swaps stay within a line.
IDENTITY_TERMS = """
women men girls boys
woman man girl boy
female male
christians muslims jews hindus buddhists atheists
christian muslim jewish hindu buddhist atheist
gay lesbian straight bisexual transgender
black white asian latino african european
immigrants refugees foreigners migrants natives
mexican chinese indian german french spanish american turkish polish
frauen männer mädchen jungen
christen muslime juden hindus atheisten
schwarze weiße asiaten afrikaner europäer
einwanderer flüchtlinge ausländer migranten
femmes hommes filles garçons
chrétiens musulmans juifs athées
noirs blancs asiatiques africains européens
immigrés réfugiés étrangers migrants
mujeres hombres niñas niños
cristianos musulmanes judíos ateos
negros blancos asiáticos africanos europeos
inmigrantes refugiados extranjeros migrantes
"""
SWAPS: dict[str, str] = {}
for _line in IDENTITY_TERMS.split("\n"):
    _terms = _line.split()
    for _a, _b in zip(_terms, _terms[1:] + _terms[:1], strict=True):
        SWAPS.setdefault(_a, _b)


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features(word: str) -> list[int]:
    """Ids of a word and of its prefixes."""
    b = zlib.crc32(word.encode())
    return [b, *(zlib.crc32(b"^" + word[:n].encode()) for n in PREFIXES if len(word) > n)]


def swapped(found: set[str]) -> set[str]:
    return {SWAPS.get(w, w) for w in found}


class Index:
    """Positions of the chosen features among a text's words."""

    def __init__(self, ids: list[int]) -> None:
        self.at = {f: i for i, f in enumerate(ids)}
        self.seen: dict[str, tuple[int, ...]] = {}

    def __call__(self, found: set[str]) -> list[int]:
        out: set[int] = set()
        seen, at = self.seen, self.at
        for w in found:
            hit = seen.get(w)
            if hit is None:
                if len(seen) >= CACHE:
                    seen.clear()
                hit = seen[w] = tuple(at[f] for f in features(w) if f in at)
            if hit:
                out.update(hit)
        return sorted(out)


def sample(docs: DataFrame, labels: DataFrame, usable: Column, max_per_class: int = MAX_PER_CLASS) -> tuple[DataFrame, dict[int, int]]:
    """The different texts to fit on (text, y), and how many labelled ids there are of each class."""
    known = labels.where(usable & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rank = F.xxhash64(F.lit(11), "doc_id")
    parts = [known.where(F.col("y") == y).orderBy(rank, "doc_id").limit(max_per_class) for y in (0, 1)]
    # At most 2 * max_per_class ids. An id may stand for several texts, so rows are chosen again, by the hash of their text.
    named = docs.join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id").select("doc_id", "y", F.xxhash64("text").alias("h")).distinct()
    parts = [named.where(F.col("y") == y).orderBy(rank, "doc_id", "h").limit(max_per_class) for y in (0, 1)]
    chosen = checkpointed(parts[0].unionByName(parts[1]))
    # Only now are texts read, those of the chosen rows, and dealt out; no sort or limit holds a text.
    texts = docs.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "h"]).repartition(SAMPLE_PARTS, "doc_id", "h")
    return checkpointed(texts.dropDuplicates(["doc_id", "h"]).select("text", "y")), totals


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        parts = []
        for y in (0, 1):
            ids = [np.unique([f for w in words(t) for f in features(w)]) for t in b["text"][b["y"] == y]]
            f, n = np.unique(np.concatenate(ids), return_counts=True) if ids else (np.array([]), np.array([]))
            parts.append(pd.DataFrame({"f": f.astype("int64"), "pos": n * y, "neg": n * (1 - y)}).astype("int64"))
        yield pd.concat(parts)


def choose(texts: DataFrame, n_pos: int, n_neg: int, max_features: int = MAX_FEATURES) -> tuple[list[int], np.ndarray]:
    """The features whose odds differ most between the classes, and the identity terms; with each
    its scale: how far its log odds ratio is surely from zero."""
    df = texts.mapInPandas(_counts, "f long, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    odds = F.log((F.col("p") + 0.5) / (n_pos - F.col("p") + 0.5)) - F.log((F.col("n") + 0.5) / (n_neg - F.col("n") + 0.5))
    scale = F.abs(odds) - DOUBT * F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("n") + 0.5))
    best = df.where(F.col("p") + F.col("n") >= MIN_DF).select("f", scale.alias("scale")).where("scale > 0").orderBy(F.desc("scale"), "f").limit(max_features).collect()
    scales = {r["f"]: r["scale"] for r in best} | {zlib.crc32(w.encode()): TERM_SCALE for w in {*SWAPS, *SWAPS.values()}}
    ids = sorted(scales)
    return ids, np.array([scales[f] for f in ids])


def _rows(index: Index):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [words(t) for t in b["text"]]
            other = [swapped(f) for f in found]
            yield pd.DataFrame({"y": b["y"].to_numpy(), "x": [index(f) for f in found], "swap": [index(o) if o != f else None for f, o in zip(found, other, strict=True)]})

    return run


def fit(x: list[list[int]], y: np.ndarray, swap: list[list[int] | None], scale: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise weighted log loss + L2 (on weight / scale) + the counterfactual
    penalty, by Adam over all rows at once."""

    def sparse(rows):
        return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([np.asarray(r, dtype=np.int64) for r in rows] or [np.array([], dtype=np.int64)])

    n = len(scale)
    r, c = sparse(x)
    pairs = [i for i, s in enumerate(swap) if s is not None]
    r0, c0 = sparse([x[i] for i in pairs])
    r1, c1 = sparse([swap[i] for i in pairs])
    w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    weight = weight / weight.sum()
    for t in range(1, ROUNDS + 1):
        e = w[:-1] * scale
        logit = np.bincount(r, e[c], minlength=len(y)) + w[-1]
        err = weight * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y)
        g = np.bincount(c, err[r], minlength=n)
        if pairs:
            d = (np.bincount(r0, e[c0], minlength=len(pairs)) - np.bincount(r1, e[c1], minlength=len(pairs))) * 2 * PENALTY / len(pairs)
            g = g + np.bincount(c0, d[r0], minlength=n) - np.bincount(c1, d[r1], minlength=n)
        g = np.append(g * scale + 2 * L2 * w[:-1], err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1] * scale, float(w[-1])


def train(docs: DataFrame, labels: DataFrame, usable: Column, max_per_class: int = MAX_PER_CLASS) -> tuple[list[int], np.ndarray, float]:
    """Feature ids, weights and bias. ``usable`` says which rows of labels may be learned from."""
    texts, totals = sample(docs, labels, usable, max_per_class)
    n = {0: 0, 1: 0} | {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n[1]:
        return [], np.zeros(0), -40.0
    if not n[0]:
        return [], np.zeros(0), 40.0
    ids, scale = choose(texts, n[1], n[0])
    rows = texts.mapInPandas(_rows(Index(ids)), "y int, x array<int>, swap array<int>").collect()
    rows.sort(key=lambda r: (r["y"], len(r["x"]), r["x"]))
    y = np.array([r["y"] for r in rows], dtype=float)
    most = max(totals.values())
    weight = {k: totals[k] * (most / totals[k]) ** BALANCE / max(1, int((y == k).sum())) for k in (0, 1)}
    w, b = fit([r["x"] for r in rows], y, [r["swap"] for r in rows], scale, np.array([weight[int(k)] for k in y]))
    return ids, w, b


def scorer(spark: SparkSession, model: tuple[list[int], np.ndarray, float]):
    """A column function: whole text -> probability of label 1."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids, w, b = shared.value
        index = Index(ids)
        for s in texts:
            logits = np.array([w[index(words(t))].sum() + b for t in s], dtype=float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(logits, -500, 500))), index=s.index)

    return score


HELD_OUT = 5


def _usable() -> Column:
    return fold("doc_id", HELD_OUT) != 0


def scored(docs: DataFrame, training_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """row (struct of the input's columns), score."""
    score = scorer(docs.sparkSession, train(training_docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), _usable()))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), score(F.col("text")).alias("score"))


def drop_toxic(docs: DataFrame, training_docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    return scored(docs, training_docs, labels).where(F.col("score") < limit).select("row.*")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs.select("doc_id", "text"), docs, table(spark, sf_dir, "labels"))
    return out.select("row.doc_id", "score").select("doc_id", (fold("doc_id", HELD_OUT) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
