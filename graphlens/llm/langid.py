"""Language identification by hierarchical discrimination.

A softmax model over hashed letter n-grams tells the language family first. Within a family of
several languages, one-versus-one linear support vector machines vote; ties go to the larger sum
of margins. The languages are the non-null values of the training rows.

Fitting reads a bounded sample: at most ``PER_LANGUAGE`` different texts of each language and about
``MAX_TEXTS`` in all, and short windows of their words, so that short texts are told apart as well.
Copies of a text count once. A null text, or one without a letter, is ``und`` with score 0; numbers
that are no digits, such as superscripts and fractions, are no letters. Without training rows every
text is. Predictions depend on the text alone, so repeated rows agree. Very long texts are read in
blocks, which give the same n-grams as the whole. Other columns play no part.
"""

from __future__ import annotations

import functools
import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlens.llm.common import checkpointed, fold, join_small, table

PER_LANGUAGE, MAX_TEXTS = 200, 1500
DIMS = 4096
L2, ROUNDS = np.float32(1e-4), 100
#: Lengths in words of the windows that are fitted beside whole texts.
WINDOWS = (1, 2, 4, 12)
#: Characters that are folded and counted at a time.
BLOCK = 1 << 20

# Language families by ISO 639-1 code. Codes that are not listed form one family.
FAMILIES = """
germanic: en de nl sv da no nb nn is af lb fy yi
romance: fr es it pt ro ca gl oc la
slavic: ru uk be pl cs sk bg sr hr bs sl mk
uralic: fi et hu
baltic: lt lv
celtic: ga gd cy br
turkic: tr az kk uz ky tk tt
semitic: ar he mt am
iranian: fa ku ps tg
indic: hi ur bn pa gu mr ne si
dravidian: ta te kn ml
sinitic: zh yue
japonic: ja
koreanic: ko
"""
FAMILY = {code: line.split(":")[0] for line in FAMILIES.strip().split("\n") for code in line.split(":")[1].split()}


@functools.cache
def _not_letters() -> re.Pattern:
    """Runs of characters that are no letters: of those that count as parts of words, also the numbers."""
    numbers = (chr(c) for c in range(128, sys.maxunicode + 1) if chr(c).isnumeric() and not chr(c).isalpha())
    return re.compile(rf"[\W\d_{''.join(numbers)}]+")


_MOSTLY = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    part = _MOSTLY.sub(" ", text.lower()).strip()
    # The large class is slow, and few texts hold a number that is no digit.
    return part if part.replace(" ", "").isalpha() else _not_letters().sub(" ", part).strip()


def pieces(text: str) -> Iterator[bytes]:
    """The letters of a text in blocks that end between words."""
    at = 0
    while at < len(text):
        cut = _not_letters().search(text, at + BLOCK) if at + BLOCK < len(text) else None
        end = cut.start() if cut else len(text)
        part = letters(text[at:end])
        if part:
            yield part.encode()
        at = cut.end() if cut else end


def vector(text: str | None) -> np.ndarray | None:
    """Square roots of hashed counts of the UTF-8 2-, 3- and 4-grams of a whole text's letters, of length 1."""
    counts, last = np.zeros(DIMS, dtype=np.int64), b""
    for part in pieces(text or ""):
        new = part + b" " if last else b" " + part + b" "
        b = np.frombuffer(last + new, dtype=np.uint8).astype(np.uint32)
        two = b[:-1] * np.uint32(257) + b[1:]
        three = two[:-1] * np.uint32(263) + b[2:]
        four = three[:-1] * np.uint32(269) + b[3:]
        for n, grams in enumerate((two, three, four)):
            grams = grams[max(0, len(last) - 1 - n) :]  # those that end in the new part
            counts += np.bincount(((grams + np.uint32(n * 7919)) * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMS)
        last = (last + new)[-3:]
    if not last:
        return None
    x = np.sqrt(counts)
    return (x / np.linalg.norm(x)).astype(np.float32)


def _examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for lang, text in zip(b["lang"], b["text"], strict=True):
            words = letters(text).split()
            at = [(n, (len(words) * (i + 1) // (len(WINDOWS) + 1))) for i, n in enumerate(WINDOWS)]
            for piece in (text, *(" ".join(words[p : p + n]) for n, p in at)):
                x = vector(piece)
                if x is not None:
                    i = np.flatnonzero(x)
                    out.append((lang, i.tolist(), x[i].tolist()))
        yield pd.DataFrame(out, columns=["lang", "i", "v"])


def sample(docs: DataFrame, usable: Column) -> DataFrame:
    """lang, text: of each language the PER_LANGUAGE different texts with the smallest hashes, fewer of each if
    that is more than MAX_TEXTS in all."""
    known = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    sizes = checkpointed(known.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64(F.lit(5), "text")).alias("n")))
    each = min(PER_LANGUAGE, MAX_TEXTS // max(1, sizes.count()) + 1)
    rank = F.pmod(F.xxhash64(F.lit(5), "text"), F.lit(1 << 40)) / float(1 << 40)
    near = join_small(known, sizes, ["lang"]).where(rank * F.col("n") < 2.0 * each + 50).select("lang", "text").distinct()
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(5), "text"), "text"))
    return near.withColumn("_n", first).where(F.col("_n") <= each).select("lang", "text")


def _softmax_fit(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    w = prev = np.zeros((k, x.shape[1]), dtype=np.float32)
    one = np.eye(k, dtype=np.float32)[y]
    weight = (1 / np.maximum(1, np.bincount(y, minlength=k)))[y]
    weight = (weight / weight.sum()).astype(np.float32)[:, None]
    for t in range(ROUNDS):
        ahead = w + np.float32(t / (t + 3)) * (w - prev)
        z = x @ ahead.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        prev, w = w, ahead - np.float32(2) * (((p - one) * weight).T @ x + L2 * ahead)
    return w


def _svm_fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared-hinge linear SVM for y in {-1, 1}, by accelerated gradient steps."""
    w = prev = np.zeros(x.shape[1], dtype=np.float32)
    y = y.astype(np.float32)
    weight = (np.where(y > 0, 1 / max(1, (y > 0).sum()), 1 / max(1, (y < 0).sum())) / 2).astype(np.float32)
    for t in range(ROUNDS):
        ahead = w + np.float32(t / (t + 3)) * (w - prev)
        gap = np.maximum(0, 1 - y * (x @ ahead))
        prev, w = w, ahead - np.float32(0.5) * (-2 * (weight * y * gap) @ x + L2 * ahead)
    return w


class Model:
    def __init__(self, langs: list[str], families: list[str], family_w: np.ndarray, pairs: dict[str, tuple[list[str], list[tuple[int, int]], np.ndarray]]) -> None:
        self.langs, self.families, self.family_w, self.pairs = langs, families, family_w, pairs

    def predict(self, text: str | None) -> tuple[str, float]:
        x = vector(text) if self.langs else None
        if x is None:
            return "und", 0.0
        z = self.family_w @ x
        p = np.exp(4 * (z - z.max()))
        f = int(np.argmax(p))
        sure = float(p[f] / p.sum())
        langs, pairs, w = self.pairs[self.families[f]]
        if len(langs) == 1:
            return langs[0], sure
        margins = w @ x
        votes, sums, prob = np.zeros(len(langs)), np.zeros(len(langs)), np.zeros(len(langs))
        for (a, b), m in zip(pairs, margins, strict=True):
            votes[a if m >= 0 else b] += 1
            sums[a] += m
            sums[b] -= m
            q = 1 / (1 + np.exp(-3 * m))
            prob[a] += q
            prob[b] += 1 - q
        best = max(range(len(langs)), key=lambda i: (votes[i], sums[i], -i))
        return langs[best], sure * float(prob[best] / (len(langs) - 1))


def train(docs: DataFrame, usable: Column) -> Model:
    rows = sample(docs, usable).mapInPandas(_examples, "lang string, i array<int>, v array<float>").collect()
    rows.sort(key=lambda r: (r["lang"], r["i"]))
    langs = sorted({r["lang"] for r in rows})
    families = sorted({FAMILY.get(x, "other") for x in langs})
    x = np.zeros((len(rows), DIMS), dtype=np.float32)
    for k, r in enumerate(rows):
        x[k, r["i"]] = r["v"]
    y = np.array([langs.index(r["lang"]) for r in rows], dtype=int)
    of = np.array([families.index(FAMILY.get(lang, "other")) for lang in langs], dtype=int)
    family_w = _softmax_fit(x, of[y], len(families)) if rows else np.zeros((0, DIMS), dtype=np.float32)
    pairs = {}
    for f, name in enumerate(families):
        own = [i for i in range(len(langs)) if of[i] == f]
        duels = [(a, b) for a in range(len(own)) for b in range(a + 1, len(own))]
        w = np.zeros((len(duels), DIMS), dtype=np.float32)
        for k, (a, b) in enumerate(duels):
            pick = (y == own[a]) | (y == own[b])
            w[k] = _svm_fit(x[pick], np.where(y[pick] == own[a], 1.0, -1.0))
        pairs[name] = ([langs[i] for i in own], duels, w)
    return Model(langs, families, family_w, pairs)


HELD_OUT = (4, 2)


def identified(docs: DataFrame, training_docs: DataFrame) -> DataFrame:
    """row (struct of the input's columns), found (lang_pred, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(train(training_docs, fold("doc_id", HELD_OUT[0]) != HELD_OUT[1]))

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            yield pd.DataFrame([shared.value.predict(t) for t in s], columns=["lang_pred", "score"])

    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), predict("text").alias("found"))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identified(docs.select("doc_id", "text"), docs)
    return out.select("row.doc_id", "found").select("doc_id", (fold("doc_id", HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"), "found.lang_pred", "found.score")
