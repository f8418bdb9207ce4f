"""Language identification against plain Python, and odd texts."""

import math
from collections import Counter

import numpy as np
import pytest

from graphlens.llm import langid
from graphlens.llm.common import fold
from tests.conftest import SF
from tests.llm.cases import write


def plain_vector(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    if not words:
        return None
    b, counts = f" {' '.join(words)} ".encode(), Counter()
    for size, (salt, factors) in {2: (0, (257,)), 3: (7919, (257, 263)), 4: (2 * 7919, (257, 263, 269))}.items():
        for i in range(len(b) - size + 1):
            h = b[i]
            for f, c in zip(factors, b[i + 1 : i + size], strict=True):
                h = (h * f + c) % 2**32
            counts[((h + salt) * 2654435761 % 2**32) >> 20] += 1
    norm = math.sqrt(sum(counts.values()))
    return {k: math.sqrt(v) / norm for k, v in counts.items()}


def plain_predict(model, text):
    x = plain_vector(text)
    if x is None or not model.langs:
        return "und", 0.0
    dot = lambda w: sum(float(w[k]) * v for k, v in x.items())
    z = [4 * dot(w) for w in model.family_w]
    sure = max(math.exp(v - max(z)) for v in z) / sum(math.exp(v - max(z)) for v in z)
    langs, pairs, w = model.pairs[model.families[z.index(max(z))]]
    if len(langs) == 1:
        return langs[0], sure
    margins = [dot(v) for v in w]
    won = lambda i: sum((a == i and m >= 0) or (b == i and m < 0) for (a, b), m in zip(pairs, margins, strict=True))
    total = lambda i: sum(m if a == i else -m for (a, b), m in zip(pairs, margins, strict=True) if i in (a, b))
    best = max(range(len(langs)), key=lambda i: (won(i), total(i), -i))
    odds = [1 / (1 + math.exp(-3 * (m if a == best else -m))) for (a, b), m in zip(pairs, margins, strict=True) if best in (a, b)]
    return langs[best], sure * sum(odds) / (len(langs) - 1)


def test_predictions_match_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs, fold("doc_id", 4) != 2)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.op1_langid(spark, SF).collect()}
    for i, text in texts.items():
        lang, score = plain_predict(model, text)
        assert got[i][0] == lang and got[i][1] == pytest.approx(score, abs=1e-3)


def test_numbers_are_no_letters(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs, fold("doc_id", 4) != 2)
    for text in ("\u00b2", "\u00bd \u2460 12", "123", "_", "\u2168\u2082", "\u0301", ""):
        assert model.predict(text) == ("und", 0.0)
    assert model.predict("a")[0] != "und" and model.predict("\u4e00")[0] != "und"


def test_blocks_give_the_n_grams_of_the_whole(monkeypatch):
    text = " ".join(f"w\u00f6rd{'x' * (i % 40)} 12, l'\u00e9t\u00e9" for i in range(300))
    whole = langid.vector(text)
    for size in (1, 7, 100):
        monkeypatch.setattr(langid, "BLOCK", size)
        assert np.array_equal(langid.vector(text), whole)


def test_copies_do_not_fill_the_sample(spark, tmp_path):
    rows = [(i, "the same words in many copies here", "en") for i in range(3000)] + [(5000 + i, f"der Hund und die Katze gehen heute nach Haus {chr(97 + i % 26)}{chr(97 + i // 26)}", "de") for i in range(60)]
    rows += [(6000 + i, f"the dog and the cat go home today {chr(97 + i)}", "en") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [tuple(r) for r in langid.sample(docs, fold("doc_id", 1) == 0).collect()]
    assert len(got) == len(set(got)) == 60 + 21
    d = write(docs, tmp_path)
    assert {r["lang_pred"] for r in langid.op1_langid(spark, d).where("doc_id between 6000 and 6019").collect()} == {"en"}
