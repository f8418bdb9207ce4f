"""Toxicity scores against plain Python, and repeated rows."""

import math
import re
import zlib

import numpy as np
import pytest

from graphlens.llm import toxicity
from tests.conftest import SF
from tests.llm.cases import write

GOOD = "the river runs past old houses and many green trees under bright skies".split()
BAD = "you stupid worthless idiots should vanish forever nobody wants such trash".split()


def table_of(copies=1):
    rows, labels = [], []
    for i in range(60):
        y = i % 3 == 0
        rows += [(i, " ".join((BAD if y else GOOD)[(i + j) % 11] for j in range(7)))] * copies
        labels.append((i, int(y)))
    return rows, labels


def model_of(spark, copies, tmp_path):
    rows, labels = table_of(copies)
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels * copies, "doc_id long, toxic int")
    write(docs, tmp_path)
    return docs, known, toxicity.train(docs, known, toxicity._usable())


def test_repeated_rows_teach_the_same(spark, tmp_path):
    _, _, (ids, w, b) = model_of(spark, 1, tmp_path / "one")
    docs, known, (many_ids, many_w, many_b) = model_of(spark, 50, tmp_path / "many")
    assert len(ids) > 10 and many_ids == ids and many_w == pytest.approx(w, abs=1e-9) and many_b == pytest.approx(b, abs=1e-9)
    got = {r["row"]["doc_id"]: r["score"] for r in toxicity.scored(docs, docs, known).collect()}
    assert all((s >= 0.5) == (i % 3 == 0) for i, s in got.items())
    assert toxicity.drop_toxic(docs, docs, known).count() == 40 * 50


def test_an_id_with_several_texts_and_labels(spark):
    rows, labels = table_of()
    docs = spark.createDataFrame([*rows, *((1, f"{GOOD[i % 12]} {i}") for i in range(100)), (None, "x"), (2, None), (2, "")], "doc_id long, text string")
    known = spark.createDataFrame([*labels, (1, 0), (1, None), (2, 7), (None, 1), (999, 1)], "doc_id long, toxic int")
    texts, totals = toxicity.sample(docs, known, toxicity._usable(), max_per_class=30)
    got = texts.groupBy("y").count().collect()
    assert all(r["count"] <= 30 for r in got) and sum(totals.values()) == known.where(toxicity._usable()).where("toxic in (0, 1) and doc_id is not null").select("doc_id").distinct().count()
    assert all(0 <= r["score"] <= 1 for r in toxicity.scored(docs, docs, known).collect())


def plain_score(model, text):
    ids, w, b = model
    weight = dict(zip(ids, w, strict=True))
    found = set()
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        found.add(zlib.crc32(word.encode()))
        found |= {zlib.crc32(b"^" + word[:n].encode()) for n in (4, 5, 6, 7) if len(word) > n}
    return 1 / (1 + math.exp(-(sum(weight.get(f, 0.0) for f in found) + b)))


def test_scores_match_plain_python(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), toxicity._usable())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in toxicity.op8_toxicity(spark, SF).collect():
        assert r["score"] == pytest.approx(plain_score(model, texts[r["doc_id"]]), abs=1e-9)
        assert r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_fit_finds_the_minimum():
    """The gradient of loss and penalties is near zero at the end, by finite differences."""
    rng = np.random.default_rng(5)
    x = [sorted(rng.choice(6, rng.integers(1, 4), replace=False).tolist()) for _ in range(80)]
    y = np.array([float(0 in r or rng.random() < 0.2) for r in x])
    swap = [[1 if f == 2 else f for f in r] if 2 in r else None for r in x]
    scale = np.array([1.0, 0.5, 0.5, 2.0, 1.0, 1.0])
    weight = np.ones(80) / 80
    w, b = toxicity.fit(x, y, swap, scale, np.ones(80))

    def loss(v, c):
        z = np.array([sum(v[f] for f in r) + c for r in x])
        value = (weight * (np.log1p(np.exp(z)) - y * z)).sum() + toxicity.L2 * ((v / scale) ** 2).sum()
        gaps = [sum(v[f] for f in r) - sum(v[f] for f in s) for r, s in zip(x, swap, strict=True) if s is not None]
        return value + toxicity.PENALTY * np.mean(np.square(gaps))

    least = loss(w, b)
    for k in range(6):
        for step in (-0.05, 0.05):
            moved = w.copy()
            moved[k] += step
            assert loss(moved, b) > least - 1e-4
