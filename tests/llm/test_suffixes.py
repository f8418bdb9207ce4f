"""Removal of repeated strings against all windows in plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from graphlens.llm import suffixes
from tests.llm.cases import LONG, docs

L = suffixes.LENGTH


def plain(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + L] for d in data for i in range(len(d) - L + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), dtype=bool)
        for i in range(len(d) - L + 1):
            if seen[d[i : i + L]] > 1:
                gone[i : i + L] = True
        kept = bytes(np.frombuffer(d, dtype=np.uint8)[~gone])
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed=1):
    """Copies, near copies, passages that end in different text, repeats inside a text, runs of one letter, UTF-8."""
    r = random.Random(seed)
    prose = lambda n: "".join(r.choice("abcdefgh ijk é日") for _ in range(n))
    base, passage, line = prose(2500), prose(700), prose(430)
    out = [base, base, base[:1200] + "X" + base[1201:], base[300:900], passage * 3]
    out += [prose(r.randrange(300)) + passage[r.randrange(200) : 450 + r.randrange(250)] + prose(r.randrange(300)) for _ in range(25)]
    out += [prose(50) + line + prose(50) for _ in range(12)]
    out += ["a" * 900, "a" * 399, "a" * 400, "ab" * 500 + prose(100), "\0" * 850, "\0" * 500 + prose(100), prose(100) + "\0" * 450, None, "", prose(399), prose(5000)]
    return out + out[-1:] + [base[-500:] + passage[:350], base[-500:] + passage[:351]]


@pytest.mark.parametrize("bucket", [suffixes.BUCKET, 1, 5])
def test_equals_all_windows(spark, bucket):
    """Small buckets are counted by digest; both ways must agree."""
    texts = corpus()
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)]
    got = suffixes.without_repeats(docs(spark, rows).repartition(3), bucket=bucket).collect()
    assert {r["doc_id"]: tuple(r[1:5]) for r in got} == dict(enumerate(plain(texts)))
    for r in got:
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and sum(s["hi"] - s["lo"] for s in r["spans"]) == r["n_removed"]


@pytest.mark.parametrize("seed", range(3))
def test_random_edits_of_copies(spark, seed):
    r = random.Random(seed)
    base = "".join(r.choice("abcdefghij ") for _ in range(4000))
    texts = []
    for _ in range(30):
        t = list(base[r.randrange(1000) : 2500 + r.randrange(1500)])
        for _ in range(r.randrange(6)):
            t[r.randrange(len(t))] = r.choice(["", "Z", "QQQ"])
        texts.append("".join(t))
    got = suffixes.without_repeats(docs(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)])).collect()
    assert {x["doc_id"]: tuple(x[1:5]) for x in got} == dict(enumerate(plain(texts)))


def test_repeated_rows_null_ids_and_long_texts(spark):
    texts = [LONG, LONG[:200_000], "x" + LONG[100:], None, None, "short"]
    rows = [(None if i == 4 else 7, t, None, None, 0) for i, t in enumerate(texts)] * 2
    got = sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.without_repeats(docs(spark, rows), texts=False).collect())
    assert got == sorted(plain(texts * 2))


def test_empty_table(spark):
    assert suffixes.without_repeats(docs(spark, [])).count() == 0


def test_phrases_in_parts_cover_all_windows(monkeypatch):
    text = "".join(random.Random(2).choice("abcdefg ") for _ in range(5000)).encode()
    whole = [(e, i) for es, lo, hi in suffixes.phrases(text) for e, p, q in zip(es.tolist(), lo.tolist(), hi.tolist(), strict=True) for i in range(p, q + 1)]
    assert [i for _, i in whole] == list(range(len(text) - L + 1)) and all(0 <= e - i < suffixes.SPAN for e, i in whole)
    monkeypatch.setattr(suffixes, "PART", 333)
    assert [(e, i) for es, lo, hi in suffixes.phrases(text) for e, p, q in zip(es.tolist(), lo.tolist(), hi.tolist(), strict=True) for i in range(p, q + 1)] == whole


def test_trigger_is_told_by_the_window_alone():
    r = random.Random(4)
    window = "".join(r.choice("abc") for _ in range(L)).encode()
    places = set()
    for _ in range(20):
        head = bytes(r.choice(b"abc") for _ in range(r.randrange(300)))
        text = head + window + bytes(r.choice(b"abc") for _ in range(r.randrange(300)))
        for es, lo, hi in suffixes.phrases(text):
            k = int(np.flatnonzero((lo <= len(head)) & (len(head) <= hi))[0])
            places.add(int(es[k]) - len(head))
    assert len(places) == 1
