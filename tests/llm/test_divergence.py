"""Source divergence against SQL and against plain integers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from graphlens.llm import divergence
from tests.llm.cases import LONG, docs


def plain(rows, min_docs):
    by, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        by[lang, source].update(found)
        df[lang].update(set(found))
    out = []
    rank = lambda xs: sorted(xs, key=lambda x: (-x[1], x[0].encode()))
    for lang, source in groups:
        kept = sorted(t for t, n in df[lang].items() if n >= min_docs)
        same = sorted(s for x, s in groups if x == lang)

        def p(c):
            size = sum(c[t] for t in kept) + 2 * len(kept)  # noqa: B023
            return {t: 1 + 10**9 * (c[t] + 2) // size for t in kept}  # noqa: B023

        f = lambda x, y: (x - y) ** 2 // (x + y)
        own, whole = p(by[lang, source]), p(sum((by[lang, s] for s in same), Counter()))
        for s in same:
            if s != source:
                other = p(by[lang, s])
                out.append((lang, source, "pair", s, sum(f(own[t], other[t]) for t in kept)))
        out += [(lang, source, "term", t, f(own[t], whole[t])) for t in kept if by[lang, source][t] and own[t] > whole[t]]
    done = []
    for lang, source in groups:
        for part in ("pair", "term"):
            mine = rank([(r[3], r[4]) for r in out if r[:3] == (lang, source, part)])
            done += [(lang, source, part, t, v, i) for i, (t, v) in enumerate(mine, 1) if part == "pair" or i <= 10]
    return sorted(done)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def random_docs(n=300):
    r = random.Random(11)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ["x", "Y", "é", "日本", "ß", "zz"]]
    sources = [None, "", *(f"s{i}" for i in range(9))]
    return [(i, " ,1".join(r.choices(words, k=r.randrange(60))), r.choice(["en", "de", None]), r.choice(sources), 0) for i in range(n)] + [(1, None, "xx", "only", 0), (2, "few", "yy", "b", 0), (3, "", "yy", "a", 0)]


@pytest.mark.parametrize(("strip", "block", "held"), [(256, 2048, 400_000), (4, 5, 30)])
def test_equals_plain_integers(spark, monkeypatch, strip, block, held):
    """Ranges of strips and blocks, flushed counts, languages without kept terms, nulls, empty names."""
    rows = random_docs()
    assert rows_of(divergence.divergence(docs(spark, rows), block=block, wide=strip)) == plain(rows, divergence.MIN_DOCS)
    batch = pa.RecordBatch.from_pylist([{"lang": r[2] or "", "source": r[3] or "", "text": (r[1] or "").encode()} for r in rows])
    given = lambda: [r for x in divergence._counts(iter([batch])) for r in x.to_pylist()]
    whole = given()
    monkeypatch.setattr(divergence, "HELD", held)
    small = given()
    for c in ("n", "docs"):
        total = lambda out: sum((Counter({(r["lang"], r["source"], r["term"]): r[c]}) for r in out), Counter())  # noqa: B023, E731
        assert total(whole) == total(small)


def test_odd_rows_and_empty_table(spark):
    rows = [(i, t, "en", s, 0) for i, (t, s) in enumerate([("The the THE", "a")] * 12 + [("the cat", "b")] * 3 + [(LONG, "a"), (None, "c"), ("", None)])]
    assert rows_of(divergence.divergence(docs(spark, rows))) == plain(rows, divergence.MIN_DOCS)
    assert divergence.divergence(docs(spark, [], extra=False)).count() == 0


def test_terms_of_a_text_in_parts(monkeypatch):
    text = ("alpha Beta, " * 50 + "x" * 300 + " gamma é日本 " * 20 + " " * 40).encode()
    whole = [t for part in divergence.terms(text) for t in part]
    for size in (1, 2, 7, 64):
        monkeypatch.setattr(divergence, "PART", size)
        assert [t for part in divergence.terms(text) for t in part] == whole


def test_large_counts_stay_exact():
    part = np.array([9 * 10**14, 3, 10**15 + 7])
    whole = np.array([2 * 10**15 + 1, 10**15, 5 * 10**15 + 3])
    assert divergence.scaled(part, whole).tolist() == [10**9 * int(a) // int(b) for a, b in zip(part, whole, strict=True)]
