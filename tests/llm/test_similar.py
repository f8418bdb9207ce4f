"""The near-dedup stage against all pairs in plain Python."""

import functools
import random

import numpy as np
import pytest

import corpus_pipeline
from graphlens.llm import components, simhash, tiles
from tests.conftest import SF
from tests.llm.test_corpus import brute_components


def plain(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(a, b):
    return not (a or b) or 5 * len(a & b) >= 4 * len(a | b)


def survivors(rows):
    roots = brute_components([plain(t) for _, t in rows], near)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        least[r] = min(least.get(r, i), i)
    return sorted(least.values())


def test_stage_drops_what_all_pairs_link(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = survivors(rows)
    assert len(want) < len({t for _, t in rows})
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == want


@pytest.mark.parametrize("tile", [simhash.SIMILAR_TILE, 500])
def test_chains_shared_passages_and_the_bound(spark, tile, monkeypatch):
    monkeypatch.setattr(simhash, "similar_links", functools.partial(simhash.similar_links, tile=tile))
    base = [f"w{i}" for i in range(94)]  # 90 shingles
    rows = [(0, ""), (1, None), (2, "one two"), (3, "One  two"), (4, "a b c d e f g h"), (5, "a b c d e f g h i"), (6, "a b c d e f g"), (7, "b c d e f g h i")]
    rows += [(10 + i, " ".join(base[i * 9 :] + [f"x{j}" for j in range(i * 9)])) for i in range(6)]  # a chain: each link 81 of 99
    rows += [(20, " ".join(f"v{i}" for i in range(85))), (21, " ".join(f"v{i}" for i in range(69))), (22, " ".join(f"v{i}" for i in range(68)))]
    rows += [(30 + i, " ".join([f"p{j}" for j in range(40)] + [f"u{i}.{j}" for j in range(8 + i)])) for i in range(30)]  # shared passage
    rng = random.Random(2)
    for i in range(120):  # a large group of near copies, some of which stand apart
        words = [f"g{j}" for j in range(100)]
        for at in rng.sample(range(100), rng.randrange(7)):
            words[at] = f"e{i}.{at}"
        rows.append((100 + i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.drop_similar_texts(df).collect()) == survivors(rows)


def test_short_sets_at_the_bound(spark):
    """Pairs at 4 of 5 shingles and the like, where fingerprints differ the most."""
    rows = []
    for i in range(400):
        n = 4 + i % 12
        words = [f"s{i}.{j}" for j in range(n + 4 + (n // 4))]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[: n + 4]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.drop_similar_texts(df).collect()) == survivors(rows)


def test_shared_counts_by_bits_and_one_by_one():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40))).astype(np.uint64) for _ in range(20)]
    i, j = (a.ravel() for a in np.meshgrid(np.arange(20), np.arange(20)))
    want = [len(set(sets[a].tolist()) & set(sets[b].tolist())) for a, b in zip(i, j, strict=True)]
    assert simhash.shared_counts(sets, sets, i, j).tolist() == want
    assert [int(simhash.shared_counts(sets, sets, i[k : k + 1], j[k : k + 1])[0]) for k in range(400)] == want


def test_a_cell_far_beyond_its_tile(spark, monkeypatch):
    """Fingerprints of one cell, in many pieces and chunks, against brute force."""
    monkeypatch.setattr(tiles, "CHUNK", 2)
    rng = random.Random(8)
    lane = lambda: sum(1 << b for b in rng.sample(range(16), 8))
    fps = set()
    while len(fps) < 600:
        x = lane() | lane() << 16 | lane() << 32 | lane() << 48
        low = [b for b in range(16) if x >> b & 1][0]
        free = [b for b in range(16) if not x >> b & 1][0]
        fps |= {x, x ^ (1 << low) ^ (1 << free)}  # the same bit counts, two bits apart
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), tile=16)
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    roots = brute_components([f & ((1 << 64) - 1) for f in signed], lambda a, b: (a ^ b).bit_count() <= 2)
    groups, own = {}, {}
    for f, r in zip(signed, roots, strict=True):
        groups.setdefault(r, set()).add(f)
        own.setdefault(got.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, own.values()))


def test_repeats_that_differ_in_other_columns(spark):
    rows = [(1, "one and the same text of many words here", s) for s in "cab"] + [(1, "one and the same text of many words here", "a")] + [(2, "ONE and the same text of many words here", "a")]
    got = [{tuple(r) for r in simhash.drop_similar_texts(spark.createDataFrame(part, "doc_id long, text string, source string").repartition(n)).collect()} for part, n in ((rows, 1), (rows[::-1], 3))]
    assert got[0] == got[1] and len(got[0]) == 1
