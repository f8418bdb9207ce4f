"""Recall at the shipped shard size, where vectors have no structure and where they have some."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from graphlens.llm import ann


def shard(v):
    return ann._build_shard(pd.DataFrame({"shard": 0, "vec_id": np.arange(len(v)), "members": [[i] for i in range(len(v))], "v": list(v)}))


def recall(v, q, k=20):
    graph = shard(v)
    asked = pd.DataFrame({"query_id": np.arange(len(q)) + 10**9, "v": list(q)})
    out = ann._search_shard(k, ann.EF_SEARCH)(graph, asked)
    found = out.groupby("query_id")["vec_id"].apply(set)
    want = np.argsort(-(q @ v.T), axis=1, kind="stable")[:, :k]
    return np.mean([len(found[i + 10**9] & set(w.tolist())) / k for i, w in enumerate(want)])


@pytest.mark.parametrize("dims", [64, 128, 256])
def test_unstructured_vectors(dims):
    rng = np.random.default_rng(dims)
    assert recall(rng.normal(size=(ann.SHARD_ROWS, dims)), rng.normal(size=(300, dims))) >= 0.95


def test_clustered_vectors_are_searched_by_graph(monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(200, 64))
    points = lambda n: centres[rng.integers(0, 200, n)] + 0.3 * rng.normal(size=(n, 64))
    monkeypatch.setattr(ann, "scan", lambda *a: pytest.fail("a scan of vectors that the graph serves"))
    assert recall(points(ann.SHARD_ROWS), points(300)) >= 0.95


def test_few_points_and_few_queries():
    rng = np.random.default_rng(5)
    for n in (1, 2, 30):
        v = rng.normal(size=(n, 8))
        assert recall(v, rng.normal(size=(1, 8)), k=min(n, 20)) == 1.0


def test_a_search_of_common_vectors_takes_no_memory_for_all_that_it_finds():
    """Each point stands for 21 rows. Written out for all queries at once, what they find takes 600 MB and more."""
    rng = np.random.default_rng(7)
    v, q = rng.normal(size=(400, 8)), rng.normal(size=(4000, 8))
    q[:50] = v[:50]
    members = [np.arange(i, 21 * 400, 400) for i in range(400)]
    graph = shard(v)
    graph["members"] = members
    # The first 50 queries are among the points' rows.
    ids = np.concatenate([np.arange(50), np.arange(3950) + 10**9])
    tracemalloc.start()
    out = ann._search_shard(20, ann.EF_SEARCH)(graph, pd.DataFrame({"query_id": ids, "v": list(q)}))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20
    who, score = np.concatenate(members), np.repeat(q @ v.T, 21, axis=1)
    score[ids[:, None] == who] = -np.inf
    near = np.stack([np.lexsort((who, -s.round(9)))[:20] for s in score])
    got = out.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    assert len(got) == 20 * len(q)
    assert (got["vec_id"].to_numpy().reshape(-1, 20) == who[near]).all(axis=1).mean() >= 0.99
    assert np.array_equal(got["query_id"].to_numpy().reshape(-1, 20)[:, 0], ids)
