"""Approximate nearest neighbours: a navigable small-world graph per shard, with results merged.

Vectors are dealt into bands of like length, a factor of 2 each, and a band into shards of about
``SHARD_ROWS`` by a hash of the id. In each shard a hierarchical navigable small-world graph is built:
points enter in batches, each batch searching the graph so far and linking to diverse near neighbours; a
geometric level decides in how many layers a point lives. The graph is stored as a row per point with
flat neighbour arrays by layer. Blocks of queries search every shard's graph; the best of all shards
are kept by merging small candidate lists. How wide a search is depends on the vectors: ``PROBES`` queries of a
block are answered exactly as well, and the width is doubled until the search finds ``AIM`` of these answers. If that
takes more than ``EF_MOST``, as with vectors without any structure, the block scans the shard, which is then the cheaper way. Scores are inner products of the original vectors in double
precision.

Equal vectors are one point of a graph and are told apart again in the results.

For the graph, the vectors of a band are scaled by the longest of its shard and get one more component that brings
all to length 1, so that the largest inner product is the smallest distance. As no vector of a band is much
longer than another, distances keep their precision whatever the lengths in the table are.

A vector that is null, of length zero, or holds null or non-finite components takes no part, nor
does a row without an id. Rows that repeat an id count once (the smallest vector holds). Ties go
to the smaller id. Vectors must agree in length; those of another length than most take no part.
Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlens.llm.common import checkpointed, table

K = 20
SHARD_ROWS, QUERY_ROWS = 16384, 65536
LINKS, EF_BUILD, EF_SEARCH = 16, 64, 96
BATCH = 512
#: Queries of a block that tell how wide to search, the share of true neighbours to reach, and the widest search.
PROBES, AIM, EF_MOST = 64, 0.95, 192
#: Components that are multiplied at a time for scores.
SCORED = 1 << 20


def _level(ids: np.ndarray) -> np.ndarray:
    """The top layer of each point: geometric with ratio 1 / LINKS, from a hash of its id."""
    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((h >> np.uint64(11)).astype(np.float64) + 1) / float(1 << 53)
    return np.minimum(6, (-np.log(u) / np.log(LINKS)).astype(int))


def _beam(x: np.ndarray, nbr: np.ndarray, q: np.ndarray, start: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one layer for many queries at once: positions and scores, best first.

    ``nbr`` holds neighbours by point, -1 for none; ``start`` the entry point of each query. Memory grows
    with the queries and ``ef`` only, not with the points."""
    m = len(q)
    rows = np.arange(m)
    ids = start
    scores = np.einsum("mkd,md->mk", x[ids], q)
    scores[ids < 0] = -np.inf
    done = np.zeros(ids.shape, dtype=bool)
    active = rows
    while len(active):
        open_ = np.where(done[active], -np.inf, scores[active])
        best = open_.argmax(axis=1)
        go = open_[np.arange(len(active)), best] > -np.inf
        active, best = active[go], best[go]
        if not len(active):
            break
        done[active, best] = True
        near = nbr[ids[active, best]]
        s = np.einsum("mkd,md->mk", x[np.maximum(near, 0)], q[active])
        s[near < 0] = -np.inf
        # A point counts once. One that has left the list is worse than all on it and does not come back.
        s[(near[:, :, None] == ids[active][:, None, :]).any(axis=2)] = -np.inf
        if ids.shape[1] < ef + near.shape[1]:
            pad = ef + near.shape[1] - ids.shape[1]
            ids = np.pad(ids, ((0, 0), (0, pad)), constant_values=-1)
            scores = np.pad(scores, ((0, 0), (0, pad)), constant_values=-np.inf)
            done = np.pad(done, ((0, 0), (0, pad)), constant_values=True)
        w = near.shape[1]
        ids[active, -w:], scores[active, -w:], done[active, -w:] = near, s, s == -np.inf
        order = np.argsort(-scores[active], axis=1, kind="stable")
        for a in (ids, scores, done):
            a[active] = np.take_along_axis(a[active], order, axis=1)
        scores[active, ef:], done[active, ef:] = -np.inf, True
    order = np.argsort(-scores, axis=1, kind="stable")[:, :ef]
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(scores, order, axis=1)


def _diverse(x: np.ndarray, q: np.ndarray, ids: np.ndarray, scores: np.ndarray, limit: int) -> np.ndarray:
    """Of each query's candidates (best first), those nearer to it than to any kept one; then the next best."""
    m, c = ids.shape
    kept = np.full((m, limit), -1)
    count = np.zeros(m, dtype=int)
    vec = x[np.maximum(ids, 0)]
    among = np.einsum("mid,mjd->mij", vec, vec)
    chosen = np.zeros((m, c), dtype=bool)
    for j in range(c):
        good = (scores[:, j] > -np.inf) & (count < limit) & ~((among[:, j, :] > scores[:, j : j + 1]) & chosen).any(axis=1)
        chosen[good, j] = True
        kept[good, count[good]] = ids[good, j]
        count[good] += 1
    for j in range(c):
        good = (scores[:, j] > -np.inf) & (count < limit) & ~chosen[:, j]
        kept[good, count[good]] = ids[good, j]
        count[good] += 1
    return kept


def build(x: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
    """Neighbours by layer, each an array of one row per point; layer 0 has twice the links."""
    n, level = len(x), _level(ids)
    order = np.argsort(-level, kind="stable")  # high points enter first, so every layer's entry exists
    layers = [np.full((n, 2 * LINKS if layer == 0 else LINKS), -1, dtype=np.int32) for layer in range(int(level.max()) + 1 if n else 1)]
    at, size = 0, 1
    while at < n:
        batch = order[at : at + size]
        q = x[batch]
        entry = np.full((len(batch), 1), order[0])
        for layer in range(len(layers) - 1, -1, -1):
            nbr = layers[layer]
            deep = level[batch] >= layer
            if at:
                found, scores = _beam(x, nbr, q, entry, EF_BUILD if deep.any() else 1)
                entry = np.where(scores[:, :1] > -np.inf, found[:, :1], entry)
            else:
                found, scores = np.zeros((len(batch), 0), dtype=int), np.zeros((len(batch), 0))
            if not deep.any():
                continue
            # The batch's own members are near neighbours too.
            mates = q @ q.T
            np.fill_diagonal(mates, -np.inf)
            mates[:, ~deep] = -np.inf
            top = np.argsort(-mates, axis=1, kind="stable")[:, :LINKS]
            cand = np.concatenate([found, batch[top]], axis=1)
            s = np.concatenate([scores, np.take_along_axis(mates, top, axis=1)], axis=1)
            best = np.argsort(-s, axis=1, kind="stable")[:, :EF_BUILD]
            cand, s = np.take_along_axis(cand, best, axis=1)[deep], np.take_along_axis(s, best, axis=1)[deep]
            own = batch[deep]
            kept = _diverse(x, q[deep], cand, s, LINKS)
            nbr[own, :LINKS] = kept
            _link_back(x, nbr, own, kept)
        at += len(batch)
        size = min(BATCH, at)
    return layers


def _link_back(x: np.ndarray, nbr: np.ndarray, own: np.ndarray, kept: np.ndarray) -> None:
    """Adds the reverse of new links; a full list keeps its most diverse near neighbours."""
    pairs = np.stack([kept.ravel(), np.repeat(own, kept.shape[1])], axis=1)
    pairs = pairs[pairs[:, 0] >= 0]
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    targets, first, count = np.unique(pairs[:, 0], return_index=True, return_counts=True)
    width = nbr.shape[1]
    full: list[tuple[int, np.ndarray]] = []
    for t, f, c in zip(targets.tolist(), first.tolist(), count.tolist(), strict=True):
        have = nbr[t][nbr[t] >= 0]
        all_ = np.unique(np.concatenate([have, pairs[f : f + c, 1]]))
        if len(all_) <= width:
            nbr[t] = -1
            nbr[t, : len(all_)] = all_
        else:
            full.append((t, all_))
    for k in range(0, len(full), BATCH):
        part = full[k : k + BATCH]
        w = max(len(a) for _, a in part)
        cand = np.full((len(part), w), -1)
        for i, (_, a) in enumerate(part):
            cand[i, : len(a)] = a
        who = np.array([t for t, _ in part])
        s = np.einsum("mkd,md->mk", x[np.maximum(cand, 0)], x[who])
        s[cand < 0] = -np.inf
        order = np.argsort(-s, axis=1, kind="stable")[:, : 2 * width]
        nbr[who] = _diverse(x, x[who], np.take_along_axis(cand, order, axis=1), np.take_along_axis(s, order, axis=1), width)


def search(x: np.ndarray, layers: list[np.ndarray], top: int, q: np.ndarray, ef: int = EF_SEARCH) -> np.ndarray:
    """Positions of each query's ``ef`` nearest points found, -1 beyond."""
    out = []
    for at in range(0, len(q), BATCH):
        part = q[at : at + BATCH]
        entry = np.full((len(part), 1), top)
        for layer in range(len(layers) - 1, 0, -1):
            found, scores = _beam(x, layers[layer], part, entry, 1)
            entry = np.where(scores > -np.inf, found, entry)
        found, scores = _beam(x, layers[0], part, entry, ef)
        out.append(np.where(scores > -np.inf, found, -1))
    return np.concatenate(out)


def width_for(x: np.ndarray, layers: list[np.ndarray], top: int, q: np.ndarray, k: int, ef: int) -> int:
    """The least doubling of ``ef`` at which the probes among the queries find their k nearest points, or 0 if none does."""
    probes, k = q[:: max(1, len(q) // PROBES)][:PROBES], min(k, len(x))
    scores = probes @ x.T
    worst = np.partition(scores, len(x) - k, axis=1)[:, len(x) - k]
    while ef <= EF_MOST:
        found = search(x, layers, top, probes, max(ef, k))
        near = (np.take_along_axis(scores, np.maximum(found, 0), axis=1) >= worst[:, None]) & (found >= 0)
        if np.minimum(near.sum(axis=1), k).mean() >= AIM * k:
            return ef
        ef *= 2
    return 0


def scan(x: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k nearest points, by all scores, for a few queries at a time."""
    k, out = min(k, len(x)), []
    for at in range(0, len(q), BATCH):
        s = q[at : at + BATCH] @ x.T
        out.append(np.argpartition(s, len(x) - k, axis=1)[:, len(x) - k :])
    return np.concatenate(out)


def lengths(v: np.ndarray) -> np.ndarray:
    """Lengths of vectors, without overflow."""
    most = np.abs(v).max(axis=1, initial=0.0)
    most[most == 0] = 1.0
    return most * np.sqrt(((v / most[:, None]) ** 2).sum(axis=1))


def _lifted(v: np.ndarray) -> np.ndarray:
    """Vectors of a shard, scaled by the longest, with one more component that brings all to length 1."""
    v = v / np.abs(v).max()
    v = v / lengths(v).max()
    rest = np.sqrt(np.maximum(0, 1 - (v * v).sum(axis=1)))
    return np.concatenate([v, rest[:, None]], axis=1).astype(np.float32)


def _aimed(q: np.ndarray) -> np.ndarray:
    """Queries of length 1, without the added component."""
    q = q / np.abs(q).max(axis=1, keepdims=True)
    q = q / lengths(q)[:, None]
    return np.concatenate([q, np.zeros((len(q), 1))], axis=1).astype(np.float32)


GRAPH = "shard long, pos int, vec_id long, members array<long>, v array<double>, layers array<array<int>>"


def _build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("vec_id", ignore_index=True)
    v, ids = np.stack(pdf["v"].to_numpy()).astype(np.float64), pdf["vec_id"].to_numpy()
    layers, level = build(_lifted(v), ids), _level(ids)
    flat = [[layers[k][i][layers[k][i] >= 0].tolist() for k in range(level[i] + 1)] for i in range(len(ids))]
    return pd.DataFrame({"shard": pdf["shard"], "pos": np.arange(len(ids), dtype="int32"), "vec_id": ids, "members": pdf["members"], "v": list(v), "layers": flat})


def _first(groups: np.ndarray, n: int) -> np.ndarray:
    """Which rows are among the first ``n`` of their group, where groups stand in order."""
    return np.arange(len(groups)) - np.searchsorted(groups, groups) < n


def _results(v: np.ndarray, ids: np.ndarray, times: np.ndarray, flat: np.ndarray, q: np.ndarray, qid: np.ndarray, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query_id, vec_id, score: of the points found for each query the ``k`` nearest members, without the query itself. ``flat`` holds the members
    of all points, ``times`` of each. The best ``k`` + 1 points, each by its smallest member, hold these, so no more are written out in members."""
    r, c = np.nonzero(found >= 0)
    hit, step = found[r, c], max(1, SCORED // q.shape[1])
    score = np.concatenate([(v[hit[i : i + step]] * q[r[i : i + step]]).sum(axis=1) for i in range(0, len(hit), step)] or [np.zeros(0)])
    order = np.lexsort((ids[hit], -score, r))
    order = order[_first(r[order], k + 1)]
    r, hit, score = r[order], hit[order], score[order]
    n = times[hit]
    # The members of a point stand together in ``flat``, from the number of members of all points before it on.
    who = flat[np.arange(n.sum()) + np.repeat((np.cumsum(times) - times)[hit] - (np.cumsum(n) - n), n)]
    r, score = np.repeat(r, n), np.repeat(score, n)
    other = who != qid[r]
    r, who, score = r[other], who[other], score[other]
    order = np.lexsort((who, -score, r))
    order = order[_first(r[order], k)]
    return qid[r[order]], who[order], score[order]


def _search_shard(k: int, ef: int):
    def run(graph: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if not len(graph) or not len(queries):
            return pd.DataFrame(columns=names).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        graph, queries = graph.sort_values("pos"), queries.sort_values("query_id")
        v, ids = np.stack(graph["v"].to_numpy()).astype(np.float64), graph["vec_id"].to_numpy()
        height = [len(x) for x in graph["layers"]]
        layers = [np.full((len(ids), 2 * LINKS if n == 0 else LINKS), -1, dtype=np.int32) for n in range(max(height))]
        for i, own in enumerate(graph["layers"]):
            for n, near in enumerate(own):
                layers[n][i, : len(near)] = near
        top = int(np.argmax(height))
        q, qid = np.stack(queries["v"].to_numpy()).astype(np.float64), queries["query_id"].to_numpy()
        x, members = _lifted(v), graph["members"].to_list()
        times, flat = np.array([len(m) for m in members]), np.concatenate(members).astype("int64")
        wide = width_for(x, layers, top, _aimed(q[:: max(1, len(q) // PROBES)][:PROBES]), k + 1, max(ef, k + 1))
        out = []
        # What a few queries find is cut to their results before the next are asked.
        for at in range(0, len(q), BATCH):
            part = q[at : at + BATCH]
            found = search(x, layers, top, _aimed(part), wide) if wide else scan(x, _aimed(part), max(ef, k + 1))
            out.append(_results(v, ids, times, flat, part, qid[at : at + BATCH], found, k))
        return pd.DataFrame(dict(zip(names, (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles): the rows that take part, one for each id."""
    v = F.transform("embedding", lambda c: c.cast("double"))
    good = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))) & F.exists("v", lambda c: c != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(F.coalesce(good, F.lit(False)))
    rows = checkpointed(rows.groupBy("vec_id").agg(F.min("v").alias("v")))
    usual = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    return rows.where(F.size("v") == (usual["n"] if usual else 0))


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """vec_id (the smallest), v, members: equal vectors as one point, with their ``most`` smallest
    ids, which are all that a result can hold. Salted, as one vector may be very common."""
    for keys in (["v", F.pmod(F.xxhash64("vec_id"), F.lit(64))], ["v"]):
        first = F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))
        rows = rows.withColumn("_n", first).where(F.col("_n") <= most).drop("_n")
    return rows.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("members")).select(F.col("members")[0].alias("vec_id"), "members", "v")


#: Numbers of shards in a band at most.
IN_BAND = 1 << 40


def index(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, list[tuple[int, int]]]:
    """The graphs of all shards, and the bands with the number of shards in each."""
    most = F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    length = F.log2("most") + F.log2(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / F.col("most")) * (x / F.col("most")))) / 2
    rows = rows.withColumn("most", most).withColumn("band", F.floor(length).cast("long")).drop("most")
    # Bands are bounded in number by the exponents of doubles.
    bands = checkpointed(rows.groupBy("band").agg(F.ceil(F.count("*") / shard_rows).cast("long").alias("shards")))
    dealt = rows.join(F.broadcast(bands), "band")
    part = F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.col("shards"))
    dealt = dealt.withColumn("shard", F.col("band") * IN_BAND + part).drop("band", "shards")
    return checkpointed(dealt.groupBy("shard").applyInPandas(_build_shard, GRAPH)), sorted((r["band"], r["shards"]) for r in bands.collect())


def nearest(rows: DataFrame, queries: DataFrame, k: int = K, ef: int = EF_SEARCH, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score for queries (query_id, v) against all rows (vec_id, v)."""
    graphs, bands = index(checkpointed(distinct_vectors(rows, k + 1)), shard_rows)
    blocks = max(1, -(-queries.count() // query_rows))
    # Each block of queries meets each shard once; a task holds one shard and one block.
    asked = queries.withColumn("block", F.pmod(F.xxhash64(F.lit(4), "query_id"), F.lit(blocks)))
    every = F.array(*[F.struct(F.lit(band * IN_BAND).cast("long").alias("first"), F.lit(n).cast("long").alias("n")) for band, n in bands] or [F.lit(None).cast("struct<first:long,n:long>")])
    asked = asked.withColumn("band", F.explode(every)).withColumn("shard", F.explode(F.sequence(F.col("band.first"), F.col("band.first") + F.col("band.n") - 1))).drop("band")
    stored = graphs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = stored.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(_search_shard(k, ef), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"))
    return nearest(rows, rows.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "v"))
