"""Tree tests by paths against closures, searches whose order is numbered anew, and registrar chains."""

import random
import time

import pytest
from pyspark.sql import functions as F

from graphlens.operators import cpg, graph, handlers, traverse
from graphlens.functions.knowledge import KnowledgeBase
from graphlens.sources import graphson
from graphlens.sources.builder import Builder


def edges_of(spark, pairs, label="T"):
    return spark.createDataFrame([(a, b, label, i) for i, (a, b) in enumerate(pairs)], "src long, dst long, label string, ord long")


def random_tree(n, seed):
    r = random.Random(seed)
    return [(r.randrange(max(0, i - 6), i) if i % 9 else 1000 + i, i) for i in range(1, n)]


def above(pairs):
    up = {b: a for a, b in pairs}
    out = {}
    for x in {x for p in pairs for x in p}:
        way, at = [], x
        while at in up:
            at = up[at]
            way.append(at)
        out[x] = way
    return out


def test_trees_need_no_closure(spark, monkeypatch):
    pairs = random_tree(120, 4)
    want, e = above(pairs), edges_of(spark, pairs)
    monkeypatch.setattr(graph, "closure", lambda *a, **k: pytest.fail("a closure of a tree"))
    nodes = spark.createDataFrame([(x,) for x in [*want, 5000]], "id long")
    got = {(r["top"], r["node"], r["depth"]) for r in graph.ancestry(nodes, e, "T").collect()}
    assert got == {(x, x, 0) for x in [*want, 5000]} | {(t, x, k) for x, way in want.items() for k, t in enumerate(way, 1)}
    tops = spark.createDataFrame([(1,), (7,), (1009,), (5000,), (7,)], "id long")
    got = {(r["root"], r["node"], r["depth"]) for r in graph.descendants(e, tops, "T").collect()}
    assert got == {(t, x, k) for x, way in want.items() for k, t in enumerate(way, 1) if t in (1, 7, 1009)}
    assert all(r["depth"] <= 2 for r in graph.descendants(e, tops, "T", 2).collect())
    asked = [(a, b) for a in (1, 7, 1009, 5000, 90) for b in [*range(0, 120, 7), 5000]]
    out = graph.dominates(e, spark.createDataFrame([(*p, i) for i, p in enumerate(asked)], "a long, b long, extra int"), "T")
    assert {(r["a"], r["b"], r["extra"]): r["dominated"] for r in out.collect()} == {(a, b, i): a == b or a in want.get(b, []) for i, (a, b) in enumerate(asked)}


@pytest.mark.parametrize("pairs", [[(1, 2), (2, 3), (1, 3)], [(1, 2), (2, 3), (3, 2)], [(1, 2), (2, 1)], [(4, 4), (1, 2)]])
def test_other_graphs_go_by_closure(spark, pairs):
    e = edges_of(spark, pairs)
    assert graph.places(e, "T") is None
    reach = {}
    for a in {x for p in pairs for x in p}:
        seen, todo = {a}, [a]
        while todo:
            at = todo.pop()
            for s, t in pairs:
                if s == at and t not in seen:
                    seen.add(t)
                    todo.append(t)
        reach[a] = seen
    ids = spark.createDataFrame([(a,) for a in reach], "id long")
    assert {(r["root"], r["node"]) for r in graph.descendants(e, ids, "T").collect()} == {(a, b) for a, s in reach.items() for b in s if a != b}
    asked = spark.createDataFrame([(a, b) for a in reach for b in reach], "a long, b long")
    assert all(r["dominated"] == (r["b"] in reach[r["a"]]) for r in graph.dominates(e, asked, "T").collect())
    assert {(r["top"], r["node"]) for r in graph.ancestry(ids, e, "T").collect()} == {(a, b) for a, s in reach.items() for b in s}


def test_a_tree_of_two_hundred_thousand_nodes(spark):
    n = 200_000
    e = spark.range(1, n).select(F.floor(F.col("id") / 3).alias("src"), F.col("id").alias("dst"), F.lit("T").alias("label"), F.col("id").alias("ord"))
    start = time.time()
    below = graph.descendants(e, spark.createDataFrame([(0,), (1,), (3,), (199_999,)], "id long"), "T").groupBy("root").count()
    got = {r["root"]: r["count"] for r in below.collect()}
    size = [1] * n
    for i in range(n - 1, 0, -1):
        size[i // 3] += size[i]
    assert got == {0: n - 1, 1: size[1] - 1, 3: size[3] - 1} and time.time() - start < 120


def plain_bfs(pairs, seeds):
    out, queue = {s: (0, None) for s in seeds}, list(seeds)
    for at in queue:
        for s, t in pairs:
            if s == at and t not in out:
                out[t] = (out[at][0] + 1, at)
                queue.append(t)
    return out


def test_order_of_discovery_survives_renumbering(spark, monkeypatch):
    """Two ways of equal length all the way down: the parent found first wins at every level."""
    r = random.Random(8)
    width, depth = 4, 21
    pairs = [(k * width + i, (k + 1) * width + j) for k in range(depth) for i in range(width) for j in range(width) if r.random() < 0.6]
    r.shuffle(pairs)
    seeds = [2, 0]
    monkeypatch.setattr(traverse, "RENUMBER", 3)
    start = spark.createDataFrame([(s, i) for i, s in enumerate(seeds)], "id long, ord long")
    got = {x["node"]: (x["depth"], x["parent"]) for x in traverse.bfs(edges_of(spark, pairs), start).collect()}
    assert got == plain_bfs(pairs, seeds)


def registrar_program(kind):
    b = Builder()
    b.file("main.c")
    b.define("on_scp", "x")
    slot = lambda at, f: b.field(b.index(b.ident("table"), at()), f)
    n, zero = lambda: b.ident("n"), lambda: b.lit("0")
    store = lambda at: (lambda: b.assign(slot(at, "action"), b.ident("key")), lambda: b.assign(slot(at, "fn"), b.ident("fn")))
    if kind == "two level":
        b.define("nothing", "key fn")
        b.define("late", "key fn", *store(n))
        b.define("store", "key fn", lambda: b.call("nothing", b.ident("key"), b.ident("fn")), lambda: b.call("late", b.ident("key"), b.ident("fn")))
        b.define("register_handler", "id cb", lambda: b.call("store", b.ident("id"), b.ident("cb")), lambda: b.call("late", b.ident("id"), b.ident("cb")))
    elif kind == "direct":
        b.define("register_handler", "key fn", *store(zero))
    elif kind == "no store":
        b.define("register_handler", "key fn", lambda: b.call("log", b.ident("key"), b.ident("fn")))
    else:
        at = n if kind == "variable index" else zero
        b.define("register_handler", "id cb", lambda: b.control("IF", b.op("equals", slot(at, "action"), b.ident("id")), b.assign(slot(at, "fn"), b.ident("cb"))))
    b.define("init", "", lambda: b.call("register_handler", b.ident("MSG_SET_PROFILE"), b.ref("on_scp")))
    return b


KINDS = ["two level", "direct", "no store", "variable index", "fixed index"]


@pytest.fixture(scope="module")
def registrars(spark):
    docs = spark.createDataFrame([(k, registrar_program(k).json()) for k in KINDS], "doc string, json string").select("doc", F.try_parse_json("json").alias("v"))
    g = cpg.Cpg(*graphson.load(docs))
    kb = KnowledgeBase(spark)
    return g, kb, handlers.registrar_calls(g, kb, 2)


def test_chain_of_a_registrar(registrars):
    g, _, rows = registrars
    chains = {}
    for r in handlers.registrar_chains(g, rows).orderBy("doc", "action", "pos").collect():
        chains.setdefault((r["doc"], r["action"]), []).append((r["step"], r["code"]))
    want = {
        "two level": [("DISPATCH_REGISTRAR_CALL", "register_handler(MSG_SET_PROFILE, on_scp)"), ("CHAIN_CALL", "store(id, cb)"), ("CHAIN_CALL", "late(key, fn)"), ("CHAIN_STORE", "table[n]->action = key"), ("CHAIN_STORE", "table[n]->fn = fn"), ("HANDLER_REF", "on_scp")],
        "direct": [("DISPATCH_REGISTRAR_CALL", "register_handler(MSG_SET_PROFILE, on_scp)"), ("CHAIN_STORE", "table[0]->action = key"), ("CHAIN_STORE", "table[0]->fn = fn"), ("HANDLER_REF", "on_scp")],
    }
    assert {d for d, _ in chains} == set(want) and all(steps == want[d] for (d, _), steps in chains.items())


def test_search_then_write_needs_a_loop_or_a_variable_index(registrars):
    g, kb, rows = registrars
    told = {r["doc"]: (r["stored"], r["searched"]) for r in rows.collect()}
    assert told == {"two level": (True, False), "direct": (True, False), "no store": (False, False), "variable index": (False, True), "fixed index": (False, False)}
    action = rows.first()["action"]
    why = {r["doc"]: r["diagnosis"] for r in handlers.diagnose(g, kb, rows).where(F.col("action") == action).collect()}
    assert (why["variable index"], why["fixed index"], why["no store"]) == ("REGISTRAR_SEARCH_THEN_WRITE", "REGISTRAR_STORE_NOT_REACHED", "REGISTRAR_STORE_NOT_REACHED")
