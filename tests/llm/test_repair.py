"""Conversation repair against a plain search over all edits."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from graphlens.llm import repair
from tests.conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string"
LAST = re.compile(r"[^\x20\x09-\x0D]")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        how = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        out += [(conv, turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    return out


def plain_path(messages):
    """Least (cost, edits, lines) by a search over (messages read, role initials so far)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, edits, i, last, lines = heapq.heappop(heap)
        if i == len(messages) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in lines)):
            return cost, edits, lines
        if (i, last) in done:
            continue
        done.add((i, last))
        follow = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        if edits[-3:] != "III":
            for role in ("user", "assistant"):
                if role[0] in follow:
                    heapq.heappush(heap, (cost + 5, edits + "I", i, role[0], (*lines, (role, ""))))
        if i < len(messages):
            role, text, fault = messages[i]
            heapq.heappush(heap, (cost + 2, edits + "D", i + 1, last, lines))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if role[:1] and role[:1] in follow:
                    heapq.heappush(heap, (cost + more, edits + "K", i + 1, role[0], (*lines, (role, text))))
                for to in ("user", "assistant"):
                    if to[0] in follow:
                        heapq.heappush(heap, (cost + 1 + more, edits + "R", i + 1, to[0], (*lines, (to, text))))
    raise AssertionError


def plain(rows, originals):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role, text))
    out = {}
    for conv in {r[0] for r in originals}:
        here = sorted(by[conv], key=lambda m: (m[0] is not None, m[0] or 0, m[1], hashlib.sha256(m[2].encode()).digest()))
        seen, messages = set(), []
        for _, role, text in here:
            kept = LAST.findall(text)
            fault = "blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else ""
            seen.add((role, text))
            messages.append((role, text, fault))
        turns = {m[0] for m in here} - {None}
        count = lambda f: sum(m[2] == f for m in messages)  # noqa: B023, E731
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(messages, messages[1:], strict=False))
        cost, edits, lines = plain_path(messages)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, edits, digest)
    return out


def found(df):
    return {r[0]: tuple(r[1:]) for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def test_query_equals_plain_search(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(repair.op11_repair(spark, SF)) == plain(plain_damage(rows), rows)


def random_rows(n, convs, seed=3):
    r = random.Random(seed)
    texts = ["Well.", "no end", "", " \t", "Why?", "So!  ", "a\x0b", "é", None, "line\nbreak."]
    roles = ["system", "user", "assistant", "tool", "", "Ass", None, "usher"]
    return [(r.choice(convs), r.choice([None, *range(12)]), r.choice(roles), r.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("dealt", [1, 7])
def test_random_conversations(spark, dealt):
    """Ties, repeats, nulls, odd roles, hot conversations, over several partitions."""
    rows = random_rows(400, [None, *range(60)]) + [(9, t, ["user", "assistant", "system"][t % 5 % 3], f"message {t % 90}.") for t in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(dealt).withColumns({c: F.lit(c) for c in ("k", "kind", "times2", "digest", "symbols", "n")})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        assert found(repair.audit(repair.damaged(df), df)) == plain(plain_damage(rows), rows)
        undamaged = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
        assert found(repair.audit(df)) == plain(undamaged, rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repaired_messages_are_what_the_digest_covers(spark):
    rows = random_rows(120, list(range(9)))
    df = spark.createDataFrame(rows, SCHEMA)
    lines = defaultdict(list)
    for r in repair.repaired(df).orderBy("conv_id", "position").collect():
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
        assert (r["edit"] == "insert") <= (r["text"] == "" and r["turn"] is None)
    want = {r["conv_id"]: r["repaired_sha256"] for r in repair.audit(df).collect()}
    assert {c: hashlib.sha256("\n".join(lines[c]).encode()).hexdigest() for c in want} == want


def test_shortest_path_equals_search_on_all_short_inputs():
    path = repair.ShortestPath()
    faults = ["blank", "duplicate", "truncated", ""]
    r = random.Random(5)
    for n in range(7):
        for _ in range(60):
            codes = [(r.randrange(4), r.choice([0, 1, 2, 3, 3, 3])) for _ in range(n)]
            messages = [(("system", "user", "assistant", "tool")[i], str(j), faults[f]) for j, (i, f) in enumerate(codes)]
            cost, edits, _ = plain_path(messages)
            assert path("".join(repair.letter(i, f) for i, f in codes)) == (cost, edits)


def test_long_conversation_is_linear():
    """A million messages: distances and edits from end to end."""
    symbols = "".join(repair.letter(1 + i % 2, 3) for i in range(1_000_000))
    cost, edits = repair.ShortestPath()(symbols)
    assert (cost, len(edits), set(edits)) == (0, 1_000_000, {"K"})


def test_empty_table_and_nothing_left(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.audit(none).count() == 0 and repair.repaired(none).count() == 0
    kept = spark.createDataFrame([(1, 1, "user", "a.")], SCHEMA)
    assert found(repair.audit(none, kept)) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
