"""Bootstrapped contexts against plain Python, and what only a second generation can find."""

import hashlib
import math
import re
from collections import defaultdict

import pytest

from graphlens.llm import pii
from tests.conftest import SF
from tests.llm.cases import write
from tests.llm.test_corpus import plain_pii

SPACE = " \t\n\x0b\x0c\r"


def mentions(text):
    base = plain_pii(text)
    kinds = defaultdict(list)
    for s, _, k, e in base:
        kinds[k].append((s, e))
    tokens = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text) if re.search("[0-9@]", m[0])]
    out = []

    def edge(piece, last):
        words = re.split(f"[{SPACE}]", piece.strip(SPACE))
        word = "".join(c for c in (words[-1] if last else words[0]) if c.isalpha()).lower()
        return hashlib.sha256(word.encode()).hexdigest() if len(word) > 40 else word

    for kind, spans in (*kinds.items(), ("", tokens)):
        for i, (s, e) in enumerate(spans):
            if kind == "" and any(x < e and s < y for x, _, _, y in base):
                continue
            left, right = text[spans[i - 1][1] if i else 0 : s], text[e : spans[i + 1][0] if i + 1 < len(spans) else len(text)]
            pats = [f"{side}:{w}" for side, w in (("left", edge(left, True)), ("right", edge(right, False))) if w]
            out.append((s, e, kind, text[s:e], pats))
    return base, out


def plausible(token, kind):
    n, parts = len(re.findall("[0-9]", token)), len(re.findall("[.:]", token))
    return {"email": "@" in token, "ip": n >= 4 and parts >= 3, "card": 12 <= n <= 19, "phone": 7 <= n <= 15}[kind]


def plain_spans(texts):
    said = {i: mentions(t or "") for i, t in texts.items()}
    graph = {(p, tok) for _, ms in said.values() for _, _, _, tok, pats in ms for p in pats}
    known = {(tok, kind) for _, ms in said.values() for _, _, kind, tok, _ in ms if kind}
    of = defaultdict(set)
    for p, tok in graph:
        of[p].add(tok)
    found, generations = set(), 0
    while True:
        generations += 1
        seeds = {(p, k): n for p in of for k in pii.KINDS if (n := sum((t, k) in known for t in of[p])) >= pii.SUPPORT}
        score = {pk: n / len(of[pk[0]]) for pk, n in seeds.items()}
        for _ in range(pii.ROUNDS - 1):
            said_by = defaultdict(dict)
            for (p, k), s in score.items():
                for t in of[p]:
                    if (t, k) not in known:
                        said_by[t, k][p] = 1 - min(s, 0.999) if s >= pii.CONFIDENCE else 1.0
            trust = lambda t, k, but: 1 - math.prod(v for p, v in said_by[t, k].items() if p != but)  # noqa: B023, E731
            score = {(p, k): (n + sum(trust(t, k, p) for t in of[p] if (t, k) not in known)) / len(of[p]) for (p, k), n in seeds.items()}
        hits = defaultdict(list)
        for i, (_, ms) in said.items():
            for s, e, kind, tok, pats in ms:
                hits[i, s, e] += [(score[p, k], -pii.KINDS.index(k), k, tok) for p in pats for k in pii.KINDS if not kind and p.startswith("left:") and score.get((p, k), 0) >= pii.CONFIDENCE and plausible(tok, k)]
        now = {(tok, k) for v in hits.values() for _, _, k, tok in v}
        known |= now
        if len(now) == len(found):
            break
        found = now
    more = defaultdict(list)
    for (i, s, e), v in hits.items():
        if v:
            more[i].append((s, pii.KINDS.index(max(v)[2]), max(v)[2], e))
    return {i: ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted([*b, *more[i]])) for i, (b, _) in said.items()}, generations


def two_generations():
    # 120 of 132 and 12 of 13 are above 0.9 without any support from the instances themselves.
    rows = [(200 + i, f"please call helpline +1 (555) 55{i % 10}-{1000 + i} now or never") for i in range(120)]
    rows += [(30 + i, f"call helpline 55{i}-0199-77{i} today") for i in range(12)]  # found after helpline
    rows += [(50 + i, f"ring nightdesk 55{i}-0199-77{i} soon") for i in range(12)]  # the same numbers teach nightdesk
    rows += [(80, "ring nightdesk 991-0000-123 soon"), (81, "in 1999 there were 1234567 now"), (82, "z" * 50 + " 991-0000-555 x"), (83, None), (83, None)]
    return rows


def test_found_instances_induce_patterns(spark, tmp_path):
    rows = two_generations()
    d = write(spark.createDataFrame(rows, "doc_id long, text string"), tmp_path)
    got = {r["doc_id"]: r["spans"] for r in pii.op3_pii(spark, d).collect()}
    want, generations = plain_spans(dict(rows))
    assert got == want and generations >= 3
    assert got[80] == "phone:15:27" and got[81] == got[82] == ""


@pytest.mark.parametrize(("phones", "orders"), [(11, 11), (11, 8), (30, 10)])
@pytest.mark.parametrize("around", ["order %s done", "%s done"])
def test_mixed_contexts_report_nothing(spark, tmp_path, phones, orders, around):
    """Words that stand beside phones and beside order numbers alike vouch for neither."""
    rows = [(i, around % f"+1 555 01{i:02d} 99{i:02d}" + f" w{chr(97 + i)}") for i in range(phones)]
    rows += [(100 + i, around % f"7{i:02d}400{i:03d}" + f" v{chr(97 + i)}") for i in range(orders)]
    d = write(spark.createDataFrame(rows, "doc_id long, text string"), tmp_path)
    got = {r["doc_id"]: r["spans"] for r in pii.op3_pii(spark, d).collect()}
    assert all(got[i].startswith("phone:") for i in range(phones)) and not any(got[100 + i] for i in range(orders))


def test_spans_match_plain_python(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r["doc_id"]: r["spans"] for r in pii.op3_pii(spark, SF).collect()} == plain_spans(texts)[0]
