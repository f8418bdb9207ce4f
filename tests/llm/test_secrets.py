"""Added spans of the secret scan against plain Python, and very long candidates."""

import math
import random
import re
import time
from collections import Counter

from graphlens.llm import secrets
from tests.conftest import SF
from tests.llm.cases import write
from tests.llm.test_corpus import plain_secrets


def entropy(t):
    best = 0.0
    for i in range(len(t) - 19):
        best = max(best, -sum(n / 20 * math.log2(n / 20) for n in Counter(t[i : i + 20]).values()))
    return best


def known(t):
    parts = re.split("[/-]", t)
    if len(parts) > 1 and all(1 <= len(p) <= 12 for p in parts) and "+" not in t:
        return True
    if re.fullmatch("[0-9]+|[A-Za-z_-]+|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", t):
        return True
    return any(w in t.lower() for w in ("example", "sample", "placeholder", "changeme", "lorem", "abcdefgh", "12345678"))


def plain_spans(t):
    base = plain_secrets(t)
    more = set()
    for pattern, least in ((r"[0-9A-Fa-f]+", 2.8), (r"[A-Za-z0-9+/_-]+", 3.7)):
        for m in re.finditer(pattern, t):
            if len(m[0]) >= 20 and not any(s < m.end() and m.start() < e for s, _, _, e in base) and not known(m[0]) and entropy(m[0]) >= least - 1e-12:
                more.add((m.start(), 3, "entropy", m.end()))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted([*base, *more]))


def test_all_spans_match_plain_python(spark, tmp_path):
    rng = random.Random(6)
    pool = "abcXYZ019+/_-", "0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    made = [" ".join("".join(rng.choice(rng.choice(pool) if rng.random() < 0.1 else p) for _ in range(rng.randrange(5, 70))) + rng.choice(["", "=", "\u00e9", " token: "]) for p in pool * 2) for _ in range(80)]
    texts = dict(enumerate(made)) | {1000 + r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    d = write(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), tmp_path)
    got = {r["doc_id"]: r["spans"] for r in secrets.op4_secrets(spark, d).collect()}
    assert got == {i: plain_spans(t or "") for i, t in texts.items()}
    assert sum("entropy" in v for v in got.values()) >= len(made)  # each made text has one


def test_very_long_candidates(spark, tmp_path):
    """A million characters without a space, as slugs and as base64, take time in proportion."""
    rng = random.Random(7)
    alphabet = secrets.ALPHABETS["base64"].replace("-", "").replace("/", "")
    blob = "".join(rng.choices(alphabet, k=1_000_000))
    rows = [(1, "ab1-" * 250_000 + "x"), (2, blob), (3, "ab1/" * 250_000 + blob[:100]), (4, "0" * 1_000_000), (5, "z" * 999_990 + "secret=" + blob[:50])]
    d = write(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), tmp_path)
    start = time.time()
    got = {r["doc_id"]: r["spans"] for r in secrets.op4_secrets(spark, d).collect()}
    assert got == {1: "", 2: "entropy:0:1000000", 3: "entropy:0:1000100", 4: "hex:0:1000000", 5: "assign:999990:1000047"}
    assert time.time() - start < 60
