"""Benchmark decontamination by Wu-Manber search over words.

The windows of all benchmark items (``WINDOW`` words in a row; a shorter item is one window) are
the patterns, the words are the alphabet, and a block is two words. A shift table tells for each
block how far the end of the search window may move; blocks in no pattern move it by the most. At
shift 0 the block selects a bucket, the first words select patterns within it, and a direct
comparison confirms each occurrence. Patterns of each length have tables of their own.

The benchmark is read in parts of at most ``MAX_WINDOWS`` windows (about half a kilobyte each in a Python
worker), each shipped to the executors. The tables of all parts are in memory together, so a part's size is bounded, that of the benchmark is not.
A null or empty text has no words. Items without words have no window; a null item id counts as the empty one; equal ids
are one item. Repeated rows are scored alike. Other columns of the documents pass through.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.llm.common import table

WINDOW = 10
MAX_WINDOWS = 200_000
#: Bytes of text that are split into words at a time.
BLOCK = 1 << 22
_CLASS = bytes((c + 32 if 65 <= c <= 90 else c) if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of letters, digits and characters beyond ASCII."""
    return (text or "").encode().translate(_CLASS).split()


class Patterns:
    """Tables for windows of one length of ``size`` words."""

    def __init__(self, size: int) -> None:
        self.size, self.block = size, min(2, size)
        self.shift: dict[tuple, int] = {}
        self.bucket: dict[tuple, dict[tuple, list[tuple]]] = {}
        self.known: dict[tuple, frozenset[str]] = {}

    def add(self, window: tuple, item: frozenset[str]) -> None:
        """A window of an item; windows of one item share the set that names it."""
        if (known := self.known.get(window)) is not None:
            if not item <= known:
                self.known[window] = known | item
            return
        self.known[window] = item
        m, b = self.size, self.block
        for end in range(b, m + 1):
            block = window[end - b : end]
            self.shift[block] = min(self.shift.get(block, m - b + 1), m - end)
        self.bucket.setdefault(window[m - b :], {}).setdefault(window[:b], []).append(window)

    def search(self, w: list[bytes], hits: list[tuple[int, int]], items: set[str]) -> None:
        m, b, n, far = self.size, self.block, len(w), self.size - self.block + 1
        shift, bucket, end = self.shift.get, self.bucket, m
        while end <= n:
            block = (w[end - 2], w[end - 1]) if b == 2 else (w[end - 1],)
            if step := shift(block, far):
                end += step
                continue
            at = end - m
            here = tuple(w[at:end])
            for window in bucket[block].get(here[:b], ()):
                if here == window:
                    hits.append((at, end))
                    items |= self.known[window]
            end += 1


def build(rows: list[tuple[str | None, str | None]], window: int = WINDOW) -> list[Patterns]:
    by_size: dict[int, Patterns] = {}
    for item, text in rows:
        w = words(text)
        size, name = min(window, len(w)), frozenset(["" if item is None else str(item)])
        for at in range(len(w) - size + 1 if size else 0):
            by_size.setdefault(size, Patterns(size)).add(tuple(w[at : at + size]), name)
    return list(by_size.values())


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


FOUND = "n_words long, starts array<int>, ends array<int>, items array<string>"


def _scan(shared):
    @F.pandas_udf(FOUND)
    def scan(texts: pd.Series, before: pd.DataFrame) -> pd.DataFrame:
        out = defaultdict(list)
        for text, s0, e0, i0 in zip(texts, before["starts"], before["ends"], before["items"], strict=True):
            w, hits, items = words(text), [*zip(s0, e0, strict=True)], {*i0}
            for p in shared.value:
                p.search(w, hits, items)
            spans = merged(hits)
            for k, v in (("n_words", len(w)), ("starts", [s for s, _ in spans]), ("ends", [e for _, e in spans]), ("items", sorted(items))):
                out[k].append(v)
        return pd.DataFrame(out, columns=["n_words", "starts", "ends", "items"])

    return scan


def _parts(benchmark: DataFrame, window: int, max_windows: int) -> Iterator[list]:
    known = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    # A text has no more windows than half its characters.
    total = known.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // (2 * max_windows)))
    for k in range(n):
        part = known if n == 1 else known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [tuple(r) for r in part.collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """row (struct of the input's columns) and found: n_words, starts, ends (merged spans of hit words), items."""
    sc = docs.sparkSession.sparkContext
    none = F.array().cast("array<int>")
    empty = F.struct(F.lit(0).cast("long").alias("n_words"), none.alias("starts"), none.alias("ends"), F.array().cast("array<string>").alias("items"))
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("t"), empty.alias("found"))
    for part in _parts(benchmark, window, max_windows):
        out = out.withColumn("found", _scan(sc.broadcast(build(part, window)))("t", "found"))
    return out.drop("t")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    return contamination(docs, benchmark, window).where(F.size("found.starts") == 0).select("row.*")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.zip_with("found.starts", "found.ends", lambda s, e: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(F.col("row.doc_id").alias("doc_id"), F.col("found.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("found.items").cast("long").alias("n_items"), F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


#: {docs}: the table or query; {out}: columns of f.
CLEAN_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r_, * FROM {docs}),
dw AS (SELECT r_, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
bw AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item, w, least(10, len(w)) AS m FROM bw WHERE len(w) > 0),
p AS (SELECT DISTINCT item, m, array_to_string(w[i : i + m - 1], ' ') AS s FROM (SELECT item, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM bs)),
ms AS (SELECT DISTINCT m FROM p),
dg AS (SELECT r_, i, m, array_to_string(w[i : i + m - 1], ' ') AS s FROM (SELECT r_, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, ms WHERE len(w) >= m)),
h AS (SELECT r_, i, dg.m, item FROM dg JOIN p ON dg.m = p.m AND dg.s = p.s),
hw AS (SELECT r_, count(DISTINCT x)::BIGINT AS n_hit FROM (SELECT r_, unnest(range(i, i + m)) AS x FROM h) GROUP BY r_),
hi AS (SELECT r_, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r_, item FROM h) GROUP BY r_),
f AS (SELECT d.*, len(dw.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
      FROM d JOIN dw USING (r_) LEFT JOIN hw USING (r_) LEFT JOIN hi USING (r_))
SELECT {out} FROM f
"""
SQL = {"op7_decontaminate": CLEAN_SQL.format(docs="documents", out="doc_id, n_words, n_hit, n_items, items_sha256, contaminated")}
