"""Removal of repeated byte strings in corpus order, by prefix-free parsing.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else goes. Texts are parsed into phrases by
a rolling hash of 8 bytes: a window of ``LENGTH`` bytes belongs to its trigger, the least hash of the first ``SPAN``
positions in it, and the windows in a row that share a trigger are a phrase. A trigger depends on a window's own bytes alone, so equal windows
have their trigger at the same place, whatever is around them, and equal passages have equal phrases.

The corpus order of windows is never written out. A window is a suffix of the dictionary (its bytes ahead of the trigger) and a prefix
of a parse suffix (its bytes from the trigger on). All windows of a trigger share its ``LENGTH - SPAN + 1`` first bytes, the phrase's core;
phrases whose core occurs once are put aside with a count. Equal phrases with equal surroundings, as in the
inside of copies, are one entry from then on, however often they occur, and repeated at all of their windows.
What is left are phrases at the ends of passages. Those of a core meet in one bucket: the suffix array of its
dictionary (phrases read backwards from the trigger) and that of its parse (texts read on from the trigger), each with the common
prefixes of its neighbours, give both ranks of each window for each distance from the trigger, and windows beside
each other in the order of (dictionary, parse) that share both are equal. Buckets over ``BUCKET`` entries are
not gathered; their windows are counted by 128-bit digest, with partial sums, instead. Phrases are told apart by 128-bit digests as well.

A document is a row; repeated rows are documents of their own. A null text is empty. Texts are UTF-8 bytes; texts
of any length are read whole, ``PART`` positions at a time. Texts under ``LENGTH`` bytes and empty texts stay as they are. An empty table has no rows. Other
columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.llm.common import checkpointed, table

LENGTH = 400
#: Positions of a window that its trigger is looked for in, a power of two.
SPAN = 256
#: Bytes of the rolling hash.
GRAM = 8
#: Positions that are parsed at a time.
PART = 1 << 20
#: Entries that are sorted together; buckets over this are counted by digest.
BUCKET = 4096
#: Phrases that a task gives out at a time.
ROWS = 1 << 18
#: Entries with bytes that a task gives out at a time.
HELD = 1 << 13
_MIX = np.uint64(0x9E3779B97F4A7C15)


def phrases(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Triggers, and the first and the last start of the windows that belong to each, in order, part by part."""
    starts = len(text) - LENGTH + 1
    for at in range(0, starts, PART):
        n = min(PART, starts - at)
        grams = np.ndarray((n + SPAN - 1,), dtype="<u8", buffer=text, offset=at, strides=(1,))
        place = np.arange(n + SPAN - 1, dtype=np.uint64)
        # The hash in the upper bits, the position in the lower, so the first of equal hashes wins.
        low = (grams * _MIX) & ~np.uint64((1 << 24) - 1) | place
        width = 1
        while width < SPAN:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        trigger = (low[:n] & np.uint64((1 << 24) - 1)).astype(np.int64)
        cut = np.flatnonzero(trigger[1:] != trigger[:-1])
        first, last = np.concatenate([[0], cut + 1]), np.concatenate([cut, [n - 1]])
        yield trigger[first] + at, first + at, last + at


def digests(parts: Iterator[bytes], size: int) -> np.ndarray:
    """Digests of byte strings, as rows of int64."""
    return np.frombuffer(b"".join(hashlib.blake2b(p, digest_size=size).digest() for p in parts), dtype="<i8").reshape(-1, size // 8)


def cores(text: bytes, triggers: np.ndarray) -> np.ndarray:
    return digests((text[e : e + LENGTH - SPAN + 1] for e in triggers.tolist()), 8)[:, 0]


def contents(text: bytes, triggers: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Digests of all bytes of a phrase's windows, and of where its trigger stands among them."""
    return digests((bytes((e - p, e - q)) + text[p : q + LENGTH] for e, p, q in zip(triggers.tolist(), first.tolist(), last.tolist(), strict=True)), 16)


CORES = "core long"
PHRASES = "core long, c1 long, c2 long, k1 long, k2 long, at int, lo int, hi int"


def _in_batches(make):
    """Rows of many texts in a frame, made by make(row) -> frames of arrays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held: list[dict] = []
            size = 0
            for row in b.itertuples(index=False):
                for part in make(row):
                    held.append(part)
                    size += len(part["core"])
                    if size >= ROWS:
                        yield pd.DataFrame({c: np.concatenate([x[c] for x in held]) for c in held[0]})
                        held, size = [], 0
            if held:
                yield pd.DataFrame({c: np.concatenate([x[c] for x in held]) for c in held[0]})

    return run


def _cores(row) -> Iterator[dict]:
    for e, _, _ in phrases(row.text):
        yield {"core": cores(row.text, e)}


def _phrases(row) -> Iterator[dict]:
    for e, lo, hi in phrases(row.text):
        c = contents(row.text, e, lo, hi)
        k1, k2 = np.full(len(e), row.k1), np.full(len(e), row.k2)
        yield {"core": cores(row.text, e), "c1": c[:, 0], "c2": c[:, 1], "k1": k1, "k2": k2, "at": e, "lo": lo, "hi": hi}


def _wanted(bucket: int):
    """Entries (a document's text, and the phrases wanted of it) -> the bytes around each trigger, or, of large buckets, its windows' digests."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["core", "n", "k1", "k2", "at", "lo", "hi", "back", "on", "d1", "d2"]
        for b in batches:
            out: list[tuple] = []
            for k1, k2, text, wanted in zip(b["k1"], b["k2"], b["text"], b["wanted"], strict=True):
                for w in wanted:
                    at, lo, hi = w["at"], w["lo"], w["hi"]
                    if w["m"] <= bucket:
                        out.append((w["core"], w["n"], k1, k2, at, lo, hi, text[lo:at][::-1], text[at : hi + LENGTH], 0, 0))
                    else:
                        ds = digests((text[i : i + LENGTH] for i in range(lo, hi + 1)), 16).tolist()
                        out += [(w["core"], w["n"], k1, k2, at, i, i, b"", b"", *d) for i, d in enumerate(ds, lo)]
                    if len(out) >= HELD:
                        yield pd.DataFrame(out, columns=names)
                        out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    return run


ENTRIES = "core long, n int, k1 long, k2 long, at int, lo int, hi int, back binary, on binary, d1 long, d2 long"
SPANS = "k1 long, k2 long, lo int, hi int"


def _sorted(strings: list[bytes], group: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of strings by group and content, and how many bytes each shares with the one ahead of it in that order; -1 across groups."""
    table_ = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), dtype=np.uint8).reshape(len(strings), width)
    rank = np.empty(len(strings), dtype=np.int64)
    rank[np.argsort(np.ascontiguousarray(table_).view(f"S{width}").ravel(), kind="stable")] = np.arange(len(strings))
    order = np.lexsort((rank, group))
    mine, above = table_[order[1:]], table_[order[:-1]]
    differ = mine != above
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    shared[group[order[1:]] != group[order[:-1]]] = -1
    return order, np.concatenate([[-1], shared])


def repeated(core: np.ndarray, n: np.ndarray, before: np.ndarray, nearest: np.ndarray, back: list[bytes], on: list[bytes]) -> np.ndarray:
    """For each entry and distance from the trigger whether the window there occurs again. ``before`` and ``nearest`` are the largest
    and the least distance of an entry's windows; ``back`` the bytes ahead of the trigger, read backwards; ``on`` those from it on."""
    count = len(core)
    words, word_shared = _sorted(back, core, SPAN)
    parse, parse_shared = _sorted(on, core, LENGTH)
    parse_rank = np.empty(count, dtype=np.int64)
    parse_rank[parse] = np.arange(count)
    out = np.zeros((count, SPAN), dtype=bool)
    for d in range(SPAN):
        here = np.flatnonzero((nearest <= d) & (d <= before))
        if len(here) == 0:
            continue
        # Suffixes of d bytes of the dictionary, and prefixes of LENGTH - d bytes of the parse, that are equal share a number.
        word, text = np.empty(count, dtype=np.int64), np.empty(count, dtype=np.int64)
        word[words] = np.cumsum(word_shared < d)
        text[parse] = np.cumsum(parse_shared < LENGTH - d)
        order = here[np.lexsort((parse_rank[here], word[here]))]
        same = (word[order[1:]] == word[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
        again = n[order] > 1
        again[1:] |= same
        again[:-1] |= same
        out[order, d] = again
    return out


def _buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries sorted by core -> the starts of repeated windows of those that occur once, as ranges."""

    def done(b: pd.DataFrame) -> pd.DataFrame:
        at, lo, hi, n = (b[c].to_numpy(dtype=np.int64) for c in ("at", "lo", "hi", "n"))
        found = repeated(b["core"].to_numpy(dtype=np.int64), n, at - lo, at - hi, list(b["back"]), list(b["on"]))
        found[n > 1] = False
        row, d = np.nonzero(found[:, ::-1])
        start = at[row] - (SPAN - 1 - d)
        if not len(row):
            return pd.DataFrame(columns=["k1", "k2", "lo", "hi"])
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)])
        first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:] - 1, len(row) - 1)
        return pd.DataFrame({"k1": b["k1"].to_numpy()[row[first]], "k2": b["k2"].to_numpy()[row[first]], "lo": start[first], "hi": start[last]})

    held: list[pd.DataFrame] = []
    size = 0
    for b in batches:
        held.append(b)
        size += len(b)
        if size >= BUCKET:
            now = pd.concat(held, ignore_index=True)
            core = now["core"].to_numpy()
            # The last bucket may go on in the next batch.
            cut = int(np.flatnonzero(core != core[-1])[-1]) + 1 if (core != core[-1]).any() else 0
            held, size = [now.iloc[cut:]], len(now) - cut
            if cut:
                yield done(now.iloc[:cut].reset_index(drop=True))
    if size:
        yield done(pd.concat(held, ignore_index=True))


def cut_spans(length: int, lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the windows that start at lo..hi."""
    out: list[list[int]] = []
    for p, q in sorted(zip(lo.tolist(), hi.tolist(), strict=True)):
        if out and p <= out[-1][1]:
            out[-1][1] = max(out[-1][1], q + LENGTH)
        else:
            out.append([p, q + LENGTH])
    return [(p, min(q, length)) for p, q in out]


FOUND = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<lo:int,hi:int>>, kept binary"


def _cut(texts: bool):
    @F.pandas_udf(FOUND)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, starts in batches:
            out = []
            for t, s in zip(text, starts, strict=True):
                s = [] if s is None else s
                spans = cut_spans(len(t), np.array([x["lo"] for x in s], dtype=np.int64), np.array([x["hi"] for x in s], dtype=np.int64))
                kept, at = [], 0
                for p, q in spans:
                    kept.append(t[at:p])
                    at = q
                kept = b"".join([*kept, t[at:]])
                out.append((len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"lo": p, "hi": q} for p, q in spans], kept if texts else None))
            yield pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return run


def _key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.col("doc_id").isNull(), F.col("text"))


def repeated_starts(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """k1, k2, starts: for each document (by both keys) the ranges of starts of windows that occur again. ``docs`` has k1, k2, text (binary)."""
    long = docs.where(F.octet_length("text") >= LENGTH)
    # Written, so that both sides of the joins on a core are plain tables and a core with very many rows is split between tasks.
    often = checkpointed(long.select("text").mapInPandas(_in_batches(_cores), CORES).groupBy("core").agg(F.count("*").alias("seen")).where("seen > 1").select("core"))
    rows = checkpointed(long.mapInPandas(_in_batches(_phrases), PHRASES).join(often, "core"))
    first = F.min(F.struct("k1", "k2", "at", "lo", "hi")).alias("f")
    entries = rows.groupBy("core", "c1", "c2").agg(F.count("*").alias("n"), first)
    entries = checkpointed(entries.select("core", "c1", "c2", F.least("n", F.lit(2)).cast("int").alias("n"), "f.*"))
    whole = rows.join(entries.where("n > 1").select("core", "c1", "c2"), ["core", "c1", "c2"], "left_semi").select("k1", "k2", "lo", "hi")
    # Buckets with an entry that occurs once, and with another one that it may share windows with.
    open_ = checkpointed(entries.groupBy("core").agg(F.count("*").cast("int").alias("m"), F.min("n").alias("least")).where("m > 1 AND least = 1").select("core", "m"))
    wanted = entries.join(open_, "core").groupBy("k1", "k2").agg(F.collect_list(F.struct("core", "n", "m", "at", "lo", "hi")).alias("wanted"))
    # Repeated rows share keys and texts; one of them is enough.
    texts = long.join(wanted, ["k1", "k2"])
    found = checkpointed(texts.mapInPandas(_wanted(bucket), ENTRIES))
    ends = found.where(F.octet_length("on") > 0).repartition("core").sortWithinPartitions("core").mapInPandas(_buckets, SPANS)
    windows = found.where(F.octet_length("on") == 0)
    again = windows.groupBy("d1", "d2").agg(F.sum("n").alias("seen")).where("seen > 1").select("d1", "d2")
    counted = windows.where("n = 1").join(again, ["d1", "d2"]).select("k1", "k2", "lo", "hi")
    spans = whole.unionByName(ends).unionByName(counted)
    return spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("starts"))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", _key(1).alias("k1"), _key(2).alias("k2"), F.col("text").cast("binary").alias("text"))


def without_repeats(docs: DataFrame, texts: bool = True, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (of bytes removed) and, if wanted, kept (the bytes left) of each row."""
    rows = keyed(docs)
    starts = repeated_starts(rows.select("k1", "k2", "text"), bucket)
    return rows.join(starts, ["k1", "k2"], "left").select("doc_id", _cut(texts)("text", "starts").alias("f")).select("doc_id", "f.*")


def op12_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents"), texts=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


SQL = {
    "op12_suffixes": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT r, unnest(range(n - 399)) AS i FROM d WHERE n >= 400),
m AS (SELECT w.r, w.i, md5(substr(d.h, 2 * w.i + 1, 800)) AS m FROM w JOIN d ON w.r = d.r),
s AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY m) AS c FROM m) WHERE c > 1),
g AS (SELECT r, i, sum(g) OVER (PARTITION BY r ORDER BY i) AS g
      FROM (SELECT r, i, CASE WHEN i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -401) + 400 THEN 1 ELSE 0 END AS g FROM s)),
x AS (SELECT r, min(i) AS lo, max(i) + 400 AS hi FROM g GROUP BY r, g),
y AS (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS from_ FROM x),
z AS (SELECT y.r, string_agg(substr(d.h, 2 * y.from_ + 1, 2 * (y.lo - y.from_)), '' ORDER BY y.lo) AS head,
        max(y.hi) AS at_, sum(y.hi - y.lo)::BIGINT AS gone, count(*) AS n FROM y JOIN d ON y.r = d.r GROUP BY y.r)
SELECT d.doc_id, d.n AS n_bytes, coalesce(z.gone, 0)::BIGINT AS n_removed, coalesce(z.n, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(z.head, '') || substr(d.h, 2 * coalesce(z.at_, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN z ON d.r = z.r
"""
}
