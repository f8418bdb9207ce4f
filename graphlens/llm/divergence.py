"""Source divergence audit: how far the word use of a language's sources is apart.

Tasks count terms over parts of the documents and add the counts up before Spark deals them out by language,
source and term. A language keeps the terms of at least ``MIN_DOCS`` of its documents. The kept terms of a
language are cut into blocks, and its sources into strips; for each block and pair of strips a task
builds two dense int64 tiles, source by term, and sums the divergence of all pairs of their sources by
broadcasting. Partial pair matrices are added up by Spark. Each tile also gives the best terms of each of
its sources, a heap of ``TOP`` for each block, which are merged by source.

All arithmetic is in integers. With c the occurrences of a term in a group, N those of all kept terms there
and V the kept terms of the language, p = 1 + floor(1e9 (c + 2) / (N + 2 V)); two groups are apart at a term by
floor((p - q)^2 / (p + q)). ``scaled`` divides in three steps of a thousand, so counts up to 9e15 stay exact.

Null texts, languages and sources count as the empty string. Every group (language, source) that occurs takes
part, with or without terms; in a language without kept terms all pairs are 0 apart. A language with one source has no pairs. Repeated rows
are documents of their own. Ties go by the UTF-8 order of the item. Texts of any length are read whole, in parts. An
empty table has no rows. Other columns play no part.

Memory of a task: a tile has at most ``STRIP`` x ``BLOCK`` cells, a pair matrix ``STRIP`` squared. The result
itself holds a row for each ordered pair of a language's sources.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlens.llm.common import checkpointed, join_small, table

MIN_DOCS = 10
TOP = 10
#: Kept terms of a block, about; sources of a strip.
BLOCK, STRIP = 2048, 256
#: Cells of a broadcast of all pairs that are worked on at a time.
CELLS = 1 << 20
#: Different (group, term) counts that a task holds at most.
HELD = 400_000
#: Bytes of a text that are cut into terms at a time.
PART = 1 << 22

#: Bytes -> lower-cased letters, all bytes of other characters as they are, and a space for what separates.
_MAP = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text's bytes, a part at a time."""
    at = 0
    while at < len(text):
        end = at + PART
        if end < len(text):
            part = text[at:end].translate(_MAP)
            cut = part.rfind(b" ")
            while cut <= 0 and end < len(text):
                end += PART
                part = text[at:end].translate(_MAP)
                cut = part.rfind(b" ") if end < len(text) else len(part)
            yield part[:cut].split()
            at += cut
        else:
            yield text[at:].translate(_MAP).split()
            return


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial occurrences and documents by language, source and term."""
    total: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}
    held = 0

    def given() -> Iterator[pa.RecordBatch]:
        for (lang, source), n in total.items():
            d, size = docs[lang, source], len(n)
            names = [pa.repeat(pa.scalar(x, pa.string()), size) for x in (lang, source)]
            numbers = [pa.array(x, pa.int64()) for x in (n.values(), map(d.__getitem__, n))]
            yield pa.RecordBatch.from_arrays([*names, pa.array(n.keys(), pa.binary()), *numbers], names=["lang", "source", "term", "n", "docs"])
        total.clear()
        docs.clear()

    for b in batches:
        for lang, source, text in zip(*(b.column(c) for c in ("lang", "source", "text")), strict=True):
            group = (lang.as_py(), source.as_py())
            n = total.setdefault(group, Counter())
            before, own = len(n), set()
            for part in terms(text.as_py()):
                n.update(part)
                own.update(part)
            docs.setdefault(group, Counter()).update(own)
            held += len(n) - before
            if held > HELD:
                yield from given()
                held = 0
    yield from given()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs, dealt out by language and term."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    rows = docs.select(text("lang"), text("source"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    counted = rows.mapInArrow(_counts, "lang string, source string, term binary, n long, docs long")
    dealt = counted.withColumn("term", F.col("term").cast("string")).repartition("lang", "term")
    return dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def scaled(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """floor(1e9 part / whole) for 0 <= part <= whole, in int64."""
    out, rest = np.zeros(np.broadcast(part, whole).shape, dtype=np.int64), part
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def pair_matrix(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Divergence of each row of p from each row of q, summed over the columns."""
    out = np.zeros((len(p), len(q)), dtype=np.int64)
    step = max(1, CELLS // max(1, q.size))
    wide = max(1, CELLS // max(1, len(q)))
    for c in range(0, p.shape[1], wide):
        x, y = p[:, c : c + wide], q[:, c : c + wide]
        for r in range(0, len(p), step):
            out[r : r + step] += apart(x[r : r + step, None, :], y[None, :, :]).sum(axis=2)
    return out


TILE = "lang string, part string, a int, b int, item string, value long"


def tile_results(lang: str, n_terms: int, strips: tuple[int, int], sizes: tuple[np.ndarray, np.ndarray], whole: int, cells: pd.DataFrame, wide: int, top: int = TOP) -> pd.DataFrame:
    """A partial pair matrix of two strips over a block of terms; on the diagonal also the best terms of each source.

    sizes: N + 2 V of the sources of either strip; whole: that of the language. cells: source number, term, n, total; wide: sources of a strip."""
    names, column = np.unique(cells["term"].to_numpy(dtype=object), return_inverse=True) if len(cells) else (np.array([], dtype=object), np.array([], dtype=int))
    number, n = cells["number"].to_numpy(dtype=np.int64), cells["n"].to_numpy(dtype=np.int64)
    tiles, counts = [], []
    for strip, size in zip(strips, sizes, strict=True):
        count = np.zeros((len(size), len(names)), dtype=np.int64)
        mine = number // wide == strip
        count[number[mine] - strip * wide, column[mine]] = n[mine]
        counts.append(count)
        tiles.append(1 + scaled(count + 2, size[:, None]))
    pairs = pair_matrix(*tiles)
    # Terms of the block that neither strip has.
    bare = [1 + scaled(np.full(len(s), 2), s) for s in sizes]
    pairs += (n_terms - len(names)) * apart(bare[0][:, None], bare[1][None, :])
    a, b = np.meshgrid(np.arange(len(sizes[0])) + strips[0] * wide, np.arange(len(sizes[1])) + strips[1] * wide, indexing="ij")
    use = a < b
    out = [pd.DataFrame({"part": "pair", "a": a[use], "b": b[use], "item": None, "value": pairs[use]})]
    if strips[0] == strips[1] and len(names):
        total = np.zeros(len(names), dtype=np.int64)
        total[column] = cells["total"].to_numpy(dtype=np.int64)
        q = 1 + scaled(total + 2, np.int64(whole))
        p, count = tiles[0], counts[0]
        value = np.where((count > 0) & (p > q), apart(p, q), -1)
        for i in range(len(p)):
            # np.unique sorts by code point, which is the order of UTF-8.
            best = np.lexsort((np.arange(len(names)), -value[i]))[:top]
            best = best[value[i][best] >= 0]
            out.append(pd.DataFrame({"part": "term", "a": i + strips[0] * wide, "b": 0, "item": names[best], "value": value[i][best]}))
    return pd.concat(out, ignore_index=True).assign(lang=lang)[["lang", "part", "a", "b", "item", "value"]]


def _tile(wide: int, top: int):
    def run(key: tuple, head: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        h = head.iloc[0]
        sizes = tuple(np.asarray(h[c], dtype=np.int64) for c in ("sizes_a", "sizes_b"))
        return tile_results(key[0], int(h["n_terms"]), (int(key[2]), int(key[3])), sizes, int(h["whole"]), cells, wide, top)

    return run


def _block(term: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(term), blocks).cast("int")


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK, wide: int = STRIP) -> DataFrame:
    """lang, source, part, item, value, rank."""
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    # A list holds a number for each source of the language at most. All sums by term take one shuffle.
    by_term = term_counts(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("cells"))
    kept = checkpointed(by_term.where(F.col("docs") >= min_docs).select("lang", "term", "total", "cells"))
    cells = kept.select("lang", "term", "total", F.explode("cells").alias("c")).select("lang", "c.source", "term", "c.n", "total")
    words = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("whole"))
    sizes = cells.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    # Numbers of a language's sources; the result has a row for each pair of them.
    numbered = groups.join(sizes, ["lang", "source"], "left").join(words, "lang", "left")
    numbered = numbered.select(
        "lang", "source", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("number"),
        F.coalesce("v", F.lit(0)).alias("v"), (F.coalesce("size", F.lit(0)) + 2 * F.coalesce("v", F.lit(0))).alias("size"), (F.coalesce("whole", F.lit(0)) + 2 * F.coalesce("v", F.lit(0))).alias("whole"),
    )
    numbered = checkpointed(numbered)
    strip = lambda c: F.floor(F.col(c) / wide).cast("int")
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("number", c))), lambda x: x[c])
    strips = numbered.where("v > 0").groupBy("lang", "v", "whole", strip("number").alias("s")).agg(in_order("size").alias("sizes"))
    blocks = F.ceil(F.col("v") / block).cast("int")
    side = lambda x: strips.select("lang", "v", "whole", F.col("s").alias(f"s{x}"), F.col("sizes").alias(f"sizes_{x}"))
    # One row for each two strips of a language.
    tiles = side("a").join(side("b").drop("v", "whole"), "lang").where("sa <= sb").withColumn("blocks", blocks)
    per_block = join_small(kept, words.select("lang", "v"), ["lang"]).groupBy("lang", _block(F.col("term"), blocks).alias("block")).agg(F.count("*").cast("int").alias("n_terms"))
    heads = per_block.join(tiles.drop("blocks", "v"), "lang").select("lang", "block", "sa", "sb", "n_terms", "whole", "sizes_a", "sizes_b")
    # A cell goes to each tile that its strip takes part in.
    last = numbered.groupBy("lang").agg(F.max(strip("number")).alias("last"), F.first("v").alias("v"))
    placed = join_small(join_small(cells, numbered.select("lang", "source", "number"), ["lang", "source"]), last, ["lang"])
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last")))).withColumn("own", strip("number"))
    placed = placed.select("lang", _block(F.col("term"), blocks).alias("block"), F.least("own", "other").alias("sa"), F.greatest("own", "other").alias("sb"), "number", "term", "n", "total")
    place = ["lang", "block", "sa", "sb"]
    # Both sides come from the same tables, so the cells' columns get names of their own.
    ours = placed.select(*[F.col(c).alias(f"cell_{c}") for c in place], "number", "term", "n", "total")
    found = checkpointed(heads.groupBy(*place).cogroup(ours.groupBy(*[f"cell_{c}" for c in place])).applyInPandas(_tile(wide, top), TILE))
    name = numbered.select("lang", F.col("number").alias("a"), "source")
    other = numbered.select("lang", F.col("number").alias("b"), F.col("source").alias("item"))
    sums = found.where("part = 'pair'").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    # Languages without kept terms have pairs all the same, at 0.
    bare = numbered.where("v = 0").select("lang", F.col("number").alias("a"))
    bare = bare.join(bare.select("lang", F.col("a").alias("b")), "lang").where("a < b").withColumn("value", F.lit(0).cast("long"))
    sums = sums.unionByName(bare)
    pairs = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    pairs = pairs.join(name, ["lang", "a"]).join(other, ["lang", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    best = found.where("part = 'term'").join(name, ["lang", "a"]).select("lang", "source", "part", "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(best.withColumn("rank", rank).where(F.col("rank") <= top))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


SQL = {
    "op13_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT i, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS total FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS whole FROM k GROUP BY lang),
c AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
s AS (SELECT lang, source, sum(n)::HUGEINT AS size FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
        1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.size, 0) + 2 * v.v) AS p,
        1 + (1000000000::HUGEINT * (k.total + 2)) // (v.whole + 2 * v.v) AS q
      FROM g JOIN k ON g.lang = k.lang JOIN v ON v.lang = g.lang
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN s ON s.lang = g.lang AND s.source = g.source),
x AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
t AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (FROM y UNION ALL FROM t))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""
}
