"""Tiled exact comparison of fingerprints.

Rows lie in numbered cells; only rows of near cells can be within the radius. A cell over ``tile``
in weight is split into pieces by hash, and a piece is a tile: its home rows meet each other, the
later pieces of their cell, and all rows of the near cells. A tile with many visitors is dealt out
in chunks, each with all of its home rows, so that no task holds or reads more than a bounded weight
of either.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm.common import checkpointed

#: Weight of the visitors of a tile in one chunk, as a multiple of a tile's.
CHUNK = 16
#: Cells of a matrix of bit counts that are worked on at a time.
BLOCK = 1 << 18
PLACE = ["cell", "piece", "chunk"]


def dealt(rows: DataFrame, near: list[int], tile: int) -> DataFrame:
    """Rows with cell (long), weight, and id -> the same rows by cell, piece, chunk and visits, as often as they
    are needed. ``near`` holds the offsets of the cells whose rows visit a cell from behind."""
    # The callers' cells are bounded in number, however many rows there are, so this side may be broadcast.
    cells = checkpointed(rows.groupBy("cell").agg(F.sum("weight").alias("own")))
    steps = F.array(F.struct(F.lit(0).cast("long").alias("by")), *[F.struct(F.lit(x).cast("long").alias("by")) for x in near])
    guests = cells.select(F.explode(steps).alias("s"), "cell", "own").groupBy((F.col("cell") + F.col("s.by")).alias("cell")).agg(F.sum("own").alias("guests"))
    cells = checkpointed(
        cells.join(F.broadcast(guests), "cell").select(
            "cell", F.ceil(F.col("own") / tile).cast("long").alias("pieces"), F.ceil(F.col("guests") / (CHUNK * tile)).cast("long").alias("chunks")
        )
    )
    columns = rows.columns
    own = rows.join(F.broadcast(cells), "cell").withColumn("piece", F.pmod(F.xxhash64(F.lit(7), "id"), F.col("pieces")))
    others = [c for c in columns if c != "cell"]
    to = lambda low: F.explode(F.sequence(low, F.col("pieces") - 1))
    chunk = F.pmod(F.xxhash64(F.lit(8), "id"), F.col("chunks"))
    home = own.select(*columns, "piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(False).alias("visits"))
    later = own.where(F.col("piece") + 1 < F.col("pieces")).select(*columns, to(F.col("piece") + 1).alias("_p"), "chunks")
    later = later.select(*columns, F.col("_p").alias("piece"), chunk.alias("chunk"), F.lit(True).alias("visits"))
    out = home.unionByName(later)
    if near:
        offsets = F.array(*[F.lit(x).cast("long") for x in near])
        abroad = rows.select(*others, F.col("cell").alias("_from"), F.explode(offsets).alias("_by")).select(*others, (F.col("_from") + F.col("_by")).alias("cell"))
        abroad = abroad.join(F.broadcast(cells), "cell").select(*columns, to(F.lit(0).cast("long")).alias("piece"), "chunks")
        out = out.unionByName(abroad.select(*columns, "piece", chunk.alias("chunk"), F.lit(True).alias("visits")))
    return out.repartition(*PLACE).sortWithinPartitions(*PLACE, "visits")


def near_pairs(a: np.ndarray, b: np.ndarray, radii: list[tuple[int, int]], ahead: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions i, j of rows of ``a`` and ``b`` (unsigned words by row) and their differing bits, in blocks. ``radii``
    holds (words, most differing bits in the first so many words); the last covers all. With ``ahead`` only
    pairs with j > i + ahead count. Blocks whose bit counts differ beyond the radius are skipped."""
    if not len(a) or not len(b):
        return
    first, most = radii[0]
    count = lambda x: np.bitwise_count(x[:, :first]).sum(axis=1, dtype=np.int64)
    low, high = (c := count(b)).min(), c.max()
    ours = count(a)
    step = max(1, BLOCK // len(b))
    lead = np.ascontiguousarray(b[:, 0])
    for at in range(0, len(a), step):
        part = a[at : at + step]
        if ours[at : at + step].min() - high > most or low - ours[at : at + step].max() > most:
            continue
        i, j = np.nonzero(np.bitwise_count(part[:, 0][:, None] ^ lead[None, :]) <= most)
        if ahead is not None:
            late = j > i + at + ahead
            i, j = i[late], j[late]
        d = np.bitwise_count(part[i, 0] ^ lead[j]).astype(np.int64)
        done = 1
        for words, limit in radii:
            if words > done and len(i):
                d = d + np.bitwise_count(part[i, done:words] ^ b[j, done:words]).sum(axis=1, dtype=np.int64)
                good = d <= limit
                i, j, d, done = i[good], j[good], d[good], words
        if len(i):
            yield i + at, j, d


class Forest:
    """Links that join what was apart."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, x, y) -> bool:
        p, q = self.root(x), self.root(y)
        if p != q:
            self.up[max(p, q)] = min(p, q)
        return p != q


def by_tile(start: Callable, columns: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A function for mapInPandas over dealt rows. ``start(place)`` makes an object for each tile and
    chunk, whose add(rows) and end() return rows to give out or None."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = place = None
        for b in batches:
            out, key = [], np.stack([b[c].to_numpy() for c in PLACE], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(b)]
            for at, end in zip(cuts[:-1], cuts[1:], strict=True):
                if at == end:
                    continue
                here = tuple(key[at].tolist())
                if here != place:
                    out += [now.end()] if now else []
                    now, place = start(here), here
                out.append(now.add(b.iloc[at:end]))
            out = [x for x in out if x is not None and len(x)]
            yield pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=columns)
        if now:
            last = now.end()
            if last is not None and len(last):
                yield last

    return run
