"""SimHash near-duplicates by tiled exact comparison.

``near_duplicates``: 64-bit fingerprints of three-word shingles, linked within a radius. The distinct
fingerprints lie in cells by the bit counts of their four 16-bit lanes. Two fingerprints within the
radius differ in those counts by no more than the radius in total, so only cells whose counts are
that close are compared; all other pairs of tiles are skipped. Within a tile numpy's exclusive-or and
bit counts compare everything with everything, and only a spanning forest of the links found leaves
the task. Components of the links give the groups.

``similar_texts``: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. The
same tiles compare fingerprints of 1,024 bits within the radius that such pairs keep to; cells are
bands of set sizes, as sizes beyond 4 to 5 rule the similarity out. Rows with a candidate meet once
more in their tiles with their whole sets, which decide exactly.

A null or blank text has no words: fingerprint zero, or the empty set, which link like any other; texts
of fewer words than a shingle are one shingle. Equal rows share a fingerprint. An empty table gives an
empty result. Rows without an id belong to groups, but an id of null is never the smallest unless all
are null. Very long texts are hashed in blocks. Other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphlens.llm.common import checkpointed, join_small, row_key, table
from graphlens.llm.components import components
from graphlens.llm.tiles import PLACE, Forest, by_tile, dealt, near_pairs

WIDTH, RADIUS, SEED = 3, 2, 42
LANES = 4
#: Rows of a tile of short fingerprints.
TILE = 4096
#: Shingles hashed at a time.
BLOCK = 1 << 16
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

#: Words of a shingle and least similarity of similar texts, as a fraction.
SIMILAR_WIDTH, NUM, DEN = 5, 4, 5
#: 64-bit words of a long fingerprint.
LONG = 16
#: Shingles of the sets of a tile.
SIMILAR_TILE = 1 << 23
#: Share of bits in which sets of the least similarity differ at most on average: arccos of the cosine
#: 8 / 9, over pi; somewhat more for small sets, where half the hashes is often met exactly.
SHARE, SMALL_SHARE, SMALL = math.acos(8 / 9) / math.pi, 0.19, 32
#: Standard deviations above that average that are still searched.
SIGMAS = 4.5


def _hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles of a whole text, in blocks."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return
    n, digest, seed = max(1, len(words) - width + 1), xxhash.xxh64_intdigest, SEED
    for at in range(0, n, BLOCK):
        part = words[at : min(at + BLOCK, n) + width - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
        yield np.fromiter((digest(s, seed) for s in shingles), dtype=np.uint64)


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The unsigned 64-bit SimHash of a whole text."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for h in _hashes(text, width):
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


@F.pandas_udf(T.LongType())
def fingerprint_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield pd.Series(np.array([fingerprint(t) for t in s], dtype=np.uint64).view(np.int64), index=s.index)


class _Links:
    """A tile of short fingerprints: its links, as a spanning forest."""

    def __init__(self, radius: int) -> None:
        self.radii, self.home, self.forest = [(1, radius)], np.empty((0, 1), dtype=np.uint64), Forest()

    def add(self, rows: pd.DataFrame) -> pd.DataFrame:
        fp, visits, out = rows["id"].to_numpy().view(np.uint64)[:, None], rows["visits"].to_numpy().astype(bool), []
        mine, others = fp[~visits], fp[visits]
        if len(mine):
            out += self._joined(mine, self.home, None) + self._joined(mine, mine, 0)
            self.home = np.concatenate([self.home, mine])
        out += self._joined(others, self.home, None)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    def _joined(self, a: np.ndarray, b: np.ndarray, ahead: int | None) -> list[tuple[int, int]]:
        out = []
        for i, j, _ in near_pairs(a, b, self.radii, ahead):
            x, y = a[i, 0].view(np.int64).tolist(), b[j, 0].view(np.int64).tolist()
            out += [(p, q) for p, q in zip(x, y, strict=True) if self.forest.join(p, q)]
        return out

    def end(self) -> None:
        return None


def _near_cells(radius: int) -> list[list[int]]:
    """Offsets of lane counts that sum to at most ``radius``, each with its first nonzero one positive."""
    found = [[]]
    for _ in range(LANES):
        found = [[*f, d] for f in found for d in range(-radius, radius + 1) if sum(map(abs, f)) + abs(d) <= radius]
    return [f for f in found if next((d for d in f if d), 0) > 0]


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Distinct fingerprints fp -> edges a, b that connect all pairs within ``radius``."""
    lanes = [F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))).cast("long") for i in range(LANES)]
    base = [64 ** (LANES - 1 - i) for i in range(LANES)]
    # At most 17 ** LANES cells.
    rows = fps.select(F.col("fp").alias("id"), sum((x * b for x, b in zip(lanes, base, strict=True)), F.lit(0)).cast("long").alias("cell"), F.lit(1).alias("weight"))
    near = [sum(x * b for x, b in zip(off, base, strict=True)) for off in _near_cells(radius)]
    return dealt(rows, near, tile).drop("weight").mapInPandas(by_tile(lambda _: _Links(radius), ["a", "b"]), "a long, b long")


def _groups(named: DataFrame, node: str) -> DataFrame:
    """node, root, first -> node, component_id and keep: the smallest id of a group, and the key of that row."""
    heads = named.groupBy("root").agg(F.min("first").alias("head"))
    return checkpointed(named.select(node, "root").join(heads, "root").select(node, F.col("head.doc_id").alias("component_id"), F.col("head.k").alias("keep")))


def _first() -> Column:
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k")).alias("first")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """k (row_key), doc_id, fp, component_id, and keep: the k of the one row that stands for its group."""
    rows = checkpointed(docs.select(row_key().alias("k"), "doc_id", fingerprint_udf("text").alias("fp")))
    fps = checkpointed(rows.groupBy("fp").agg(_first()))
    roots = components(links(fps.select("fp"), radius))
    named = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    return join_small(rows, _groups(named, "fp"), ["fp"])


def shingles(text: str | None, width: int = SIMILAR_WIDTH) -> np.ndarray:
    """The distinct shingles of a whole text as sorted hashes."""
    return np.unique(np.concatenate([np.empty(0, dtype=np.uint64), *_hashes(text, width)]))


def long_fingerprint(own: np.ndarray) -> bytes:
    """The SimHash of a set of hashes, of LONG words."""
    ones = np.zeros(64 * LONG, dtype=np.int64)
    salts = np.arange(1, LONG + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(own), 255):  # as many as a byte counts
        h = own[at : at + 255, None] + salts[None, :]
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        ones += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(own), bitorder="little").tobytes()


@F.pandas_udf(T.StructType().add("id", T.BinaryType()).add("weight", T.LongType()).add("fp", T.BinaryType()))
def _signed(texts: pd.Series) -> pd.DataFrame:
    sets = [shingles(t) for t in texts]
    return pd.DataFrame({"id": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "weight": [len(s) for s in sets], "fp": [long_fingerprint(s) for s in sets]})


@F.pandas_udf(T.BinaryType())
def _set_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: shingles(t).tobytes())


def _radii(smallest: int) -> list[tuple[int, int]]:
    """For the first 1, 4 and all words: the most differing bits of a pair at the least similarity."""
    p = SMALL_SHARE if smallest < SMALL else SHARE
    return [(w, math.ceil(64 * w * p + SIGMAS * math.sqrt(64 * w * p * (1 - p)))) for w in (1, 4, LONG)]


class _Side:
    """Rows of one side of a tile."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.id, self.n = rows["id"].to_numpy(dtype=object), rows["weight"].to_numpy(dtype=np.int64)
        self.fp = np.frombuffer(b"".join(rows["fp"]), dtype=np.uint64).reshape(-1, LONG)
        self.sets = [np.frombuffer(s, dtype=np.uint64) for s in rows["own"]] if "own" in rows else None

    def radii(self, other: _Side) -> list[tuple[int, int]]:
        return _radii(int(min(self.n.min(initial=SMALL), other.n.min(initial=SMALL))))


def _candidates(a: _Side, b: _Side, ahead: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for i, j, d in near_pairs(a.fp, b.fp, a.radii(b), ahead):
        good = np.minimum(a.n[i], b.n[j]) * DEN >= np.maximum(a.n[i], b.n[j]) * NUM
        if good.any():
            yield i[good], j[good], d[good]


class _Involved:
    """A tile of long fingerprints: the rows that have a candidate there."""

    def __init__(self, place: tuple[int, ...]) -> None:
        self.place, self.parts, self.flags = place, [], []

    def _meet(self, a: _Side, b: _Side, ahead: int | None) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.zeros(len(a.id), dtype=bool), np.zeros(len(b.id), dtype=bool)
        for i, j, _ in _candidates(a, b, ahead):
            x[i] = y[j] = True
        return x, y

    def add(self, rows: pd.DataFrame) -> pd.DataFrame | None:
        visits = rows["visits"].to_numpy().astype(bool)
        home, guests = rows[~visits], rows[visits]
        if len(home):
            side = _Side(home)
            found, again = self._meet(side, side, 0)
            found |= again
            for k, part in enumerate(self.parts):
                x, y = self._meet(side, part, None)
                found |= x
                self.flags[k] |= y
            self.parts.append(side)
            self.flags.append(found)
        if not len(guests):
            return None
        side, found = _Side(guests), np.zeros(len(guests), dtype=bool)
        for k, part in enumerate(self.parts):
            x, y = self._meet(side, part, None)
            found |= x
            self.flags[k] |= y
        return self._rows(side.id[found], True)

    def end(self) -> pd.DataFrame:
        return self._rows(np.concatenate([p.id[f] for p, f in zip(self.parts, self.flags, strict=True)] or [np.empty(0, dtype=object)]), False)

    def _rows(self, ids: np.ndarray, visits: bool) -> pd.DataFrame:
        return pd.DataFrame({"id": ids, **dict(zip(PLACE, self.place, strict=True)), "visits": visits})


#: Words of the bit table in which shared shingles are looked up.
TABLE = 1 << 22


def shared_counts(x: list[np.ndarray], y: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many shingles the sets x[i] and y[j] have in common. Shingles of at least two sets become bits,
    where that table is of a bounded size."""
    a, p = np.unique(i, return_inverse=True)
    b, q = np.unique(j, return_inverse=True)
    sets = [x[k] for k in a] + [y[k] for k in b]
    if len(i) > 2 * len(sets):
        every = np.concatenate(sets)
        common, times = np.unique(every, return_counts=True)
        common = common[times > 1]
        words = -(-max(1, len(common)) // 64)
        if words * len(sets) <= TABLE:
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            at = np.minimum(np.searchsorted(common, every), max(0, len(common) - 1))
            hit = common[at] == every if len(common) else np.zeros(len(every), dtype=bool)
            flat = np.zeros(len(sets) * words, dtype=np.uint64)
            np.bitwise_or.at(flat, owner[hit] * words + at[hit] // 64, np.uint64(1) << (at[hit] % 64).astype(np.uint64))
            bits, q, out = flat.reshape(-1, words), q + len(a), []
            step = max(1, TABLE // words)
            for k in range(0, len(p), step):
                out.append(np.bitwise_count(bits[p[k : k + step]] & bits[q[k : k + step]]).sum(axis=1, dtype=np.int64))
            return np.concatenate(out)
    return np.array([len(np.intersect1d(x[k], y[m], assume_unique=True)) for k, m in zip(i.tolist(), j.tolist(), strict=True)], dtype=np.int64)


class _Similar:
    """A tile of whole sets: the links of at least the least similarity, as a spanning forest."""

    def __init__(self) -> None:
        self.parts, self.forest = [], Forest()

    def add(self, rows: pd.DataFrame) -> pd.DataFrame:
        visits, out = rows["visits"].to_numpy().astype(bool), []
        if (~visits).any():
            home = _Side(rows[~visits])
            out += self._joined(home, home, 0)
            for part in self.parts:
                out += self._joined(home, part, None)
            self.parts.append(home)
        if visits.any():
            guests = _Side(rows[visits])
            for part in self.parts:
                out += self._joined(guests, part, None)
        return pd.DataFrame(out, columns=["a", "b"])

    def _joined(self, a: _Side, b: _Side, ahead: int | None) -> list[tuple[bytes, bytes]]:
        out, root = [], self.forest.root
        for i, j, d in _candidates(a, b, ahead):
            # The nearest first; what they join needs no look at the rest.
            order = np.argsort(d, kind="stable")
            i, j = i[order], j[order]
            for at in (slice(0, len(i) // 16 + 1), slice(len(i) // 16 + 1, None)):
                p, q = i[at], j[at]
                apart = np.array([root(a.id[x]) != root(b.id[y]) for x, y in zip(p.tolist(), q.tolist(), strict=True)], dtype=bool)
                p, q = p[apart], q[apart]
                both = shared_counts(a.sets, b.sets, p, q)
                good = both * DEN >= NUM * (a.n[p] + b.n[q] - both)
                for x, y in zip(p[good].tolist(), q[good].tolist(), strict=True):
                    if self.forest.join(a.id[x], b.id[y]):
                        out.append((a.id[x], b.id[y]))
        return out

    def end(self) -> None:
        return None


def similar_links(sets: DataFrame, sets_of, tile: int = SIMILAR_TILE) -> DataFrame:
    """Distinct sets id, weight (size), fp -> edges a, b that connect all pairs at the least similarity.
    ``sets_of`` gives id and own (the whole set) of the ids asked for."""
    # Sizes in a ratio of 4 to 5 lie in the same band or in neighbouring ones.
    band = F.floor(F.log(F.greatest("weight", F.lit(1)).cast("double")) / math.log(DEN / NUM)).cast("long")
    rows = sets.select("id", F.col("weight"), "fp", F.when(F.col("weight") == 0, F.lit(-9).cast("long")).otherwise(band).alias("cell"))
    # Long fingerprints weigh as well: at most tile / 64 rows.
    rows = rows.withColumns({"size": F.col("weight"), "weight": F.greatest("weight", F.lit(64).cast("long"))})
    placed = checkpointed(dealt(rows, [1], tile).drop("weight").withColumnRenamed("size", "weight").mapInPandas(by_tile(_Involved, ["id", *PLACE, "visits"]), "id binary, cell long, piece long, chunk long, visits boolean"))
    whole = checkpointed(sets_of(placed.select("id").distinct()))
    met = placed.join(whole, "id").join(sets.select("id", "weight", "fp"), "id")
    met = met.repartition(*PLACE).sortWithinPartitions(*PLACE, "visits")
    return met.mapInPandas(by_tile(lambda _: _Similar(), ["a", "b"]), "a binary, b binary")


def similar_texts(docs: DataFrame) -> DataFrame:
    """k (row_key), doc_id, id (of its set of shingles), component_id, and keep: the k of the row that stands for its group."""
    rows = checkpointed(docs.select(row_key().alias("k"), "doc_id", _signed("text").alias("s")).select("k", "doc_id", "s.*"))
    sets = checkpointed(rows.groupBy("id").agg(F.first("weight").alias("weight"), F.first("fp").alias("fp"), _first()))
    keyed = docs.select(row_key().alias("k"), "text")

    def sets_of(ids: DataFrame) -> DataFrame:
        want = checkpointed(sets.join(ids, "id", "left_semi").select("id", F.col("first.k").alias("k")))
        return join_small(keyed, want, ["k"]).select("id", "text").dropDuplicates(["id"]).select("id", _set_udf("text").alias("own"))

    roots = components(similar_links(sets.select("id", "weight", "fp"), sets_of))
    named = sets.join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("root"), "first")
    return join_small(rows.select("k", "doc_id", "id"), _groups(named, "id"), ["id"])


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of each group of ``found`` (k, keep). Of rows equal in id and text the one with the smallest hash
    of all its columns stays, so that reruns agree. Only rows that go or repeat are looked up."""
    special = found.groupBy("k").agg(F.first("keep").alias("keep"), F.count("*").alias("n")).where((F.col("keep") != F.col("k")) | (F.col("n") > 1))
    special = checkpointed(special.select("k", (F.col("keep") == F.col("k")).alias("stays")))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = join_small(docs.select(whole.alias("row"), row_key().alias("k")), special, ["k"], "left")
    plain = [F.col(f"row.`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    repeats = rows.where(F.col("stays")).groupBy("k").agg(F.min_by("row", F.xxhash64(F.lit(17), *plain)).alias("row"))
    return rows.where(F.col("stays").isNull()).select("row.*").unionByName(repeats.select("row.*"))


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each group of fingerprints: the one with the smallest id."""
    return one_of_each(docs, near_duplicates(docs, radius))


def drop_similar_texts(docs: DataFrame) -> DataFrame:
    """One row of each group of similar texts: the one with the smallest id."""
    return one_of_each(docs, similar_texts(docs))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
