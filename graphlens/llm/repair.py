"""Conversation structure repair by weighted finite-state composition.

A conversation is an input acceptor, a chain with an arc for each message. An edit transducer keeps a
message (0), gives it the role user or assistant (1), deletes it (2) or inserts an empty message of
either role (5); messages that are blank or repeat an earlier one can only be deleted, and an undeleted
truncated one costs 5 more. A grammar acceptor takes the role initials ``(s?(ua)+)?``. The product of
the three is never stored: its arcs are made when a position is reached. Inserts after one message are
numbered, and two are enough, as a third comes back to a state of the grammar; so the product
has no cycle. Weights are (cost, string of edit initials), compared in this order; distances are taken in
reverse topological order, and the least string follows from the start over arcs that lose nothing.

Spark computes faults with joins and sums, and puts the messages of all conversations in one order dealt
out by range, in which each task writes its part of a conversation as a string with a letter for each
message. A conversation's letters, which are as many as its edits, meet its messages in one sorted
stream, where the shortest path, the repaired messages and their digest are found. A digest of one
conversation's text can only be taken from end to end; its messages stream by, and are never held.

Messages stand by turn, nulls first; those of one turn by role, then by a digest of their text. A null conv_id
is a conversation of its own, and so is each other id. Null roles and texts read as one space, a null
turn as one space where ids are formed. A role that starts with none of s, u, a can be given another or deleted. Repeated rows
are repeats. An empty table has no rows. Texts of any length are read whole. Columns of other names play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.llm.common import table

SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Classes of a message's letter: the initial of its role, and its first fault.
INITIALS = "sua?"
BLANK, DUPLICATE, CUT, SOUND = range(4)
#: State of the grammar -> arcs (initial, state). 0 and 3 accept.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ACCEPTING = (0, 3)
MOST_INSERTS = 2
#: Remembered steps of the shortest path at most.
CACHE = 100_000
FAR = 1 << 60


def letter(initial: int, fault: int) -> str:
    return chr(65 + 4 * initial + fault)


def message_arcs(symbol: str, q: int) -> Iterator[tuple[str, int, int]]:
    """Arcs (edit, cost, state of the grammar) of the product that read a message."""
    kind, fault = divmod(ord(symbol) - 65, 4)
    yield "D", DELETE, q
    if fault in (BLANK, DUPLICATE):
        return
    extra = TRUNCATED if fault == CUT else 0
    for initial, to in GRAMMAR[q].items():
        if initial == INITIALS[kind]:
            yield "K", KEEP + extra, to
        if initial != "s":
            yield "R", REROLE + extra, to


def insert_arcs(k: int, q: int) -> Iterator[tuple[str, int, int]]:
    """Arcs of the product that insert a message, the (k+1)-th in a row."""
    if k < MOST_INSERTS:
        for initial, to in GRAMMAR[q].items():
            if initial != "s":
                yield "I", INSERT, to


def _before(symbol: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """Distances to the end at (k, q), as [k * 4 + q], ahead of a message, from those behind it. An empty symbol is the end."""
    read = [min(c + after[to] for _, c, to in message_arcs(symbol, q)) for q in range(4)] if symbol else [0 if q in ACCEPTING else FAR for q in range(4)]
    now: list[int] = []
    for k in range(MOST_INSERTS, -1, -1):
        now = [min([read[q], *(c + now[to] for _, c, to in insert_arcs(k, q))]) for q in range(4)] + now
    return tuple(now)


class ShortestPath:
    """Cost and least edit string of a string of letters; steps between equal distances are remembered."""

    def __init__(self) -> None:
        self.back: dict[tuple, tuple] = {}
        self.walk: dict[tuple, tuple] = {}
        self.whole: dict[str, tuple[int, str]] = {}

    def _distances(self, symbols: str) -> tuple[list[tuple[int, ...]], int]:
        """At each position the distances less their minimum, and the minimum at the start."""
        base, at = 0, _before("", ())
        out = [at]
        for s in reversed(symbols):
            step = self.back.get((s, at))
            if step is None:
                far = _before(s, at)
                low = min(far)
                step = (tuple(min(x - low, FAR) for x in far), low)
                if len(self.back) < CACHE:
                    self.back[(s, at)] = step
            at, low = step
            base += low
            out.append(at)
        return out[::-1], base

    def _edits(self, symbol: str, states: frozenset, here: tuple[int, ...], there: tuple[int, ...] | None) -> tuple[str, frozenset | None]:
        """Least edits up to and with the next message, and the states behind it. All states share one edit string so far."""
        out, low = "", min(_before(symbol, there)) if symbol else 0
        togo = lambda k, q: here[k * 4 + q] + low
        while True:
            arcs = []
            for k, q in states:
                arcs += [(e, (k + 1, to)) for e, c, to in insert_arcs(k, q) if c + togo(k + 1, to) == togo(k, q)]
                if symbol:
                    arcs += [(e, (0, to)) for e, c, to in message_arcs(symbol, q) if c + there[to] == togo(k, q)]
            if not arcs:
                return out, None
            least = min(e for e, _ in arcs)
            out, states = out + least, frozenset(s for e, s in arcs if e == least)
            if least != "I":
                return out, states

    def __call__(self, symbols: str) -> tuple[int, str]:
        if (known := self.whole.get(symbols)) is not None:
            return known
        distances, base = self._distances(symbols)
        states, out = frozenset([(0, 0)]), []
        for i, s in enumerate([*symbols, ""]):
            here, there = distances[i], distances[i + 1] if s else None
            step = self.walk.get((s, states, here, there))
            if step is None:
                step = self._edits(s, states, here, there)
                if len(self.walk) < CACHE:
                    self.walk[(s, states, here, there)] = step
            out.append(step[0])
            states = step[1]
        found = base + distances[0][0], "".join(out)
        if len(self.whole) < CACHE and len(symbols) <= 64:
            self.whole[symbols] = found
        return found


def conversation_key(df: DataFrame):
    """conv_id as a string that is never null."""
    c = F.col("conv_id")
    return F.when(c.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), c.cast("string")))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, times: rows damaged by a hash of their id and turn."""
    text = F.coalesce("text", F.lit(" "))
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.pmod(F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn")).cast("binary")), F.lit(20))
    out = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), how.alias("how")).where("how != 0")
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return out.select(
        "conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("how") == 3, 2).otherwise(1).alias("times")
    )


def messages_of(rows: DataFrame) -> DataFrame:
    """k, turn, role, text, digest, times of the rows conv_id, turn, role, text; times is 1 unless the rows have it."""
    text = F.coalesce("text", F.lit(" "))
    return rows.select(
        conversation_key(rows).alias("k"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"),
        F.unhex(F.sha2(text, 256)).alias("digest"), F.col("times") if "times" in rows.columns else F.lit(1).alias("times"),
    )


ORDER = ["k", "turn", "role", "digest"]


def lettered(messages: DataFrame) -> DataFrame:
    """k, turn, role, digest, symbols: a letter for each of the equal messages of a turn."""
    end = F.rtrim("text", F.lit(SPACES))
    blank, cut = end == "", ~F.right(end, F.lit(1)).isin(".", "!", "?")
    slim = messages.select(*ORDER, "times", blank.alias("blank"), cut.alias("cut"))
    # Equal messages of a turn are one row from here on, however many they are.
    each = slim.groupBy(*ORDER, "blank", "cut").agg(F.sum("times").cast("int").alias("n"))
    place = F.struct(F.col("turn").isNotNull(), "turn")
    first = each.groupBy("k", "role", "digest").agg(F.min(place).alias("first"))
    kind = F.lit(3)
    for i, initial in enumerate(INITIALS[:3]):
        kind = F.when(F.col("role").startswith(initial), i).otherwise(kind)
    sign = lambda fault: F.char(F.lit(65) + 4 * kind + fault)
    lead = F.when(F.col("blank"), BLANK).when(~F.col("first").eqNullSafe(place), DUPLICATE).when(F.col("cut"), CUT).otherwise(SOUND)
    rest = F.when(F.col("blank"), BLANK).otherwise(DUPLICATE)
    return each.join(first, ["k", "role", "digest"]).select(*ORDER, F.concat(sign(lead), F.repeat(sign(rest), F.col("n") - 1)).alias("symbols"))


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part = TaskContext.get().partitionId()
    for number, b in enumerate(batches):
        if not len(b):
            continue
        key = b["k"].to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(b)]])
        turn, known, signs, out = b["turn"].to_numpy(), b["known"].to_numpy(), b["symbols"].to_numpy(), []
        for at, end in zip(cuts[:-1], cuts[1:], strict=True):
            real = np.unique(turn[at:end][known[at:end]])
            low, high = (str(real[0]), str(real[-1])) if len(real) else (None, None)
            out.append((key[at], part, number, "".join(signs[at:end]), len(real), low, high))
        yield pd.DataFrame(out, columns=["k", "part", "number", "symbols", "turns", "low", "high"])


def pieces(messages: DataFrame) -> DataFrame:
    """k, part, number, symbols, turns, low, high: each conversation's letters in order, by piece, with its
    different turns, the least and the largest."""
    rows = lettered(messages).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    rows = rows.select("k", F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNotNull().alias("known"), "symbols")
    return rows.mapInPandas(_pieces, "k string, part int, number int, symbols string, turns long, low string, high string")


ROLE = {"u": "user", "a": "assistant"}


class Conversation:
    """A conversation whose letters are known and whose messages come by in order."""

    def __init__(self, key: str, path: ShortestPath, keep: bool) -> None:
        self.key, self.path, self.keep = key, path, keep
        self.parts: list[str] = []
        self.turns, self.low, self.high = 0, None, None
        self.audit: str | None = None
        self.hash, self.lines, self.out, self.at = hashlib.sha256(), 0, [], 0

    def piece(self, symbols: str, turns: int, low, high) -> None:
        self.parts.append(symbols)
        if turns:
            # A turn may go on from one piece to the next.
            self.turns += turns - (self.high is not None and low == self.high)
            self.low = low if self.low is None else self.low
            self.high = high

    def solve(self) -> None:
        self.symbols = "".join(self.parts)
        self.cost, self.audit = self.path(self.symbols)
        length = len(self.audit) - self.audit.count("D")
        self.first = ("s" if length % 2 else "") + "u"

    def _initial(self) -> str:
        n = self.lines - (len(self.first) - 1)
        return "s" if n < 0 else "ua"[n % 2]

    def _line(self, edit: str, turn, role: str, text: str) -> None:
        self.hash.update(("\n" if self.lines else "").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        if self.keep:
            self.out.append((self.key, self.lines, edit, turn, role, text))
        self.lines += 1

    def _inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._line("insert", None, ROLE[self._initial()], "")
            self.at += 1

    def message(self, turn, role: str, text: str, times: int) -> None:
        for _ in range(times):
            self._inserts()
            edit = self.audit[self.at]
            self.at += 1
            if edit == "K":
                self._line("keep", turn, role, text)
            elif edit == "R":
                self._line("rerole", turn, ROLE[self._initial()], text)

    def summary(self) -> tuple:
        self._inserts()
        s = self.symbols
        faults = [sum(s.count(letter(i, f)) for i in range(4)) for f in (BLANK, DUPLICATE, CUT)]
        codes = np.frombuffer(s.encode(), dtype=np.uint8).astype(np.int64) - 65 >> 2
        pairs = codes[:-1] * 4 + codes[1:]
        legal = sum(int((pairs == INITIALS.index(p[0]) * 4 + INITIALS.index(p[1])).sum()) for p in ("su", "ua", "au"))
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return self.key, gaps, *faults, max(len(s) - 1, 0) - legal, self.cost, self.audit, self.hash.hexdigest()


SUMMARY = "k string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
MESSAGES = "k string, position long, edit string, turn long, role string, text string"


def _walk(keep: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Over rows sorted by conversation and kind: its name, its pieces, its messages."""
    names = [c.split()[0] for c in (MESSAGES if keep else SUMMARY).split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        return out.astype({"turn": "Int64"}) if keep else out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, now, out = ShortestPath(), None, []

        def close() -> None:
            if now.audit is None:
                now.solve()
            row = now.summary()
            out.extend(now.out if keep else [row])

        for b in batches:
            for k, kind, symbols, turns, low, high, turn, role, text, times in zip(*(b[c].to_numpy(dtype=object) for c in ("k", "kind", "symbols", "turns", "low", "high", "turn", "role", "text", "times")), strict=True):
                if now is None or k != now.key:
                    if now is not None:
                        close()
                    now = Conversation(k, path, keep)
                if kind == 1:
                    now.piece(symbols, int(turns), low and int(low), high and int(high))
                elif kind == 2:
                    if now.audit is None:
                        now.solve()
                    now.message(turn and int(turn), role, text, int(times))
            if keep and now is not None:
                out.extend(now.out)
                now.out.clear()
            if out:
                yield frame(out)
                out.clear()
        if now is not None:
            close()
            yield frame(out)

    return run


def _stream(rows: DataFrame, originals: DataFrame, keep: bool) -> DataFrame:
    messages = messages_of(rows)
    names = originals.select(conversation_key(originals).alias("k")).distinct().withColumn("kind", F.lit(0))
    letters = pieces(messages).withColumn("kind", F.lit(1))
    both = names.unionByName(letters, allowMissingColumns=True).unionByName(messages.withColumn("kind", F.lit(2)), allowMissingColumns=True)
    order = ["k", "kind", "part", "number", "turn", "role", "digest"]
    dealt = both.repartition("k").sortWithinPartitions(*order).drop("digest").withColumn("turn", F.col("turn").cast("string"))
    out = dealt.mapInPandas(_walk(keep), MESSAGES if keep else SUMMARY)
    kind = originals.schema["conv_id"].dataType
    conv_id = F.when(F.col("k").startswith("1"), F.substring("k", 2, 1 << 30)).cast(kind)
    return out.select(conv_id.alias("conv_id"), *[c for c in out.columns if c != "k"])


def audit(rows: DataFrame, originals: DataFrame | None = None) -> DataFrame:
    """One row for each conversation of ``originals`` (of ``rows``, if not given): gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256. Rows have conv_id, turn, role, text, and times if they stand for several."""
    return _stream(rows, rows if originals is None else originals, False)


def repaired(rows: DataFrame) -> DataFrame:
    """The messages of the repaired conversations: conv_id, position, edit (keep, rerole, insert), turn, role, text."""
    return _stream(rows, rows, True)


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return audit(damaged(rows), rows)
