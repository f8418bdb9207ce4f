"""Session helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphlens.session import MAX_BROADCAST_ROWS, checkpointed, table  # noqa: F401

#: Copies of the small side when a join on a hot key is salted.
SALTS = 32
#: A side of at most this many bytes of values, and MAX_BROADCAST_ROWS rows, may be broadcast.
MAX_BROADCAST_BYTES = 32 << 20


def _bytes(column: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(column), F.lit(0)).cast("long") + 16
    if isinstance(kind, T.StructType):
        return sum((_bytes(column.getField(f.name), f.dataType) for f in kind.fields), F.lit(16).cast("long"))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StringType | T.BinaryType | T.StructType | T.ArrayType | T.MapType):
            return F.aggregate(F.coalesce(column, F.array().cast(kind)), F.lit(24).cast("long"), lambda acc, x: acc + _bytes(x, kind.elementType))
        return F.greatest(F.size(column), F.lit(0)).cast("long") * 8 + 24
    return F.lit(16).cast("long")


def is_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    """Whether a count of its rows and bytes shows that a table may be broadcast."""
    size = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0).cast("long"))
    n, b = df.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return n <= max_rows and b <= MAX_BROADCAST_BYTES


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Join with a side that is expected to be small: broadcast it if a count shows that it is,
    else deal out both sides by key and salt, so that a hot key spreads over SALTS tasks."""
    if is_small(small, max_rows):
        return big.join(F.broadcast(small), on, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # From the row's own values, so that a task that runs again deals its rows out alike.
    plain = [f"`{f.name}`" for f in big.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    dealt = big.withColumn("_salt", F.pmod(F.xxhash64(F.lit(13), *plain), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, [*on, "_salt"], how).drop("_salt")


def row_key(doc_id: str | Column = "doc_id", text: str | Column = "text") -> Column:
    """Identity of a row for joins: its id and its text. Rows that agree in both are
    interchangeable for every operator here; null ids and null texts are values of their own."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.concat_ws(":", F.coalesce(as_col(doc_id).cast("string"), F.lit("null")), F.coalesce(F.hex(F.xxhash64(as_col(text))), F.lit("")), as_col(text).isNull().cast("string"))


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
