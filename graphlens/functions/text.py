"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def upper_snake(name: Column | str) -> Column:
    """CamelCase to UPPER_SNAKE, without an underscore between capitals in a row."""
    return F.upper(F.regexp_replace(_col(name), r"([^A-Z])([A-Z])", "$1_$2"))


def strip_quotes(text: Column | str) -> Column:
    """Without a pair of equal quotes around."""
    t = F.trim(_col(text))
    first, last = F.substring(t, 1, 1), F.right(t, F.lit(1))
    return F.when((F.length(t) >= 2) & (first == last) & first.isin('"', "'"), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)


def sanitize_filename(name: Column | str, fallback: str = "unnamed", max_len: int = 120) -> Column:
    """Letters, digits, dot, dash and underscore; other runs become one underscore; trimmed and cut."""
    safe = F.btrim(F.regexp_replace(_col(name), r"[^A-Za-z0-9._-]+", "_"), F.lit("._-"))
    return F.left(F.when(safe == "", fallback).otherwise(F.coalesce(safe, F.lit(fallback))), F.lit(max_len))


def sanitize_token(text: Column | str, max_len: int = 100) -> Column:
    """Every character but letters, digits, underscore and dash becomes an underscore."""
    return F.left(F.regexp_replace(_col(text), r"[^\p{L}\p{N}_-]", "_"), F.lit(max_len))


SEPARATORS = r"[\s(){}\[\]<>;,.:=+\-*/%&|^!~?\"'#@\\]+"


def name_from_code(code: Column | str, fallback: str = "") -> Column:
    """The last word of a piece of code."""
    words = F.filter(F.split(_col(code), SEPARATORS), lambda w: w != "")
    return F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit(fallback))


def unique_names(rank: Column, name: Column) -> Column:
    """``name`` for the first of a kind, ``name_n`` for later ones (rank from 0)."""
    return F.when(rank == 0, name).otherwise(F.concat(name, F.lit("_"), rank.cast("string")))


def case_label(text: Column | str) -> Column:
    """The label of a case without keyword, colon and space."""
    t = F.trim(_col(text))
    return F.when(t.rlike(r"^default\b"), "default").otherwise(F.trim(F.regexp_extract(t, r"^(?:case\b)?\s*(.*?)\s*:?$", 1)))


def case_int(label: Column | str) -> Column:
    """A case label as a number: character, hexadecimal, octal, decimal, default -1; null if it is none."""
    t = _col(label)
    escapes = {r"'\\n'": 10, r"'\\t'": 9, r"'\\r'": 13, r"'\\0'": 0, r"'\\\\'": 92, r"'\\''": 39}
    out = F.when(t == "default", -1)
    for pattern, value in escapes.items():
        out = out.when(t.rlike(f"^{pattern}$"), value)
    out = out.when(t.rlike(r"^'[^\\']'$"), F.ascii(F.substring(t, 2, 1)))
    out = out.when(t.rlike(r"^0[xX][0-9a-fA-F]+[uUlL]*$"), F.conv(F.regexp_extract(t, r"^0[xX]([0-9a-fA-F]+)", 1), 16, 10).cast("long"))
    out = out.when(t.rlike(r"^0[0-7]+[uUlL]*$"), F.conv(F.regexp_extract(t, r"^0([0-7]+)", 1), 8, 10).cast("long"))
    return out.when(t.rlike(r"^-?[0-9]+[uUlL]*$"), F.regexp_extract(t, r"^(-?[0-9]+)", 1).cast("long")).cast("long")


def norm_value(n: Column | str, cap: int = 100) -> Column:
    return F.least(F.greatest(_col(n), F.lit(0)), F.lit(cap)) / cap


def array_size(declaration: Column | str, cap: int = 100) -> Column:
    """struct(state, norm): 0 no array, 1 constant size, 2 other; norm is the capped product of the sizes."""
    inner = F.transform(F.regexp_extract_all(_col(declaration), F.lit(r"\[([^\]]*)\]"), F.lit(1)), lambda x: F.trim(x))
    constant = F.forall(inner, lambda x: x.rlike(r"^[0-9]+$"))
    product = F.aggregate(inner, F.lit(1.0), lambda a, x: a * F.when(x.rlike(r"^[0-9]+$"), x.cast("double")).otherwise(1.0))
    state = F.when(F.size(inner) == 0, 0).when(constant, 1).otherwise(2)
    return F.struct(state.alias("state"), F.when(state == 1, norm_value(product, cap)).otherwise(0.0).alias("norm"))


def _tokens(text: Column) -> Column:
    """Parentheses and commas, and the runs between them."""
    return F.regexp_extract_all(text, F.lit("[(),]|[^(),]+"), F.lit(0))


def _depth(before: Column, token: Column) -> Column:
    return before + F.when(token == "(", 1).when(token == ")", -1).otherwise(0)


def matching_paren(text: Column | str) -> Column:
    """1-based position of the parenthesis that closes the first one; 0 if there is none."""
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("at"), F.lit(0).alias("found"))

    def step(acc: Column, token: Column) -> Column:
        depth, at = _depth(acc["d"], token), acc["at"] + F.length(token)
        return F.struct(depth.alias("d"), at.alias("at"), F.when((acc["found"] == 0) & (token == ")") & (depth == 0), at).otherwise(acc["found"]).alias("found"))

    return F.coalesce(F.aggregate(_tokens(_col(text)), start, step, lambda acc: acc["found"]), F.lit(0))


def split_arguments(text: Column | str) -> Column:
    """Arguments of a list at its outer commas, trimmed; an empty list has none."""
    start = F.struct(F.lit(0).alias("d"), F.lit("").alias("out"))
    step = lambda acc, token: F.struct(_depth(acc["d"], token).alias("d"), F.concat(acc["out"], F.when((token == ",") & (acc["d"] == 0), F.lit("\u0001")).otherwise(token)).alias("out"))
    marked = F.aggregate(_tokens(_col(text)), start, step, lambda acc: acc["out"])
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda x: F.trim(x)), lambda x: x != "")


def strip_sizeof(text: Column | str, nesting: int = 4) -> Column:
    """Without sizeof(...), up to some levels of parentheses within."""
    inner = r"[^()]*"
    for _ in range(nesting):
        inner = rf"(?:[^()]|\({inner}\))*"
    return F.regexp_replace(_col(text), rf"\bsizeof\s*\({inner}\)", "")
