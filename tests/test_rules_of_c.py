"""Addresses, macro constants, pointer writes, array lengths and first contents of arrays."""

from pyspark.sql import functions as F

from graphlens.operators import callflags
from graphlens.sources.builder import Builder
from tests.test_programs import functions_of


def typed(b, i, kind):
    b.vertices[i - 1]["properties"]["TYPE_FULL_NAME"] = kind
    return i


def local(b, name, kind):
    return lambda: b.node("LOCAL", NAME=name, CODE=f"{kind} {name}", TYPE_FULL_NAME=kind)


def macro(b, name, *inside):
    """A call whose parameter list holds a block: what a macro stands for."""
    return b.call(name, b.block(*inside))


def test_rules(spark):
    b = Builder()

    def address(name, *kinds):
        c = b.op("addressOf", *[typed(b, b.ident(n), k) for n, k in kinds])
        b.vertices[c - 1]["properties"]["CODE"] = f"&{name}"
        return c

    def text_subscript(code, name):
        a = b.assign(b.ident(name), b.ident("v"))
        b.vertices[a - 1]["properties"]["CODE"] = code
        return a

    element = lambda name, kind, at: b.index(typed(b, b.ident(name), kind), b.ident(at))
    body = [
        local(b, "first", "char[n + sizeof(int)]"),  # 2
        lambda: text_subscript("first[k] = v", "first"),  # 3, right after the declaration
        lambda: b.assign(element("data", "char*", "i"), b.ident("v")),  # 4: an element of a pointer
        lambda: b.assign(typed(b, b.ident("data"), "char*"), b.ident("w")),  # 5: the pointer itself
        lambda: b.assign(b.index(b.ident("buf"), b.ident("i")), macro(b, "LIMIT", b.ident("hidden"))),
        lambda: text_subscript("late[k] = v", "late"),
        lambda: text_subscript('late[k] = "v"', "late"),
        lambda: text_subscript("late[7] = v", "late"),
        lambda: b.call("use", address("x", ("y", "long"), ("x", "int")), address("z", ("q", "int"))),
    ]
    b.define("f", "n", *body)
    b.define("g", "", lambda: b.call("use", macro(b, "OUTER", macro(b, "INNER", b.lit("64"))), macro(b, "SELF", macro(b, "SELF2", b.ident("a"))), macro(b, "TWO", b.lit("1"), b.lit("2"))))
    tree, fns = functions_of(spark, b)
    types = [r["type"] for r in tree.where("node_type = 'AddressOfExpression'").orderBy("path").collect()]
    assert types == ["int*", "<unknown>"]
    values = {r["name"]: r["value"] for r in callflags.macro_values(tree).collect()}
    assert values["INNER"] == "64" and "TWO" not in values and "SELF" not in values
    f = fns.statements.where("name = 'f' AND node_type = 'FunctionEntry'").first()
    said = fns.mentions if f is None else fns.mentions.where(F.col("fn") == f["fn"])
    rows = {(r["var"], r["is_def"], r["flow"]) for r in said.collect()}
    assert ("n", False, "size") in rows and ("int", False, "size") not in rows
    assert not any(v in ("hidden", "LIMIT") for v, _, _ in rows)
    by_code = {r["code"]: r["sid"] for r in fns.statements.where("node_type = 'AssignmentExpression'").collect()}
    of = lambda code: {(r["var"], r["is_def"], r["flow"]) for r in said.where(F.col("sid") == by_code[code]).collect()}
    assert of("data[i] = v") == {("data", False, "base"), ("i", False, "index"), ("v", False, "value")}
    assert ("data", True, "value") in of("data = w")
    assert {("buf", True, "value"), ("buf", False, "base")} <= {x for code in by_code if code.startswith("buf[i]") for x in of(code)}
    flags = {r["sid"]: (r["is_buffer_access"], r["is_sink_assign"]) for r in fns._buffer_writes().collect()}
    assert flags.get(by_code["first[k] = v"]) is None and flags.get(by_code['late[k] = "v"']) is None
    assert flags[by_code["late[k] = v"]] == (1, 1) and flags[by_code["late[7] = v"]] == (1, 0) and flags[by_code["data[i] = v"]] == (1, 1)
