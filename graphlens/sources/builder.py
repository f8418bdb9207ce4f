"""Builds small property-graph documents by hand: for tests and examples, as no parser is in scope."""

from __future__ import annotations

import json
from typing import Any


class Builder:
    """Vertices and edges of one document. Expressions and statements are node ids."""

    def __init__(self) -> None:
        self.vertices: list[dict] = []
        self.edges: list[dict] = []
        self.methods: dict[str, int] = {}
        self.params: dict[tuple[int, str], int] = {}
        self.method: int = -1
        self.line = 0
        self.later: list[tuple[int, str]] = []
        self.names: dict[int, str] = {}

    def node(self, label: str, **props: Any) -> int:
        i = len(self.vertices) + 1
        self.vertices.append({"id": i, "label": label, "properties": {k: v for k, v in props.items() if v is not None}})
        self.names[i] = props.get("NAME") or props.get("CODE") or ""
        return i

    def edge(self, label: str, src: int, dst: int) -> None:
        self.edges.append({"label": label, "outV": src, "inV": dst, "properties": {}})

    def code(self, i: int) -> str:
        return self.vertices[i - 1]["properties"].get("CODE", "")

    def file(self, name: str) -> None:
        self.node("FILE", NAME=name)

    def define(self, name: str, params: str, *body: Any) -> int:
        """A method whose body is a list of functions that make its statements."""
        self.line += 1
        self.method = m = self.node("METHOD", NAME=name, CODE=name, LINE_NUMBER=self.line, FILENAME="main.c", SIGNATURE=f"void({params})", AST_PARENT_FULL_NAME="main.c:<global>", IS_EXTERNAL=False)
        self.methods[name] = m
        for k, p in enumerate(params.split(), 1):
            q = self.node("METHOD_PARAMETER_IN", NAME=p, CODE=p, INDEX=k, LINE_NUMBER=self.line, TYPE_FULL_NAME="int")
            self.edge("AST", m, q)
            self.params[m, p] = q
        block = self.node("BLOCK", LINE_NUMBER=self.line)
        self.edge("AST", m, block)
        made = [b() for b in body]
        for s in made:
            self.edge("AST", block, s)
        for a, b in zip([m, *made], made):
            self.edge("CFG", a, b)
        return m

    def ident(self, name: str) -> int:
        i = self.node("IDENTIFIER", NAME=name, CODE=name, LINE_NUMBER=self.line, TYPE_FULL_NAME="int")
        if (p := self.params.get((self.method, name))) is not None:
            self.edge("REF", i, p)
            self.edge("REACHING_DEF", p, i)
        return i

    def lit(self, code: str) -> int:
        return self.node("LITERAL", CODE=code, LINE_NUMBER=self.line, TYPE_FULL_NAME="int")

    def ref(self, name: str) -> int:
        return self.node("METHOD_REF", CODE=name, METHOD_FULL_NAME=name, LINE_NUMBER=self.line)

    def call(self, name: str, *args: int, code: str | None = None, arguments: bool = True) -> int:
        self.line += 0 if name.startswith("<operator>") else 1
        code = code or f"{name}({', '.join(self.code(a) for a in args)})"
        c = self.node("CALL", NAME=name, CODE=code, LINE_NUMBER=self.line, TYPE_FULL_NAME="int", METHOD_FULL_NAME=name)
        for k, a in enumerate(args, 1):
            self.edge("AST", c, a)
            if arguments:
                self.vertices[a - 1]["properties"]["ARGUMENT_INDEX"] = k
                self.edge("ARGUMENT", c, a)
        self.later.append((c, name))
        return c

    def op(self, name: str, *args: int) -> int:
        return self.call(f"<operator>.{name}", *args, code=f" {name} ".join(self.code(a) for a in args))

    def field(self, base: int, name: str) -> int:
        f = self.node("FIELD_IDENTIFIER", CODE=name, CANONICAL_NAME=name, LINE_NUMBER=self.line)
        return self.call("<operator>.indirectFieldAccess", base, f, code=f"{self.code(base)}->{name}")

    def index(self, base: int, at: int) -> int:
        return self.call("<operator>.indirectIndexAccess", base, at, code=f"{self.code(base)}[{self.code(at)}]")

    def assign(self, lhs: int, rhs: int) -> int:
        self.line += 1
        return self.call("<operator>.assignment", lhs, rhs, code=f"{self.code(lhs)} = {self.code(rhs)}")

    def array(self, *items: int) -> int:
        return self.call("<operator>.arrayInitializer", *items, code="{" + ", ".join(self.code(i) for i in items) + "}")

    def block(self, *items: int) -> int:
        b = self.node("BLOCK", LINE_NUMBER=self.line)
        for i in items:
            self.edge("AST", b, i)
        return b

    def control(self, kind: str, cond: int, *body: int) -> int:
        self.line += 1
        c = self.node("CONTROL_STRUCTURE", CONTROL_STRUCTURE_TYPE=kind, CODE=f"{kind.lower()} ({self.code(cond)})", LINE_NUMBER=self.line)
        self.edge("CONDITION", c, cond)
        self.edge("AST", c, cond)
        self.edge("AST", c, self.block(*body))
        return c

    def case(self, label: str, call: int) -> int:
        j = self.node("JUMP_TARGET", NAME="case", CODE=f"case {label}:", LINE_NUMBER=self.line)
        self.edge("CFG", j, call)
        return self.block(j, call)

    def done(self) -> dict:
        for c, name in self.later:
            if name in self.methods:
                self.edge("CALL", c, self.methods[name])
        self.later = []
        return {"vertices": self.vertices, "edges": self.edges}

    def wrapped(self) -> dict:
        """The document with GraphSON type wrappers."""
        w = lambda t, v: {"@type": t, "@value": v}
        i64 = lambda v: w("g:Int64", v)
        prop = lambda v: w("g:VertexProperty", w("g:List", [v]))
        d = self.done()
        return w("tinker:graph", {
            "vertices": [{"@type": "g:Vertex", "id": i64(v["id"]), "label": v["label"], "properties": {k: prop(x) for k, x in v["properties"].items()}} for v in d["vertices"]],
            "edges": [{"@type": "g:Edge", "id": i64(k), "label": e["label"], "outV": i64(e["outV"]), "inV": i64(e["inV"]), "outVLabel": "", "inVLabel": "", "properties": {}} for k, e in enumerate(d["edges"])],
        })

    def json(self, wrap: bool = True) -> str:
        return json.dumps(self.wrapped() if wrap else self.done())
