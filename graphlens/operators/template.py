"""Template trees from code property graphs: one projection by label, and re-parenting.

The rewrite of the syntax tree is a change of two columns: ``parent`` and the order key ``path``
(child positions from the root). Nodes without a template type are taken out and their children
promoted, by looking up the nearest node that stays. Made-up nodes (parameter lists, dereferenced
identifiers) have ids derived from their node's, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.functions.knowledge import BOUNDED_SINKS, CALL_CATEGORY, UNBOUNDED_SINKS
from graphlens.operators import graph
from graphlens.operators.calculus import lookup
from graphlens.session import settled as checkpointed

# Operator call -> sign, without the common prefix.
BINARY = {
    "addition": "+", "subtraction": "-", "multiplication": "*", "division": "/", "modulo": "%", "shiftLeft": "<<", "arithmeticShiftRight": ">>", "and": "&", "or": "|", "xor": "^",
    "logicalAnd": "&&", "logicalOr": "||", "equals": "==", "notEquals": "!=", "lessThan": "<", "lessEqualsThan": "<=", "greaterThan": ">", "greaterEqualsThan": ">=",
    "assignmentPlus": "+=", "assignmentMinus": "-=", "assignmentMultiplication": "*=", "assignmentDivision": "/=", "pointerCall": "()", "conditional": "?:", "op_ellipses": "...",
}
UNARY = {
    "postIncrement": "++", "preIncrement": "++", "postDecrement": "--", "preDecrement": "--", "plus": "+", "minus": "-", "logicalNot": "!", "not": "~", "indirection": "*",
    "new": "new", "delete": "delete", "alloc": "alloc", "arrayInitializer": "{}",
}
BOOLEAN = ("equals", "notEquals", "lessThan", "lessEqualsThan", "greaterThan", "greaterEqualsThan", "logicalAnd", "logicalOr")
PREDEFINED = {"stdin": "FILE*", "stdout": "FILE*", "stderr": "FILE*", "errno": "int", "EOF": "int", "NULL": "void*", "FILENAME_MAX": "int"}
CONTROL = {"BREAK": "BreakStatement", "DO": "DoWhileStatement", "FOR": "ForStatement", "GOTO": "GotoStatement", "IF": "IfStatement", "SWITCH": "SwitchStatement", "WHILE": "WhileStatement"}
STATEMENTS = frozenset("CompoundStatement IfStatement ForStatement WhileStatement DoWhileStatement SwitchStatement BreakStatement ContinueStatement GotoStatement ReturnStatement CaseLabel DefaultLabel Label".split())
EXPRESSIONS = frozenset("AssignmentExpression BinaryExpression UnaryExpression CastExpression MemberAccess ArraySubscriptExpression SizeOfExpression AddressOfExpression PointerDereference Identifier Literal StandardLibCall UserDefinedCall".split())
DECLARATIONS = frozenset("FunctionDefinition FunctionDeclaration ParameterDeclaration VariableDeclaration ArrayDeclaration PointerDeclaration StructType UnionType TypeDefinition".split())

#: Calls that count as library calls unless the caller brings a longer list.
LIBRARY = tuple(sorted({*CALL_CATEGORY, *UNBOUNDED_SINKS, *BOUNDED_SINKS, "strlen", "strcmp", "strncmp", "exit", "free", "rand", "srand", "time", "memcmp", "strdup"}))


def is_statement(kind: Column) -> Column:
    return kind.isin(*STATEMENTS)


def is_expression(kind: Column) -> Column:
    return kind.isin(*EXPRESSIONS)


def is_declaration(kind: Column) -> Column:
    return kind.isin(*DECLARATIONS)


def operator_type(name: Column, type_full_name: Column, n_children: Column) -> Column:
    """Boolean for comparisons, else the type the graph has, else unknown: all leaves are unknown, so
    inference from children adds nothing."""
    return F.when(name.isin(*[f"<operator>.{b}" for b in BOOLEAN]), "boolean").otherwise(F.coalesce(type_full_name, F.when(n_children > 0, "unknown").otherwise("<unknown>")))


def allocation_length(type_full_name: Column) -> Column:
    """The number between brackets, else the type's text."""
    return F.coalesce(F.nullif(F.regexp_extract(type_full_name, r"\[(\d+)\]", 1), F.lit("")), type_full_name)


def cast_target(code: Column) -> Column:
    """What is between the first parentheses."""
    return F.coalesce(F.nullif(F.regexp_extract(code, r"^[^)]*?\(([^()]*)\)", 1), F.lit("")), code)


def clean_literal(code: Column) -> Column:
    return F.replace(F.replace(F.replace(code, F.lit('"'), F.lit("")), F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t"))


def convert(nodes: DataFrame, edges: DataFrame, library: tuple[str, ...] = LIBRARY) -> DataFrame:
    """id, doc, parent, path, node_type, name, value, type, size, operator, length, level, storage,
    target, code: the template tree as rows, in pre-order by path within a root."""
    nodes, edges = checkpointed(nodes), checkpointed(edges)
    tree = graph.forest(edges, "AST").select(F.col("node").alias("id"), "path", "root")
    parent = graph.parents(edges, "AST", last=False)
    kids = parent.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    t = nodes.join(tree, "id").join(parent, "id", "left").join(kids, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("pos", F.try_element_at("path", F.lit(-1)))
    up = nodes.select(F.col("id").alias("parent"), F.col("label").alias("p_label"), F.col("name").alias("p_name"), F.col("control_type").alias("p_control"), F.col("code").alias("p_code"), F.col("filename").alias("p_file"), F.col("ast_parent_full_name").alias("p_apfn"), F.col("is_external").alias("p_ext"), F.col("signature").alias("p_sig"))
    t = checkpointed(t.join(up, "parent", "left"))
    label, name, code, typ = F.col("label"), F.coalesce("name", F.lit("")), F.coalesce("code", F.lit("")), F.coalesce("type_full_name", F.lit(""))
    own = lambda f, a, e, s: (F.concat(f, F.lit(":<global>")) == a) & ~F.coalesce(e, F.lit(False)) & (F.length(F.coalesce(s, F.lit(""))) > 0)
    is_method = (label == "METHOD") & own(F.col("filename"), F.col("ast_parent_full_name"), F.col("is_external"), F.col("signature"))
    in_method = (F.col("p_label") == "METHOD") & own(F.col("p_file"), F.col("p_apfn"), F.col("p_ext"), F.col("p_sig"))

    op = F.when(name.startswith("<operator>."), F.substring(name, 12, 1000))
    by_op = lambda table_: lookup(op, table_)
    assign = op == "assignment"
    allocs = nodes.where("label = 'CALL' AND name = '<operator>.alloc'").select("id").join(parent, "id").select(F.col("parent").alias("id")).distinct().withColumn("allocs", F.lit(True))
    # The type behind an address is that of the identifier it is taken of.
    named = nodes.where("label = 'IDENTIFIER'").select("id", "name", "type_full_name", "ord").join(parent, "id").select(F.col("parent").alias("id"), F.col("name").alias("of"), F.col("type_full_name").alias("of_type"), F.col("ord").alias("of_ord"))
    taken = nodes.where("name = '<operator>.addressOf'").select("id", "code").join(named, "id").where(F.col("of") == F.replace("code", F.lit("&"), F.lit("")))
    taken = taken.groupBy("id").agg(F.min_by("of_type", "of_ord").alias("of_type"))
    t = t.join(allocs, "id", "left").join(taken, "id", "left")
    call = (
        F.when(by_op(BINARY).isNotNull(), "BinaryExpression").when(by_op(UNARY).isNotNull(), "UnaryExpression").when(op == "addressOf", "AddressOfExpression")
        .when(assign & (F.col("n_children") != 2), F.raise_error(F.concat(F.lit("assignment without two children: "), F.col("id"))))
        .when(assign & F.col("allocs"), "ArraySizeAllocation").when(assign, "AssignmentExpression").when(op == "cast", "CastExpression")
        .when(op.isin("fieldAccess", "indirectFieldAccess"), "MemberAccess").when(op == "indirectIndexAccess", "ArraySubscriptExpression").when(op == "sizeOf", "SizeOfExpression")
        .when(op.isNotNull(), F.lit(None)).when(name.isin(*library), "StandardLibCall").otherwise("UserDefinedCall")
    )
    declared = F.when(typ.rlike(r"\[.*\]"), "ArrayDeclaration").when(F.contains(typ, F.lit("*")), "PointerDeclaration").otherwise("VariableDeclaration")
    base = F.split_part(typ, F.lit("["), F.lit(1))
    pointer = (label == "IDENTIFIER") & F.contains(base, F.lit("*"))
    typedef = F.when(F.contains(code, F.lit("typedef struct")), "StructType").when(F.contains(code, F.lit("typedef union")), "UnionType").when(F.contains(code, F.lit("typedef")), "TypeDefinition")
    first_block = nodes.where("label = 'BLOCK'").join(parent, "id").groupBy(F.col("parent").alias("id")).agg(F.min_by("code", "ord").alias("block_code"), F.min_by("id", "ord").alias("block"))
    t = t.join(first_block, "id", "left")
    kind = (
        F.when(label == "BLOCK", "CompoundStatement").when(label == "CALL", call).when(label == "CONTROL_STRUCTURE", lookup("control_type", CONTROL))
        .when(label.isin("FIELD_IDENTIFIER", "METHOD_REF"), "Identifier").when((label == "FILE") & name.rlike(r"\.(c|cpp)$"), "TranslationUnit")
        .when(pointer, "PointerDereference").when((label == "IDENTIFIER") & (name == "NULL"), "Literal").when(label == "IDENTIFIER", "Identifier")
        .when(label == "JUMP_TARGET", F.when(name == "case", "CaseLabel").when(name == "default", "DefaultLabel").otherwise("Label")).when(label == "LITERAL", "Literal")
        .when(label.isin("LOCAL", "MEMBER"), declared).when(label == "METHOD_PARAMETER_IN", "ParameterDeclaration").when(label == "RETURN", "ReturnStatement")
        .when(is_method, F.when(F.col("block_code") == "<empty>", "FunctionDeclaration").otherwise("FunctionDefinition")).when(label == "TYPE_DECL", typedef)
    )
    # Subtrees that go.
    gone = (
        (label == "IMPORT") | ((label == "FILE") & ~name.rlike(r"\.(c|cpp)$")) | ((F.col("p_name") == "<operator>.cast") & (label == "TYPE_REF"))
        | (in_method & (label.isin("METHOD_RETURN", "MODIFIER") | ((label == "BLOCK") & (F.col("n_children") == 0))))
        | ((F.col("p_label") == "TYPE_DECL") & F.contains(F.col("p_code"), F.lit("typedef struct")) & ((label == "METHOD") | (name == "<clinit>"))) | ((F.col("p_control") == "IF") & (F.col("pos") > 3))
    )
    # The else branch is its first child only; the body of a switch dissolves.
    is_else = (F.col("p_control") == "IF") & (F.col("pos") == 3)
    t = t.withColumn("_else", F.coalesce(is_else, F.lit(False))).withColumn("_switch", F.coalesce((F.col("p_control") == "SWITCH") & (label == "BLOCK"), F.lit(False)))
    folded = t.where("_else OR _switch").select(F.col("id").alias("parent"), F.col("_else").alias("in_else"), F.col("_switch").alias("in_switch"))
    t = t.join(folded, "parent", "left")
    gone = F.coalesce(gone, F.lit(False)) | (F.coalesce("in_else", F.lit(False)) & (F.col("pos") > 1))
    kind = F.when(F.col("_else") | F.col("_switch"), F.lit(None)).otherwise(kind)
    # Statements after a case label belong to it.
    is_label = (label == "JUMP_TARGET") & name.isin("case", "default")
    run = Window.partitionBy("parent").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    label_at = F.last(F.when(is_label, F.col("id")), ignorenulls=True).over(run)
    owner = F.when(F.coalesce("in_switch", F.lit(False)) & ~is_label & label_at.isNotNull(), label_at).otherwise(F.col("parent"))
    plist = lambda c: F.concat(c, F.lit("/params"))
    is_call = (F.col("p_label") == "CALL") & ~F.coalesce(F.col("p_name").startswith("<operator>."), F.lit(False))
    in_list = is_call | (in_method & (label == "METHOD_PARAMETER_IN"))
    owner = F.when(F.coalesce(in_list, F.lit(False)), plist(F.col("parent"))).otherwise(owner)
    path = F.when(in_method & (label == "METHOD_PARAMETER_IN"), F.concat(F.slice("path", F.lit(1), F.size("path") - 1), F.array(F.lit(0), F.col("pos")))).otherwise(F.col("path"))
    star = F.length(typ) - F.length(F.replace(typ, F.lit("*"), F.lit("")))
    rows = t.select(
        "id", "doc", "root", owner.alias("up"), path.alias("path"), kind.alias("node_type"), F.coalesce(gone, F.lit(False)).alias("gone"), "code",
        F.when(label == "METHOD_REF", F.coalesce("method_full_name", F.nullif(name, F.lit("")), F.lit("<unknown>"))).when(label == "FIELD_IDENTIFIER", F.coalesce(F.nullif(name, F.lit("")), code)).when(pointer, F.lit(None)).otherwise(F.col("name")).alias("name"),
        F.when((label == "IDENTIFIER") & (name == "NULL"), name).when(label == "LITERAL", clean_literal(code)).alias("value"),
        F.when((label == "CALL") & (by_op(BINARY).isNotNull() | by_op(UNARY).isNotNull()), operator_type(name, F.col("type_full_name"), F.col("n_children"))).when(pointer, F.trim(F.replace(base, F.lit("*"), F.lit("")))).when(label == "FIELD_IDENTIFIER", "<unknown>")
        .when(label.isin("IDENTIFIER", "METHOD_REF", "METHOD_PARAMETER_IN"), F.coalesce(lookup(name, PREDEFINED), base)).when(label.isin("LOCAL", "MEMBER"), F.coalesce(lookup(name, PREDEFINED), F.when(typ.rlike(r"\[.*\]"), base).otherwise(F.replace(typ, F.lit("*"), F.lit(""))))).when(is_method, F.split_part("signature", F.lit("("), F.lit(1))).otherwise(F.col("type_full_name")).alias("type"),
        F.when(label.isin("IDENTIFIER", "METHOD_PARAMETER_IN", "METHOD_REF") & typ.rlike(r"\[.*\]"), F.regexp_extract(typ, r"\[([^\]]*)\]", 1)).when((label == "LITERAL") & F.contains(typ, F.lit("char")), F.length(clean_literal(code)).cast("string")).alias("size"),
        F.when(label == "CALL", F.coalesce(by_op(BINARY), by_op(UNARY), F.when(assign, "="))).alias("operator"),
        F.when((label == "CALL") & assign & F.col("allocs"), allocation_length(typ)).when(label.isin("LOCAL", "MEMBER") & typ.rlike(r"\[.*\]"), F.regexp_extract(typ, r"\[([^\]]*)\]", 1)).alias("length"),
        F.when(label.isin("LOCAL", "MEMBER") & (star > 0), star).alias("level"),
        F.when(label.isin("LOCAL", "MEMBER") & ~F.startswith(F.trim(code), typ) & F.contains(code, typ), F.trim(F.split_part(code, typ, F.lit(1)))).alias("storage"),
        F.when(op == "cast", cast_target(code)).when(F.col("control_type") == "GOTO", F.replace(F.regexp_extract(code, r"goto (.*)$", 1), F.lit(";"), F.lit(""))).when(typedef == "TypeDefinition", F.coalesce("alias_type_full_name", F.lit("<unknown>"))).alias("target"),
        F.concat("of_type", F.lit("*")).alias("of_type"), (label == "CALL").alias("is_call"), is_method.alias("is_method"), pointer.alias("is_pointer"), F.col("name").alias("raw_name"), F.coalesce(lookup(name, PREDEFINED), base).alias("raw_type"),
    )
    address = F.col("node_type") == "AddressOfExpression"
    rows = checkpointed(rows.withColumn("type", F.when(address, F.coalesce("of_type", F.lit("<unknown>"))).otherwise(F.col("type"))).drop("of_type"))
    blank = {c: F.lit(None).cast(rows.schema[c].dataType) for c in rows.columns}
    made = lambda df, **cols: df.select(*[cols.get(c, blank[c]).alias(c) for c in rows.columns])
    no = F.lit(False)
    zero = F.concat("path", F.array(F.lit(0)))
    call_lists = rows.where(F.col("node_type").isin("StandardLibCall", "UserDefinedCall") | F.coalesce("is_method", no))
    lists = made(call_lists, id=plist(F.col("id")), doc=F.col("doc"), root=F.col("root"), up=F.col("id"), path=zero, node_type=F.lit("ParameterList"), gone=no)
    some = rows.where("node_type = 'ParameterDeclaration'").select(F.col("up").alias("_l")).distinct()
    bare = rows.where("is_method").join(some, plist(F.col("id")) == F.col("_l"), "left_anti")
    empty = made(bare, id=F.concat("id", F.lit("/empty")), doc=F.col("doc"), root=F.col("root"), up=plist(F.col("id")), path=F.concat("path", F.array(F.lit(0), F.lit(0))), node_type=F.lit("ParameterDeclaration"), gone=no, name=F.lit("<empty>"), type=F.lit("<empty>"))
    inner = made(rows.where("is_pointer"), id=F.concat("id", F.lit("/name")), doc=F.col("doc"), root=F.col("root"), up=F.col("id"), path=zero, node_type=F.lit("Identifier"), gone=no, name=F.col("raw_name"), type=F.col("raw_type"), size=F.col("size"), code=F.col("code"))
    all_ = checkpointed(rows.unionByName(lists).unionByName(empty).unionByName(inner).drop("is_call", "is_method", "is_pointer", "raw_name", "raw_type"))
    return prune(all_)


def prune(rows: DataFrame) -> DataFrame:
    """Rows (id, up, node_type, gone, ...) -> without gone subtrees and untyped nodes; ``parent`` is
    the nearest node that stays."""
    link = rows.select("id", F.col("up").alias("parent")).where(F.col("parent").isNotNull())
    dead = graph.owner(rows, link, F.col("gone")).where(F.col("owner").isNotNull()).select("id")
    live = checkpointed(rows.join(dead, "id", "left_anti"))
    stays = graph.owner(live, link, F.col("node_type").isNotNull()).select(F.col("id").alias("up"), F.col("owner").alias("parent"))
    return checkpointed(live.where(F.col("node_type").isNotNull()).join(stays, "up", "left").drop("up", "gone"))


def call_names(nodes: DataFrame) -> DataFrame:
    """name, first: distinct call names in the order they are first seen."""
    return nodes.where("label = 'CALL'").groupBy("doc", "name").agg(F.min("ord").alias("first"))


def functions(tree: DataFrame, skip_main: bool = False, definitions_only: bool = True) -> DataFrame:
    """Functions of a template tree, in order; with a body and without main on demand."""
    kinds = ["FunctionDefinition"] if definitions_only else ["FunctionDefinition", "FunctionDeclaration"]
    out = tree.where(F.col("node_type").isin(*kinds))
    if definitions_only:
        body = tree.where("node_type = 'CompoundStatement'").select(F.col("parent").alias("id"))
        out = out.join(body, "id", "left_semi")
    return out.where(F.col("name") != "main") if skip_main else out


def merge_allocations(tree: DataFrame) -> DataFrame:
    """Array declarations with the length of the allocation right after them, which goes."""
    w = Window.partitionBy("parent").orderBy("path")
    rows = tree.withColumn("_next", F.lead(F.struct("node_type", "length")).over(w)).withColumn("_last", F.lag("node_type").over(w))
    merged = (F.col("node_type") == "ArrayDeclaration") & (F.col("_next.node_type") == "ArraySizeAllocation")
    rows = rows.withColumn("length", F.when(merged, F.col("_next.length")).otherwise(F.col("length")))
    return rows.where(~((F.col("node_type") == "ArraySizeAllocation") & F.coalesce(F.col("_last") == "ArrayDeclaration", F.lit(False)))).drop("_next", "_last")


def translation_units(tree: DataFrame) -> DataFrame:
    return tree.where("node_type = 'TranslationUnit'")
