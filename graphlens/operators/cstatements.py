"""Statement graphs and def-use edges of functions in a template tree.

An assignment whose value holds a call is two statements, the call and then the assignment, which takes
its value as ``$ret@sid``. A call with an effect in the condition of an if is a statement before it.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlens.functions.knowledge import API_SLOTS, BOUNDED_SINKS, CALL_CATEGORY, UNBOUNDED_SINKS
from graphlens.functions.text import array_size, case_int, case_label
from graphlens.operators import callflags, dataflow, graph, statements
from graphlens.operators.calculus import lookup
from graphlens.session import settled as checkpointed

# The node types that are statements of a function.
KEEP = """VariableDeclaration ArrayDeclaration PointerDeclaration AssignmentExpression IfStatement ForStatement WhileStatement
    DoWhileStatement SwitchStatement BreakStatement ContinueStatement StandardLibCall UserDefinedCall""".split()
LOOPS = ["ForStatement", "WhileStatement", "DoWhileStatement"]
CONTROLS = [*LOOPS, "IfStatement", "SwitchStatement"]


class Functions:
    """The functions of a template tree (id, parent, path, node_type, name, code, ...)."""

    def __init__(self, tree: DataFrame, functions: DataFrame) -> None:
        links = tree.select("id", "parent").where(F.col("parent").isNotNull())
        fns = functions.select(F.col("id").alias("fn"), F.col("name").alias("fn_name"))
        owner = graph.owner(tree.join(fns.select(F.col("fn").alias("id"), F.lit(True).alias("is_fn")), "id", "left"), links, F.coalesce("is_fn", F.lit(False))).select("id", F.col("owner").alias("fn"))
        self.tree = checkpointed(tree.join(owner, "id").where(F.col("fn").isNotNull()))
        self.fns = fns
        self.links = checkpointed(self.tree.select("id", "parent"))
        self.statements = self._number()

    def _number(self) -> DataFrame:
        """fn, sid, id, node_type, code, name, path, parent_sid, branch, place, origin: the entry is 0, then
        come the parameters, then the kept statements of the body in pre-order. A call within another kept
        statement is part of it, unless it is split off or lifted (origin); it then takes the place of that statement,
        right before it."""
        inside = self.tree.where(F.col("node_type").isin("CompoundStatement", "CaseLabel", "DefaultLabel", *CONTROLS) | (F.col("id") == F.col("fn"))).select(F.col("id").alias("parent"), F.col("node_type").alias("in_type"), F.col("id").alias("block"), F.col("parent").alias("over"))
        body = self.tree.where(F.col("node_type").isin(*KEEP)).join(inside, "parent")
        # A child of a control statement is a statement only within a block of it.
        body = body.where(F.col("in_type").isin("CompoundStatement", "CaseLabel", "DefaultLabel") | (F.col("in_type") == "SwitchStatement") & F.col("node_type").isin(*KEEP))
        params = self.tree.where("node_type = 'ParameterDeclaration'")
        entry = self.tree.where(F.col("id") == F.col("fn"))
        part = lambda df, rank, block, place=F.col("path"), before=0, origin="": df.select("fn", F.lit(rank).alias("rank"), "id", "node_type", "name", "code", "path", "type", "length", block.alias("block"), F.struct(place.alias("at"), F.lit(1 - before).alias("late")).alias("place"), F.lit(origin).alias("origin"))
        none = F.lit(None).cast("string")
        body = checkpointed(body)
        rows = part(entry, 0, none).withColumn("node_type", F.lit("FunctionEntry")).withColumn("code", F.concat(F.lit("<entry:"), F.coalesce("name", F.lit("")), F.lit(">"))).unionByName(part(params, 1, none)).unionByName(part(body, 2, F.col("block")))
        first = self._first_calls(body)
        moved = self.tree.join(first.select(F.col("call").alias("id"), "holder", "holder_type"), "id").join(body.select(F.col("id").alias("holder"), F.col("path").alias("at"), "block"), "holder")
        for kind, origin in (("AssignmentExpression", "split"), ("IfStatement", "lifted")):
            rows = rows.unionByName(part(moved.where(F.col("holder_type") == kind), 2, F.col("block"), F.col("at"), 1, origin))
        rows = checkpointed(statements.number(rows, "fn", "rank", "place", "id"))
        # The statement above: the nearest kept one, else the entry; its branch is the block's place.
        kept = rows.where("rank = 2").select("id", F.lit(True).alias("kept"))
        above = graph.owner(self.tree.join(kept, "id", "left"), self.links, F.coalesce("kept", F.lit(False))).select(F.col("id").alias("block"), F.col("owner").alias("above"))
        scope = self._scopes()
        rows = rows.join(above, "block", "left").join(scope, "block", "left")
        sid_of = rows.select(F.col("id").alias("above"), F.col("sid").alias("above_sid"))
        out = rows.join(sid_of, "above", "left").withColumn("parent_sid", F.when(F.col("rank") > 0, F.coalesce("above_sid", F.lit(0))))
        return checkpointed(out.drop("above_sid"))

    def _first_calls(self, body: DataFrame) -> DataFrame:
        """holder, holder_type, call: the first call in the value of an assignment, and the first in the condition of an
        if where it has an effect. Calls that stand for a macro's constant do not count."""
        holders = body.where(F.col("node_type").isin("AssignmentExpression", "IfStatement")).select(F.col("id").alias("holder"), F.col("node_type").alias("holder_type"), F.size("path").alias("above"))
        marked = self.tree.join(body.select("id", F.lit(True).alias("is_stmt")), "id", "left")
        near = graph.owner(marked, self.links, F.coalesce("is_stmt", F.lit(False))).select(F.col("id").alias("call"), F.col("owner").alias("holder"))
        calls = self.tree.where(F.col("node_type").isin("StandardLibCall", "UserDefinedCall")).select(F.col("id").alias("call"), "name", "path")
        calls = calls.join(callflags.macro_calls(self.tree), "call", "left_anti").join(near, "call").join(holders, "holder")
        operand = F.try_element_at("path", F.col("above") + 1)
        calls = calls.where(F.when(F.col("holder_type") == "IfStatement", operand == 1).otherwise(operand == 2))
        first = calls.groupBy("holder", "holder_type").agg(F.min_by(F.struct("call", "name"), "path").alias("c")).select("holder", "holder_type", "c.*")
        lifted = callflags.lifted(first.where("holder_type = 'IfStatement'"))
        return checkpointed(first.where("holder_type <> 'IfStatement'").unionByName(lifted))

    def _scopes(self) -> DataFrame:
        """block, scope, branch: nested plain blocks join the outermost one below a control statement;
        branch is that block's place among the children of the control, from 0."""
        plain = self.tree.where("node_type = 'CompoundStatement'").select("id", "parent")
        kinds = self.tree.select(F.col("id").alias("parent"), F.col("node_type").alias("over"))
        tops = plain.join(kinds, "parent").where(F.col("over") != "CompoundStatement").select("id", "parent")
        place = F.row_number().over(Window.partitionBy("parent").orderBy("path")) - 1
        order = self.tree.where("node_type = 'CompoundStatement'").withColumn("branch", place).select("id", "branch")
        marked = self.tree.join(tops.select("id", F.lit(True).alias("top")), "id", "left")
        found = graph.owner(marked, self.links, F.coalesce("top", F.lit(False))).select(F.col("id").alias("block"), F.col("owner").alias("scope"))
        labels = self.tree.where(F.col("node_type").isin("CaseLabel", "DefaultLabel")).select(F.col("id").alias("block"), F.col("id").alias("scope"), F.col("code").alias("label"))
        out = found.join(labels.select("block"), "block", "left_anti").join(order.select(F.col("id").alias("scope"), "branch"), "scope", "left").select("block", "scope", "branch")
        return checkpointed(out.unionByName(labels.select("block", "scope", F.lit(0).alias("branch"))))

    def parent_edges(self) -> DataFrame:
        return self.statements.where("sid > 0").select("fn", F.col("parent_sid").alias("src"), F.col("sid").alias("dst"))

    def order_edges(self) -> DataFrame:
        """Neighbouring statements of a scope; parameters among themselves."""
        scope = F.when(F.col("rank") == 1, F.lit("params")).otherwise(F.concat_ws("/", F.coalesce("above", F.lit("")), F.coalesce("scope", F.lit(""))))
        return statements.order_edges(self.statements.where("sid > 0").withColumn("_scope", scope), ["fn", "_scope"], "sid").select("fn", "src", "dst")

    def guard_edges(self) -> DataFrame:
        """fn, src, dst, kind, branch: from each control statement to the first one of each block; then
        is 0 and else 1, loops have 2, a switch the number of its label."""
        inner = self.statements.where(F.col("above").isNotNull() & (F.col("origin") != "lifted"))
        kinds = self.statements.select(F.col("id").alias("above"), F.col("node_type").alias("control_type"))
        rows = inner.join(kinds, "above").where(F.col("control_type").isin(*CONTROLS))
        labels = self.tree.where(F.col("node_type").isin("CaseLabel", "DefaultLabel")).select(F.col("id").alias("scope"), case_int(case_label("code")).alias("number"), F.col("path").alias("label_path"))
        rows = rows.join(labels, "scope", "left")
        # A label that is no number gets a place among the other such labels of its switch.
        place = F.dense_rank().over(Window.partitionBy("fn", "parent_sid", F.col("number").isNull()).orderBy("label_path")) - 1
        branch = F.when(F.col("control_type") == "IfStatement", F.col("branch")).when(F.col("control_type") == "SwitchStatement", F.coalesce("number", place)).otherwise(2)
        blocks = rows.select("fn", F.col("parent_sid").alias("control"), branch.alias("branch"), "sid", F.col("place").alias("path"), lookup("control_type", statements.GUARD_KIND).alias("kind"))
        kind = blocks.select("fn", F.col("control").alias("src"), "kind").distinct()
        return statements.guard_edges(blocks).join(kind, ["fn", "src"])

    @cached_property
    def guard_facts(self) -> DataFrame:
        """control, var, lower, upper, norm: what the condition of a control statement, and the header of a for, say
        about variables."""
        conds = callflags.condition_of(self.tree).select("control", F.col("cond").alias("id"))
        inside = graph.owner(self.tree.join(conds.select("id", F.lit(True).alias("is_cond")), "id", "left"), self.links, F.coalesce("is_cond", F.lit(False))).where(F.col("owner").isNotNull()).select("id", F.col("owner").alias("cond"))
        said = F.coalesce("code", "name", "value")
        kids = self.tree.select(F.col("parent").alias("id"), said.alias("said"), F.row_number().over(Window.partitionBy("parent").orderBy("path")).alias("pos"))
        side = lambda n, name: kids.where(F.col("pos") == n).select("id", F.trim("said").alias(name))
        compared = self.tree.where(F.col("operator").isin("<", "<=", ">", ">=") & (F.col("node_type") == "BinaryExpression")).select("id", F.col("operator").alias("op")).join(inside, "id")
        facts = statements.comparison_guards(compared.join(side(1, "left"), "id").join(side(2, "right"), "id").select("cond", "op", "left", "right"))
        facts = facts.join(conds.withColumnRenamed("id", "cond"), "cond").select("control", "var", "lower", "upper", "norm")
        header = statements.for_header_lower(self._for_headers()).select(F.col("cond").alias("control"), "var", "lower", F.lit(0).alias("upper"), F.lit(0.0).alias("norm"))
        out = facts.unionByName(header).groupBy("control", "var").agg(F.max("lower").alias("lower"), F.max("upper").alias("upper"), F.max("norm").alias("norm"))
        return checkpointed(out)

    def _for_headers(self) -> DataFrame:
        """cond (the for), init_var, init_value, inc_var, inc_op, inc_value."""
        fors = self.tree.where("node_type = 'ForStatement'").select(F.col("id").alias("cond"))
        rows = self.tree.select("id", "parent", "node_type", "operator", F.trim(F.coalesce("code", "name", "value")).alias("said"), F.row_number().over(Window.partitionBy("parent").orderBy("path")).alias("pos"))
        part = lambda n, name: rows.where(F.col("pos") == n).join(fors, F.col("parent") == F.col("cond")).select("cond", F.col("id").alias(name), F.col("operator").alias(f"{name}_op"))
        kid = lambda of, n, name: rows.where(F.col("pos") == n).select(F.col("parent").alias(of), F.col("said").alias(name))
        number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^([0-9]+)[uUlL]*$', 1) AS BIGINT)")
        init = part(1, "init").where("init_op = '='").join(kid("init", 1, "init_var"), "init").join(kid("init", 2, "init_text"), "init")
        inc = part(3, "inc").join(kid("inc", 1, "inc_var"), "inc").join(kid("inc", 2, "inc_text"), "inc", "left")
        return init.join(inc, "cond").select("cond", "init_var", number("init_text").alias("init_value"), "inc_var", F.col("inc_op").alias("inc_op"), number("coalesce(inc_text, '')").alias("inc_value"))

    @cached_property
    def contexts(self) -> DataFrame:
        """fn, sid, strength, norm: the guards in force at each statement, from all controls around it; of several on one
        variable the innermost holds. A lifted call runs before its condition and has none of its own."""
        controls = self.statements.where(F.col("node_type").isin(*CONTROLS)).select("id", F.col("above").alias("outer"))
        up = controls.where(F.col("outer").isNotNull()).select(F.col("id").alias("src"), F.col("outer").alias("dst"))
        around = graph.closure(up, controls.select("id")).select(F.col("seed").alias("above"), F.col("node").alias("control"), (-F.col("depth")).alias("depth"))
        held = self.statements.where("rank = 2 AND origin <> 'lifted'").select("fn", "sid", "above").join(around, "above").join(self.guard_facts, "control")
        return checkpointed(statements.context(held.select("fn", "sid", "depth", "var", "lower", "upper", "norm")))

    @cached_property
    def guard_table(self) -> DataFrame:
        """fn, sid, var, kind, lower, upper, norm: the guards that reach a statement along parent and order edges from the
        first statement of a block; ``__agg__`` for a block whose condition bounds no variable."""
        node = lambda c: F.struct("fn", F.col(c).alias("sid"))
        steps = self.parent_edges().unionByName(self.order_edges()).select(node("src").alias("src"), node("dst").alias("dst"))
        control = self.statements.select("fn", F.col("sid").alias("src"), F.col("id").alias("control"))
        first = self.guard_edges().join(control, ["fn", "src"]).join(self.guard_facts, "control", "left")
        bound = lambda c, kind: F.coalesce(c, F.lit(0).cast(kind)).alias(c)
        guards = first.select(node("dst").alias("start"), "kind", F.coalesce("var", F.lit("__agg__")).alias("var"), bound("lower", "int"), bound("upper", "int"), bound("norm", "double"))
        return checkpointed(statements.guard_map(steps, checkpointed(guards)).select("node.fn", "node.sid", "var", "kind", "lower", "upper", "norm"))

    @cached_property
    def calls(self) -> DataFrame:
        """fn, sid, call, name of the statements that are calls."""
        return self.statements.where(F.col("node_type").isin("StandardLibCall", "UserDefinedCall")).select("fn", "sid", F.col("id").alias("call"), F.coalesce("name", F.lit("")).alias("name"))

    @cached_property
    def call_flags(self) -> DataFrame:
        """fn, sid and the flags of statements that are calls."""
        args = callflags.call_arguments(self.tree)
        return checkpointed(callflags.flags(self.calls.select("call", "name"), args).join(self.calls.select("fn", "sid", "call"), "call").drop("call"))

    def features(self) -> DataFrame:
        """fn, sid, node_type, code, orig_id and the twenty numbers of a statement."""
        # A statement is in a loop if its parent is a loop or in one.
        over = graph.owner(self.tree, self.links, F.col("node_type").isin(*LOOPS)).where(F.col("owner").isNotNull()).select(F.col("id").alias("parent"))
        looped = self.links.join(over, "parent", "left_semi").select("id", F.lit(1).alias("in_loop"))
        kind, size = F.col("node_type"), array_size("code")
        low = F.lower(F.coalesce("name", F.lit("")))
        array = kind == "ArrayDeclaration"
        one = lambda c: F.coalesce(c.cast("int"), F.lit(0))
        flag = lambda c, name: F.coalesce(F.col(c), F.lit(0)).alias(name)
        rows = self.statements.join(looped, "id", "left").join(self.contexts, ["fn", "sid"], "left").join(self.call_flags, ["fn", "sid"], "left")
        return rows.select(
            "fn", "sid", "node_type", "code", F.col("id").alias("orig_id"), statements.node_type_id("node_type").alias("node_type_id"), statements.train_mask(kind).alias("train_mask"),
            F.coalesce("in_loop", F.lit(0)).alias("in_loop"), one(kind.isin(*LOOPS)).alias("is_loop"), flag("strength", "ctx_guard_strength"), F.coalesce("norm", F.lit(0.0)).alias("ctx_upper_bound_norm"),
            one(array).alias("is_buffer_decl"), F.when(array, size["state"]).otherwise(0).alias("buffer_size_state"), F.when(array, size["norm"]).otherwise(0.0).alias("buffer_size_norm"),
            F.when(kind.isin("StandardLibCall", "UserDefinedCall"), lookup(low, CALL_CATEGORY, 0)).otherwise(0).alias("call_sem_cat_id"), flag("danger_unbounded", "call_flag_danger_unbounded"), flag("len_linked_to_dst", "call_flag_len_linked_to_dst"),
            flag("sizeof_non_dst", "call_flag_sizeof_non_dst"), flag("has_varargs", "call_flag_has_varargs"), flag("dst_is_field", "call_dst_is_field"), flag("size_kind", "call_size_kind"), flag("len_linked_extended", "call_len_linked_to_dst_extended"),
            flag("size_is_base_struct", "call_size_is_sizeof_base_struct"), flag("size_mismatch_field", "call_size_mismatch_field"), flag("alloc_sizeof_state", "alloc_sizeof_state"),
        )

    @cached_property
    def identifiers(self) -> DataFrame:
        """fn, stmt, node, var, path, pointer, starred: identifiers below each statement, each with the nearest
        statement it belongs to, and whether it stands for a pointer, or for what one points to; operands of sizeof and what a macro's
        constant is made of do not count."""
        stmts = self.statements.where("rank = 2").select("id", F.lit(True).alias("is_stmt"))
        near = graph.owner(self.tree.join(stmts, "id", "left"), self.links, F.coalesce("is_stmt", F.lit(False))).select("id", F.col("owner").alias("stmt"))
        sized = graph.owner(self.tree, self.links, F.col("node_type") == "SizeOfExpression").where(F.col("owner").isNotNull()).select("id")
        macros = callflags.macro_calls(self.tree).select(F.col("call").alias("id"), F.lit(True).alias("is_macro"))
        constant = graph.owner(self.tree.join(macros, "id", "left"), self.links, F.coalesce("is_macro", F.lit(False))).where(F.col("owner").isNotNull()).select("id")
        around = self.tree.where("node_type = 'PointerDereference'").select(F.col("id").alias("parent"), F.lit(True).alias("pointer"), F.trim("code").startswith("*").alias("starred"))
        rows = self.tree.where("node_type = 'Identifier'").join(near, "id").join(sized, "id", "left_anti").join(constant, "id", "left_anti").where(F.col("stmt").isNotNull()).join(around, "parent", "left")
        no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
        return checkpointed(rows.select("fn", "stmt", F.col("id").alias("node"), F.col("name").alias("var"), "path", no("pointer"), no("starred")))

    @cached_property
    def mentions(self) -> DataFrame:
        """fn, sid, phase, var, is_def, flow: definitions and uses in the order in which a statement
        makes them. Parameters are defined at the entry, the variables of a for's header at the for. In an assignment the first operand's first
        name is defined (the container, for a subscript, is a base; an element of a pointer, or what it points to, is no
        definition of it, only a base), names in a subscript are indexes, those in an array's length sizes, the rest are values; in a call the target slot is a base and is defined, the size slot a size.
        Conditions make no use."""
        sid = self.statements.where("rank = 2").select(F.col("id").alias("stmt"), "sid", "node_type", F.col("path").alias("s_path"), F.col("name").alias("callee"))
        ids = self.identifiers.join(sid, "stmt")
        header = ids.where("node_type = 'ForStatement'").withColumn("operand", F.try_element_at("path", F.size("s_path") + 1))
        # The variable that starts, and all names in the step.
        starts = (F.col("operand") == 1) & (F.try_element_at("path", F.size("s_path") + 2) == 1) & (F.size("path") == F.size("s_path") + 2)
        header = header.where(starts | (F.col("operand") == 3)).select("fn", "sid", F.lit(0).alias("phase"), "var", F.lit(True).alias("is_def"), F.lit("value").alias("flow"))
        ids = ids.where(~F.col("node_type").isin(*CONTROLS))
        up = graph.owner(self.tree, self.links, F.col("node_type") == "ArraySubscriptExpression").where(F.col("owner").isNotNull()).select(F.col("id").alias("node"), F.col("owner").alias("sub"))
        subs = self.tree.select(F.col("id").alias("sub"), F.col("path").alias("sub_path"))
        ids = ids.join(up, "node", "left").join(subs, "sub", "left")
        place = lambda path, n: F.try_element_at("path", F.size(path) + n)
        operand = place("s_path", 1)
        index = F.coalesce(place("sub_path", 1) > 1, F.lit(False))
        # Written here, as the optimizer's constraints grow fast over the names below.
        ids = checkpointed(ids.select("fn", "sid", "node_type", F.lower("callee").alias("api"), "var", "sub", operand.alias("operand"), index.alias("index"), (F.col("starred") | (F.col("pointer") & F.col("sub").isNotNull())).alias("through")))
        slots = self.tree.sparkSession.createDataFrame([(n, d, z) for n, (d, z) in API_SLOTS.items()], "api string, dst_slot int, size_slot int")
        call = F.col("node_type").isin("StandardLibCall", "UserDefinedCall")
        lhs = (F.col("node_type") == "AssignmentExpression") & (F.col("operand") == 1)
        at = lambda slot: call & (F.col("operand") - 1 == F.col(slot))
        flow = F.when(F.col("index"), "index").when(lhs, "base").when(at("size_slot"), "size").when(at("dst_slot"), "base").otherwise("value")
        writes_to = F.coalesce(at("dst_slot") & ~F.col("index"), F.lit(False))
        rows = ids.join(F.broadcast(slots), "api", "left").select("fn", "sid", "var", "node_type", lhs.alias("lhs"), "index", "sub", "through", writes_to.alias("dst"), flow.alias("flow"))
        rows = checkpointed(rows)
        part = lambda df, phase, is_def, f: df.select("fn", "sid", F.lit(phase).alias("phase"), "var", F.lit(is_def).alias("is_def"), f.alias("flow"))
        own = F.col("lhs") & ~F.col("index")
        entry = self.statements.where("rank = 1").select("fn", F.lit(0).cast("int").alias("sid"), F.lit(0).alias("phase"), F.col("name").alias("var"), F.lit(True).alias("is_def"), F.lit("value").alias("flow"))
        decl = self.statements.where(F.col("node_type").isin("VariableDeclaration", "ArrayDeclaration", "PointerDeclaration")).select("fn", "sid", F.lit(5).alias("phase"), F.col("name").alias("var"), F.lit(True).alias("is_def"), F.lit("value").alias("flow"))
        uses = part(rows.where(call), 0, False, F.col("flow"))
        writes = part(rows.where(call & F.col("dst")), 1, True, F.lit("value"))
        inner = part(rows.where(~call & F.col("index")), 2, False, F.lit("index"))
        bases = part(rows.where(own & (F.col("sub").isNotNull() | F.col("through"))), 3, False, F.lit("base"))
        length = F.regexp_replace(F.coalesce("length", F.lit("")), r"\bsizeof\s*(\([^()]*\)|\w+)", " ")
        sizes = self.statements.where("node_type = 'ArrayDeclaration'").select("fn", "sid", F.col("id")).join(self.tree.select("id", "length"), "id").select("fn", "sid", F.explode(F.regexp_extract_all(length, F.lit(r"(?<![\w.])([A-Za-z_]\w*)(?!\s*\()"))).alias("var"), F.lit("size").alias("flow"))
        sizes = part(sizes, 0, False, F.col("flow"))
        # The call of an assignment owns the values in it.
        taken = self.splits.select("fn", F.col("assign_sid").alias("sid"))
        values = part(rows.where(~call & ~F.col("lhs") & ~F.col("index")).join(taken, ["fn", "sid"], "left_anti"), 4, False, F.lit("value"))
        defs = part(rows.where(own & ~F.col("through")), 5, True, F.lit("value"))
        out = entry.unionByName(decl).unionByName(header)
        for df in (uses, writes, inner, bases, sizes, values, defs):
            out = out.unionByName(df)
        return checkpointed(out.where(F.col("var").isNotNull() & (F.col("var") != "NULL")).distinct())

    @cached_property
    def splits(self) -> DataFrame:
        """fn, call_sid, assign_sid: assignments and the calls split off them."""
        later = self.statements.where("node_type = 'AssignmentExpression'").select("fn", F.col("place.at").alias("at"), F.col("sid").alias("assign_sid"))
        return self.statements.where("origin = 'split'").select("fn", F.col("place.at").alias("at"), F.col("sid").alias("call_sid")).join(later, ["fn", "at"]).drop("at")

    @cached_property
    def def_use(self) -> DataFrame:
        """fn, src, dst, var, flow, flow_id, guard_kind, has_lower, has_upper, upper_norm: one edge for each pair, variable
        and role, with the guards in force at its end."""
        e = dataflow.def_use(self.mentions, extra=("flow",)).distinct()
        given = callflags.return_edges(self.order_edges(), self.splits).withColumn("flow", F.lit("value"))
        e = checkpointed(e.unionByName(given.select("fn", "src", "dst", "var", "flow")))
        # A write to a subscript passes the guards of its index on to all uses in the statement.
        index = self.mentions.where("flow = 'index' AND NOT is_def").select("fn", "sid", "var").distinct().join(self._buffer_writes().select("fn", "sid"), ["fn", "sid"], "left_semi")
        whole = self.guard_table.join(index, ["fn", "sid", "var"], "left_semi").groupBy("fn", "sid").agg(F.lit("*").alias("var"), F.min("kind").alias("kind"), F.max("lower").alias("lower"), F.max("upper").alias("upper"), F.max("norm").alias("norm"))
        guards = checkpointed(self.guard_table.unionByName(whole))
        return checkpointed(dataflow.merge_guards(e, guards).withColumn("flow_id", dataflow.flow_id("flow")))

    def flow_nodes(self) -> DataFrame:
        """fn, sid, node_type_id, def_vars, use_vars and the twelve numbers of a statement in the def-use graph."""
        base = self.statements.select("fn", "sid", statements.node_type_id("node_type").alias("node_type_id"))
        calls = self.calls.select("fn", "sid", "name")
        args = callflags.call_arguments(self.tree).join(self.calls, "call").select("fn", "sid", F.lower(self.calls["name"]).alias("api"), "pos", "code")
        slots = F.broadcast(self.tree.sparkSession.createDataFrame([(n, d, z) for n, (d, z) in API_SLOTS.items()], "api string, dst_slot int, size_slot int"))
        at = lambda slot: F.max(F.when(F.col("pos") == F.col(slot), F.col("code")))
        writes = args.join(slots, "api").groupBy("fn", "sid", "api").agg(at("dst_slot").alias("dst"), at("size_slot").alias("size"))
        linked = self.call_flags.select("fn", "sid", F.col("len_linked_to_dst").alias("linked"))
        one = lambda c: F.coalesce(c.cast("int"), F.lit(0))
        rest = F.regexp_replace(F.coalesce("size", F.lit("")), r"\bsizeof\s*\([^)]*\)", "")
        bounded = F.col("api").isin(*BOUNDED_SINKS)
        other = F.contains(F.regexp_replace("size", r"\s+", ""), F.lit("sizeof(")) & (F.coalesce("linked", F.lit(0)) == 0)
        sizes = writes.join(linked, ["fn", "sid"], "left").select(
            "fn", "sid", one(F.col("api").isin(*BOUNDED_SINKS, *UNBOUNDED_SINKS) & callflags.has_indexing(F.col("dst"))).alias("call_dst_indexed"),
            one(bounded & (F.col("linked") == 1)).alias("call_len_linked_to_dst"), one(bounded & (rest.rlike(r"[A-Za-z_]") | other)).alias("call_size_nonconst"), one(F.col("api").isin(*UNBOUNDED_SINKS)).alias("call_danger_unbounded"),
        )
        out = base.join(dataflow.degrees(self.def_use), ["fn", "sid"], "left").join(dataflow.variables(self.mentions), ["fn", "sid"], "left").join(dataflow.sink_flags(calls, UNBOUNDED_SINKS, BOUNDED_SINKS), ["fn", "sid"], "left")
        out = out.join(sizes, ["fn", "sid"], "left").join(self._buffer_writes(), ["fn", "sid"], "left").fillna(0)
        empty = F.array().cast("array<string>")
        return out.withColumns({c: F.coalesce(c, empty) for c in ("def_vars", "use_vars")})

    def _buffer_writes(self) -> DataFrame:
        """fn, sid, is_buffer_access, is_sink_assign: assignments to a subscript, and whether its index is known at run
        time only. A subscript may show in the code alone, with a plain name as target; one that gives a declared array its first
        content, in braces, as a text or within two statements of its declaration, is none."""
        target = F.size("s_path") + 1
        stmts = self.statements.where("node_type = 'AssignmentExpression'").select("fn", "sid", F.col("id").alias("parent"), F.col("path").alias("s_path"))
        subs = self.tree.where("node_type = 'ArraySubscriptExpression'").select(F.col("id").alias("sub"), "parent", "path").join(stmts, "parent").where(F.try_element_at("path", target) == 1).select("fn", "sid")
        indexed = self.mentions.where("flow = 'index' AND NOT is_def AND phase = 2").select("fn", "sid", F.lit(1).alias("is_sink_assign")).distinct()
        found = subs.distinct().withColumn("is_buffer_access", F.lit(1)).join(indexed, ["fn", "sid"], "left").withColumn("is_sink_assign", F.coalesce("is_sink_assign", F.lit(0)))
        code = self.statements.select("fn", "sid", "code")
        plain = self.tree.where("node_type = 'Identifier'").select("parent", "path", F.col("name").alias("target")).join(stmts, "parent").where(F.try_element_at("path", target) == 1).join(code, ["fn", "sid"])
        at = lambda g: F.regexp_extract("code", r"^\s*([A-Za-z_]\w*)\s*\[([^\]]*)\](?:\s*\[[^\]]*\])*\s*=\s*(.?)", g)
        plain = plain.where((at(1) == F.col("target")) & ~at(3).isin("{", '"'))
        arrays = self.statements.where("node_type = 'ArrayDeclaration'").select("fn", F.col("name").alias("target"), F.explode(F.array(F.col("sid") + 1, F.col("sid") + 2)).alias("sid"))
        plain = plain.join(arrays, ["fn", "sid", "target"], "left_anti").select("fn", "sid", F.lit(1).alias("is_buffer_access"), at(2).rlike(r"(?<!\w)[A-Za-z_]").cast("int").alias("is_sink_assign"))
        return found.unionByName(plain.join(found.select("fn", "sid"), ["fn", "sid"], "left_anti").distinct())


#: The numbers of a statement, and of one in the def-use graph, and of a def-use edge.
STATEMENT_FEATURES = """node_type_id train_mask in_loop is_loop ctx_guard_strength ctx_upper_bound_norm is_buffer_decl buffer_size_state buffer_size_norm
    call_sem_cat_id call_flag_danger_unbounded call_flag_len_linked_to_dst call_flag_sizeof_non_dst call_flag_has_varargs call_dst_is_field call_size_kind
    call_len_linked_to_dst_extended call_size_is_sizeof_base_struct call_size_mismatch_field alloc_sizeof_state""".split()
FLOW_FEATURES = """node_type_id in_degree_dfg out_degree_dfg def_count use_count is_buffer_access is_sink_assign is_sink_call_unbounded is_sink_call_bounded
    call_dst_indexed call_len_linked_to_dst call_size_nonconst call_danger_unbounded""".split()


def training_records(fns: Functions, with_label: bool = False) -> DataFrame:
    """One row for each function: name, statements and def-use nodes with their numbers, the three families of statement
    edges and the def-use edges with theirs, as arrays, and a label from the name on demand."""
    gather = lambda df, name, *columns: df.groupBy("fn").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    feat = lambda names: F.struct(*[F.col(c) for c in names]).alias("feat")
    flow_nodes = fns.flow_nodes().withColumnsRenamed({"in_degree": "in_degree_dfg", "out_degree": "out_degree_dfg"})
    parts = [
        gather(fns.features(), "nodes", "sid", "node_type", "code", "orig_id", feat(STATEMENT_FEATURES)),
        gather(fns.parent_edges(), "edges_ast_pc", "src", "dst", F.lit(0).alias("kind")),
        gather(fns.order_edges(), "edges_ast_sb", "src", "dst", F.lit(1).alias("kind")),
        gather(fns.guard_edges(), "edges_ast_guard", "src", "dst", F.col("kind").alias("guard_kind"), F.col("branch").cast("long").alias("guard_branch")),
        gather(flow_nodes, "dfg_nodes", "sid", feat(FLOW_FEATURES), "def_vars", "use_vars"),
        gather(fns.def_use, "edges_dfg", "src", "dst", "var", "flow_id", "guard_kind", F.col("has_lower").alias("has_lower_guard"), F.col("has_upper").alias("has_upper_guard"), F.col("upper_norm").alias("upper_guard_norm")),
    ]
    out = fns.fns.withColumnRenamed("fn_name", "function_name")
    for part in parts:
        name = part.columns[1]
        out = out.join(part, "fn", "inner" if name == "nodes" else "left").withColumn(name, F.coalesce(name, F.array().cast(part.schema[name].dataType)))
    return out.withColumn("label", F.when(F.contains(F.lower("function_name"), F.lit("bad")), 1).otherwise(0)) if with_label else out


def validated_records(records: DataFrame) -> DataFrame:
    """Records as they are passed on: without the branch of guard edges, which serves debugging only. A record without a name
    or a statement is an error."""
    ok = F.col("function_name").isNotNull() & (F.size("nodes") > 0)
    guard = F.transform("edges_ast_guard", lambda e: F.struct(e["src"].alias("src"), e["dst"].alias("dst"), e["guard_kind"].alias("guard_kind")))
    checked = F.when(ok, F.col("nodes")).otherwise(F.raise_error(F.concat(F.lit("incomplete record "), F.coalesce("fn", F.lit("?")))))
    return records.withColumn("nodes", checked).withColumn("edges_ast_guard", guard)
