"""Producers of handler evidence over a code property graph, for all actions and documents at once.

Every producer returns evidence rows: doc, action, kind, weight, match, callback, site, nodes,
group, extractor. "First" is by document order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.functions.knowledge import KnowledgeBase
from graphlens.functions.text import strip_quotes, upper_snake
from graphlens.operators import calculus, traverse
from graphlens.operators.calculus import Policy
from graphlens.operators.cpg import ARRAY_INIT, ASSIGN, FIELD_ACCESS, Cpg
from graphlens.session import rounds
from graphlens.session import settled as checkpointed

COMPARISONS = tuple(f"<operator>.{x}" for x in ("equals", "notEquals", "lessThan", "greaterThan", "lessEqualsThan", "greaterEqualsThan"))
INDEXING = ("<operator>.indirectIndexAccess", "<operator>.indexAccess")


def _evidence(df: DataFrame, kind: Column, weight: Column, match: Column, site: Column, nodes: Column, group: Column, extractor: Column) -> DataFrame:
    return df.select("doc", "action", kind.alias("kind"), weight.cast("double").alias("weight"), match.alias("match"), "callback", site.cast("string").alias("site"), nodes.alias("nodes"), group.alias("group"), extractor.alias("extractor"))


def tokens(kb: KnowledgeBase) -> DataFrame:
    """action, token: the snake-case name and the symbols of each action."""
    return F.broadcast(kb.actions.select("action", F.explode(F.array_distinct(F.concat(F.array(upper_snake("action")), F.transform("symbols", lambda s: F.upper(s))))).alias("token")))


def by_string(g: Cpg, kb: KnowledgeBase) -> DataFrame:
    """A literal equal to the action, and the internal call near it: in the first control structure
    that holds the literal, outside its condition, else anywhere in the method."""
    lit = g.label("LITERAL").select("doc", F.col("id").alias("lit"), strip_quotes("code").alias("action"), "ord").join(F.broadcast(kb.actions.select("action")), "action")
    lit = lit.groupBy("doc", "action").agg(F.min_by("lit", "ord").alias("lit")).join(g.method_of.select(F.col("id").alias("lit"), "owner"), "lit")
    inner = g.calls.where("internal").select("call", "owner", F.col("ord").alias("call_ord"), F.col("target").alias("callback"))
    holds = g.below.select(F.col("top").alias("cs"), F.col("node").alias("lit"))
    near = g.conditions.select("cs", "cond", "owner", "cs_ord").join(holds, "cs").join(lit, ["lit", "owner"])
    under = g.below.select(F.col("top").alias("cs"), F.col("node").alias("call"))
    in_cond = g.below.select(F.col("top").alias("cond"), F.col("node").alias("call"))
    first = near.join(under, "cs").join(inner.drop("owner"), "call").join(in_cond, ["cond", "call"], "left_anti").select("doc", "action", "lit", "owner", "call", "callback", F.struct("cs_ord", "call_ord").alias("rank"))
    rest = lit.join(inner, "owner").select("doc", "action", "lit", "owner", "call", "callback", F.struct(F.lit(1 << 60).cast("long").alias("cs_ord"), "call_ord").alias("rank"))
    best = first.unionByName(rest).groupBy("doc", "action").agg(F.min_by(F.struct("lit", "owner", "call", "callback"), "rank").alias("b")).select("doc", "action", "b.*")
    return _evidence(best, F.lit("STRING_DISPATCH"), F.lit(0.9), F.lit("EXACT_IDENTIFIER"), F.lit(None), F.array("lit", "call"), F.concat(F.lit("site:string:"), "owner"), F.lit("string_dispatch"))


def first_internal_call(g: Cpg, starts: DataFrame) -> DataFrame:
    """start, call, callback: the first internal call over CFG edges from each start, not past another
    case label."""
    cfg = checkpointed(g.edges.where("label = 'CFG'").select(F.col("src").alias("node"), F.col("dst").alias("next"), F.col("ord").alias("eord")))
    hit = g.calls.where("internal").select(F.col("call").alias("node"), F.col("target").alias("callback"))
    labels = g.label("JUMP_TARGET").select(F.col("id").alias("node"))
    front = checkpointed(starts.select("start", F.col("start").alias("node"), F.array().cast("array<struct<rank:int,eord:bigint>>").alias("found")).distinct())
    known, out = front.select("start", "node"), None
    for depth in rounds():
        new = front.join(cfg, "node").select("start", F.col("next").alias("node"), F.concat("found", F.array(F.struct(F.lit(0).alias("rank"), F.col("eord").cast("long").alias("eord")))).alias("found"))
        new = new.groupBy("start", "node").agg(F.min("found").alias("found")).join(known, ["start", "node"], "left_anti")
        new = checkpointed(new.join(labels, "node", "left_anti").join(hit, "node", "left"))
        if new.isEmpty():
            break
        done = new.where(F.col("callback").isNotNull()).groupBy("start").agg(F.min_by(F.struct(F.col("node").alias("call"), "callback"), "found").alias("b"))
        done = checkpointed(done.select("start", "b.*"))
        out = done if out is None else out.unionByName(done)
        known = known.unionByName(new.select("start", "node"))
        if depth % 16 == 0:
            known = checkpointed(known)
        front = new.join(done, "start", "left_anti").select("start", "node", "found")
        if depth % traverse.RENUMBER == 0:
            front = traverse.renumbered(front, "start", "found")
    return out if out is not None else starts.select("start", F.lit(None).cast("string").alias("call"), F.lit(None).cast("string").alias("callback")).limit(0)


def by_case(g: Cpg, kb: KnowledgeBase) -> DataFrame:
    """The first case label with a token of the action from which an internal call is reached."""
    jt = g.label("JUMP_TARGET").select("doc", F.col("id").alias("start"), "ord", F.upper("code").alias("code"))
    hits = jt.join(tokens(kb), F.contains("code", "token")).select("doc", "start", "ord", "code", "action").distinct()
    rows = checkpointed(hits.join(first_internal_call(g, hits), "start"))
    first = rows.groupBy("doc", "action").agg(F.min_by(F.struct("start", "code", "call", "callback"), "ord").alias("b")).select("doc", "action", "b.*")
    first = first.join(F.broadcast(kb.actions.select("action", "symbols")), "action").join(g.method_of.select(F.col("id").alias("start"), "owner"), "start", "left")
    exact = F.exists("symbols", lambda s: F.contains(F.col("code"), F.upper(s)))
    match = F.when(exact, "EXACT_IDENTIFIER").when(F.contains("code", upper_snake("action")), "NORMALIZED_NAME").otherwise("HEURISTIC_SUBSTRING")
    group = F.when(exact, F.concat(F.lit("site:switch:"), F.coalesce("owner", F.lit("")))).otherwise(F.concat(F.lit("token:"), "action"))
    return _evidence(first, F.lit("ENUM_CASE"), F.lit(0.85), match, F.col("start"), F.array("start", "call"), group, F.lit("enum_case"))


def by_method_name(g: Cpg, kb: KnowledgeBase) -> DataFrame:
    """The first internal method with a handler pattern's name, else with the action in its name."""
    m = g.methods.select("doc", F.col("method").alias("callback"), F.lower("method_name").alias("lower"), "method_ord")
    pat = m.join(F.broadcast(kb.actions.select("action", F.explode("handlers").alias("h"))), F.col("lower") == F.lower("h")).select("doc", "action", "callback", F.struct(F.lit(0).alias("r"), "method_ord").alias("rank"))
    part = m.join(F.broadcast(kb.actions.select("action", F.lower(upper_snake("action")).alias("snake"))), F.contains("lower", "snake")).select("doc", "action", "callback", F.struct(F.lit(1).alias("r"), "method_ord").alias("rank"))
    best = pat.unionByName(part).groupBy("doc", "action").agg(F.min(F.struct("rank", "callback")).alias("b")).select("doc", "action", "b.callback", F.col("b.rank.r").alias("r"))
    named = F.col("r") == 0
    return _evidence(best, F.lit("NAME_MATCH"), F.when(named, 0.7).otherwise(0.65), F.when(named, "NORMALIZED_NAME").otherwise("HEURISTIC_SUBSTRING"), F.lit(None), F.array("callback"), F.concat(F.lit("token:"), "action"), F.when(named, "name_pattern").otherwise("name_token"))


def registrations(g: Cpg) -> DataFrame:
    """doc, ref, callback, mechanism, node, site_key, slot, symbols, literals: function references in
    positional and designated initialisers and in field stores, with the ids beside them."""
    refs = g.label("METHOD_REF").select("doc", F.col("id").alias("ref"), strip_quotes("code").alias("method_name")).join(g.by_name, ["doc", "method_name"]).withColumnRenamed("method", "callback").drop("method_name")
    refs = refs.join(g.parent.select(F.col("id").alias("ref"), F.col("parent").alias("entry")), "ref").join(g.ids("entry", "name", where=F.col("label") == "CALL"), "entry")
    refs = checkpointed(refs.where(F.col("entry_name").isin(ARRAY_INIT, ASSIGN)))
    up = lambda a, b: g.parent.select(F.col("id").alias(a), F.col("parent").alias(b))
    kind = lambda a: g.ids(a, "label", "name")
    kids = g.edges.where("label = 'AST'").select("src", F.col("dst").alias("kid"))

    # Designated: at most three blocks between the assignment and its initialiser.
    lhs = g.args.where((F.col("pos") == 1) & (F.col("arg_label") == "IDENTIFIER")).select(F.col("call").alias("entry"))
    climb = refs.where(F.col("entry_name") == ASSIGN).join(lhs, "entry", "left_semi").select("entry").distinct().join(up("entry", "p1"), "entry").join(kind("p1"), "p1")
    climb = climb.join(up("p1", "p2"), "p1", "left").join(kind("p2"), "p2", "left").join(up("p2", "p3"), "p2", "left").join(kind("p3"), "p3", "left")
    is_init = lambda p: (F.col(f"{p}_label") == "CALL") & (F.col(f"{p}_name") == ARRAY_INIT)
    block = lambda p: F.col(f"{p}_label") == "BLOCK"
    struct_ = F.when(is_init("p1"), F.col("p1")).when(block("p1") & is_init("p2"), F.col("p2")).when(block("p1") & block("p2") & is_init("p3"), F.col("p3"))
    inits = checkpointed(climb.select("entry", struct_.alias("init")).where(F.col("init").isNotNull()))

    # Where the ids of each registration are: subtrees (tops).
    positional = refs.where(F.col("entry_name") == ARRAY_INIT).join(up("entry", "table"), "entry", "left")
    positional = positional.select("doc", "ref", "callback", "entry", F.lit("AGGREGATE_INIT").alias("mechanism"), F.col("entry").alias("node"), F.coalesce("table", "entry").alias("site_key"), F.lit("").alias("slot"))
    designated = refs.join(inits, "entry").select("doc", "ref", "callback", "entry", F.lit("AGGREGATE_INIT").alias("mechanism"), F.col("init").alias("node"), F.concat(F.lit("designated:"), "init").alias("site_key"), F.lit("").alias("slot"))
    stores = refs.where(F.col("entry_name") == ASSIGN).join(inits.select("entry"), "entry", "left_anti").join(g.receiver.select(F.col("assign").alias("entry"), "slot", "method"), "entry", "left")
    stores = checkpointed(stores)
    assigns = stores.select("doc", "ref", "callback", "entry", F.lit("FIELD_ASSIGN").alias("mechanism"), F.col("entry").alias("node"), F.concat(F.lit("assign:"), F.coalesce("method", F.lit("")), F.lit(":"), F.coalesce("slot", F.lit(""))).alias("site_key"), F.coalesce("slot", F.lit("")).alias("slot"))

    beside = lambda df: df.select("ref", "entry").join(kids, F.col("entry") == F.col("src")).where(F.col("kid") != F.col("ref")).select("ref", F.col("kid").alias("top"))
    value = g.args.where("pos = 2").select(F.col("call").alias("other"), F.col("arg").alias("top"))
    # Fields of the same initialiser, each under a block or not.
    direct = kids.select(F.col("src").alias("node"), F.col("kid").alias("other"))
    wrapped = direct.join(g.ids("other", "label", where=F.col("label") == "BLOCK"), "other").join(kids, F.col("other") == F.col("src")).select("node", F.col("kid").alias("other"))
    fields = direct.unionByName(wrapped).join(g.calls.where(F.col("name") == ASSIGN).select(F.col("call").alias("other")), "other").join(lhs.withColumnRenamed("entry", "other").join(g.args.where((F.col("pos") == 1) & (F.col("arg_label") == "IDENTIFIER")).select(F.col("call").alias("other")), "other", "left_semi"), "other", "left_semi")
    sibling = designated.select("ref", "entry", "node").join(fields, "node").where(F.col("other") != F.col("entry")).join(value, "other").select("ref", "top")
    paired = stores.select("ref", "entry", "slot", "method").join(g.receiver.select(F.col("assign").alias("other"), "slot", "method"), ["slot", "method"]).where(F.col("other") != F.col("entry")).join(value, "other").select("ref", "top")
    tops = reduce(DataFrame.unionByName, [beside(positional), beside(stores), sibling, paired]).distinct()
    ids = tops.join(g.tokens, "top").groupBy("ref").agg(F.collect_set("symbol").alias("symbols"), F.collect_set("literal").alias("literals"))
    none = F.array().cast("array<string>")
    all_ = reduce(DataFrame.unionByName, [positional, designated, assigns]).join(ids, "ref", "left")
    return checkpointed(all_.withColumn("symbols", F.coalesce("symbols", none)).withColumn("literals", F.coalesce("literals", none)).drop("entry"))


def by_registration(g: Cpg, kb: KnowledgeBase) -> DataFrame:
    """All registrations with a token of the action among their symbols or its number among their literals."""
    acts = kb.actions.select("action", "symbols", F.transform("numeric", lambda n: n.cast("string")).alias("numeric"), F.array_distinct(F.concat(F.array(upper_snake("action")), F.transform("symbols", lambda s: F.upper(s)))).alias("tokens"))
    acts = F.broadcast(acts.withColumnRenamed("symbols", "kb_symbols"))
    symbol = F.exists("symbols", lambda s: F.exists("tokens", lambda t: F.contains(s, t)))
    number = F.arrays_overlap("literals", "numeric")
    # The actions are a short table, so each registration meets each of them once.
    rows = registrations(g).join(acts, symbol | number)
    exact = number | F.exists("kb_symbols", lambda s: F.array_contains(F.col("symbols"), F.upper(s)))
    kind = F.when(F.col("mechanism") == "AGGREGATE_INIT", "REGISTRATION_INIT").otherwise("REGISTRATION_ASSIGN")
    group = F.when(exact, F.concat(F.lit("site:reg:"), "site_key")).otherwise(F.concat(F.lit("token:"), "action"))
    return _evidence(rows, kind, F.lit(0.8), F.when(exact, "EXACT_IDENTIFIER").otherwise("HEURISTIC_SUBSTRING"), F.lit(None), F.array("node", "ref"), group, F.lit("registration_ast"))


def registrar_calls(g: Cpg, kb: KnowledgeBase, depth: int) -> DataFrame:
    """doc, action, call, callback, cb_arg, exact, stored, searched, sites, id_store, cb_store: internal calls that get a function
    and an id of an action, and whether some function within ``depth`` hops stores both in one slot; then with the first such way
    in the order of a search that looks into a function before the functions it calls: the calls passed through and both stores."""
    internal = g.methods.select(F.col("method").alias("target"))
    calls = g.calls.where(~F.col("name").startswith("<operator>")).join(internal, "target", "left_semi").select("doc", "call", "target", "ord")
    refs = g.args.where("arg_label = 'METHOD_REF'").select("call", F.col("idx").alias("cb_idx"), F.col("arg").alias("cb_arg"), "pos", strip_quotes("arg_code").alias("method_name"))
    cb = calls.join(refs, "call").join(g.by_name, ["doc", "method_name"]).groupBy("doc", "call", "target").agg(F.min_by(F.struct("cb_idx", "cb_arg", F.col("method").alias("callback")), "pos").alias("c")).select("doc", "call", "target", "c.*")
    acts = F.broadcast(kb.actions.select("action", F.transform("numeric", lambda n: n.cast("string")).alias("numeric"), F.transform("symbols", lambda s: F.upper(s)).alias("symbols"), F.array_distinct(F.concat(F.array(upper_snake("action")), F.transform("symbols", lambda s: F.upper(s)))).alias("tokens")))
    code = F.upper("arg_code")
    number = (F.col("arg_label") == "LITERAL") & F.array_contains("numeric", strip_quotes("arg_code"))
    said = F.exists("tokens", lambda t: F.contains(code, t))
    ids = cb.join(g.args.select("call", F.col("idx").alias("id_idx"), "pos", "arg_label", "arg_code"), "call").join(acts, number | said)
    exact = number | F.array_contains("symbols", code) | F.array_contains("numeric", code)
    # A number decides at its place; otherwise the last token does.
    pick = F.min_by(F.struct("id_idx", exact.alias("exact")), F.struct(F.when(number, 0).otherwise(1).alias("r"), F.when(number, F.col("pos")).otherwise(-F.col("pos")).alias("p")))
    rows = ids.groupBy("doc", "action", "call", "target", "cb_idx", "cb_arg", "callback").agg(pick.alias("i")).select("doc", "action", "call", "target", "cb_arg", "callback", "cb_idx", F.col("i.id_idx").alias("id_idx"), F.col("i.exact").alias("exact"))
    rows = checkpointed(_bind(g, rows))

    # Names below each argument and each stored value.
    named = g.below.join(g.ids("node", "name", "label", "code"), "node").select("top", F.coalesce(F.nullif("node_name", F.lit("")), F.when(F.col("node_label") == "METHOD_REF", strip_quotes("node_code"))).alias("n"), F.col("node_label").alias("nl")).where(F.col("n").isNotNull())
    named = checkpointed(named.distinct())
    rhs = g.args.where("pos = 2").select(F.col("call").alias("assign"), F.col("arg").alias("top")).join(named.where(F.col("nl").isin("IDENTIFIER", "METHOD_REF")), "top").select("assign", "n").join(g.receiver.select("assign", "slot", "method"), "assign")
    rhs = checkpointed(rhs.distinct().join(g.calls.select(F.col("call").alias("assign"), F.col("ord").cast("long").alias("a_ord")), "assign"))
    # ``way`` holds the places of the calls passed through; the way of a function sorts before those through its calls.
    state = rows.select("action", "call", F.col("target").alias("method"), "cb_name", "id_name", F.array().cast("array<bigint>").alias("way"), F.array().cast(f"array<{g.nodes.schema['id'].dataType.simpleString()}>").alias("sites")).distinct()
    stored = None
    for hop in range(depth + 1):
        a = rhs.select("method", F.col("n").alias("cb_name"), "slot", F.col("assign").alias("cb_store"), F.col("a_ord").alias("ca"))
        b = rhs.select("method", F.col("n").alias("id_name"), "slot", F.col("assign").alias("id_store"), F.col("a_ord").alias("ia"))
        hit = state.join(a, ["method", "cb_name"]).join(b, ["method", "id_name", "slot"]).where(F.col("cb_store") != F.col("id_store")).select("action", "call", "way", "ca", "ia", "sites", "id_store", "cb_store")
        stored = hit if stored is None else stored.unionByName(hit)
        if hop == depth:
            break
        inside = g.calls.where(~F.col("name").startswith("<operator>") & F.col("target").isNotNull()).select(F.col("owner").alias("method"), F.col("call").alias("site"), F.col("target").alias("next"), F.col("ord").cast("long").alias("site_ord"))
        uses = g.args.select(F.col("call").alias("site"), "idx", F.col("arg").alias("top")).join(named.select("top", "n"), "top").select("site", "idx", "n").distinct()
        go = state.join(inside, "method").join(uses.select("site", F.col("idx").alias("cb_idx"), F.col("n").alias("cb_name")), ["site", "cb_name"]).join(uses.select("site", F.col("idx").alias("id_idx"), F.col("n").alias("id_name")), ["site", "id_name"])
        # If several arguments of a call hold a name, the last one stands for it.
        go = go.groupBy("action", "call", "site", "next", "site_ord", "way", "sites").agg(F.max("cb_idx").alias("cb_idx"), F.max("id_idx").alias("id_idx"))
        go = _bind(g, go.select("action", "call", F.col("next").alias("target"), "cb_idx", "id_idx", F.concat("way", F.array("site_ord")).alias("way"), F.concat("sites", F.array("site")).alias("sites")))
        state = go.groupBy("action", "call", F.col("target").alias("method"), "cb_name", "id_name").agg(F.min(F.struct("way", "sites")).alias("w"))
        state = checkpointed(state.select("action", "call", "method", "cb_name", "id_name", "w.way", "w.sites"))
    stored = stored.groupBy("action", "call").agg(F.min(F.struct("way", "ca", "ia", "sites", "id_store", "cb_store")).alias("w")).select("action", "call", "w.sites", "w.id_store", "w.cb_store")
    compared = g.calls.where(F.col("name").isin(*COMPARISONS)).select(F.col("call").alias("top"), F.col("owner").alias("target")).join(named.select("top", "n"), "top").select("target", F.col("n").alias("id_name"), F.lit(True).alias("compared")).distinct()
    loops = g.label("CONTROL_STRUCTURE").where(F.upper("control_type").isin("FOR", "WHILE", "DO")).select("id").join(g.method_of, "id").select(F.col("owner").alias("target"), F.lit(True).alias("loop")).distinct()
    out = rows.join(stored.withColumn("stored", F.lit(True)), ["action", "call"], "left").join(compared, ["target", "id_name"], "left").join(loops, "target", "left")
    out = out.join(_indexed_stores(g, named), ["target", "cb_name"], "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return checkpointed(out.select("doc", "action", "call", "callback", "cb_arg", "exact", yes("stored").alias("stored"), (yes("compared") & (yes("loop") | yes("indexed"))).alias("searched"), "sites", "id_store", "cb_store"))


def _indexed_stores(g: Cpg, named: DataFrame) -> DataFrame:
    """target, cb_name, indexed: functions with an assignment that holds a name and whose target is an element, or a field of one, at
    an index that is no literal."""
    place = Window.partitionBy("src").orderBy("ord", "dst")
    kids = g.edges.where("label = 'AST'").withColumn("at", F.row_number().over(place))
    kid = lambda k, a, b: kids.where(F.col("at") == k).select(F.col("src").alias(a), F.col("dst").alias(b))
    calls = lambda a, names: g.calls.where(F.col("name").isin(*names)).select(F.col("call").alias(a))
    lhs = g.args.where("pos = 1").select(F.col("call").alias("assign"), F.col("arg").alias("lhs")).join(calls("assign", (ASSIGN,)), "assign")
    of_field = lhs.join(calls("lhs", FIELD_ACCESS), "lhs").join(kid(1, "lhs", "element"), "lhs").select("assign", "element")
    elements = of_field.unionByName(lhs.select("assign", F.col("lhs").alias("element"))).join(calls("element", INDEXING), "element")
    index = kid(2, "element", "index").join(g.ids("index", "label", where=F.col("label") != "LITERAL"), "index")
    stores = elements.join(index, "element").select(F.col("assign").alias("top")).distinct().join(named.select("top", "n"), "top").join(g.calls.select(F.col("call").alias("top"), F.col("owner").alias("target")), "top")
    return stores.select("target", F.col("n").alias("cb_name"), F.lit(True).alias("indexed")).distinct()


def registrar_chains(g: Cpg, registrars: DataFrame) -> DataFrame:
    """doc, action, call, pos, step, node, code, line: how each registrar call that stores its callback gets there: the call,
    the calls it is handed on by, the stores of the id and of the callback, and the callback."""
    step = lambda kind, node: F.struct(F.lit(kind).alias("step"), F.col(node).alias("node"))
    handed = F.transform("sites", lambda s: F.struct(F.lit("CHAIN_CALL").alias("step"), s.alias("node")))
    chain = F.concat(F.array(step("DISPATCH_REGISTRAR_CALL", "call")), handed, F.array(step("CHAIN_STORE", "id_store"), step("CHAIN_STORE", "cb_store"), step("HANDLER_REF", "callback")))
    rows = registrars.where("stored").select("doc", "action", "call", F.posexplode(chain).alias("pos", "s")).select("doc", "action", "call", "pos", "s.step", "s.node")
    shown = F.when(F.col("step") == "HANDLER_REF", F.col("node_name")).otherwise(F.col("node_code"))
    return rows.join(g.ids("node", "code", "name", "line"), "node").select("doc", "action", "call", "pos", "step", "node", shown.alias("code"), F.col("node_line").alias("line"))


def _bind(g: Cpg, rows: DataFrame) -> DataFrame:
    """Adds the names of the parameters that get the callback and the id."""
    p = lambda a, b: g.params.select(F.col("method").alias("target"), F.col("idx").alias(a), F.col("param_name").alias(b))
    return rows.join(p("cb_idx", "cb_name"), ["target", "cb_idx"]).join(p("id_idx", "id_name"), ["target", "id_idx"])


def by_registrar(registrars: DataFrame) -> DataFrame:
    return _evidence(registrars.where("stored"), F.lit("REGISTRAR_CALL"), F.lit(0.7), F.when(F.col("exact"), "EXACT_IDENTIFIER").otherwise("HEURISTIC_SUBSTRING"), F.col("call"), F.array("call", "cb_arg"), F.concat(F.lit("site:registrar:"), "call"), F.lit("registrar_call"))


def diagnose(g: Cpg, kb: KnowledgeBase, registrars: DataFrame) -> DataFrame:
    """doc, action, reason, secondary, dispatch: why an action has no evidence, for all of them."""
    pointer = g.calls.where("name = '<operator>.pointerCall'").groupBy("doc").agg(F.min_by("call", "ord").alias("dispatch"))
    # A function passed to a call beside an id of the action, resolved or not.
    refs = g.label("METHOD_REF").select(F.col("id").alias("ref")).join(g.parent.select(F.col("id").alias("ref"), F.col("parent").alias("top")), "ref")
    sites = refs.join(g.ids("top", "name", "doc", where=F.col("label") == "CALL"), "top").where(~F.col("top_name").isin(ARRAY_INIT, ASSIGN)).select("top", F.col("top_doc").alias("doc")).distinct()
    said = sites.join(g.tokens, "top").join(tokens(kb), F.contains("symbol", "token")).select("doc", "action")
    numbers = F.broadcast(kb.actions.select("action", F.explode(F.transform("numeric", lambda n: n.cast("string"))).alias("literal")))
    passed = said.unionByName(sites.join(g.tokens, "top").join(numbers, "literal").select("doc", "action")).distinct().withColumn("passed", F.lit(True))
    missed = registrars.where("not stored").groupBy("doc", "action").agg(F.max("searched").alias("searched"), F.lit(True).alias("missed"))
    docs = g.nodes.select("doc").distinct().join(F.broadcast(kb.actions.select("action")))
    rows = docs.join(pointer, "doc", "left").join(passed, ["doc", "action"], "left").join(missed, ["doc", "action"], "left")
    reason = F.when(F.col("passed") & F.col("missed") & F.col("searched"), "REGISTRAR_SEARCH_THEN_WRITE").when(F.col("passed") & F.col("missed"), "REGISTRAR_STORE_NOT_REACHED").when(F.col("passed"), "UNSUPPORTED_REGISTRAR_CALL").when(F.col("dispatch").isNotNull(), "UNRESOLVED_INDIRECT_CALL").otherwise("NO_EVIDENCE")
    return rows.select("doc", "action", reason.alias("diagnosis"), F.when(F.col("passed") & F.col("dispatch").isNotNull(), "UNRESOLVED_INDIRECT_CALL").alias("secondary"), "dispatch")


def resolve(g: Cpg, kb: KnowledgeBase, policy: Policy = Policy(), cascade: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Evidence, ranked candidates and one resolution for each document and action."""
    registrars = registrar_calls(g, kb, policy.registrar_depth)
    all_ = reduce(DataFrame.unionByName, [by_string(g, kb), by_case(g, kb), by_method_name(g, kb), by_registration(g, kb), by_registrar(registrars)])
    evidence = checkpointed(calculus.dedupe(all_.withColumn("slot", F.concat_ws("|", "doc", "action")).withColumn("site", F.coalesce("site", F.lit("")))))
    candidates = checkpointed(calculus.cascade(evidence) if cascade else calculus.corroborate(evidence, policy))
    chosen = calculus.select(candidates, Policy(min_confidence=-1.0, ambiguity_margin=-1.0) if cascade else policy)
    out = diagnose(g, kb, registrars).withColumn("slot", F.concat_ws("|", "doc", "action")).join(chosen, "slot", "left")
    out = out.select("slot", "doc", "action", F.coalesce("status", F.lit("UNRESOLVED")).alias("status"), F.when(F.col("status").isNull(), F.col("diagnosis")).otherwise(F.col("reason")).alias("reason"), F.when(F.col("status").isNull(), F.col("secondary")).alias("secondary"), "dispatch", "chosen", "top", "runner_up", "margin", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))
    return evidence, candidates, checkpointed(out)


