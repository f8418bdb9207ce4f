"""The evidence pipeline over code property graphs: handlers, source binding, flow, sinks, checks and
packages. It emits candidates with the evidence for them, no verdicts. All documents, actions and
fields run at once; loops are graph frontiers only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.functions.knowledge import KnowledgeBase
from graphlens.functions.text import strip_quotes
from graphlens.operators import graph, handlers, rules, traverse
from graphlens.operators.calculus import Policy
from graphlens.operators.cpg import FIELD_ACCESS, Cpg
from graphlens.session import rounds
from graphlens.session import settled as checkpointed

BUILDERS = ("sprintf", "snprintf", "strcpy", "strcat", "strncpy")


def bind_sources(g: Cpg, kb: KnowledgeBase, resolutions: DataFrame) -> DataFrame:
    """run, doc, action, field, access, target, variable, ...: for each resolved action and field the
    first access to it, in the handler's method first: a field access by one of its names, or a call
    with one as a literal. ``run`` names the pair of resolution and field."""
    done = resolutions.where("status = 'RESOLVED'").select("slot", "doc", "action", "chosen")
    want = kb.fields.select("action", "field", "semantic", "checks", "cwes", "domains", F.explode(F.array_distinct(F.transform(F.concat("aliases", F.array("field")), lambda a: F.lower(a)))).alias("alias"))
    names = g.args.select("call", F.when(F.col("arg_label") == "FIELD_IDENTIFIER", F.coalesce(F.nullif("arg_field", F.lit("")), F.col("arg_code"))).alias("f"), F.when(F.col("arg_label") == "LITERAL", strip_quotes("arg_code")).alias("l"))
    calls = g.calls.join(g.methods.select(F.col("method").alias("owner"), "method_ord"), "owner")
    used = calls.join(names, "call").select("doc", "call", "code", "line", "owner", "method_ord", "ord", F.lower(F.when(F.col("name").isin(*FIELD_ACCESS), F.col("f")).otherwise(F.col("l"))).alias("alias"))
    rows = done.join(F.broadcast(want), "action").join(used, ["doc", "alias"])
    rank = F.struct((F.col("owner") != F.col("chosen")).alias("away"), "method_ord", "ord", "call")
    first = rows.groupBy("slot", "doc", "action", "field", "semantic", "checks", "cwes", "domains", "chosen").agg(F.min_by(F.struct("call", "code", "line", "owner"), rank).alias("a"))
    first = first.select(F.concat_ws("|", "slot", "field").alias("run"), "slot", "doc", "action", "field", "semantic", "checks", "cwes", "domains", "chosen", F.col("a.call").alias("access"), F.col("a.code").alias("source"), F.col("a.line").alias("line"), F.col("a.owner").alias("method"))
    at = g.assigned.select(F.col("arg").alias("access"), "target", "target_name", "assign")
    return checkpointed(first.join(at, "access", "left").withColumn("variable", F.coalesce("target_name", "source")).drop("target_name"))


def returned(g: Cpg, levels: int = 6) -> DataFrame:
    """node: expressions with a RETURN among their first ancestors."""
    up = g.below.where(F.col("depth").between(1, levels)).join(g.ids("top", where=F.col("label") == "RETURN"), "top", "left_semi")
    return up.select("node").distinct()


def sink_uses(g: Cpg, kb: KnowledgeBase) -> DataFrame:
    """call, arg, api, domain, cwe, severity: arguments of calls that the knowledge base calls sinks."""
    apis = F.broadcast(kb.apis.groupBy(F.lower("api").alias("api")).agg(F.max_by(F.struct("domain", "cwe", "severity"), "ord").alias("p")).select("api", "p.*"))
    calls = g.calls.select("call", F.lower("name").alias("api"), F.col("ord").alias("call_ord"), F.col("line").alias("sink_line"), F.col("owner").alias("sink_method")).join(apis, "api")
    return checkpointed(calls.join(g.args.select("call", "arg", "idx"), "call"))


def flow_edges(g: Cpg, kb: KnowledgeBase) -> DataFrame:
    """src, dst, kind, rank, ord: argument to parameter, return to caller, definition to use."""
    sinks = sink_uses(g, kb).select("call").distinct()
    inner = g.calls.where("internal").select("call", "target", "name").join(sinks, "call", "left_anti")
    bridge = g.args.select("call", "idx", F.col("arg").alias("src")).join(inner, "call").join(g.params.select(F.col("method").alias("target"), "idx", F.col("param").alias("dst")), ["target", "idx"])
    bridge = bridge.join(g.methods.select(F.col("method").alias("target"), "method_name"), "target").select("src", "dst", F.concat(F.lit("argument_pass → "), "method_name").alias("kind"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("ord"))
    back = returned(g).select(F.col("node").alias("src")).join(g.method_of.select(F.col("id").alias("src"), "owner"), "src")
    sites = g.calls.select(F.col("target").alias("owner"), "call", F.col("ord").alias("ord")).join(g.assigned.select(F.col("arg").alias("call"), F.col("target").alias("into")), "call", "left")
    back = back.join(sites, "owner").join(g.ids("owner", "name"), "owner").select("src", F.coalesce("into", "call").alias("dst"), F.concat(F.lit("return_value ← "), "owner_name").alias("kind"), F.lit(1).alias("rank"), "ord")
    reach = g.edges.where("label = 'REACHING_DEF'").select("src", "dst", F.lit("propagate").alias("kind"), F.lit(2).alias("rank"), "ord")
    return checkpointed(reduce(DataFrame.unionByName, [bridge, back, reach]))


@dataclass
class Result:
    """The record lists of a run."""

    evidence: DataFrame
    candidates: DataFrame
    resolutions: DataFrame
    bindings: DataFrame
    visits: DataFrame
    sinks: DataFrame
    steps: DataFrame
    observed: DataFrame
    matching: DataFrame
    packages: DataFrame
    limitations: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {k: v for k, v in vars(self).items() if isinstance(v, DataFrame)}


def _tracked(g: Cpg, visits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(run, name) and (run, decl) of the variables a flow went through."""
    n = visits.join(g.ids("node", "label", "name", where=F.col("label").isin("IDENTIFIER", "METHOD_PARAMETER_IN", "LOCAL")), "node")
    names = n.where((F.col("node_name") != "") & ~F.upper("node_name").isin("NULL", "NULLPTR")).select("run", F.col("node_name").alias("name")).distinct()
    ref = graph.first_out(g.edges, "REF").select(F.col("id").alias("node"), F.col("target").alias("ref"))
    decls = n.join(ref, "node", "left").select("run", F.when(F.col("node_label") == "IDENTIFIER", F.col("ref")).otherwise(F.col("node")).alias("decl")).where(F.col("decl").isNotNull()).distinct()
    return checkpointed(names), checkpointed(decls)


def _references(g: Cpg, tops: DataFrame, names: DataFrame, decls: DataFrame) -> DataFrame:
    """run, top: subtrees that mention a tracked variable, by name or by declaration."""
    idents = g.below.join(tops.select("top").distinct(), "top", "left_semi").join(g.ids("node", "name", where=F.col("label") == "IDENTIFIER"), "node").select("top", "node", F.col("node_name").alias("name"))
    ref = graph.first_out(g.edges, "REF").select(F.col("id").alias("node"), F.col("target").alias("decl"))
    return idents.join(names, "name").select("run", "top").unionByName(idents.join(ref, "node").join(decls, "decl").select("run", "top")).distinct()


def observed_checks(g: Cpg, kb: KnowledgeBase, visits: DataFrame, sinks: DataFrame) -> DataFrame:
    """run, sink, check_type, strength, expected, method, line, confidence: conditions on tracked
    variables and calls of check functions, in the methods that a flow went through; one for each
    check type and method of a sink, the first."""
    names, decls = _tracked(g, visits)
    own = visits.join(g.method_of.withColumnRenamed("id", "node"), "node").join(g.methods.select(F.col("method").alias("owner"), "method_ord"), "owner")
    path = own.select("run", F.col("owner").alias("method"), "method_ord").distinct()
    # Where the flow leaves a method towards the sink: the last bridging call, else the sink itself.
    bridges = own.join(g.args.select("call", F.col("arg").alias("node")), "node").join(g.calls.where("internal").select("call"), "call").groupBy("run", F.col("owner").alias("method")).agg(F.max_by("call", F.struct("depth", "call")).alias("bridge"))
    at = sinks.select("run", F.col("call").alias("sink"), "sink_method").distinct()
    leave = path.join(at, "run").join(bridges, ["run", "method"], "left").withColumn("leaves", F.coalesce("bridge", F.when(F.col("sink_method") == F.col("method"), F.col("sink"))))
    leave = checkpointed(leave.select("run", "sink", "method", "method_ord", "leaves"))

    conds = g.conditions.where(F.col("cond").isNotNull()).select("cs", "cond", F.col("owner").alias("method"), "cs_line", "cs_ord")
    conds = checkpointed(conds.join(path.select("method").distinct(), "method", "left_semi"))
    seen = _references(g, conds.select(F.col("cond").alias("top")), names, decls).withColumnRenamed("top", "cond")
    parts = conds.select("cond").distinct().join(g.below.select(F.col("top").alias("cond"), "node"), "cond").join(g.ids("node", "label", "name", "code"), "node")
    is_op = F.col("node_name").startswith("<operator>")
    pick = lambda cond, value: F.collect_set(F.when(cond, value))
    shape = parts.groupBy("cond").agg(
        pick((F.col("node_label") == "CALL") & ~is_op, F.lower("node_name")).alias("calls"), pick((F.col("node_label") == "CALL") & is_op, F.col("node_name")).alias("operators"),
        pick(F.col("node_label") == "IDENTIFIER", F.col("node_name")).alias("identifiers"), pick(F.col("node_label") == "LITERAL", F.lower(strip_quotes("node_code"))).alias("literals"),
    )
    kinds = rules.classify_conditions(shape, kb.patterns)
    rows = conds.join(seen, "cond").join(kinds, "cond").join(leave, ["run", "method"])
    tests = checkpointed(rows)
    pairs = tests.where(F.col("leaves").isNotNull()).select(F.explode(F.array("cond", "cs")).alias("a"), F.col("leaves").alias("b")).distinct()
    dom = graph.dominates(g.edges, pairs, "DOMINATE").where("dominated").select(F.col("a"), F.col("b").alias("leaves"))
    hit = lambda c, n: dom.select(F.col("a").alias(c), "leaves", F.lit(True).alias(n))
    tree = g.edges.where("label = 'DOMINATE'").select(F.col("dst").alias("leaves"), F.lit(True).alias("in_tree")).distinct()
    tests = tests.join(hit("cond", "d1"), ["cond", "leaves"], "left").join(hit("cs", "d2"), ["cs", "leaves"], "left").join(tree, "leaves", "left").join(g.ids("leaves", "line"), "leaves", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    before = F.when(F.col("leaves").isNull(), True).otherwise(rules.ordered_before(yes("d1") | yes("d2"), yes("in_tree"), F.col("cs_line"), F.col("leaves_line")))
    one = tests.select("run", "sink", "method", "method_ord", "check_type", F.when(before, F.col("strength")).otherwise("PARTIAL").alias("strength"), "expected", F.col("cs_line").alias("line"), F.lit(0).alias("pass"), F.col("cs_ord").alias("ord"))

    by_call = F.broadcast(kb.patterns.select("priority", "check_type", "strength", "expected", F.explode("call_names").alias("api")).groupBy("api").agg(F.min_by(F.struct("check_type", "strength", "expected"), "priority").alias("p")).select("api", "p.*"))
    calls = g.calls.where(~F.col("name").startswith("<operator>")).select("call", F.lower("name").alias("api"), F.col("owner").alias("method"), "line", "ord").join(by_call, "api").join(path.select("method").distinct(), "method", "left_semi")
    tops = calls.select("call").join(g.args.select("call", F.col("arg").alias("top")), "call")
    about = _references(g, tops, names, decls).join(tops, "top").select("run", "call").distinct()
    two = calls.join(about, "call").join(leave, ["run", "method"]).select("run", "sink", "method", "method_ord", "check_type", "strength", "expected", "line", F.lit(1).alias("pass"), "ord")
    first = Window.partitionBy("run", "sink", "method", "check_type").orderBy("pass", "ord")
    out = one.unionByName(two).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    confidence = F.when((F.col("check_type") == "NULL_CHECK") & (F.col("pass") == 0), 0.95).otherwise(0.85)
    return checkpointed(out.withColumn("confidence", confidence))


def operation(kind: Column, label: Column, name: Column) -> Column:
    """How a step of a flow is told; null for one that is left out."""
    return F.when(kind == "", "source_binding").when(kind.startswith("argument_pass") | kind.startswith("return_value"), kind).when((label == "CALL") & F.lower(name).isin(*BUILDERS), F.concat(F.lit("string_build:"), name))


def flow_steps(g: Cpg, visits: DataFrame, sinks: DataFrame, max_depth: int | None = None) -> DataFrame:
    """run, call, step, function, line, operation: the way from the source to each sink, told once
    for a place, with the sink last."""
    links = checkpointed(visits.select("run", "node", "parent", "depth", "kind"))
    at = sinks.select("run", "call", F.col("arg").alias("node")).join(links, ["run", "node"]).select("run", "call", "node", "parent", "depth", "kind")
    out = at = checkpointed(at)
    for depth in rounds(max_depth):
        at = at.where(F.col("parent").isNotNull()).select("run", "call", F.col("parent").alias("node")).join(links, ["run", "node"]).select("run", "call", "node", "parent", "depth", "kind")
        at = checkpointed(at)
        if at.isEmpty():
            break
        out = out.unionByName(at)
        if depth % 16 == 0:
            out = checkpointed(out)
    where = lambda df, c: df.join(g.ids(c, "label", "name", "line"), c).join(g.method_of.select(F.col("id").alias(c), "owner"), c, "left").join(g.ids("owner", "name"), "owner", "left")
    told = where(out, "node").select("run", "call", F.col("depth").alias("pos"), F.coalesce("owner_name", F.lit("")).alias("function"), F.col("node_line").alias("line"), operation(F.col("kind"), F.col("node_label"), F.col("node_name")).alias("operation")).where(F.col("operation").isNotNull())
    last = where(sinks.select("run", "call").distinct().withColumn("node", F.col("call")), "node").select("run", "call", F.lit(1 << 30).alias("pos"), F.coalesce("owner_name", F.lit("")).alias("function"), F.col("node_line").alias("line"), F.concat(F.lit("sink:"), "node_name").alias("operation"))
    steps = told.unionByName(last).withColumn("key", F.concat_ws("|", "run", "call"))
    return traverse.collapse_steps(steps, "key", "pos", "function", "line", "operation").drop("pos", "key")


def analyze(nodes: DataFrame, edges: DataFrame, kb: KnowledgeBase, policy: Policy = Policy(), max_depth: int | None = None, cascade: bool = False) -> Result:
    """All steps over all documents."""
    g = Cpg(nodes, edges)
    evidence, candidates, resolutions = handlers.resolve(g, kb, policy, cascade)
    bindings = bind_sources(g, kb, resolutions)
    seeds = bindings.select("run", F.explode(F.array_compact(F.array(F.struct(F.lit(0).cast("long").alias("ord"), F.col("access").alias("id")), F.when(F.col("target").isNotNull(), F.struct(F.lit(1).cast("long").alias("ord"), F.col("target").alias("id")))))).alias("s")).select("run", "s.*")
    visits = checkpointed(traverse.bfs(flow_edges(g, kb), seeds, max_depth, by="run"))
    uses = sink_uses(g, kb)
    reached = visits.join(uses.withColumnRenamed("arg", "node"), "node").withColumnRenamed("node", "arg")
    # One argument for each sink call, found first; sinks of the field's own domains if there are any.
    once = reached.groupBy("run", "call", "api", "domain", "cwe", "severity", "sink_line", "sink_method", "call_ord").agg(F.min_by(F.struct("arg", F.col("depth").alias("d")), F.struct("depth", "idx")).alias("m"))
    once = once.select("*", "m.arg", "m.d").drop("m")
    want = bindings.select("run", "domains")
    sinks = checkpointed(rules.prefer(once.join(want, "run"), "run", F.array_contains("domains", F.col("domain"))).drop("domains", "_p"))
    steps = checkpointed(flow_steps(g, visits, sinks, max_depth))
    observed = observed_checks(g, kb, visits, sinks)

    slot = F.concat_ws("|", "run", "call").alias("slot")
    expected = sinks.select("run", "call").join(bindings.select("run", "checks"), "run").select(slot, F.explode("checks").alias("check"))
    seen = observed.where(F.col("expected").isNotNull()).select(F.concat_ws("|", "run", "sink").alias("slot"), F.col("expected").alias("check"), "strength", F.lit(True).alias("before_sink"))
    disproof = kb.checks.select("check", F.explode("negative_domains").alias("negative_domain"))
    all_sinks = sinks.select("run", "call").join(once.select("run", "domain", F.col("call_ord").alias("ord")), "run").select(slot, "domain", "ord")
    negative = rules.negative_evidence(all_sinks, disproof)
    matching = checkpointed(rules.match_checks(expected, seen, negative))

    missing = matching.groupBy("slot").agg(F.array_sort(F.collect_list(F.when(F.col("status").isin("UNVERIFIED", "WEAKLY_RELATED", "NEGATIVE_EVIDENCE_FOUND"), F.col("check")))).alias("missing"), F.count_if(F.col("status") == "SATISFIED").alias("n_satisfied"))
    passes = steps.groupBy("run", "call").agg(F.max(F.col("operation").startswith("argument_pass")).alias("passes"), F.array_sort(F.collect_set("function")).alias("functions"), F.count("*").alias("n_steps"))
    some = observed.select("run", F.col("sink").alias("call"), F.lit(True).alias("some")).distinct()
    weight = evidence.groupBy("slot", "callback").agg(F.max("weight").alias("handler")).select(F.col("slot").alias("h_slot"), F.col("callback").alias("chosen"), "handler")
    pk = sinks.join(bindings.select("run", F.col("slot").alias("h_slot"), "doc", "action", "field", "semantic", "cwes", "chosen", "variable", "source"), "run").withColumn("slot", F.concat_ws("|", "run", "call"))
    pk = pk.join(missing, "slot", "left").join(passes, ["run", "call"], "left").join(some, ["run", "call"], "left").join(weight, ["h_slot", "chosen"], "left")
    parts = {
        "handler": F.col("handler"), "field": F.lit(0.85), "semantic": F.when(F.col("semantic") != "", 1.0).otherwise(0.5), "flow": F.when(F.col("passes"), 0.8).otherwise(0.95),
        "sink": F.when(F.col("domain") != rules.UNKNOWN_SINK, 1.0).otherwise(0.4), "checks": F.when(F.col("some"), 0.75).otherwise(0.6), "trace": F.lit(1.0),
    }
    pk = pk.select("slot", "run", "doc", "action", "field", "variable", "source", "api", "domain", "severity", F.array_sort(F.array_union("cwes", F.split("cwe", " "))).alias("cwes"), "missing", "n_satisfied", "functions", "n_steps", rules.package_confidence(**parts).alias("confidence"), "call_ord")
    packages = rules.prefixed_ids(rules.root_causes(pk, kb.causes), "PKG", "doc", "action", "field", "call_ord")
    return Result(evidence, candidates, resolutions, bindings, visits, sinks, steps, observed, matching, checkpointed(packages), limitations(kb, resolutions, bindings, sinks))


def limitations(kb: KnowledgeBase, resolutions: DataFrame, bindings: DataFrame, sinks: DataFrame) -> DataFrame:
    """doc, action, field, limitation: where a run ended before a package, and why."""
    none = F.lit(None).cast("string")
    open_ = resolutions.where("status <> 'RESOLVED'").select("doc", "action", none.alias("field"), F.when(F.col("status") == "AMBIGUOUS", "competing handler candidates").otherwise(F.concat(F.lit("handler not resolved: "), F.col("reason"))).alias("limitation"))
    want = resolutions.where("status = 'RESOLVED'").join(F.broadcast(kb.fields.select("action", "field")), "action").select("doc", "action", "field")
    unbound = want.join(bindings.select("doc", "action", "field"), ["doc", "action", "field"], "left_anti").withColumn("limitation", F.lit("field access not found"))
    dry = bindings.join(sinks.select("run"), "run", "left_anti").select("doc", "action", "field", F.lit("no sink reached").alias("limitation"))
    return reduce(DataFrame.unionByName, [open_, unbound, dry])
