"""Matching against the knowledge base: sinks, checks, root causes, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.operators.calculus import lookup

# Fixed values.
STRENGTH_RANK = {"CONFLICTED": 0, "UNKNOWN": 1, "WEAK": 2, "PARTIAL": 3, "STRONG": 4}
CONFIDENCE_WEIGHTS = {"handler": 0.15, "field": 0.20, "semantic": 0.15, "flow": 0.25, "sink": 0.10, "checks": 0.10, "trace": 0.05}
UNKNOWN_SINK = "UNKNOWN_SINK"


def map_sinks(calls: DataFrame, apis: DataFrame, name: str = "name") -> DataFrame:
    """Adds domain, cwe and severity of a call by its lower-cased name; of several profiles of an api
    the last holds. ``apis``: api, domain, cwe, severity, ord."""
    last = apis.groupBy(F.lower("api").alias("_api")).agg(F.max_by(F.struct("domain", "cwe", "severity"), "ord").alias("_p"))
    rows = calls.join(F.broadcast(last), F.lower(name) == F.col("_api"), "left")
    return rows.withColumn("domain", F.coalesce("_p.domain", F.lit(UNKNOWN_SINK))).withColumn("cwe", F.col("_p.cwe")).withColumn("severity", F.col("_p.severity")).drop("_api", "_p")


def prefer(rows: DataFrame, key: str, preferred: Column) -> DataFrame:
    """Of each key the preferred rows, or all if none is."""
    some = F.max(preferred.cast("int")).over(Window.partitionBy(key))
    return rows.withColumn("_p", preferred.cast("int")).withColumn("_some", some).where(F.col("_p") == F.col("_some")).drop("_p", "_some")


def first_rule(rows: DataFrame, rules: list[tuple[str, Column]], out: str = "rule", default: str | None = None) -> DataFrame:
    """Adds the name of the first rule that holds."""
    expr = None
    for name, holds in rules:
        expr = F.when(holds, F.lit(name)) if expr is None else expr.when(holds, F.lit(name))
    return rows.withColumn(out, expr.otherwise(F.lit(default)) if expr is not None else F.lit(default))


def classify_conditions(conditions: DataFrame, patterns: DataFrame) -> DataFrame:
    """Conditions (cond, calls, operators, identifiers, literals: arrays) -> cond, check_type, strength,
    expected: the first pattern by priority whose call names occur, else the first whose operators
    do and whose operand names or literal prefixes, if it has any, do as well."""
    p = F.broadcast(patterns.select("priority", "check_type", "strength", "expected", "call_names", "operators", "operand_identifiers", "literal_prefixes", "standalone"))
    lower = F.transform("calls", lambda c: F.lower(c))
    by_name = F.arrays_overlap(lower, "call_names")
    prefixed = F.exists("literals", lambda x: F.exists("literal_prefixes", lambda q: F.startswith(x, q)))
    confirmed = F.arrays_overlap("identifiers", "operand_identifiers") | prefixed
    free = (F.size("operand_identifiers") == 0) & (F.size("literal_prefixes") == 0)
    by_operator = F.arrays_overlap("condition_ops", "standalone") | (F.arrays_overlap("condition_ops", "operators") & (free | confirmed))
    rows = conditions.withColumnRenamed("operators", "condition_ops").crossJoin(p)
    rank = F.when(F.coalesce(by_name, F.lit(False)), 0).when(F.coalesce(by_operator, F.lit(False)), 1)
    hits = rows.withColumn("_pass", rank).where(F.col("_pass").isNotNull())
    best = hits.groupBy("cond").agg(F.min_by(F.struct("check_type", "strength", "expected"), F.struct("_pass", "priority")).alias("b"))
    return best.select("cond", "b.*")


def strength_rank(strength: Column | str) -> Column:
    return lookup(strength, STRENGTH_RANK, 0)


def match_checks(expected: DataFrame, observed: DataFrame, negative: DataFrame) -> DataFrame:
    """expected (slot, check), observed (slot, check, strength, before_sink), negative (slot, check) ->
    slot, check, status, confidence: negative evidence outranks what is observed, the strongest
    observed check counts, and nothing at all is unverified."""
    top = observed.groupBy("slot", "check").agg(F.max(F.struct(strength_rank("strength").alias("r"), F.col("before_sink").cast("int").alias("b"), "strength")).alias("o"))
    rows = expected.join(top, ["slot", "check"], "left").join(negative.select("slot", "check", F.lit(True).alias("neg")).distinct(), ["slot", "check"], "left")
    strength = F.col("o.strength")
    status = (
        F.when(F.col("neg"), "NEGATIVE_EVIDENCE_FOUND").when(F.col("o").isNull(), "UNVERIFIED").when(strength == "CONFLICTED", "CONFLICTED")
        .when(strength == "STRONG", "SATISFIED").when(strength == "PARTIAL", "PARTIALLY_SATISFIED").when(strength == "WEAK", "WEAKLY_RELATED").otherwise("REVIEW_REQUIRED")
    )
    confidence = F.when(F.col("neg"), 0.94).when(F.col("o").isNull(), 0.75).when(strength == "WEAK", 0.7).otherwise(0.85)
    return rows.select("slot", "check", status.alias("status"), confidence.alias("confidence"), strength.alias("strength"))


def ordered_before(dominated: Column, has_dominator: Column, line_a: Column, line_b: Column) -> Column:
    """Whether a check comes before a departure: by dominance if that is known, else by line."""
    return F.when(dominated, True).when(has_dominator, False).otherwise(F.coalesce(line_a <= line_b, F.lit(False)))


def negative_evidence(reached: DataFrame, checks: DataFrame) -> DataFrame:
    """reached (slot, domain, ord) and checks (check, negative_domain) -> slot, check, domain: one for each check, the first."""
    rows = reached.join(F.broadcast(checks), F.col("domain") == F.col("negative_domain"))
    return rows.groupBy("slot", "check").agg(F.min_by("domain", "ord").alias("domain"))


def root_causes(rows: DataFrame, causes: DataFrame, domain: str = "domain", missing: str = "missing") -> DataFrame:
    """Adds causes: ids of root causes of a domain or of any missing check, in catalog order. The
    catalog (id, ord, domains, checks) is a short table."""
    c = F.broadcast(causes.select("id", "ord", "domains", "checks"))
    key = [x for x in rows.columns]
    # Both ways to match become keys of an equi-join, so the rows are not paired with the catalog.
    wanted = F.array_distinct(F.concat(F.array(F.concat(F.lit("d:"), F.col(domain))), F.transform(missing, lambda m: F.concat(F.lit("c:"), m))))
    offered = c.select("id", "ord", F.explode(F.concat(F.transform("domains", lambda d: F.concat(F.lit("d:"), d)), F.transform("checks", lambda d: F.concat(F.lit("c:"), d)))).alias("_k"))
    # Rows are told apart by their own values; equal ones are counted, and given out again as often as they came.
    each = rows.groupBy(*key).agg(F.count("*").alias("_times"))
    hits = each.select(*key, "_times", F.explode_outer(wanted).alias("_k")).join(F.broadcast(offered), "_k", "left")
    out = hits.groupBy(*key, "_times").agg(F.array_sort(F.collect_set(F.when(F.col("id").isNotNull(), F.struct("ord", "id")))).alias("c"))
    out = out.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
    return out.select(*key, F.transform("c", lambda s: s["id"]).alias("causes"))


def package_confidence(**parts: Column) -> Column:
    """Weighted sum of the seven component scores, to three places."""
    total = None
    for name, weight in CONFIDENCE_WEIGHTS.items():
        term = parts[name] * F.lit(weight)
        total = term if total is None else total + term
    return F.round(total, 3)


def prefixed_ids(rows: DataFrame, prefix: str, run: str, *order: str | Column) -> DataFrame:
    """Adds id: PREFIX-0001 and so on within a run."""
    n = F.row_number().over(Window.partitionBy(run).orderBy(*order))
    return rows.withColumn("id", F.format_string(prefix + "-%04d", n))


# Reason -> tier, category, confidence.
OUTCOMES = {
    "LOW_CONFIDENCE": ("POLICY", "LOW_CONFIDENCE", "HIGH"),
    "EXTERNAL_DEFINITION": ("ANALYSIS_SCOPE", "EXTERNAL_DEFINITION", "HIGH"),
    "UNRESOLVED_INDIRECT_CALL": ("POTENTIALLY_SUPPORTABLE", "INDIRECT_CALL", "MEDIUM"),
    "UNSUPPORTED_REGISTRAR_CALL": ("POTENTIALLY_SUPPORTABLE", "INDIRECT_CALL", "LOW"),
    "REGISTRAR_STORE_NOT_REACHED": ("POTENTIALLY_SUPPORTABLE", "VARIABLE_INDEX_CORRELATION", "LOW"),
    "REGISTRAR_SEARCH_THEN_WRITE": ("POTENTIALLY_SUPPORTABLE", "SEARCH_THEN_WRITE_REGISTRAR", "LOW"),
}


def classify_outcome(rows: DataFrame, status: str = "status", reason: str = "reason", referenced: str = "referenced") -> DataFrame:
    """Adds tier, category and class_confidence to outcomes that are not RESOLVED."""
    why = F.coalesce(F.col(reason), F.lit("NO_EVIDENCE"))
    none = F.struct(F.lit("UNKNOWN").alias("tier"), F.lit(None).cast("string").alias("category"), F.lit("LOW").alias("class_confidence"))
    make = lambda t: F.struct(F.lit(t[0]).alias("tier"), F.lit(t[1]).alias("category"), F.lit(t[2]).alias("class_confidence"))
    c = F.when(F.col(status) == "AMBIGUOUS", make(("POLICY", "COMPETING_CANDIDATES", "HIGH"))).when(F.col(status) != "UNRESOLVED", F.lit(None))
    for name, t in OUTCOMES.items():
        c = c.when(why == name, make(t))
    c = c.when((why == "NO_EVIDENCE") & F.col(referenced), make(("ANALYSIS_SCOPE", "CROSS_TU_REGISTRATION", "MEDIUM"))).otherwise(none)
    return rows.withColumn("_c", c).select(*rows.columns, "_c.tier", "_c.category", "_c.class_confidence")
