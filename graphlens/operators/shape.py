"""Result shaping: findings, decisions, snippets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.operators.calculus import lookup

# Fixed values.
STATUS_ORDER = {"RESOLVED": 0, "AMBIGUOUS": 1, "UNRESOLVED": 2}
CONFIDENCE_BUCKETS = ((0.8, "high"), (0.6, "medium"), (0.4, "low"))


def bucket(confidence: Column | str) -> Column:
    c, out = F.col(confidence) if isinstance(confidence, str) else confidence, None
    for at_least, name in CONFIDENCE_BUCKETS:
        out = F.when(c >= at_least, name) if out is None else out.when(c >= at_least, name)
    return out.otherwise("very_low")


def snippets(refs: DataFrame, key: str, line: str, context: int, last: Column | None = None) -> DataFrame:
    """key, first, last, n: references whose gap is at most context + 1 in one range, with some lines
    around, cut at the ends of the file."""
    w = Window.partitionBy(key).orderBy(line)
    fresh = F.coalesce((F.col(line) - F.lag(line).over(w) > context + 1).cast("int"), F.lit(0))
    rows = refs.withColumn("_new", fresh).withColumn("_g", F.sum("_new").over(w))
    out = rows.groupBy(key, "_g").agg(F.min(line).alias("a"), F.max(line).alias("b"), F.count("*").alias("n"))
    end = F.col("b") + context
    return out.select(key, F.greatest(F.col("a") - context, F.lit(1)).alias("first"), (end if last is None else F.least(end, last)).alias("last"), "n")


def findings(packages: DataFrame, checks: DataFrame) -> DataFrame:
    """Packages (pkg) with their checks (pkg, check, status, remedy) as counts and distinct remedies."""
    missing = F.col("status").isin("UNVERIFIED", "NEGATIVE_EVIDENCE_FOUND", "WEAKLY_RELATED")
    per = checks.groupBy("pkg").agg(F.count("*").alias("n_checks"), F.count_if(missing).alias("n_missing"), F.array_sort(F.collect_set(F.when(missing, F.col("remedy")))).alias("remedies"))
    return packages.join(per, "pkg", "left")


def decisions(resolutions: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """The rows to show: packages if there are any, else resolutions by status and action; an
    ambiguous one becomes a row for each candidate (an array column); with nothing at all, one row
    that says so."""
    rank = lookup("status", STATUS_ORDER, 9)
    shown = resolutions.select("action", "status", rank.alias("rank"), F.explode_outer(F.when(F.col("status") == "AMBIGUOUS", F.col("candidates")).otherwise(F.slice("candidates", 1, 1))).alias("candidate"))
    none = resolutions.sparkSession.range(1).select(F.lit(None).cast("string").alias("action"), F.lit("NO_FINDING").alias("status"), F.lit(9).alias("rank"), F.lit(None).cast("string").alias("candidate"))
    empty = none.join(resolutions.limit(1).select(F.lit(1).alias("_any")), F.lit(True), "left_anti")
    out = shown.unionByName(empty)
    if packages is None:
        return out
    own = packages.select("action", F.lit("PACKAGE").alias("status"), F.lit(-1).alias("rank"), F.col("pkg").cast("string").alias("candidate"))
    return own.unionByName(out.join(packages.limit(1).select(F.lit(1).alias("_any")), F.lit(True), "left_anti"))


def traces(evidence: DataFrame) -> DataFrame:
    """slot, callback, notes, sites: what speaks for each candidate, strongest first, and the places it was seen."""
    rows = evidence.groupBy("slot", "callback").agg(F.sort_array(F.collect_list(F.struct("weight", "kind", "match", "site")), False).alias("e"))
    note = lambda e: F.concat_ws(" ", e["kind"], e["match"], F.format_string("%.2f", e["weight"]))
    return rows.select("slot", "callback", F.transform("e", note).alias("notes"), F.array_distinct(F.array_compact(F.transform("e", lambda e: e["site"].cast("string")))).alias("sites"))


# What the kinds of export hold.
EXPORTS = {"fragments": ("resolutions", "bindings", "sinks", "steps", "observed", "matching"), "packages": ("packages",)}


def selection(tables: dict[str, DataFrame], which: str) -> dict[str, DataFrame]:
    """The result tables of an export: fragments, packages, or full."""
    names = tables if which == "full" else EXPORTS[which]
    return {n: tables[n] for n in names if n in tables}


def exported(tables: dict[str, DataFrame], which: str) -> DataFrame:
    """name, row: the rows of an export's tables as JSON texts, side by side."""
    parts = [t.select(F.lit(n).alias("name"), F.to_json(F.struct("*")).alias("row")) for n, t in selection(tables, which).items()]
    if not parts:
        raise ValueError(f"no table of the export {which!r} is there")
    return reduce(DataFrame.unionByName, parts)


def with_roles(steps: DataFrame, key: str, order: list[str], is_sink: Column) -> DataFrame:
    """Adds n, from 1 within a key, and role: the first step is the source, then sinks and plain steps."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return steps.withColumn("n", n).withColumn("role", F.when(F.col("n") == 1, "source").when(is_sink, "sink").otherwise("step"))


def check_rows(expected: DataFrame, observed: DataFrame, missing: DataFrame) -> DataFrame:
    """pkg, place, id, status, observed, evidence: a row for each expected check (pkg, pos, check), with the first missing candidate (pkg, pos,
    check, basis) and the first observed check (pkg, pos, kind, strength, matched, evidence) that match it; then one for each observed
    check that matches none."""
    first = lambda df, check, *c: df.groupBy("pkg", F.col(check).alias("check")).agg(F.min(F.struct("pos", *c)).alias("m")).select("pkg", "check", *[F.col(f"m.{x}").alias(x) for x in c])
    seen = observed.withColumn("observed", F.concat_ws(" ", "kind", "strength"))
    rows = expected.join(first(missing, "check", "basis"), ["pkg", "check"], "left").join(first(seen.where(F.col("matched").isNotNull()), "matched", "observed", "evidence"), ["pkg", "check"], "left")
    status = F.when(F.col("basis") == "NEGATIVE_EVIDENCE_FOUND", "NEGATIVE").otherwise(F.coalesce("basis", F.lit("SATISFIED")))
    rows = rows.select("pkg", F.struct(F.lit(0).alias("part"), F.col("pos").cast("long").alias("pos")).alias("place"), F.col("check").alias("id"), status.alias("status"), "observed", "evidence")
    other = seen.where(F.col("matched").isNull()).select("pkg", F.struct(F.lit(1).alias("part"), F.col("pos").cast("long").alias("pos")).alias("place"), F.col("kind").alias("id"), F.when(F.col("strength") == "STRONG", "SATISFIED").otherwise("WEAKLY_RELATED").alias("status"), "observed", "evidence")
    return rows.unionByName(other)


def finding_details(packages: DataFrame, steps: DataFrame, checks: DataFrame, missing: DataFrame, remedies: DataFrame) -> DataFrame:
    """Packages (pkg, action, field, semantic, api, domain, confidence) with their trace (steps: pkg, n, role, function, line, operation), checks
    (see ``check_rows``), distinct remedies in the order of the missing checks (check, remedy), the confidence's bucket, and a summary."""
    inner = lambda df, name, *c: df.groupBy("pkg").agg(F.array_sort(F.collect_list(F.struct(*c))).alias(name))
    trace = inner(steps, "trace", "n", "role", "function", "line", "operation")
    told = inner(checks, "checks", "place", "id", "status", "observed", "evidence")
    told = told.select("pkg", F.transform("checks", lambda c: c.dropFields("place")).alias("checks"))
    what = missing.join(remedies, "check", "left").withColumn("remedy", F.coalesce("remedy", F.concat(F.lit("add the check "), "check")))
    what = what.groupBy("pkg").agg(F.array_sort(F.collect_list(F.struct("pos", "remedy"))).alias("m")).select("pkg", F.array_distinct(F.transform("m", lambda r: r["remedy"])).alias("remedies"))
    out = packages.join(trace, "pkg", "left").join(told, "pkg", "left").join(what, "pkg", "left")
    crossed = F.size(F.array_distinct(F.transform("trace", lambda s: s["function"])))
    through = F.when(crossed > 1, F.concat(F.lit("through "), crossed.cast("string"), F.lit(" functions "))).otherwise("")
    summary = F.concat(F.lit("field "), "field", F.lit(" of "), "action", F.lit(" ("), "semantic", F.lit(") comes from outside and reaches "), through, "api", F.lit(" ("), "domain", F.lit(") without enough checks"))
    last = F.try_element_at(F.filter("trace", lambda s: s["role"] == "sink"), F.lit(-1))
    return out.withColumn("confidence_label", bucket("confidence")).withColumn("location", F.when(F.size("trace") > 0, last["line"])).withColumn("summary", summary)


# Status -> how it is shown and what it says.
STATUS_SHOWN = {"RESOLVED": ("info", "handler found"), "AMBIGUOUS": ("warn", "several candidates"), "UNRESOLVED": ("none", "no handler settled")}


def resolution_decisions(resolutions: DataFrame, records: DataFrame) -> DataFrame:
    """Resolutions (slot, action, status, reason, chosen, top) with tone, title, label and the trace of the callback chosen: its evidence records
    (slot, callback, pos, step, code, line) in order, the first as source, references to the handler as sinks."""
    rows = with_roles(records.withColumn("_key", F.struct("slot", "callback")), "_key", ["pos"], F.col("step") == "HANDLER_REF")
    trace = rows.groupBy("slot", "callback").agg(F.array_sort(F.collect_list(F.struct("n", "role", "step", "code", "line"))).alias("trace"))
    shown = lambda i: F.coalesce(*[F.when(F.col("status") == s, v[i]) for s, v in STATUS_SHOWN.items()])
    out = resolutions.join(trace.withColumnRenamed("callback", "chosen"), ["slot", "chosen"], "left")
    return out.select(*resolutions.columns, shown(0).alias("tone"), shown(1).alias("title"), bucket(F.coalesce("top", F.lit(0.0))).alias("label"), "trace")


def status_counts(resolutions: DataFrame) -> DataFrame:
    return resolutions.agg(*[F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in STATUS_ORDER])


def report_rows(expected: DataFrame, missing: DataFrame) -> DataFrame:
    """Expected checks (check) with what the map of missing ones (check, reason) says."""
    return expected.join(missing, "check", "left").withColumn("is_missing", F.col("reason").isNotNull())
