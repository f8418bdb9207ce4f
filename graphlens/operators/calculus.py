"""The evidence calculus: deduplication, scoring, combination and selection of candidates.

Evidence rows have a ``slot`` (what is to be resolved), a ``callback`` (the candidate), kind,
weight, match (strength), a provenance group and, for deduplication, site, nodes and extractor.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphlens.session import parts_for

# Fixed values.
KIND_WEIGHT = {"STRING_DISPATCH": 0.90, "ENUM_CASE": 0.85, "REGISTRATION_INIT": 0.80, "REGISTRATION_ASSIGN": 0.80, "REGISTRAR_CALL": 0.70, "NAME_MATCH": 0.70, "DISPATCH_SITE": 0.00}
KIND_RANK = {"STRING_DISPATCH": 5, "ENUM_CASE": 4, "REGISTRATION_INIT": 3, "REGISTRATION_ASSIGN": 3, "REGISTRAR_CALL": 2, "NAME_MATCH": 1, "DISPATCH_SITE": 0}
MATCH_RANK = {"EXACT_IDENTIFIER": 4, "RESOLVED_VALUE": 3, "NORMALIZED_NAME": 2, "HEURISTIC_SUBSTRING": 1, "NONE": 0}
MATCH_MULTIPLIER = {"EXACT_IDENTIFIER": 1.00, "RESOLVED_VALUE": 0.95, "NORMALIZED_NAME": 0.85, "HEURISTIC_SUBSTRING": 0.70, "NONE": 0.00}
STRONG_MATCHES = ("EXACT_IDENTIFIER", "RESOLVED_VALUE")


# Fixed values, as the defaults.
@dataclass(frozen=True)
class Policy:
    """Bounds of the calculus: the most that weak evidence alone, and any evidence, can say; the least confidence and the
    least lead of a resolved candidate; what conflicting evidence keeps; how many calls a registrar is followed."""

    weak_only_cap: float = 0.85
    global_cap: float = 0.99
    min_confidence: float = 0.50
    ambiguity_margin: float = 0.15
    conflict_multiplier_cap: float = 0.70
    conflict_scale: float = 0.5
    registrar_depth: int = 2


def lookup(key: Column | str, table: dict, default=None) -> Column:
    """A constant table as a column expression."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.create_map(*pairs)[key if isinstance(key, Column) else F.col(key)]
    return found if default is None else F.coalesce(found, F.lit(default))


def dedupe(evidence: DataFrame) -> DataFrame:
    """One row of each (slot, kind, callback, site or -1, sorted nodes): the strongest match, then
    the highest weight, then the smallest extractor."""
    key = ["slot", "kind", "callback", "_site", "_nodes"]
    rows = evidence.withColumn("_site", F.coalesce(F.col("site").cast("string"), F.lit("-1"))).withColumn("_nodes", F.array_sort("nodes"))
    order = Window.partitionBy(*key).orderBy(lookup("match", MATCH_RANK, -1).desc(), F.desc("weight"), "extractor")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_site", "_nodes")


def consistency(numeric_id: Column, resolved: Column, implied: Column) -> Column:
    """CONFLICTING if two different numbers are seen, or if two or more sets of implied actions have
    nothing in common; CONSISTENT if they do; PARTIAL if fewer than two say anything."""
    sets = F.filter(implied, lambda s: s.isNotNull() & (F.size(s) > 0))
    common = F.aggregate(sets, sets[0], lambda acc, s: F.array_intersect(acc, s))
    numbers = numeric_id.isNotNull() & resolved.isNotNull() & (numeric_id != resolved)
    return F.when(numbers, F.lit("CONFLICTING")).when(F.size(sets) < 2, F.lit("PARTIAL")).when(F.size(common) > 0, F.lit("CONSISTENT")).otherwise(F.lit("CONFLICTING"))


def score(evidence: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Adds score_pre_penalty (weight x match multiplier) and score (scaled down if conflicting)."""
    m = lookup("match", MATCH_MULTIPLIER, 0.0)
    pre = F.round(F.col("weight") * m, 6)
    bad = F.coalesce(F.col("conflicting"), F.lit(False)) if "conflicting" in evidence.columns else F.lit(False)
    cut = F.round(F.col("weight") * F.least(m, F.lit(policy.conflict_multiplier_cap)) * policy.conflict_scale, 6)
    return evidence.withColumn("score_pre_penalty", pre).withColumn("score", F.when(bad, cut).otherwise(pre))


def group_max(scored: DataFrame, parts: int | None = None) -> DataFrame:
    """slot, callback, group score: the best of each provenance group; a row without a group stands alone. Such rows are
    told apart by their own values and their place among equal ones, so that a task that runs again agrees. Rows with a group
    are dealt out by their number before they are summed up (or over ``parts``), as a task holds all its groups and most have few rows."""
    best = [F.max("score").alias("g"), F.max(F.col("match").isin(*STRONG_MATCHES)).alias("strong")]
    slim = scored.where(F.col("group").isNotNull()).select("slot", "callback", "group", "score", "match")
    grouped = slim.repartition(parts or parts_for(slim), "slot", "callback").groupBy("slot", "callback", "group").agg(*best)
    plain = [F.col(f"`{f.name}`") for f in scored.schema.fields if not isinstance(f.dataType, T.MapType | T.VariantType)]
    place = F.row_number().over(Window.partitionBy("slot", "callback", "_own").orderBy("score"))
    alone = scored.where(F.col("group").isNull()).withColumn("_own", F.xxhash64(*plain)).withColumn("_place", place)
    alone = alone.groupBy("slot", "callback", "group", "_own", "_place").agg(*best)
    return grouped.unionByName(alone.select(*grouped.columns))


def noisy_or(groups: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """slot, callback, confidence: 1 - product(1 - g), capped."""
    raw = groups.groupBy("slot", "callback").agg((1 - F.product(1 - F.col("g"))).alias("raw"), F.max("strong").alias("strong"))
    conf = F.least("raw", F.lit(policy.global_cap))
    conf = F.when(F.col("strong"), conf).otherwise(F.least(conf, F.lit(policy.weak_only_cap)))
    return raw.select("slot", "callback", F.round(conf, 6).alias("confidence"))


def best_evidence(evidence: DataFrame) -> DataFrame:
    """slot, callback, best_kind, best_weight: the evidence of the highest weight, then kind rank."""
    top = F.max(F.struct("weight", lookup("kind", KIND_RANK, 0).alias("rank"), "kind")).alias("b")
    return evidence.groupBy("slot", "callback").agg(top).select("slot", "callback", F.col("b.kind").alias("best_kind"), F.col("b.weight").alias("best_weight"), F.col("b.rank").alias("best_rank"))


def ranked(candidates: DataFrame) -> DataFrame:
    """Adds rank within the slot: confidence, then kind rank, then the smaller callback."""
    order = Window.partitionBy("slot").orderBy(F.desc("confidence"), F.desc("best_rank"), "callback")
    return candidates.withColumn("rank", F.row_number().over(order))


def corroborate(evidence: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Candidates by noisy-or over provenance groups, ranked."""
    parts = parts_for(evidence)
    conf = noisy_or(group_max(score(evidence, policy), parts), policy)
    best = best_evidence(evidence.select("slot", "callback", "kind", "weight").repartition(parts, "slot", "callback"))
    return ranked(conf.join(best, ["slot", "callback"]).repartition(parts, "slot"))


def cascade(evidence: DataFrame) -> DataFrame:
    """Candidates by their highest weight, ranked."""
    conf = evidence.groupBy("slot", "callback").agg(F.max("weight").alias("confidence"))
    return ranked(conf.join(best_evidence(evidence), ["slot", "callback"]))


def select(candidates: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """slot, status, reason, chosen, top, runner_up, margin, n_candidates."""
    w = Window.partitionBy("slot").orderBy("rank")
    rows = candidates.withColumn("runner_up", F.lead("confidence").over(w)).withColumn("n_candidates", F.count("*").over(Window.partitionBy("slot"))).where("rank = 1")
    margin = F.round(F.col("confidence") - F.col("runner_up"), 6)
    low = F.col("confidence") < policy.min_confidence
    close = F.col("runner_up").isNotNull() & (F.col("confidence") - F.col("runner_up") < policy.ambiguity_margin)
    status = F.when(low, "UNRESOLVED").when(close, "AMBIGUOUS").otherwise("RESOLVED")
    return rows.select("slot", status.alias("status"), F.when(low, "LOW_CONFIDENCE").alias("reason"), F.when(~low & ~close, F.col("callback")).alias("chosen"), F.col("confidence").alias("top"), "runner_up", margin.alias("margin"), "n_candidates")


def conflicts(candidates: DataFrame, top: int = 3) -> DataFrame:
    """slot, competing (the first three candidates) and margin, where there are several."""
    rows = candidates.where(F.col("rank") <= top).groupBy("slot").agg(F.array_sort(F.collect_list(F.struct("rank", "callback", "confidence"))).alias("c"))
    rows = rows.where(F.size("c") > 1)
    return rows.select("slot", F.transform("c", lambda x: F.struct(x["callback"].alias("callback"), x["confidence"].alias("confidence"))).alias("competing"), F.round(F.col("c")[0]["confidence"] - F.col("c")[1]["confidence"], 6).alias("margin"))


def handler_map(evidence: DataFrame, resolutions: DataFrame) -> DataFrame:
    """slot, callback, kind, weight of each resolved slot: the chosen callback with its best evidence, by weight and then by
    the rank of its kind."""
    chosen = resolutions.where("status = 'RESOLVED'").select("slot", F.col("chosen").alias("callback"))
    best = best_evidence(evidence.join(chosen, ["slot", "callback"], "left_semi"))
    return best.select("slot", "callback", F.col("best_kind").alias("kind"), F.col("best_weight").alias("weight"))


def public_candidates(candidates: DataFrame, resolutions: DataFrame, names: DataFrame) -> DataFrame:
    """slot, place, callback, name, file, confidence, chosen: the candidates as they are shown. The chosen one comes first, then by
    falling confidence, name and file; ``names`` has callback, name, file."""
    chosen = resolutions.select("slot", F.col("chosen").alias("callback"), F.lit(True).alias("chosen"))
    rows = candidates.join(names, "callback", "left").join(chosen, ["slot", "callback"], "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))
    order = Window.partitionBy("slot").orderBy(F.desc("chosen"), F.desc("confidence"), F.asc_nulls_last("name"), F.asc_nulls_last("file"), "callback")
    return rows.select("slot", F.row_number().over(order).alias("place"), "callback", "name", "file", "confidence", "chosen")
