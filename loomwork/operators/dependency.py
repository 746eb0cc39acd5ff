"""Dependency analytics: models in contexts, profiles of targets, benchmark rankings and the gate of a release."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import criterion
from loomwork.operators.matrix import summarize
from loomwork.operators.ranking import bounded_overlay, membership_changes, midrank_percentile, placed, reversed_signal, signal_rank
from loomwork.session import cut_lineage


def group_summaries(values: DataFrame, target: str, value: str, inside: Column, thresholds: Sequence[float] = ()) -> DataFrame:
    """A row for each target and group (``context``, ``non_context``, ``pan_cancer``) of its summary."""
    rows = values.withColumn("group", F.explode(F.array(F.when(inside, F.lit("context")).otherwise(F.lit("non_context")), F.lit("pan_cancer"))))
    return summarize(rows, [target, "group"], value, thresholds)


def profile_contrasts(summaries: DataFrame, target: str, least_context: int, least_reference: int, thresholds: int = 0) -> DataFrame:
    """Context minus non-context and minus all, of medians, means and fractions, where both sides have enough values."""
    pick = lambda name, group: F.max(F.when(F.col("group") == group, F.col(name)))
    names = ["median", "mean", *(f"fraction_{k}" for k in range(thresholds))]
    wide = summaries.groupBy(target).agg(*(F.coalesce(pick("n", g), F.lit(0)).alias(f"n_{g}") for g in ("context", "non_context", "pan_cancer")), *(pick(n, g).alias(f"{n}_{g}") for n in names for g in ("context", "non_context", "pan_cancer")))
    enough = lambda g: (F.col("n_context") >= least_context) & (F.col(f"n_{g}") >= least_reference)
    return wide.withColumns({f"{n}_minus_{g}": F.when(enough(g), F.col(f"{n}_context") - F.col(f"{n}_{g}")) for n in names for g in ("non_context", "pan_cancer")})


def coverage_state(resolved: Column, has_effect: Column, has_probability: Column, n_models: Column, n: Mapping[str, Column], least_context: int, least_reference: int) -> Column:
    """How far a profile is covered. ``n`` has the measured models: effect_context, effect_reference,
    probability_context, probability_reference."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    ec, er, pc, pr = (zero(n[k]) for k in ("effect_context", "effect_reference", "probability_context", "probability_reference"))
    return (
        F.when(~resolved, "target_unresolved").when(n_models == 0, "no_context_models")
        .when(has_effect & has_probability & (ec == 0) & (pc == 0), "context_models_all_values_missing")
        .when((ec < least_context) & (pc < least_context), "insufficient_measured_context_models")
        .when((er < least_reference) & (pr < least_reference), "insufficient_measured_reference_models")
        .when(has_effect & has_probability, "sufficient_complete_coverage").when(has_effect | has_probability, "sufficient_partial_coverage")
        .otherwise(matrix_state(resolved, has_effect, has_probability))
    )


def matrix_state(resolved: Column, has_effect: Column, has_probability: Column) -> Column:
    """Which of the two matrices hold a resolved target."""
    both = F.when(has_effect & has_probability, "target_resolved_both_matrices").when(has_effect, "target_present_only_gene_effect").when(has_probability, "target_present_only_dependency_probability")
    return F.when(resolved, both.otherwise("target_unresolved")).otherwise("target_unresolved")


def heterogeneity(effects: DataFrame, probabilities: DataFrame, target: str, model: str, effect: str, probability: str) -> DataFrame:
    """A row for each measured model of a target, with its probability where there is one. Rows, not arrays: a
    target may have any number of models; order by target, effect and model to read them."""
    have = probabilities.select(target, model, probability)
    return effects.where(F.col(effect).isNotNull()).select(target, model, effect).join(have, [target, model], "left")


def discordant_models(pairs: DataFrame, effect: str, probability: str, strong: float | None, low: float | None, high: float | None) -> DataFrame:
    """Models whose two measures disagree: a strong effect with a low probability, or a weak one with a high one."""
    e, p = F.col(effect), F.col(probability)
    never = F.lit(False)
    first = (e <= strong) & (p <= low) if strong is not None and low is not None else never
    second = (e > strong) & (p >= high) if strong is not None and high is not None else never
    kind = F.when(first, "strong_negative_gene_effect_low_probability").when(second, "weak_gene_effect_high_probability")
    return pairs.withColumn("type", kind).where("type is not null")


def summary_contradictions(effect: DataFrame, probability: DataFrame, target: str, references: DataFrame | None = None) -> DataFrame:
    """(target, type, source) from the contrasts of both matrices: a context signal in one alone, too little for a
    concordance, contrasts that point to different sides, and membership in a reference list against selectivity.
    ``references`` has (target, reference, status)."""
    rename = lambda df, s: df.withColumnsRenamed({c: f"{s}_{c}" for c in df.columns if c != target})
    both = rename(effect, "e").join(rename(probability, "p"), target, "full")
    e, p = F.coalesce(F.col("e_n_context"), F.lit(0)) > 0, F.coalesce(F.col("p_n_context"), F.lit(0)) > 0
    opposite = lambda s: (F.col(f"{s}_median_context") - F.col(f"{s}_median_non_context")) * (F.col(f"{s}_median_context") - F.col(f"{s}_median_pan_cancer")) < 0
    item = lambda condition, kind, source=None: F.when(condition, F.struct(F.lit(kind).alias("type"), F.lit(source).cast("string").alias("source")))
    found = F.array_compact(F.array(
        item(e != p, "context_signal_present_only_one_matrix"), item(~(e & p), "insufficient_data_for_concordance_assessment"),
        item(opposite("e"), "context_and_pan_cancer_summaries_point_in_different_directions", "gene_effect"),
        item(opposite("p"), "context_and_pan_cancer_summaries_point_in_different_directions", "dependency_probability"),
    ))
    rows = both.select(target, F.explode(found).alias("x")).select(target, "x.type", "x.source")
    if references is None:
        return rows
    selective = both.where(F.col("e_median_minus_non_context") < 0).select(target)
    listed = references.where("status = 'explicitly_present'").join(selective, target, "left_semi")
    return rows.unionByName(listed.select(target, F.lit("optional_reference_membership_conflicts_with_descriptive_context_selectivity").alias("type"), F.col("reference").alias("source")))


def reference_status(targets: DataFrame, members: DataFrame, target: str, resolved: Column, validation: str | None) -> DataFrame:
    """(target, status): membership in a reference list; absence is told from a list that is missing or failed."""
    have = members.select(F.col(target).alias("__m")).where("__m is not null").distinct()
    joined = targets.join(have, F.col(target) == F.col("__m"), "left")
    if validation is None:
        status = F.lit("reference_unavailable")
    elif validation != "valid":
        status = F.lit("reference_validation_failed")
    else:
        status = F.when(F.col(target).isNull() | ~resolved, "target_unresolved_in_reference").when(F.col("__m").isNotNull(), "explicitly_present").otherwise("explicitly_absent")
    return joined.select(target, status.alias("status"))


def reconcile_benchmark(benchmark: DataFrame, baseline: DataFrame, profiles: DataFrame, key: str, request: str) -> DataFrame:
    """Every benchmark row with its baseline rank and profile, and which of them it has. ``profiles`` has ``by`` (the
    normalised request, and the symbol of the matched label: a row for each) and the profile's columns."""
    ranked = benchmark.join(baseline.withColumn("__ranked", F.lit(True)), key, "left")
    joined = ranked.join(profiles.withColumn("__profiled", F.lit(True)), F.col(request) == F.col("by"), "left")
    r, p = F.col("__ranked").isNotNull(), F.col("__profiled").isNotNull()
    state = F.when(r & p, "ranked_and_profiled").when(r, "ranked_not_profiled").when(p, "profiled_not_ranked").otherwise("unresolved_benchmark_target")
    return joined.withColumn("reconciliation_state", state).drop("__ranked", "__profiled", "by")


def profile_keys(profiles: DataFrame, request: str, label: str) -> DataFrame:
    """A row ``by`` for the request and for the symbol part of the label of each profile; a symbol wins over nothing,
    and of profiles that share a key the one with the least label stays."""
    symbol = F.when(F.contains(F.col(label), F.lit(" (")), F.substring_index(F.col(label), " (", 1))
    keys = profiles.withColumn("by", F.explode(F.array_distinct(F.array_compact(F.array(F.col(request), symbol))))).where("by <> ''")
    other = [c for c in profiles.columns]
    return keys.groupBy("by").agg(F.min_by(F.struct(*other), F.struct(F.col(label).isNull(), label)).alias("__p")).select("by", "__p.*")


def candidate_rankings(rows: DataFrame, key: str, components: Mapping[str, bool], minimum: int, band: int) -> DataFrame:
    """The rows with their dependency signal, the rank by it alone, and the overlay bounded to bands of the baseline."""
    signed = reversed_signal(rows, key, components, minimum, "dependency_signal")
    alone = signal_rank(signed, "dependency_signal", "baseline_rank", key, "dependency_only_rank")
    ranked = bounded_overlay(alone.where("baseline_rank is not null"), "baseline_rank", "dependency_signal", key, band, "bounded_overlay_rank").select(key, "bounded_overlay_rank")
    return alone.join(ranked, key, "left")


def ablations(rows: DataFrame, key: str, variants: Mapping[str, Mapping[str, bool]], minimum: int, k: int) -> DataFrame:
    """A row for each subset of components: eligible rows, and how far its ranking keeps the baseline.

    Components are scored once, all subsets are ranked as groups of one table: their number doesn't change the number of jobs.
    """
    sides = {(c, down): f"{'-' if down else '+'}{c}" for components in variants.values() for c, down in components.items()}
    values = F.array(*(F.struct(F.lit(name).alias("component"), (-F.col(c) if down else F.col(c)).cast("double").alias("value")) for (c, down), name in sides.items()))
    scored = midrank_percentile(rows.select(key, F.explode(values).alias("x")).select(key, "x.*").where("value is not null"), "value", by=["component"])
    spark = rows.sparkSession
    subsets = spark.createDataFrame([(name, sides[c, down]) for name, components in variants.items() for c, down in components.items()], "ablation string, component string")
    means = scored.join(F.broadcast(subsets), "component").groupBy("ablation", key).agg(F.when(F.count("percentile") >= minimum, F.avg("percentile")).alias("signal"))
    names = spark.createDataFrame([(name, "|".join(components)) for name, components in variants.items()], "ablation string, components string")
    based = rows.where(F.col("baseline_rank").isNotNull()).select(key, "baseline_rank", F.explode(F.array(*map(F.lit, variants))).alias("ablation"))
    signed = cut_lineage(based.join(means, ["ablation", key], "left"))
    ranked = placed(signed, [F.col("signal").desc_nulls_last(), F.col("baseline_rank"), F.col(key)], ["ablation"], "ablation_rank")
    stable = membership_changes(ranked, ["ablation"], "baseline_rank", "ablation_rank", k).select("ablation", "spearman", "jaccard")
    eligible = signed.groupBy("ablation").agg(F.count_if(F.col("signal").isNotNull()).alias("eligible"))
    joined = names.join(eligible, "ablation", "left").join(stable, "ablation", "left")
    return joined.select("ablation", "components", F.coalesce("eligible", F.lit(0)).alias("eligible"), "spearman", "jaccard")


def gate(criteria: DataFrame, ladder: Sequence[tuple[Sequence[str], str]], passed: str) -> DataFrame:
    """One row ``state``: that of the first step with a mandatory criterion that isn't met; an empty step takes any.

    ``criteria`` has (criterion, observed, op, bound, mandatory).
    """
    results = criteria.withColumn("result", criterion(F.col("observed"), F.col("op"), F.col("bound")))
    bad = F.col("mandatory") & (F.col("result") != "pass")
    chain = None
    for names, state in ladder:
        held = F.count_if(bad & F.col("criterion").isin(*names)) > 0 if names else F.count_if(bad) > 0
        chain = F.when(held, state) if chain is None else chain.when(held, state)
    return results.agg(chain.otherwise(passed).alias("state"), F.count_if(F.col("result") == "pass").alias("n_passed"), F.count(F.lit(1)).alias("n_criteria"))


def report_evidence(profiles: DataFrame, overlay: DataFrame, key: str) -> DataFrame:
    """Profiles with their overlay, and ``issues``: ranks on one side alone, or a change that isn't candidate minus baseline."""
    joined = profiles.join(overlay, key, "left")
    base, candidate = F.col("baseline_rank"), F.col("candidate_rank")
    delta = candidate - base
    issues = F.array_compact(F.array(F.when(base.isNull() != candidate.isNull(), "rank_on_one_side"), F.when((base < 1) | (candidate < 1), "rank_below_one"), F.when(~F.col("rank_delta").eqNullSafe(delta), "rank_delta_mismatch")))
    return joined.withColumn("issues", issues)
