"""Whole runs: features to rankings, validation, and the bundles that they leave behind."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import priority_label
from loomwork.operators import dependency, evaluate, ranking, scoring
from loomwork.sources import sinks


def core(features: DataFrame, profiles: Sequence[scoring.Profile], key: str, baseline: str, available: Column, top: int = 20) -> dict[str, DataFrame]:
    """``ranked``: all entities with the score, rank, shift and priority of every profile; ``tops``: the first of each."""
    ranked = ranking.competition_rank(features, baseline, available)
    for p in profiles:
        ranked = ranking.unique_rank(scoring.score(ranked, p), f"{p.name}_score", baseline, key, f"{p.name}_rank")
        ranked = ranked.withColumns({f"{p.name}_shift": F.col("baseline_rank") - F.col(f"{p.name}_rank"), f"{p.name}_priority": priority_label(F.col(f"{p.name}_score"))})
    tops = None
    for p in profiles:
        part = ranking.top_ranked(ranked, top, f"{p.name}_score", baseline, key).select(F.lit(p.name).alias("profile"), key, F.col(f"{p.name}_score").alias("score"), "rank")
        tops = part if tops is None else tops.unionByName(part)
    return {"ranked": ranked, "tops": tops}


def benchmark(predictions: DataFrame, retrieved: Column, ks: Sequence[int] = (10,)) -> dict[str, DataFrame]:
    """The tables of a benchmark: predictions, intent metrics, summary, confusion of intents."""
    return {"predictions": predictions, "intent_metrics": evaluate.intent_metrics(predictions, ks), "summary": evaluate.benchmark_summary(predictions, retrieved, ks), "confusion": evaluate.role_confusion(predictions, "expected", "predicted")}


def sensitivity(features: DataFrame, profiles: list[scoring.Profile], factors: Mapping[str, float], key: str, ks: Sequence[int] = (5, 10, 20)) -> dict[str, DataFrame]:
    """The tables of a sensitivity run: targets by scenario, stability of scenarios, of weights and of profiles, targets."""
    base = "none|base"
    scored = ranking.unique_rank(scoring.scenario_scores(features, profiles, factors, key), "score", "baseline", key, by=["profile", "scenario"])
    own = Window.partitionBy("profile", key)  # a row for each scenario
    first = lambda c: F.max(F.when(F.col("scenario") == base, F.col(c))).over(own)
    rows = scored.withColumns({"base_rank": first("rank"), "base_score": first("score")}).where(F.col("scenario") != base)
    stable = ranking.rank_stability(rows, ["profile", "scenario"], "base_rank", "rank", ks).withColumn("weight", F.split_part("scenario", F.lit("|"), F.lit(1)))
    return {
        "details": rows, "scenarios": stable, "weights": evaluate.aggregate_scenarios(stable, ["profile", "weight"], "scenario", ks),
        "profiles": evaluate.aggregate_scenarios(stable, ["profile"], "scenario", ks), "targets": evaluate.summarize_targets(rows, ["profile", key], ks),
    }


def dependency_tables(rows: DataFrame, key: str, components: Mapping[str, bool], variants: Mapping[str, Mapping[str, bool]], positive: Column, negative: Column, partition: str, minimum: int, band: int, ks: Sequence[int]) -> dict[str, DataFrame]:
    """The tables of a dependency benchmark: ranks, metrics of each ranking and partition, stability, ablations."""
    ranked = dependency.candidate_rankings(rows, key, components, minimum, band)
    metrics = stable = None
    for name in ("baseline_rank", "dependency_only_rank", "bounded_overlay_rank"):
        part = evaluate.ranking_metrics(evaluate.with_combined(ranked, partition), name, positive, [partition], ks, negative).withColumn("ranking", F.lit(name))
        metrics = part if metrics is None else metrics.unionByName(part)
        if name != "baseline_rank":
            own = ranking.membership_changes(ranked, [], "baseline_rank", name, ks[0], band).withColumn("ranking", F.lit(name))
            stable = own if stable is None else stable.unionByName(own)
    return {"rank_comparison": ranked, "partition_metrics": metrics, "stability": stable, "ablations": dependency.ablations(rows, key, variants, minimum, ks[0])}


def save(tables: dict[str, DataFrame], path: str, **manifest: str) -> None:
    """A run's tables as a bundle; the manifest is written last."""
    sinks.write_bundle(tables, path, manifest)
