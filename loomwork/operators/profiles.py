"""Profiles of targets over models: summaries by context side, over all, and by lineage; contrasts; lineage position."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.operators.dependency import coverage_state
from loomwork.operators.ranking import quantiles_of_counts
from loomwork.session import cut_lineage

#: The groups of models that a profile summarises beside lineages.
CONTEXT, REFERENCE, ALL, LINEAGE = "context", "non_context", "pan_cancer", "lineage"
#: Fixed value: the lineage of models whose metadata name none.
NO_LINEAGE = "metadata_missing"


@dataclass(frozen=True)
class Policy:
    """What a profile asks of its groups."""

    thresholds: Sequence[float] = ()
    least_context: int = 1
    least_reference: int = 1
    least_lineage_models: int = 1
    least_lineages: int = 1


def lineage_of(lineage: Column) -> Column:
    return F.when(F.coalesce(lineage, F.lit("")) != "", lineage).otherwise(NO_LINEAGE)


def group_sizes(models: DataFrame, inside: str, lineage: str) -> DataFrame:
    """(kind, group, n_models): models of each side, of all, and of each lineage, by one grouping-sets aggregation."""
    side, line = F.when(F.col(inside), CONTEXT).otherwise(REFERENCE), lineage_of(F.col(lineage))
    marked = models.select(side.alias("side"), line.alias("line"))
    return _named(marked.groupingSets([["side"], ["line"], []], "side", "line").agg(F.grouping_id("side", "line").alias("__set"), F.count(F.lit(1)).alias("n_models"))).select("kind", "group", "n_models")


def _named(df: DataFrame) -> DataFrame:
    """``kind`` and ``group`` in place of the columns of grouping sets (side and line; both missing: all)."""
    kind = F.when(F.col("__set") == 1, F.col("side")).when(F.col("__set") == 2, LINEAGE).otherwise(ALL)
    return df.withColumns({"kind": kind, "group": F.when(F.col("__set") == 2, F.col("line")).otherwise(kind)}).drop("side", "line", "__set")


def summaries(cells: DataFrame, models: DataFrame, target: str, model: str, measures: Sequence[str], inside: str, lineage: str, thresholds: Mapping[str, Sequence[float]] | None = None) -> DataFrame:
    """(target, measure, kind, group) with the number of models, the measured and missing ones, mean, extremes, quartiles
    and the fractions at or above thresholds, of every group of models that has a measured value of the target.

    ``cells`` has a row for each target and model with a column a measure; cells that are null or absent are missing. One
    grouping-sets aggregation counts the values of all groups, and one pass by ranges picks their quartiles.
    """
    side, line = F.when(F.col(inside), CONTEXT).otherwise(REFERENCE), lineage_of(F.col(lineage))
    known = models.select(model, side.alias("side"), line.alias("line"))
    each = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("__v")) for m in measures))
    long = cells.select(target, model, F.explode(each).alias("x")).select(target, model, "x.*").where("__v is not null and not isnan(__v)")
    joined = long.join(known, model)
    keys = [target, "measure", "__v"]
    counts = joined.groupingSets([[*keys, "side"], [*keys, "line"], keys], *keys, "side", "line").agg(F.grouping_id(*keys, "side", "line").bitwiseAND(3).alias("__set"), F.count(F.lit(1)).alias("__n"))
    counts = cut_lineage(_named(counts))
    by = [target, "measure", "kind", "group"]
    n, v = F.sum("__n"), F.col("__v")
    mean = F.sum(v.cast("decimal(28,10)") * F.col("__n").cast("decimal(10,0)")).cast("double") / n.cast("double")
    fractions = []
    for m, bounds in (thresholds or {}).items():
        fractions += [F.when(F.max(F.col("measure") == m), F.sum(F.when(v >= t, F.col("__n")).otherwise(0)).cast("double") / n.cast("double")).alias(f"{m}_fraction_{k}") for k, t in enumerate(bounds)]
    totals = counts.groupBy(*by).agg(n.alias("n"), mean.alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), *fractions)
    quartiles = quantiles_of_counts(counts, by, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    full = totals.join(quartiles, by).withColumn("iqr", F.col("q3") - F.col("q1"))
    return full.join(group_sizes(models, inside, lineage), ["kind", "group"]).withColumn("n_missing", F.col("n_models") - F.col("n"))


def profiles(targets: DataFrame, cells: DataFrame, models: DataFrame, target: str, model: str, effect: str, probability: str, inside: str, lineage: str, policy: Policy) -> DataFrame:
    """A row for each of ``targets`` (``target``, ``resolved``): summaries, contrasts, lineages, position and coverage.

    ``summaries`` has a struct for each measure and side, ``lineages`` one for each lineage with a measured value, in order;
    a lineage is eligible with enough models and a measured effect. The position of the context's lineage is
    100 * (eligible lineages with a larger median effect + half the ties) / (lineages - 1); it is null unless all models of the context
    are of one lineage, which is eligible, and enough lineages are. Contrasts need enough measured models on both sides.
    """
    bounds = {probability: policy.thresholds}
    found = cut_lineage(summaries(cells, models, target, model, [effect, probability], inside, lineage, bounds))
    fractions = [f"{probability}_fraction_{k}" for k in range(len(policy.thresholds))]
    shown = ["n_models", "n", "n_missing", "mean", "least", "q1", "median", "q3", "most", "iqr"]
    sides = (CONTEXT, REFERENCE, ALL)
    pick = lambda m, kind: F.max(F.when((F.col("measure") == m) & (F.col("kind") == kind), F.struct(*shown, *(fractions if m == probability else [])))).alias(f"{m}_{kind}")
    line = F.struct(F.col("group").alias("lineage"), "measure", *shown, (F.col("n_models") >= policy.least_lineage_models).alias("enough"))
    lines = F.array_sort(F.collect_list(F.when(F.col("kind") == LINEAGE, line))).alias("lineages")  # as many as there are lineages
    wide = found.groupBy(target).agg(*(pick(m, kind) for m in (effect, probability) for kind in sides), lines)

    own = models.where(F.col(inside)).agg(F.count(F.lit(1)).alias("n_context_models"), F.count_distinct(lineage_of(F.col(lineage))).alias("__lines"), F.min(lineage_of(F.col(lineage))).alias("context_lineage"))
    own = own.select("n_context_models", F.when(F.col("__lines") == 1, F.col("context_lineage")).alias("context_lineage"))
    rows = targets.select(target, "resolved").join(wide, target, "left").join(F.broadcast(own))
    n = lambda m, kind: F.coalesce(F.col(f"{m}_{kind}.n"), F.lit(0))
    contrasts = {}
    for m in (effect, probability):
        for kind in (REFERENCE, ALL):
            enough = (n(m, CONTEXT) >= policy.least_context) & (n(m, kind) >= policy.least_reference)
            for what in ("median", "mean", *(fractions if m == probability else [])):
                name = what if what in fractions else f"{m}_{what}"
                contrasts[f"{name}_minus_{kind}"] = F.when(enough, F.col(f"{m}_{CONTEXT}.{what}") - F.col(f"{m}_{kind}.{what}"))
    rows = rows.withColumns(contrasts)
    eligible = F.filter(F.coalesce("lineages", F.array()), lambda x: x["enough"] & (x["measure"] == effect) & (x["n"] > 0))
    rows = rows.withColumn("__eligible", eligible).withColumn("n_eligible_lineages", F.size("__eligible"))
    median = F.get(F.filter("__eligible", lambda x: x["lineage"] == F.col("context_lineage")), F.lit(0))["median"]
    rows = rows.withColumn("__median", median)
    larger = F.size(F.filter("__eligible", lambda x: x["median"] > F.col("__median")))
    equal = F.size(F.filter("__eligible", lambda x: x["median"] == F.col("__median")))
    place = F.lit(100.0) * (larger + (equal - 1) / F.lit(2.0)) / F.greatest(F.lit(1), F.col("n_eligible_lineages") - 1)
    possible = F.col("__median").isNotNull() & (F.col("n_eligible_lineages") >= policy.least_lineages)
    some = lambda m: F.col(f"{m}_{ALL}").isNotNull()
    counts = {"effect_context": n(effect, CONTEXT), "effect_reference": n(effect, REFERENCE), "probability_context": n(probability, CONTEXT), "probability_reference": n(probability, REFERENCE)}
    state = coverage_state(F.coalesce("resolved", F.lit(False)), some(effect), some(probability), F.col("n_context_models"), counts, policy.least_context, policy.least_reference)
    return rows.withColumns({"lineage_position": F.when(possible, place), "coverage_state": state}).drop("__eligible", "__median")

