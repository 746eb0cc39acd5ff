"""Wide measurement matrices in long form: group summaries, contrasts, positions, context assignment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.ranking import quantiles


def to_long(df: DataFrame, key: str, columns: Sequence[str] | None = None, label: str = "label", value: str = "value") -> DataFrame:
    """One row per cell; missing cells stay missing."""
    chosen = list(columns or [c for c in df.columns if c != key])
    return df.select(key, *(F.col(f"`{c}`").try_cast("double").alias(c) for c in chosen)).unpivot(key, [f"`{c}`" for c in chosen], label, value)


@dataclass(frozen=True)
class Context:
    """Which models belong to a context: explicit ids, and values that metadata fields may or must not have."""

    include: Sequence[str] = ()
    exclude: Sequence[str] = ()
    accepted: Mapping[str, Sequence[str]] = field(default_factory=dict)
    rejected: Mapping[str, Sequence[str]] = field(default_factory=dict)


#: States of models that count as inside their context.
INSIDE = ("in_context", "explicitly_included")


def assign_context(context: Context, key: Column, metadata: Column, in_metadata: Column, in_matrices: Column) -> tuple[Column, Column, Column]:
    """(state, matched field, matched value) of a model. First of: excluded id, included id, known to metadata alone,
    no metadata, values accepted and rejected at once, rejected value, missing field, all values accepted, out."""
    value = lambda name: F.try_element_at(metadata, F.lit(name))
    given = lambda name: F.coalesce(value(name), F.lit("")) != ""
    among = lambda name, values: F.coalesce(value(name).isin(*values), F.lit(False))
    found = lambda rules: F.array_compact(F.array(*(F.when(among(n, vs), F.struct(F.lit(n).alias("field"), value(n).alias("value"))) for n, vs in rules.items())))
    nothing = F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value"))
    bad = found(context.rejected) if context.rejected else F.slice(F.array(nothing), 1, 0)
    good = found(context.accepted) if context.accepted else F.slice(F.array(nothing), 1, 0)
    missing = F.array_compact(F.array(*(F.when(~given(n), F.struct(F.lit(n).alias("field"), F.lit(None).cast("string").alias("value"))) for n in context.accepted))) if context.accepted else F.slice(F.array(nothing), 1, 0)
    ids = lambda xs: key.isin(*xs) if xs else F.lit(False)
    ladder = [
        (ids(context.exclude), "explicitly_excluded", nothing), (ids(context.include), "explicitly_included", nothing),
        (in_metadata & ~in_matrices, "model_not_reconciled", nothing), (metadata.isNull(), "metadata_unavailable", nothing),
        ((F.size(bad) > 0) & (F.size(good) > 0), "ambiguous_context", bad[0]), (F.size(bad) > 0, "out_of_context", bad[0]),
        (F.size(missing) > 0, "missing_required_metadata", missing[0]), (F.size(good) == len(context.accepted), "in_context", F.get(good, F.lit(0))),
    ]
    state = match = None
    for condition, name, why in ladder:
        condition = F.coalesce(condition, F.lit(False))
        state = F.when(condition, name) if state is None else state.when(condition, name)
        match = F.when(condition, why) if match is None else match.when(condition, why)
    match = match.otherwise(nothing)
    return state.otherwise("out_of_context"), match["field"], match["value"]


def summarize(df: DataFrame, by: Sequence[str], value: str, thresholds: Sequence[float] = ()) -> DataFrame:
    """Counts, extremes, exact linear quantiles and fractions at or above thresholds, of the values there are."""
    c, n = F.col(value), F.count(value)
    fractions = [F.try_divide(F.count_if(c >= t).cast("double"), n.cast("double")).alias(f"fraction_{k}") for k, t in enumerate(thresholds)]
    mean = F.try_divide(F.sum(c.cast("decimal(30,10)")).cast("double"), n.cast("double"))
    totals = df.groupBy(*by).agg(n.alias("n"), F.count_if(c.isNull()).alias("n_missing"), mean.alias("mean"), F.min(c).alias("least"), F.max(c).alias("most"), *fractions)
    return _beside(totals, quantiles(df, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}), by).withColumn("iqr", F.col("q3") - F.col("q1"))


def _beside(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """The left rows with the further columns of the right row of equal keys, nulls being equal."""
    other = right.withColumnsRenamed({c: f"__{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & left[c].eqNullSafe(other[f"__{c}"])
    return left.join(other, same, "left").drop(*(f"__{c}" for c in by))


def contrast(df: DataFrame, by: Sequence[str], inside: Column, value: str, least_in: int = 1, least_out: int = 1) -> DataFrame:
    """Median and mean inside minus outside, where both have enough values."""
    marked = df.withColumn("__in", F.coalesce(inside, F.lit(False)))
    sides = summarize(marked, [*by, "__in"], value)
    pick = lambda name, side: F.max(F.when(F.col("__in") == side, F.col(name)))
    both = sides.groupBy(*by).agg(*(F.coalesce(pick("n", side), F.lit(0)).alias(f"n_{word}") for word, side in (("in", True), ("out", False))), *(pick(what, side).alias(f"{what}_{word}") for what in ("median", "mean") for word, side in (("in", True), ("out", False))))
    enough = (F.col("n_in") >= least_in) & (F.col("n_out") >= least_out)
    return both.withColumns({"difference": F.when(enough, F.col("median_in") - F.col("median_out")), "mean_difference": F.when(enough, F.col("mean_in") - F.col("mean_out"))})


def position(df: DataFrame, group: str, value: str, least: int = 1, by: Sequence[str] = (), least_groups: int = 1) -> DataFrame:
    """Of each group with enough values: 100 * (groups with a larger median + half the ties) / (groups - 1).

    100 is the most negative median. With fewer than ``least_groups`` such groups there is no position.
    """
    sizes = df.groupBy(*by, group).agg(F.count(value).alias("n")).where(F.col("n") >= least)
    medians = _beside(sizes, quantiles(df, [*by, group], value, {"median": 0.5}), [*by, group])
    w = Window.partitionBy(*by)  # a row for each group
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, "median"))
    larger = F.rank().over(w.orderBy(F.col("median").desc())) - 1
    groups = F.count(F.lit(1)).over(w)
    place = F.lit(100.0) * (larger + (ties - 1) / F.lit(2.0)) / F.greatest(F.lit(1), groups - 1)
    return medians.withColumn("position", F.when(groups >= least_groups, place))
