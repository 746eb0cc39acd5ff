"""Ranks, shifts, top-k, mid-rank percentiles and bounded reranking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import priority_label
from loomwork.session import cut_lineage


def placed(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """1..n within each group, or over the whole table, without a task that sees a whole group.

    Rows are range-partitioned and sorted by group and order; a partition counts its own rows of each group, and
    the counts before it (a row for each partition and group in it) are added. The sorted rows are written to the
    checkpoint folder, so that places are fixed. ``order`` must tell all rows of a group apart.
    """
    keys = [F.col(c) for c in by]
    sorted_rows = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    rows = cut_lineage(sorted_rows.withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__at", 33))
    sizes = rows.groupBy("__part", *by).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(F.col("__part").alias("__p"), *(F.col(c).alias(f"__{c}") for c in by), "__first", F.coalesce(before, F.lit(0)).alias("__before"))
    same = rows["__part"] == offsets["__p"]
    for c in by:
        same = same & rows[c].eqNullSafe(offsets[f"__{c}"])
    joined = rows.join(offsets, same)
    return joined.select(*(rows[c] for c in df.columns), (F.col("__before") + F.col("__at") - F.col("__first") + 1).alias(name))


def totals_before(df: DataFrame, order: Sequence[Column], weight: str, by: Sequence[str] = (), name: str = "before") -> DataFrame:
    """The sum of ``weight`` over the rows that come first, in the manner of ``placed``."""
    keys = [F.col(c) for c in by]
    sorted_rows = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    rows = cut_lineage(sorted_rows.withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__at", 33))
    earlier = lambda part, at: F.coalesce(F.sum(F.col(weight)).over(Window.partitionBy(*part).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = rows.withColumn("__inside", earlier(["__part", *by], "__at"))
    sizes = rows.groupBy("__part", *by).agg(F.sum(weight).alias(weight))
    offsets = sizes.select(F.col("__part").alias("__p"), *(F.col(c).alias(f"__{c}") for c in by), earlier(by, "__part").alias("__before"))
    same = inside["__part"] == offsets["__p"]
    for c in by:
        same = same & inside[c].eqNullSafe(offsets[f"__{c}"])
    return inside.join(offsets, same).select(*(inside[c] for c in df.columns), (F.col("__before") + F.col("__inside")).alias(name))


def _by_value(df: DataFrame, shown: Column, by: Sequence[str]) -> DataFrame:
    """(by, __v, __n, before): how many rows have each value that is there, and how many have a larger one."""
    counts = df.select(*by, shown.alias("__v")).where("__v is not null").groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__n"))
    return totals_before(counts, [F.desc("__v")], "__n", by)


def _with_value(df: DataFrame, shown: Column, values: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rows with the columns of their value."""
    right = values.withColumnsRenamed({c: f"__{c}" for c in by})
    left = df.withColumn("__shown", shown)
    same = left["__shown"] == right["__v"]
    for c in by:
        same = same & left[c].eqNullSafe(right[f"__{c}"])
    return left.join(right, same, "left").drop("__shown", *(f"__{c}" for c in by))


def competition_rank(df: DataFrame, score: str, available: Column, name: str = "baseline_rank", by: Sequence[str] = ()) -> DataFrame:
    """Ties share the least rank; rows that aren't available have none."""
    shown = F.when(available, F.col(score))
    return _with_value(df, shown, _by_value(df, shown, by), by).select(*df.columns, (F.col("before") + 1).alias(name))


def unique_rank(df: DataFrame, score: str, baseline: str, key: str, name: str = "rank", by: Sequence[str] = ()) -> DataFrame:
    """1..n by score, then baseline, then key."""
    return placed(df, [F.col(score).desc_nulls_last(), F.col(baseline).desc_nulls_last(), F.col(key)], by, name)


def global_row_number(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """1..n over a whole table."""
    return placed(df, order, (), name)


def rank_shift(df: DataFrame, baseline_rank: str = "baseline_rank", rank: str = "rank", name: str = "rank_shift") -> DataFrame:
    return df.withColumn(name, F.col(baseline_rank) - F.col(rank))


def intent_ranking(df: DataFrame, score: str, baseline: str, available: Column, key: str) -> DataFrame:
    ranked = unique_rank(competition_rank(df, baseline, available), score, baseline, key)
    return rank_shift(ranked).withColumn("priority", priority_label(F.col(score)))


def top_k(df: DataFrame, k: int, rank: str = "rank", score: str = "score", key: str = "key", prioritized_only: bool = True) -> DataFrame:
    kept = df.where((priority_label(F.col(score)) != "not prioritized") & (F.col(score) > 0)) if prioritized_only else df
    return kept.orderBy(F.col(rank).asc_nulls_last(), F.col(score).desc_nulls_last(), F.col(key)).limit(k)


def top_ranked(df: DataFrame, k: int, score: str, baseline: str, key: str, name: str = "rank") -> DataFrame:
    """The first k of ``unique_rank`` that are prioritised, with their ranks: only k rows are numbered."""
    order = [F.col(score).desc_nulls_last(), F.col(baseline).desc_nulls_last(), F.col(key)]
    best = df.where((priority_label(F.col(score)) != "not prioritized") & (F.col(score) > 0)).orderBy(*order).limit(k)
    return best.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, name: str = "place") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col(name) <= n)


def midrank_percentile(df: DataFrame, value: str, name: str = "percentile", by: Sequence[str] = ()) -> DataFrame:
    """1 for the largest, 0 for the smallest, ties share the middle of their ranks; nulls have none."""
    values = _by_value(df, F.col(value), by)
    sizes = values.groupBy(*by).agg(F.sum("__n").alias("__all")).withColumnsRenamed({c: f"__{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & values[c].eqNullSafe(sizes[f"__{c}"])
    counted = values.join(sizes, same).drop(*(f"__{c}" for c in by))
    mid = F.col("before") + 1 + (F.col("__n") - 1) / F.lit(2.0)
    percentile = F.when(F.col("__all") == 1, F.lit(1.0)).otherwise(F.lit(1.0) - (mid - 1) / F.nullif(F.col("__all") - 1, F.lit(0)))
    return _with_value(df, F.col(value), counted, by).select(*df.columns, percentile.alias(name))


def quantiles(df: DataFrame, by: Sequence[str], value: str, shares: Mapping[str, float]) -> DataFrame:
    """A row for each group: exact linear quantiles of the values there are, picked by rank from counts of values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    return quantiles_of_counts(counts, by, shares)


def quantiles_of_counts(counts: DataFrame, by: Sequence[str], shares: Mapping[str, float]) -> DataFrame:
    """``quantiles`` of values ``__v`` that each occur ``__n`` times."""
    ranks = totals_before(counts, [F.asc("__v")], "__n", by)
    sizes = counts.groupBy(*by).agg(F.sum("__n").alias("__all")).withColumnsRenamed({c: f"__{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & ranks[c].eqNullSafe(sizes[f"__{c}"])
    full = ranks.join(sizes, same)
    at = {name: F.lit(float(q)) * (F.col("__all") - 1) for name, q in shares.items()}
    here = lambda k: F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("__n")), F.col("__v")))
    picked = full.groupBy(*by, "__all").agg(*(here(F.floor(p)).alias(f"{name}__low") for name, p in at.items()), *(here(F.ceil(p)).alias(f"{name}__high") for name, p in at.items()))
    between = lambda name, p: F.col(f"{name}__low") + (F.col(f"{name}__high") - F.col(f"{name}__low")) * (p - F.floor(p))
    return picked.select(*by, *(between(name, p).cast("double").alias(name) for name, p in at.items()))


def mean_signal(df: DataFrame, key: str, component: str, percentile: str, minimum: int, name: str = "signal") -> DataFrame:
    """The mean of a key's available components, if there are enough."""
    n = F.count(percentile)
    return df.groupBy(key).agg(F.when(n >= minimum, F.avg(percentile)).alias(name), n.alias("n_components"))


def bounded_overlay(df: DataFrame, baseline: str, signal: str, key: str, band: int, name: str = "overlay_rank") -> DataFrame:
    """Within bands of baseline ranks, rows with a signal take the places of such rows by their signal; others stay."""
    marked = df.withColumn("__band", F.floor((F.col(baseline) - 1) / band)).withColumn("__in", F.col(signal).isNotNull())
    part = Window.partitionBy("__band", "__in")
    order = F.row_number().over(part.orderBy(F.col(signal).desc_nulls_last(), F.col(baseline), F.col(key)))
    slot = F.row_number().over(part.orderBy(F.col(baseline), F.col(key)))
    placed = marked.withColumns({"__order": order, "__slot": slot})
    slots = placed.where("__in").select(F.col("__band").alias("__b"), F.col("__slot").alias("__o"), F.col(baseline).alias("__place"))
    joined = placed.join(slots, F.col("__in") & (F.col("__band") == F.col("__b")) & (F.col("__order") == F.col("__o")), "left")
    return joined.select(*df.columns, F.coalesce("__place", F.col(baseline)).alias(name))


def rank_stability(df: DataFrame, by: Sequence[str], baseline: str, scenario: str, ks: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """Correlation of two rankings, rank changes, and what the top k share."""
    x, y = F.col(baseline).cast("double"), F.col(scenario).cast("double")
    n = F.count(F.lit(1)).cast("double")
    sx, sy = F.sum(x), F.sum(y)
    covariance = n * F.sum(x * y) - sx * sy
    spread = F.sqrt((n * F.sum(x * x) - sx * sx) * (n * F.sum(y * y) - sy * sy))
    change = F.abs(F.col(baseline) - F.col(scenario))
    aggs = [F.count(F.lit(1)).alias("n"), F.try_divide(covariance, spread).alias("spearman"), F.avg(change).alias("mean_change"), F.max(change).cast("long").alias("max_change")]
    for k in ks:
        a, b = F.col(baseline) <= k, F.col(scenario) <= k
        both, either = F.count_if(a & b).cast("double"), F.count_if(a | b).cast("double")
        aggs += [F.try_divide(both, either).alias(f"jaccard_{k}"), F.try_divide(both, F.count_if(a).cast("double")).alias(f"retention_{k}")]
    return df.groupBy(*by).agg(*aggs)


def membership_changes(df: DataFrame, by: Sequence[str], baseline: str, ranking: str, k: int, band: int | None = None) -> DataFrame:
    """Stability of a second ranking: shared rows, what its first k keep, gain and lose, the median and largest
    displacement, and rows that leave their band of baseline ranks. The first k are places among the shared rows."""
    shared = df.where(F.col(ranking).isNotNull() & F.col(baseline).isNotNull())
    both = placed(placed(shared, [F.asc(baseline)], by, "__b"), [F.asc(ranking)], by, "__r")
    moved = both.withColumn("__moved", F.abs(F.col(ranking) - F.col(baseline)))
    a, b = F.col("__b") <= k, F.col("__r") <= k
    count = lambda c: F.count_if(c)
    band_of = lambda c: F.floor((F.col(c) - 1) / F.lit(band))
    left = F.count_if(band_of(baseline) != band_of(ranking)) if band else F.lit(None).cast("long")
    x, y, n = F.col(baseline).cast("double"), F.col(ranking).cast("double"), F.count(F.lit(1)).cast("double")
    covariance = n * F.sum(x * y) - F.sum(x) * F.sum(y)
    spread = F.sqrt((n * F.sum(x * x) - F.sum(x) * F.sum(x)) * (n * F.sum(y * y) - F.sum(y) * F.sum(y)))
    out = moved.groupBy(*by).agg(
        F.count(F.lit(1)).alias("shared"), F.try_divide(covariance, spread).alias("spearman"),
        F.try_divide(count(a & b).cast("double"), count(a | b).cast("double")).alias("jaccard"),
        count(a & b).alias("retained"), count(b & ~a).alias("added"), count(a & ~b).alias("removed"),
        F.max("__moved").alias("largest_change"), left.alias("band_violations"),
    )
    middle = quantiles(moved, by, "__moved", {"median_change": 0.5})
    if not by:
        return out.join(F.broadcast(middle), how="left")
    return out.join(middle, list(by), "left")


def reversed_signal(df: DataFrame, key: str, components: Mapping[str, bool], minimum: int, name: str = "signal") -> DataFrame:
    """The rows with the mean of the mid-rank percentiles of their components, if ``minimum`` of these are there.

    ``components`` maps a column to whether smaller values are the stronger ones (their sign is reversed).
    """
    long = df.select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("component"), (-F.col(c) if down else F.col(c)).cast("double").alias("value")) for c, down in components.items()))).alias("x")).select(key, "x.*")
    scored = midrank_percentile(long.where("value is not null"), "value", by=["component"])
    means = mean_signal(scored, key, "component", "percentile", minimum, name)
    return df.join(means, key, "left").withColumn("n_components", F.coalesce("n_components", F.lit(0)))


def signal_rank(df: DataFrame, signal: str, baseline: str, key: str, name: str = "signal_rank") -> DataFrame:
    """Rows with a baseline rank in the order: those with a signal first, larger ones first, then baseline and key."""
    ranked = placed(df.where(F.col(baseline).isNotNull()), [F.col(signal).desc_nulls_last(), F.col(baseline), F.col(key)], (), name)
    return df.join(ranked.select(key, name), key, "left")
