"""Evaluation of predictions: intents, confusion, macro metrics, ranking metrics, enrichment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import LOW
from loomwork.operators.ranking import placed, totals_before
from loomwork.session import cut_lineage

MISSING, NONE = "__missing_prediction__", "none"
#: Columns of a mode.
MODE_COLUMNS = {"score": "{}_score", "rank": "{}_rank", "shift": "{}_shift", "priority": "{}_priority"}


def primary_intent(scores: dict[str, Column], available: Column, least: float = LOW) -> tuple[Column, Column]:
    """(intent, score): the largest score, ties to the first intent; ``none`` up to ``least``, a sentinel if unavailable."""
    best = F.greatest(*(F.coalesce(c, F.lit(0.0)) for c in scores.values()))
    chain = F.when(~available, MISSING).when(best <= least, "none")
    for name, c in scores.items():
        chain = chain.when(F.coalesce(c, F.lit(0.0)) == best, name)
    return chain.otherwise("none"), F.when(available, best).otherwise(0.0)


def confusion_matrix(df: DataFrame, expected: str, predicted: str, labels: Sequence[str]) -> DataFrame:
    """Counts by expected label (rows) and predicted label (columns), zeros filled in."""
    domain = df.sparkSession.createDataFrame([(x,) for x in labels], f"{expected} string")
    counted = df.groupBy(F.col(expected).cast("string").alias(expected)).agg(*(F.count_if(F.col(predicted).cast("string") == x).alias(f"predicted_{x}") for x in labels))
    return domain.join(counted, expected, "left").na.fill(0)


def classification_metrics(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    """Accuracy and macro precision, recall and F1 over the union of labels; a metric without cases is 0."""
    pairs = df.groupBy(F.col(expected).alias("e"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("e").alias("label"), F.lit(True).alias("actual")), F.struct(F.col("p").alias("label"), F.lit(False).alias("actual")))).alias("x"), "n", (F.col("e") == F.col("p")).alias("hit"))
    by = sides.groupBy("x.label").agg(F.sum(F.when(F.col("x.actual"), F.col("n")).otherwise(0)).alias("actual"), F.sum(F.when(~F.col("x.actual"), F.col("n")).otherwise(0)).alias("found"), F.sum(F.when(F.col("x.actual") & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(F.lit(2.0) * F.col("tp"), (F.col("actual") + F.col("found")).cast("double")), F.lit(0.0))
    rows = by.select("label", "tp", "actual", ratio("tp", "found").alias("p"), ratio("tp", "actual").alias("r"), f1.alias("f"))
    ordered = lambda c: F.aggregate(F.array_sort(F.collect_list(F.struct("label", c))), F.lit(0.0), lambda a, x: a + x[c]) / F.count(F.lit(1))
    return rows.agg(F.try_divide(F.sum("tp").cast("double"), F.sum("actual").cast("double")).alias("accuracy"), ordered("p").alias("macro_precision"), ordered("r").alias("macro_recall"), ordered("f").alias("macro_f1"))


def ranking_metrics(df: DataFrame, rank: str, positive: Column, by: Sequence[str], ks: Sequence[int], negative: Column | None = None) -> DataFrame:
    """Of each group of eligible rows: recall and precision at k, average precision, reciprocal of the best rank, median
    and normalised median rank of the positives, coverage, the positives and negatives among the first k, and the
    share of the negatives outside them.

    Eligible are positives and negatives, or all rows without ``negative``. A row without a rank takes no place, but counts
    among the positives or negatives that recall, average precision and exclusion are measured by.
    """
    pos, neg = F.coalesce(positive, F.lit(False)), F.coalesce(negative if negative is not None else F.lit(False), F.lit(False))
    eligible = df if negative is None else df.where(pos | neg)
    marked = cut_lineage(eligible.select(*by, F.col(rank).alias("__rank"), pos.cast("long").alias("__pos"), neg.cast("long").alias("__neg")))
    totals = marked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count("__rank").alias("n_ranked"), F.sum("__pos").alias("n_positive"), F.sum("__neg").alias("n_negative"), F.sum(F.when(F.col("__rank").isNotNull(), F.col("__pos"))).alias("__found"))
    rows = placed(marked.where("__rank is not null"), [F.col("__rank")], by, "__row")
    run = totals_before(rows, [F.col("__row")], "__pos", by, "__earlier").withColumn("__hits", F.col("__earlier") + F.col("__pos"))
    known = totals.withColumnsRenamed({c: f"__{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & run[c].eqNullSafe(known[f"__{c}"])
    hit, row = F.col("__pos") == 1, F.col("__row")
    middle = lambda k: F.max(F.when(hit & (F.col("__hits") == k), F.col("__rank")))
    sums = [
        F.sum(F.when(hit, F.round(F.col("__hits") / row.cast("double"), 12).cast("decimal(30,12)"))).cast("double").alias("__terms"),  # a decimal sum doesn't depend on partitions
        F.min(F.when(hit, F.col("__rank"))).alias("__best"),
        ((middle(F.floor((F.col("__found") + 1) / 2)) + middle(F.ceil((F.col("__found") + 1) / 2))) / F.lit(2.0)).alias("median_rank"),
    ]
    for k in ks:
        sums += [F.sum(F.when(row <= k, F.col(c)).otherwise(0)).alias(f"{word}_{k}") for word, c in (("positive", "__pos"), ("negative", "__neg"))]
    found = run.join(known, same).groupBy(*by).agg(*sums).withColumnsRenamed({c: f"__{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & totals[c].eqNullSafe(found[f"__{c}"])
    ratio = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    out = [F.col(c) for c in ("n", "n_ranked", "n_positive", *(["n_negative"] if negative is not None else []))]
    out += [
        ratio(F.col("n_ranked"), F.col("n")).alias("coverage"), ratio(F.coalesce("__terms", F.lit(0.0)), F.col("n_positive")).alias("average_precision"),
        ratio(F.lit(1.0), F.col("__best")).alias("reciprocal_rank"), F.col("median_rank"), ratio(F.col("median_rank"), F.col("n_ranked")).alias("normalized_median_rank"),
    ]
    for k in ks:
        top, bad = (F.coalesce(f"{word}_{k}", F.lit(0)) for word in ("positive", "negative"))
        out += [top.alias(f"positive_{k}"), ratio(top, F.col("n_positive")).alias(f"recall_{k}"), ratio(top, F.least(F.lit(k), F.col("n_ranked"))).alias(f"precision_{k}")]
        if negative is not None:
            out += [bad.alias(f"negative_{k}"), ratio(F.col("n_negative") - bad, F.col("n_negative")).alias(f"excluded_{k}")]
    joined = totals.join(found, same, "left") if by else totals.join(F.broadcast(found), how="left")
    return joined.select(*by, *out)


def with_combined(df: DataFrame, partition: str, combined: str = "combined") -> DataFrame:
    """Every row once in its partition and once in that of all rows."""
    return df.withColumn(partition, F.explode(F.array(F.col(partition).cast("string"), F.lit(combined))))


def log_factorial(n: Column) -> Column:
    """Natural logarithm of n!: the exact factorial up to 20, Stirling's series beyond."""
    z = n.cast("double") + 1
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5)) - 1 / (1680 * F.pow(z, 7))
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise((z - 0.5) * F.log(z) - z + 0.5 * F.log(2 * F.pi()) + series)


def _log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def hypergeometric_tail(population: Column, positives: Column, drawn: Column, hits: Column) -> Column:
    """P(X >= hits), null where the counts are impossible; terms are added in logarithms, so that no binomial grows."""
    n, k, d, x = (c.cast("long") for c in (population, positives, drawn, hits))
    low, high = F.greatest(x, d - (n - k)), F.least(k, d)
    whole = _log_choose(n, d)
    term = lambda i: F.exp(_log_choose(k, i) + _log_choose(n - k, d - i) - whole)
    total = F.aggregate(F.sequence(low, high), F.lit(0.0), lambda acc, i: acc + term(i))
    possible = (F.least(n, k, d, x) >= 0) & (k <= n) & (d <= n)
    return F.when(possible, F.when(low > high, F.lit(0.0)).otherwise(F.least(F.lit(1.0), total)))


def bonferroni(p: Column, tests: Column) -> Column:
    return F.least(F.lit(1.0), p * tests)


def compare_intents(df: DataFrame, expected: str, modes: Sequence[str], available: Column, names: Mapping[str, str] = MODE_COLUMNS) -> DataFrame:
    """Score, rank, shift and priority of the expected intent, the best other score, their margin, whether the
    expected one is ahead, and the best score of controls (expected ``none``).

    ``names`` gives a mode's columns, with ``{}`` for the mode. Without a prediction all are null.
    """
    column = lambda what, mode: F.col(names[what].format(mode))
    score = {m: F.coalesce(column("score", m), F.lit(0.0)) for m in modes}
    control = F.col(expected) == NONE
    own = lambda values: F.when(available & ~control, _choose(F.col(expected), values))
    others = F.when(available, F.when(control, F.greatest(*score.values())).otherwise(_choose(F.col(expected), {m: F.greatest(*(c for o, c in score.items() if o != m)) for m in modes})))
    with_scores = df.withColumns({
        "expected_score": own(score), "best_other": others,
        "expected_rank": own({m: column("rank", m) for m in modes}), "expected_shift": own({m: column("shift", m) for m in modes}),
        "expected_priority": F.coalesce(own({m: column("priority", m) for m in modes}), F.lit("")),
        "control_score": F.when(available & control, F.greatest(*score.values())),
    })
    margin = F.col("expected_score") - F.col("best_other")
    return with_scores.withColumns({"margin": margin, "is_top": F.coalesce(margin > 0, F.lit(False)) & ~control})


def _choose(key: Column, values: Mapping[str, Column]) -> Column:
    chain = None
    for name, value in values.items():
        chain = F.when(key == name, value) if chain is None else chain.when(key == name, value)
    return chain


def acceptable(predicted: Column, expected: Column, accepted: Column) -> Column:
    """Whether a prediction will do: one of the accepted intents; ``none`` for a control; never a missing one."""
    return F.when(predicted == MISSING, False).when(expected == NONE, predicted == NONE).otherwise(F.coalesce(F.array_contains(accepted, predicted), F.lit(False)))


def all_not_prioritized(priorities: Sequence[Column]) -> Column:
    """Whether every priority is blank or ``not prioritized``."""
    return F.forall(F.array(*(F.coalesce(F.lower(F.trim(p)), F.lit("")) for p in priorities)), lambda p: p.isin("", "not prioritized"))


def benchmark_predictions(benchmark: DataFrame, ranked: DataFrame, key: str, modes: Sequence[str], threshold: float = LOW, names: Mapping[str, str] = MODE_COLUMNS) -> DataFrame:
    """Every benchmark row with its prediction: the primary intent and score, whether they are right or
    acceptable, and the comparison of intents. ``benchmark`` has ``expected`` and ``accepted`` (an array)."""
    joined = benchmark.join(ranked.withColumn("available", F.lit(True)), key, "left").withColumn("available", F.coalesce("available", F.lit(False)))
    intent, best = primary_intent({m: F.col(names["score"].format(m)) for m in modes}, F.col("available"), threshold)
    low = all_not_prioritized([F.col(names["priority"].format(m)) for m in modes])
    predicted = F.when(F.col("available") & low, NONE).otherwise(intent)
    compared = compare_intents(joined.withColumns({"predicted": predicted, "predicted_score": best}), "expected", modes, F.col("available"), names)
    return compared.withColumns({"primary_correct": F.col("predicted") == F.col("expected"), "acceptable_correct": acceptable(F.col("predicted"), F.col("expected"), F.col("accepted"))})


def intent_metrics(predictions: DataFrame, ks: Sequence[int] = (10,), digits: int = 4) -> DataFrame:
    """A row for each expected intent, controls (``none``) included: coverage, accuracies, reciprocal ranks,
    means of rank, shift, score and margin, specificity, hits and recall among the first k."""
    n, covered = F.count(F.lit(1)).cast("double"), F.col("available")
    n_covered = F.count_if(covered).cast("double")
    mean = lambda c: F.avg(F.when(covered, c))
    flag = lambda c: F.coalesce(F.try_divide(F.count_if(covered & F.col(c)).cast("double"), n_covered), F.lit(0.0))
    control = F.col("expected") == NONE
    rank = F.col("expected_rank")
    own = lambda c: F.when(F.first("expected") != NONE, c)
    out = {
        "expected_count": F.count(F.lit(1)), "covered_count": F.count_if(covered), "coverage": n_covered / n,
        "primary_accuracy": flag("primary_correct"), "acceptable_accuracy": flag("acceptable_correct"),
        "mrr_all": own(F.avg(F.coalesce(F.try_divide(F.lit(1.0), rank), F.lit(0.0)))), "mrr_covered": own(F.coalesce(F.avg(F.when(covered, F.try_divide(F.lit(1.0), rank))), F.lit(0.0))),
        "mean_rank": own(mean(rank)), "mean_shift": own(mean(F.col("expected_shift"))), "mean_score": own(mean(F.col("expected_score"))), "mean_margin": own(mean(F.col("margin"))),
        "specificity": own(flag("is_top")), "mean_control_score": F.avg(F.when(covered & control, F.col("control_score"))),
    }
    for k in ks:
        hits = F.count_if(F.coalesce(rank <= k, F.lit(False)))
        inside = F.count_if(covered & F.coalesce(rank <= k, F.lit(False))).cast("double")
        out |= {f"hits_{k}": own(hits), f"recall_{k}_all": own(hits / n), f"recall_{k}_covered": own(F.coalesce(F.try_divide(inside, n_covered), F.lit(0.0)))}
    counts = {"expected_count", "covered_count", *(f"hits_{k}" for k in ks)}
    return predictions.groupBy("expected").agg(*((c if name in counts else F.round(c, digits)).alias(name) for name, c in out.items()))


def benchmark_summary(predictions: DataFrame, retrieved: Column, ks: Sequence[int] = (10,), digits: int = 4) -> DataFrame:
    """One row: coverage, accuracy of intents over all and covered rows, specificity, controls, and the mean over intents
    of reciprocal ranks and recalls."""
    covered, control = F.col("available"), F.col("expected") == NONE
    n, n_covered = F.count(F.lit(1)).cast("double"), F.count_if(covered).cast("double")
    share = lambda hit, of: F.try_divide(F.count_if(hit).cast("double"), F.count_if(of).cast("double"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    whole = predictions.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(covered).alias("n_covered"), F.count_if(~covered).alias("n_missing"), zero(F.try_divide(n_covered, n)).alias("coverage"),
        zero(F.try_divide(F.count_if(covered & retrieved).cast("double"), n)).alias("retrieval_coverage"),
        zero(share(F.col("primary_correct"), F.lit(True))).alias("primary_accuracy_all"), zero(share(covered & F.col("primary_correct"), covered)).alias("primary_accuracy_covered"),
        zero(share(F.col("acceptable_correct"), F.lit(True))).alias("acceptable_accuracy_all"), zero(share(covered & F.col("acceptable_correct"), covered)).alias("acceptable_accuracy_covered"),
        zero(share(covered & ~control & F.col("is_top"), covered & ~control)).alias("specificity_covered"),
        share(covered & control & (F.col("predicted") == NONE), covered & control).alias("controls_not_prioritized"), F.avg(F.when(covered & control, F.col("control_score"))).alias("mean_control_score"),
    )
    rows = intent_metrics(predictions, ks, digits).where(F.col("expected") != NONE)
    means = rows.agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c}") for c in ["mrr_all", "mrr_covered", *(f"recall_{k}_{w}" for k in ks for w in ("all", "covered"))]))
    joined = whole.join(F.broadcast(means), how="left")
    counts = {"n", "n_covered", "n_missing"}
    return joined.select(*(F.col(c) if c in counts else F.round(c, digits).alias(c) for c in joined.columns))


def deltas(df: DataFrame, metrics: Sequence[str], baseline: str = "baseline_{}", scenario: str = "scenario_{}", delta: str = "delta_{}") -> DataFrame:
    """Scenario minus baseline of every metric; null where either is."""
    return df.withColumns({delta.format(m): F.col(scenario.format(m)) - F.col(baseline.format(m)) for m in metrics})


def _scenario_aggregates(scenario: str, ks: Sequence[int], changes: Sequence[str], digits: int) -> list[Column]:
    out = {
        "n_scenarios": F.count(F.lit(1)), "min_spearman": F.min("spearman"), "mean_spearman": F.avg("spearman"), "worst_scenario": F.min_by(scenario, F.struct("spearman", scenario)),
        "max_mean_change": F.max("mean_change"), "max_change": F.max("max_change"),
    } | {f"max_abs_{c}": F.max(F.abs(c)) for c in changes}
    for k in ks:
        out |= {f"min_jaccard_{k}": F.min(f"jaccard_{k}"), f"mean_jaccard_{k}": F.avg(f"jaccard_{k}"), f"min_retention_{k}": F.min(f"retention_{k}")}
    exact = {"n_scenarios", "worst_scenario", "max_change"}
    return [(c if name in exact else F.round(c, digits)).alias(name) for name, c in out.items()]


def aggregate_scenarios(df: DataFrame, by: Sequence[str], scenario: str, ks: Sequence[int], changes: Sequence[str] = (), digits: int = 4) -> DataFrame:
    """Stability of groups of scenarios: counts, least and mean correlation, the first scenario with the least, the
    largest rank changes and absolute deltas, least and mean overlaps of the first k."""
    return df.groupBy(*by).agg(*_scenario_aggregates(scenario, ks, changes, digits))


def aggregate_levels(df: DataFrame, outer: str, inner: str, scenario: str, ks: Sequence[int], changes: Sequence[str] = (), digits: int = 4) -> DataFrame:
    """``aggregate_scenarios`` by (outer, inner) and by outer alone in one grouping-sets pass; ``level`` names the finer key
    of a row, and the inner key of the outer level is null."""
    found = df.groupingSets([[outer, inner], [outer]], outer, inner).agg(F.grouping(inner).alias("__whole"), *_scenario_aggregates(scenario, ks, changes, digits))
    return found.withColumn("level", F.when(F.col("__whole") == 1, outer).otherwise(inner)).drop("__whole")


def scenario_accuracy(scores: DataFrame, expected: DataFrame, modes: Sequence[str], key: str, base: str) -> DataFrame:
    """(profile, scenario, baseline_accuracy, scenario_accuracy, delta_accuracy): how right the primary intent is when one
    profile's scores are those of a scenario and the others' are as they are. ``scores`` is (profile, scenario, key, score)."""
    plain = scores.where(F.col("scenario") == base).groupBy(key).agg(*(F.max(F.when(F.col("profile") == m, F.col("score"))).alias(f"__{m}") for m in modes))
    joined = scores.join(plain, key).join(expected, key)
    intent, _ = primary_intent({m: F.when(F.col("profile") == m, F.col("score")).otherwise(F.col(f"__{m}")) for m in modes}, F.lit(True))
    by = joined.groupBy("profile", "scenario").agg((F.count_if(intent == F.col("expected")).cast("double") / F.count(F.lit(1)).cast("double")).alias("scenario_accuracy"))
    own = Window.partitionBy("profile")  # a row for each scenario
    rows = by.withColumn("baseline_accuracy", F.max(F.when(F.col("scenario") == base, F.col("scenario_accuracy"))).over(own)).where(F.col("scenario") != base)
    return deltas(rows, ["accuracy"]).select("profile", "scenario", "baseline_accuracy", "scenario_accuracy", "delta_accuracy")


def summarize_targets(df: DataFrame, by: Sequence[str], ks: Sequence[int], digits: int = 4) -> DataFrame:
    """Over all scenarios of an entity: its base rank and score, best, worst and mean rank, mean and largest changes of rank
    and score, and how often it is among the first k. A row is (by, base_rank, base_score, rank, score)."""
    moved, change = F.abs(F.col("rank") - F.col("base_rank")), F.abs(F.col("score") - F.col("base_score"))
    out = {
        "base_rank": F.min("base_rank"), "base_score": F.min("base_score"), "n_scenarios": F.count(F.lit(1)), "min_rank": F.min("rank"), "max_rank": F.max("rank"), "mean_rank": F.avg("rank"),
        "mean_change": F.avg(moved), "max_change": F.max(moved), "mean_score_change": F.avg(F.round(change, 12).cast("decimal(20,12)")).cast("double"), "max_score_change": F.max(change),
    }
    for k in ks:
        out |= {f"base_top_{k}": F.min("base_rank") <= k, f"top_{k}_rate": F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0))}
    exact = {"base_rank", "n_scenarios", "min_rank", "max_rank", "max_change", *(f"base_top_{k}" for k in ks)}
    return df.groupBy(*by).agg(*((c if name in exact else F.round(c, digits)).alias(name) for name, c in out.items()))


#: Labels that go to all tasks; more are joined without a hint.
MOST_LABELS = 10_000


def role_confusion(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    """(expected, predicted, n) over the union of labels on both sides, zeros filled in."""
    pairs = df.groupBy(F.col(expected).alias("expected"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    labels = pairs.select(F.col("expected").alias("label")).union(pairs.select("predicted")).distinct()
    labels = cut_lineage(labels)  # the result has a row for each pair of labels
    other = labels.select(F.col("label").alias("predicted"))
    grid = labels.select(F.col("label").alias("expected")).join(F.broadcast(other) if labels.count() <= MOST_LABELS else other)
    return grid.join(pairs, ["expected", "predicted"], "left").select("expected", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def union_of_tops(tops: Sequence[DataFrame], key: str, place: str) -> DataFrame:
    """Keys of several ordered top lists, in the order in which they first appear, with that order."""
    marked = None
    for k, top in enumerate(tops):
        part = top.select(key, F.struct(F.lit(k).alias("list"), F.col(place).alias("place")).alias("seen"))
        marked = part if marked is None else marked.unionByName(part)
    first = marked.groupBy(key).agg(F.min("seen").alias("seen"))
    return first.select(key, F.row_number().over(Window.orderBy("seen", key)).cast("long").alias("position"))
