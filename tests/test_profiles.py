"""Target profiles and ranking metrics, with numbers worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from loomwork.operators import evaluate, matrix, profiles, ranking


def one(df, **where):
    for k, v in where.items():
        df = df.where(F.col(k) == v)
    (row,) = df.collect()
    return row


def test_unranked_positives_keep_their_share(spark):
    """Ranks 5 and 12 of three positives, 9 of the negative; the first two places are 5 and 9."""
    rows = [("d", 5, "p"), ("d", 9, "n"), ("d", 12, "p"), ("d", None, "p"), ("h", None, "p"), ("h", 3, "other")]
    df = spark.createDataFrame(rows, "part string, r long, class string")
    found = evaluate.ranking_metrics(evaluate.with_combined(df, "part"), "r", F.col("class") == "p", ["part"], [2, 5], F.col("class") == "n")
    m = one(found, part="d")
    assert (m.n, m.n_ranked, m.n_positive, m.n_negative, m.coverage) == (4, 3, 3, 1, 0.75)
    assert m.recall_2 == pytest.approx(1 / 3) and m.average_precision == pytest.approx((1 + 2 / 3) / 3)
    assert (m.reciprocal_rank, m.median_rank, m.precision_2, m.positive_2, m.negative_2, m.excluded_2) == (0.2, 8.5, 0.5, 1, 1, 0.0)
    assert m.normalized_median_rank == pytest.approx(8.5 / 3) and m.recall_5 == pytest.approx(2 / 3) and m.precision_5 == pytest.approx(2 / 3)
    h = one(found, part="h")
    assert (h.n, h.n_ranked, h.n_positive, h.coverage, h.recall_2, h.average_precision) == (1, 0, 1, 0.0, 0.0, 0.0)
    assert h.reciprocal_rank is h.median_rank is h.normalized_median_rank is h.precision_2 is h.excluded_2 is None
    assert one(found, part="combined").n == 5 and evaluate.ranking_metrics(df.limit(0), "r", F.lit(True), ["part"], [1]).count() == 0


def test_position_is_highest_for_the_most_negative_median(spark):
    df = spark.createDataFrame([("skin", -2.0), ("lung", -1.0), ("bone", 0.0), ("eye", -1.0), ("few", None)], "line string, effect double")
    places = {r.line: r.position for r in matrix.position(df.where("line <> 'eye'"), "line", "effect").collect()}
    assert places == {"skin": 100.0, "lung": 50.0, "bone": 0.0}
    assert {r.line: r.position for r in matrix.position(df, "line", "effect").collect()}["lung"] == 50.0
    assert {r.position for r in matrix.position(df, "line", "effect", least_groups=5).collect()} == {None}


MODELS = [("m1", True, "skin"), ("m2", True, "skin"), ("m3", False, "lung"), ("m4", False, "lung"), ("m5", False, ""), ("m6", False, None)]
CELLS = [("A", "m1", -1.0, 0.9), ("A", "m2", -0.5, None), ("A", "m3", 0.0, 0.2), ("A", "m4", 0.5, 0.4), ("A", "m5", float("nan"), 0.1), ("A", "unknown", -9.0, 1.0), ("B", "m3", 0.1, None), ("C", "m1", None, None)]


def profile(spark, policy, models=MODELS):
    cells = spark.createDataFrame(CELLS, "t string, m string, e double, p double")
    models = spark.createDataFrame(models, "m string, inside boolean, line string")
    targets = spark.createDataFrame([("A", True), ("B", True), ("C", True), ("D", False)], "t string, resolved boolean")
    return {r.t: r for r in profiles.profiles(targets, cells, models, "t", "m", "e", "p", "inside", "line", policy).collect()}


def test_profile_of_each_target(spark):
    found = profile(spark, profiles.Policy((0.5,), 1, 1, 2, 2))
    a = found["A"]
    assert (a.e_context.n_models, a.e_context.n, a.e_context.median, a.e_non_context.n, a.e_non_context.n_missing, a.e_pan_cancer.n) == (2, 2, -0.75, 2, 2, 4)
    assert (a.p_context.n, a.p_context.p_fraction_0, a.p_non_context.p_fraction_0) == (1, 1.0, 0.0)
    assert a.e_median_minus_non_context == -1.0 and a.e_mean_minus_non_context == -1.0 and math.isclose(a.e_median_minus_pan_cancer, -0.5)
    assert math.isclose(a.p_median_minus_non_context, 0.7) and a.p_fraction_0_minus_non_context == 1.0 and math.isclose(a.p_fraction_0_minus_pan_cancer, 0.75)
    assert [(x.lineage, x.measure, x.n, x.n_models, x.enough) for x in a.lineages] == [("lung", "e", 2, 2, True), ("lung", "p", 2, 2, True), ("metadata_missing", "p", 1, 2, True), ("skin", "e", 2, 2, True), ("skin", "p", 1, 2, True)]
    assert (a.context_lineage, a.n_eligible_lineages, a.lineage_position, a.coverage_state) == ("skin", 2, 100.0, "sufficient_complete_coverage")
    b = found["B"]
    assert b.e_context is None and b.e_median_minus_non_context is None and b.lineage_position is None and b.coverage_state == "insufficient_measured_context_models"
    assert found["C"].coverage_state == "insufficient_measured_context_models" and found["D"].coverage_state == "target_unresolved" and found["D"].n_eligible_lineages == 0


def test_position_needs_one_lineage_and_enough_of_them(spark):
    assert profile(spark, profiles.Policy((), 1, 1, 2, 3))["A"].lineage_position is None
    assert profile(spark, profiles.Policy((), 1, 1, 3, 1))["A"].n_eligible_lineages == 0
    mixed = [("m1", True, "skin"), ("m2", True, "lung"), *MODELS[2:]]
    assert profile(spark, profiles.Policy((), 1, 1, 1, 1), mixed)["A"].context_lineage is None
    none = profile(spark, profiles.Policy((), 1, 1, 1, 1), [(m, False, line) for m, _, line in MODELS])
    assert none["A"].coverage_state == "no_context_models"
    short = profile(spark, profiles.Policy((), 3, 1, 1, 1))["A"]
    assert short.e_median_minus_non_context is None and short.e_context.median == -0.75 and short.coverage_state == "insufficient_measured_context_models"


def test_levels_come_from_one_expand(spark):
    df = spark.createDataFrame([("p", w, f"{w}|{d}", 0.9 + k / 100, 1.0, 2, 0.5, 0.5) for k, (w, d) in enumerate((w, d) for w in "ab" for d in ("up", "down"))], "profile string, weight string, scenario string, spearman double, mean_change double, max_change long, jaccard_5 double, retention_5 double")
    found = evaluate.aggregate_levels(df, "profile", "weight", "scenario", [5])
    assert sorted((r.level, r.weight or "", r.n_scenarios, r.worst_scenario) for r in found.collect()) == [("profile", "", 4, "a|up"), ("weight", "a", 2, "a|up"), ("weight", "b", 2, "b|up")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1
    cells, models = spark.createDataFrame(CELLS, "t string, m string, e double, p double"), spark.createDataFrame(MODELS, "m string, inside boolean, line string")
    assert profiles.summaries(cells, models, "t", "m", ["e", "p"], "inside", "line").count() == 12 + 2


def test_quantiles_of_counts_equal_those_of_rows(spark):
    df = spark.range(2000).select((F.col("id") % 3).alias("g"), F.pmod(F.hash("id"), F.lit(97)).cast("double").alias("v"))
    shares = {"a": 0.1, "b": 0.5}
    counts = df.groupBy("g", F.col("v").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    assert sorted(map(tuple, ranking.quantiles(df, ["g"], "v", shares).collect())) == sorted(map(tuple, ranking.quantiles_of_counts(counts, ["g"], shares).collect()))
