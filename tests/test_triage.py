import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomwork import functions as fn
from loomwork.operators import claims, evaluate, evidence, feasibility, matrix, ranking, rules, scoring, universe


def test_priority_labels(spark):
    df = spark.createDataFrame([(x,) for x in (0.90, 0.70, 0.69, 0.45, 0.11, 0.10, 0.0, float("nan"), None)], "s double")
    got = [r[0] for r in df.select(fn.priority_label(F.col("s"))).collect()]
    assert got == ["high", "high", "medium", "medium", "low"] + ["not prioritized"] * 4


def test_coercion(spark):
    df = spark.createDataFrame([(" 1e3 ",), ("x",), (None,), ("NaN",), (" Yes\t",)], "v string")
    v = F.col("v")
    rows = df.select(fn.safe_double(v, 0.5).alias("d"), fn.safe_bool(v).alias("b"), fn.safe_str(v).alias("s"), fn.is_missing(v).alias("m"), fn.normalize_symbol(v).alias("n")).collect()
    assert [r.d for r in rows] == [1000.0, 0.5, 0.5, 0.5, 0.5]
    assert [r.b for r in rows] == [False] * 4 + [True]
    assert [r.s for r in rows] == ["1e3", "x", "", "", "Yes"]
    assert [r.m for r in rows] == [False, False, True, True, False] and rows[4].n == "YES"


def test_labels_and_paths(spark):
    df = spark.createDataFrame([("AAA (1)",), ("AAA",), ("1A (2)",), (None,)], "v string")
    assert [tuple(r) for r in df.select(*fn.parse_label(F.col("v"))).collect()] == [("AAA", "1", "resolved"), ("AAA", None, "unresolved_format"), (None, None, "malformed"), (None, None, "malformed")]
    paths = spark.createDataFrame([("a/b.txt",), ("/a",), ("a/../b",), ("s3:b",), (None,)], "v string")
    assert [r[0] for r in paths.select(fn.safe_release_path(F.col("v"))).collect()] == [True, False, False, False, False]


def test_text(spark):
    row = spark.createDataFrame([('a  "b" \\', "Not stupid. Clearly good! <x>",)], "q string, t string").select(
        fn.phrase(F.col("q")).alias("p"), fn.and_query(F.col("q"), F.lit(" "), F.lit("c")).alias("w"), fn.unnegated_markers(F.col("t"), ["stupid", "good"], ["not "]).alias("m"), fn.word_count(F.col("t")).alias("n"), fn.escape_html(F.col("t")).alias("h")
    ).first()
    assert row.p == '"a \\"b\\" \\\\"' and row.w == row.p + ' AND "c"' and row.m == ["good"] and row.n == 5 and row.h.endswith("&lt;x&gt;")


def test_ranks_and_shift(spark):
    df = spark.createDataFrame([("LOW", 0.20, 0.50, True), ("HIGH", 0.80, 0.50, True), ("BEST", 0.50, 0.90, True), ("Z", 0.0, 0.10, False)], "k string, b double, s double, e boolean")
    got = {r.k: (r.baseline_rank, r["rank"], r.rank_shift) for r in ranking.intent_ranking(df, "s", "b", F.col("e"), "k").collect()}
    assert got == {"BEST": (2, 1, 1), "HIGH": (1, 2, -1), "LOW": (3, 3, 0), "Z": (None, 4, None)}


def test_global_row_number(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v"), F.lit("x").alias("rank_of")).repartition(5)
    got = ranking.global_row_number(df, [F.desc("v")]).collect()
    assert [r["rank"] for r in sorted(got, key=lambda r: -r.v)] == list(range(1, 5001))
    assert ranking.global_row_number(df.limit(0), [F.asc("v")]).count() == 0


def test_midrank(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", 1.0), ("d", None)], "k string, v double")
    assert {r.k: r.percentile for r in ranking.midrank_percentile(df, "v").collect()} == {"a": 1.0, "b": 0.25, "c": 0.25, "d": None}
    assert ranking.midrank_percentile(df.where("k = 'a'"), "v").first().percentile == 1.0


@pytest.mark.parametrize(("rows", "band", "want"), [
    ([("a", 1, 0.1), ("b", 2, 0.9), ("c", 3, None), ("d", 4, 0.8)], 2, {"a": 2, "b": 1, "c": 3, "d": 4}),
    ([("a", 5, 0.2), ("b", 42, 0.1), ("c", 47, 0.9), ("d", 132, 0.8)], 50, {"a": 42, "b": 47, "c": 5, "d": 132}),
])
def test_bounded_overlay(spark, rows, band, want):
    df = spark.createDataFrame(rows, "k string, base long, signal double")
    assert {r.k: r.overlay_rank for r in ranking.bounded_overlay(df, "base", "signal", "k", band).collect()} == want


def test_stability(spark):
    df = spark.createDataFrame([("s", 1, 1), ("s", 2, 3), ("s", 3, 2), ("s", 4, 4)], "g string, a long, b long")
    r = ranking.rank_stability(df, ["g"], "a", "b", [2, 3]).first()
    assert math.isclose(r.spearman, 0.8) and (r.mean_change, r.max_change, r.retention_2, r.jaccard_3) == (0.5, 1, 0.5, 1.0) and math.isclose(r.jaccard_2, 1 / 3)


def test_augment(spark):
    base = spark.createDataFrame([("AAA", 0.4, "D1")], "symbol string, score double, disease string")
    required = spark.createDataFrame([(" b2m ",), ("B2M",), ("tap1",), ("aaa",), (None,)], "s string")
    rows = {r.symbol: r for r in universe.augment(base, required, "symbol", "score").collect()}
    assert set(rows) == {"AAA", "B2M", "TAP1"} and rows["B2M"].score == 0.0 and not rows["TAP1"].has_evidence and rows["AAA"].has_evidence


def test_intent(spark):
    df = spark.createDataFrame([(0.20, 0.82, 0.10, True), (0.05, 0.08, 0.10, True), (0.5, 0.5, 0.1, True), (0.9, 0.9, 0.9, False)], "a double, b double, c double, ok boolean")
    intent, value = evaluate.primary_intent({k: F.col(k) for k in "abc"}, F.col("ok"))
    assert [tuple(r) for r in df.select(intent, value).collect()] == [("b", 0.82), ("none", 0.10), ("a", 0.5), (evaluate.MISSING, 0.0)]


def test_rank_metrics_and_tail(spark):
    df = spark.createDataFrame([("x", 1, True), ("x", 2, False), ("x", 3, True)], "g string, r long, p boolean")
    m = evaluate.ranking_metrics(df, "r", F.col("p"), ["g"], [2]).first()
    assert math.isclose(m.average_precision, 5 / 6) and (m.recall_2, m.precision_2, m.reciprocal_rank, m.median_rank) == (0.5, 0.5, 1.0, 2.0)
    t = spark.createDataFrame([(3, 2, 2, 1), (2, 3, 1, 1)], "n long, k long, d long, x long")
    tail = evaluate.hypergeometric_tail(*(F.col(c) for c in "nkdx"))
    assert [r[0] for r in t.select(F.round(tail, 12)).collect()] == [1.0, None]
    cases = [(n, k, d, x) for n, k, d in ((30, 7, 11), (500, 40, 90), (5000, 1200, 300)) for x in (0, 1, 5, 7, 20, 80, 100)]
    want = [sum(math.comb(k, i) * math.comb(n - k, d - i) for i in range(max(x, d - (n - k)), min(k, d) + 1)) / math.comb(n, d) for n, k, d, x in cases]
    got = [r[0] for r in spark.createDataFrame(cases, "n long, k long, d long, x long").coalesce(1).select(tail).collect()]
    assert all(math.isclose(a, b, rel_tol=1e-8, abs_tol=1e-300) for a, b in zip(got, want, strict=True))


def test_matrix_profiles(spark):
    values = [-0.5, -0.6, -0.4, -0.2, -0.1, -0.3, -0.8]
    df = spark.createDataFrame([(k + 1, v, p) for k, (v, p) in enumerate(zip(values, [0.9, 0.8, 0.7, None, 0.6, 0.5, 0.4], strict=True))], "m int, effect double, p double").withColumn("g", F.lit("x"))
    inside = matrix.summarize(df.where("m <= 3"), ["g"], "p", [0.5, 0.8]).first()
    assert inside.fraction_0 == 1.0 and math.isclose(inside.fraction_1, 2 / 3)
    out = matrix.summarize(df.where("m > 3"), ["g"], "p", [0.5]).first()
    assert math.isclose(out.fraction_0, 2 / 3) and (out.n, out.n_missing) == (3, 1)
    c = matrix.contrast(df, ["g"], F.col("m") <= 3, "effect", 2, 1).first()
    assert c.median_in == -0.5 and math.isclose(c.difference, -0.25)
    wide = spark.createDataFrame([("a", "1", None), ("b", "x", "2")], "id string, `AAA (1)` string, `B` string")
    assert sorted((r.id, r.label, r.value) for r in matrix.to_long(wide, "id").collect() if r.value is not None) == [("a", "AAA (1)", 1.0), ("b", "B", 2.0)]


def test_context(spark):
    rows = [(1, {"l": "skin"}), (2, {"l": "lung"}), (3, {"l": ""}), (4, None), (5, {"l": "skin"}), (6, {"l": "skin"}), (7, {"l": "eye", "s": "no"}), (8, {"l": "bone", "s": "no"}), (9, {"l": "bone"}), (10, {"l": "eye"})]
    df = spark.createDataFrame(rows, "id int, m map<string,string>").coalesce(1)
    context = matrix.Context([2], [5], {"l": ["skin", "eye"]}, {"s": ["no"]})
    found = matrix.assign_context(context, F.col("id"), F.col("m"), F.lit(True), F.col("id") != 6)
    got = [tuple(r) for r in df.select(*found).collect()]
    assert [r[0] for r in got] == ["in_context", "explicitly_included", "missing_required_metadata", "metadata_unavailable", "explicitly_excluded", "model_not_reconciled", "ambiguous_context", "out_of_context", "out_of_context", "in_context"]
    assert got[0][1:] == ("l", "skin") and got[6][1:] == got[7][1:] == ("s", "no") and got[2][1:] == ("l", None) and got[8][1:] == (None, None)


def test_families_along_lineage(spark):
    items = spark.createDataFrame([("a", "C1", None, None), ("b", "unknown", "s", "7"), ("c", None, None, None), ("d", None, None, None), ("x", None, None, None), ("y", None, None, None), ("z", "n/a", None, None)], "id string, cohort string, src string, sid string")
    items = evidence.own_family(items, ["cohort"], "src", "sid")
    edges = spark.createDataFrame([("c", "a"), ("d", "c"), ("d", "b"), ("x", "y"), ("y", "x")], "child string, parent string")
    got = {r.id: r.assigned_family for r in evidence.inherited_family(items, edges, "id", "family").collect()}
    assert got == {"a": "cohort:C1", "b": "source:s:7", "c": "cohort:C1", "d": "composite:cohort:C1+source:s:7", "x": None, "y": None, "z": None}
    chain = spark.createDataFrame([(k + 1, k) for k in range(40)], "child int, parent int")
    assert {r.root for r in evidence.lineage_roots(chain).collect()} == {0}


def test_appends(spark):
    store = spark.createDataFrame([("k1", "h1", "b1"), ("k2", "h2", "b2")], "k string, h string, b string")
    new = spark.createDataFrame([("k1", "h1", "b1"), ("k3", "h1", "other"), ("k2", "h9", "b9"), ("k4", "h4", "b4"), ("k5", "h4", "b4")], "k string, h string, b string")
    got = {r.k: r.outcome for r in evidence.classify_append(new, store, "k", "h", "b").collect()}
    assert got == {"k1": "duplicate", "k3": "collision", "k2": "rejected_mutation", "k4": "new", "k5": "duplicate"}


def test_appends_within_a_batch(spark):
    none = spark.createDataFrame([], "k string, h string, b string")
    rows = [("m", "h1", "x"), ("m", "h2", "y"), ("p", "h3", "x"), ("q", "h3", "y"), ("r", "h4", "z"), ("r", "h4", "z"), ("s", None, "z"), ("t", None, "z")]
    got = Counter((r.k, r.h, r.outcome) for r in evidence.classify_append(spark.createDataFrame(rows, none.schema), none, "k", "h", "b").collect())
    assert got == Counter({("m", "h1", "new"): 1, ("m", "h2", "rejected_mutation"): 1, ("p", "h3", "new"): 1, ("q", "h3", "collision"): 1, ("r", "h4", "new"): 1, ("r", "h4", "duplicate"): 1, ("s", None, "new"): 1, ("t", None, "new"): 1})
    audit = evidence.append_audit(evidence.classify_append(spark.createDataFrame(rows, none.schema), none, "k", "h", "b"), "k", "h", 5).collect()
    assert sorted(r.event_id for r in audit) == [5, 6, 7]


def test_duplicates_without_digest(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, None)], "id int, h string")
    got = {r.id: (r.first_key, r.n_same, r.is_duplicate) for r in evidence.exact_duplicates(df, "h", "id").collect()}
    assert got == {1: (1, 2, False), 3: (1, 2, True), 2: (None, None, False), 4: (None, None, False)}


def test_cycles_and_long_chains(spark):
    edges = spark.createDataFrame([(f"n{k + 1}", f"n{k}") for k in range(256)] + [("x", "y"), ("y", "x"), ("below", "x")], "child string, parent string")
    assert evidence.lineage_roots(edges).count() == 257
    assert {r.node for r in evidence.rootless(edges).collect()} == {"x", "y", "below"}


def test_rules(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "s string, n int")
    table = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early")], "s string, priority int, role string")
    assert {r.n: r.role for r in rules.rule_table(df, table, "s", ["role"], {"role": "none"}).collect()} == {1: "early", 2: "none", 3: "none"}
    found = rules.issues(df, {"blank": F.col("s").isNull(), "large": F.col("n") > 1}, "n").collect()
    assert sorted((r.n, r.issue) for r in found) == [(2, "large"), (3, "blank"), (3, "large")]


def test_scoring_scenarios(spark):
    p = scoring.Profile("p", {"baseline": 0.5, "axis": 0.5}, poor=-0.3)
    df = spark.createDataFrame([("a", 0.4, 0.8, "yes"), ("b", None, float("nan"), "no")], "k string, baseline double, axis_score double, poor_target string")
    assert [round(r.p_score, 9) for r in scoring.score(df, p).orderBy("k").collect()] == [0.3, 0.0]
    full = scoring.Profile("q", dict.fromkeys(scoring.COMPONENTS, 1 / 7))
    cases = scoring.scenarios([full], {"down": 0.8, "up": 1.2})
    assert len(cases) == 14 and all(math.isclose(sum(q.weights.values()), 1.0) for *_, q in cases)
    with pytest.raises(ValueError):
        scoring.normalized({"a": -1.0, "b": 2.0})


def test_feasibility(spark):
    rows = [("T1", [(("D", "d"), 2, "x")], [("l", "Small molecule ", True), ("l", "small molecule", False), ("l2", "SM", True), ("l3", "Other Clinical", True)], None), ("T2", [], None, [("e", "s")])]
    df = spark.createDataFrame(rows, feasibility.RECORD)
    got = {(r.target, r.dimension, r.modality): r.state for r in feasibility.coverage(feasibility.observations(df)).collect()}
    assert got == {("T1", "known_drug", None): "observed", ("T1", "tractability", "small_molecule"): "conflicting", ("T1", "tractability", "other_clinical"): "observed", ("T1", "tractability", None): "conflicting", ("T1", "safety", None): "not_available", ("T2", "known_drug", None): "observed", ("T2", "tractability", None): "not_available", ("T2", "safety", None): "observed"}


def test_claims(spark):
    docs = spark.createDataFrame([("d1", "alpha beta gamma"), ("d2", "x")], "doc_id string, source_text string")
    rows = [("c1", "d1", "may help", "beta", 6, 10, "supports"), ("c2", "d1", "t", "beta", 0, 4, "supports"), ("c3", "d1", "t", "delta", 0, 5, "supports"), ("c4", "d9", "t", "x", 0, 1, "supports"), ("c5", "d1", "take 5 mg", "beta", 6, 10, "maybe"), ("c6", "d1", "may help", "beta", 6, 10, "supports")]
    df = spark.createDataFrame(rows, "claim_id string, doc_id string, claim_text string, quoted_span string, quote_start int, quote_end int, stance string")
    got = Counter(r.rejection for r in claims.extract(df, docs).collect())
    assert got == Counter({None: 1, "offsets_mismatch": 1, "quote_not_in_source": 1, "document_missing": 1, "stance_unknown": 1, "claim_repeated": 1})
    audited = claims.audit(df, {"hedge": ("warning", ["may "]), "dose": ("blocker", [" mg"])})
    assert {r.claim_id: r.decision for r in audited.collect()}["c5"] == "block"
    assert {r.doc_id: r.decision for r in claims.roll_up(audited, docs).collect()} == {"d1": "block", "d2": "no_candidates"}
