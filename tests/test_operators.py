"""Operators against plain Python, and the cases that queries over the tables don't have."""

import hashlib
import json
import math
import random
from pathlib import Path
from statistics import median

import pytest
from pyspark.sql import functions as F

from loomwork import functions as fn
from loomwork.operators import claims, dependency, evaluate, feasibility, ranking, release, reports, rules, scoring, store, triage
from loomwork.plans import runs
from loomwork.sources import associations, ingest, loaders, matrices, sinks


def test_round_exactly(spark):
    rng = random.Random(1)
    values = [rng.random() for _ in range(2000)] + [k / 10000 + 0.00005 for k in range(0, 10000, 7)] + [0.5, 0.125, 2.5, -0.00005, -1.23455, 0.0, 1.0, 123.45675, 1e-9]
    for digits in (0, 3, 4, 6):
        got = spark.createDataFrame([(v,) for v in values], "x double").coalesce(1).select(fn.round_exactly(F.col("x"), digits)).collect()
        assert [r[0] for r in got] == [float(round(v, digits)) for v in values]


def test_text_functions(spark):
    row = spark.createDataFrame([(0.12345, "2024-01-02T03:04:05.5Z", "2024-01-02T03:04:05+02:00", [3, 1, 2], {"a": "1", "b": "2"}, '{"x":{"Secret_key":1},"y":[{"z":"q"}]}', "ENSG00000000001", "at /home/me/x token=abc\n now")], "x double, t string, u string, a array<int>, m map<string,string>, j string, g string, e string")
    c = F.col
    got = row.select(fn.fixed(c("x"), 3), fn.utc_text(fn.utc_instant(c("t"))), fn.utc_instant(c("u")), fn.canonical_unordered(c("a")), fn.allowed_entries(c("m"), ["b"]), fn.forbidden_names(c("j"), ["secret"]), fn.json_type(c("j")), fn.gene_id(c("g")), fn.percent(c("x")), fn.score_bar(c("x")), fn.sanitized_error(c("e")), fn.json_safe(F.lit(float("nan")))).first()
    assert tuple(got) == ("0.123", "2024-01-02T03:04:05.500000Z", None, "[1,2,3]", {"b": "2"}, ["Secret_key"], "object", True, 12, "#.........", "at [path] token=[hidden] now", None)


def test_ranks_by_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab") if rng.random() < 0.9 else None, rng.randint(0, 30) if rng.random() < 0.9 else None, k) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, v long, k long").repartition(7)
    unique = {r.k: r.rank for r in ranking.unique_rank(df, "v", "v", "k", by=["g"]).collect()}
    competition = {r.k: r.baseline_rank for r in ranking.competition_rank(df, "v", F.lit(True), by=["g"]).collect()}
    percentile = {r.k: r.percentile for r in ranking.midrank_percentile(df, "v", by=["g"]).collect()}
    for g in ("a", "b", None):
        own = [(v, k) for h, v, k in rows if h == g]
        order = sorted(own, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
        assert [unique[k] for _, k in order] == list(range(1, len(own) + 1))
        known = [v for v, _ in own if v is not None]
        for v, k in own:
            larger, ties = sum(x > v for x in known) if v is not None else 0, known.count(v)
            assert competition[k] == (None if v is None else larger + 1)
            assert percentile[k] is None if v is None else math.isclose(percentile[k], 1 - (larger + (ties - 1) / 2) / (len(known) - 1))
    top = ranking.top_ranked(df.withColumn("s", F.col("v") / 30), 5, "s", "s", "k").collect()
    assert [r.rank for r in sorted(top, key=lambda r: r["rank"])] == [1, 2, 3, 4, 5]


def test_quantiles(spark):
    rng = random.Random(5)
    rows = [(g, round(rng.uniform(-5, 5), 2) if rng.random() < 0.8 else None) for g in ("x", "y", "z", None) for _ in range(rng.randint(1, 60))]
    got = {r.g: r for r in ranking.quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v", {"m": 0.5, "q": 0.25}).collect()}
    for g in {g for g, _ in rows}:
        values = sorted(v for h, v in rows if h == g and v is not None)
        if values:
            at = 0.25 * (len(values) - 1)
            assert math.isclose(got[g].m, median(values)) and math.isclose(got[g].q, values[int(at)] + (values[math.ceil(at)] - values[int(at)]) * (at - int(at)))


def test_candidate_rankings_and_stability(spark):
    rng = random.Random(8)
    rows = [(k, k + 1, *(round(rng.uniform(-1, 1), 1) if rng.random() < 0.7 else None for _ in range(2))) for k in range(40)] + [(99, None, 0.1, 0.2)]
    df = spark.createDataFrame(rows, "id long, baseline_rank long, effect double, p double").repartition(4)
    got = {r.id: r for r in dependency.candidate_rankings(df, "id", {"effect": True, "p": False}, 2, 10).collect()}

    def percentiles(values):
        n = len(values)
        return {k: 1 - (sum(w > v for w in values.values()) + (list(values.values()).count(v) - 1) / 2) / (n - 1) for k, v in values.items()}

    e, p = percentiles({r[0]: -r[2] for r in rows if r[2] is not None}), percentiles({r[0]: r[3] for r in rows if r[3] is not None})
    signal = {r[0]: (e[r[0]] + p[r[0]]) / 2 for r in rows if r[0] in e and r[0] in p}
    assert all((got[r[0]].dependency_signal is None) == (r[0] not in signal) for r in rows)
    assert all(math.isclose(got[k].dependency_signal, v) for k, v in signal.items())
    ranked = sorted((r for r in rows if r[1]), key=lambda r: (r[0] not in signal, -round(signal.get(r[0], 0), 12), r[1]))
    assert [got[r[0]].dependency_only_rank for r in ranked] == list(range(1, 41)) and got[99].dependency_only_rank is None
    assert all((got[r[0]].bounded_overlay_rank - 1) // 10 == (r[1] - 1) // 10 for r in rows if r[1])
    full = spark.createDataFrame([(r.id, r.baseline_rank, r.dependency_only_rank) for r in got.values()], "id long, b long, c long")
    s = ranking.membership_changes(full, [], "b", "c", 10, 10).first()
    moved = [abs(r.baseline_rank - r.dependency_only_rank) for r in got.values() if r.baseline_rank]
    first = {r.id for r in got.values() if r.baseline_rank and r.dependency_only_rank <= 10}
    base = set(range(10))
    assert (s.shared, s.retained, s.added, s.removed, s.largest_change, s.median_change) == (40, len(first & base), len(first - base), len(base - first), max(moved), median(moved))
    assert s.band_violations == sum((r.baseline_rank - 1) // 10 != (r.dependency_only_rank - 1) // 10 for r in got.values() if r.baseline_rank)
    rows = dependency.ablations(df, "id", {"both": {"effect": True, "p": False}, "one": {"p": False}}, 1, 10).collect()
    assert {r.ablation for r in rows} == {"both", "one"} and all(r.eligible > 0 for r in rows)


def test_dependency_profile(spark):
    cells = [("t", m, e, p, m <= 3) for m, (e, p) in enumerate([(-1.2, 0.1), (-0.9, 0.9), (-1.0, None), (0.2, 0.95), (0.1, 0.2), (None, 0.3)], 1)]
    df = spark.createDataFrame(cells, "t string, m int, e double, p double, inside boolean")
    effect = dependency.profile_contrasts(dependency.group_summaries(df, "t", "e", F.col("inside")), "t", 2, 2)
    probability = dependency.profile_contrasts(dependency.group_summaries(df, "t", "p", F.col("inside"), [0.5]), "t", 2, 2, 1)
    r, q = effect.first(), probability.first()
    assert math.isclose(r.median_minus_non_context, -1.0 - 0.15) and math.isclose(r.mean_minus_pan_cancer, -3.1 / 3 - (-2.8 / 5)) and math.isclose(q.fraction_0_minus_non_context, 0.5 - 1 / 3)
    strict = dependency.profile_contrasts(dependency.group_summaries(df, "t", "e", F.col("inside")), "t", 4, 2).first()
    assert strict.median_minus_non_context is None
    pairs = dependency.heterogeneity(df, df, "t", "m", "e", "p")
    kinds = {r.m: r.type for r in dependency.discordant_models(pairs.where("m <= 4"), "e", "p", -0.8, 0.2, 0.9).collect()}
    assert kinds == {1: "strong_negative_gene_effect_low_probability", 4: "weak_gene_effect_high_probability"}
    status = dependency.reference_status(df.select("t").distinct(), df.select("t"), "t", F.lit(True), "valid")
    assert status.first().status == "explicitly_present" and dependency.reference_status(df.select("t"), df.select("t"), "t", F.lit(True), None).first().status == "reference_unavailable"
    found = {r.type for r in dependency.summary_contradictions(effect, probability, "t", status.withColumn("reference", F.lit("list"))).collect()}
    assert "optional_reference_membership_conflicts_with_descriptive_context_selectivity" in found
    n = {k: F.lit(v) for k, v in {"effect_context": 3, "effect_reference": 2, "probability_context": 2, "probability_reference": 3}.items()}
    state = lambda **x: spark.range(1).select(dependency.coverage_state(F.lit(x.get("resolved", True)), F.lit(True), F.lit(x.get("p", True)), F.lit(x.get("models", 3)), n | {k: F.lit(v) for k, v in x.get("n", {}).items()}, 2, 2)).first()[0]
    assert state() == "sufficient_complete_coverage" and state(p=False) == "sufficient_partial_coverage" and state(resolved=False) == "target_unresolved" and state(models=0) == "no_context_models"
    assert state(n={"effect_context": 0, "probability_context": 0}) == "context_models_all_values_missing" and state(n={"effect_context": 1, "probability_context": 1}) == "insufficient_measured_context_models"
    assert state(n={"effect_reference": 0, "probability_reference": 1}) == "insufficient_measured_reference_models"


def test_benchmark_reconciliation_and_gate(spark):
    benchmark = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C"), ("d", "D")], "id string, request string")
    base = spark.createDataFrame([("a", 1), ("b", 2)], "id string, baseline_rank int")
    profiles = spark.createDataFrame([("A", "A (1)"), ("x7", "C (2)")], "normalized string, label string")
    joined = dependency.reconcile_benchmark(benchmark, base, dependency.profile_keys(profiles, "normalized", "label"), "id", "request")
    assert {r.id: r.reconciliation_state for r in joined.collect()} == {"a": "ranked_and_profiled", "b": "ranked_not_profiled", "c": "profiled_not_ranked", "d": "unresolved_benchmark_target"}
    criteria = lambda a, b: spark.createDataFrame([("coverage", a, ">=", 0.5, True), ("violations", b, "==", 0.0, True)], "criterion string, observed double, op string, bound double, mandatory boolean")
    ladder = [(["coverage"], "blocked_insufficient_evidence"), ([], "blocked_policy_failure")]
    assert [dependency.gate(criteria(*x), ladder, "eligible").first().state for x in ((0.9, 0.0), (None, 0.0), (0.9, 2.0))] == ["eligible", "blocked_insufficient_evidence", "blocked_policy_failure"]
    rows = dependency.report_evidence(spark.createDataFrame([("a",), ("b",), ("c",)], "id string"), spark.createDataFrame([("a", 3, 1, -2), ("b", 2, 5, 1)], "id string, baseline_rank int, candidate_rank int, rank_delta int"), "id").collect()
    assert {r.id: r.issues for r in rows} == {"a": [], "b": ["rank_delta_mismatch"], "c": []}


def test_store_rules(spark):
    names = ["evidence_id", "source", "source_id", "publication_id", "quoted_span", "computed_support", "extraction_method", "evidence_type", "validation_status", "effect_size_metric", "uncertainty_metric", "patient_cohort_id", "experiment_id", "comparison", "endpoint", "model_system", "interpretation", "evidence_family", "evidence_family_basis", "independence_ineligibility_reason", "record_hash"]
    schema = ", ".join(f"{n} string" for n in names) + ", effect_size double, uncertainty double, extraction_confidence double, sample_size int, retrieved_at timestamp, derived_from array<string>, independence_eligible boolean, provenance array<struct<step_type:string,details:map<string,string>>>"
    good = dict.fromkeys(names) | {"evidence_id": "e1", "source": "s", "source_id": "1", "quoted_span": "q", "extraction_method": "manual", "evidence_type": "review", "validation_status": "manually_curated", "evidence_family": "f", "evidence_family_basis": "cohort", "effect_size": None, "uncertainty": None, "extraction_confidence": 0.5, "sample_size": 3, "retrieved_at": __import__("datetime").datetime(2024, 1, 1), "derived_from": [], "independence_eligible": True, "provenance": [("manual_review", {"curator_id": "c", "review_rationale": "r", "reviewed_source_material": "m"})]}
    bad = good | {"evidence_id": "e2", "source_id": "unknown", "effect_size": 1.0, "extraction_confidence": 2.0, "sample_size": 0, "record_hash": "XYZ", "evidence_type": "clinical_cohort", "provenance": [("manual_review", {"curator_id": "c"})], "derived_from": [" "], "independence_eligible": False}
    order = [f.split()[0] for f in schema.split(", ")]
    df = spark.createDataFrame([tuple(r[n] for n in order) for r in (good, bad)], schema)
    intrinsic = store.intrinsic_rules(["evidence_id", "source"], ["publication_id"], {"evidence_type": ["review", "clinical_cohort"]}, ["effect_size"])
    found = {(r.evidence_id, r.field) for r in store.issue_rows(df, "evidence_id", intrinsic + store.semantic_rules()).collect()}
    assert found == {("e2", f) for f in ("extraction_confidence", "sample_size", "record_hash", "derived_from", "evidence_family", "evidence_family_basis", "independence_ineligibility_reason", "source_id", "provenance", "effect_size_metric", "patient_cohort_id")}
    assert store.finalizable(df, store.issue_rows(df, "evidence_id", intrinsic), "evidence_id").count() == 1
    fields = "retrieval_attempt_id string, target_identifier string, disease_context string, source string, query string, status string, treatment_context string, error_category string, source_release string, timestamp timestamp, result_count int"
    now = __import__("datetime").datetime(2024, 1, 1)
    attempts = spark.createDataFrame([("1", "t", "d", "s", "q", "success", None, None, None, now, 3), ("2", "t", "d", "s", "q", "failed", None, None, None, now, 1), ("3", "t", "d", "s", " ", "success_zero_results", None, "x", None, None, None)], fields)
    assert {(r.retrieval_attempt_id, r.field) for r in store.issue_rows(attempts, "retrieval_attempt_id", store.attempt_rules()).collect()} == {("2", "result_count"), ("2", "error_category"), ("3", "query"), ("3", "timestamp"), ("3", "result_count"), ("3", "error_category")}
    assert store.new_attempts(attempts.union(attempts), attempts.where("retrieval_attempt_id = '1'")).count() == 2


def test_snapshots_and_persistence(spark):
    items = spark.createDataFrame([("b", "h2", "x"), ("a", "h1", "x"), ("c", "h3", "y")], "id string, h string, lang string")
    refs, manifest = store.snapshot(items, store.selector({"lang": "x"}), "id", "h")
    assert [(r.position, r.id) for r in refs.orderBy("position").collect()] == [(1, "a"), (2, "b")]
    again = store.snapshot(items.repartition(3), F.col("lang") == "x", "id", "h")[1].first()
    other = store.snapshot(items.withColumn("h", F.concat("h", F.lit("!"))), F.col("lang") == "x", "id", "h")[1].first()
    assert manifest.first() == again != other
    with pytest.raises(ValueError):
        store.selector({"secret": 1}, allowed=["lang"])
    families = store.independent_families(spark.createDataFrame([("f1", True), ("f1", True), ("composite:f1+f2", True), ("f2", False)], "family string, eligible boolean"), []).first()
    assert tuple(families) == (4, 3, 1)


def test_claim_taxonomy(spark):
    words = claims.Lexicon(["causes"], ["linked to"], ["proves"], ["may"], ["small cohort"], ["mouse"], ["clinical efficacy"], ["should receive"], ["no recommendation"], [" mg"], ["all patients"])
    docs = spark.createDataFrame([("d", "X is linked to Y and may matter in a small cohort of mouse models", "h", True), ("e", "t", "h", False), ("n", "t", "h", True)], "doc_id string, source_text string, source_hash string, valid boolean")
    quote = "X is linked to Y and may matter in a small cohort"
    row = lambda i, text, stance="supports", doc="d", targets=("X",), diseases=("Y",), start=0: (i, doc, text, quote, start, start + len(quote), stance, "h", list(targets), list(diseases), [], [], "")
    rows = [row("1", "X causes Y in a small cohort"), row("2", "proves it for all patients"), row("3", "patients should receive 5 mg"), row("4", "No recommendation: should receive. small cohort", "contradicts"), row("5", "small cohort", "unclear", start=3), row("6", "small cohort", targets=("Z",)), row("7", "small cohort", doc="e")]
    df = spark.createDataFrame(rows, "claim_id string, doc_id string, claim_text string, quoted_span string, quote_start int, quote_end int, stance string, source_hash string, target_mentions array<string>, disease_mentions array<string>, species_mentions array<string>, model_mentions array<string>, cohort string")
    audited = claims.taxonomy(df, docs, words)
    got = {r.claim_id: set(r.findings) for r in audited.collect()}
    cross = {"within_source_contradiction"}
    assert got["1"] == {"association_presented_as_causation"} | cross and got["2"] == {"certainty_inflation", "unsupported_population_generalization", "missing_source_limitation"} | cross
    assert got["3"] == {"unsupported_therapeutic_recommendation", "clinical_guidance_language", "missing_source_limitation"} | cross and got["4"] == cross
    assert got["5"] == {"grounding_integrity_failure", "ambiguous_support_relation"} and got["6"] == {"invented_or_unanchored_identifier"} and "audit_input_invalid" in got["7"]
    assert {r.doc_id: r.decision for r in claims.roll_up(audited, docs).collect()} == {"d": "block", "e": "invalid_input", "n": "no_candidates"}
    texts = spark.createDataFrame([('{"claim_id":"1","verdict":"approve","content_hash":"h","reviewer":"r","answered":[]}',), ('{"claim_id":"1"}',), ("x",), ('{"claim_id":"1","verdict":"maybe","content_hash":"h","reviewer":"r","answered":[]}',), ('{"claim_id":"1","verdict":"approve","content_hash":"h","reviewer":"r","answered":[],"more":1}',)], "json string")
    assert [r.problem for r in claims.parse_decisions(texts.coalesce(1)).collect()] == [None, "field_missing", "not_json", "verdict_unknown", "unknown_field"]
    statements = spark.createDataFrame([("s1", "fine", ["e1"]), ("s2", "proves it", ["e1", "e1"]), ("s3", "x", []), ("s4", "patients should receive it", ["e9"])], "statement_id string, text string, citations array<string>")
    found = {(r.statement_id, r.issue) for r in claims.synthesis_issues(statements, spark.createDataFrame([("e1", "it may be")], "evidence_id string, text string"), words).collect()}
    assert found == {("s2", "repeated_citation"), ("s2", "more_certain_than_cited"), ("s3", "no_citation"), ("s4", "unknown_citation"), ("s4", "recommends")}


def test_repeated_headers_and_paths(spark, tmp_path):
    (tmp_path / "m.csv").write_text('ModelID,AAA (1),B,AAA (1),"C (3)"\nm1,1,2,3,\nm2,x,5,6,7\n')
    wide = matrices.read_wide(spark, str(tmp_path / "m.csv"))
    assert wide.columns == ["ModelID", "AAA (1)", "B", "AAA (1)#2", "C (3)"] and [tuple(r) for r in wide.collect()][0] == ("m1", "1", "2", "3", None)
    assert {r.name: r.state for r in matrices.label_index(wide, "ModelID").collect()} == {"AAA (1)": "duplicate_identity", "AAA (1)#2": "duplicate_identity", "B": "unresolved_format", "C (3)": "resolved"}
    assert matrices.structure_issues(wide, "ModelID").collect()[0].issue == "not_numeric"
    (tmp_path / "w.csv").write_text('a,b\n1,2\n1,2,3\n"x,y",2\n')
    assert [r.cells for r in matrices.width_issues(spark, str(tmp_path / "w.csv")).collect()] == [3]
    rows, issues = matrices.read_keyed(spark, str(tmp_path / "m.csv"), "ModelID")
    assert [r.source_row for r in rows.orderBy("source_row").collect()] == [1, 2] and issues.count() == 0
    root = tmp_path / "rel"
    for name, text in (("x/f", "one"), ("y/f", "two"), ("z.csv", "a,b\n")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    files = matrices.file_digests(spark, str(root))
    entry = lambda name, text, length=None: (name, len(text) if length is None else length, hashlib.sha256(text.encode()).hexdigest())
    manifest = spark.createDataFrame([entry("x/f", "one"), entry("y/f", "other", 3), entry("z.csv", "a,b\n"), entry("gone", ""), entry("../up", "")], "name string, length long, sha256 string")
    state = lambda **x: {r.name: r.state for r in matrices.release_state(files, manifest, **x).collect()}
    assert state() == {"x/f": "verified", "y/f": "hash_mismatch", "z.csv": "verified", "gone": "missing_file", "../up": "unsafe_path"}
    assert state(headers={"z.csv": ["a", "c"]})["z.csv"] == "header_mismatch" and state(formats=["csv"])["x/f"] == "unsupported_format"
    assert {r.name: r.issue for r in release.tree_issues(files, file_limit=3).collect()} == {"z.csv": "file_too_large"}
    other = files.select("name", F.when(F.col("name") == "x/f", F.lit("no")).otherwise(F.col("sha256")).alias("sha256")).where("name <> 'z.csv'")
    assert {r.name: r.state for r in release.compare_runs(files, other).collect()} == {"x/f": "different", "y/f": "equal", "z.csv": "only_left"}


def test_release_and_universes(spark):
    c = lambda *rows: spark.createDataFrame([(f"c{k}", *r) for k, r in enumerate(rows)], "criterion string, observed double, op string, bound double, mandatory boolean")
    state = lambda df, fixture=False, **x: release.release_state(df, F.lit(fixture), **x).first().state
    good = c((1.0, ">=", 0.5, True), (0.0, ">=", 0.5, False))
    assert state(good) == "ready" and state(good, True) == "fixture_only" and state(good, reproduced=F.lit(False)) == "not_reproduced"
    assert state(c((None, ">=", 0.5, True))) == "incomplete" and state(c((0.1, ">=", 0.5, True))) == "criteria_failed"
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "id string")
    row = loaders.frozen(ids("a", "b", None), ids("b", "c"), ids("b", "d", "d"), "id").first()
    assert (row.n_benchmark, row.n_discovery, row.n_background, row.n_all, row.n_benchmark_only, row.n_benchmark_discovery) == (2, 2, 2, 1, 1, 1)
    assert loaders.leakage(ids("a", "b").withColumn("source", F.when(F.col("id") == "a", "Benchmark list").otherwise("x")), ids("a", "b"), "id").collect()[0].id == "a"
    assert release.same_members(ids("a", "b"), ids("b"), "id").collect()[0].side == "left"
    assert tuple(release.one_of(ids("x", "x"), "id").first()) == ("x", 1) and release.one_of(ids("x", "y"), "id").first().id is None
    assert {r.value for r in release.count_issues(ids("x", "x", "y"), {"x": 2, "y": 2, "z": 1}, "id").collect()} == {"y", "z"}
    config = {"groups": {"g1": {"intent": "m1", "role": "r", "targets": [{"symbol": " abc "}, {"symbol": "X"}]}, "g2": {"intent": "m9", "targets": [{"symbol": "x"}]}}}
    rows = loaders.benchmark_rows(spark, config)
    assert {(r.symbol, r.issue) for r in loaders.benchmark_issues(rows, ["m1"]).collect()} == {("X", "repeated_symbol"), ("X", "unknown_intent"), ("X", "unknown_accepted")}


def test_sources_and_sinks(spark, tmp_path):
    payload = spark.createDataFrame([("D", [("t1", 0.5), ("t2", None)])], "d string, r array<struct<t:string,s:double>>").select(F.struct(F.col("d").alias("id"), F.lit("n").alias("name")).alias("disease"), F.struct(F.lit(2).alias("count"), F.transform("r", lambda x: F.struct(x["s"].alias("score"), F.struct(x["t"].alias("id")).alias("target"))).alias("rows")).alias("associatedTargets"))
    path = str(tmp_path / "landed")
    found = associations.landed(spark, path, lambda: payload, "test")
    assert associations.complete(found).first().complete and associations.landed(spark, path, lambda: 1 / 0, "test").count() == 1
    assert [r.target_id for r in associations.ordered(associations.flatten(found)).collect()] == ["t1", "t2"] and associations.clear(spark, path) and not associations.clear(spark, path)
    requests = spark.createDataFrame([("A",), ("B",), ("C",), ("D",), ("",)], "symbol string")
    candidates = spark.createDataFrame([("A", "A", "1", True), ("A", "AX", "2", True), ("B", "B", "3", True), ("B", "B", "4", True), ("C", "C", "5", None)], "query string, approved_symbol string, target_id string, validated boolean")
    assert {r.symbol: r.state for r in associations.resolve_exact(requests, candidates).collect()} == {"A": "resolved_exact", "B": "ambiguous", "C": "retrieval_failed", "D": "unresolved", "": "invalid_identifier"}
    entries = spark.createDataFrame([("k1", "p"), ("k2", "p"), ("k2", "q"), ("k3", "r")], "key string, body string").withColumn("payload_sha256", F.when(F.col("key") == "k3", "bad").otherwise(F.sha2("body", 256)))
    assert {r.key: r.state for r in associations.cached(entries, "key", "body").collect()} == {"k1": "found", "k2": "ambiguous", "k3": "corrupt"}
    assert associations.query_plan(requests.limit(1), spark.createDataFrame([("A", "resolve")], "request string, operation string")).count() == 2
    asked = spark.createDataFrame([("q1",), ("q2",), ("q3",), ("q4",)], "query string")
    answers = spark.createDataFrame([("q1", 200, 3), ("q2", 200, 0), ("q3", 429, None)], "query string, status_code int, hit_count int")
    assert [(r.status, r.result_count, r.error_category) for r in associations.search_attempts(asked, answers).orderBy("query").collect()] == [("success", 3, None), ("success_zero_results", 0, None), ("failed", None, "rate_limited"), ("not_executed", None, None)]
    table = spark.createDataFrame([(2, ["x"], None), (1, [], "b")], "b int, a array<string>, c string")
    sinks.write_bundle({"t": table, "j": table}, str(tmp_path / "out"), {"policy": "p1"}, {"j": "json"})
    manifest = {r.table: r for r in spark.read.json(str(tmp_path / "out" / "manifest")).collect()}
    assert manifest["t"].n_rows == 2 and manifest["j"].format == "json" and manifest["t"].policy == "p1"
    assert spark.read.csv(str(tmp_path / "out" / "t"), sep="\t", header=True).columns == ["a", "b", "c"]
    with pytest.raises(ValueError):
        sinks.write_bundle({"t": table}, str(tmp_path / "bad"), {}, checks={"t": table})
    broken = spark.range(2).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception, match="no"):
        sinks.export_snapshot({"fine": table.drop("a"), "broken": broken}, str(tmp_path / "partial"))
    assert not Path(tmp_path / "partial").exists()
    note = spark.range(1).select(sinks.note({"id": F.lit('a"b')}, F.lit("T_1"), {"Why": F.lit(None).cast("string")})).first()[0]
    assert note == '---\nid: "a\\"b"\n---\n# T\\_1\n## Why\n\nnot available'
    notes = spark.createDataFrame([("n1", "x"), ("n2", "y"), ("n3", "z"), ("n4", "1"), ("n4", "2")], "name string, text string")
    plan = sinks.note_plan(notes, spark.createDataFrame([("n2", "y"), ("n3", "old")], "name string, text string"))
    assert {r.name: r.action for r in plan.collect()} == {"n1": "create", "n2": "skip", "n3": "refuse_changed", "n4": "refuse_repeated"}
    assert json.loads(spark.createDataFrame([("x",)], "a string").select(fn.canonical_json(a=F.col("a"))).first()[0]) == {"a": "x"}


def test_profiles_and_rules(spark):
    assert scoring.profile_issues({"name": "x", "weights": {"axis": -1, "zz": 1}, "roles": {}}, "y") == ["missing: confidences", "missing: modalities", "unknown weight: zz", "negative weight: axis", "name doesn't agree"]
    with pytest.raises(ValueError):
        scoring.profile_of({"name": "x"})
    # sets overlap: the first one decides, and a nested set changes single outputs
    both = triage.RuleSet([triage.SetRule(["AA", "BB"], {"fit": "high", "other": "low"}, (["bb"], {"other": "medium"})), triage.SetRule(["BB", "CC"], {"fit": "low", "other": "low"})], {"fit": "unclear", "other": "unclear"}, [(triage.contains_any(F.col("role"), "driver"), {"fit": "medium", "other": "x"})])
    df = spark.createDataFrame([("aa", ""), (" bb ", ""), ("CC", ""), ("d", "a Driver"), ("e", None)], "s string, role string")
    assert {r.s.strip(): (r.fit, r.other) for r in triage.classify(df, both, "s").collect()} == {"aa": ("high", "low"), "bb": ("high", "medium"), "CC": ("low", "low"), "d": ("medium", "x"), "e": ("unclear", "unclear")}
    assert triage.reorder(df, ["role", "zz"]).columns == ["role", "s"] and triage.without_generated(df.withColumn("p_score", F.lit(1)), ["p"], ["score"]).columns == ["s", "role"]
    assert {r.issue for r in triage.key_issues(spark.createDataFrame([("a",), (" A",), ("",)], "s string"), "s").collect()} == {"duplicate", "blank"}
    assert rules is not None and evaluate.NONE == "none" and feasibility.MODALITIES["OTHER"] == "other_clinical"
    state = spark.createDataFrame([("r1", None, None), ("r1", "r2", True), ("r1", "r1", True), ("r1", "r1", None)], "d string, o string, v boolean").coalesce(1).select(feasibility.release_check(F.col("d"), F.col("o"), F.col("v")))
    assert [r[0] for r in state.collect()] == ["not_reported", "mismatch", "verified", "declared_unverified"]


def test_runs_and_reports(spark, tmp_path):
    profiles = [scoring.Profile("a", {"baseline": 0.5, "axis": 0.5}), scoring.Profile("b", {"baseline": 0.1, "axis": 0.9})]
    rng = random.Random(4)
    df = spark.createDataFrame([(k, rng.random(), rng.random()) for k in range(30)], "id long, baseline double, axis_score double")
    core = runs.core(df, profiles, "id", "baseline", F.lit(True), 5)
    assert core["ranked"].count() == 30 and core["tops"].groupBy("profile").count().where("count = 5").count() == 2
    found = runs.sensitivity(df, profiles, {"up": 1.2}, "id", [5])
    assert found["scenarios"].count() == 14 and found["weights"].count() == 14 and found["targets"].count() == 60
    runs.save({"tops": core["tops"], "weights": found["weights"]}, str(tmp_path / "run"), policy="p")
    assert spark.read.json(str(tmp_path / "run" / "manifest")).count() == 2
    rows = df.select("id", (F.col("id") + 1).alias("baseline_rank"), F.col("baseline").alias("effect"), F.col("axis_score").alias("p"), F.lit("x").alias("part"))
    tables = runs.dependency_tables(rows, "id", {"effect": True, "p": False}, {"one": {"p": False}}, F.col("id") % 3 == 0, F.col("id") % 3 == 1, "part", 2, 10, [5])
    assert tables["partition_metrics"].count() == 6 and tables["stability"].where("ranking = 'bounded_overlay_rank'").first().band_violations == 0
    assert reports.universe_hash(df, "id").first() == reports.universe_hash(df.union(df).orderBy("baseline"), "id").first()
    lists = spark.createDataFrame([([1, 2],), ([2, 1],), ([1, 3],)], "a array<int>").coalesce(1).select(reports.record_id("r", {}, {"a": F.col("a")})).collect()
    assert lists[0] == lists[1] != lists[2]
    ordered = spark.createDataFrame([("x", 1.0, "c"), ("y", 9.0, "a"), ("x", None, "b"), ("z", 5.0, "d")], "s string, v double, k string")
    assert [r.k for r in ordered.orderBy(*reports.by_source(ordered, "s", "v", "k", ["x", "y"])).collect()] == ["c", "b", "a", "d"]
    assert [r.k for r in reports.exactly_one(ordered.union(ordered.limit(1)), "k").collect()] == ["c"]
    more = reports.decorated(ordered, spark.createDataFrame([("a", 7)], "k string, w int"), "k", "dep")
    assert {r.k: (r.has_dep, r.dep_w) for r in more.collect()}["a"] == (True, 7)
    final = reports.finalized(ordered, spark.createDataFrame([("a",)], "k string"), spark.createDataFrame([("b", "missing_quote"), ("c", "verified")], "k string, verification string"), "k")
    assert {r.k: r.state for r in final.collect()} == {"a": "invalid", "b": "citation_not_verified", "c": "final", "d": "final"}
    limits = reports.matrix_limits(spark.createDataFrame([(0.5, None), (1.5, -0.1)], "a double, b double"), ["a", "b"]).first()
    assert tuple(limits) == (-0.1, 1.5, 1, 2)


def test_ingestion(spark, tmp_path):
    root = tmp_path / "release"
    root.mkdir()
    texts = {"effect.csv": "ModelID,AAA (1),BBB (2),odd label\nm1,0.1,,1\nm2,x,0.3,1\n", "probability.csv": "ModelID,AAA (1),CCC (3)\nm1,0.9,0.8\nm3,0.7,\n", "models.csv": "ModelID,lineage\nm1,skin\nm3,lung\nm9,skin\n"}
    for name, text in texts.items():
        (root / name).write_text(text)
    manifest = spark.createDataFrame([(n, len(t), hashlib.sha256(t.encode()).hexdigest()) for n, t in texts.items()], "name string, length long, sha256 string")
    found = ingest.ingest(spark, str(root), manifest, "effect.csv", "probability.csv", "models.csv", "ModelID", ["aaa", "3", "none", "AAA"])
    assert {r.state for r in found["files"].collect()} == {"verified"}
    assert {(r["where"], r.issue) for r in found["issues"].collect()} == {("m2", "not_numeric")}
    assert tuple(found["coverage"].first()) == (1, 1, 1, 1, 1)
    assert {r.request: (r.label, r.state) for r in found["targets"].collect()} == {"aaa": ("AAA (1)", "resolved"), "3": ("CCC (3)", "resolved"), "none": (None, "unresolved"), "AAA": ("AAA (1)", "duplicate")}
    assert found["effect_subset"].columns == ["ModelID", "AAA (1)"] and found["probability_subset"].columns == ["ModelID", "AAA (1)", "CCC (3)"]
    ingest.save({k: v for k, v in found.items() if k in ("files", "models", "targets")}, str(tmp_path / "out"), release="r")
    (root / "effect.csv").write_text("changed")
    with pytest.raises(ValueError):
        ingest.save({"files": matrices.release_state(matrices.file_digests(spark, str(root)), manifest)}, str(tmp_path / "no"))
