"""Registered queries of whole chains: feature table, dependency profiles and benchmark, evidence, claims, universes."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork import functions as fn
from loomwork.operators import claims, dependency, evaluate, ranking, reports, store, triage
from loomwork.plans.catalog import AXES_SQL, FEATURES_SQL, PROFILES, SPEC, annotated, predictions, register, round_sql, score_sql, weighted_scores
from loomwork.sources import loaders, table

# --- feature table: classes, fits, evidence, confidence, notes ------------------------------------------

_name = "Supplier#{:09d}".format
GATE, MYELOID, SMALL = [_name(k) for k in range(1, 9)], [_name(k) for k in range(5, 16)], [_name(k) for k in (2, 6, 10, 14, 20, 30, 40)]
ROLE = triage.RuleSet(
    [triage.SetRule(GATE, {"role": "gate combination target", "role_confidence": "high"}), triage.SetRule(MYELOID, {"role": "tumor-intrinsic driver / poor direct target", "role_confidence": "medium-high"})],
    {"role": "unclear", "role_confidence": "low"},
)
FITS = ("antibody", "small_molecule", "biomarker", "combination")


def _fits(best: str, antibody: str, small: str, marker: str, combination: str, poor: str = "false") -> dict[str, str]:
    return {"best_modality": best, "antibody": antibody, "small_molecule": small, "biomarker": marker, "combination": combination, "poor": poor}


MODALITY = triage.RuleSet(
    [triage.SetRule(GATE[:4], _fits("antibody", "high", "low", "medium", "high")), triage.SetRule(MYELOID, _fits("antibody", "medium-high", "low-medium", "medium", "medium-high"), (SMALL, {"small_molecule": "medium"})), triage.SetRule(SMALL, _fits("small molecule", "low", "high", "medium", "low-medium"))],
    _fits("unclear", "unclear", "unclear", "unclear", "unclear"),
)
MARKER_FITS, MAPPED_FITS = _fits("patient stratification", "low", "low-medium", "medium-high", "high"), _fits("unclear", "unclear", "unclear", "medium", "unclear", "true")
FIELDS = ["s_name", "association", "axis_ids", "role", "role_confidence", "best_modality", "evidence_for", "evidence_against", "limitation"]


def feature_table_of(df: DataFrame) -> DataFrame:
    """The chain over entities with s_name, association, axis_ids, axis_labels and axis_roles."""
    mapped, poor = F.col("axis_ids") != "unmapped", fn.safe_bool(F.col("poor"))
    inherited = {"role": F.concat(F.lit("biomarker of "), F.col("axis_roles")), "role_confidence": "medium"}
    df = triage.classify(df, replace(ROLE, conditions=[(mapped, inherited)]), "s_name")
    df = triage.classify(df, replace(MODALITY, conditions=[(triage.contains_any(F.col("role"), "biomarker"), MARKER_FITS), (mapped, MAPPED_FITS)]), "s_name")
    fits = {k: F.col(k) for k in FITS}
    said_for, said_against = triage.score_reasons(F.col("association"))
    strong = [(triage.level(fits[k], triage.STRONG), F.concat(F.lit(f"{k} fit is "), fits[k])) for k in FITS]
    has = lambda *parts: triage.contains_any(F.col("role"), *parts)
    reasons_for = [*said_for, (mapped, F.concat(F.lit("Maps to "), F.col("axis_labels"))), (triage.level(F.col("role_confidence"), triage.STRONG), F.concat(F.lit("Role confidence is "), F.col("role_confidence"))), *strong]
    reasons_against = [*said_against, (~mapped, "Not mapped"), (triage.level(F.col("role_confidence"), ["low", "none"]), "Role confidence is low"), (poor, "Poor direct target"), (has("poor direct"), "Poor direct target"), (has("biomarker") & ~has("target"), "Marker rather than target")]
    df = triage.audit(df, reasons_for, reasons_against)
    limit = triage.first_text([(poor, "poor direct target"), (~mapped, "no axis"), (has("biomarker"), "better for stratification"), (has("tumor-intrinsic driver") & (fits["antibody"] == "low"), "poor antibody fit"), ((fits["antibody"] == "unclear") & (fits["small_molecule"] == "unclear"), "modality unclear")], "none flagged")
    put_off = triage.first_text([(poor, triage.template("{s} is context, not a target", s=F.col("s_name"))), (~mapped, triage.template("{s} lacks an axis", s=F.col("s_name"))), (has("biomarker") & triage.level(fits["biomarker"], triage.STRONG), triage.template("{s} ranks in marker mode", s=F.col("s_name"))), (has("tumor-intrinsic driver") & (fits["combination"] == "low"), triage.template("{s} ranks in driver mode", s=F.col("s_name")))], "no strong reason")
    df = df.withColumns({"contradiction": triage.contradiction(F.col("n_against"), F.col("poor"), F.col("role"), fits), "limitation": limit, "deprioritization": put_off})
    df = triage.completeness(df, FIELDS)
    level = triage.confidence(F.col("completeness"), F.col("role_confidence"), mapped, F.col("evidence_for") != "", F.col("evidence_against") != "", ~F.col("best_modality").isin("", "unclear"), F.col("contradiction"))
    df = df.withColumn("confidence_level", level)
    why = triage.uncertainty(F.col("missing_fields"), [(~mapped, "no axis"), (F.col("role_confidence").isin("", "low", "none"), "role confidence is low"), (F.col("best_modality").isin("", "unclear"), "modality unclear"), (F.col("contradiction") >= 0.6, "high contradiction"), ((F.col("contradiction") >= 0.4) & (F.col("contradiction") < 0.6), "moderate contradiction")], F.col("confidence_level"))
    step = triage.first_text([(has("combination target"), "blockade assay"), (has("biomarker"), "cohort comparison"), (F.col("best_modality").contains("small molecule") | has("tumor-intrinsic"), "perturbation assay")], "literature review")
    note = F.when(~mapped, triage.template("{s}: no axis; {r}; {m}; {c}", s=F.col("s_name"), r=F.col("role"), m=F.col("best_modality"), c=F.col("confidence_level"))).when(F.col("association").isNotNull(), triage.template("{s} ({a}): {x}; {r}; {c}", s=F.col("s_name"), a=fn.fixed(F.col("association"), 3), x=F.col("axis_labels"), r=F.col("role"), c=F.col("confidence_level"))).otherwise(triage.template("{s}: {x}; {r}; {c}", s=F.col("s_name"), x=F.col("axis_labels"), r=F.col("role"), c=F.col("confidence_level")))
    df = df.withColumns({"uncertainty": why, "next_step": step, "note": note, "has_axis": mapped})
    return triage.reorder(df.withColumn("missing_fields", F.concat_ws(", ", "missing_fields")), ["s_name", "association", "axis_ids", "has_axis", "role"])


def _in(names: list[str]) -> str:
    return "UPPER(TRIM(s_name)) IN (" + ", ".join(f"'{n.upper()}'" for n in names) + ")"


def _fit_sql(k: int) -> str:
    pick = lambda *xs: xs[k]
    rows = [list(r.values.values()) for r in MODALITY.sets]
    nested = f"CASE WHEN {_in(SMALL)} THEN 'medium' ELSE '{rows[1][k]}' END" if k == 2 else f"'{rows[1][k]}'"
    last = [list(v.values()) for v in (MARKER_FITS, MAPPED_FITS)]
    return f"CASE WHEN {_in(GATE[:4])} THEN '{pick(*rows[0])}' WHEN {_in(MYELOID)} THEN {nested} WHEN {_in(SMALL)} THEN '{pick(*rows[2])}' WHEN CONTAINS(LOWER(role), 'biomarker') THEN '{pick(*last[0])}' WHEN axis_ids <> 'unmapped' THEN '{pick(*last[1])}' ELSE '{list(MODALITY.default.values())[k]}' END"


_STRONG = "IN ('high', 'medium-high')"
_WEAK = "IN ('low', 'unclear')"
_F3 = f"printf('%.3f', {round_sql('association', 3)})"
FEATURE_TABLE = f"""
WITH {AXES_SQL}, b AS (SELECT *, CASE WHEN s_acctbal BETWEEN 0 AND 400 THEN NULL ELSE s_acctbal / 10000.0::DOUBLE END AS association FROM mapped),
r AS (SELECT *, CASE WHEN {_in(GATE)} THEN 'gate combination target' WHEN {_in(MYELOID)} THEN 'tumor-intrinsic driver / poor direct target' WHEN axis_ids <> 'unmapped' THEN 'biomarker of ' || axis_roles ELSE 'unclear' END AS role, CASE WHEN {_in(GATE)} THEN 'high' WHEN {_in(MYELOID)} THEN 'medium-high' WHEN axis_ids <> 'unmapped' THEN 'medium' ELSE 'low' END AS role_confidence FROM b),
m AS (SELECT *, {", ".join(f"{_fit_sql(k)} AS {n}" for k, n in enumerate(MODALITY.default))} FROM r),
e AS (SELECT *, LIST_FILTER([CASE WHEN association >= 0.7 THEN 'High association score (' || {_F3} || ')' END, CASE WHEN association >= 0.4 AND association < 0.7 THEN 'Moderate association score (' || {_F3} || ')' END, CASE WHEN axis_ids <> 'unmapped' THEN 'Maps to ' || axis_labels END, CASE WHEN role_confidence {_STRONG} THEN 'Role confidence is ' || role_confidence END,
  {", ".join(f"CASE WHEN {k} {_STRONG} THEN '{k} fit is ' || {k} END" for k in FITS)}], lambda x: x IS NOT NULL) AS ef,
 LIST_FILTER([CASE WHEN association < 0.4 THEN 'Low association score (' || {_F3} || ')' END, CASE WHEN association IS NULL THEN 'Missing association score' END, CASE WHEN axis_ids = 'unmapped' THEN 'Not mapped' END, CASE WHEN role_confidence IN ('low', 'none') THEN 'Role confidence is low' END, CASE WHEN poor = 'true' THEN 'Poor direct target' END,
  CASE WHEN CONTAINS(role, 'poor direct') THEN 'Poor direct target' END, CASE WHEN CONTAINS(role, 'biomarker') AND NOT CONTAINS(role, 'target') THEN 'Marker rather than target' END], lambda x: x IS NOT NULL) AS ea FROM m),
t AS (SELECT *, ARRAY_TO_STRING(LIST_FILTER(ef, lambda x, i: LIST_POSITION(ef, x) = i), ' | ') AS evidence_for, ARRAY_TO_STRING(LIST_FILTER(ea, lambda x, i: LIST_POSITION(ea, x) = i), ' | ') AS evidence_against, CAST(LEN(ea) AS INTEGER) AS n_against,
 {round_sql(f"LEAST(1.0::DOUBLE, LEAST(0.4::DOUBLE, 0.08::DOUBLE * LEN(ea)) + CASE WHEN poor = 'true' THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN CONTAINS(role, 'biomarker') AND combination {_STRONG} THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN CONTAINS(role, 'tumor-intrinsic driver') AND antibody = 'high' THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN antibody = 'low' AND combination = 'high' THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN antibody {_WEAK} AND small_molecule {_WEAK} AND biomarker {_WEAK} AND combination {_WEAK} THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END)", 3)} AS contradiction,
 CASE WHEN poor = 'true' THEN 'poor direct target' WHEN axis_ids = 'unmapped' THEN 'no axis' WHEN CONTAINS(role, 'biomarker') THEN 'better for stratification' WHEN CONTAINS(role, 'tumor-intrinsic driver') AND antibody = 'low' THEN 'poor antibody fit' WHEN antibody = 'unclear' AND small_molecule = 'unclear' THEN 'modality unclear' ELSE 'none flagged' END AS limitation,
 CASE WHEN poor = 'true' THEN s_name || ' is context, not a target' WHEN axis_ids = 'unmapped' THEN s_name || ' lacks an axis' WHEN CONTAINS(role, 'biomarker') AND biomarker {_STRONG} THEN s_name || ' ranks in marker mode' WHEN CONTAINS(role, 'tumor-intrinsic driver') AND combination = 'low' THEN s_name || ' ranks in driver mode' ELSE 'no strong reason' END AS deprioritization FROM e),
c AS (SELECT *, LIST_FILTER([{", ".join(f"CASE WHEN {f} IS NULL OR LOWER(TRIM({f}::VARCHAR)) IN ('', 'nan', 'none', 'null', 'unclear', 'unmapped', 'not assessed') THEN '{f}' END" for f in FIELDS)}], lambda x: x IS NOT NULL) AS mf FROM t),
d AS (SELECT *, {round_sql("(9 - LEN(mf)) / 9.0::DOUBLE", 3)} AS completeness, ARRAY_TO_STRING(mf, ', ') AS missing_fields FROM c),
l AS (SELECT *, CASE WHEN completeness < 0.45 THEN 'insufficient' WHEN completeness >= 0.85 AND role_confidence {_STRONG} AND axis_ids <> 'unmapped' AND evidence_for <> '' AND evidence_against <> '' AND best_modality NOT IN ('', 'unclear') AND contradiction <= 0.45 THEN 'high' WHEN completeness >= 0.65 AND role_confidence IN ('high', 'medium-high', 'medium') AND evidence_for <> '' AND best_modality NOT IN ('', 'unclear') THEN 'medium' ELSE 'low' END AS confidence_level FROM d),
u AS (SELECT *, LIST_FILTER([CASE WHEN LEN(mf) > 0 THEN 'Missing fields: ' || missing_fields END, CASE WHEN axis_ids = 'unmapped' THEN 'no axis' END, CASE WHEN role_confidence IN ('', 'low', 'none') THEN 'role confidence is low' END, CASE WHEN best_modality IN ('', 'unclear') THEN 'modality unclear' END, CASE WHEN contradiction >= 0.6 THEN 'high contradiction' END, CASE WHEN contradiction >= 0.4 AND contradiction < 0.6 THEN 'moderate contradiction' END], lambda x: x IS NOT NULL) AS why FROM l)
SELECT s_suppkey, association, axis_ids, axis_ids <> 'unmapped' AS has_axis, role, role_confidence, best_modality, antibody, small_molecule, biomarker, combination, poor, evidence_for, evidence_against, n_against, contradiction, limitation, deprioritization, completeness, missing_fields, confidence_level,
 CASE WHEN LEN(why) > 0 THEN ARRAY_TO_STRING(why, ' | ') WHEN confidence_level = 'high' THEN 'Evidence is fairly complete' ELSE 'No particular reason' END AS uncertainty, CASE WHEN CONTAINS(role, 'combination target') THEN 'blockade assay' WHEN CONTAINS(role, 'biomarker') THEN 'cohort comparison' WHEN CONTAINS(best_modality, 'small molecule') OR CONTAINS(role, 'tumor-intrinsic') THEN 'perturbation assay' ELSE 'literature review' END AS next_step,
 CASE WHEN axis_ids = 'unmapped' THEN s_name || ': no axis; ' || role || '; ' || best_modality || '; ' || confidence_level WHEN association IS NOT NULL THEN s_name || ' (' || {_F3} || '): ' || axis_labels || '; ' || role || '; ' || confidence_level ELSE s_name || ': ' || axis_labels || '; ' || role || '; ' || confidence_level END AS note FROM u"""


@register(FEATURE_TABLE)
def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = annotated(spark, sf_dir).withColumn("association", F.when(~F.col("s_acctbal").between(0, 400), F.col("s_acctbal") / F.lit(10000.0)))
    found = feature_table_of(base)
    return found.select("s_suppkey", "association", "axis_ids", "has_axis", "role", "role_confidence", "best_modality", *FITS, "poor", "evidence_for", "evidence_against", "n_against", "contradiction", "limitation", "deprioritization", "completeness", "missing_fields", "confidence_level", "uncertainty", "next_step", "note")


# --- dependency: profiles, candidate rankings, stability, ablations ----------------------------------------

_CELLS = """cells AS (SELECT p.p_brand AS target, l.l_suppkey AS model, MIN(s.s_nationkey) < 8 AS inside, SUM(CAST(l.l_quantity AS DECIMAL(18,2)))::DOUBLE / COUNT(*)::DOUBLE AS effect, CASE WHEN COUNT(*) > 1 THEN COUNT_IF(l.l_returnflag = 'R')::DOUBLE / COUNT(*)::DOUBLE END AS probability
 FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN supplier s ON s.s_suppkey = l.l_suppkey GROUP BY 1, 2)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as targets, suppliers as models, two measures of each pair."""
    t = lambda n: table(spark, sf_dir, n)
    joined = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    n = F.count(F.lit(1))
    return joined.groupBy(F.col("p_brand").alias("target"), F.col("l_suppkey").alias("model")).agg(
        (F.min("s_nationkey") < 8).alias("inside"), (F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double") / n.cast("double")).alias("effect"),
        F.when(n > 1, F.count_if(F.col("l_returnflag") == "R").cast("double") / n.cast("double")).alias("probability"),
    )


_GROUPS = ("context", "non_context", "pan_cancer")
_OF = {"context": "inside", "non_context": "NOT inside", "pan_cancer": "TRUE"}
_PROFILE = f"""WITH {_CELLS}, a AS (SELECT target, {", ".join(f"CAST(COUNT(probability) FILTER ({_OF[g]}) AS BIGINT) AS n_{g}, MEDIAN(probability) FILTER ({_OF[g]}) AS median_{g}, SUM(CAST(probability AS DECIMAL(30,10))) FILTER ({_OF[g]})::DOUBLE / COUNT(probability) FILTER ({_OF[g]})::DOUBLE AS mean_{g}, (COUNT_IF(probability >= 0.3 AND {_OF[g]}))::DOUBLE / NULLIF(COUNT(probability) FILTER ({_OF[g]}), 0)::DOUBLE AS fraction_0_{g}" for g in _GROUPS)} FROM cells GROUP BY 1)
SELECT target, {", ".join(f"n_{g}" for g in _GROUPS)}, {", ".join(f"ROUND({n}_{g}, 6) AS {n}_{g}" for n in ("median", "mean", "fraction_0") for g in _GROUPS)}, {", ".join(f"ROUND(CASE WHEN n_context >= 2 AND n_{g} >= 3 THEN {n}_context - {n}_{g} END, 6) AS {n}_minus_{g}" for n in ("median", "mean", "fraction_0") for g in _GROUPS[1:])} FROM a"""


@register(_PROFILE)
def dependency_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dependency.profile_contrasts(dependency.group_summaries(cells(spark, sf_dir), "target", "probability", F.col("inside"), [0.3]), "target", 2, 3, 1)
    return found.select("target", *(c if c.startswith("n_") else F.round(c, 6).alias(c) for c in found.columns if c != "target"))


@register(f"""WITH {_CELLS} SELECT target, model, ROUND(effect, 9) AS effect, probability, CASE WHEN effect <= 22 AND probability <= 0.1 THEN 'strong_negative_gene_effect_low_probability' ELSE 'weak_gene_effect_high_probability' END AS type FROM cells WHERE inside AND ((effect <= 22 AND probability <= 0.1) OR (effect > 22 AND probability >= 0.5))""")
def discordant_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = cells(spark, sf_dir).where("inside")
    pairs = dependency.heterogeneity(inside, inside, "target", "model", "effect", "probability")
    return dependency.discordant_models(pairs, "effect", "probability", 22.0, 0.1, 0.5).withColumn("effect", F.round("effect", 9))


_BENCH = """b AS (SELECT s_suppkey AS id, CASE WHEN s_nationkey <> 3 THEN s_acctbal END AS effect, CASE WHEN s_acctbal > 500 THEN s_nationkey::DOUBLE END AS share, CASE WHEN s_nationkey < 20 THEN ROW_NUMBER() OVER (PARTITION BY s_nationkey < 20 ORDER BY s_acctbal, s_suppkey) END AS baseline_rank FROM supplier),
e AS (SELECT id, CASE WHEN COUNT(*) OVER () = 1 THEN 1.0 ELSE 1.0 - (RANK() OVER (ORDER BY -effect DESC) + (COUNT(*) OVER (PARTITION BY effect) - 1) / 2.0 - 1) / (COUNT(*) OVER () - 1)::DOUBLE END AS v FROM b WHERE effect IS NOT NULL),
h AS (SELECT id, CASE WHEN COUNT(*) OVER () = 1 THEN 1.0 ELSE 1.0 - (RANK() OVER (ORDER BY share DESC) + (COUNT(*) OVER (PARTITION BY share) - 1) / 2.0 - 1) / (COUNT(*) OVER () - 1)::DOUBLE END AS v FROM b WHERE share IS NOT NULL),
s AS (SELECT b.*, CAST((e.v IS NOT NULL)::INT + (h.v IS NOT NULL)::INT AS BIGINT) AS n_components, CASE WHEN e.v IS NOT NULL AND h.v IS NOT NULL THEN ROUND((e.v + h.v) / 2, 9) END AS signal FROM b LEFT JOIN e ON e.id = b.id LEFT JOIN h ON h.id = b.id),
o AS (SELECT *, CASE WHEN baseline_rank IS NOT NULL THEN ROW_NUMBER() OVER (PARTITION BY baseline_rank IS NOT NULL ORDER BY signal DESC NULLS LAST, baseline_rank, id) END AS alone, FLOOR((baseline_rank - 1) / 8.0) AS band, signal IS NOT NULL AS ok FROM s),
p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY band, ok ORDER BY signal DESC NULLS LAST, baseline_rank, id) AS ord, ROW_NUMBER() OVER (PARTITION BY band, ok ORDER BY baseline_rank, id) AS slot FROM o WHERE baseline_rank IS NOT NULL),
q AS (SELECT x.id, COALESCE(y.baseline_rank, x.baseline_rank) AS overlay FROM p x LEFT JOIN p y ON x.ok AND y.ok AND x.band = y.band AND x.ord = y.slot),
z AS (SELECT o.id, o.baseline_rank, o.n_components, o.signal AS dependency_signal, CAST(o.alone AS BIGINT) AS dependency_only_rank, CAST(q.overlay AS BIGINT) AS bounded_overlay_rank FROM o LEFT JOIN q ON q.id = o.id)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as targets: balance and nation as components, a baseline by balance for most of them."""
    s = table(spark, sf_dir, "supplier")
    ranked = ranking.placed(s.where("s_nationkey < 20").select("s_suppkey", "s_acctbal"), [F.asc("s_acctbal"), F.asc("s_suppkey")], (), "baseline_rank").select("s_suppkey", "baseline_rank")
    rows = s.join(ranked, "s_suppkey", "left").select(F.col("s_suppkey").alias("id"), "baseline_rank", F.when(F.col("s_nationkey") != 3, F.col("s_acctbal")).alias("effect"), F.when(F.col("s_acctbal") > 500, F.col("s_nationkey").cast("double")).alias("share"))
    return dependency.candidate_rankings(rows, "id", {"effect": True, "share": False}, 2, 8)


@register(f"WITH {_BENCH} SELECT * FROM z")
def dependency_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select("id", "baseline_rank", "n_components", F.round("dependency_signal", 9).alias("dependency_signal"), "dependency_only_rank", "bounded_overlay_rank")


@register(f"""WITH {_BENCH}, w AS (SELECT *, ROW_NUMBER() OVER (ORDER BY baseline_rank) AS b, ROW_NUMBER() OVER (ORDER BY bounded_overlay_rank) AS r FROM z WHERE baseline_rank IS NOT NULL AND bounded_overlay_rank IS NOT NULL)
SELECT COUNT(*) AS shared, ROUND((COUNT(*)::DOUBLE * SUM(baseline_rank * bounded_overlay_rank)::DOUBLE - SUM(baseline_rank)::DOUBLE * SUM(bounded_overlay_rank)::DOUBLE) / NULLIF(SQRT((COUNT(*)::DOUBLE * SUM(baseline_rank * baseline_rank)::DOUBLE - SUM(baseline_rank)::DOUBLE * SUM(baseline_rank)::DOUBLE) * (COUNT(*)::DOUBLE * SUM(bounded_overlay_rank * bounded_overlay_rank)::DOUBLE - SUM(bounded_overlay_rank)::DOUBLE * SUM(bounded_overlay_rank)::DOUBLE)), 0), 9) AS spearman,
 COUNT_IF(b <= 5 AND r <= 5)::DOUBLE / COUNT_IF(b <= 5 OR r <= 5)::DOUBLE AS jaccard, CAST(COUNT_IF(b <= 5 AND r <= 5) AS BIGINT) AS retained, CAST(COUNT_IF(r <= 5 AND b > 5) AS BIGINT) AS added, CAST(COUNT_IF(b <= 5 AND r > 5) AS BIGINT) AS removed, MAX(ABS(bounded_overlay_rank - baseline_rank)) AS largest_change, CAST(COUNT_IF(FLOOR((baseline_rank - 1) / 8.0) <> FLOOR((bounded_overlay_rank - 1) / 8.0)) AS BIGINT) AS band_violations, MEDIAN(ABS(bounded_overlay_rank - baseline_rank)) AS median_change FROM w""")
def dependency_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.membership_changes(candidates(spark, sf_dir), [], "baseline_rank", "bounded_overlay_rank", 5, 8).withColumn("spearman", F.round("spearman", 9))


@register("""WITH b AS (SELECT c_custkey AS id, UPPER(c_name) AS request FROM customer), r AS (SELECT o_custkey AS id, MIN(o_orderkey) AS baseline_rank FROM orders GROUP BY 1), p AS (SELECT UPPER(c_name) AS by, c_mktsegment AS segment FROM customer WHERE c_acctbal > 0)
SELECT b.id, r.baseline_rank, p.segment, CASE WHEN r.id IS NOT NULL AND p.by IS NOT NULL THEN 'ranked_and_profiled' WHEN r.id IS NOT NULL THEN 'ranked_not_profiled' WHEN p.by IS NOT NULL THEN 'profiled_not_ranked' ELSE 'unresolved_benchmark_target' END AS reconciliation_state FROM b LEFT JOIN r ON r.id = b.id LEFT JOIN p ON p.by = b.request""")
def benchmark_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    benchmark = customers.select(F.col("c_custkey").alias("id"), F.upper("c_name").alias("request"))
    base = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderkey").alias("baseline_rank"))
    profiles = customers.where("c_acctbal > 0").select(F.upper("c_name").alias("normalized"), F.concat(F.upper("c_name"), F.lit(" (1)")).alias("label"), F.col("c_mktsegment").alias("segment"))
    keyed = dependency.profile_keys(profiles, "normalized", "label").select("by", "segment")
    return dependency.reconcile_benchmark(benchmark, base, keyed, "id", "request").select("id", "baseline_rank", "segment", "reconciliation_state")


@register(f"""WITH {_BENCH}, v AS (SELECT COUNT(*)::DOUBLE AS n, COUNT(dependency_signal)::DOUBLE / COUNT(*) AS covered, MAX(CASE WHEN FLOOR((baseline_rank - 1) / 8.0) <> FLOOR((bounded_overlay_rank - 1) / 8.0) THEN 1.0 ELSE 0.0 END) AS moved FROM z)
SELECT CASE WHEN covered < 0.99 THEN 'blocked_insufficient_evidence' WHEN moved <> 0 THEN 'blocked_policy_failure' ELSE 'eligible' END AS state, CAST((n >= 5)::INT + (covered >= 0.99)::INT + (moved = 0)::INT AS BIGINT) AS n_passed, CAST(3 AS BIGINT) AS n_criteria FROM v""")
def integration_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = lambda c: F.floor((F.col(c) - 1) / F.lit(8))
    m = candidates(spark, sf_dir).agg(F.count(F.lit(1)).cast("double").alias("n"), (F.count("dependency_signal") / F.count(F.lit(1))).alias("covered"), F.max(F.when(band("baseline_rank") != band("bounded_overlay_rank"), 1.0).otherwise(0.0)).alias("moved"))
    row = lambda name, op, bound: F.struct(F.lit(name).alias("criterion"), F.col(name).alias("observed"), F.lit(op).alias("op"), F.lit(bound).alias("bound"), F.lit(True).alias("mandatory"))
    criteria = m.select(F.inline(F.array(row("n", ">=", 5.0), row("covered", ">=", 0.99), row("moved", "==", 0.0))))
    return dependency.gate(criteria, [(["n", "covered"], "blocked_insufficient_evidence"), ([], "blocked_policy_failure")], "eligible")


# --- evidence, claims, universes ----------------------------------------------------------------------------

@register("""WITH a AS (SELECT CAST(event_id AS VARCHAR) AS id, CASE event_type WHEN 'click' THEN 'success' WHEN 'purchase' THEN 'success_zero_results' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'not_executed' ELSE 'odd' END AS status, CASE WHEN value > 100 THEN CAST(FLOOR(value) - 120 AS INTEGER) END AS n, CASE WHEN value < 60 THEN 'timeout' END AS category FROM events)
SELECT id AS retrieval_attempt_id, x.field, x.message FROM (SELECT id, UNNEST(LIST_FILTER([CASE WHEN status = 'odd' THEN {'field': 'status', 'message': 'is not in its vocabulary'} END, CASE WHEN n < 0 THEN {'field': 'result_count', 'message': 'must not be negative'} END, CASE WHEN status = 'success' AND n IS NULL THEN {'field': 'result_count', 'message': 'is required for success'} END,
 CASE WHEN status = 'success_zero_results' AND n IS DISTINCT FROM 0 THEN {'field': 'result_count', 'message': 'must be 0'} END, CASE WHEN status IN ('not_executed', 'failed') AND n IS NOT NULL THEN {'field': 'result_count', 'message': 'must be null for this status'} END, CASE WHEN status = 'failed' AND category IS NULL THEN {'field': 'error_category', 'message': 'is required for a failure'} END,
 CASE WHEN status <> 'failed' AND category IS NOT NULL THEN {'field': 'error_category', 'message': 'must be null without a failure'} END], lambda x: x IS NOT NULL)) AS x FROM a)""")
def attempt_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    status = F.when(kind == "click", "success").when(kind == "purchase", "success_zero_results").when(kind == "error", "failed").when(kind == "signup", "not_executed").otherwise("odd")
    attempts = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("retrieval_attempt_id"), F.col("user_id").cast("string").alias("target_identifier"), F.lit("d").alias("disease_context"), F.lit("s").alias("source"), F.lit("q").alias("query"), status.alias("status"),
        F.lit(None).cast("string").alias("treatment_context"), F.when(value < 60, "timeout").alias("error_category"), F.lit(None).cast("string").alias("source_release"), F.lit("2024-01-01").cast("timestamp").alias("timestamp"), F.when(value > 100, (F.floor(value) - 120).cast("int")).alias("result_count"))
    return store.issue_rows(attempts, "retrieval_attempt_id", store.attempt_rules())


@register("""SELECT source, COUNT(*) AS n, CAST(COUNT_IF(lang <> 'de') AS BIGINT) AS n_eligible, COUNT(DISTINCT CASE WHEN lang <> 'de' AND n_chars <= 1500 THEN CAST(FLOOR(n_chars / 50) AS BIGINT) END) AS n_families FROM documents GROUP BY 1""")
def family_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = F.concat(F.when(F.col("n_chars") > 1500, "composite:").otherwise("cohort:"), F.floor(F.col("n_chars") / 50))
    items = table(spark, sf_dir, "documents").select("source", family.alias("family"), (F.col("lang") != "de").alias("eligible"))
    return store.independent_families(items, ["source"])


@register("""SELECT CAST(ROW_NUMBER() OVER (ORDER BY doc_id, sha256(text)) AS BIGINT) AS position, doc_id, sha256(text) AS digest FROM documents WHERE lang = 'en' AND source IN ('src1', 'src3', 'src5')""")
def reviewed_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("digest", F.sha2("text", 256))
    return store.snapshot(docs, store.selector({"lang": "en", "source": ["src1", "src3", "src5"]}), "doc_id", "digest")[0].select("position", "doc_id", "digest")


LEXICON = claims.Lexicon(causal=["ing "], associative=["the "], certain=["tion"], uncertain=["on "], limits=["er "], preclinical=["src1"], clinical=["a"], advice=["in the"], guidance=[" mg"], broad=["and "])


@register("""WITH c AS (SELECT doc_id, LOWER(SUBSTR(text, 1, 120)) AS claim, SUBSTR(text, 31, 60) AS quote, CASE WHEN n_chars % 5 = 0 THEN 29 ELSE 30 END AS a, lang, source, text, n_chars FROM documents),
o AS (SELECT source, lang FROM (SELECT source, lang, CASE WHEN n_chars % 3 = 0 THEN 'supports' ELSE 'contradicts' END AS stance FROM c WHERE n_chars % 7 <> 0) GROUP BY 1, 2 HAVING COUNT(DISTINCT stance) > 1),
f AS (SELECT c.doc_id, LIST_FILTER([CASE WHEN NOT (a + 60 <= LENGTH(text) AND SUBSTR(text, a + 1, 60) = quote) THEN 'grounding_integrity_failure' END, CASE WHEN CONTAINS(claim, 'in the') THEN 'unsupported_therapeutic_recommendation' END, CASE WHEN CONTAINS(claim, ' mg') THEN 'clinical_guidance_language' END, CASE WHEN CONTAINS(claim, 'ing ') AND CONTAINS(LOWER(quote), 'the ') AND NOT CONTAINS(LOWER(quote), 'ing ') THEN 'association_presented_as_causation' END,
 CASE WHEN CONTAINS(claim, 'tion') AND CONTAINS(LOWER(quote), 'on ') THEN 'certainty_inflation' END, CASE WHEN CONTAINS(LOWER(c.source), 'src1') AND CONTAINS(claim, 'a') THEN 'preclinical_presented_as_clinical' END, CASE WHEN CONTAINS(claim, 'and ') THEN 'unsupported_population_generalization' END, CASE WHEN CONTAINS(LOWER(quote) || ' ', 'er ') AND NOT CONTAINS(claim, 'er ') THEN 'missing_source_limitation' END,
 CASE WHEN NOT CONTAINS(text, c.source) OR NOT CONTAINS(text, c.lang) THEN 'invented_or_unanchored_identifier' END, CASE WHEN n_chars % 7 = 0 THEN 'ambiguous_support_relation' END, CASE WHEN n_chars % 7 <> 0 AND o.source IS NOT NULL THEN 'within_source_contradiction' END], lambda x: x IS NOT NULL) AS findings FROM c LEFT JOIN o ON o.source = c.source AND o.lang = c.lang)
SELECT doc_id, ARRAY_TO_STRING(findings, ',') AS findings, CASE WHEN LIST_HAS_ANY(findings, ['grounding_integrity_failure', 'unsupported_therapeutic_recommendation', 'clinical_guidance_language', 'preclinical_presented_as_clinical', 'invented_or_unanchored_identifier']) THEN 'block' WHEN LEN(findings) > 0 THEN 'review' ELSE 'pass' END AS decision FROM f""")
def claim_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim from every document, about its source and language; documents of one source are one source text's claims."""
    docs = table(spark, sf_dir, "documents")
    n = F.col("n_chars")
    start = F.when(n % 5 == 0, 29).otherwise(30)
    none = F.array().cast("array<string>")
    stance = F.when(n % 7 == 0, "unclear").when(n % 3 == 0, "supports").otherwise("contradicts")
    rows = docs.select(F.col("doc_id").alias("claim_id"), "doc_id", F.substring("text", 1, 120).alias("claim_text"), F.substring("text", 31, 60).alias("quoted_span"), start.alias("quote_start"), (start + 60).alias("quote_end"), stance.alias("stance"), F.lit("h").alias("source_hash"), F.array("source").alias("target_mentions"), F.array("lang").alias("disease_mentions"), none.alias("species_mentions"), none.alias("model_mentions"), F.lit("").alias("cohort"), F.col("source").alias("group"))
    sources = docs.select("doc_id", F.col("text").alias("source_text"), F.lit("h").alias("source_hash"), F.lit(True).alias("valid"))
    audited = claims.taxonomy(rows, sources, LEXICON, group="group")
    return audited.select("doc_id", F.concat_ws(",", "findings").alias("findings"), "decision")


@register("""WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 7000), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier), c AS (SELECT DISTINCT n_nationkey AS k FROM nation WHERE n_regionkey < 3), j AS (SELECT COALESCE(a.k, b.k, c.k) AS k, a.k IS NOT NULL AS a, b.k IS NOT NULL AS b, c.k IS NOT NULL AS c FROM a FULL JOIN b ON a.k = b.k FULL JOIN c ON COALESCE(a.k, b.k) = c.k)
SELECT CAST(COUNT_IF(a) AS BIGINT) AS n_benchmark, CAST(COUNT_IF(b) AS BIGINT) AS n_discovery, CAST(COUNT_IF(c) AS BIGINT) AS n_background, CAST(COUNT_IF(a AND b) AS BIGINT) AS n_benchmark_discovery, CAST(COUNT_IF(a AND c) AS BIGINT) AS n_benchmark_background, CAST(COUNT_IF(b AND c) AS BIGINT) AS n_discovery_background, CAST(COUNT_IF(a AND b AND c) AS BIGINT) AS n_all, CAST(COUNT_IF(a AND NOT b AND NOT c) AS BIGINT) AS n_benchmark_only, CAST(COUNT_IF(b AND NOT a AND NOT c) AS BIGINT) AS n_discovery_only, CAST(COUNT_IF(c AND NOT a AND NOT b) AS BIGINT) AS n_background_only FROM j""")
def frozen_universes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    return loaders.frozen(t("customer").where("c_acctbal > 7000").select(F.col("c_nationkey").alias("k")), t("supplier").select(F.col("s_nationkey").alias("k")), t("nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("k")), "k")


@register("""WITH p AS (SELECT d.source AS expected, CASE WHEN l.toxic = 1 THEN 'src0' ELSE 'src' || CAST(d.n_chars % 4 AS VARCHAR) END AS predicted FROM documents d JOIN labels l ON l.doc_id = d.doc_id), x AS (SELECT expected AS label FROM p UNION SELECT predicted FROM p)
SELECT a.label AS expected, b.label AS predicted, COUNT(p.expected) AS n FROM x a CROSS JOIN x b LEFT JOIN p ON p.expected = a.label AND p.predicted = b.label GROUP BY 1, 2""")
def role_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    said = F.when(F.col("toxic") == 1, "src0").otherwise(F.concat(F.lit("src"), (F.col("n_chars") % 4).cast("string")))
    return evaluate.role_confusion(joined.select(F.col("source").alias("e"), said.alias("p")), "e", "p")


# --- reports ------------------------------------------------------------------------------------------------

@register(f"""WITH {FEATURES_SQL}, s AS (SELECT s_suppkey, {", ".join(f"{score_sql(p)} AS {p.name}" for p in PROFILES)} FROM f), t AS ({" UNION ".join(f"SELECT s_suppkey FROM (SELECT s_suppkey, ROW_NUMBER() OVER (ORDER BY {p.name} DESC, s_suppkey) AS k FROM s) WHERE k <= 5" for p in PROFILES)})
SELECT s.*, GREATEST({", ".join(p.name for p in PROFILES)}) AS best FROM s WHERE s_suppkey IN (SELECT s_suppkey FROM t)""")
def heat_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = weighted_scores(spark, sf_dir).select("s_suppkey", *(F.col(f"{p.name}_score").alias(p.name) for p in PROFILES))
    tops = None
    for p in PROFILES:
        part = scored.orderBy(F.desc(p.name), "s_suppkey").limit(5).select("s_suppkey")
        tops = part if tops is None else tops.union(part)
    return reports.heat_matrix(scored, tops, "s_suppkey", [p.name for p in PROFILES])


@register("""SELECT source, lang, COUNT(*) AS n FROM documents GROUP BY 1, 2""")
def source_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.histogram(table(spark, sf_dir, "documents"), "source", "lang")


@register("""SELECT user_id, COUNT(DISTINCT event_type) AS n_states, COUNT(*) AS n, CAST(COUNT_IF(event_type IN ('click', 'purchase')) AS BIGINT) AS n_covered, COUNT_IF(event_type IN ('click', 'purchase'))::DOUBLE / COUNT(*)::DOUBLE AS ratio FROM events GROUP BY 1""")
def coverage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.coverage_ratio(table(spark, sf_dir, "events"), "event_type", ["click", "purchase"], ["user_id"])


@register("""SELECT c_nationkey, ARG_MIN(c_mktsegment, c_custkey) FILTER (c_acctbal > 3000) AS segment, ARG_MIN(c_name, c_custkey) AS name FROM customer GROUP BY 1""")
def first_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.when(F.col("c_acctbal") > 3000, F.col("c_mktsegment")).otherwise("Unclear ").alias("segment"), F.col("c_name").alias("name"))
    return reports.first_non_missing(rows, ["c_nationkey"], ["segment", "name"], F.col("c_custkey"))


@register("""SELECT source, COUNT(*) AS n_items, COUNT(DISTINCT CASE WHEN TRIM(lang) <> '' THEN lang END) AS n_publications, COUNT(DISTINCT CASE WHEN n_chars > 700 THEN md5(text) END) AS n_families, CAST(COUNT_IF(n_chars <= 700) AS BIGINT) AS n_ineligible FROM documents WHERE lang IN ('en', 'de') GROUP BY 1""")
def evidence_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents").withColumns({"family": F.md5(F.col("text").cast("binary")), "eligible": F.col("n_chars") > 700})
    return reports.cards(reports.card_items(items, "lang", ["en", "de"]), "source", "lang", "family", "eligible")


@register(f"WITH {SPEC} SELECT s_suppkey, expected, predicted, CASE WHEN NOT available THEN 'missing' WHEN expected = 'none' AND predicted <> 'none' THEN 'control_prioritized' ELSE 'wrong' END AS kind FROM q WHERE NOT available OR NOT acceptable_correct")
def benchmark_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.errors_of(predictions(spark, sf_dir)).select("s_suppkey", "expected", "predicted", "kind")
