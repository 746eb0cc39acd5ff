"""Registered queries of target profiles over models, and of metrics by partition and level."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators import evaluate, profiles, ranking
from loomwork.plans.catalog import KS, SCENARIO_RANKS, register, sensitivity_stability
from loomwork.plans.catalog import _STABLE as STABLE
from loomwork.sources import table

POLICY = profiles.Policy(thresholds=(0.4, 0.8), least_context=2, least_reference=4, least_lineage_models=2, least_lineages=5)

# --- brands as targets, suppliers as models, nations as lineages -----------------------------------

_CELLS = """c AS (SELECT p_brand AS target, l_suppkey AS model, CASE WHEN COUNT(*) % 5 <> 0 THEN CAST(CAST(SUM(l_quantity) AS BIGINT) % 97 - 48 AS DOUBLE) END AS effect, CASE WHEN COUNT(*) % 7 <> 0 THEN MAX(l_discount) * 10 END AS probability
 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand <> 'Brand#11' GROUP BY 1, 2),
m AS (SELECT s_suppkey AS model, s_nationkey = 6 AS inside, CASE WHEN s_nationkey = 24 THEN 'metadata_missing' ELSE n_name END AS line FROM supplier JOIN nation ON n_nationkey = s_nationkey),
x AS (SELECT target, model, 'effect' AS measure, effect AS v FROM c WHERE effect IS NOT NULL UNION ALL SELECT target, model, 'probability', probability FROM c WHERE probability IS NOT NULL),
j AS (SELECT x.*, CASE WHEN inside THEN 'context' ELSE 'non_context' END AS side, line FROM x JOIN m ON m.model = x.model),
z AS (SELECT CASE WHEN GROUPING(line) = 0 THEN 'lineage' WHEN GROUPING(side) = 0 THEN side ELSE 'pan_cancer' END AS kind, CASE WHEN GROUPING(line) = 0 THEN line WHEN GROUPING(side) = 0 THEN side ELSE 'pan_cancer' END AS members, COUNT(*) AS n_models
 FROM (SELECT CASE WHEN inside THEN 'context' ELSE 'non_context' END AS side, line FROM m) GROUP BY GROUPING SETS ((side), (line), ())),
t AS (SELECT target, measure, CASE WHEN GROUPING(line) = 0 THEN 'lineage' WHEN GROUPING(side) = 0 THEN side ELSE 'pan_cancer' END AS kind, CASE WHEN GROUPING(line) = 0 THEN line WHEN GROUPING(side) = 0 THEN side ELSE 'pan_cancer' END AS members,
 COUNT(*) AS n, SUM(CAST(v AS DECIMAL(28,10)))::DOUBLE / COUNT(*)::DOUBLE AS mean, MIN(v) AS least, MAX(v) AS most, QUANTILE_CONT(v, 0.25) AS q1, QUANTILE_CONT(v, 0.5) AS median, QUANTILE_CONT(v, 0.75) AS q3,
 CASE WHEN measure = 'probability' THEN COUNT_IF(v >= 0.4)::DOUBLE / COUNT(*)::DOUBLE END AS fraction_0, CASE WHEN measure = 'probability' THEN COUNT_IF(v >= 0.8)::DOUBLE / COUNT(*)::DOUBLE END AS fraction_1
 FROM j GROUP BY GROUPING SETS ((target, measure, side), (target, measure, line), (target, measure))),
y AS (SELECT t.*, z.n_models, z.n_models - t.n AS n_missing FROM t JOIN z ON z.kind = t.kind AND z.members = t.members)"""


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(targets, cells, models)."""
    brands = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("target"))
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_suppkey").alias("model"), "l_quantity", "l_discount")
    n = F.count(F.lit(1))
    sold = lines.join(brands.where("target <> 'Brand#11'"), F.col("l_partkey") == F.col("p_partkey")).groupBy("target", "model")
    cells = sold.agg(F.when(n % 5 != 0, (F.sum("l_quantity").cast("long") % 97 - 48).cast("double")).alias("effect"), F.when(n % 7 != 0, F.max("l_discount") * 10).alias("probability"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    models = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    models = models.select(F.col("s_suppkey").alias("model"), (F.col("s_nationkey") == 6).alias("inside"), F.when(F.col("s_nationkey") != 24, F.col("n_name")).alias("lineage"))
    return brands.select("target", (F.col("target") != "Brand#12").alias("resolved")).distinct(), cells, models


@register(f"WITH {_CELLS} SELECT target, measure, kind, members, n_models, n, n_missing, ROUND(mean, 6) AS mean, least, most, ROUND(q1, 6) AS q1, ROUND(median, 6) AS median, ROUND(q3, 6) AS q3, ROUND(fraction_0, 6) AS fraction_0, ROUND(fraction_1, 6) AS fraction_1 FROM y")
def target_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every target by context side, over all models and by lineage, for both measures."""
    _, cells, models = _inputs(spark, sf_dir)
    found = profiles.summaries(cells, models, "target", "model", ["effect", "probability"], "inside", "lineage", {"probability": POLICY.thresholds})
    rounded = lambda name, c=None: F.round(c or name, 6).alias(name)
    return found.select("target", "measure", "kind", F.col("group").alias("members"), "n_models", "n", "n_missing", rounded("mean"), "least", "most", rounded("q1"), rounded("median"), rounded("q3"), *(rounded(f"fraction_{k}", f"probability_fraction_{k}") for k in (0, 1)))


_PICK = lambda name, m, kind, c: f"MAX(CASE WHEN measure = '{m}' AND kind = '{kind}' THEN {c} END) AS {name}"
_WIDE = ", ".join(_PICK(f"{m[0]}{s[0]}_{c}", m, s, c) for m in ("effect", "probability") for s in ("context", "non_context", "pan_cancer") for c in ("n", "median", "mean", "fraction_0", "fraction_1"))
_LESS = lambda name, m, s, c: f"CASE WHEN COALESCE({m}c_n, 0) >= 2 AND COALESCE({m}{s[0]}_n, 0) >= 4 THEN ROUND({m}c_{c} - {m}{s[0]}_{c}, 6) END AS {name}_minus_{s}"
_CONTRASTS = ", ".join(_LESS(name, m, s, c) for s in ("non_context", "pan_cancer") for name, m, c in (("effect_median", "e", "median"), ("effect_mean", "e", "mean"), ("probability_median", "p", "median"), ("probability_fraction_0", "p", "fraction_0"), ("probability_fraction_1", "p", "fraction_1")))


@register(f"""WITH {_CELLS}, w AS (SELECT target, {_WIDE} FROM y GROUP BY 1), own AS (SELECT COUNT(*) AS n, CASE WHEN COUNT(DISTINCT line) = 1 THEN MIN(line) END AS line FROM m WHERE inside),
l AS (SELECT target, members, median FROM y WHERE kind = 'lineage' AND measure = 'effect' AND n_models >= 2), o AS (SELECT l.target, l.median FROM l JOIN own ON own.line = l.members),
pos AS (SELECT l.target, COUNT(*) AS n_eligible, CASE WHEN COUNT(*) >= 5 THEN 100.0::DOUBLE * (COUNT_IF(l.median > o.median)::DOUBLE + (COUNT_IF(l.median = o.median) - 1)::DOUBLE / 2.0::DOUBLE) / GREATEST(1, COUNT(*) - 1)::DOUBLE END AS position, MAX(o.median) AS own FROM l LEFT JOIN o ON o.target = l.target GROUP BY 1),
b AS (SELECT DISTINCT p_brand AS target FROM part)
SELECT b.target, own.n AS n_context_models, own.line AS context_lineage, COALESCE(ec_n, 0) AS n_effect_context, COALESCE(pn_n, 0) AS n_probability_reference, {_CONTRASTS}, CAST(COALESCE(n_eligible, 0) AS INT) AS n_eligible_lineages, CASE WHEN pos.own IS NOT NULL THEN ROUND(pos.position, 6) END AS lineage_position,
 CASE WHEN b.target = 'Brand#12' THEN 'target_unresolved' WHEN own.n = 0 THEN 'no_context_models' WHEN ep_n > 0 AND pp_n > 0 AND COALESCE(ec_n, 0) = 0 AND COALESCE(pc_n, 0) = 0 THEN 'context_models_all_values_missing' WHEN COALESCE(ec_n, 0) < 2 AND COALESCE(pc_n, 0) < 2 THEN 'insufficient_measured_context_models'
 WHEN COALESCE(en_n, 0) < 4 AND COALESCE(pn_n, 0) < 4 THEN 'insufficient_measured_reference_models' WHEN ep_n > 0 AND pp_n > 0 THEN 'sufficient_complete_coverage' WHEN ep_n > 0 OR pp_n > 0 THEN 'sufficient_partial_coverage' ELSE 'target_unresolved' END AS coverage_state
FROM b LEFT JOIN w ON w.target = b.target LEFT JOIN pos ON pos.target = b.target, own""")
def target_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each brand: contrasts, position of the context's lineage, coverage."""
    found = profiles.profiles(*_inputs(spark, sf_dir), "target", "model", "effect", "probability", "inside", "lineage", POLICY)
    names = [f"{c}_minus_{s}" for s in ("non_context", "pan_cancer") for c in ("effect_median", "effect_mean", "probability_median", "probability_fraction_0", "probability_fraction_1")]
    return found.select("target", "n_context_models", "context_lineage", F.coalesce("effect_context.n", F.lit(0)).alias("n_effect_context"), F.coalesce("probability_non_context.n", F.lit(0)).alias("n_probability_reference"), *(F.round(c, 6).alias(c) for c in names), "n_eligible_lineages", F.round("lineage_position", 6).alias("lineage_position"), "coverage_state")


@register(f"""WITH {_CELLS} SELECT target, members AS lineage, measure, n_models, n, n_missing, ROUND(median, 6) AS median, n_models >= 2 AS enough FROM y WHERE kind = 'lineage'""")
def target_lineages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lineages nested in each profile."""
    found = profiles.profiles(*_inputs(spark, sf_dir), "target", "model", "effect", "probability", "inside", "lineage", POLICY)
    return found.select("target", F.explode("lineages").alias("x")).select("target", "x.lineage", "x.measure", "x.n_models", "x.n", "x.n_missing", F.round("x.median", 6).alias("median"), F.col("x.enough").alias("enough"))


# --- metrics by partition and level -------------------------------------------------------------------

@register("""WITH d AS (SELECT d.doc_id, d.lang, l.quality = 0 AS pos, l.quality = 1 AND l.toxic = 1 AS neg, d.source <> 'src1' AS ok, d.n_chars FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
r AS (SELECT *, CASE WHEN ok THEN ROW_NUMBER() OVER (PARTITION BY ok ORDER BY n_chars, doc_id) END AS rank FROM d),
e AS (SELECT part AS partition, pos, neg, rank FROM (SELECT UNNEST([lang, 'combined']) AS part, * FROM r) WHERE pos OR neg),
t AS (SELECT partition, COUNT(*) AS n, COUNT(rank) AS n_ranked, CAST(COUNT_IF(pos) AS BIGINT) AS n_positive, CAST(COUNT_IF(neg) AS BIGINT) AS n_negative FROM e GROUP BY 1),
h AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY partition ORDER BY rank) AS k, SUM(CASE WHEN pos THEN 1 ELSE 0 END) OVER (PARTITION BY partition ORDER BY rank) AS hits FROM e WHERE rank IS NOT NULL),
a AS (SELECT partition, SUM(CAST(ROUND(hits::DOUBLE / k::DOUBLE, 12) AS DECIMAL(30,12))) FILTER (pos)::DOUBLE AS terms, MIN(rank) FILTER (pos) AS best, MEDIAN(rank) FILTER (pos) AS middle, CAST(COUNT_IF(pos AND k <= 20) AS BIGINT) AS p20, CAST(COUNT_IF(neg AND k <= 20) AS BIGINT) AS n20 FROM h GROUP BY 1)
SELECT t.partition, n, n_ranked, n_positive, n_negative, n_ranked::DOUBLE / n AS coverage, ROUND(COALESCE(terms, 0.0) / NULLIF(n_positive, 0), 9) AS average_precision, 1.0::DOUBLE / best AS reciprocal_rank, middle AS median_rank, middle / NULLIF(n_ranked, 0)::DOUBLE AS normalized_median_rank,
 COALESCE(p20, 0) AS positive_20, COALESCE(p20, 0)::DOUBLE / NULLIF(n_positive, 0) AS recall_20, COALESCE(p20, 0)::DOUBLE / NULLIF(LEAST(20, n_ranked), 0) AS precision_20, COALESCE(n20, 0) AS negative_20, (n_negative - COALESCE(n20, 0))::DOUBLE / NULLIF(n_negative, 0) AS excluded_20 FROM t LEFT JOIN a ON a.partition = t.partition""")
def partition_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives and negatives by language and over all; documents of one source have no rank but count."""
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(labels, "doc_id", "left")
    ranks = ranking.placed(docs.where("source <> 'src1'").select("n_chars", "doc_id"), [F.col("n_chars"), F.col("doc_id")]).select("doc_id", "rank")
    rows = evaluate.with_combined(docs.join(ranks, "doc_id", "left").withColumnRenamed("lang", "partition"), "partition")
    found = evaluate.ranking_metrics(rows, "rank", F.col("quality") == 0, ["partition"], [20], (F.col("quality") == 1) & (F.col("toxic") == 1))
    return found.withColumn("average_precision", F.round("average_precision", 9))


_LEVEL = "COUNT(*) AS n_scenarios, ROUND(MIN(spearman), 6) AS min_spearman, ROUND(AVG(spearman), 6) AS mean_spearman, ARG_MIN(scenario, (spearman, scenario)) AS worst_scenario, ROUND(MAX(mean_change), 6) AS max_mean_change, MAX(max_change) AS max_change" + "".join(f", ROUND(MIN(jaccard_{k}), 6) AS min_jaccard_{k}, ROUND(AVG(jaccard_{k}), 6) AS mean_jaccard_{k}, ROUND(MIN(retention_{k}), 6) AS min_retention_{k}" for k in KS)


@register(f"""WITH {SCENARIO_RANKS}, t AS ({STABLE}), x AS (SELECT SPLIT_PART(t.scenario, '|', 1) AS weight, t.* FROM t)
SELECT profile, weight, 'weight' AS level, {_LEVEL} FROM x GROUP BY profile, weight UNION ALL SELECT profile, NULL, 'profile', {_LEVEL} FROM x GROUP BY profile""")
def sensitivity_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stability by (profile, weight) and by profile, from one pass."""
    rows = sensitivity_stability(spark, sf_dir).withColumn("weight", F.split_part("scenario", F.lit("|"), F.lit(1)))
    return evaluate.aggregate_levels(rows, "profile", "weight", "scenario", KS, digits=6)
