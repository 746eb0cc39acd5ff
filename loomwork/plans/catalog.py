"""Registered queries of the triage analytics and their SQL equivalents.

Sums are exact decimals, so that results don't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork import functions as fn
from loomwork.operators import claims, evaluate, evidence, feasibility, matrix, ontology, ranking, rules, scoring, store, universe
from loomwork.session import cut_lineage
from loomwork.sources import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "ranked_parts"


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def put(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql:
            ORACLES[query.__name__] = sql
        return query

    return put


# --- parts by revenue: baseline, score, ranks ---------------------------------------------------

PARTS = """
revenue AS (SELECT p.p_partkey, p.p_brand, p.p_type, p.p_size, p.p_retailprice,
                   CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
                   CAST(COUNT(l.l_partkey) AS BIGINT) AS n_lines
            FROM part p LEFT JOIN lineitem l ON p.p_partkey = l.l_partkey GROUP BY 1, 2, 3, 4, 5),
scored AS (SELECT r.*, COALESCE(revenue, 0.0) / m.top AS score, p_retailprice / m.price AS baseline
           FROM revenue r, (SELECT MAX(revenue) AS top, MAX(p_retailprice) AS price FROM revenue) m)
"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with revenue, score (share of the largest revenue) and baseline (share of the largest price)."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("revenue"), F.count("l_partkey").alias("n_lines"))
    joined = table(spark, sf_dir, "part").join(lines, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice", "revenue", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"))
    most = joined.agg(F.max("revenue").alias("top"), F.max("p_retailprice").alias("price"))
    return joined.join(F.broadcast(most)).select(*joined.columns, (F.coalesce("revenue", F.lit(0.0)) / F.col("top")).alias("score"), (F.col("p_retailprice") / F.col("price")).alias("baseline"))


LABEL = "CASE WHEN score >= 0.70 THEN 'high' WHEN score >= 0.45 THEN 'medium' WHEN score > 0.10 THEN 'low' ELSE 'not prioritized' END"
RANKED = f"""
ranked AS (SELECT p_partkey, score, baseline,
       CASE WHEN n_lines > 0 THEN CAST(RANK() OVER (ORDER BY CASE WHEN n_lines > 0 THEN baseline END DESC NULLS LAST) AS BIGINT) END AS baseline_rank,
       CAST(ROW_NUMBER() OVER (ORDER BY score DESC NULLS LAST, baseline DESC NULLS LAST, p_partkey) AS BIGINT) AS rank,
       {LABEL} AS priority FROM scored)
"""


@register(f"WITH {PARTS}, {RANKED} SELECT *, baseline_rank - rank AS rank_shift FROM ranked")
def ranked_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ranking.intent_ranking(parts(spark, sf_dir), "score", "baseline", F.col("n_lines") > 0, "p_partkey")
    return ranked.select("p_partkey", "score", "baseline", "baseline_rank", "rank", "priority", "rank_shift")


@register(f"WITH {PARTS}, {RANKED} SELECT p_partkey, score, rank FROM ranked WHERE priority <> 'not prioritized' AND score > 0 ORDER BY rank, score DESC, p_partkey LIMIT 20")
def priority_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_ranked(parts(spark, sf_dir), 20, "score", "baseline", "p_partkey").select("p_partkey", "score", "rank")


@register(f"""WITH {PARTS} SELECT p_partkey, CASE WHEN score IS NOT NULL THEN CASE WHEN COUNT(*) OVER () = 1 THEN 1.0 ELSE
 1.0 - ((RANK() OVER (ORDER BY p_retailprice DESC) + (COUNT(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0) - 1) / CAST(COUNT(*) OVER () - 1 AS DOUBLE) END END AS percentile FROM scored""")
def midrank_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.midrank_percentile(parts(spark, sf_dir), "p_retailprice").select("p_partkey", "percentile")


@register(f"""WITH {PARTS},
b AS (SELECT p_partkey, CAST(ROW_NUMBER() OVER (ORDER BY baseline DESC, p_partkey) AS BIGINT) AS base, CASE WHEN p_size > 10 THEN score END AS signal FROM scored),
o AS (SELECT *, FLOOR((base - 1) / 50.0) AS band, signal IS NOT NULL AS ok FROM b),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY band, ok ORDER BY signal DESC NULLS LAST, base, p_partkey) AS ord, ROW_NUMBER() OVER (PARTITION BY band, ok ORDER BY base, p_partkey) AS slot FROM o)
SELECT a.p_partkey, a.base AS baseline_rank, COALESCE(s.base, a.base) AS overlay_rank FROM r a LEFT JOIN r s ON a.ok AND s.ok AND a.band = s.band AND a.ord = s.slot""")
def bounded_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ranking.unique_rank(parts(spark, sf_dir), "baseline", "baseline", "p_partkey", "baseline_rank")
    signal = ranked.select("p_partkey", "baseline_rank", F.when(F.col("p_size") > 10, F.col("score")).alias("signal"))
    return ranking.bounded_overlay(signal, "baseline_rank", "signal", "p_partkey", 50).select("p_partkey", "baseline_rank", "overlay_rank")


@register("""SELECT o_custkey, o_orderkey, place FROM (SELECT o_custkey, o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS place FROM orders) WHERE place <= 3""")
def top_orders_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = ranking.top_per_group(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)
    return best.select("o_custkey", "o_orderkey", "place")


@register("""SELECT l_orderkey, l_linenumber, CAST(ROW_NUMBER() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS BIGINT) AS rank FROM lineitem""")
def ranked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return ranking.global_row_number(lines, [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")]).drop("l_extendedprice")


# --- ladders, lookups, audits --------------------------------------------------------------------

@register("""SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' AND o_orderstatus = 'F' THEN 'urgent closed' WHEN o_orderpriority LIKE '1%' THEN 'urgent open' WHEN o_orderpriority LIKE '2%' OR o_totalprice > 300000 THEN 'watch' ELSE 'routine' END AS role,
 CASE WHEN o_orderpriority LIKE '1%' AND o_orderstatus = 'F' THEN 'high' WHEN o_orderpriority LIKE '1%' THEN 'high' WHEN o_orderpriority LIKE '2%' OR o_totalprice > 300000 THEN 'medium' ELSE 'low' END AS role_confidence FROM orders""")
def role_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = F.col("o_orderpriority").startswith("1")
    steps = [
        (urgent & (F.col("o_orderstatus") == "F"), {"role": "urgent closed", "role_confidence": "high"}),
        (urgent, {"role": "urgent open", "role_confidence": "high"}),
        (F.col("o_orderpriority").startswith("2") | (F.col("o_totalprice") > 300000), {"role": "watch", "role_confidence": "medium"}),
    ]
    return rules.apply_ladder(table(spark, sf_dir, "orders"), steps, {"role": "routine", "role_confidence": "low"}).select("o_orderkey", "role", "role_confidence")


AXES_SQL = """
sold AS (SELECT l.l_suppkey, n.n_regionkey AS ord, SUM(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS part FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY 1, 2),
axes AS (SELECT s.s_name AS symbol, d.ord, 'axis' || d.ord AS axis_id, r.r_name AS label, CASE WHEN d.ord < 2 THEN 'west' ELSE 'east' END AS role
  FROM (SELECT *, part::DOUBLE / SUM(part) OVER (PARTITION BY l_suppkey)::DOUBLE AS share FROM sold) d JOIN supplier s ON s.s_suppkey = d.l_suppkey JOIN region r ON r.r_regionkey = d.ord WHERE share >= 0.22),
g AS (SELECT symbol, COUNT(*) AS n, STRING_AGG(axis_id, '; ' ORDER BY ord) AS ids, STRING_AGG(label, '; ' ORDER BY ord) AS labels, STRING_AGG(DISTINCT role, ' | ' ORDER BY role) AS roles FROM axes GROUP BY 1),
mapped AS (SELECT s.*, COALESCE(g.ids, 'unmapped') AS axis_ids, COALESCE(g.labels, 'unmapped') AS axis_labels, COALESCE(g.roles, '') AS axis_roles, CAST(COALESCE(n, 0) AS BIGINT) AS n_axes,
  CASE WHEN n > 0 THEN LEAST(1.0::DOUBLE, 0.75::DOUBLE + 0.15::DOUBLE * (n - 1)) ELSE 0.0 END AS axis_score, CASE WHEN n >= 2 THEN 'high' WHEN n > 0 THEN 'medium' ELSE 'low' END AS axis_confidence
  FROM supplier s LEFT JOIN g ON UPPER(TRIM(s.s_name)) = UPPER(g.symbol))
"""


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with the regions (axes) that take at least 22 % of their revenue."""
    t = lambda n: table(spark, sf_dir, n)
    sold = (
        t("lineitem").select("l_orderkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
        .join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("l_suppkey", F.col("n_regionkey").alias("ord")).agg(F.sum("price").alias("part"))
    )
    whole = sold.groupBy("l_suppkey").agg(F.sum("part").cast("double").alias("all"))
    share = sold.join(whole, "l_suppkey").where(F.col("part").cast("double") / F.col("all") >= 0.22)
    rows = share.join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("region"), F.col("ord") == F.col("r_regionkey"))
    index = rows.select("ord", F.concat(F.lit("axis"), F.col("ord")).alias("axis_id"), F.col("r_name").alias("label"), F.when(F.col("ord") < 2, "west").otherwise("east").alias("role"), fn.normalize_symbol(F.col("s_name")).alias("symbol"))
    return ontology.annotate(t("supplier"), index, "s_name")


@register(f"WITH {AXES_SQL} SELECT s_suppkey, axis_ids, axis_labels, axis_roles, n_axes, axis_score, axis_confidence FROM mapped")
def ontology_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotated(spark, sf_dir).select("s_suppkey", "axis_ids", "axis_labels", "axis_roles", "n_axes", "axis_score", "axis_confidence")


@register("""WITH a AS (SELECT c.c_custkey, COUNT(o.o_orderkey) AS n, COUNT_IF(o.o_orderstatus = 'O') AS n_open, COUNT_IF(o.o_orderpriority LIKE '5%') AS n_low, MAX(c.c_acctbal) AS bal FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1),
r AS (SELECT *, LIST_FILTER([CASE WHEN n = 0 THEN 'no orders' END, CASE WHEN bal < 0 THEN 'negative balance' END, CASE WHEN n_open > 5 THEN 'many open' END, CASE WHEN n > 0 AND n_low * 2 > n THEN 'mostly low priority' END, CASE WHEN n = 0 AND bal < 0 THEN 'negative balance' END], lambda x: x IS NOT NULL) AS against FROM a)
SELECT c_custkey, ARRAY_TO_STRING(CASE WHEN n = 0 AND bal < 0 THEN ['no orders', 'negative balance'] ELSE against END, ' | ') AS evidence_against,
 LEAST(1.0::DOUBLE, LEAST(0.4::DOUBLE, 0.08::DOUBLE * LEN(against)) + CASE WHEN bal < -500 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN n = 0 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END) AS contradiction FROM r""")
def evidence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"), F.count_if(F.col("o_orderpriority").startswith("5")).alias("n_low"))
    joined = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").na.fill(0, ["n", "n_open", "n_low"])
    none, minus = F.col("n") == 0, F.col("c_acctbal") < 0
    against = rules.collect_reasons((none, "no orders"), (minus, "negative balance"), (F.col("n_open") > 5, "many open"), ((F.col("n") > 0) & (F.col("n_low") * 2 > F.col("n")), "mostly low priority"), (none & minus, "negative balance"))
    score = F.least(F.lit(0.4), F.lit(0.08) * F.size("against")) + F.when(F.col("c_acctbal") < -500, 0.25).otherwise(0.0) + F.when(none, 0.15).otherwise(0.0)
    return joined.withColumn("against", against).select("c_custkey", rules.join_unique(F.col("against")).alias("evidence_against"), F.least(F.lit(1.0), score).alias("contradiction"))


@register("""WITH x AS (SELECT d.doc_id, CASE WHEN LOWER(TRIM(d.text)) IN ('', 'nan', 'none', 'null', 'unclear', 'unmapped', 'not assessed') THEN 0 ELSE 1 END + CASE WHEN d.lang IS NULL THEN 0 ELSE 1 END + CASE WHEN l.quality IS NULL THEN 0 ELSE 1 END + CASE WHEN l.toxic IS NULL THEN 0 ELSE 1 END AS n,
  CONCAT_WS(' | ', CASE WHEN l.quality IS NULL THEN 'quality' END, CASE WHEN l.toxic IS NULL THEN 'toxic' END) AS missing FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT doc_id, n / 4.0::DOUBLE AS completeness, missing, CASE WHEN n = 4 THEN 'high' WHEN n >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM x""")
def completeness_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    fields = ["text", "lang", "quality", "toxic"]
    n = sum((F.when(fn.is_missing(F.col(f)), 0).otherwise(1) for f in fields), F.lit(0))
    missing = rules.collect_reasons(*((fn.is_missing(F.col(f)), f) for f in fields))
    level = F.when(F.col("n") == 4, "high").when(F.col("n") >= 2, "medium").otherwise("low")
    return joined.withColumn("n", n).select("doc_id", (F.col("n") / F.lit(4.0)).alias("completeness"), F.concat_ws(" | ", missing).alias("missing"), level.alias("confidence"))


# --- profiles and scenarios -----------------------------------------------------------------------

PROFILES = [
    scoring.Profile("volume", {"baseline": 0.15, "axis": 0.20, "role": 0.20, "modality": 0.20, "confidence": 0.10, "balance": 0.10, "novelty": 0.05}, roles={"home": 1.0, "abroad": 0.4}, confidences={"high": 1.0, "medium": 0.6, "low": 0.2}, modalities={"fit": {"high": 1.0, "low": 0.25}}, poor=-0.45, contradiction=-0.25, unmapped=-0.20),
    scoring.Profile("balance", {"baseline": 0.20, "axis": 0.10, "role": 0.25, "modality": 0.25, "confidence": 0.10, "balance": 0.10, "novelty": 0.0}, roles={"home": 0.5, "abroad": 0.9}, confidences={"high": 1.0, "medium": 0.6, "low": 0.2}, modalities={"fit": {"high": 0.3, "low": 0.8}}, poor=-0.25, contradiction=-0.15, unmapped=-0.05),
    scoring.Profile("scarcity", {"baseline": 0.15, "axis": 0.20, "role": 0.25, "modality": 0.20, "confidence": 0.10, "balance": 0.10, "novelty": 0.0}, roles={"home": 0.3, "abroad": 1.0}, confidences={"high": 0.5, "medium": 0.8, "low": 1.0}, modalities={"fit": {"high": 0.1, "low": 1.0}}, contradiction=-0.15, unmapped=-0.2),
]
FEATURES_SQL = """
f AS (SELECT s.s_suppkey, COALESCE(t.n, 0) / CAST(MAX(t.n) OVER () AS DOUBLE) AS baseline, GREATEST(0.0::DOUBLE, LEAST(1.0::DOUBLE, s.s_acctbal / 10000.0::DOUBLE)) AS axis_score,
 CASE WHEN s.s_nationkey < 10 THEN 'home' ELSE 'abroad' END AS role, CASE WHEN s.s_acctbal > 5000 THEN 'high' WHEN s.s_acctbal > 0 THEN 'medium' ELSE 'low' END AS confidence,
 CASE WHEN COALESCE(t.n, 0) > 600 THEN 'high' ELSE 'low' END AS fit, CASE WHEN s.s_acctbal < 0 THEN 0.7::DOUBLE ELSE 0.2::DOUBLE END AS contradiction, s.s_acctbal < -500 AS poor
 FROM supplier s LEFT JOIN (SELECT l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY 1) t ON t.l_suppkey = s.s_suppkey)
"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with the columns a profile scores."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    joined = table(spark, sf_dir, "supplier").join(counts, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    most = counts.agg(F.max("n").cast("double").alias("top"))
    n = F.coalesce("n", F.lit(0))
    return joined.join(F.broadcast(most)).select(
        "s_suppkey", (n / F.col("top")).alias("baseline"), fn.clip01(F.col("s_acctbal") / F.lit(10000.0)).alias("axis_score"),
        F.when(F.col("s_nationkey") < 10, "home").otherwise("abroad").alias("role"), F.when(F.col("s_acctbal") > 5000, "high").when(F.col("s_acctbal") > 0, "medium").otherwise("low").alias("confidence"),
        F.when(n > 600, "high").otherwise("low").alias("fit"), F.when(F.col("s_acctbal") < 0, 0.7).otherwise(0.2).alias("contradiction"), (F.col("s_acctbal") < -500).alias("poor_target"),
    )


def round_sql(expression: str, digits: int = 4) -> str:
    """SQL of ``round_exactly``."""
    scale = f"{10**digits}.0::DOUBLE"
    high = "(x * 134217729.0::DOUBLE - (x * 134217729.0::DOUBLE - x))"
    base = f"FLOOR(x * {scale})"
    over = f"(({high} * (2 * {scale}) - ({base} * 2 + 1)) + (x - {high}) * (2 * {scale}))"
    return f"LIST_TRANSFORM([{expression}], lambda x: ({base} + CASE WHEN {over} > 0 OR ({over} = 0 AND {base} % 2 = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) / {scale})[1]"


def _case(column: str, levels: dict[str, float]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in levels.items()) + " ELSE 0.0::DOUBLE END"


def score_sql(p: scoring.Profile, weights: dict[str, float] | None = None) -> str:
    w = weights or p.weights
    fit = f"((1.0::DOUBLE * {_case('fit', p.modalities['fit'])}) / 1.0::DOUBLE)"
    terms = {"baseline": "baseline", "axis": "axis_score", "role": _case("role", p.roles), "modality": fit, "confidence": _case("confidence", p.confidences), "balance": "(1.0::DOUBLE - contradiction)", "novelty": "0.5::DOUBLE"}
    total = " + ".join(f"{w[c]!r}::DOUBLE * {terms[c]}" for c in scoring.COMPONENTS)
    fine = f"(CASE WHEN poor THEN {p.poor!r}::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN contradiction >= 0.6 THEN {p.contradiction!r}::DOUBLE ELSE 0.0::DOUBLE END)"
    return round_sql(f"GREATEST(0.0::DOUBLE, LEAST(1.0::DOUBLE, ({total}) + {fine}))")


@register(f"WITH {FEATURES_SQL} SELECT s_suppkey, baseline, " + ", ".join(f"{score_sql(p)} AS {p.name}_score" for p in PROFILES) + " FROM f")
def weighted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features(spark, sf_dir)
    for p in PROFILES:
        df = scoring.score(df, p, keep_parts=False)
    return df.select("s_suppkey", "baseline", *(f"{p.name}_score" for p in PROFILES))


FACTORS = {"down": 0.8, "up": 1.2}
BASE = "none|base"
SCENARIO_SQL = " UNION ALL ".join(
    f"SELECT '{p.name}' AS profile, '{name}' AS scenario, s_suppkey, baseline, {score_sql(p, dict(q.weights))} AS score FROM f" for p in PROFILES for name, q in [(BASE, p), *((f"{w}|{d}", q) for _, w, d, q in scoring.scenarios([p], FACTORS))]
)
SCENARIO_RANKS = f"""{FEATURES_SQL}, s AS ({SCENARIO_SQL}),
k AS (SELECT profile, scenario, s_suppkey, score, CAST(ROW_NUMBER() OVER (PARTITION BY profile, scenario ORDER BY score DESC NULLS LAST, baseline DESC NULLS LAST, s_suppkey) AS BIGINT) AS rank FROM s),
j AS (SELECT a.profile, a.scenario, a.s_suppkey, b.rank AS base_rank, b.score AS base_score, a.rank, a.score FROM k a JOIN k b ON b.s_suppkey = a.s_suppkey AND b.profile = a.profile AND b.scenario = '{BASE}' WHERE a.scenario <> '{BASE}')"""
KS = (5, 10, 20)


def scenario_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of all profiles times weights times factors, from features that are read once."""
    return cut_lineage(scoring.scenario_scores(cut_lineage(features(spark, sf_dir)), PROFILES, FACTORS, "s_suppkey"))


def scenario_ranks(scored: DataFrame) -> DataFrame:
    """Rank and score of every supplier in every scenario beside those of the profile as it is."""
    ranked = ranking.unique_rank(scored, "score", "baseline", "s_suppkey", by=["profile", "scenario"])
    of = Window.partitionBy("profile", "s_suppkey")  # a row for each scenario
    base = lambda c: F.max(F.when(F.col("scenario") == BASE, F.col(c))).over(of)
    return ranked.withColumns({"base_rank": base("rank"), "base_score": base("score")}).where(F.col("scenario") != BASE).select("profile", "scenario", "s_suppkey", "base_rank", "base_score", "rank", "score")


@register(f"WITH {SCENARIO_RANKS} SELECT * FROM j")
def sensitivity_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenario_ranks(scenario_scores(spark, sf_dir))


_STABLE = """SELECT profile, scenario, COUNT(*) AS n, (COUNT(*)::DOUBLE * SUM(base_rank * rank)::DOUBLE - SUM(base_rank)::DOUBLE * SUM(rank)::DOUBLE) / NULLIF(SQRT((COUNT(*)::DOUBLE * SUM(base_rank * base_rank)::DOUBLE - SUM(base_rank)::DOUBLE * SUM(base_rank)::DOUBLE) * (COUNT(*)::DOUBLE * SUM(rank * rank)::DOUBLE - SUM(rank)::DOUBLE * SUM(rank)::DOUBLE)), 0) AS spearman,
 AVG(ABS(base_rank - rank)) AS mean_change, MAX(ABS(base_rank - rank)) AS max_change""" + "".join(f""", COUNT_IF(base_rank <= {k} AND rank <= {k})::DOUBLE / COUNT_IF(base_rank <= {k} OR rank <= {k}) AS jaccard_{k}, COUNT_IF(base_rank <= {k} AND rank <= {k})::DOUBLE / COUNT_IF(base_rank <= {k}) AS retention_{k}""" for k in KS) + " FROM j GROUP BY 1, 2"


@register(f"WITH {SCENARIO_RANKS} {_STABLE}")
def sensitivity_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stability(scenario_scores(spark, sf_dir))


def stability(scored: DataFrame) -> DataFrame:
    return ranking.rank_stability(scenario_ranks(scored), ["profile", "scenario"], "base_rank", "rank", KS)


def _expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") > 4000, "volume").when(F.col("s_nationkey") < 10, "balance").otherwise("scarcity").alias("expected"))


_ACCURACY = "w AS (SELECT s_suppkey, " + ", ".join(f"MAX(CASE WHEN profile = '{p.name}' THEN score END) AS {p.name}" for p in PROFILES) + f""" FROM k WHERE scenario = '{BASE}' GROUP BY 1),
e AS (SELECT s_suppkey, CASE WHEN s_acctbal > 4000 THEN 'volume' WHEN s_nationkey < 10 THEN 'balance' ELSE 'scarcity' END AS expected FROM supplier),
v AS (SELECT k.profile, k.scenario, e.expected, """ + ", ".join(f"CASE WHEN k.profile = '{p.name}' THEN k.score ELSE w.{p.name} END AS {p.name}" for p in PROFILES) + """ FROM k JOIN w ON w.s_suppkey = k.s_suppkey JOIN e ON e.s_suppkey = k.s_suppkey),
u AS (SELECT profile, scenario, COUNT_IF(expected = CASE WHEN GREATEST(volume, balance, scarcity) <= 0.1 THEN 'none' WHEN volume = GREATEST(volume, balance, scarcity) THEN 'volume' WHEN balance = GREATEST(volume, balance, scarcity) THEN 'balance' ELSE 'scarcity' END)::DOUBLE / COUNT(*)::DOUBLE AS scenario_accuracy FROM v GROUP BY 1, 2),
""" + f"d AS (SELECT a.profile, a.scenario, b.scenario_accuracy AS baseline_accuracy, a.scenario_accuracy, a.scenario_accuracy - b.scenario_accuracy AS delta_accuracy FROM u a JOIN u b ON a.profile = b.profile AND b.scenario = '{BASE}' WHERE a.scenario <> '{BASE}')"


def scenario_deltas(spark: SparkSession, sf_dir: str, scored: DataFrame) -> DataFrame:
    return evaluate.scenario_accuracy(scored, _expected(spark, sf_dir), [p.name for p in PROFILES], "s_suppkey", BASE)


@register(f"WITH {SCENARIO_RANKS}, {_ACCURACY} SELECT * FROM d")
def sensitivity_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenario_deltas(spark, sf_dir, scenario_scores(spark, sf_dir))


@register(f"""WITH {SCENARIO_RANKS}, {_ACCURACY}, t AS ({_STABLE}), x AS (SELECT SPLIT_PART(t.scenario, '|', 1) AS weight, t.*, d.delta_accuracy FROM t JOIN d ON t.profile = d.profile AND t.scenario = d.scenario)
SELECT profile, weight, COUNT(*) AS n_scenarios, ROUND(MIN(spearman), 6) AS min_spearman, ROUND(AVG(spearman), 6) AS mean_spearman, ARG_MIN(scenario, (spearman, scenario)) AS worst_scenario, ROUND(MAX(mean_change), 6) AS max_mean_change, MAX(max_change) AS max_change, ROUND(MAX(ABS(delta_accuracy)), 6) AS max_abs_delta_accuracy"""
 + "".join(f", ROUND(MIN(jaccard_{k}), 6) AS min_jaccard_{k}, ROUND(AVG(jaccard_{k}), 6) AS mean_jaccard_{k}, ROUND(MIN(retention_{k}), 6) AS min_retention_{k}" for k in KS) + " FROM x GROUP BY 1, 2")
def sensitivity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scenario_scores(spark, sf_dir)
    stable = stability(scored).join(scenario_deltas(spark, sf_dir, scored).select("profile", "scenario", "delta_accuracy"), ["profile", "scenario"])
    rows = stable.withColumn("weight", F.split_part("scenario", F.lit("|"), F.lit(1)))
    return evaluate.aggregate_scenarios(rows, ["profile", "weight"], "scenario", KS, ["delta_accuracy"], 6)


@register(f"""WITH {SCENARIO_RANKS} SELECT profile, s_suppkey, MIN(base_rank) AS base_rank, ROUND(MIN(base_score), 6) AS base_score, COUNT(*) AS n_scenarios, MIN(rank) AS min_rank, MAX(rank) AS max_rank, ROUND(AVG(rank), 6) AS mean_rank, ROUND(AVG(ABS(rank - base_rank)), 6) AS mean_change, MAX(ABS(rank - base_rank)) AS max_change,
 ROUND(SUM(CAST(ROUND(ABS(score - base_score), 12) AS DECIMAL(20,12)))::DOUBLE / COUNT(*), 6) AS mean_score_change, ROUND(MAX(ABS(score - base_score)), 6) AS max_score_change"""
 + "".join(f", MIN(base_rank) <= {k} AS base_top_{k}, ROUND(AVG(CASE WHEN rank <= {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS top_{k}_rate" for k in KS) + " FROM j GROUP BY 1, 2")
def sensitivity_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.summarize_targets(scenario_ranks(scenario_scores(spark, sf_dir)), ["profile", "s_suppkey"], KS, 6)


@register(f"""WITH {FEATURES_SQL}, s AS (SELECT s_suppkey, {score_sql(PROFILES[0])} AS a, {score_sql(PROFILES[1])} AS b, s_suppkey % 7 <> 0 AS ok FROM f)
SELECT s_suppkey, CASE WHEN NOT ok THEN '__missing_prediction__' WHEN GREATEST(a, b) <= 0.1 THEN 'none' WHEN a = GREATEST(a, b) THEN 'volume' ELSE 'balance' END AS intent, CASE WHEN ok THEN GREATEST(a, b) ELSE 0.0 END AS intent_score FROM s""")
def primary_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = weighted_scores(spark, sf_dir)
    intent, value = evaluate.primary_intent({p.name: F.col(f"{p.name}_score") for p in PROFILES[:2]}, F.col("s_suppkey") % 7 != 0)
    return scored.select("s_suppkey", intent.alias("intent"), value.alias("intent_score"))


# --- universes -----------------------------------------------------------------------------------

@register("""WITH base AS (SELECT UPPER(TRIM(c_name)) AS symbol, c_acctbal AS score FROM customer WHERE c_mktsegment <> 'BUILDING')
SELECT symbol, score, TRUE AS has_evidence, 'association' AS source FROM base UNION ALL
SELECT DISTINCT UPPER(TRIM(c_name)), 0.0, FALSE, 'required_symbol' FROM customer JOIN orders ON o_custkey = c_custkey WHERE UPPER(TRIM(c_name)) NOT IN (SELECT symbol FROM base)""")
def universe_augment(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    base = customers.where("c_mktsegment <> 'BUILDING'").select(fn.normalize_symbol(F.col("c_name")).alias("symbol"), F.col("c_acctbal").alias("score"))
    required = customers.join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_name")
    return universe.augment(base, required, "symbol", "score")


@register("""WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 5000), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 2000)
SELECT (SELECT COUNT(*) FROM a) AS n_customers, (SELECT COUNT(*) FROM b) AS n_suppliers, (SELECT COUNT(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS n_both, (SELECT COUNT(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) AS n_only_customers, (SELECT COUNT(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)) AS n_only_suppliers""")
def universe_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("k"))
    b = table(spark, sf_dir, "supplier").where("s_acctbal > 2000").select(F.col("s_nationkey").alias("k"))
    return universe.overlap(a, b, "k", ("customers", "suppliers"))


@register("""WITH r AS (SELECT o_orderkey AS id, ' ' || LOWER(c_name) || ' ' AS request FROM orders JOIN customer ON c_custkey = o_custkey),
l AS (SELECT UPPER(c_name) AS k, c_mktsegment AS label FROM customer WHERE c_acctbal > 0 UNION SELECT UPPER(c_name), 'OTHER' FROM customer WHERE c_acctbal > 8000),
g AS (SELECT k, COUNT(DISTINCT label) AS n, MIN(label) AS label FROM l GROUP BY 1)
SELECT id, CASE WHEN n = 1 THEN g.label END AS label, CASE WHEN COALESCE(n, 0) = 0 THEN 'unresolved' WHEN n > 1 THEN 'ambiguous' WHEN ROW_NUMBER() OVER (PARTITION BY UPPER(TRIM(request)) ORDER BY id, request) > 1 THEN 'duplicate' ELSE 'resolved' END AS state FROM r LEFT JOIN g ON UPPER(TRIM(r.request)) = g.k""")
def request_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    requests = table(spark, sf_dir, "orders").join(customers, F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("id"), F.concat(F.lit(" "), F.lower("c_name"), F.lit(" ")).alias("request"))
    name = F.upper("c_name").alias("k")
    labels = customers.where("c_acctbal > 0").select(name, F.col("c_mktsegment").alias("label_found")).union(customers.where("c_acctbal > 8000").select(name, F.lit("OTHER")))
    return universe.resolve(requests, labels, "request", "k", "label_found").select("id", "label", "state")


@register("""SELECT COALESCE(a.k, b.k) AS k, a.k IS NOT NULL AS in_left, b.k IS NOT NULL AS in_right FROM (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderstatus = 'O') a FULL JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'N') b ON a.k = b.k""")
def id_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("k"))
    right = table(spark, sf_dir, "lineitem").where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("k"))
    return universe.reconcile(left, right, "k")


# --- evaluation ------------------------------------------------------------------------------------

@register("""WITH d AS (SELECT x.quality FROM (VALUES ('0'), ('1')) x(quality)), c AS (SELECT CAST(quality AS VARCHAR) AS quality, COUNT_IF(toxic = 0) AS predicted_0, COUNT_IF(toxic = 1) AS predicted_1 FROM labels GROUP BY 1)
SELECT d.quality, CAST(COALESCE(predicted_0, 0) AS BIGINT) AS predicted_0, CAST(COALESCE(predicted_1, 0) AS BIGINT) AS predicted_1 FROM d LEFT JOIN c ON d.quality = c.quality""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion_matrix(table(spark, sf_dir, "labels"), "quality", "toxic", ["0", "1"])


_PREDICTED = "p AS (SELECT CAST(l.quality AS VARCHAR) AS e, CASE WHEN d.n_chars < 300 OR d.lang = 'es' THEN '0' ELSE '1' END AS p FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


@register(f"""WITH {_PREDICTED}, x AS (SELECT e AS label FROM p UNION SELECT p FROM p),
c AS (SELECT x.label, (SELECT COUNT(*) FROM p WHERE e = x.label) AS a, (SELECT COUNT(*) FROM p WHERE p.p = x.label) AS f, (SELECT COUNT(*) FROM p WHERE e = x.label AND p.p = x.label) AS t FROM x)
SELECT SUM(t)::DOUBLE / SUM(a)::DOUBLE AS accuracy, LIST_REDUCE(LIST_PREPEND(0.0::DOUBLE, LIST(CASE WHEN f = 0 THEN 0.0 ELSE t::DOUBLE / f END ORDER BY label)), lambda u, v: u + v) / COUNT(*) AS macro_precision, LIST_REDUCE(LIST_PREPEND(0.0::DOUBLE, LIST(CASE WHEN a = 0 THEN 0.0 ELSE t::DOUBLE / a END ORDER BY label)), lambda u, v: u + v) / COUNT(*) AS macro_recall, LIST_REDUCE(LIST_PREPEND(0.0::DOUBLE, LIST(CASE WHEN a + f = 0 THEN 0.0 ELSE 2.0::DOUBLE * t / (a + f)::DOUBLE END ORDER BY label)), lambda u, v: u + v) / COUNT(*) AS macro_f1 FROM c""")
def macro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    said = F.when((F.col("n_chars") < 300) | (F.col("lang") == "es"), "0").otherwise("1")
    return evaluate.classification_metrics(joined.select(F.col("quality").cast("string").alias("e"), said.alias("p")), "e", "p")


@register("""WITH r AS (SELECT d.lang, l.quality = 0 AS pos, ROW_NUMBER() OVER (PARTITION BY d.lang ORDER BY d.n_chars, d.doc_id) AS k FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
h AS (SELECT *, SUM(CASE WHEN pos THEN 1 ELSE 0 END) OVER (PARTITION BY lang ORDER BY k) AS hits FROM r)
SELECT lang, COUNT(*) AS n, COUNT(*) AS n_ranked, CAST(COUNT_IF(pos) AS BIGINT) AS n_positive, CAST(COUNT_IF(NOT pos) AS BIGINT) AS n_negative, 1.0::DOUBLE AS coverage, CAST(COUNT_IF(pos AND k <= 10) AS BIGINT) AS positive_10, CAST(COUNT_IF(NOT pos AND k <= 10) AS BIGINT) AS negative_10, ROUND(SUM(CAST(ROUND(hits::DOUBLE / k::DOUBLE, 12) AS DECIMAL(30,12))) FILTER (pos)::DOUBLE / COUNT_IF(pos)::DOUBLE, 9) AS average_precision, 1.0::DOUBLE / MIN(k) FILTER (pos) AS reciprocal_rank, MEDIAN(k) FILTER (pos) AS median_rank, MEDIAN(k) FILTER (pos) / COUNT(*)::DOUBLE AS normalized_median_rank,
 COUNT_IF(pos AND k <= 10)::DOUBLE / COUNT_IF(pos)::DOUBLE AS recall_10, COUNT_IF(pos AND k <= 10)::DOUBLE / LEAST(10, COUNT(*))::DOUBLE AS precision_10, COUNT_IF(NOT pos AND k > 10)::DOUBLE / COUNT_IF(NOT pos)::DOUBLE AS excluded_10 FROM h GROUP BY 1""")
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    order = ranking.placed(joined.select("lang", "n_chars", "doc_id", "quality"), [F.col("n_chars"), F.col("doc_id")], ["lang"], "rank")
    found = evaluate.ranking_metrics(order, "rank", F.col("quality") == 0, ["lang"], [10], F.col("quality") == 1)
    return found.withColumn("average_precision", F.round("average_precision", 9))


@register("""WITH b AS (SELECT d.source, COUNT(*) AS drawn, COUNT_IF(l.toxic = 1) AS hits FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY 1), t AS (SELECT SUM(drawn) AS population, SUM(hits) AS positives, COUNT(*) AS tests FROM b),
x AS (SELECT b.*, t.*, LIST_SUM(LIST_TRANSFORM(RANGE(GREATEST(hits, drawn - (population - positives))::BIGINT, LEAST(positives, drawn)::BIGINT + 1), lambda i: EXP(LGAMMA(positives::DOUBLE + 1) - LGAMMA(i::DOUBLE + 1) - LGAMMA(positives::DOUBLE - i + 1) + LGAMMA((population - positives)::DOUBLE + 1) - LGAMMA(drawn::DOUBLE - i + 1) - LGAMMA((population - positives - drawn)::DOUBLE + i + 1) - (LGAMMA(population::DOUBLE + 1) - LGAMMA(drawn::DOUBLE + 1) - LGAMMA((population - drawn)::DOUBLE + 1))))) AS tail FROM b, t)
SELECT source, drawn, CAST(hits AS BIGINT) AS hits, CAST(population AS BIGINT) AS population, CAST(positives AS BIGINT) AS positives, ROUND(LEAST(1.0, COALESCE(tail, 0.0)), 8) AS p_value, ROUND(LEAST(1.0, LEAST(1.0, COALESCE(tail, 0.0)) * tests), 8) AS adjusted FROM x""")
def enrichment_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    by = joined.groupBy("source").agg(F.count(F.lit(1)).alias("drawn"), F.count_if(F.col("toxic") == 1).alias("hits"))
    total = by.agg(F.sum("drawn").alias("population"), F.sum("hits").alias("positives"), F.count(F.lit(1)).alias("tests"))
    p = evaluate.hypergeometric_tail(F.col("population"), F.col("positives"), F.col("drawn"), F.col("hits"))
    rows = by.join(F.broadcast(total)).withColumn("p_value", p)
    return rows.withColumns({"adjusted": F.round(evaluate.bonferroni(F.col("p_value"), F.col("tests")), 8), "p_value": F.round("p_value", 8)}).drop("tests")


# --- matrices and groups ----------------------------------------------------------------------------

@register("""SELECT event_type, COUNT(value) AS n, CAST(COUNT_IF(value IS NULL) AS BIGINT) AS n_missing, MIN(value) AS least, MAX(value) AS most, ROUND(QUANTILE_CONT(value, 0.25), 6) AS q1, ROUND(QUANTILE_CONT(value, 0.5), 6) AS median, ROUND(QUANTILE_CONT(value, 0.75), 6) AS q3, ROUND(QUANTILE_CONT(value, 0.75) - QUANTILE_CONT(value, 0.25), 6) AS iqr, COUNT_IF(value >= 50)::DOUBLE / COUNT(value)::DOUBLE AS fraction_0 FROM events GROUP BY 1""")
def group_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matrix.summarize(table(spark, sf_dir, "events"), ["event_type"], "value", [50.0])
    return found.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3", "iqr")}).drop("mean")


@register("""SELECT c_nationkey, COUNT(CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END) AS n_in, COUNT(CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END) AS n_out, MEDIAN(CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END) AS median_in, MEDIAN(CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END) AS median_out,
 CASE WHEN COUNT(CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END) >= 2 AND COUNT(CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END) >= 2 THEN MEDIAN(CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END) - MEDIAN(CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END) END AS difference FROM customer GROUP BY 1""")
def context_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matrix.contrast(table(spark, sf_dir, "customer"), ["c_nationkey"], F.col("c_mktsegment") == "BUILDING", "c_acctbal", 2, 2)
    return found.drop("mean_in", "mean_out", "mean_difference")


@register("""WITH m AS (SELECT c_nationkey, MEDIAN(c_acctbal) AS median, COUNT(c_acctbal) AS n FROM customer GROUP BY 1 HAVING COUNT(c_acctbal) >= 2)
SELECT *, 100.0::DOUBLE * (RANK() OVER (ORDER BY median DESC) - 1 + (COUNT(*) OVER (PARTITION BY median) - 1) / 2.0::DOUBLE) / GREATEST(1, COUNT(*) OVER () - 1) AS position FROM m""")
def lineage_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.position(table(spark, sf_dir, "customer"), "c_nationkey", "c_acctbal", 2)


@register("""SELECT id, label, AVG(CAST(value AS DECIMAL(18,2)))::DOUBLE AS mean, COUNT(value) AS n FROM (SELECT l_returnflag AS id, UNNEST(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS label, UNNEST([l_quantity, l_extendedprice, l_discount, l_tax]) AS value FROM lineitem) GROUP BY 1, 2""".replace("AVG(CAST(value AS DECIMAL(18,2)))::DOUBLE", "SUM(CAST(value AS DECIMAL(18,2)))::DOUBLE / COUNT(value)::DOUBLE"))
def matrix_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("id"), "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    cells = matrix.to_long(lines, "id")
    return cells.groupBy("id", "label").agg((F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / F.count("value").cast("double")).alias("mean"), F.count("value").alias("n"))


@register(r"""WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '1' || p_brand WHEN p_partkey % 3 = 0 THEN REPLACE(p_brand, '#', '') ELSE REPLACE(p_brand, '#', '') || ' (' || p_partkey || ')' END AS label FROM part),
y AS (SELECT *, REGEXP_MATCHES(label, '^[A-Za-z][A-Za-z0-9-]* \([1-9][0-9]*\)$') AS ok, REGEXP_MATCHES(label, '^[A-Za-z][A-Za-z0-9-]*$') AS alone FROM x)
SELECT p_partkey, CASE WHEN ok THEN REGEXP_EXTRACT(label, '^([A-Za-z][A-Za-z0-9-]*) ', 1) WHEN alone THEN label END AS symbol, CASE WHEN ok THEN REGEXP_EXTRACT(label, '\(([0-9]+)\)$', 1) END AS number, CASE WHEN ok THEN 'resolved' WHEN alone THEN 'unresolved_format' ELSE 'malformed' END AS state FROM y""")
def label_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.replace(F.col("p_brand"), F.lit("#"), F.lit(""))
    label = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("1"), F.col("p_brand"))).when(F.col("p_partkey") % 3 == 0, plain).otherwise(F.concat(plain, F.lit(" ("), F.col("p_partkey"), F.lit(")")))
    symbol, number, state = fn.parse_label(F.col("label"))
    return table(spark, sf_dir, "part").withColumn("label", label).select("p_partkey", symbol.alias("symbol"), number.alias("number"), state.alias("state"))


# --- evidence, text, states ----------------------------------------------------------------------------

@register("""SELECT n_nationkey, 'nation_' || SHA256('{"n_name":"' || n_name || '","n_regionkey":"' || n_regionkey || '"}') AS content_id FROM nation""")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.with_content_id(table(spark, sf_dir, "nation"), "nation", ["n_regionkey", "n_name"]).select("n_nationkey", "content_id")


@register("""WITH d AS (SELECT doc_id, CASE WHEN lang = 'es' THEN NULL ELSE text END AS g FROM documents)
SELECT doc_id, CASE WHEN g IS NOT NULL THEN MIN(doc_id) OVER (PARTITION BY g) END AS first_key, CASE WHEN g IS NOT NULL THEN COUNT(*) OVER (PARTITION BY g) END AS n_same, g IS NOT NULL AND doc_id > MIN(doc_id) OVER (PARTITION BY g) AS is_duplicate FROM d""")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in Spanish stand for records without a digest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") != "es", F.sha2("text", 256)).alias("digest"))
    return evidence.exact_duplicates(docs, "digest", "doc_id").drop("digest")


_APPENDS = """s AS (SELECT doc_id AS k, md5(text) AS g, lang AS b FROM documents WHERE n_chars >= 800), i AS (SELECT CAST(FLOOR(doc_id / 2) AS BIGINT) AS k, md5(text) AS g, source AS b FROM documents WHERE n_chars < 1200 UNION ALL SELECT doc_id, md5(text), lang FROM documents WHERE n_chars BETWEEN 700 AND 1500),
sd AS (SELECT g, MIN(b) AS b FROM s GROUP BY 1), sk AS (SELECT k, MIN(g) AS g FROM s GROUP BY 1), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY g ORDER BY k, b) AS by_g, FIRST_VALUE(b) OVER (PARTITION BY g ORDER BY k, b) AS first_b, FIRST_VALUE(g) OVER (PARTITION BY k ORDER BY g, b) AS first_g FROM i)"""


@register(f"""WITH {_APPENDS} SELECT r.k, r.g AS digest, r.b AS body, CASE WHEN COALESCE(sd.b, first_b) <> r.b THEN 'collision' WHEN sd.g IS NOT NULL OR by_g > 1 THEN 'duplicate' WHEN COALESCE(sk.g, first_g) <> r.g THEN 'rejected_mutation' ELSE 'new' END AS outcome
FROM r LEFT JOIN sd ON sd.g = r.g LEFT JOIN sk ON sk.k = r.k""")
def append_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends whose keys, digests and bodies clash with the store's and with each other's."""
    docs = table(spark, sf_dir, "documents")
    row = lambda key, body: [key.alias("k"), F.md5(F.col("text").cast("binary")).alias("digest"), F.col(body).alias("body")]
    have = docs.where("n_chars >= 800").select(*row(F.col("doc_id"), "lang"))
    halves = docs.where("n_chars < 1200").select(*row(F.floor(F.col("doc_id") / 2), "source"))
    incoming = halves.unionByName(docs.where("n_chars BETWEEN 700 AND 1500").select(*row(F.col("doc_id"), "lang")))
    return evidence.classify_append(incoming, have, "k", "digest", "body")


@register("""WITH RECURSIVE t AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent FROM conversations), e AS (SELECT id, parent FROM t WHERE parent IN (SELECT id FROM t)),
w AS (SELECT id AS node, id AS root FROM (SELECT parent AS id FROM e EXCEPT SELECT id FROM e) UNION SELECT e.id, w.root FROM e JOIN w ON e.parent = w.node) SELECT node, root FROM w""")
def lineage_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("child"), F.col("turn"))
    edges = turns.where("turn > 0").select("child", (F.col("child") - 1).alias("parent"))
    known = edges.join(turns.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi")
    return evidence.lineage_roots(known)


@register("""SELECT user_id, COUNT(*) AS n, COUNT(DISTINCT CASE WHEN TRIM(event_type) <> '' THEN event_type END) AS n_event_type, COUNT(DISTINCT CASE WHEN TRIM(props) <> '' THEN props END) AS n_props FROM events GROUP BY 1""")
def card_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.card_metrics(table(spark, sf_dir, "events"), ["user_id"], ["event_type", "props"])


@register("""WITH u AS (SELECT DISTINCT user_id FROM events), s AS (SELECT UNNEST(['click', 'purchase', 'error', 'signup', 'view', 'refund']) AS event_type)
SELECT u.user_id, s.event_type, COUNT(e.event_id) AS n FROM u CROSS JOIN s LEFT JOIN events e ON e.user_id = u.user_id AND e.event_type = s.event_type GROUP BY 1, 2""")
def state_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return evidence.state_coverage(events, events.select("user_id").distinct(), ["click", "purchase", "error", "signup", "view", "refund"], "event_type")


@register("""SELECT user_id, event_type, COUNT(DISTINCT props) AS n_values, COUNT(*) AS n FROM events GROUP BY 1, 2 HAVING COUNT(DISTINCT props) > 1""")
def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.contradictions(table(spark, sf_dir, "events"), ["user_id", "event_type"], "props")


@register("""SELECT event_id, 'k' AS factor, JSON_EXTRACT_STRING(props, '$.k') AS value, CASE WHEN JSON_EXTRACT_STRING(props, '$.k') IS NULL THEN 'not_available' ELSE 'observed' END AS availability FROM events""")
def eav_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", F.lit("k").alias("factor"), value.alias("value"), F.when(value.isNull(), "not_available").otherwise("observed").alias("availability"))


@register("""WITH c AS (SELECT item_id, item_id * 3 AS doc_id, CASE WHEN item_id % 2 = 0 THEN SUBSTR(text, 1, 12) ELSE (SELECT SUBSTR(d.text, 5, 20) FROM documents d WHERE d.doc_id = b.item_id * 3) END AS quote FROM benchmark b)
SELECT c.item_id, CASE WHEN COALESCE(TRIM(c.quote), '') = '' THEN 'missing_quote' WHEN d.doc_id IS NULL THEN 'missing_document' WHEN COALESCE(TRIM(d.text), '') = '' THEN 'empty_document' WHEN NOT CONTAINS(d.text, c.quote) THEN 'quote_not_literal' ELSE 'verified' END AS verification FROM c LEFT JOIN documents d ON d.doc_id = c.doc_id""")
def citation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    own = docs.select(F.col("doc_id"), F.substring("text", 5, 20).alias("own"))
    claims = table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") * 3).alias("doc_id"), "text").join(own, "doc_id", "left")
    quote = F.when(F.col("item_id") % 2 == 0, F.substring("text", 1, 12)).otherwise(F.col("own"))
    return evidence.verify_citations(claims.select("item_id", "doc_id", quote.alias("quote")), docs, "doc_id", "quote", "text").select("item_id", "verification")


MARKERS, NEGATIONS = ["the", "tion", "license", "password"], ["not ", "no "]


@register("""SELECT conv_id, turn, ARRAY_TO_STRING(LIST_FILTER(['the', 'tion', 'license', 'password'], lambda m: CONTAINS(LOWER(text), m)), ',') AS markers FROM conversations""")
def claim_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(fn.matched_markers(F.col("text"), MARKERS), ",").alias("markers"))


@register("""SELECT e.user_id, e.event_type, e.event_id FROM events e JOIN (SELECT user_id FROM events GROUP BY 1 HAVING COUNT_IF(event_type = 'purchase') > 0 AND COUNT_IF(event_type = 'error') > 0) u ON u.user_id = e.user_id WHERE e.event_type IN ('purchase', 'error')""")
def stance_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.conflicting_members(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id", ("purchase", "error"))


@register("""SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND source IN ('src0', 'src2') AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)""")
def selector_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = store.selector({"lang": "en", "source": ["src0", "src2"]}, allowed=["lang", "source"])
    docs = table(spark, sf_dir, "documents").where(chosen)
    return docs.join(table(spark, sf_dir, "labels").where("quality = 0"), "doc_id", "left_anti").select("doc_id", "lang", "source")


@register("""WITH m AS (SELECT COUNT(*)::DOUBLE AS n, AVG(quality) AS good, MIN(doc_id)::DOUBLE AS least FROM labels), c AS (SELECT 'count' AS criterion, n AS observed, '>=' AS op, 100.0 AS bound FROM m UNION ALL SELECT 'good', good, '>=', 0.99 FROM m UNION ALL SELECT 'least', NULLIF(least, least), '==', 0.0 FROM m)
SELECT criterion, CASE WHEN observed IS NULL THEN 'unavailable' WHEN (op = '>=' AND observed >= bound) OR (op = '==' AND observed = bound) THEN 'pass' ELSE 'fail' END AS state FROM c""")
def gate_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "labels").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("quality").alias("good"), F.lit(None).cast("double").alias("least"))
    row = lambda name, op, bound: F.struct(F.lit(name[0]).alias("criterion"), F.col(name[1]).alias("observed"), F.lit(op).alias("op"), F.lit(bound).alias("bound"))
    rows = m.select(F.inline(F.array(row(("count", "n"), ">=", 100.0), row(("good", "good"), ">=", 0.99), row(("least", "least"), "==", 0.0))))
    return rows.select("criterion", fn.criterion(F.col("observed"), F.col("op"), F.col("bound")).alias("state"))


@register("""SELECT axis, COUNT(*) AS n, ROUND(MEDIAN(p_retailprice), 6) AS median_price FROM (SELECT UNNEST(LIST_FILTER(LIST_TRANSFORM(STRING_SPLIT(p_type, ' '), lambda x: TRIM(x)), lambda x: x <> '')) AS axis, p_retailprice FROM part) GROUP BY 1""")
def axis_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    exploded = table(spark, sf_dir, "part").select(F.explode(fn.pipe_list(F.col("p_type"), " ")).alias("axis"), "p_retailprice")
    found = matrix.summarize(exploded, ["axis"], "p_retailprice")
    return found.select("axis", "n", F.round("median", 6).alias("median_price"))


# --- benchmark of intents, unions of tops, feasibility, audits ----------------------------------------

MODES = [p.name for p in PROFILES]
_LABELS = "CASE WHEN {0} >= 0.70 THEN 'high' WHEN {0} >= 0.45 THEN 'medium' WHEN {0} > 0.10 THEN 'low' ELSE 'not prioritized' END"
_PICK = lambda what: "CASE expected " + " ".join(f"WHEN '{m}' THEN {what.format(m)} END".replace(" END", "") for m in MODES) + " END"
_BEST = "GREATEST(" + ", ".join(MODES) + ")"
_OTHER = "CASE expected " + " ".join("WHEN '{}' THEN GREATEST({})".format(m, ", ".join(o for o in MODES if o != m)) for m in MODES) + " END"
SPEC = f"""{FEATURES_SQL}, s AS (SELECT s_suppkey, baseline, """ + ", ".join(f"{score_sql(p)} AS {p.name}" for p in PROFILES) + """ FROM f),
br AS (SELECT s_suppkey, CAST(RANK() OVER (ORDER BY baseline DESC) AS BIGINT) AS base FROM s),
k AS (SELECT s.*, br.base, """ + ", ".join(f"CAST(ROW_NUMBER() OVER (ORDER BY {m} DESC NULLS LAST, s.baseline DESC NULLS LAST, s.s_suppkey) AS BIGINT) AS {m}_rank" for m in MODES) + """ FROM s JOIN br ON br.s_suppkey = s.s_suppkey),
spec AS (SELECT CASE WHEN s_acctbal BETWEEN 2000 AND 3500 THEN -s_suppkey ELSE s_suppkey END AS s_suppkey, CASE WHEN s_acctbal < 0 THEN 'none' WHEN s_nationkey < 8 THEN 'volume' WHEN s_nationkey < 17 THEN 'balance' ELSE 'scarcity' END AS expected FROM supplier),
j AS (SELECT spec.s_suppkey, spec.expected, k.s_suppkey IS NOT NULL AS available, """ + ", ".join(f"k.{m}, k.{m}_rank, k.base - k.{m}_rank AS {m}_shift" for m in MODES) + """ FROM spec LEFT JOIN k ON k.s_suppkey = spec.s_suppkey),
p AS (SELECT s_suppkey, expected, available, CASE WHEN NOT available THEN '__missing_prediction__' WHEN """ + _BEST + " <= 0.1 THEN 'none' " + " ".join(f"WHEN {m} = {_BEST} THEN '{m}'" for m in MODES) + """ END AS predicted, CASE WHEN available THEN """ + _BEST + """ ELSE 0.0 END AS predicted_score,
 """ + _PICK("{}") + " AS expected_score, CASE WHEN available AND expected = 'none' THEN " + _BEST + " ELSE " + _OTHER + " END AS best_other, " + _PICK("{}_rank") + " AS expected_rank, " + _PICK("{}_shift") + " AS expected_shift, CASE WHEN available THEN COALESCE(" + "CASE expected " + " ".join(f"WHEN '{m}' THEN {_LABELS.format(m)}" for m in MODES) + " END, '') ELSE '' END AS expected_priority, CASE WHEN available AND expected = 'none' THEN " + _BEST + """ END AS control_score FROM j),
q AS (SELECT *, expected_score - best_other AS margin, COALESCE(expected_score - best_other > 0, FALSE) AS is_top, predicted = expected AS primary_correct, CASE WHEN predicted = '__missing_prediction__' THEN FALSE WHEN expected = 'none' THEN predicted = 'none' ELSE predicted = expected OR (expected = 'scarcity' AND predicted = 'balance') END AS acceptable_correct FROM p)
"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A benchmark of all suppliers by nation and balance: some are unknown to the ranking, some are controls."""
    scored = weighted_scores(spark, sf_dir)
    ranked = ranking.competition_rank(scored, "baseline", F.lit(True), "base")
    for m in MODES:
        ranked = ranking.unique_rank(ranked, f"{m}_score", "baseline", "s_suppkey", f"{m}_rank")
    ranked = ranked.withColumns({f"{m}_shift": F.col("base") - F.col(f"{m}_rank") for m in MODES} | {f"{m}_priority": fn.priority_label(F.col(f"{m}_score")) for m in MODES}).drop("baseline")
    unknown = F.col("s_acctbal").between(2000, 3500)
    expected = F.when(F.col("s_acctbal") < 0, "none").when(F.col("s_nationkey") < 8, "volume").when(F.col("s_nationkey") < 17, "balance").otherwise("scarcity")
    accepted = F.when(expected == "scarcity", F.array(F.lit("scarcity"), F.lit("balance"))).otherwise(F.array(expected))
    spec = table(spark, sf_dir, "supplier").select(F.when(unknown, -F.col("s_suppkey")).otherwise(F.col("s_suppkey")).alias("s_suppkey"), expected.alias("expected"), accepted.alias("accepted"))
    return evaluate.benchmark_predictions(spec, ranked, "s_suppkey", MODES)


_PREDICTED_COLUMNS = ["s_suppkey", "expected", "available", "predicted", "predicted_score", "expected_score", "best_other", "expected_rank", "expected_shift", "expected_priority", "control_score", "margin", "is_top", "primary_correct", "acceptable_correct"]


@register(f"WITH {SPEC} SELECT {', '.join(_PREDICTED_COLUMNS)} FROM q")
def benchmark_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).select(*_PREDICTED_COLUMNS)


_MEAN = "ROUND(AVG({}), 6)"
_INTENTS = """i AS (SELECT expected, COUNT(*) AS expected_count, CAST(COUNT_IF(available) AS BIGINT) AS covered_count, ROUND(COUNT_IF(available)::DOUBLE / COUNT(*), 6) AS coverage, ROUND(COALESCE(COUNT_IF(available AND primary_correct)::DOUBLE / NULLIF(COUNT_IF(available), 0), 0), 6) AS primary_accuracy, ROUND(COALESCE(COUNT_IF(available AND acceptable_correct)::DOUBLE / NULLIF(COUNT_IF(available), 0), 0), 6) AS acceptable_accuracy,
 CASE WHEN expected <> 'none' THEN ROUND(AVG(COALESCE(1.0::DOUBLE / expected_rank, 0.0::DOUBLE)), 6) END AS mrr_all, CASE WHEN expected <> 'none' THEN ROUND(COALESCE(AVG(CASE WHEN available THEN 1.0::DOUBLE / expected_rank END), 0), 6) END AS mrr_covered, CASE WHEN expected <> 'none' THEN ROUND(AVG(expected_rank) FILTER (available), 6) END AS mean_rank, CASE WHEN expected <> 'none' THEN ROUND(AVG(expected_shift) FILTER (available), 6) END AS mean_shift,
 CASE WHEN expected <> 'none' THEN ROUND(AVG(expected_score) FILTER (available), 6) END AS mean_score, CASE WHEN expected <> 'none' THEN ROUND(AVG(margin) FILTER (available), 6) END AS mean_margin, CASE WHEN expected <> 'none' THEN ROUND(COALESCE(COUNT_IF(available AND is_top)::DOUBLE / NULLIF(COUNT_IF(available), 0), 0), 6) END AS specificity, ROUND(AVG(control_score) FILTER (available AND expected = 'none'), 6) AS mean_control_score,
 CASE WHEN expected <> 'none' THEN CAST(COUNT_IF(COALESCE(expected_rank <= 10, FALSE)) AS BIGINT) END AS hits_10, CASE WHEN expected <> 'none' THEN ROUND(COUNT_IF(COALESCE(expected_rank <= 10, FALSE))::DOUBLE / COUNT(*), 6) END AS recall_10_all, CASE WHEN expected <> 'none' THEN ROUND(COALESCE(COUNT_IF(available AND COALESCE(expected_rank <= 10, FALSE))::DOUBLE / NULLIF(COUNT_IF(available), 0), 0), 6) END AS recall_10_covered FROM q GROUP BY 1)"""


@register(f"WITH {SPEC}, {_INTENTS} SELECT * FROM i")
def intent_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.intent_metrics(predictions(spark, sf_dir), [10], 6)


@register(f"""WITH {SPEC}, {_INTENTS}, m AS (SELECT ROUND(AVG(mrr_all), 6) AS mean_mrr_all, ROUND(AVG(mrr_covered), 6) AS mean_mrr_covered, ROUND(AVG(recall_10_all), 6) AS mean_recall_10_all, ROUND(AVG(recall_10_covered), 6) AS mean_recall_10_covered FROM i WHERE expected <> 'none'),
w AS (SELECT COUNT(*) AS n, CAST(COUNT_IF(available) AS BIGINT) AS n_covered, CAST(COUNT_IF(NOT available) AS BIGINT) AS n_missing, ROUND(COUNT_IF(available)::DOUBLE / COUNT(*), 6) AS coverage, ROUND(COUNT_IF(available AND predicted_score > 0.3)::DOUBLE / COUNT(*), 6) AS retrieval_coverage, ROUND(COUNT_IF(primary_correct)::DOUBLE / COUNT(*), 6) AS primary_accuracy_all, ROUND(COUNT_IF(available AND primary_correct)::DOUBLE / COUNT_IF(available), 6) AS primary_accuracy_covered,
 ROUND(COUNT_IF(acceptable_correct)::DOUBLE / COUNT(*), 6) AS acceptable_accuracy_all, ROUND(COUNT_IF(available AND acceptable_correct)::DOUBLE / COUNT_IF(available), 6) AS acceptable_accuracy_covered, ROUND(COUNT_IF(available AND expected <> 'none' AND is_top)::DOUBLE / COUNT_IF(available AND expected <> 'none'), 6) AS specificity_covered,
 ROUND(COUNT_IF(available AND expected = 'none' AND predicted = 'none')::DOUBLE / COUNT_IF(available AND expected = 'none'), 6) AS controls_not_prioritized, ROUND(AVG(control_score), 6) AS mean_control_score FROM q) SELECT * FROM w, m""")
def benchmark_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.benchmark_summary(predictions(spark, sf_dir), F.col("predicted_score") > 0.3, [10], 6)


@register(f"""WITH {FEATURES_SQL}, s AS (SELECT s_suppkey, baseline, {score_sql(PROFILES[0])} AS a, {score_sql(PROFILES[1])} AS b FROM f),
t AS (SELECT s_suppkey, 0 AS list, place FROM (SELECT s_suppkey, ROW_NUMBER() OVER (ORDER BY a DESC, baseline DESC, s_suppkey) AS place FROM s) WHERE place <= 10 UNION ALL SELECT s_suppkey, 1, place FROM (SELECT s_suppkey, ROW_NUMBER() OVER (ORDER BY b DESC, baseline DESC, s_suppkey) AS place FROM s) WHERE place <= 10),
m AS (SELECT s_suppkey, MIN(list * 1000 + place) AS seen FROM t GROUP BY 1) SELECT s_suppkey, CAST(ROW_NUMBER() OVER (ORDER BY seen, s_suppkey) AS BIGINT) AS position FROM m""")
def top_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = weighted_scores(spark, sf_dir)
    tops = [ranking.top_per_group(scored, [], [F.desc(f"{p.name}_score"), F.desc("baseline"), F.asc("s_suppkey")], 10) for p in PROFILES[:2]]
    return evaluate.union_of_tops(tops, "s_suppkey", "place")


_FACTS = """o AS (SELECT CAST(user_id AS VARCHAR) AS target, CASE event_type WHEN 'purchase' THEN 'known_drug' WHEN 'error' THEN 'safety' ELSE 'tractability' END AS dimension, CASE WHEN event_type IN ('purchase', 'error') THEN NULL WHEN value > 100 THEN 'small_molecule' ELSE 'antibody' END AS modality, event_type AS factor,
 CASE WHEN value < 20 THEN NULL ELSE CAST(value > 250 AS VARCHAR) END AS value, CASE WHEN value < 5 OR value IS NULL THEN 'not_available' WHEN value < 20 THEN 'not_observed' ELSE 'observed' END AS availability FROM events),
x AS (SELECT *, availability IN ('observed', 'conflicting') AND COALESCE(MIN(value) OVER g <> MAX(value) OVER g, FALSE) AS contradictory FROM o WINDOW g AS (PARTITION BY target, dimension, modality, factor)),
y AS (SELECT target, dimension, modality, availability, contradictory FROM x UNION ALL SELECT target, dimension, NULL, availability, contradictory FROM x WHERE dimension = 'tractability' AND modality IS NOT NULL),
c AS (SELECT target, dimension, modality, CAST(COUNT_IF(availability = 'observed') AS BIGINT) AS n_observed, CAST(COUNT_IF(availability = 'not_observed') AS BIGINT) AS n_not_observed, CAST(COUNT_IF(availability = 'not_available') AS BIGINT) AS n_not_available, CAST(0 AS BIGINT) AS n_retrieval_failed, CAST(COUNT_IF(contradictory) AS BIGINT) AS n_conflicting, CAST(0 AS BIGINT) AS n_unsupported FROM y GROUP BY 1, 2, 3),
v AS (SELECT *, CASE WHEN n_conflicting > 0 THEN 'conflicting' WHEN n_observed > 0 AND n_not_available > 0 THEN 'partial' WHEN n_observed > 0 THEN 'observed' WHEN n_not_observed > 0 AND n_not_available = 0 THEN 'observed' WHEN n_not_available > 0 THEN 'not_available' ELSE 'partial' END AS state FROM c)"""
DIMENSIONS = ("known_drug", "safety", "tractability")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations of their users: three dimensions, two modalities, and values that are missing in two ways."""
    kind, value = F.col("event_type"), F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("target"), F.when(kind == "purchase", "known_drug").when(kind == "error", "safety").otherwise("tractability").alias("dimension"),
        F.when(~kind.isin("purchase", "error"), F.when(value > 100, "small_molecule").otherwise("antibody")).alias("modality"), kind.alias("factor"),
        F.when(value >= 20, (value > 250).cast("string")).alias("value"), F.when((value < 5) | value.isNull(), "not_available").when(value < 20, "not_observed").otherwise("observed").alias("availability"),
    )


@register(f"WITH {_FACTS} SELECT * FROM v")
def feasibility_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feasibility.coverage(facts(spark, sf_dir))


@register(f"""WITH {_FACTS}, r AS (SELECT CAST(c_custkey AS VARCHAR) AS request_id, CASE WHEN c_acctbal < -900 THEN '' ELSE CAST(c_custkey AS VARCHAR) END AS target, CASE WHEN c_nationkey = 3 THEN 'other' ELSE 'gene_symbol' END AS id_type, CASE WHEN c_nationkey = 4 THEN 'r2' ELSE 'r1' END AS source_release, c_acctbal, c_nationkey, c_mktsegment FROM customer),
h AS (SELECT target, COUNT_IF(state <> 'observed') > 0 AS gaps FROM v GROUP BY 1),
z AS (SELECT r.*, h.gaps, CASE WHEN r.target = '' OR id_type = 'other' THEN 'invalid_request' WHEN c_mktsegment = 'MACHINERY' AND c_acctbal > 9000 THEN 'invalid_fetch_result' WHEN c_nationkey = 5 THEN 'target_unresolved' WHEN c_nationkey = 6 THEN 'target_ambiguous' WHEN c_nationkey = 7 THEN 'target_retrieval_failed' WHEN c_acctbal > 8500 THEN 'target_record_missing' WHEN source_release = 'r2' THEN 'source_release_mismatch' WHEN c_nationkey = 8 THEN 'unsupported_source_shape' WHEN c_mktsegment = 'BUILDING' OR COALESCE(h.gaps, TRUE) THEN 'built_with_gaps' ELSE 'built' END AS status FROM r LEFT JOIN h ON h.target = r.target)
SELECT request_id, target, status FROM z""")
def feasibility_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_states(spark, sf_dir).select("request_id", "target", "status")


def profile_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    key, nation, balance = F.col("c_custkey").cast("string"), F.col("c_nationkey"), F.col("c_acctbal")
    target, kind = F.when(balance < -900, "").otherwise(key), F.when(nation == 3, "other").otherwise("gene_symbol")
    requests = customers.select(key.alias("request_id"), target.alias("target"), kind.alias("id_type"), F.when(nation == 4, "r2").otherwise("r1").alias("source_release"))
    state = F.when(nation == 5, "unresolved").when(nation == 6, "ambiguous").when(nation == 7, "retrieval_failed").otherwise("resolved_exact")
    resolutions = customers.where(~((F.col("c_mktsegment") == "MACHINERY") & (balance > 9000))).select(target.alias("target"), kind.alias("id_type"), state.alias("status"), key.alias("resolved_id"))
    records = customers.where(balance <= 8500).select(key.alias("resolved_id"), F.lit("r1").alias("release"), (F.col("c_mktsegment") != "BUILDING").alias("verified"), (nation != 8).alias("shape_ok"))
    return feasibility.profile_status(requests, resolutions, records, feasibility.coverage(facts(spark, sf_dir)))


@register(f"""WITH {_FACTS} SELECT 'dimension' AS kind, dimension AS name, CAST(SUM(n_observed) AS BIGINT) AS n FROM v WHERE modality IS NULL GROUP BY 2 UNION ALL SELECT 'modality', modality, CAST(SUM(n_observed) AS BIGINT) FROM v WHERE dimension = 'tractability' AND modality IS NOT NULL GROUP BY 2""")
def feasibility_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    covered = feasibility.coverage(facts(spark, sf_dir))
    return feasibility.batch_totals(profile_states(spark, sf_dir), covered).where("kind <> 'status'")


@register(f"""WITH {_FACTS}, a AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS target, 'antibody' AS modality FROM events), d AS (SELECT UNNEST(['known_drug', 'safety', 'tractability']) AS dimension),
e AS (SELECT target, dimension, modality, COUNT(*) AS n, COUNT_IF(contradictory) AS bad FROM x GROUP BY 1, 2, 3)
SELECT a.target, a.modality, d.dimension, COALESCE(o.n, 0) AS n_own, COALESCE(w.n, 0) AS n_context, CAST(COALESCE(o.bad, 0) + COALESCE(w.bad, 0) AS BIGINT) AS n_contradictory, COALESCE(vo.state, CASE WHEN o.n > 0 THEN 'observed' END, 'not_available') AS own_state, COALESCE(vw.state, CASE WHEN w.n > 0 THEN 'observed' END, 'not_available') AS context_state
FROM a CROSS JOIN d LEFT JOIN e o ON o.target = a.target AND o.dimension = d.dimension AND o.modality = a.modality LEFT JOIN e w ON w.target = a.target AND w.dimension = d.dimension AND w.modality IS NULL LEFT JOIN v vo ON vo.target = a.target AND vo.dimension = d.dimension AND vo.modality = a.modality LEFT JOIN v vw ON vw.target = a.target AND vw.dimension = d.dimension AND vw.modality IS NULL""")
def feasibility_composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = facts(spark, sf_dir)
    wanted = obs.select("target").distinct().withColumn("modality", F.lit("antibody"))
    return feasibility.compose(wanted, obs, feasibility.coverage(obs), DIMENSIONS)


@register("""WITH a AS (SELECT source, CONTAINS(LOWER(text), 'password') AS bad, CONTAINS(LOWER(text), 'license') AS doubt FROM documents)
SELECT source, CASE WHEN BOOL_OR(bad) THEN 'block' WHEN BOOL_OR(doubt) THEN 'review' ELSE 'pass' END AS decision FROM a GROUP BY 1""")
def claim_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    audited = claims.audit(docs, {"secret": ("blocker", ["password"]), "legal": ("warning", ["license"])}, "text")
    return claims.roll_up(audited, docs, "source")


@register("""SELECT p.p_partkey, COALESCE(CASE WHEN p.p_size <= 10 THEN 'small' WHEN p.p_size <= 20 THEN 'early' END, 'unclear') AS role FROM part p""")
def rule_table_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = spark.range(1, 11).select(F.col("id").cast("int").alias("p_size"), F.lit(1).alias("priority"), F.lit("small").alias("role"))
    wide = spark.range(1, 21).select(F.col("id").cast("int").alias("p_size"), F.lit(2).alias("priority"), F.lit("early").alias("role"))
    return rules.rule_table(table(spark, sf_dir, "part"), low.unionByName(wide), "p_size", ["role"], {"role": "unclear"}).select("p_partkey", "role")
