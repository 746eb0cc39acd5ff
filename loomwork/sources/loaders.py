"""Benchmarks, universes, profiles and bundles as tables, with the checks that belong to them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import normalize_symbol, safe_bool
from loomwork.operators.release import tree_issues
from loomwork.sources.matrices import file_digests, release_state


def benchmark_rows(spark: SparkSession, config: Mapping[str, object]) -> DataFrame:
    """A row for each target of each group of a benchmark: intent, group, symbol, expected role, accepted intents."""
    rows = [(g["intent"], name, t["symbol"], t.get("role", g.get("role")), list(t.get("accepted", g.get("accepted", [g["intent"]])))) for name, g in config["groups"].items() for t in g["targets"]]
    found = spark.createDataFrame(rows, "expected string, `group` string, symbol string, expected_role string, accepted array<string>")
    return found.withColumn("symbol", normalize_symbol(F.col("symbol"))).orderBy("expected", "group", "symbol")


def benchmark_issues(rows: DataFrame, modes: Sequence[str]) -> DataFrame:
    """(symbol, issue): blank symbols, symbols of several groups, intents that are no mode, an expected intent that isn't accepted."""
    known = F.array(*map(F.lit, [*modes, "none"]))
    rules = [(F.col("symbol") == "", "blank_symbol"), (~F.array_contains(known, F.col("expected")), "unknown_intent"), (F.size(F.array_except("accepted", known)) > 0, "unknown_accepted"), ((F.col("expected") != "none") & ~F.expr("array_contains(accepted, expected)"), "expected_not_accepted")]
    own = rows.select("symbol", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(i)) for c, i in rules)))).alias("issue"))
    twice = rows.where("symbol <> ''").groupBy("symbol").count().where("count > 1").select("symbol", F.lit("repeated_symbol").alias("issue"))
    return own.unionByName(twice)


def missing_columns(df: DataFrame, needed: Sequence[str]) -> list[str]:
    return [c for c in needed if c not in df.columns]


def read_profiles(spark: SparkSession, path: str, schema: str, identity: str, request: str) -> DataFrame:
    """Profiles from JSON lines with ``key``: the canonical identity, or the request where there is none."""
    return spark.read.schema(schema).json(path).withColumn("key", F.coalesce(F.nullif(F.trim(identity), F.lit("")), F.col(request)))


def policy_rows(df: DataFrame, group: str, wanted: Sequence[str]) -> DataFrame:
    """The rows of a universe's groups, symbols normalised; a symbol once."""
    return df.where(F.col(group).isin(*wanted)).withColumn("symbol", normalize_symbol(F.col("symbol"))).where("symbol <> ''").groupBy("symbol").agg(F.min(group).alias(group))


def frozen(benchmark: DataFrame, discovery: DataFrame, background: DataFrame, key: str) -> DataFrame:
    """One row: sizes of three universes, of all their overlaps, and of what is in one alone."""
    flag = lambda df, name: df.select(key).where(F.col(key).isNotNull()).distinct().withColumn(name, F.lit(True))
    names = ("benchmark", "discovery", "background")
    joined = flag(benchmark, "benchmark").join(flag(discovery, "discovery"), key, "full").join(flag(background, "background"), key, "full")
    a, b, c = (F.coalesce(F.col(n), F.lit(False)) for n in names)
    out = {"n_benchmark": a, "n_discovery": b, "n_background": c, "n_benchmark_discovery": a & b, "n_benchmark_background": a & c, "n_discovery_background": b & c, "n_all": a & b & c, "n_benchmark_only": a & ~b & ~c, "n_discovery_only": b & ~a & ~c, "n_background_only": c & ~a & ~b}
    return joined.agg(*(F.count_if(x).alias(n) for n, x in out.items()))


def leakage(discovery: DataFrame, benchmark: DataFrame, key: str, markers: Sequence[str] = ("benchmark", "holdout", "expected")) -> DataFrame:
    """(key, issue): discovery rows that a benchmark put there: their source names one, though they are on it."""
    source = F.lower(F.coalesce(F.col("source"), F.lit("")))
    named = F.lit(False)
    for m in markers:
        named = named | F.contains(source, F.lit(m))
    return discovery.where(named).join(benchmark.select(key).distinct(), key, "left_semi").select(key, F.lit("selected_by_benchmark").alias("issue"))


def canonical_identities(rows: DataFrame, frozen_rows: DataFrame, original: str, canonical: str) -> DataFrame:
    """The rows with the canonical identity of their original one; null where none, or several, are frozen."""
    one = frozen_rows.groupBy(F.col(original).alias("__o")).agg(F.min(canonical).alias(canonical), F.max(canonical).alias("__m")).where(F.col(canonical) == F.col("__m")).drop("__m")
    return rows.join(one, F.col(original) == F.col("__o"), "left").drop("__o")


def bundle_issues(spark: SparkSession, path: str, checksums: DataFrame, known: DataFrame, profiles: DataFrame, key: str) -> DataFrame:
    """(name, issue) of a portable bundle: files whose digest isn't declared or differs, local paths, unknown targets."""
    files = file_digests(spark, path)
    state = release_state(files, checksums).where("state <> 'verified'").select("name", F.col("state").alias("issue"))
    unknown = profiles.select(F.col(key).cast("string").alias("name")).join(known.select(F.col(key).cast("string").alias("name")), "name", "left_anti").select("name", F.lit("unknown_target").alias("issue"))
    return state.unionByName(tree_issues(files)).unionByName(unknown)


def run_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """(name, state) of the files of a run, against the digests in its ``manifest.json``: a list ``files`` of name and sha256."""
    entries = spark.read.schema("files array<struct<name:string,length:bigint,sha256:string>>").json(f"{path}/manifest.json", multiLine=True).select(F.explode("files").alias("f")).select("f.*")
    return release_state(file_digests(spark, path).where("name <> 'manifest.json'"), entries)


def available(df: DataFrame, column: str = "has_evidence") -> DataFrame:
    """The rows whose evidence flag, in any spelling, is true."""
    return df.where(safe_bool(F.col(column)))
