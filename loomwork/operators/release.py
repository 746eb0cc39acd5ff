"""Releases: preflight, comparison of runs, criteria, inventories and what may not be published."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import criterion

#: Bytes that a published file, page and bundle may have.
FILE_LIMIT, PAGE_LIMIT, BUNDLE_LIMIT = 5 << 20, 2 << 20, 30 << 20
LOCAL_PATH = r"(?:/(?:home|root|tmp|Users|mnt|private)/)|(?:[A-Za-z]:\\\\)|(?:file://)"


def preflight(inputs: DataFrame, files: DataFrame) -> DataFrame:
    """(name, state) of every input that a run needs: missing, empty, not as declared, a fixture posing as real, or ready.
    ``inputs`` has (name, sha256, is_fixture, scope), ``files`` (name, length, sha256)."""
    joined = inputs.join(files.select("name", "length", F.col("sha256").alias("__have")), "name", "left")
    state = F.when(F.col("__have").isNull(), "missing").when(F.col("length") == 0, "empty").when(F.col("sha256").isNotNull() & (F.col("sha256") != F.col("__have")), "hash_mismatch").when(F.col("is_fixture") & (F.col("scope") != "synthetic_fixture"), "fixture_not_labelled").otherwise("ready")
    return joined.select("name", state.alias("state"))


def compare_runs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(name, state) of the files of two runs: equal, different, or in one alone."""
    a, b = left.select("name", F.col("sha256").alias("__a")), right.select("name", F.col("sha256").alias("__b"))
    state = F.when(F.col("__a").isNull(), "only_right").when(F.col("__b").isNull(), "only_left").when(F.col("__a") == F.col("__b"), "equal").otherwise("different")
    return a.join(b, "name", "full").select("name", state.alias("state"))


def judged(criteria: DataFrame) -> DataFrame:
    """(criterion, observed, op, bound, mandatory) with ``result``."""
    return criteria.withColumn("result", criterion(F.col("observed"), F.col("op"), F.col("bound")))


def release_state(criteria: DataFrame, fixture: Column, reproduced: Column | None = None) -> DataFrame:
    """One row ``state``: a fixture run is never more than that; then unavailable and failed criteria, then reproduction."""
    bad = lambda result: F.count_if(F.col("mandatory") & (F.col("result") == result)) > 0
    chain = F.when(F.bool_or(fixture), "fixture_only").when(bad("unavailable"), "incomplete").when(bad("fail"), "criteria_failed")
    if reproduced is not None:
        chain = chain.when(~F.bool_and(reproduced), "not_reproduced")
    return judged(criteria).agg(chain.otherwise("ready").alias("state"))


def tree_issues(files: DataFrame, file_limit: int = FILE_LIMIT, page_limit: int = PAGE_LIMIT, bundle_limit: int = BUNDLE_LIMIT) -> DataFrame:
    """(name, issue) of files (name, length, content) that may not be published: too large, or with local paths in them;
    and a row for a bundle that is too large as a whole."""
    text = F.decode("content", "UTF-8")
    rules = [(F.col("length") > file_limit, "file_too_large"), (F.col("name").endswith(".html") & (F.col("length") > page_limit), "page_too_large"), (~F.col("name").rlike(r"\.(png|parquet)$") & text.rlike(LOCAL_PATH), "local_path")]
    own = files.select("name", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(i)) for c, i in rules)))).alias("issue"))
    whole = files.agg(F.sum("length").alias("n")).where(F.col("n") > bundle_limit).select(F.lit("(bundle)").alias("name"), F.lit("bundle_too_large").alias("issue"))
    return own.unionByName(whole)


def count_issues(df: DataFrame, wanted: dict[str, int], by: str) -> DataFrame:
    """(value, wanted, found) of values whose number of rows isn't the pinned one."""
    table = df.sparkSession.createDataFrame(list(wanted.items()), f"`{by}` string, wanted long")
    found = df.groupBy(F.col(by).cast("string").alias(by)).agg(F.count(F.lit(1)).alias("found"))
    return table.join(found, by, "full").select(F.col(by).alias("value"), F.coalesce("wanted", F.lit(0)).alias("wanted"), F.coalesce("found", F.lit(0)).alias("found")).where("wanted <> found")


def one_of(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """The value that all sources agree on, null where they don't or none has one."""
    n = F.count_distinct(column)
    return df.groupBy(*by).agg(F.when(n == 1, F.min(column)).alias(column), n.alias("n_values"))


def same_members(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of the keys that only one side has: none if the sets are equal."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def replaced(values: Column, old: str, new: str) -> Column:
    """An array with one value put in another's place."""
    return F.transform(values, lambda x: F.when(x == old, F.lit(new)).otherwise(x))
