"""What reports show: heat maps, histograms, cards, coverage, and views for checking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import canonical_unordered, is_missing, safe_str
from loomwork.operators.merkle import identity

#: States of evidence that a card shows, and that an audit shows.
CARD_STATES = ("citation_verified", "manually_curated")


def heat_matrix(df: DataFrame, chosen: DataFrame, key: str, scores: Sequence[str], name: str = "best") -> DataFrame:
    """The chosen entities once, with their scores and the largest of them, by which they are to be ordered."""
    one = df.join(chosen.select(key).distinct(), key, "left_semi").groupBy(key).agg(*(F.max(s).alias(s) for s in scores))
    return one.withColumn(name, F.greatest(*(F.col(s) for s in scores)))


def matrix_limits(df: DataFrame, scores: Sequence[str]) -> DataFrame:
    """One row: the least and largest score, and cells that are null, below 0 or above 1."""
    cells = df.select(F.explode(F.array(*scores)).alias("x"))
    return cells.agg(F.min("x").alias("least"), F.max("x").alias("most"), F.count_if(F.col("x").isNull()).alias("n_null"), F.count_if((F.col("x") < 0) | (F.col("x") > 1)).alias("n_outside"))


def by_source(df: DataFrame, source: str, score: str, key: str, order: Sequence[str]) -> list[Column]:
    """The order of an augmented universe: sources as listed, larger scores first, keys last; nulls at the end."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col(source)), F.lit(0)), F.lit(len(order) + 1))
    return [place.asc(), F.col(score).desc_nulls_last(), F.col(key).asc_nulls_last()]


def histogram(df: DataFrame, *by: str) -> DataFrame:
    """Rows of each value."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def first_non_missing(df: DataFrame, by: Sequence[str], columns: Sequence[str], order: Column) -> DataFrame:
    """Of each group and column, the first value in the order that says something."""
    return df.groupBy(*by).agg(*(F.min_by(F.col(c), F.when(~is_missing(F.col(c)), F.struct(order.alias("at"), F.col(c).alias("v")))).alias(c) for c in columns))


def decorated(df: DataFrame, extra: DataFrame, key: str, prefix: str) -> DataFrame:
    """The rows with the columns of a table that has one row for each key, and whether it has one."""
    named = extra.withColumnsRenamed({c: f"{prefix}_{c}" for c in extra.columns if c != key}).withColumn(f"has_{prefix}", F.lit(True))
    return df.join(named, key, "left").withColumn(f"has_{prefix}", F.coalesce(f"has_{prefix}", F.lit(False)))


def card_items(items: DataFrame, status: str = "validation_status", states: Sequence[str] = CARD_STATES) -> DataFrame:
    """What a card shows; the other rows are for its audit."""
    return items.where(F.col(status).isin(*states))


def cards(items: DataFrame, key: str, publication: str, family: str, eligible: str) -> DataFrame:
    """A row for each symbol: shown records, distinct publications and families, records that don't count."""
    text = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return items.groupBy(key).agg(F.count(F.lit(1)).alias("n_items"), F.count_distinct(text(publication)).alias("n_publications"), F.count_distinct(F.when(F.col(eligible), text(family))).alias("n_families"), F.count_if(~F.coalesce(F.col(eligible), F.lit(False))).alias("n_ineligible"))


def finalized(items: DataFrame, issues: DataFrame, verified: DataFrame, key: str) -> DataFrame:
    """Every record with what keeps it from being final: rules it breaks, a citation that isn't verified, or nothing."""
    broken = issues.groupBy(F.col(key).alias("__b")).agg(F.count(F.lit(1)).alias("n_issues"))
    checked = verified.select(F.col(key).alias("__v"), "verification")
    joined = items.join(broken, F.col(key) == F.col("__b"), "left").join(checked, F.col(key) == F.col("__v"), "left")
    state = F.when(F.coalesce(F.col("n_issues"), F.lit(0)) > 0, "invalid").when(F.col("verification").isNotNull() & (F.col("verification") != "verified"), "citation_not_verified").otherwise("final")
    return joined.withColumns({"n_issues": F.coalesce("n_issues", F.lit(0)), "state": state}).drop("__b", "__v")


def coverage_ratio(df: DataFrame, state: str, covered: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Distinct states, rows in a covered one, and their share."""
    hit = F.count_if(F.col(state).isin(*covered))
    return df.groupBy(*by).agg(F.count_distinct(state).alias("n_states"), F.count(F.lit(1)).alias("n"), hit.alias("n_covered"), F.try_divide(hit.cast("double"), F.count(F.lit(1)).cast("double")).alias("ratio"))


def exactly_one(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of keys with another number of rows than one."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n <> 1")


def universe_hash(df: DataFrame, key: str) -> DataFrame:
    """One row: how many distinct members a universe has, and the root of a tree over them, which no order changes."""
    members = df.select(safe_str(F.col(key)).alias("m")).where("m <> ''").distinct().withColumn("d", F.sha2("m", 256))
    return identity(members, "m", "d").select(F.col("n_rows").alias("n"), F.col("hash").alias("universe_id"))


def record_id(prefix: str, fields: Mapping[str, Column], lists: Mapping[str, Column]) -> Column:
    """An id of a record that the order of its lists doesn't change."""
    named = [F.coalesce(c.cast("string"), F.lit("null")) for _, c in sorted(fields.items())] + [F.coalesce(canonical_unordered(c), F.lit("null")) for _, c in sorted(lists.items())]
    return F.concat(F.lit(prefix + "_"), F.sha2(F.to_json(F.array(*named)), 256))


def errors_of(predictions: DataFrame) -> DataFrame:
    """Benchmark rows to look at: wrong, missing, or a control that was prioritised."""
    kind = F.when(~F.col("available"), "missing").when((F.col("expected") == "none") & (F.col("predicted") != "none"), "control_prioritized").when(~F.col("acceptable_correct"), "wrong")
    return predictions.withColumn("kind", kind).where("kind is not null")
