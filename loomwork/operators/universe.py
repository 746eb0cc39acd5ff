"""Entity universes: augmentation, union, overlap, reconciliation and resolution of requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions import first_usable, normalize_symbol
from loomwork.session import cut_lineage


def augment(df: DataFrame, required: DataFrame, key: str, score: str, source: str = "source", carried: Sequence[str] = ("disease_id", "disease_name")) -> DataFrame:
    """Required symbols that are missing are added with score 0, no evidence and source ``required_symbol``.

    A flag ``has_evidence`` and a source that rows have already are kept; a missing flag is false and a missing source
    ``association``. Added rows carry the least value of each of ``carried`` that the table has.
    """
    wanted = required.select(normalize_symbol(F.col(required.columns[0])).alias(key)).where(F.col(key) != "").distinct()
    have = df.select(normalize_symbol(F.col(key)).alias(key)).distinct()
    added = wanted.join(have, key, "left_anti").select(key, F.lit(0.0).alias(score), F.lit(False).alias("has_evidence"), F.lit("required_symbol").alias(source))
    if shared := [c for c in carried if c in df.columns]:
        added = added.join(F.broadcast(df.agg(*(F.min(first_usable(F.col(c))).alias(c) for c in shared))), how="left")
    flag = F.coalesce("has_evidence", F.lit(False)) if "has_evidence" in df.columns else F.col(score).isNotNull()
    base = df.withColumns({"has_evidence": flag, source: F.coalesce(source, F.lit("association")) if source in df.columns else F.lit("association")})
    return base.unionByName(added, allowMissingColumns=True)


def union_missing(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All of the first and what of the second it hasn't got."""
    return first.unionByName(second.join(first.select(key), key, "left_anti"), allowMissingColumns=True)


def overlap(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """Sizes of two sets, their intersection and differences."""
    a, b = left.select(key).distinct().withColumn("__a", F.lit(1)), right.select(key).distinct().withColumn("__b", F.lit(1))
    both = a.join(b, key, "full")
    inside = lambda c: F.col(c).isNotNull()
    return both.agg(
        F.count("__a").alias(f"n_{names[0]}"), F.count("__b").alias(f"n_{names[1]}"), F.count_if(inside("__a") & inside("__b")).alias("n_both"),
        F.count_if(inside("__a") & ~inside("__b")).alias(f"n_only_{names[0]}"), F.count_if(~inside("__a") & inside("__b")).alias(f"n_only_{names[1]}"),
    )


def unambiguous(df: DataFrame, key: str, label: str) -> DataFrame:
    """Keys with one distinct label."""
    return df.groupBy(key).agg(F.min(label).alias(label), F.max(label).alias("__m")).where(F.col(label) == F.col("__m")).drop("__m")


def resolve(requests: DataFrame, labels: DataFrame, request: str, key: str, label: str) -> DataFrame:
    """Each request's label and state: resolved, ambiguous, unresolved, duplicate or invalid."""
    found = labels.groupBy(F.col(key).alias("__k")).agg(F.count_distinct(label).alias("n_labels"), F.min(label).alias(label))
    wanted = normalize_symbol(F.col(request))
    rows = cut_lineage(requests.withColumns({"__q": wanted, "__row": F.monotonically_increasing_id()}))
    joined = rows.join(found, F.col("__q") == F.col("__k"), "left")
    # the first row of a request is found by an aggregate, not by a window: a request may be that of a third of all rows
    first = joined.groupBy(F.col("__q").alias("__f")).agg(F.min(F.struct(*requests.columns, "__row")).alias("__first"))
    joined = joined.join(first, F.col("__q").eqNullSafe(F.col("__f")), "left")
    n = F.coalesce("n_labels", F.lit(0))
    state = F.when(F.col("__q") == "", "invalid").when(n == 0, "unresolved").when(n > 1, "ambiguous").when(F.col("__first.__row") != F.col("__row"), "duplicate").otherwise("resolved")
    return joined.withColumn("state", state).select(*requests.columns, F.when(n == 1, F.col(label)).alias("label"), "state")


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row per key with the presence on both sides."""
    a, b = left.select(key).distinct().withColumn("__a", F.lit(True)), right.select(key).distinct().withColumn("__b", F.lit(True))
    return a.join(b, key, "full").select(key, F.col("__a").isNotNull().alias("in_left"), F.col("__b").isNotNull().alias("in_right"))
