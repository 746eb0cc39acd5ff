"""Entities and the axes of an ontology: inversion of axis lists, and 1:n annotation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions import normalize_symbol


def axis_index(ontology: DataFrame, members: str = "members") -> DataFrame:
    """(symbol, axis columns, ord): one row per member of an axis; ``ord`` keeps the order of the axes."""
    other = [c for c in ontology.columns if c != members]
    return ontology.select(*other, F.explode(members).alias("symbol")).withColumn("symbol", normalize_symbol(F.col("symbol"))).where("symbol <> ''").dropDuplicates(["symbol", "axis_id"])


def annotate(df: DataFrame, index: DataFrame, key: str = "symbol", unmapped: str = "unmapped") -> DataFrame:
    """Axis ids and labels in axis order, roles as a sorted set, a score and a confidence.

    The score is 0.75 for one axis and 0.15 more for each further, at most 1; unmatched entities get ``unmapped`` and 0.
    """
    by_symbol = index.groupBy("symbol").agg(
        F.array_sort(F.collect_list(F.struct("ord", "axis_id", "label"))).alias("axes"),
        F.array_sort(F.collect_set("role")).alias("roles"),
    )
    joined = df.join(by_symbol.withColumnRenamed("symbol", "__symbol"), normalize_symbol(F.col(key)) == F.col("__symbol"), "left")
    n = F.coalesce(F.size("axes"), F.lit(0))
    mapped = n > 0
    return joined.select(
        *df.columns,
        F.when(mapped, F.concat_ws("; ", "axes.axis_id")).otherwise(unmapped).alias("axis_ids"),
        F.when(mapped, F.concat_ws("; ", "axes.label")).otherwise(unmapped).alias("axis_labels"),
        F.when(mapped, F.concat_ws(" | ", "roles")).otherwise("").alias("axis_roles"),
        n.cast("long").alias("n_axes"),
        F.when(mapped, F.least(F.lit(1.0), F.lit(0.75) + F.lit(0.15) * (n - 1))).otherwise(0.0).alias("axis_score"),
        F.when(n >= 2, "high").when(mapped, "medium").otherwise("low").alias("axis_confidence"),
    )
