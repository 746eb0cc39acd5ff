"""A local release of matrices, checked and indexed: what a run needs before it profiles targets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators import universe
from loomwork.sources import associations, matrices, sinks


def associated(spark: SparkSession, path: str, page_size: int = 100, pages: int = 3) -> DataFrame:
    """Associations as they landed: flattened, ordered by score, and as many as the first pages hold."""
    return associations.first_pages(associations.flatten(associations.read_payloads(spark, path)), page_size, pages)


def model_coverage(index: DataFrame) -> DataFrame:
    """One row: models in both matrices, in one alone, and without metadata."""
    left, right, meta = F.col("in_left"), F.col("in_right"), F.col("in_metadata")
    return index.agg(
        F.count_if(left & right).alias("n_shared"), F.count_if(left & ~right).alias("n_only_left"), F.count_if(right & ~left).alias("n_only_right"),
        F.count_if((left | right) & ~meta).alias("n_without_metadata"), F.count_if(meta & ~left & ~right).alias("n_metadata_alone"),
    )


def ingest(spark: SparkSession, root: str, manifest: DataFrame, effect: str, probability: str, metadata: str, key: str, requests: Sequence[str], formats: Sequence[str] = ("csv", "tsv", "txt")) -> dict[str, DataFrame]:
    """The tables of an ingestion: states of files, structural issues, label indices, models, coverage, resolved
    requests, and both matrices pruned to the resolved labels.

    A request is a symbol or a number; it is resolved if one label has it, see ``universe.resolve``.
    """
    left, right = (matrices.read_wide(spark, f"{root}/{name}") for name in (effect, probability))
    rows, metadata_issues = matrices.read_keyed(spark, f"{root}/{metadata}", key)
    labels = matrices.label_index(left, key).withColumn("role", F.lit("effect")).unionByName(matrices.label_index(right, key).withColumn("role", F.lit("probability")))
    index = matrices.presence_index(left, right, rows.drop("source_row"), key)
    good = labels.where("state = 'resolved'")
    names = good.select(F.explode(F.array(F.upper("symbol"), F.col("number"))).alias("name"), "label")
    wanted = spark.createDataFrame([(k, r) for k, r in enumerate(requests)], "place int, request string")
    resolved = universe.resolve(wanted, names, "request", "name", "label")
    issues = matrices.structure_issues(left, key).withColumn("file", F.lit(effect)).unionByName(matrices.structure_issues(right, key).withColumn("file", F.lit(probability)))
    issues = issues.select(F.col(key).alias("where"), "issue", "file").unionByName(metadata_issues.withColumn("file", F.lit(metadata)))
    chosen = [r.label for r in resolved.where("state = 'resolved'").select("label").distinct().collect()]  # a label for each request
    return {
        "files": matrices.release_state(matrices.file_digests(spark, root), manifest, formats), "issues": issues, "labels": labels, "models": index, "coverage": model_coverage(index),
        "targets": resolved, "effect_subset": matrices.subset(left, key, chosen), "probability_subset": matrices.subset(right, key, chosen),
    }


def save(tables: Mapping[str, DataFrame], path: str, **manifest: str) -> None:
    """The tables of an ingestion as a bundle, unless a file of the release isn't as its manifest says."""
    sinks.write_bundle(dict(tables), path, manifest, checks={"files": tables["files"].where("state <> 'verified'")})
