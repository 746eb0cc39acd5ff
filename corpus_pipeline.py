"""Corpus pipeline: quality, near-duplicates, repeated passages, benchmark passages, packing.

Every stage works on all rows its predecessor kept. ``run`` writes each stage's rows as Parquet in the
checkpoint folder and reads them again, so that a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from loomwork.llm import decontaminate, packing, quality, simhash, substring
from loomwork.llm.common import small_batches, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(run: Stage) -> Stage:
    """All stages take small batches, nulls in any column, empty tables, repeated rows and further columns."""

    @wraps(run)
    def step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return run(spark, docs, sf_dir)

    return step


@stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling selects. Texts without n-grams weigh 0; without good labels all stay."""
    return quality.selected_rows(docs, table(spark, sf_dir, "labels"))


@stage
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more.

    Null and empty texts are equal texts; rows with a null id stay; different texts under one id are different documents.
    """
    return simhash.one_of_each(docs, width=5, least=0.8)


@stage
def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that a smaller document has are cut out; documents without words left go.

    Texts without words stay as they are, and so do rows with a null id.
    """
    return substring.without_repeats(docs)


@stage
def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; null texts stay null, and texts may become empty."""
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


@stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences; a null text is its end alone. Equal ids are documents of their own."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("benchmark", benchmark_stage),
    ("packing", packing_stage),
]

#: The stages train models, sign texts and tokenize; SQL has none of these.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
