"""Wide measurement matrices, metadata and releases from delimited files."""

from __future__ import annotations

import csv
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import identity, parse_label, safe_release_path
from loomwork.operators.ranking import placed


def header(spark: SparkSession, path: str, separator: str = ",") -> list[str]:
    """The column labels as the file has them, repeats included: Spark's own header option renames these."""
    line = spark.read.text(path).limit(1).collect()
    return next(csv.reader([line[0].value], delimiter=separator)) if line else []


def read_wide(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """All columns as strings; a blank cell is null. Columns of repeated labels are named ``label``, ``label#2``, ``label#3``, so that
    none is lost; the label as the file has it stays with the column's metadata, and ``label_index`` marks repeats."""
    labels, taken, names = header(spark, path, separator), set(), []
    real = set(labels)
    for label in labels:
        name, k = label, 2
        while name in taken or (name != label and name in real):
            name, k = f"{label}#{k}", k + 1
        taken.add(name)
        names.append(name)
    schema = ", ".join(f"`c{k}` string" for k in range(len(names)))
    return spark.read.csv(path, sep=separator, header=True, enforceSchema=True, schema=schema, mode="FAILFAST", nullValue="", emptyValue="").select(*(F.col(f"c{k}").alias(name, metadata={"label": label}) for k, (name, label) in enumerate(zip(names, labels, strict=True))))


def label_index(df: DataFrame, key: str) -> DataFrame:
    """One row per column label with its parts; identities that occur twice are marked, never merged."""
    fields = [f for f in df.schema if f.name != key]
    labels = df.sparkSession.createDataFrame([(k, f.name, f.metadata.get("label", f.name)) for k, f in enumerate(fields)], "place int, name string, label string")
    symbol, number, state = parse_label(F.col("label"))
    parsed = labels.select("place", "name", "label", symbol.alias("symbol"), number.alias("number"), state.alias("state")).withColumn("identity", identity(F.col("symbol"), F.col("number")))
    twice = parsed.where("identity is not null").groupBy("identity").count().where("count > 1").select("identity", F.lit(True).alias("twice"))
    again = parsed.groupBy("label").count().where("count > 1").select("label", F.lit(True).alias("again"))
    marked = parsed.join(twice, "identity", "left").join(again, "label", "left")
    state = F.when(F.col("twice"), "duplicate_identity").when(F.col("again"), "duplicate_label").otherwise(F.col("state"))
    return marked.withColumn("state", state).select("place", "name", "label", "symbol", "number", "state", "identity")


def width_issues(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """(line, cells) of the lines that have another number of cells than the header. For files without line breaks in cells."""
    n = len(header(spark, path, separator))
    cells = F.size(F.split(F.regexp_replace("value", '"[^"]*"', ""), rf"\Q{separator}\E"))
    return spark.read.text(path).select(F.col("value").alias("line"), cells.alias("cells")).where(F.col("cells") != n)


def read_keyed(spark: SparkSession, path: str, key: str, separator: str = ",") -> tuple[DataFrame, DataFrame]:
    """(rows with ``source_row``, issues): a table keyed by a column that must be there and unique. Rows are numbered in file order."""
    rows = read_wide(spark, path, separator).withColumn("__at", F.monotonically_increasing_id())
    numbered = placed(rows, [F.asc("__at")], (), "source_row").drop("__at")
    blank = numbered.where(F.coalesce(F.trim(key), F.lit("")) == "").select(F.col("source_row").cast("string").alias("where"), F.lit("blank_key").alias("issue"))
    twice = numbered.groupBy(key).count().where(f"count > 1 and `{key}` is not null").select(F.col(key).alias("where"), F.lit("repeated_key").alias("issue"))
    return numbered, blank.unionByName(twice)


def reference_labels(spark: SparkSession, path: str, column: str | None = None, separator: str = ",") -> DataFrame:
    """The labels of a reference list with their parts; repeats are marked."""
    rows = read_wide(spark, path, separator)
    label = F.trim(F.col(f"`{column or rows.columns[0]}`"))
    symbol, number, state = parse_label(F.col("label"))
    parsed = rows.select(label.alias("label")).where("label <> ''").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return parsed.select("label", symbol.alias("symbol"), number.alias("number"), F.when(F.col("n") > 1, "duplicate_label").otherwise(state).alias("state")).withColumn("identity", identity(F.col("symbol"), F.col("number")))


def structure_issues(df: DataFrame, key: str) -> DataFrame:
    """(key, issue): empty or repeated keys, and cells that are no numbers."""
    cells = [c for c in df.columns if c != key]
    bad = F.exists(F.array(*(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast("double").isNull() for c in cells)), lambda x: x) if cells else F.lit(False)
    empty = F.coalesce(F.trim(key), F.lit("")) == ""
    rows = df.select(F.col(key), F.array_compact(F.array(F.when(empty, "empty_key"), F.when(bad, "not_numeric"))).alias("issues"))
    repeated = df.where(~empty).groupBy(key).count().where("count > 1").select(key, F.lit("repeated_key").alias("issue"))
    return rows.select(key, F.explode("issues").alias("issue")).unionByName(repeated)


def subset(df: DataFrame, key: str, labels: Sequence[str]) -> DataFrame:
    return df.select(key, *(F.col(f"`{c}`") for c in df.columns if c in set(labels)))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, length, sha256) of the files below a path, read by the executors; the name is the path below that root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = path.rstrip("/").split("://", 1)[-1].removeprefix("file:")
    name = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:(//[^/]*)?", ""), "^/*" + re.escape(root.lstrip("/")) + "/", "")
    return files.select(name.alias("name"), "length", F.sha2("content", 256).alias("sha256"), "content")


#: Terminal states of a file of a release, worst first.
RELEASE_STATES = ("unsafe_path", "duplicate_entry", "missing_file", "unexpected_file", "empty_file", "size_mismatch", "hash_mismatch", "hash_not_declared", "unsupported_format", "header_mismatch", "verified")


def release_state(files: DataFrame, manifest: DataFrame, formats: Sequence[str] = (), headers: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """State of every file that a manifest (name, length, sha256) names, or that is there without being named.

    ``headers`` gives the first columns that a delimited file must have.
    """
    have = files.select(F.col("name").alias("__n"), F.col("length").alias("l"), F.col("sha256").alias("h"), F.lit(True).alias("here"), *([F.substring_index(F.decode("content", "UTF-8"), "\n", 1).alias("first")] if headers else []))
    entries = manifest.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("length"), F.max("sha256").alias("sha256")).withColumn("named", F.lit(True))
    joined = entries.join(have, F.col("name") == F.col("__n"), "full").withColumn("name", F.coalesce("name", "__n"))
    wrong = F.lit(False)
    for name, columns in (headers or {}).items():
        start = "^" + r"[,\t]".join(re.escape(c) for c in columns)
        wrong = wrong | ((F.col("name") == name) & ~F.coalesce(F.col("first").rlike(start), F.lit(False)))
    state = (
        F.when(~safe_release_path(F.col("name")), "unsafe_path").when(F.col("n") > 1, "duplicate_entry").when(F.col("here").isNull(), "missing_file").when(F.col("named").isNull(), "unexpected_file")
        .when(F.col("l") == 0, "empty_file").when(F.col("length") != F.col("l"), "size_mismatch").when(F.col("sha256") != F.col("h"), "hash_mismatch").when(F.col("sha256").isNull(), "hash_not_declared")
        .when(~F.col("name").rlike(r"\.(" + "|".join(formats) + ")$") if formats else F.lit(False), "unsupported_format").when(wrong, "header_mismatch").otherwise("verified")
    )
    return joined.select("name", state.alias("state"))


def baseline_is_complete(df: DataFrame, identity_col: str, rank: str) -> DataFrame:
    """One row: whether identities and ranks are unique and the ranks exactly 1..n."""
    n = F.count(F.lit(1))
    return df.agg(n.alias("n"), ((F.count_distinct(identity_col) == n) & (F.count_distinct(rank) == n) & (F.min(rank) == 1) & (F.max(rank) == n)).alias("complete"))


def presence_index(left: DataFrame, right: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """One row per model with its presence in two matrices and in the metadata, and the metadata as JSON."""
    flag = lambda df, name: df.select(key).where(F.col(key).isNotNull()).distinct().withColumn(name, F.lit(True))
    other = [c for c in metadata.columns if c != key]
    meta = metadata.groupBy(key).agg(F.min_by(F.to_json(F.struct(*other)), F.to_json(F.struct(*other))).alias("metadata")).withColumn("in_metadata", F.lit(True))
    joined = flag(left, "in_left").join(flag(right, "in_right"), key, "full").join(meta, key, "full")
    return joined.select(key, *(F.coalesce(c, F.lit(False)).alias(c) for c in ("in_left", "in_right", "in_metadata")), "metadata")
