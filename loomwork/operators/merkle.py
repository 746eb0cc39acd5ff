"""Merkle trees over the rows of a table: identities that no order or partitioning changes, and where two tables differ.

A row's entry is the digest of its key and its content digest. Entries are leaves of a trie by the first digits of
their own hash, so that a change of one row changes one bucket and the nodes above it. Buckets hold about
``BUCKET`` entries; equal rows are one entry with a count.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.session import cut_lineage

#: Entries of a bucket, about.
BUCKET = 256
#: Most digits of a bucket's prefix.
DEEPEST = 8


def row_digest(df: DataFrame) -> Column:
    """A digest of all columns of a row."""
    return F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)


def entries(df: DataFrame, key: str, digest: str) -> DataFrame:
    """(entry, n): each distinct pair of key and digest as a hash, and how often it occurs; nulls are told from texts."""
    pair = F.to_json(F.struct(F.col(key).cast("string").alias("k"), F.col(digest).cast("string").alias("d")), {"ignoreNullFields": "false"})
    return df.groupBy(F.sha2(pair, 256).alias("entry")).agg(F.count(F.lit(1)).alias("n"))


def depth_for(n: int, bucket: int = BUCKET) -> int:
    """Digits of a bucket's prefix for so many entries."""
    depth = 0
    while n > bucket * 16**depth and depth < DEEPEST:
        depth += 1
    return depth


def _folded(parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(parts))), 256)


def tree(df: DataFrame, key: str, digest: str, depth: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """(depth, prefix, n_rows, hash) of every node that has rows, and of the root, which an empty table has too.

    Buckets have ``depth`` digits (by the number of entries, if not given); each level is folded from the one below it.
    """
    leaves = cut_lineage(entries(df, key, digest))
    if depth is None:
        depth = depth_for(leaves.count(), bucket)
    prefix = F.substring("entry", 1, depth) if depth else F.lit("")
    level = leaves.groupBy(prefix.alias("prefix")).agg(F.sum("n").alias("n_rows"), _folded(F.concat_ws(":", "entry", F.col("n").cast("string"))).alias("hash"))
    level = cut_lineage(level)
    out = level.select(F.lit(depth).alias("depth"), "prefix", "n_rows", "hash")
    for digits in range(depth - 1, -1, -1):
        above = F.substring("prefix", 1, digits) if digits else F.lit("")
        level = level.groupBy(above.alias("prefix")).agg(F.sum("n_rows").alias("n_rows"), _folded(F.concat_ws(":", "prefix", "hash")).alias("hash"))
        out = out.unionByName(level.select(F.lit(digits).alias("depth"), "prefix", "n_rows", "hash"))
    if not depth and leaves.isEmpty():
        return df.sparkSession.range(1).select(F.lit(0).alias("depth"), F.lit("").alias("prefix"), F.lit(0).cast("long").alias("n_rows"), F.sha2(F.lit(""), 256).alias("hash"))
    return out


def root(nodes: DataFrame) -> DataFrame:
    """(n_rows, hash) of the whole table."""
    return nodes.where("depth = 0").select("n_rows", "hash")


def identity(df: DataFrame, key: str, digest: str) -> DataFrame:
    """One row: how many rows a table has and the root of its tree."""
    return root(tree(df, key, digest))


def deepest(nodes: DataFrame) -> int:
    return nodes.agg(F.max("depth")).first()[0]


def differences(one: DataFrame, other: DataFrame) -> DataFrame:
    """(prefix, n_one, n_other) of the buckets in which two trees of equal depth differ; a null count is an empty bucket."""
    if (depth := deepest(one)) != deepest(other):
        raise ValueError("the trees differ in depth: build the second with the depth of the first")
    leaf = lambda df, s: df.where(F.col("depth") == depth).select("prefix", F.col("n_rows").alias(f"n_{s}"), F.col("hash").alias(f"hash_{s}"))
    both = leaf(one, "one").join(leaf(other, "other"), "prefix", "full")
    return both.where(~F.col("hash_one").eqNullSafe(F.col("hash_other"))).select("prefix", "n_one", "n_other")


def changed_rows(one: DataFrame, other: DataFrame, key: str, digest: str | None = None) -> DataFrame:
    """(key, state, n_one, n_other) of the keys whose rows aren't the same in two tables: ``added``, ``removed`` or ``changed``.

    Trees tell the buckets that differ; only their rows are held against each other. Without ``digest`` a row's digest is over
    all its columns.
    """
    marked = [cut_lineage(df.select(F.col(key), (F.col(digest) if digest else row_digest(df)).alias("__digest"))) for df in (one, other)]
    first = tree(marked[0], key, "__digest")
    second = tree(marked[1], key, "__digest", deepest(first))
    depth = deepest(first)
    apart = cut_lineage(differences(first, second).select("prefix"))
    pair = F.to_json(F.struct(F.col(key).cast("string").alias("k"), F.col("__digest").cast("string").alias("d")), {"ignoreNullFields": "false"})
    inside = lambda df: df.withColumn("prefix", F.substring(F.sha2(pair, 256), 1, depth) if depth else F.lit("")).join(apart, "prefix", "left_semi").groupBy(key, "__digest").agg(F.count(F.lit(1)).alias("n"))
    left, right = (inside(df).withColumnsRenamed({"n": f"n_{s}", key: f"__{s}", "__digest": f"__digest_{s}"}) for df, s in zip(marked, ("one", "other"), strict=True))
    same = F.col("__one").eqNullSafe(F.col("__other")) & F.col("__digest_one").eqNullSafe(F.col("__digest_other"))
    loose = left.join(right, same, "full").where(~F.col("n_one").eqNullSafe(F.col("n_other")))
    there = lambda c: F.coalesce(F.sum(c), F.lit(0))
    rows = loose.groupBy(F.coalesce("__one", "__other").alias(key)).agg(there("n_one").alias("n_one"), there("n_other").alias("n_other"))
    return rows.select(key, F.when(F.col("n_one") == 0, "added").when(F.col("n_other") == 0, "removed").otherwise("changed").alias("state"), "n_one", "n_other")


def stable_identity(read: Callable[[], DataFrame], key: str, digest: str) -> DataFrame:
    """``identity`` of what ``read`` gives; it is read twice, and an error names the buckets that weren't the same."""
    first = tree(read(), key, digest)
    second = tree(read(), key, digest, deepest(first))
    if moved := [r.prefix for r in differences(first, second).orderBy("prefix").limit(10).collect()]:
        raise ValueError(f"the source changed between two reads, in the buckets {moved}")
    return root(first)


def issues(df: DataFrame, key: str, digest: str, fields: Sequence[str] = ()) -> DataFrame:
    """(key, issue): what keeps rows from being listed in a manifest: no id, no digest, an id of several rows, a blank field."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    own = F.array_compact(F.array(F.when(blank(key), "id_missing"), F.when(~F.coalesce(F.col(digest).rlike("^[0-9a-f]{64}$"), F.lit(False)), "digest_invalid"), *(F.when(blank(f), F.lit(f"{f}_missing")) for f in fields)))
    several = df.where(~blank(key)).groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(key, F.lit("id_repeated").alias("issue"))
    return df.select(key, F.explode(own).alias("issue")).unionByName(several)
