"""An append-only store of records, partitioned so that appends and lookups read what they touch.

Items (at the store's path) are partitioned by the first digits of a hash of the record's digest, keys (key and digest, at
``<path>_keys``) by those of a hash of the key, both also by batch. An append is held against the partitions of its own digests and keys, and a
lookup goes from keys to digests to items; each reads the partitions that its rows fall in. ``<path>_meta`` holds the versions
that an opener must agree with, ``<path>_audit`` the rows that weren't appended.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators.evidence import classify_append
from loomwork.operators.store import schema_issues, selector
from loomwork.session import cut_lineage

#: Partitions that are named one by one in a filter; there are no more than 16 to the power of the digits.
MOST_DIGITS = 4


class StoreError(ValueError):
    """A store that isn't there, or isn't what its opener expects."""


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


class RecordStore:
    """Use ``create`` or ``open``."""

    def __init__(self, spark: SparkSession, path: str, meta: Mapping[str, object]) -> None:
        self.spark, self.path, self.meta = spark, path, meta
        self.key, self.digest, self.body, self.digits = meta["key"], meta["digest"], meta["body"], meta["digits"]

    @classmethod
    def create(cls, spark: SparkSession, path: str, fields: str, key: str, digest: str, body: str, version: str, canonicalization: str = "1", digits: int = 2) -> RecordStore:
        """A new store of records with ``fields`` (a DDL schema). One that is there already must have the same versions."""
        if not 1 <= digits <= MOST_DIGITS:
            raise StoreError(f"digits must be 1 to {MOST_DIGITS}")
        if not _exists(spark, f"{path}_meta"):
            row = [(fields, key, digest, body, digits, version, canonicalization)]
            spark.createDataFrame(row, "fields string, key string, digest string, body string, digits int, version string, canonicalization string").coalesce(1).write.parquet(f"{path}_meta")
        return cls.open(spark, path, version, canonicalization)

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: str, canonicalization: str = "1", fields: str | None = None) -> RecordStore:
        """The store, if its versions are those and its tables have its columns; nothing is written."""
        if not _exists(spark, f"{path}_meta"):
            raise StoreError(f"no store at {path}")
        (meta,) = [r.asDict() for r in spark.read.parquet(f"{path}_meta").collect()]
        if (meta["version"], meta["canonicalization"]) != (version, canonicalization):
            raise StoreError(f"the store has version {meta['version']} and canonicalization {meta['canonicalization']}")
        store = cls(spark, path, meta)
        if fields is not None and (found := schema_issues(spark.createDataFrame([], meta["fields"]), fields)):
            raise StoreError(f"the store's fields differ: {found}")
        if _exists(spark, path):
            stored = spark.read.parquet(path).drop("prefix", "batch")
            if found := [x for x in schema_issues(stored, meta["fields"]) if x[1] != "unexpected"]:
                raise StoreError(f"the stored items differ from the schema: {found}")
        return store

    def _at(self, name: str) -> str:
        return self.path if name == "items" else f"{self.path}_{name}"

    # --- reading ---------------------------------------------------------------------------------

    def _read(self, name: str, fields: str) -> DataFrame:
        schema = f"{fields}, prefix string, batch string"
        where = self._at(name)
        return self.spark.read.schema(schema).parquet(where) if _exists(self.spark, where) else self.spark.createDataFrame([], schema)

    def _items(self) -> DataFrame:
        return self._read("items", self.meta["fields"])

    def _keys(self) -> DataFrame:
        kinds = dict(self.spark.createDataFrame([], self.meta["fields"]).dtypes)
        return self._read("keys", f"`{self.key}` {kinds[self.key]}, `{self.digest}` {kinds[self.digest]}")

    def prefix(self, column: str) -> Column:
        return F.substring(F.sha2(F.coalesce(F.col(column).cast("string"), F.lit("")), 256), 1, self.digits)

    def _touched(self, rows: DataFrame, column: str) -> Column:
        """The condition on ``prefix`` that keeps the partitions of these rows."""
        found = sorted(r[0] for r in rows.select(self.prefix(column)).distinct().collect())  # at most 16 ** digits
        return F.col("prefix").isin(found) if found else F.lit(False)

    def items(self) -> DataFrame:
        return self._items().drop("prefix", "batch")

    def audit(self) -> DataFrame:
        kinds = dict(self.spark.createDataFrame([], self.meta["fields"]).dtypes)
        where = f"{self.path}_audit"
        schema = f"`{self.key}` {kinds[self.key]}, `{self.digest}` {kinds[self.digest]}, outcome string, batch string"
        return self.spark.read.schema(schema).parquet(where) if _exists(self.spark, where) else self.spark.createDataFrame([], schema)

    def scan(self, rules: Mapping[str, object]) -> DataFrame:
        """Items whose fields equal values or are among several; the predicates reach the Parquet scan."""
        known = self.spark.createDataFrame([], self.meta["fields"]).columns
        return self.items().where(selector(rules, allowed=known))

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """The items with the keys in ``wanted`` (a column of the key's name), by way of their digests."""
        keys = cut_lineage(wanted.select(self.key).where(F.col(self.key).isNotNull()).distinct())
        named = cut_lineage(self._keys().where(self._touched(keys, self.key)).join(keys, self.key, "left_semi").select(self.key, self.digest))
        found = self._items().where(self._touched(named, self.digest)).drop("prefix", "batch")
        return found.join(named, [self.key, self.digest], "left_semi")

    def with_digest(self, wanted: DataFrame) -> DataFrame:
        """The items with the digests in ``wanted``."""
        digests = cut_lineage(wanted.select(self.digest).where(F.col(self.digest).isNotNull()).distinct())
        return self._items().where(self._touched(digests, self.digest)).drop("prefix", "batch").join(digests, self.digest, "left_semi")

    # --- appending -------------------------------------------------------------------------------

    def append(self, rows: DataFrame, batch: str) -> DataFrame:
        """Appends the new rows under the name of a batch and returns all rows with their ``outcome`` (``classify_append``).

        A batch of the same name is replaced: it isn't held against itself, so that a repeated append leaves the store as it was.
        """
        fields = self.spark.createDataFrame([], self.meta["fields"]).columns
        incoming = cut_lineage(rows.select(*fields))
        other = F.col("batch") != batch
        have = self._items().where(self._touched(incoming, self.digest) & other).select(self.key, self.digest, self.body)
        named = self._keys().where(self._touched(incoming, self.key) & other).select(self.key, self.digest)
        found = cut_lineage(classify_append(incoming, have, self.key, self.digest, self.body, named))
        new = found.where("outcome = 'new'").drop("outcome")
        self._write("items", new, self.digest, batch)
        self._write("keys", new.select(self.key, self.digest), self.key, batch)
        self._put(found.where("outcome <> 'new'").select(self.key, self.digest, "outcome", F.lit(batch).alias("batch")), "audit", ["batch"])
        return found

    def _write(self, name: str, rows: DataFrame, column: str, batch: str) -> None:
        marked = rows.withColumns({"prefix": self.prefix(column), "batch": F.lit(batch)})
        self._put(marked.repartition("prefix").sortWithinPartitions("prefix", column), name, ["prefix", "batch"])

    def _put(self, rows: DataFrame, name: str, by: list[str]) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(self._at(name))
