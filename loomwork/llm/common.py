"""What the corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomwork.session import cut_lineage, ensure_checkpoint_dir
from loomwork.sources import table

__all__ = ["LOWER", "arrow_map", "byte_rows", "cut_lineage", "ensure_checkpoint_dir", "map_arrow", "release", "remainder", "small", "small_batches", "stored", "table", "vector_sum"]

#: Byte table that lower-cases A-Z alone.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus, F.lit(0))


def byte_rows(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return column.cast(pa.binary()).to_pylist()


#: Most bytes of a batch that goes to a Python task or comes from one: texts are long, a task holds several
#: copies of a batch, and what the largest batch took stays with the executor's allocators.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Batches of ``BATCH_BYTES`` to Python tasks, unless the session has set their size itself.

    The registered queries and the pipeline's stages ask for it; operators leave the session as it is.
    """
    if spark.conf.get(BATCH_KEY, "67108864b") == "67108864b":
        spark.conf.set(BATCH_KEY, f"{BATCH_BYTES}b")


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about ``BATCH_BYTES``."""
    rows = max(1, batch.num_rows // max(1, -(-batch.nbytes // BATCH_BYTES)))
    for first in range(0, batch.num_rows, rows):
        yield batch.slice(first, rows)


def arrow_map(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow``; what ``run`` gives is handed over in small batches, and freed memory goes back when a task ends."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in run(batches):
                yield from _pieces(batch)
        finally:
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(sliced, schema)


def map_arrow(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | dict], schema: str) -> DataFrame:
    """``mapInArrow`` for a function of one batch; a dict of columns becomes a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = work(batch)
                yield pa.RecordBatch.from_pydict(out) if isinstance(out, dict) else out

    return arrow_map(df, run, schema)


_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stored(df: DataFrame, name: str, schema: StructType | str | None = None) -> DataFrame:
    """``df`` written as Parquet below the checkpoint folder and read again, by ``schema`` if there is one: smaller than a checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(schema or df.schema).parquet(path)
    _PATHS[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete what ``stored`` wrote for these; nothing may read them any more."""
    for df in tables:
        path = _PATHS.pop(df, None)
        if path:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of at most three longs that may be broadcast; beyond it, joins shuffle.
BROADCAST_ROWS = 2_000_000


def small(keys: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A materialised frame of short keys, marked for broadcast if its counted rows are few enough."""
    return F.broadcast(keys) if keys.count() <= limit else keys


def vector_sum(df: DataFrame, fan_in: int = 32) -> dict[str, np.ndarray]:
    """Sums, by key, of rows (key, vector of float64 or int64 as bytes, kind), in a tree of ``fan_in``.

    One vector a key reaches the driver. Vectors are added in the order of their partitions, so that a
    repeated run gives the same floats.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        kinds: dict = {}
        for batch in batches:
            for key, vector, kind in zip(*(batch.column(c).to_pylist() for c in ("key", "vector", "kind")), strict=True):
                part = np.frombuffer(vector, kind)
                kinds[key] = kind
                sums[key] = sums[key] + part if key in sums else part
        if sums:
            yield pa.RecordBatch.from_pydict({"key": list(sums), "vector": [v.tobytes() for v in sums.values()], "kind": [kinds[k] for k in sums]})

    schema = "key string, vector binary, kind string"
    parts = df.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // fan_in)
        placed = df.withColumn("__at", F.spark_partition_id()).repartition(parts, F.floor(F.col("__at") / fan_in)).sortWithinPartitions("__at", "key")
        df = arrow_map(placed.drop("__at"), add, schema)
    total: dict = {}
    for row in df.collect():
        part = np.frombuffer(bytes(row.vector), row.kind)
        total[row.key] = total[row.key] + part if row.key in total else part
    return total
