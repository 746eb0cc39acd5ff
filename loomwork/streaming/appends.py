"""Idempotent appends from a stream. The analytics are batch; this keeps an append-only store fed."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from loomwork.sources.store import RecordStore


def append_new(stream: DataFrame, store: str, key: str, checkpoint: str, digest: str, body: str, version: str = "1", digits: int = 2) -> DataStreamWriter:
    """Appends the rows that are new to the ``RecordStore`` at ``store``, which is created if it isn't there; its audit has the others.

    A batch reads the partitions of its own digests and keys alone. It is written under a name made of the stream's checkpoint and
    the batch: a repeated batch overwrites itself and nothing else, and a fresh checkpoint over an existing store adds to it.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)

    def put(batch: DataFrame, number: int) -> None:
        RecordStore.create(batch.sparkSession, store, fields, key, digest, body, version, digits=digits).append(batch, f"{run}-{number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True)
