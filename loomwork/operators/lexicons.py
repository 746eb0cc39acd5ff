"""Markers of a lexicon table in texts, by one automaton: the cost of a text doesn't grow with the number of markers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions.nested import quoted
from loomwork.operators.rules import worst

#: Bytes of markers that go to the tasks at once; a larger lexicon is searched block by block.
BLOCK_BYTES = 4 << 20


def marker_blocks(lexicon: DataFrame, most: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str, str]]]:
    """(marker, code, severity) in lower case, in blocks of about ``most`` bytes, one block in the driver at a time."""
    rows = lexicon.select(F.lower("marker").alias("marker"), "code", "severity").where("marker <> '' and code is not null").distinct()
    block, size = [], 0
    for r in rows.toLocalIterator():
        block.append((r.marker, r.code, r.severity))
        size += 64 + len(r.marker)
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def automaton(block: Sequence[tuple[str, str, str]]) -> ahocorasick.Automaton:
    """All markers of a block; each holds its rows."""
    found: dict[str, list[tuple[str, str, str]]] = {}
    for row in block:
        found.setdefault(row[0], []).append(row)
    made = ahocorasick.Automaton()
    for marker, rows in found.items():
        made.add_word(marker, rows)
    made.make_automaton()
    return made


def marker_hits(df: DataFrame, keys: Sequence[str], text: str, lexicon: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(keys, marker, code, severity): every marker that a lower-cased text holds, once for each row. Null texts hold none.

    ``lexicon`` has (marker, code, severity); blank markers and null codes are left out, a marker may have several codes.
    """
    out, kinds = None, ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, marker string, code string, severity string"
    source = df.select(*keys, F.lower(text).alias("__t"))
    for block in marker_blocks(lexicon, block_bytes):
        shared = df.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            search = automaton(shared.value).iter
            for batch in batches:
                rows, hits = [], []
                for number, t in enumerate(batch.column(len(keys)).to_pylist()):
                    for hit in {row for _, own in search(t) for row in own} if t else ():
                        rows.append(number)
                        hits.append(hit)
                if rows:
                    at = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(keys))), *(pa.array([h[k] for h in hits], pa.string()) for k in range(3))], names=[*keys, "marker", "code", "severity"])

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else df.sparkSession.createDataFrame([], schema)


def lexicon_audit(df: DataFrame, key: str, text: str, lexicon: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each key: ``n_markers``, ``findings`` (codes in order, as JSON), and ``decision`` by the worst severity (blocker: block, warning: review)."""
    hits = marker_hits(df, [key], text, lexicon, block_bytes)
    by = hits.groupBy(F.col(key).alias("__k")).agg(F.count_distinct("marker").alias("n_markers"), F.array_sort(F.collect_set("code")).alias("codes"), F.collect_set("severity").alias("severities"))
    joined = df.select(key).join(by, F.col(key).eqNullSafe(F.col("__k")), "left")
    none = F.array().cast("array<string>")
    said = F.concat(F.lit("["), F.array_join(F.transform(F.coalesce("codes", none), quoted), ","), F.lit("]"))
    return joined.select(key, F.coalesce("n_markers", F.lit(0)).alias("n_markers"), said.alias("findings"), worst(F.coalesce("severities", none), [("blocker", "block"), ("warning", "review")], "pass").alias("decision"))
