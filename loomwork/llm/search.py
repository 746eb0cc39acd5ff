"""Ranked lexical search the other way round: documents stream through an index over the items' terms.

Documents are many and items few, so the items' terms are indexed. Each document's counts of indexed terms are
taken once; corpus statistics follow from them, then tasks stream the counts through the index and keep a bounded
heap an item, and the heaps of all tasks are merged in two steps.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import LOWER, arrow_map, byte_rows, release, stored

#: Terms, in bytes of UTF-8: ASCII digits and lower-case letters (upper-case ones are lowered first), and all else but ASCII.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes of items whose index goes to the tasks at once; more items are searched block by block.
BLOCK_BYTES = 4 << 20
#: Scores (documents x items) that a task holds at once.
CELLS = 1 << 20


def terms(text: bytes | None) -> list[bytes]:
    return TERM.findall(text.translate(LOWER)) if text else []


def item_blocks(items: DataFrame, id_col: str, text_col: str, most: int = BLOCK_BYTES) -> Iterator[list]:
    """Rows of items in blocks of about ``most`` bytes, one block in the driver at a time."""
    block, size = [], 0
    for row in items.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).toLocalIterator():
        block.append((row.id, row.text))
        size += 64 + len(row.text or "")
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


class Index:
    """Postings of a block of items: for each term the items that hold it."""

    def __init__(self, texts: list[str | None]) -> None:
        self.items = len(texts)
        found: dict[bytes, list[int]] = {}
        for number, text in enumerate(texts):
            for term in dict.fromkeys(terms(text.encode() if text else None)):
                found.setdefault(term, []).append(number)
        self.numbers = {term: number for number, term in enumerate(found)}
        self.starts = np.cumsum([0, *map(len, found.values())])
        self.postings = np.array([x for items in found.values() for x in items], np.int64)


def term_counts(docs: DataFrame, index: Index, id_col: str, text_col: str) -> DataFrame:
    """A row per document with terms: ``id``, ``n`` (its terms), and the numbers and counts of the indexed ones."""
    numbers = index.numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, found, tf = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), byte_rows(batch.column(1)), strict=True):
                words = terms(text)
                if words:
                    counted = Counter(words)
                    known = [(numbers[w], c) for w, c in counted.items() if w in numbers]
                    ids.append(doc)
                    n.append(len(words))
                    found.append([x for x, _ in known])
                    tf.append([c for _, c in known])
            if ids:
                yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "n": pa.array(n, pa.int64()), "terms": pa.array(found, pa.list_(pa.int32())), "tf": pa.array(tf, pa.list_(pa.int64()))})

    return arrow_map(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run, "id long, n long, terms array<int>, tf array<long>")


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    """floor(1000 * ln((2N + 2) / (2df + 1))) of each term, in doubles."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)


class Heaps:
    """The ``k`` best documents of every item: highest score first, then the smallest id, null ids last."""

    def __init__(self, items: int, k: int) -> None:
        self.k = k
        self.worst = np.zeros(items, np.int64)  # the score to reach
        self.item, self.score, self.doc, self.null = (np.empty(0, np.int64) for _ in range(4))

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        item, score, doc, null = (np.concatenate(x) for x in zip((self.item, self.score, self.doc, self.null), (item, score, doc, null), strict=True))
        order = np.lexsort((doc, null, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        keep = place < self.k
        self.item, self.score, self.doc, self.null = item[keep], score[order][keep], doc[order][keep], null[order][keep]
        full = place[keep] == self.k - 1
        self.worst[self.item[full]] = self.score[full]


def stream(counts: DataFrame, index: Index, weight: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """(item, doc, score): every task's heaps."""
    starts, postings, items = index.starts, index.postings, index.items
    rows = max(1, CELLS // max(1, items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(items, k)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                doc = part.column("id")
                null = np.asarray(doc.is_null().to_numpy(zero_copy_only=False), np.int64)
                doc = doc.fill_null(0).to_numpy(zero_copy_only=False)
                m = np.array([10 + 90 * n * documents // length for n in part.column("n").to_pylist()], np.int64)
                sizes = part.column("terms").value_lengths().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(part.num_rows), sizes)
                term = part.column("terms").flatten().to_numpy(zero_copy_only=False)
                tf = part.column("tf").flatten().to_numpy(zero_copy_only=False)
                value = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
                fan = starts[term + 1] - starts[term]
                score = np.zeros(part.num_rows * items, np.int64)
                step = max(1, CELLS * 4 // max(1, int(fan.max(initial=1))))
                for first in range(0, len(term), step):
                    own = slice(first, first + step)
                    many = fan[own]
                    ends = np.cumsum(many)
                    item = postings[np.repeat(starts[term[own]] - ends + many, many) + np.arange(many.sum())]
                    np.add.at(score, np.repeat(row[own], many) * items + item, np.repeat(value[own], many))
                score = score.reshape(part.num_rows, items)
                where, item = np.nonzero((score > 0) & (score >= heaps.worst))
                if len(where):
                    heaps.add(item, score[where, item], doc[where], null[where])
        if len(heaps.item):
            yield pa.RecordBatch.from_pydict({"item": pa.array(heaps.item), "doc": pa.array(heaps.doc, mask=heaps.null.astype(bool)), "score": pa.array(heaps.score)})

    return arrow_map(counts, run, "item long, doc long, score long")


def merged(heaps: DataFrame, k: int) -> DataFrame:
    """(item, rank, doc, score): the heaps of groups of tasks are merged first, so that no group grows with the tasks."""
    order = (F.col("score").desc(), F.col("doc").asc_nulls_last())
    groups = max(1, math.isqrt(heaps.rdd.getNumPartitions()))
    part = F.pmod(F.spark_partition_id(), F.lit(groups))
    first = heaps.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
    last = first.drop("rank").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
    return last.where(F.col("rank") <= k).select("item", "rank", "doc", "score")


def best_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_col``, ``rank``, ``id_col``, ``score``: the ``k`` highest-scoring documents of each item with a score above 0.

    Statistics are over all documents with a term: N, the terms of all L, and the documents that hold a term. Equal scores
    rank by ascending id, null ids last; repeated rows of documents rank as rows of their own, and so do repeated rows of
    items. Items without terms, or whose terms no document holds, have no row; empty tables give an empty result.
    Other columns are not looked at.
    """
    spark, result = docs.sparkSession, None
    for block in item_blocks(items, item_col, item_text_col, block_bytes):
        index = Index([text for _, text in block])
        counts = stored(term_counts(docs, index, id_col, text_col), "counts")
        totals = counts.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("length")).first()
        if not totals.n or not index.numbers:
            release(counts)
            continue
        df = np.zeros(len(index.numbers), np.int64)
        for row in counts.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
            df[row.t] = row["count"]
        heaps = stream(counts, index, weights(df, totals.n), totals.n, totals.length, k)
        found = stored(merged(heaps, k), "ranked")
        names = spark.createDataFrame(list(enumerate(i for i, _ in block)), f"item long, name {items.schema[item_col].dataType.simpleString()}")
        named = found.join(F.broadcast(names), "item").select(F.col("name").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
        result = named if result is None else result.unionByName(named)
        release(counts)
    if result is None:
        return spark.createDataFrame([], f"`{item_col}` {items.schema[item_col].dataType.simpleString()}, rank int, `{id_col}` long, score long")
    return result
