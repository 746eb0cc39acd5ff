"""Benchmark decontamination with an FM-index per shard of training documents.

Documents are gathered into shards of bounded size. A shard is indexed over the alphabet of the test
phrases: words that no phrase has are one separator. Phrases are found by backward search, occurrences are
located by sampled suffix positions, and their spans are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import LOWER, arrow_map, byte_rows, map_arrow, stored
from loomwork.llm.fmindex import FMIndex

#: Byte table: A-Z in lower case, other bytes outside words as spaces.
WORDS = bytes(LOWER[b] if 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Text bytes of a shard; bytes of test items searched in one pass.
SHARD, BLOCK = 4 << 20, 4 << 20


def words(text: bytes | None) -> list[bytes]:
    return text.translate(WORDS).split() if text else []


@dataclass(frozen=True)
class Phrases:
    """Distinct windows of test items over their own alphabet."""

    symbols: dict[bytes, int]
    matrix: np.ndarray  # flush right, 0 before
    lengths: np.ndarray
    first: np.ndarray  # items of window w: items[first[w]:first[w + 1]]
    items: np.ndarray
    names: list[str | None]

    @classmethod
    def of(cls, items: list[tuple[str | None, bytes | None]], width: int) -> Phrases:
        symbols: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[int]] = {}
        for k, (_, text) in enumerate(items):
            ids = [symbols.setdefault(w, len(symbols) + 1) for w in words(text)]
            for a in range(max(1, len(ids) - width + 1) if ids else 0):
                windows.setdefault(tuple(ids[a : a + width]), set()).add(k)
        matrix = np.zeros((len(windows), width), np.int64)
        for row, window in zip(matrix, windows, strict=True):
            row[width - len(window) :] = window
        lengths = np.fromiter(map(len, windows), np.int64, len(windows))
        sizes = np.fromiter(map(len, windows.values()), np.int64, len(windows))
        owners = np.fromiter((k for ks in windows.values() for k in sorted(ks)), np.int64, int(sizes.sum()))
        return cls(symbols, matrix, lengths, np.r_[0, np.cumsum(sizes)], owners, [n for n, _ in items])


@dataclass
class Found:
    """Of the documents of a shard: words, words hit, merged word spans and items."""

    n_words: np.ndarray
    n_hit: np.ndarray
    spans: list[list[tuple[int, int]]]
    items: list[list[str]]


def scan_shard(texts: list[bytes | None], phrases: Phrases) -> Found:
    joined = b" \0 ".join(t.translate(WORDS) if t else b"" for t in texts)
    tokens = joined.split()
    lookup = phrases.symbols | {b"\0": -1}
    ids = np.fromiter(map(lookup.get, tokens, repeat(0)), np.int64, len(tokens))
    del tokens, joined
    bounds = np.flatnonzero(ids == -1)
    starts, stops = np.r_[0, bounds + 1], np.r_[bounds, len(ids)]  # of each document
    n_words = stops - starts
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[list[str]] = [[] for _ in texts]
    n_hit = np.zeros(len(texts), np.int64)
    ids[bounds] = 0
    keep = (ids > 0) | np.r_[False, ids[:-1] > 0]
    place = np.flatnonzero(keep)
    text = np.concatenate([[0], ids[place], [0]])
    if not len(place) or not len(phrases.lengths):
        return Found(n_words, n_hit, spans, items)
    index = FMIndex(text, len(phrases.symbols) + 1)
    low, high = index.search(phrases.matrix, phrases.lengths)
    count = np.maximum(high - low, 0)
    window = np.repeat(np.arange(len(count)), count)
    rows = np.repeat(low, count) + np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count)
    if not len(rows):
        return Found(n_words, n_hit, spans, items)
    begin = place[index.locate(rows) - 1]
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + phrases.lengths[window], -1)
    hit = np.cumsum(edge)[: len(ids)] > 0
    total = np.r_[0, np.cumsum(hit)]
    n_hit = total[stops] - total[starts]
    turns = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0])).reshape(-1, 2)
    of = np.searchsorted(stops, turns[:, 0], "right")
    for d, (a, b) in zip(of.tolist(), (turns - starts[of][:, None]).tolist(), strict=True):
        spans[d].append((a, b))
    doc = np.searchsorted(stops, begin, "right")
    pairs = np.unique(doc * np.int64(len(phrases.lengths)) + window)
    doc, window = pairs // len(phrases.lengths), pairs % len(phrases.lengths)
    for d, w in zip(doc.tolist(), window.tolist(), strict=True):
        items[d].extend(phrases.items[phrases.first[w] : phrases.first[w + 1]].tolist())
    names = phrases.names
    items = [sorted({names[k] for k in ks if names[k] is not None}) if ks else [] for ks in items]
    return Found(n_words, n_hit, spans, items)


def _shards(batches: Iterator[pa.RecordBatch], at: int, size: int) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows put together until their texts have ``size`` bytes; a longer text ends its shard."""
    held, n = [], 0
    for batch in batches:
        first = 0
        for k, length in enumerate(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist(), 1):
            n += length
            if n >= size:
                held.append(batch.slice(first, k - first))
                yield pa.concat_batches(held)
                held, n, first = [], 0, k
        if first < batch.num_rows:
            held.append(batch.slice(first))
    if held:
        yield pa.concat_batches(held)


def _item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block: int) -> Iterator[list[tuple[str | None, bytes | None]]]:
    """Test items in blocks of about ``block`` bytes, dealt by a hash of the item."""
    items = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("t")).where("t is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0))).first()[0]
    n = -(-size // block) or 1
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r.i, bytes(r.t)) for r in part.toLocalIterator()]


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
_FIELDS = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,stop:int>>"


def _pass(rows: DataFrame, text_col: str, items: list, width: int, shard: int, cut: bool = False) -> DataFrame:
    """The rows with the four result columns, the text as it is; or, with ``cut``, the rows with their spans cut out."""
    shared = rows.sparkSession.sparkContext.broadcast(Phrases.of(items, width))
    at, names = rows.columns.index(text_col), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _shards(batches, at, shard):
            texts = byte_rows(part.column(at))
            found = scan_shard(texts, shared.value)
            if cut:
                yield _cut(part, at, texts, found.spans)
                continue
            spans = pa.array([[{"start": x, "stop": y} for x, y in s] for s in found.spans], _SPANS)
            new = [pa.array(found.n_words, pa.int64()), pa.array(found.n_hit, pa.int64()), pa.array(found.items, pa.list_(pa.string())), spans]
            yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*names, "__n_words", "__n_hit", "__items", "__spans"])

    if cut:
        return arrow_map(rows, run, rows.schema)
    fields = ", ".join(f"__{f}" for f in _FIELDS.split(", "))
    return arrow_map(rows, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", " + fields)


def _cut(batch: pa.RecordBatch, at: int, texts: list[bytes | None], spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
    """The rows with those word ranges cut out of their texts."""
    arrays = list(batch.columns)
    arrays[at] = pa.array([cut_spans(t, s) if s else t for t, s in zip(texts, spans, strict=True)], pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)


def _annotated(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, width: int, shard: int, block: int, cut: bool = False) -> DataFrame:
    """The rows with the result columns; with ``cut``, the rows without the spans."""
    blocks = _item_blocks(benchmark, item_col, item_text_col, block)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        return _pass(docs, text_col, first, width, shard, cut)
    # more items than one pass holds: a pass for each block, put together by row
    rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    slim = rows.select("__row", F.col(text_col))
    parts = [_pass(slim, text_col, items, width, shard).drop(text_col) for items in (first, second, *blocks)]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    ordered = F.array_sort(F.flatten(F.collect_list("__spans")))
    merged = F.aggregate(
        ordered,
        F.array().cast("array<struct<start:int,stop:int>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["stop"] >= x["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], x["stop"]).alias("stop"))))).otherwise(F.concat(acc, F.array(x))),
    )
    by_row = union.groupBy("__row").agg(F.max("__n_words").alias("__n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("__items")))).alias("__items"), merged.alias("__spans"))
    hits = F.aggregate("__spans", F.lit(0).cast("long"), lambda acc, x: acc + x["stop"] - x["start"])
    found = rows.join(by_row.withColumn("__n_hit", hits), "__row").drop("__row")
    if not cut:
        return found
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [[(s["start"], s["stop"]) for s in row] for row in batch.column(len(names)).to_pylist()]
        return _cut(batch.select(names), at, byte_rows(batch.column(at)), spans)

    return map_arrow(found.select(*names, "__spans"), run, docs.schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """One row per input row: ``id_col``, ``n_words``, ``n_hit``, ``items`` (ids as sorted strings) and
    ``spans`` ([start, stop) word ranges to remove, merged).

    A window is ``width`` consecutive words of an item; a shorter item is one window. Null, empty and
    blank texts have no words, and items without words no window. Items with a null id count for hits but
    are not listed; repeated items count once. Without documents the result is empty, without items nothing is hit.
    """
    source = docs.select(F.col(id_col), F.col(text_col))
    found = _annotated(source, benchmark, text_col, item_col, item_text_col, width, shard, block)
    return found.select(id_col, *(F.col(f"__{f.split()[0]}").alias(f.split()[0]) for f in _FIELDS.split(", ")))


def items_digest(items: str = "items") -> F.Column:
    return F.sha2(F.concat_ws(",", items), 256)


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without those word ranges and what separates them from the next word."""
    table = np.frombuffer(WORDS, np.uint8)
    blank = table[np.frombuffer(text, np.uint8)] == 0x20
    edges = np.flatnonzero(np.diff(np.r_[True, blank, True].astype(np.int8)))
    starts = np.r_[edges[0::2], len(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : starts[a]])
        at = int(starts[b])
    return b"".join([*out, text[at:]])


def without_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """The rows with occurrences of test phrases cut out of the text, all other columns as they are.

    Texts that are null stay null, and texts of which nothing is left become empty.
    """
    return _annotated(docs, benchmark, text_col, item_col, item_text_col, width, shard, block, cut=True)
