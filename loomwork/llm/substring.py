"""Exact substring deduplication by level-wise doubling.

A passage is a window of ``width`` words. Levels are windows of a quarter, a half and all of that width:

1. Quarter windows are taken where content selects them: in every full window, the quarter window whose
   hash is least. Equal full windows select equal quarter windows, so nothing that repeats is missed.
2. Only quarter windows that occur in two documents are extended to half width, to the left and to the
   right; every full window around them holds one of the two extensions.
3. Only half windows that occur in two documents are extended to the full windows around them, and the
   smallest document of each full window is found.

Documents with equal texts stand aside: all but the smallest are covered by it entirely.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import arrow_map, byte_rows, map_arrow, release, small, stored

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_BITS = 32  # low bits of an ordering key that hold a position


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Hashes of any window of a word sequence: a polynomial modulo 2**64 by prefix sums."""

    def __init__(self, hashes: np.ndarray, base: int) -> None:
        powers = np.full(len(hashes) + 1, base, np.uint64)
        powers[0] = 1
        inverse = np.full(len(hashes) + 1, pow(base, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        self.back = np.multiply.accumulate(inverse)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * np.multiply.accumulate(powers)[:-1], dtype=np.uint64)])

    def at(self, start: np.ndarray, length: int) -> np.ndarray:
        return _mix((self.sums[start + length] - self.sums[start]) * self.back[start])


def word_hashes(lists: list[list[bytes]]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(lists)), np.uint64, sum(map(len, lists)))


def sliding_least(values: np.ndarray, span: int) -> np.ndarray:
    """The least of every ``span`` neighbours, by blockwise prefix and suffix minima."""
    n = len(values)
    filled = np.concatenate([values, np.full(-n % span, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, span)
    prefix = np.minimum.accumulate(filled, axis=1).ravel()
    suffix = np.minimum.accumulate(filled[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[: n - span + 1], prefix[span - 1 : n])


def levels(width: int) -> tuple[int, int]:
    """Quarter and half of a width, rounded up."""
    return -(-width // 4), -(-width // 2)


def select(lists: list[list[bytes]], width: int) -> dict[str, np.ndarray]:
    """Selected quarter windows of documents: row, position, first and last offset in full windows, hashes."""
    quarter, half = levels(width)
    span = width - quarter + 1
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    if total < width:
        return {k: np.empty(0, np.int64) for k in ("row", "pos", "far", "near", "key", "left", "right")}
    rolling = Rolling(word_hashes(lists), _BASES[0])
    keys = rolling.at(np.arange(total - quarter + 1), quarter)
    order = (keys & ~np.uint64((1 << _BITS) - 1)) | np.arange(len(keys), dtype=np.uint64)
    least = (sliding_least(order, span) & np.uint64((1 << _BITS) - 1)).astype(np.int64)
    of = np.repeat(np.arange(len(lists)), counts)
    start = np.flatnonzero(np.arange(len(least)) + width <= ends[of[: len(least)]])
    if not len(start):
        return {k: np.empty(0, np.int64) for k in ("row", "pos", "far", "near", "key", "left", "right")}
    chosen = least[start]
    first = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    pos, low, high = chosen[first], start[first], start[np.r_[first[1:], len(start)] - 1]
    far, near, row = pos - low, pos - high, of[pos]
    begin = pos - (half - quarter)
    left, right = np.zeros(len(pos), np.uint64), np.zeros(len(pos), np.uint64)
    has_left, has_right = far >= half - quarter, near <= width - half
    left[has_left] = rolling.at(begin[has_left], half)
    right[has_right] = rolling.at(pos[has_right], half)
    out = {"row": row, "pos": pos - (ends - counts)[row], "far": far, "near": near, "key": keys[pos].view(np.int64)}
    return out | {"left": left.view(np.int64), "right": right.view(np.int64), "has_left": has_left, "has_right": has_right}


def _in_groups(texts: list[bytes | None], limit: int = 1 << 17):
    """(first row, word lists) of neighbouring rows with about ``limit`` words at most."""
    lists: list[list[bytes]] = []
    first = words = 0
    for k, text in enumerate(texts):
        lists.append(text.split() if text else [])
        words += len(lists[-1])
        if words >= limit:
            yield first, lists
            lists, first, words = [], k + 1, 0
    if lists:
        yield first, lists


#: Repeated quarter windows, and half windows (longs), that go to all tasks, so that others needn't leave theirs; beyond it, a join does it.
KEYS = 1 << 20


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the known ones, which are sorted."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


def _quarters(docs: DataFrame, width: int, known: np.ndarray | None = None) -> DataFrame:
    """Selected quarter windows of all documents; with ``known`` (sorted keys) those alone."""
    shared = None if known is None else docs.sparkSession.sparkContext.broadcast(known)

    def work(batch: pa.RecordBatch) -> dict:
        parts: list[dict] = []
        for first, lists in _in_groups(byte_rows(batch.column("t"))):
            found = select(lists, width)
            if shared is not None and len(found["row"]):
                keep = _among(found["key"], shared.value)
                found = {k: v[keep] for k, v in found.items()}
            if len(found["row"]):
                found["row"] = found["row"] + first
                parts.append(found)
        if not parts:
            return {n: pa.array([], t) for n, t in (("d", pa.int64()), ("tk", pa.int64()), ("pos", pa.int32()), ("far", pa.int16()), ("near", pa.int16()), ("key", pa.int64()), ("left", pa.int64()), ("right", pa.int64()))}
        both = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        row = pa.array(both["row"])
        out = {"d": batch.column("d").take(row), "tk": batch.column("tk").take(row), "pos": pa.array(both["pos"], pa.int32()), "far": pa.array(both["far"], pa.int16()), "near": pa.array(both["near"], pa.int16()), "key": pa.array(both["key"])}
        return out | {side: pa.array(both[side], mask=~both[f"has_{side}"]) for side in ("left", "right")}

    return map_arrow(docs, work, "d long, tk long, pos int, far short, near short, key long, left long, right long")


def _both(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(row, side, key, h) of the half windows to the left (0) and right (1) of quarter windows."""
    rows, sides, values = [], [], []
    for side, name in enumerate(("left", "right")):
        column = batch.column(name)
        row = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
        rows.append(row)
        sides.append(np.full(len(row), side, np.int32))
        values.append(column.fill_null(0).to_numpy(zero_copy_only=False)[row])
    row = np.concatenate(rows)
    return row, np.concatenate(sides), batch.column("key").to_numpy(zero_copy_only=False)[row], np.concatenate(values)


#: Quarter windows whose halves a task folds at once.
FOLD = 1 << 17


def _folded_halves(alive: DataFrame) -> DataFrame:
    """Half windows (key, side, h) with the least and the largest document that has them, folded within tasks."""

    def fold(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.concat_batches(held)
        row, side, key, h = _both(batch)
        order = np.lexsort((h, side, key))
        side, key, h, d = side[order], key[order], h[order], batch.column("d").to_numpy(zero_copy_only=False)[row][order]
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (side[1:] != side[:-1]) | (h[1:] != h[:-1])]) if len(key) else np.empty(0, np.int64)
        low, high = (f.reduceat(d, first) if len(d) else d for f in (np.minimum, np.maximum))
        return pa.RecordBatch.from_pydict({"key": pa.array(key[first]), "side": pa.array(side[first]), "h": pa.array(h[first]), "low": pa.array(low), "high": pa.array(high)})

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= FOLD:
                yield fold(held)
                held, n = [], 0
        if n:
            yield fold(held)

    return arrow_map(alive.select("d", "key", "left", "right"), run, "key long, side int, h long, low long, high long")


def _one_hash(key: np.ndarray, side: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One long for a half window; two that share it cost a comparison of full windows, no more."""
    return _mix(key.view(np.uint64) ^ _mix(h.view(np.uint64) + side.astype(np.uint64))).view(np.int64)


def _found_halves(alive: DataFrame, known: np.ndarray) -> DataFrame:
    """(d, tk, found): the half windows among the known ones (sorted), once each; one row for a document and batch."""
    shared = alive.sparkSession.sparkContext.broadcast(known)

    def work(batch: pa.RecordBatch) -> dict:
        row, side, key, h = _both(batch)
        keep = _among(_one_hash(key, side, h), shared.value)
        row, side = row[keep], side[keep]
        column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        order = np.lexsort((side, column("pos")[row], column("tk")[row], column("d")[row]))
        row, side = row[order], side[order]
        own = np.stack([column("d")[row], column("tk")[row], column("pos")[row], side])
        once = np.r_[True, (own[:, 1:] != own[:, :-1]).any(axis=0)] if len(row) else np.empty(0, bool)  # rows may repeat
        row, side = row[once], side[once]
        d, tk = column("d")[row], column("tk")[row]
        first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (tk[1:] != tk[:-1])]) if len(d) else np.empty(0, np.int64)
        at = pa.array(row)
        found = pa.StructArray.from_arrays([*(batch.column(c).take(at) for c in ("pos", "far", "near")), pa.array(side)], names=["pos", "far", "near", "side"])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(d)], pa.int32()), found)
        return {"d": pa.array(d[first]), "tk": pa.array(tk[first]), "found": lists}

    return map_arrow(alive, work, "d long, tk long, found array<struct<pos:int,far:short,near:short,side:int>>")


def _windows(docs: DataFrame, width: int) -> DataFrame:
    """Full windows around the half windows in ``found``: document, start and a 128-bit hash."""
    quarter, half = levels(width)

    def work(batch: pa.RecordBatch) -> dict:
        ds, tks, starts, h1, h2 = [], [], [], [], []
        for d, tk, text, found in zip(batch.column("d").to_pylist(), batch.column("tk").to_pylist(), byte_rows(batch.column("t")), batch.column("found").to_pylist(), strict=True):
            words = text.split()
            edge = np.zeros(len(words) + 2, np.int32)
            for x in found:
                if x["side"]:
                    low, high = x["pos"] - min(width - half, x["far"]), x["pos"] - x["near"]
                else:
                    low, high = x["pos"] - x["far"], x["pos"] - max(half - quarter, x["near"])
                if low <= high:
                    edge[low] += 1
                    edge[high + 1] -= 1
            start = np.flatnonzero(np.cumsum(edge)[: max(0, len(words) - width + 1)] > 0)
            hashes = word_hashes([words])
            ds.append(np.full(len(start), d))
            tks.append(np.full(len(start), tk))
            starts.append(start)
            h1.append(Rolling(hashes, _BASES[0]).at(start, width))
            h2.append(Rolling(_mix(hashes), _BASES[1]).at(start, width))
        join = lambda x, t: np.concatenate(x).astype(t)
        return {"d": pa.array(join(ds, np.int64)), "tk": pa.array(join(tks, np.int64)), "s": pa.array(join(starts, np.int32)), "k1": pa.array(np.concatenate(h1).view(np.int64)), "k2": pa.array(np.concatenate(h2).view(np.int64))}

    return map_arrow(docs.select("d", "tk", "t", "found"), work, "d long, tk long, s int, k1 long, k2 long")


def _repeated(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur in two documents, and the smallest document of each."""
    return df.groupBy(*keys).agg(F.min("d").alias("least"), F.max("d").alias("most")).where("least < most").drop("most")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50) -> tuple[DataFrame, DataFrame]:
    """(copies, repeats). Copies: (d, tk) of documents whose text a smaller document has. Repeats: (d, tk,
    starts), for other documents the starts of windows that also start in a smaller document. d is the id
    as a long, tk a hash of the text, which tells rows with equal ids apart."""
    if width < 8:
        raise ValueError("width must be 8 words at least")
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.xxhash64(text_col).alias("tk"), F.col(text_col).alias("t")).where("d is not null and t is not null")
    keys = stored(rows.select("d", "tk", F.md5(F.col("t").cast("binary")).alias("m")), "texts")
    first = stored(keys.groupBy("m").agg(F.min("d").alias("least"), F.max("d").alias("most")).where("least < most").drop("most"), "copied")
    copies = stored(keys.join(first, "m").where("d > least").select("d", "tk").distinct(), "copies")
    release(keys, first)
    base = rows.join(small(copies), ["d", "tk"], "left_anti")

    quarters = _quarters(base, width)
    quarter = stored(_repeated(quarters.select("key", "d"), "key").select("key"), "quarter")
    if quarter.count() <= KEYS:
        alive = stored(_quarters(base, width, np.sort(quarter.toArrow().column("key").to_numpy())), "alive")
    else:
        alive = stored(quarters.join(quarter, "key"), "alive")
    halves = _folded_halves(alive).groupBy("key", "side", "h").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    again = stored(halves.where("low < high").select("key", "side", "h"), "half")
    if again.count() <= KEYS:
        known = again.toArrow()
        found = _found_halves(alive, np.sort(_one_hash(*(known.column(c).to_numpy() for c in ("key", "side", "h")))))
        found = found.distinct().groupBy("d", "tk").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
    else:
        columns = ("key", "d", "tk", "pos", "far", "near")
        side = lambda n, c: alive.where(F.col(c).isNotNull()).select(*columns, F.lit(n).alias("side"), F.col(c).alias("h"))
        found = side(0, "left").unionByName(side(1, "right")).join(again, ["key", "side", "h"])
        found = found.groupBy("d", "tk").agg(F.collect_set(F.struct("pos", "far", "near", "side")).alias("found"))
    found = stored(found, "found")
    release(alive, again, quarter)
    wanted = rows.join(small(found.select("d", "tk")), ["d", "tk"], "left_semi").dropDuplicates(["d", "tk"])
    windows = stored(_windows(wanted.join(found, ["d", "tk"]), width), "windows")
    again = stored(_repeated(windows.select("k1", "k2", "d"), "k1", "k2"), "full")
    hit = windows.join(again, ["k1", "k2"]).where("d > least").groupBy("d", "tk").agg(F.collect_list("s").alias("starts"))
    hit = stored(hit, "repeats")
    release(found, windows, again)
    return copies, hit


def covered(n: int, starts: list[int] | None, width: int) -> np.ndarray:
    """Which of n words lie in a window that begins at one of the starts."""
    edge = np.zeros(n + 1, np.int32)
    if starts:
        at = np.asarray(starts)
        np.add.at(edge, at, 1)
        np.add.at(edge, np.minimum(at + width, n), -1)
    return np.cumsum(edge)[:n] > 0


def _marked(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """All rows with ``__copy`` and ``__starts``; only rows that lose words are shuffled with their texts."""
    copies, hits = repeats(docs, id_col, text_col, width)
    keyed = docs.withColumns({"__d": F.col(id_col).cast("long"), "__tk": F.xxhash64(text_col)})
    name = lambda df: df.withColumnsRenamed({"d": "__d", "tk": "__tk"})
    flagged = keyed.join(small(name(copies).withColumn("__copy", F.lit(True))), ["__d", "__tk"], "left")
    touched = small(name(hits.select("d", "tk")))
    with_hits = flagged.join(touched, ["__d", "__tk"], "left_semi").join(name(hits).withColumnRenamed("starts", "__starts"), ["__d", "__tk"])
    without = flagged.join(touched, ["__d", "__tk"], "left_anti").withColumn("__starts", F.lit(None).cast("array<int>"))
    return with_hits.unionByName(without).withColumn("__copy", F.coalesce("__copy", F.lit(False))).drop("__d", "__tk")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50) -> DataFrame:
    """One row per input row: ``id_col``, ``n_words``, ``n_removed``, ``kept_sha256``, ``spans``.

    A word goes if a window of ``width`` words around it also starts in a document with a smaller id;
    windows are judged on the input. ``spans`` are [start, stop) word ranges that go. Null or blank texts
    have no words. Rows with a null id lose nothing and cover nothing. Rows with equal ids are one
    document to others and never cover each other. An empty table gives an empty result.
    """
    source = docs.select(F.col(id_col), F.col(text_col))
    marked = _marked(source, id_col, text_col, width)
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def work(batch: pa.RecordBatch) -> dict:
        n_words, n_removed, digests, spans = [], [], [], []
        for text, copy, starts in zip(byte_rows(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            words = text.split() if text else []
            gone = np.full(len(words), len(words) >= width) if copy else covered(len(words), starts, width)
            kept = words if not gone.any() else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0])).reshape(-1, 2).tolist()
            n_words.append(len(words))
            n_removed.append(len(words) - len(kept))
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            spans.append([{"start": a, "stop": b} for a, b in edges])
        return {id_col: batch.column(0), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": digests, "spans": pa.array(spans, spans_type)}

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,stop:int>>"
    return map_arrow(marked.select(id_col, text_col, "__copy", "__starts"), work, schema)


def cut_words(text: bytes, gone: np.ndarray) -> bytes:
    """The text without those words and the white space behind each run of them."""
    blank = np.isin(np.frombuffer(text, np.uint8), (9, 10, 11, 12, 13, 32))
    edges = np.flatnonzero(np.diff(np.r_[True, blank, True].astype(np.int8)))
    starts = np.r_[edges[0::2], len(text)]
    runs = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0])).reshape(-1, 2)
    out, at = [], 0
    for a, b in runs.tolist():
        out.append(text[at : starts[a]])
        at = int(starts[b])
    return b"".join([*out, text[at:]])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50) -> DataFrame:
    """The rows with their repeated passages cut out of the text, all other columns as they are.

    Rows that had words and have none left go.
    """
    columns = docs.columns
    marked = _marked(docs, id_col, text_col, width).select(*columns, "__copy", "__starts")
    at = columns.index(text_col)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, keep = [], []
        for text, copy, starts in zip(byte_rows(batch.column(at)), batch.column(len(columns)).to_pylist(), batch.column(len(columns) + 1).to_pylist(), strict=True):
            if text and (copy or starts):
                n = len(text.split())
                gone = np.full(n, n >= width) if copy else covered(n, starts, width)
                keep.append(not n or not gone.all())
                text = cut_words(text, gone)
            else:
                keep.append(True)
            texts.append(text)
        arrays = [batch.column(k) for k in range(len(columns))]
        arrays[at] = pa.array(texts, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays(arrays, names=columns).filter(pa.array(keep))

    return map_arrow(marked, work, docs.schema)
