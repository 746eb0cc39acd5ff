"""Quality by importance resampling.

Two generative models of hashed n-grams, one of target text and one of all raw text, give each document a
log importance weight. Documents are drawn without replacement with chances that follow the weights, by
Gumbel top-k: noise is added to the log weights and the k largest keys are kept. k is the number of
documents whose weight lies above a cut that labelled documents fix.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import arrow_map, byte_rows, stored, vector_sum

#: Buckets of n-grams; bound of the sample: labelled rows of each class; count added to every bucket.
BUCKETS, MOST, ADDED = 1 << 14, 10_000, 20.0
#: Words and runs of other characters.
TOKENS = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\s]+")
_REPEAT = np.uint32(0x52455054)


def buckets(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams of each text, their buckets): tokens and pairs of neighbours; a token twice in a row is one
    and the same pair, whatever the token."""
    lists = [TOKENS.findall(t) if t else [] for t in texts]
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    one = np.fromiter(map(zlib.crc32, chain.from_iterable(lists)), np.uint32, int(n.sum()))
    first = np.cumsum(n) - n
    two = np.zeros(len(one), np.uint32)
    two[1:] = np.where(one[1:] == one[:-1], _REPEAT, one[:-1] * np.uint32(0x85EBCA6B) ^ (one[1:] >> np.uint32(3)))
    two[first[n > 0]] = np.uint32(0x53544152)  # the first token of a text
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    both = np.empty(2 * len(one), np.int64)
    both[0::2], both[1::2] = (one * np.uint32(0x9E3779B1)) >> shift, (two * np.uint32(0xC2B2AE35)) >> shift
    return 2 * n, both


@dataclass(frozen=True)
class Model:
    ratio: np.ndarray  # log target over raw probability of each bucket
    cut: float  # least log weight of what counts towards k


def _groups(texts: list[bytes | None], limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    first = held = 0
    for k, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= limit:
            yield first, k + 1
            first, held = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def weigh(texts: list[bytes | None], ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, log importance weight) of each text; no n-grams weigh 0."""
    counts, sums = [], []
    for a, b in _groups(texts):
        n, found = buckets(texts[a:b])
        total = np.zeros(len(n))
        if len(found):  # each text's sum is its own, whatever texts are beside it
            total[n > 0] = np.add.reduceat(ratio[found], (np.cumsum(n) - n)[n > 0])
        counts.append(n)
        sums.append(total)
    return (np.concatenate(counts), np.concatenate(sums)) if counts else (np.empty(0, np.int64), np.empty(0))


def best_cut(good: np.ndarray, bad: np.ndarray, favour: float = 5.0) -> float:
    """The cut between weights of good and bad documents with the least errors, a lost good document
    counting ``favour`` times; in the middle of the widest gap of the best. No bad ones: below all."""
    if not len(bad):
        return -np.inf
    if not len(good):
        return np.inf
    values = np.unique(np.concatenate([good, bad]))
    edges = np.r_[values[0] - 1, (values[1:] + values[:-1]) / 2, values[-1] + 1]
    gaps = np.r_[0.0, np.diff(values), 0.0]
    errors = favour * np.searchsorted(np.sort(good), edges) + len(bad) - np.searchsorted(np.sort(bad), edges)
    best = np.flatnonzero(errors == errors.min())
    return float(edges[best[np.argmax(gaps[best])]])


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of target over raw probability; raw counts are scaled to the target's size, and both smoothed alike."""
    return np.log(target + ADDED) - np.log(raw * (target.sum() / raw.sum()) + ADDED)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST, seed: int = 2) -> Model:
    """Raw counts over all rows; target counts and the cut from at most ``most`` labelled rows of each class,
    those least by a hash of the id. Half of the good rows (by another hash) give the target counts, the
    other half the cut, so that the cut knows documents the model hasn't seen. Null ids and labels are left out; an id with both labels counts as
    bad, and one with several texts has the least weight of these. Without good rows, or rows at all, every weight is 0."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).cast("int").alias("__label"))
    order = [F.xxhash64("__id", F.lit(seed)), F.col("__id")]
    sample = known.where("__label = 0").orderBy(*order).limit(most).unionAll(known.where("__label = 1").orderBy(*order).limit(most))
    sample = stored(sample.withColumn("__fit", (F.col("__label") == 1) & (F.pmod(F.xxhash64("__id", F.lit(seed + 1)), F.lit(2)) == 0)), "sample")
    rows = docs.join(F.broadcast(sample), F.col(id_col) == F.col("__id"), "left").select(F.col(text_col).alias("t"), F.col("__id").alias("i"), F.col("__label").alias("label"), F.coalesce("__fit", F.lit(False)).alias("fit"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for batch in batches:
            texts, good = byte_rows(batch.column("t")), np.array(batch.column("fit").to_pylist(), bool)
            for a, b in _groups(texts):
                n, found = buckets(texts[a:b])
                raw += np.bincount(found, minlength=BUCKETS)
                target += np.bincount(found[np.repeat(good[a:b], n)], minlength=BUCKETS)
        yield pa.RecordBatch.from_pydict({"key": ["raw", "target"], "vector": [raw.tobytes(), target.tobytes()], "kind": ["float64"] * 2})

    sums = vector_sum(arrow_map(rows, count, "key string, vector binary, kind string"))
    raw, target = (sums.get(k, np.zeros(BUCKETS)) for k in ("raw", "target"))
    if not target.sum():
        return Model(np.zeros(BUCKETS), -np.inf)
    ratio = log_ratio(raw, target)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, weights = weigh(byte_rows(batch.column("t")), shared.value)
            yield pa.RecordBatch.from_pydict({"i": batch.column("i"), "label": batch.column("label"), "w": pa.array(weights)})

    weighed = arrow_map(rows.where("label is not null and not fit").select("t", "i", "label"), value, f"i {docs.schema[id_col].dataType.simpleString()}, label int, w double")
    found = weighed.groupBy("i", "label").agg(F.min("w").alias("w")).toPandas()  # one row for each id of the sample
    return Model(ratio, best_cut(found.w[found.label == 1].to_numpy(), found.w[found.label == 0].to_numpy()))


def keyed(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", noise: float = 1.0, seed: int = 2) -> DataFrame:
    """The rows with ``__n``, ``__weight`` and ``__key``: the log weight plus Gumbel noise fixed by the id."""
    shared = docs.sparkSession.sparkContext.broadcast(model.ratio)
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, weights = weigh(byte_rows(batch.column(at)), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n), pa.array(weights)], names=[*names, "__n", "__weight"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    weighed = arrow_map(docs, run, f"{fields}, __n long, __weight double")
    return weighed.withColumn("__key", F.col("__weight") + noise * gumbel(id_col, seed))


def gumbel(id_col: str, seed: int) -> Column:
    """Standard Gumbel noise from a hash of the id."""
    bits = F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)), 11)
    uniform = (bits + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def top_cut(keys: DataFrame, k: int, few: int = 20_000, bins: int = 1024) -> float:
    """A value with the k largest of ``key`` at or above it (more if equal keys tie), found by narrowing histograms."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if k <= 0:
        return np.inf
    if k >= n:
        return -np.inf
    above = 0
    while True:
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high))
        width = (high - low) / bins
        if n <= few or width <= 0 or low + width == low:  # equal keys are counted, not repeated
            rows = inside.groupBy("key").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("key")).limit(few).collect()
            values = np.array([r.key for r in rows])
            at = int(np.searchsorted(np.cumsum([r.n for r in rows]), k - above))
            return float((values[at] + values[at + 1]) / 2) if at + 1 < len(values) else float(values[at])
        rows = inside.groupBy(F.least(F.floor((F.col("key") - low) / width), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        for r in sorted(rows, key=lambda r: -r.bin):
            if above + r.n >= k:
                low, high, n = r.low, r.high, r.n
                break
            above += r.n


def _selection(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, noise: float, most: int, seed: int) -> tuple[Model, DataFrame, float]:
    model = train(docs, labels, id_col, text_col, label_col, most, seed)
    slim = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    keys = stored(keyed(slim, model, "__id", "__text", noise, seed).select("__id", "__n", "__weight", F.col("__key").alias("key")), "keys")
    k = keys.where(F.col("__weight") >= model.cut).count()
    return model, keys, top_cut(keys, k)


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", noise: float = 1.0, most: int = MOST, seed: int = 2) -> DataFrame:
    """One row per input row: ``id_col``, ``n_grams``, ``log_weight``, ``key``, ``selected``.

    Null, empty and blank texts have no n-grams and weight 0. Rows with equal ids have equal noise; equal
    keys at the cut are selected together. ``noise`` scales the Gumbel noise (0: the k largest weights).
    Without good labels all rows are selected. An empty table gives an empty result.
    """
    _, keys, cut = _selection(docs, labels, id_col, text_col, label_col, noise, most, seed)
    return keys.select(F.col("__id").alias(id_col), F.col("__n").alias("n_grams"), F.col("__weight").alias("log_weight"), "key", (F.col("key") >= cut).alias("selected"))


def selected_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", noise: float = 1.0, most: int = MOST, seed: int = 2) -> DataFrame:
    """The selected rows, with their columns as they are."""
    model, _, cut = _selection(docs, labels, id_col, text_col, label_col, noise, most, seed)
    return keyed(docs, model, id_col, text_col, noise, seed).where(F.col("__key") >= cut).select(*docs.columns)
