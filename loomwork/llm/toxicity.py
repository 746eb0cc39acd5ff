"""Toxicity by subword-bag embeddings.

A word is the mean of the embeddings of its character n-grams, a document the mean of its words, and a
linear softmax over that mean gives the label. Embeddings and softmax are trained jointly in numpy, on a
bounded sample. As all of that is linear up to the softmax, a document's score needs one number per word,
the mean over the word's n-grams; unseen spellings share n-grams with seen ones.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import byte_rows, map_arrow
from loomwork.llm.decontaminate import words

#: Lengths of n-grams in bytes, their buckets, and the bound of the sample: labelled rows of each class.
LENGTHS, BUCKETS, MOST = (3, 4, 5), 1 << 19, 1500
#: Bytes of a text of the sample.
LONGEST = 1 << 16
#: Documents of the sample that an n-gram must occur in; mini-batches of training at least.
SEEN, STEPS = 2, 900
#: Words of the extracts of clean documents: any part of a clean document is clean too.
EXTRACTS = (1, 1, 4, 8, 16, 64)
#: Words whose numbers a task keeps.
KEPT = 400_000


def ngrams(word: bytes) -> list[int]:
    """Buckets of a word's n-grams, its ends marked, and of the word itself."""
    marked = b"<" + word + b">"
    n = len(marked)
    return [zlib.crc32(marked[a : a + k]) % BUCKETS for k in LENGTHS for a in range(n - k + 1)] + [zlib.crc32(marked) % BUCKETS]


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of each n-gram bucket: its embedding along the difference of the two classes
    bias: float


class _Bags:
    """Documents as word frequencies, words as n-gram lists."""

    def __init__(self, lists: list[list[bytes]]) -> None:
        index: dict[bytes, int] = {}
        self.docs: list[tuple[np.ndarray, np.ndarray]] = []
        for words_of in lists:
            ids = np.fromiter((index.setdefault(w, len(index)) for w in words_of), np.int64)
            found, counts = np.unique(ids, return_counts=True)
            self.docs.append((found, counts / max(1, len(ids))))
        grams = [ngrams(w) for w in index]
        self.sizes = np.fromiter(map(len, grams), np.int64, len(grams))
        self.first = np.cumsum(self.sizes) - self.sizes
        self.grams = np.fromiter((g for gs in grams for g in gs), np.int64, int(self.sizes.sum()))
        self.seen = np.zeros(BUCKETS, np.int64)  # documents of each n-gram
        for d in range(len(lists)):
            self.seen[np.unique(self.batch(np.array([d]))[0])] += 1

    def batch(self, chosen: np.ndarray):
        """n-grams of the words of some documents, words' sizes, and (document, word, frequency) entries."""
        parts = [self.docs[d] for d in chosen]
        doc = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        word, of = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        sizes = self.sizes[word]
        at = np.repeat(self.first[word] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return self.grams[at], sizes, doc, of, np.concatenate([p[1] for p in parts])


#: Spread of the first embeddings.
INIT = 0.01


def fit(texts: list[bytes | None], labels: np.ndarray, dim: int = 8, epochs: int = 6, size: int = 64, rate: float = 1.0, gain: float = 20.0, seed: int = 1) -> Model:
    """Joint training by Adagrad on mini-batches. With one class only, every score is that class's share."""
    labels = np.asarray(labels, int)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    bias = float(np.log(share / (1 - share)))
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS, np.float32), bias)
    rng = np.random.default_rng(seed)
    lists = [words(t) for t in texts]
    clean = [w for w, label in zip(lists, labels, strict=True) if not label and w]
    for w in clean:
        at = rng.integers(0, len(w), len(EXTRACTS)).tolist()
        lists.extend(w[a : a + n] for a, n in zip(at, EXTRACTS, strict=True))
    labels = np.r_[labels, np.zeros(len(lists) - len(labels), int)]
    bags = _Bags(lists)
    emb = rng.normal(0, INIT, (BUCKETS, dim)).astype(np.float32)
    out = rng.normal(0, 0.5, (dim, 2)).astype(np.float32)
    off = np.array([0, bias], np.float32)
    emb_sum, out_sum, off_sum = np.full((BUCKETS, dim), 1e-6, np.float32), np.full((dim, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    usual = (bags.seen >= SEEN)[:, None]
    emb *= usual
    some = np.array([len(d[0]) > 0 for d in bags.docs])
    clean_rows, toxic_rows = np.flatnonzero(some & (labels == 0)), np.flatnonzero(some & (labels == 1))
    times = max(1, round(len(clean_rows) / (7 * max(1, len(toxic_rows)))))
    full = np.concatenate([clean_rows, np.repeat(toxic_rows, times)])  # an eighth is toxic at least
    epochs = max(epochs, -(-STEPS * size // max(1, len(full))))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(full)
        for k in range(0, len(order), size):
            chosen = order[k : k + size]
            grams, sizes, doc, of, frequency = bags.batch(chosen)
            starts = np.cumsum(sizes) - sizes
            word = np.add.reduceat(emb[grams], starts) / sizes[:, None]
            mean = np.zeros((len(chosen), dim))
            np.add.at(mean, doc, word[of] * frequency[:, None])
            logits = gain * mean @ out + off
            prob = np.exp(logits - logits.max(axis=1, keepdims=True))
            prob /= prob.sum(axis=1, keepdims=True)
            prob[np.arange(len(chosen)), labels[chosen]] -= 1
            d_out, d_off, d_mean = gain * mean.T @ prob / len(chosen), prob.mean(axis=0), gain * prob @ out.T / len(chosen)
            d_word = np.zeros_like(word)
            np.add.at(d_word, of, frequency[:, None] * d_mean[doc])
            d_word /= sizes[:, None]
            touched, where = np.unique(grams, return_inverse=True)
            back = np.repeat(np.arange(len(sizes)), sizes)
            grad = np.stack([np.bincount(where, d_word[back, c], len(touched)) for c in range(dim)], axis=1)
            emb_sum[touched] += grad**2
            emb[touched] -= (step * grad / np.sqrt(emb_sum[touched])).astype(np.float32) * usual[touched]
            out_sum += d_out**2
            out -= (step * d_out / np.sqrt(out_sum)).astype(np.float32)
            off_sum += d_off**2
            off -= (step * d_off / np.sqrt(off_sum)).astype(np.float32)
    return Model((gain * emb @ (out[:, 1] - out[:, 0])).astype(np.float32), float(off[1] - off[0]))


class _Numbers(dict):
    """The number of a word, computed when first met."""

    def __init__(self, weights: np.ndarray) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        number = float(self.weights[ngrams(word)].mean())
        if len(self) < KEPT:
            self[word] = number
        return number


def train(docs: DataFrame, labels: DataFrame, where: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MOST, seed: int = 1) -> Model:
    """Fit on at most ``most`` labelled rows of each class, those least by a hash of the id; ``where`` admits labels.

    Rows with a null id or label are left out; an id with both labels counts as toxic. Of an id's texts the least is
    taken, and texts of more than ``LONGEST`` bytes are not learned from.
    """
    known = labels.where(where & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__label"))
    order = [F.xxhash64("__id", F.lit(seed)), F.col("__id")]
    sample = known.where("__label = 0").orderBy(*order).limit(most).unionAll(known.where("__label = 1").orderBy(*order).limit(most))
    rows = docs.join(F.broadcast(sample), F.col(id_col) == F.col("__id")).select(F.col(id_col).alias("__id"), F.col(text_col).cast("binary").alias("__text"), "__label")
    short = rows.where(F.coalesce(F.octet_length("__text"), F.lit(0)) <= LONGEST)
    found = sorted(((r[0], bytes(r[2] or b""), r[1]) for r in short.groupBy("__id", "__label").agg(F.min("__text")).collect()), key=lambda r: r[0])
    return fit([r[1] for r in found], np.array([r[2] for r in found], int), seed=seed)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``id_col`` and ``score``; null, empty and blank texts get the score of no words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [id_col, *extra]
    held: dict[int, _Numbers] = {}

    def work(batch: pa.RecordBatch) -> dict:
        model = shared.value
        numbers = held.setdefault(0, _Numbers(model.weights))
        logits = np.full(batch.num_rows, model.bias)
        for k, text in enumerate(byte_rows(batch.column(len(names)))):
            if found := words(text):
                logits[k] += np.fromiter(map(numbers.__getitem__, found), float, len(found)).mean()
        columns = {n: batch.column(k) for k, n in enumerate(names)}
        return columns | {"score": pa.array(1 / (1 + np.exp(-np.clip(logits, -700, 700))))}

    fields = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names)
    return map_arrow(docs.select(*(F.col(n) for n in names), F.col(text_col)), work, f"{fields}, score double")
