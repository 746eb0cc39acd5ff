"""Language identification as inference of a mixture.

Each language has a distribution over hashed byte trigrams, learned from labelled documents. A document is
a mixture of languages whose proportions are estimated by expectation-maximisation. Among the nested sets
of its strongest languages the one of the best penalised likelihood is taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import arrow_map, byte_rows, map_arrow, vector_sum

#: Buckets of trigrams, share of the common distribution in each language's, rounds of estimation.
BUCKETS, COMMON, ROUNDS = 1 << 15, 0.02, 8
#: Cost of one more language, in units of half the logarithm of the trigram count.
PENALTY = 8.0
UNKNOWN = "und"

#: ASCII letters in lower case, other ASCII bytes as spaces.
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes | None) -> bool:
    return bool(text) and (bool(ASCII_LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8")))


def trigrams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of all trigrams of texts between spaces; none is all spaces or crosses texts."""
    padded = [b" " + t.translate(LETTERS) + b" " if t else b"" for t in texts]
    data = np.frombuffer(b"".join(padded), np.uint8)
    row = np.repeat(np.arange(len(texts)), [len(p) for p in padded])
    if len(data) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = data[:-2].astype(np.uint32) << np.uint32(16) | data[1:-1].astype(np.uint32) << np.uint32(8) | data[2:]
    good = (row[:-2] == row[2:]) & (data[1:-1] != 0x20)
    bucket = (code[good] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    return row[:-2][good], bucket.astype(np.int64)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages, probabilities


def _slices(texts: list[bytes | None], limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    first = held = 0
    for k, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= limit:
            yield first, k + 1
            first, held = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def train(docs: DataFrame, where: Column, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Trigram counts of every language over all rows that ``where`` admits and that have a language."""
    rows = docs.where(where & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, languages = byte_rows(batch.column("t")), np.array(batch.column("l").to_pylist(), object)
            names, of = np.unique(languages, return_inverse=True)
            for a, b in _slices(texts):
                row, bucket = trigrams(texts[a:b])
                found = np.bincount(of[a:b][row] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                for name, part in zip(names, found, strict=True):
                    sums[name] = sums[name] + part if name in sums else part
        if sums:
            yield pa.RecordBatch.from_pydict({"key": list(sums), "vector": [v.astype(np.int64).tobytes() for v in sums.values()], "kind": ["int64"] * len(sums)})

    counts = vector_sum(arrow_map(rows, count, "key string, vector binary, kind string"))
    languages = sorted(counts)
    if not languages:
        return Model([], np.empty((BUCKETS, 0)))
    table = np.stack([counts[x] for x in languages], axis=1).astype(float)
    common = (table.sum(axis=1) + 0.5) / (table.sum() + 0.5 * BUCKETS)
    own = table / np.maximum(table.sum(axis=0), 1)
    return Model(languages, (1 - COMMON) * own + COMMON * common[:, None])


def _estimate(likely: np.ndarray, n: np.ndarray, starts: np.ndarray, of: np.ndarray, mix: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log-likelihood) of the documents after some rounds from ``mix``."""
    total = np.add.reduceat(n, starts)
    for _ in range(rounds):
        joint = likely * mix[of]
        joint *= (n / joint.sum(axis=1))[:, None]
        mix = np.add.reduceat(joint, starts) / total[:, None]
    return mix, np.add.reduceat(n * np.log((likely * mix[of]).sum(axis=1)), starts)


def infer(texts: list[bytes | None], model: Model, penalty: float = PENALTY) -> np.ndarray:
    """Proportions (documents x languages) within each document's language set; zeros without trigrams."""
    out = np.zeros((len(texts), len(model.languages)))
    for a, b in _slices(texts):
        row, bucket = trigrams(texts[a:b])
        if not len(row):
            continue
        key, n = np.unique(row * BUCKETS + bucket, return_counts=True)
        row, n = key // BUCKETS, n.astype(float)
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        docs = row[starts]
        of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(row)]))
        likely = model.table[key % BUCKETS]
        size = len(model.languages)
        mix, _ = _estimate(likely, n, starts, of, np.full((len(docs), size), 1 / size), ROUNDS)
        order = np.argsort(-mix, axis=1, kind="stable")
        single = np.add.reduceat(n[:, None] * np.log(likely), starts)
        best = single.max(axis=1)
        chosen = np.zeros_like(mix)
        chosen[np.arange(len(docs)), single.argmax(axis=1)] = 1
        cost = penalty * 0.5 * np.log(np.add.reduceat(n, starts))
        live = np.arange(len(docs))
        for k in range(2, size + 1):  # one more language, as long as it pays
            live = live[mix[live, order[live, k - 1]] > 0.01]
            if not len(live):
                break
            pick = np.isin(of, live)
            again = np.searchsorted(live, of[pick])
            begin = np.flatnonzero(np.r_[True, again[1:] != again[:-1]])
            part = np.zeros((len(live), size))
            rows = np.arange(len(live))[:, None]
            part[rows, order[live, :k]] = np.maximum(mix[live][rows, order[live, :k]], 1e-6)
            part /= part.sum(axis=1, keepdims=True)
            found, value = _estimate(likely[pick], n[pick], begin, again, part, ROUNDS // 2)
            value -= (k - 1) * cost[live]
            better = value > best[live]
            chosen[live[better]], best[live[better]] = found[better], value[better]
            live = live[better]
        out[a + docs] = chosen
    return out


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = PENALTY, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``id_col``, ``lang_pred``, ``score`` and ``mixture`` (language to proportion).

    The prediction is the largest proportion of the chosen set, ties to the first name. Null texts, texts
    without a letter and an empty model give ``und`` with score 0 and an empty mixture.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [id_col, *extra]

    def work(batch: pa.RecordBatch) -> dict:
        model = shared.value
        texts = byte_rows(batch.column(len(names)))
        texts = [t if has_letter(t) else None for t in texts]
        share = infer(texts, model, penalty) if model.languages else np.zeros((len(texts), 0))
        known = share.sum(axis=1) > 0
        top = share.argmax(axis=1) if model.languages else np.zeros(len(texts), int)
        predicted = [model.languages[k] if ok else UNKNOWN for k, ok in zip(top.tolist(), known.tolist(), strict=True)]
        score = np.where(known, share[np.arange(len(texts)), top], 0.0) if model.languages else np.zeros(len(texts))
        mixtures = [[(model.languages[k], float(s[k])) for k in np.flatnonzero(s > 0)] for s in share]
        columns = {n: batch.column(k) for k, n in enumerate(names)}
        return columns | {"lang_pred": pa.array(predicted, pa.string()), "score": pa.array(np.minimum(score, 1.0)), "mixture": pa.array(mixtures, pa.map_(pa.string(), pa.float64()))}

    fields = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names)
    return map_arrow(docs.select(*(F.col(n) for n in names), F.col(text_col)), work, f"{fields}, lang_pred string, score double, mixture map<string,double>")
