import math
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from loomwork.llm import hmm, queries

SF = "/root/testdata/sf0.01"


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w] + [None]


def base(rows, training):
    counts = Counter(t for d, text in rows if training(d) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    return n, {d: (len(ts := tokens(text)), sum(counts[t] > 0 for t in ts), sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts)) for d, text in rows}


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    n, want = base(rows, lambda d: not held(d))
    got = queries.op10_hmm(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        size, known, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), size, known, n)
        assert math.isclose(r.base_score, score, rel_tol=1e-9)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_forward_is_exact():
    rng = np.random.default_rng(1)
    model = hmm.Model.rough(3)
    symbols = rng.integers(0, 50, 12)
    lengths = np.array([5, 1, 6])
    got = hmm.forward(model, lengths, symbols)
    at = 0
    for n, value in zip(lengths, got, strict=True):
        seq = symbols[at : at + n]
        at += n
        total = 0
        for path in product(range(3), repeat=int(n)):
            p = model.start[path[0]] * model.emit[seq[0], path[0]]
            for a, b, s in zip(path, path[1:], seq[1:], strict=False):
                p *= model.move[a, b] * model.emit[s, b]
            total += p
        assert math.isclose(value, math.log(total), rel_tol=1e-9)


def test_rounds_raise_likelihood():
    texts = [b"a bb ccc a bb. a bb", b"xx yyy! xx zz xx", b"", None] * 5
    lengths, symbols = hmm.classes(texts)
    assert lengths.tolist()[:4] == [8, 6, 1, 1] and (symbols == hmm.CLASSES).sum() == 20
    model, values = hmm.Model.rough(2), []
    for _ in range(8):
        values.append(hmm.forward(model, lengths, symbols).sum())
        counts, value = hmm.expected(model, lengths, symbols)
        assert math.isclose(value, values[-1], rel_tol=1e-9)
        assert math.isclose(counts[4 + 2 :].sum(), lengths.sum())
        model = hmm.Model.of(counts, 2, pull=1e-3)
    assert values == sorted(values)


def test_pieces_of_long_texts_are_exact(monkeypatch):
    rng = np.random.default_rng(3)
    lengths = np.array([1, 7, 23, 4, 40, 8, 3, 9])
    symbols = rng.integers(0, 60, lengths.sum())
    model = hmm.Model.rough(4)
    counts, value = hmm.expected(model, lengths, symbols)
    values = hmm.forward(model, lengths, symbols)
    for piece, cells in ((4, 16), (1, 5), (8, 1000)):
        monkeypatch.setattr(hmm, "PIECE", piece)
        monkeypatch.setattr(hmm, "CELLS", cells)
        assert np.allclose(hmm.forward(model, lengths, symbols), values, rtol=1e-9)
        again, sum_again = hmm.expected(model, lengths, symbols)
        assert np.allclose(again, counts, rtol=1e-7, atol=1e-9) and math.isclose(sum_again, value, rel_tol=1e-9)


def test_null_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(hmm, "REPEATED", 50)
    rows = [(None, f"a{k} b c") for k in range(2000)] + [(5, "same text")] * 300 + [(5, None)] * 120 + [(7, "same text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    model = hmm.train(docs, F.lit(True), sample=10, warm=1, rounds=1)
    got = hmm.score(docs, model, F.lit(True), blocks=8).collect()
    n, want = base([(k, t) for k, (_, t) in enumerate(rows)], lambda d: True)
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == sorted((a, b, round(c, 6)) for a, b, c in want.values())
    assert {r.train_tokens for r in got} == {n} and sum(r.doc_id is None for r in got) == 2000


def test_repeated_long_rows_are_computed_once(spark):
    long = " ".join(f"w{k % 91}" for k in range(900))
    rows = [(1, long)] * 40 + [(2, long), (3, "short one"), (3, "short one"), (4, None)] + [(k, f"w{k} w{k + 1}") for k in range(5, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    model = hmm.train(docs, F.lit(True), sample=10, warm=1, rounds=1)
    found = [sorted((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in hmm.score(docs, model, F.lit(True), block=size, blocks=4).collect()) for size in (1000, 1 << 24)]
    assert len(found[0]) == len(rows) and np.allclose(np.array(found[0], float), np.array(found[1], float), rtol=1e-12)
    assert len({r for f in found[:1] for r in f if r[0] == 1}) == 1
    n, want = base(list(enumerate(t for _, t in rows)), lambda d: True)
    assert sorted((a, b, round(c, 6)) for a, b, c in want.values()) == sorted((r[1], r[2], round(r[3], 6)) for r in found[0])


def test_million_words():
    words = np.random.default_rng(1).integers(0, 5000, 1_000_000)
    text = " ".join(f"w{w}" for w in words).encode()
    lengths, symbols = hmm.classes([text, b"short one"])
    model = hmm.Model.rough()
    counts, value = hmm.expected(model, lengths, symbols)
    assert math.isclose(hmm.forward(model, lengths, symbols).sum(), value, rel_tol=1e-9)
    assert math.isclose(counts[hmm.STATES + hmm.STATES**2 :].sum(), 1_000_004, rel_tol=1e-9)


def test_edges(spark):
    rows = [(1, "A b\tb", 7), (2, None, 8), (3, "", 9), (None, "b c", 1), (1, "A b\tb", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    where = F.coalesce(F.col("doc_id"), F.lit(0)) != 3
    model = hmm.train(docs, where, rounds=1)
    got = sorted(((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9)) for r in hmm.score(docs, model, where).collect()))
    n = 4 + 1 + 3 + 4
    line = lambda cs: round(sum(math.log10((c + 1) / (n + 4 + 1)) for c in cs), 9)
    assert got == sorted([(4, 4, n, line([2, 5, 5, 4]))] * 2 + [(1, 1, n, line([4]))] * 2 + [(3, 3, n, line([5, 1, 4]))])
    assert hmm.score(docs.limit(0), hmm.train(docs.limit(0), where), where).count() == 0
