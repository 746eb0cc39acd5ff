import math
import re
from collections import Counter

import numpy as np
import pytest

from loomwork.llm import search


def plain(docs, items, k=10):
    """The contract word by word."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counted = [(d, Counter(words(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in counted:
            m = 10 + 90 * sum(c.values()) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in set(words(text)) if w in c)
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("block_bytes", [search.BLOCK_BYTES, 200])
def test_against_plain_loops(spark, block_bytes):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcÉ9"), rng.integers(1, 3)))
    docs = [(k, " ".join(word() for _ in range(rng.integers(0, 60)))) for k in range(200)]
    docs += [(300, docs[7][1]), (301, docs[7][1].upper()), (302, None), (303, ""), (304, "--- !!"), (None, docs[7][1]), (5, docs[5][1])]
    items = [(k, " ".join(word() for _ in range(rng.integers(1, 12)))) for k in range(25)] + [(30, None), (31, ""), (32, "zzz"), (33, docs[7][1])]
    df = spark.createDataFrame([(*d, "x", 0) for d in docs], "doc_id long, text string, item_id string, rank int").repartition(6)
    got = search.best_documents(df, spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int"), block_bytes=block_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert found(got) == plain(docs, items)


def test_heaps_are_bounded_and_exact():
    rng = np.random.default_rng(2)
    heaps = search.Heaps(5, 3)
    rows = []
    for _ in range(40):
        item, score, doc = rng.integers(0, 5, 30), rng.integers(1, 20, 30), rng.integers(0, 1000, 30)
        rows += zip(item.tolist(), (-score).tolist(), doc.tolist(), strict=True)
        heaps.add(item, score, doc, np.zeros(30, np.int64))
        assert len(heaps.item) <= 15
    want = [x for i in range(5) for x in sorted(r for r in rows if r[0] == i)[:3]]
    assert list(zip(heaps.item.tolist(), (-heaps.score).tolist(), heaps.doc.tolist(), strict=True)) == want


def test_long_texts_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "alpha " * 300_000), (2, "alpha beta"), (3, "beta " * 10)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Beta alpha alpha"), (1, "Beta alpha alpha")], "item_id long, text string")
    want = plain([(1, "alpha " * 300_000), (2, "alpha beta"), (3, "beta " * 10)], [(1, "beta alpha")])
    assert found(search.best_documents(docs, items)) == sorted(want * 2, key=str)
    assert search.best_documents(docs.limit(0), items).collect() == []
    assert search.best_documents(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
