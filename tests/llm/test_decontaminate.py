import hashlib
import random
import re

import numpy as np

from loomwork.llm import decontaminate, fmindex, queries

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, width=10):
    windows = {}
    for name, text in items:
        ws = words(text)
        for k in range(max(1, len(ws) - width + 1) if ws else 0):
            windows.setdefault(tuple(ws[k : k + width]), set()).add(name)
    sizes = {len(w) for w in windows}
    out = []
    for d, text in docs:
        ws = words(text)
        hit, found = [False] * len(ws), set()
        for size in sizes:
            for k in range(len(ws) - size + 1):
                if (names := windows.get(tuple(ws[k : k + size]))) is not None:
                    hit[k : k + size] = [True] * size
                    found |= names
        found = sorted(str(x) for x in found if x is not None)
        out.append((d, len(ws), sum(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), any(hit)))
    return sorted(out, key=str)


def digest(df):
    from pyspark.sql import functions as F

    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_hit", F.size("items"), decontaminate.items_digest(), F.col("n_hit") > 0).collect()), key=str)


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op5_decontaminate(spark, SF).collect()), key=str)
    assert got == brute(docs, items)
    assert 0 < sum(r[5] for r in got) < len(got)


def test_random_and_blocks(spark):
    rng = random.Random(3)
    vocabulary = ["a", "b", "Cd", "é", "x-y", "z9", "of"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.randint(0, 9))) for k in range(25)] + [(3, "a b a"), (None, "of of of of"), (7, None), (8, "...")]
    docs = [(k, text(rng.randint(0, 60))) for k in range(120)] + [(5, "a b a"), (None, "a b a"), (200, None), (201, ""), (202, "?!")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items, 4)
    assert digest(decontaminate.decontaminate(d, b, width=4)) == want
    assert digest(decontaminate.decontaminate(d, b, width=4, shard=100)) == want
    assert digest(decontaminate.decontaminate(d, b, width=4, block=200)) == want


def test_edges(spark):
    docs = spark.createDataFrame([(1, "Say: the quick brown fox jumps! End.", "keep")], "doc_id long, text string, items string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert digest(decontaminate.decontaminate(docs, none))[0][1:4] == (7, 0, 0)
    assert decontaminate.decontaminate(docs.limit(0), none).count() == 0
    item = spark.createDataFrame([(1, "The QUICK brown fox")], "item_id long, text string")
    out = decontaminate.without_benchmark(docs, item).first()
    assert out.text == "Say: jumps! End." and out["items"] == "keep"


def test_index_against_plain_search():
    rng = np.random.default_rng(5)
    for size in (3, 40):
        text = np.r_[0, rng.integers(0, size, 3000), 0]
        text[1000:1200] = text[2000:2200]
        index = fmindex.FMIndex(text, size)
        for n in (1, 2, 5):
            phrases = np.array([text[k : k + n] for k in range(1, 2900, 7) if (text[k : k + n] > 0).all()])
            low, high = index.search(phrases, np.full(len(phrases), n))
            for p, a, b in zip(phrases, low, high, strict=True):
                want = [k for k in range(len(text) - n + 1) if (text[k : k + n] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want
