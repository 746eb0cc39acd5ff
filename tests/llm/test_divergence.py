import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import functions as F

from loomwork.llm import divergence


def plain(docs, least_docs, top):
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counts, df = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in docs:
        counts[lang or "", source or ""].update(words(text))
        df[lang or ""].update(set(words(text)))
    out = []
    for (lang, source), count in counts.items():
        kept = [t for t, n in df[lang].items() if n >= least_docs]

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = shares(count)
        q = shares(sum((c for (x, _), c in counts.items() if x == lang), Counter()))
        others = {s: shares(c) for (x, s), c in counts.items() if x == lang and s != source}
        parts = {"pair": [(sum(abs(p[t] - o[t]) for t in kept), s) for s, o in others.items()], "term": [(p[t] - q[t], t) for t in kept if count[t] and p[t] > q[t]]}
        for part, rows in parts.items():
            ranked = sorted(rows, key=lambda r: (-r[0], r[1].encode()))
            out += [(lang, source, part, item, value, rank) for rank, (value, item) in enumerate(ranked, 1) if part == "pair" or rank <= top]
    return sorted(out)


@pytest.mark.parametrize("block_terms", [divergence.BLOCK_TERMS, 7])
def test_against_plain_counts(spark, block_terms):
    rng = np.random.default_rng(8)
    vocabulary = [f"{a}{b}" for a in "abcéß" for b in "xyz"]
    docs = []
    for k in range(300):
        lang, source = ["en", "de", None, "a\x00b", "rare"][min(4, k % 5 if k < 290 else 4)], ["s1", "s2", None, "s4"][rng.integers(0, 4)]
        own = rng.choice(vocabulary, rng.integers(0, 20), p=rng.dirichlet(np.ones(len(vocabulary)) * 0.4))
        docs.append((lang, source, " ".join(own).upper() if k % 7 == 0 else "-".join(own)))
    docs += [("en", "empty", None), ("en", "blank", "12 !!"), ("xx", "one", "word"), ("xx", "two", "word"), ("en", "s1", docs[0][2]), ("en", "s1", docs[0][2])]
    df = spark.createDataFrame([(*d, 1, "t") for d in docs], "lang string, source string, text string, value int, terms string").repartition(5)
    got = divergence.audit(df, least_docs=8, top=6, block_terms=block_terms)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain(docs, 8, 6)


def test_no_kept_terms_and_empty_table(spark):
    df = spark.createDataFrame([("en", "b", "x y"), ("en", "a", None), (None, None, None)], "lang string, source string, text string")
    assert sorted(map(tuple, divergence.audit(df).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert divergence.audit(df.limit(0)).count() == 0


@pytest.mark.parametrize("chunk_bytes", [1, 500, divergence.CHUNK_BYTES])
def test_chunks_do_not_change_counts(spark, chunk_bytes):
    rng = np.random.default_rng(9)
    docs = [(["en", "de", None][k % 3], ["s1", "s2", None][rng.integers(0, 3)], " ".join(rng.choice([f"{a}é{b}" for a in "abc" for b in "wxyz"], rng.integers(0, 6)))) for k in range(200)]
    docs += [("en", "no words", "12 !!"), ("fr", "x", None), ("fr", "y", " a  a "), ("en", "long", "longer " * 300), *[("de", "s1", f"often {k}") for k in range(8)], *[("de", "s2", "rare") for _ in range(7)]]
    df = spark.createDataFrame(docs, "lang string, source string, text string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        assert sorted(map(tuple, divergence.audit(df, least_docs=8, top=4, chunk_bytes=chunk_bytes).collect())) == plain(docs, 8, 4)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repeats_are_counted_before_the_vectoriser(spark, monkeypatch):
    """Ten times as many documents over the same words: it is given no more terms, by either of its steps."""
    given = []

    def seen(df):
        given.append(df.select(F.sum(F.size("terms"))).first()[0])
        return df

    class Spy:
        def __init__(self, **params):
            self.own = CountVectorizer(**params)

        def fit(self, df):
            model = self.own.fit(seen(df))
            transform = model.transform
            model.transform = lambda rows: transform(seen(rows))
            return model

    monkeypatch.setattr(divergence, "CountVectorizer", Spy)
    for repeats in (1, 10):
        docs = [("en", f"s{k % 2}", "one two two three " + "four " * (k % 4)) for k in range(40)] * repeats
        df = spark.createDataFrame(docs, "lang string, source string, text string").coalesce(1)
        assert sorted(map(tuple, divergence.audit(df, least_docs=8).collect())) == plain(docs, 8, 50)
    assert len(given) == 4 and given[:2] == given[2:]
