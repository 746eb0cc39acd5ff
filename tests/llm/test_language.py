import math
import random

import numpy as np
from pyspark.sql import functions as F

from loomwork.llm import language, queries

SF = "/root/testdata/sf0.1"


def test_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = queries.op9_language(spark, SF).join(docs, "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixture(spark):
    texts = [("en", "the cat sat on the mat with the other cat and then they went home " * 3), ("xx", "zorp qui vax tulo brin kesh podu wix garl " * 3)]
    docs = spark.createDataFrame([(k, l, t) for k, (l, t) in enumerate(texts * 5)], "doc_id long, lang string, text string")
    model = language.train(docs, F.lit(True))
    assert model.languages == ["en", "xx"] and np.allclose(model.table.sum(axis=0), 1)
    both = texts[0][1] + texts[1][1]
    share = language.infer([both.encode(), texts[0][1].encode(), b"", b"12 34"], model)
    assert (share[0] > 0.2).all() and abs(share[0].sum() - 1) < 1e-9
    assert share[1].tolist() == [1.0, 0.0] and not share[2:].any()


def plain_best(grams, model, penalty):
    """The best penalised nested set of languages of a list of trigrams, by EM over dicts."""

    def em(mix, rounds):
        for _ in range(rounds):
            new = dict.fromkeys(mix, 0.0)
            for g in grams:
                total = sum(model.table[g, k] * m for k, m in mix.items())
                for k, m in mix.items():
                    new[k] += model.table[g, k] * m / total
            mix = {k: v / len(grams) for k, v in new.items()}
        return mix, sum(math.log(sum(model.table[g, k] * m for k, m in mix.items())) for g in grams)

    n = len(model.languages)
    full, _ = em({k: 1 / n for k in range(n)}, language.ROUNDS)
    order = sorted(full, key=lambda k: -full[k])
    best = max(({k: 1.0} for k in range(n)), key=lambda m: em(m, 0)[1])
    value = em(best, 0)[1]
    for size in range(2, n + 1):
        if full[order[size - 1]] <= 0.01:
            break
        start = {k: max(full[k], 1e-6) for k in order[:size]}
        mix, new = em({k: v / sum(start.values()) for k, v in start.items()}, language.ROUNDS // 2)
        new -= (size - 1) * penalty * 0.5 * math.log(len(grams))
        if new <= value:
            break
        best, value = mix, new
    return [best.get(k, 0.0) for k in range(n)]


def test_inference_against_plain_python():
    rng = random.Random(5)
    letters = {"aa": "abcdef", "bb": "defghi", "cc": "ghijkl"}
    make = lambda k, n: " ".join("".join(rng.choice(letters[k]) for _ in range(rng.randint(2, 6))) for _ in range(n))
    counts = {k: np.bincount(language.trigrams([make(k, 400).encode()])[1], minlength=language.BUCKETS) for k in letters}
    table = np.stack([counts[k] + 0.01 for k in letters], axis=1).astype(float)
    model = language.Model(list(letters), table / table.sum(axis=0))
    texts = [make("aa", 30), make("bb", 5), make("aa", 40) + " " + make("cc", 25), make("cc", 2), make("aa", 30) + " " + make("bb", 30) + " " + make("cc", 30), "d"]
    for penalty in (0.5, 4.0):
        got = language.infer([t.encode() for t in texts], model, penalty)
        for row, t in zip(got, texts, strict=True):
            grams = language.trigrams([t.encode()])[1].tolist()
            assert np.allclose(row, plain_best(grams, model, penalty), atol=1e-9)


def test_ties_take_the_first_name(spark):
    table = np.full((language.BUCKETS, 2), 1 / language.BUCKETS)
    model = language.Model(["aa", "bb"], table)
    got = language.identify(spark.createDataFrame([(1, "some text")], "doc_id long, text string"), model).first()
    assert (got.lang_pred, got.score) == ("aa", 1.0)


def test_edges(spark):
    rows = [(1, "en", "some words here"), (2, None, "words"), (3, "de", None), (4, "de", "12 .. \n"), (5, "de", ""), (None, "en", "É")]
    docs = spark.createDataFrame(rows, "doc_id long, lang_pred string, text string").withColumn("lang", F.col("lang_pred"))
    model = language.train(docs, F.lit(True))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, model).collect()}
    assert got[3] == got[4] == got[5] == ("und", 0.0)
    assert got[1][0] == "en" and got[None][0] in ("en", "de")
    none = language.train(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}
    assert language.identify(docs.limit(0), none).count() == 0
