import numpy as np
from pyspark.sql import functions as F

from loomwork.llm import quality, queries

SF = "/root/testdata/sf0.1"


def test_labels_agree(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = queries.op2_quality(spark, SF).join(labels, "doc_id").collect()
    good, bad = [r.selected for r in rows if r.quality == 1], [r.selected for r in rows if r.quality == 0]
    assert sum(good) >= 0.999 * len(good) and sum(bad) <= 0.03 * len(bad)


def test_weights_against_plain_counts(spark):
    docs = spark.createDataFrame([(1, "good words, good"), (2, "bad !! bad !! bad"), (3, "good words"), (4, None), (5, ""), *((k, f"good w{k}") for k in range(6, 14))], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), *((k, 1) for k in range(6, 14))], "doc_id long, quality int")
    model = quality.train(docs, labels)
    fit = {r[0] for r in labels.where("quality = 1").where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)) == 0).collect()}
    assert 0 < len(fit) < 9
    grams = {r.doc_id: quality.buckets([(r.text or "").encode()])[1] for r in docs.collect()}
    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for d, found in grams.items():
        np.add.at(raw, found, 1)
        if d in fit:
            np.add.at(target, found, 1)
    ratio = np.log((target + quality.ADDED) / (raw / raw.sum() * target.sum() + quality.ADDED))
    for r in quality.resample(docs, labels, noise=0.0).collect():
        assert np.isclose(r.log_weight, ratio[grams[r.doc_id]].sum()) and r.n_grams == len(grams[r.doc_id])
        assert r.selected == (r.log_weight >= model.cut)


def test_top_cut_is_exact(spark):
    rng = np.random.default_rng(6)
    values = np.r_[rng.normal(0, 100, 3000), np.full(50, 7.0)]
    keys = spark.createDataFrame([(float(v),) for v in values], "key double")
    for k in (1, 10, 1500, 3049):
        cut = quality.top_cut(keys, k, few=100, bins=8)
        least = np.sort(values)[::-1][k - 1]
        assert (values >= cut).sum() == (values >= least).sum()
    assert quality.top_cut(keys, 0) == np.inf and quality.top_cut(keys, 5000) == -np.inf


def test_gumbel_follows_weights(spark):
    noise = np.array([r[0] for r in spark.range(20000).select(quality.gumbel("id", 3)).collect()])
    assert abs(noise.mean() - np.euler_gamma) < 0.05 and abs(noise.var() - np.pi**2 / 6) < 0.1


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (None, "x", 2.0), (1, None, 1.0)], "doc_id long, text string, key double")
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    assert [r.selected for r in quality.resample(docs, none).collect()] == [True] * 3
    kept = quality.selected_rows(docs, none)
    assert kept.columns == docs.columns and kept.count() == 3
    assert quality.resample(docs.where(F.lit(False)), none).count() == 0


def test_equal_rows_weigh_the_same_in_any_batch(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abcdefgh"), rng.integers(0, 400))).encode() for _ in range(300)] + [None, b""]
    texts += texts[:20] * 3
    ratio = rng.normal(size=quality.BUCKETS)
    _, together = quality.weigh(texts, ratio)
    assert together.tolist() == [quality.weigh([t], ratio)[1][0] for t in texts]
    docs = spark.createDataFrame([(k % 40, (t or b"").decode()) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    found = []
    for size in ("1048576b", "65536b"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
        found.append(sorted(map(tuple, quality.keyed(docs, quality.Model(ratio, 0.0)).collect())))
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    assert found[0] == found[1]


def test_ties_at_the_cut_are_counted(spark):
    keys = spark.range(50_000).selectExpr("if(id < 20000, 2.0D, if(id < 49990, 1.0D, 0.0D)) as key")
    assert 0.0 < quality.top_cut(keys, 30_000, few=100, bins=8) <= 1.0
    assert 1.0 < quality.top_cut(keys, 20_000, few=10) <= 2.0
