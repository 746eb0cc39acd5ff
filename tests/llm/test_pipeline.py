import hashlib

import corpus_pipeline
from loomwork.llm import decontaminate, quality, simhash

SF = "/root/testdata/sf0.01"


def test_stages_one_by_one(spark):
    """Every stage against plain Python on its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "substrings", "benchmark", "packing"]
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}

    one = stage["quality"](spark, docs, SF).cache()
    assert one.columns == columns
    before, kept = rows(docs), rows(one)
    good = [d for d in before if labels.get(d) == 1]
    assert sum(d in kept for d in good) >= 0.98 * len(good)
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    n, w = quality.weigh([before[d].encode() for d in sorted(before)], model.ratio)
    assert len(kept) == sum(w >= model.cut)

    two = stage["near_duplicates"](spark, one, SF).cache()
    left = rows(two)
    assert two.columns == columns and set(left) <= set(kept)
    sets = {d: simhash.shingle_set(t.encode(), 5) for d, t in kept.items()}
    texts = {}
    for d in sorted(kept):
        texts.setdefault(kept[d], d)
    assert all(d in texts.values() for d in left)  # of equal texts the first stays
    near = lambda d: [e for e in kept if simhash.similarity(sets[d], sets[e]) >= 0.8]
    for d in set(kept) - set(left):  # it and a smaller one that stays are like the same centre
        assert any(e in left and e < d for c in near(d) for e in near(c))

    three = stage["substrings"](spark, two, SF).cache()
    cut = rows(three)
    first = {}
    for d in sorted(left):
        ws = left[d].split()
        for k in range(len(ws) - 49):
            first.setdefault(tuple(ws[k : k + 50]), d)
    for d, t in left.items():
        ws, gone = t.encode().split(), set()
        plain = left[d].split()
        if len(plain) != len(ws):
            continue
        for k in range(len(plain) - 49):
            if first[tuple(plain[k : k + 50])] < d:
                gone |= set(range(k, k + 50))
        want = [w for k, w in enumerate(ws) if k not in gone]
        assert cut.get(d, "").encode().split() == want

    four = stage["benchmark"](spark, three, SF).cache()
    clean = rows(four)
    items = [(str(r.item_id), r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    phrases = decontaminate.Phrases.of(items, 10)
    ids = sorted(cut)
    found = decontaminate.scan_shard([cut[d].encode() for d in ids], phrases)
    assert found.n_hit.sum() > 0
    for d, n_words, n_hit in zip(ids, found.n_words, found.n_hit, strict=True):
        assert len(decontaminate.words(clean[d].encode())) == n_words - n_hit
        if not n_hit:
            assert clean[d] == cut[d]

    pieces = stage["packing"](spark, four, SF).collect()
    assert {p.doc_id for p in pieces} == set(clean)


def test_run_repeats(spark):
    digest = lambda df: hashlib.sha256(repr(sorted(tuple(r) for r in df.select("doc_id", "start", "length", "ids_crc32").collect())).encode()).hexdigest()
    assert digest(corpus_pipeline.run(spark, SF)) == digest(corpus_pipeline.run(spark, SF))


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows, ties, an empty table, and columns whose names the stages use themselves."""
    text = " ".join(f"word{k}" for k in range(120))
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text, None, None, None), (None, text, None, None, None), (None, None, None, None, None), (3, None, "de", "b", 2), (4, "", "de", "b", 3), (5, "  ", None, "b", 3), (6, "only three words", "en", "a", 5)]
    fields = "doc_id long, text string, lang string, source string, n_chars long"
    clash = {"d": 1, "t": "x", "k": 2, "m1": 3, "m2": 4, "fp": 5, "c": 6, "label": 7, "i": 8, "w": 9, "found": 10, "starts": 11, "tk": 12, "h": 13, "key": 14, "items": 15, "spans": 16, "score": 17}
    spark.createDataFrame([(1, 1), (None, 0), (6, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "three words here"), (2, "only three words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    from pyspark.sql import functions as F

    full = spark.createDataFrame(rows, fields).withColumns({n: F.lit(v) for n, v in clash.items()})
    for docs in (full, full.limit(0)):
        docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
        for name, run in corpus_pipeline.STAGES:
            columns, out = docs.columns, run(spark, docs, str(tmp_path))
            out.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
            assert name == "packing" or docs.columns == columns
            if name == "near_duplicates" and full.count():
                assert docs.where(f"doc_id is not null and text = '{text}'").count() <= 1 and docs.where("doc_id is null").count() == out.where("doc_id is null").count()
    assert docs.count() == 0
