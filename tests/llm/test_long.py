"""Very long texts and single words, through every operator."""

import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from loomwork.llm import decontaminate, hmm, language, media, packing, quality, simhash, substring, toxicity, warc

RNG = random.Random(3)
MANY = " ".join(f"w{RNG.randint(0, 3000)}" for _ in range(1_000_000))
TEXTS = {1: MANY, 2: "x" * 1_000_000, 3: "a " * 300_000, 4: "", 5: None, 6: " ".join(MANY.split()[500:700])}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "en", 0) for d, t in TEXTS.items()], "doc_id long, text string, lang string, score int").repartition(2)


def test_simhash(docs):
    rows = {r.doc_id: r.component_id for r in simhash.near_duplicate_components(docs).collect()}
    assert len(rows) == 6 and rows[5] == 4
    assert {r.doc_id for r in simhash.one_of_each(docs).collect()} == {1, 2, 3, 4, 6}


def test_quality(spark, docs):
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    assert quality.resample(docs, labels).where("n_grams = 2000000").count() == 1


def test_substring(docs):
    rows = {r.doc_id: r for r in substring.substring_dedup(docs).collect()}
    assert rows[1].n_words == 1_000_000 and rows[1].n_removed == 0
    assert (rows[6].n_words, rows[6].n_removed) == (200, 200) and rows[6].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[2].n_words == 1


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(4, 0), (6, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, model).collect())


def test_decontaminate(spark, docs):
    item = spark.createDataFrame([(9, " ".join(MANY.split()[800_000:800_015]))], "item_id long, text string")
    rows = {r.doc_id: r for r in decontaminate.decontaminate(docs, item).collect()}
    assert rows[1].n_hit == 15 and [tuple(s) for s in rows[1].spans] == [(800_000, 800_015)] and rows[3].n_hit == 0


def test_media(docs):
    rows = {r.doc_id: r for r in media.store_media(docs).collect()}
    payload = TEXTS[2].encode().ljust(-(-1_000_000 // 192) * 192)
    assert rows[2].payload_sha256 == hashlib.sha256(payload).hexdigest() and rows[2].tail_crc32 == zlib.crc32(payload[-16:])


def test_packing(docs):
    rows = packing.pack(docs).collect()
    for d in TEXTS:
        pieces = sorted((r.start, r.length) for r in rows if r.doc_id == d)
        assert sum(n for _, n in pieces) == next(r.doc_tokens for r in rows if r.doc_id == d)
        assert all(n <= 2048 for _, n in pieces) and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:], strict=False))


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>" + MANY), (2, "http://b/", "<" * 1_000_000)], "page_id long, url string, html string")
    texts = {r.page_id: warc.parse(bytes(r.record))[1].decode() for r in warc.derivatives(warc.responses(pages)).where("warc_type = 'conversion'").collect()}
    assert texts[1] == MANY and texts[2] == "<" * 1_000_000


def test_language(docs):
    model = language.train(docs, F.lit(True))
    assert {r.doc_id: r.lang_pred for r in language.identify(docs, model).collect()} == {1: "en", 2: "en", 3: "en", 4: "und", 5: "und", 6: "en"}


def test_hmm(docs):
    model = hmm.train(docs, F.lit(True), sample=2, warm=1, rounds=1)
    rows = {r.doc_id: r for r in hmm.score(docs, model, F.lit(True), blocks=3).collect()}
    assert rows[1].n_tokens == 1_000_001 and rows[2].n_tokens == 2 and rows[5].n_tokens == 1
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows.values())
