"""Divergence of sources: how far the term frequencies of each (lang, source) group are from those of others.

Tasks count words in chunks of documents, and terms that occur equally often in a group's documents of a chunk share a row.
``CountVectorizer`` gives these rows exact sparse vectors over the terms that enough documents of their lang hold;
terms carry their lang, so that one fit holds the vocabularies of all langs. Vectors are summed by group in sparse
form, and pairs of groups are evaluated on the terms that both hold; what only one of a pair holds, or none, follows
from sums by group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import arrow_map, byte_rows, release, small, stored

#: Byte table that lower-cases A-Z and turns all ASCII characters but letters into spaces: what is left between them are the terms.
FOLD = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Between a lang and a term; no term holds it.
MARK = "\x00"
#: Terms of one fit: its vocabulary goes through the driver and to every task. More are fitted in blocks dealt by their hash.
BLOCK_TERMS = 1 << 20
#: One part in so many of all terms is counted to tell how many blocks there must be.
SHARE = 16
#: As many terms as a fit can hold.
MOST_TERMS = (1 << 31) - 1
#: What a probability is multiplied by, and what is added to a count.
UNITS, PRIOR = 1_000_000_000, 5
#: Text of the documents that are counted together; a task holds about eleven times as much meanwhile (180 MB for 17 MB of the check tool's texts).
CHUNK_BYTES = 1 << 24
#: A row of ``counted_terms``.
_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("times", pa.int64()), ("terms", pa.list_(pa.string())), ("held", pa.list_(pa.string()))])


def _alike(keys: np.ndarray, number: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys (owner times ``width`` plus word) in rows of one owner and number: owners, numbers, where each row starts (and the last ends), words."""
    owner, word = np.divmod(keys, width)
    order = np.lexsort((number, owner))
    owner, number, word = owner[order], number[order], word[order]
    first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (number[1:] != number[:-1])][: len(owner)])
    return owner[first], number[first], np.r_[first, len(owner)], word


def _counted(langs: pa.Array, sources: pa.Array, texts: pa.Array, least_docs: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``counted_terms`` of a chunk; texts are folded."""
    lang, source = langs.dictionary_encode(), sources.dictionary_encode()
    groups, group = np.unique(lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy(), return_inverse=True)
    lists = pc.ascii_split_whitespace(texts)
    doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    words = lists.flatten().dictionary_encode()
    names, word = words.dictionary, words.indices.to_numpy()
    some = word != names.index("").as_py()  # spaces at the ends of a text have an empty word beside them
    doc, word, width = doc[some], word[some], max(1, len(names))

    def batch(own: np.ndarray, sources: pa.Array, times: np.ndarray, edges: np.ndarray, word: np.ndarray, held: bool) -> pa.RecordBatch:
        tags = lang.dictionary.take(pa.array(own))
        tagged = pc.binary_join_element_wise(tags.take(pa.array(np.repeat(np.arange(len(own)), np.diff(edges)))), names.take(pa.array(word)), MARK)
        lists, none = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), tagged), pa.nulls(len(own), pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([tags, sources, pa.array(times, pa.int64()), *((none, lists) if held else (lists, none))], schema=_COUNTED)

    own, times, edges, each = _alike(*np.unique(group[doc] * width + word, return_counts=True), width)
    bare = np.setdiff1d(np.arange(len(groups)), own)
    at = groups[np.r_[own, bare]]
    yield batch(at // len(source.dictionary), source.dictionary.take(pa.array(at % len(source.dictionary))), np.r_[times, np.zeros_like(bare)], np.r_[edges, np.full(len(bare), edges[-1])], each, False)
    pairs, _ = np.unique(doc * width + word, return_counts=True)  # return_counts: by sorting, which is faster here
    doc, word = np.divmod(pairs, width)
    terms, docs = np.unique(lang.indices.to_numpy()[doc] * np.int64(width) + word, return_counts=True)
    own, times, edges, each = _alike(terms, np.minimum(docs, least_docs), width)
    yield batch(own, pa.nulls(len(own), pa.string()), times, edges, each, True)


def counted_terms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 30, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(lang, source, times, terms, held) of chunks of documents; each term follows its lang. Nulls are empty texts.

    ``terms``: what occurs so many times in the group's documents of a chunk; every group has a row, if only an empty one.
    ``held``, without a source: what so many of a lang's documents of a chunk hold. ``least_docs`` stands for as many
    and more: these alone keep a term, whatever other chunks hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def whole() -> Iterator[pa.RecordBatch]:
            return _counted(*(pa.concat_arrays(column) for column in zip(*parts, strict=True)), least_docs)

        for batch in batches:
            if batch.num_rows:
                texts = pa.array([text.translate(FOLD) for text in byte_rows(batch.column("t"))], pa.binary()).cast(pa.string())
                parts.append((batch.column("lang"), batch.column("source"), texts))
                size += texts.nbytes
            if size >= chunk_bytes:
                yield from whole()
                parts, size = [], 0
        if parts:
            yield from whole()

    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "t"))))
    return arrow_map(rows, run, "lang string, source string, times long, terms array<string>, held array<string>")


def blocks_for(rows: DataFrame, least_docs: int, block_terms: int) -> int:
    """Blocks that hold ``block_terms`` kept terms each, about; from the count of those in a part of all hashes that enough documents hold."""
    every = F.explode("held").alias("t")
    some = rows.select(every, "times").where(F.pmod(F.xxhash64("t", F.lit(1)), F.lit(SHARE)) == 0).groupBy("t").agg(F.sum("times").alias("docs"))
    return max(1, -(-SHARE * some.where(F.col("docs") >= least_docs).count() // block_terms))


def group_counts(rows: DataFrame, least_docs: int = 30, block_terms: int = BLOCK_TERMS) -> tuple[DataFrame, DataFrame]:
    """(lang, source, id, count) of the kept terms that a group holds, and their (id, term)."""
    spark = rows.sparkSession
    blocks = blocks_for(rows, least_docs, block_terms)
    counts = names = None
    for block in range(blocks):
        own = rows
        for name in ("terms", "held") if blocks > 1 else ():
            own = own.withColumn(name, F.filter(name, lambda t: F.pmod(F.xxhash64(t), F.lit(blocks)) == block))  # noqa: B023
        # a row for each of the documents that hold the terms, or for ``least_docs`` of them
        held = own.where("held is not null").select(F.col("held").alias("terms"), F.explode(F.sequence(F.lit(1).cast("long"), "times")))
        model = CountVectorizer(inputCol="terms", outputCol="features", minDF=float(least_docs), vocabSize=MOST_TERMS).fit(held)
        if not model.vocabulary:
            continue
        vectors = model.transform(own.where("terms is not null")).select("lang", "source", "times", F.unwrap_udt("features").alias("features"))
        each = vectors.select("lang", "source", "times", F.explode(F.arrays_zip("features.indices", "features.values")).alias("x"))
        number = F.shiftleft(F.lit(block).cast("long"), 32) + F.col("x.indices")
        found = stored(each.groupBy("lang", "source", number.alias("id")).agg(F.sum(F.col("times") * F.col("x.values").cast("long")).alias("count")), "counts")
        words = pa.table({"id": pa.array(range(block << 32, (block << 32) + len(model.vocabulary)), pa.int64()), "tagged": pa.array(model.vocabulary, pa.string())})
        known = stored(spark.createDataFrame(words).select("id", F.substring_index("tagged", MARK, -1).alias("term")), "terms")
        counts, names = (found, known) if counts is None else (counts.unionByName(found), names.unionByName(known))
    if counts is None:
        return spark.createDataFrame([], "lang string, source string, id long, count long"), spark.createDataFrame([], "id long, term string")
    return counts, names


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNITS * (count + PRIOR) / (total + PRIOR * terms)), exact."""
    parts = (F.lit(UNITS).cast("decimal(38,0)") * (count + PRIOR).cast("decimal(20,0)")).cast("decimal(38,0)")
    whole = (total + PRIOR * terms).cast("decimal(20,0)")
    return F.when(terms > 0, (1 + F.call_function("div", parts, whole)).cast("long")).otherwise(F.lit(0).cast("long"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 30, top: int = 50, block_terms: int = BLOCK_TERMS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank`` of every (lang, source) group.

    Part ``pair`` has a row for each other source of the lang: the sum of the absolute differences of both groups' shares over all
    kept terms, 0 if there are none. Part ``term`` has the ``top`` terms that the group holds and whose share there is above
    the lang's. Ranks go by value, largest first, then by item in UTF-8 order. Null texts, langs and sources are empty ones;
    repeated rows count each; groups without kept terms have pairs and no terms; an empty table gives an empty result. Other
    columns are not looked at.
    """
    rows = stored(counted_terms(docs, text_col, lang_col, source_col, least_docs, chunk_bytes), "counted")
    groups = rows.where("source is not null").select("lang", "source").distinct()
    counts, names = group_counts(rows, least_docs, block_terms)

    of_lang = stored(counts.groupBy("lang", "id").agg(F.sum("count").alias("held")), "langs")
    langs = of_lang.groupBy("lang").agg(F.sum("held").alias("lang_total"), F.count(F.lit(1)).alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("own"))
    known = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "own", "terms", "lang_total"])
    known = stored(known.withColumn("base", share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))), "groups")
    shares = counts.join(small(known), ["lang", "source"]).select("lang", "source", "id", share(F.col("count"), F.col("total"), F.col("terms")).alias("p"), "base", "terms", "lang_total")
    shares = stored(shares, "shares")
    release(rows)

    a, b = (lambda df, s: df.select("lang", *(F.col(c).alias(f"{c}_{s}") for c in df.columns if c != "lang"))), F.abs
    side = known.select("lang", "source", "own", "base", "terms")
    # what one group holds, against the base of each other one: by values of the share, of which there are few
    values = shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m"))
    alone = a(values, "a").join(a(side.select("lang", "source", "base"), "b"), "lang").where("source_a <> source_b")
    alone = alone.groupBy("lang", "source_a", "source_b").agg(F.sum(F.col("m_a") * b(F.col("p_a") - F.col("base_b"))).alias("alone"))
    alone = stored(alone, "alone")
    held = shares.select("lang", "id", "source", "p", "base")
    left, right = (held.select("lang", "id", *(F.col(c).alias(f"{c}_{s}") for c in ("source", "p", "base"))) for s in "ab")
    both = left.join(right, ["lang", "id"]).where("source_a < source_b").groupBy("lang", "source_a", "source_b").agg(
        F.sum(b(F.col("p_a") - F.col("p_b")) - b(F.col("p_a") - F.col("base_b")) - b(F.col("base_a") - F.col("p_b"))).alias("shift"), F.count(F.lit(1)).alias("shared")
    )
    both = stored(both, "both")
    pairs = a(side, "a").join(a(side, "b"), "lang").where("source_a < source_b")
    pairs = pairs.join(both, ["lang", "source_a", "source_b"], "left").join(alone.withColumnRenamed("alone", "alone_a"), ["lang", "source_a", "source_b"], "left")
    pairs = pairs.join(alone.select("lang", F.col("source_a").alias("source_b"), F.col("source_b").alias("source_a"), F.col("alone").alias("alone_b")), ["lang", "source_a", "source_b"], "left")
    pairs = pairs.fillna(0, ["shift", "shared", "alone_a", "alone_b"])
    neither = F.col("terms_a") - F.col("own_a") - F.col("own_b") + F.col("shared")
    value = F.col("alone_a") + F.col("alone_b") + F.col("shift") + neither * b(F.col("base_a") - F.col("base_b"))
    pairs = stored(pairs.select("lang", "source_a", "source_b", value.alias("value")), "pairs")
    every = pairs.select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), "value").unionByName(pairs.select("lang", F.col("source_b").alias("source"), F.col("source_a").alias("item"), "value"))

    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    ranked = every.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    over = shares.join(of_lang, ["lang", "id"]).withColumn("value", F.col("p") - share(F.col("held"), F.col("lang_total"), F.col("terms"))).where("value > 0")
    over = over.select("lang", "source", "id", "value").join(small(names), "id").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    best = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.unionByName(best)
