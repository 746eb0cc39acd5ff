import zlib
from itertools import pairwise

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomwork.llm import packing, queries

SF = "/root/testdata/sf0.01"
LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(docs, pieces, size=2048, most=0.03):
    """Pieces against the ids of the tokenizer's own library."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    of, sequences = {}, {}
    for p in pieces:
        of.setdefault(p.doc_id, []).append(p)
        sequences.setdefault(p.sequence_id, []).append(p)
    assert set(of) == {d for d, _ in docs}
    for d, text in docs:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for p in sorted(of[d], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids)) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    total = padding = 0
    for parts in sequences.values():
        parts.sort(key=lambda p: p.offset)
        assert parts[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in pairwise(parts))
        n = parts[-1].offset + parts[-1].length
        assert n <= size
        total, padding = total + n, padding + (0 if n & (n - 1) == 0 else size - n)
    assert padding <= most * total


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(docs, queries.op7_packing(spark, SF).collect())


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "a<|endoftext|>b  c \n d"), (4, "x" * 9000), (5, "no stop " * 3000), (6, "    é\r\n\t"), (7, "One. Two! Three?\n" * 500)]
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, start int").coalesce(1)
    check(docs, packing.pack(df).collect(), most=0.2)
    assert packing.pack(df.limit(0)).count() == 0
    kept = packing.pack(df, keep_ids=True).collect()
    assert all(len(r.ids) == r.length for r in kept)


_PIECES = st.one_of(st.text(max_size=30), st.sampled_from(["\u3000\u2003 ", "\r\n\r\n", "\t \t", "don't I'LL we've", "1234567890 3.14", "\u0e01\u0e33", "\u4f60\u597d", "\U0001f469\u200d\U0001f4bb", "e\u0301", "\u0130\u017f", "\x00\x7f\x85", "<|endoftext|>"]), st.builds(lambda c, n: c * n, st.characters(exclude_categories=["Cs"]), st.integers(1, 80)))


@settings(max_examples=150, deadline=None)
@given(st.lists(_PIECES, max_size=8).map("".join))
def test_ids_are_those_of_the_library(text):
    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert encode.ids(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "c"), (1, "d"), (1, "d")], "doc_id long, text string")
    rows = packing.pack(df).collect()
    assert sorted(str(r.doc_id) for r in rows if r.start == 0) == ["1", "1", "None", "None"]


def test_plan_is_least():
    rng = np.random.default_rng(2)
    for _ in range(30):
        positions = np.cumsum(np.r_[0, rng.integers(1, 6, 12)])
        penalties = rng.integers(0, 5, 13).astype(float)
        size = 9
        best = {0: 0.0}
        for j in range(1, 13):
            best[j] = min(best[i] + size - (positions[j] - positions[i]) + penalties[j] for i in range(j) if positions[j] - positions[i] <= size)
        cuts = packing.plan(positions.tolist(), penalties.tolist(), size)
        assert cuts[0] == 0 and cuts[-1] == 12
        assert sum(size - (positions[b] - positions[a]) + penalties[b] for a, b in pairwise(cuts)) == best[12]
