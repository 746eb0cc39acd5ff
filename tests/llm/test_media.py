import hashlib
import struct
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwork.llm import media, queries

SF = "/root/testdata/sf0.01"


def plain_payload(data):
    """The bytes of the media data box, found without the module's own reader."""
    at = 0
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"mdat":
            return data[at + 8 : at + size]
        at += size
    raise AssertionError


def test_whole_table(spark):
    texts = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op6_media(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        payload = texts[r.doc_id] + b" " * (-len(texts[r.doc_id]) % 192)
        assert (r.n_bytes, r.payload_bytes) == (len(texts[r.doc_id]), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        stored = media.build(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert plain_payload(stored) == payload


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.sampled_from([1, 7, 192]), st.sampled_from([1, 3, 64]), st.sampled_from([1, 2, 16]))
def test_round_trip(data, frame, chunk, sync):
    payload = media.pad(data, frame)
    stored = media.build(payload, frame, chunk, sync)
    (track,) = media.tracks(stored)
    assert track.payload(stored) == payload and track.codec == "raw " and track.duration == len(payload)
    assert len(track.sizes) == len(payload) // frame
    for k, (a, b) in zip(track.sync.tolist(), track.keyframes(), strict=True):
        assert stored[a:b] == payload[k * frame : (k + 1) * frame] and k % sync == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=900), st.integers(0, 2000), st.binary(max_size=6))
def test_damage_never_raises(data, at, noise):
    stored = bytearray(media.build(media.pad(data)))
    at %= len(stored)
    stored[at : at + len(noise)] = noise
    for track in media.tracks(bytes(stored[: at + 400])):
        assert isinstance(track.sizes, np.ndarray)


def test_wide_boxes(monkeypatch):
    monkeypatch.setattr(media, "WIDE", 64)
    payload = media.pad(bytes(range(256)) * 200)
    stored = media.build(payload)
    kinds = {p[-1] for p, _, _ in media.walk(stored)}
    assert b"co64" in kinds and b"stco" not in kinds
    (track,) = media.tracks(stored)
    assert track.payload(stored) == payload
    assert all(stored[a:b] == payload[k * 192 : (k + 1) * 192] for k, (a, b) in zip(track.sync.tolist(), track.keyframes(), strict=True))


def test_feature_knows_the_content(spark):
    rows = media.store_media(spark.createDataFrame([(1, "abc"), (2, "xyz"), (3, "abc")], "doc_id long, text string")).collect()
    by = {r.doc_id: r.feature for r in rows}
    assert by[1] == by[3] != by[2]


def test_nested_paths():
    stored = media.build(b" " * 192)
    paths = [p for p, _, _ in media.walk(stored)]
    assert (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"stsz") in paths and paths[-1] == (b"mdat",)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "é" * 200, "z"), (2, "", "y")], "doc_id long, text string, feature string")
    rows = media.store_media(docs, keep_media=True).collect()
    assert len(rows) == 4 and sorted(r.payload_bytes for r in rows) == [192, 192, 192, 576]
    empty = {(r.media_sha256, r.feature) for r in rows if r.n_bytes == 0}
    assert len(empty) == 1
    assert all(hashlib.sha256(bytes(r.media)).hexdigest() == r.media_sha256 for r in rows)
    assert media.store_media(docs.limit(0)).count() == 0
