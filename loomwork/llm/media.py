"""Media columns: ISO base-media containers, built and walked box by box.

A payload is stored as 8-bit samples of one track: sample tables (time to sample, sample to chunk, sizes,
chunk offsets, sync samples) describe fixed frames of the media data box. Reading walks the nested boxes
and decodes the tables; payload bytes are only sliced, never decoded.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import byte_rows, map_arrow

#: Bytes of a frame, frames of a chunk, frames from one sync frame to the next, frames a second.
FRAME, CHUNK, SYNC, RATE = 192, 64, 16, 48_000
#: Sizes and offsets from here on take 64 bits.
WIDE = 1 << 32
#: Boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}
IDENTITY = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body if len(body) + 8 < WIDE else struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(payload: bytes, unit: int = FRAME) -> bytes:
    """Filled with spaces to a positive multiple of ``unit``."""
    return payload.ljust(max(1, -(-len(payload) // unit)) * unit, b" ")


def build(payload: bytes, frame: int = FRAME, chunk: int = CHUNK, sync: int = SYNC, rate: int = RATE) -> bytes:
    """A container with one track of ``len(payload) // frame`` samples; the payload is a multiple of ``frame``."""
    samples = len(payload) // frame
    duration = samples * frame
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso2", b"mp41")
    chunks = -(-samples // chunk)
    tail = samples - (chunks - 1) * chunk
    runs = [(1, chunk, 1)] if tail == chunk else ([(1, chunk, 1)] if chunks > 1 else []) + [(chunks, tail, 1)]
    wide = len(payload) + (1 << 20) >= WIDE

    def moov(base: int) -> bytes:
        offsets = [base + k * chunk * frame for k in range(chunks)]
        table = full(b"co64", struct.pack(f">I{chunks}Q", chunks, *offsets)) if wide else full(b"stco", struct.pack(f">I{chunks}I", chunks, *offsets))
        keys = range(1, samples + 1, sync)
        entry = box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, rate << 16 & 0xFFFFFFFF))
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, samples, frame)),
            full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", frame, samples)),
            table,
        )
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdhd = full(b"mdhd", struct.pack(">QQIQHH", 0, 0, rate, duration, 0x55C4, 0), version=1)
        mdia = box(b"mdia", mdhd, full(b"hdlr", bytes(4), b"soun", bytes(12), b"text\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, duration), bytes(8), struct.pack(">hhhh", 0, 0, 256, 0), IDENTITY, bytes(8), version=1, flags=3)
        mvhd = full(b"mvhd", struct.pack(">QQIQiH", 0, 0, rate, duration, 0x10000, 256), bytes(10), IDENTITY, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    lead = 16 if len(payload) + 8 >= WIDE else 8
    base = len(head) + len(moov(0)) + lead
    return b"".join([head, moov(base), box(b"mdat", payload)])


def walk(data: bytes, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()):
    """(path, body start, body end) of every box, parents first; a damaged size ends the walk of its level."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if start + 16 > end:
                return
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        stop = end if size == 0 else start + size
        if stop < body or stop > end:
            return
        here = (*path, kind)
        yield here, body, stop
        if kind in CONTAINERS:
            yield from walk(data, body, stop, here)
        start = stop


@dataclass(frozen=True)
class Track:
    codec: str
    timescale: int
    duration: int
    offsets: np.ndarray  # of each sample, in the file
    sizes: np.ndarray
    sync: np.ndarray  # indices of the sync samples

    def keyframes(self) -> list[tuple[int, int]]:
        """Byte ranges [from, to) of the sync samples."""
        at = self.offsets[self.sync]
        return list(zip(at.tolist(), (at + self.sizes[self.sync]).tolist(), strict=True))

    def payload(self, data: bytes) -> bytes:
        """The samples in order; neighbours in the file are sliced at once."""
        if not len(self.offsets):
            return b""
        ends = self.offsets + self.sizes
        cut = np.flatnonzero(self.offsets[1:] != ends[:-1]) + 1
        first, last = np.r_[0, cut], np.r_[cut, len(ends)] - 1
        return b"".join(data[a:b] for a, b in zip(self.offsets[first].tolist(), ends[last].tolist(), strict=True))


def tracks(data: bytes) -> list[Track]:
    """The tracks of a container, from their sample tables; a track with missing or damaged tables is left out."""
    found: list[dict] = []
    for path, a, b in walk(data):
        kind = path[-1]
        if kind == b"trak":
            found.append({})
        elif found and b"trak" in path:
            found[-1].setdefault(kind, (a, b))
    out = []
    for t in found:
        try:
            out.append(_track(data, t))
        except (KeyError, struct.error, ValueError, IndexError):
            continue
    return out


def _track(data: bytes, t: dict) -> Track:
    def words(kind: bytes, skip: int, n: int, code: str = ">u4") -> np.ndarray:
        return np.frombuffer(data, code, n, t[kind][0] + skip).astype(np.int64)

    version = data[t[b"mdhd"][0]]
    timescale, duration = struct.unpack_from(">IQ" if version else ">II", data, t[b"mdhd"][0] + (20 if version else 12))
    fixed, n = struct.unpack_from(">II", data, t[b"stsz"][0] + 4)
    if fixed * n > len(data):
        raise ValueError("more samples than bytes")
    sizes = np.full(n, fixed, np.int64) if fixed else words(b"stsz", 12, n)
    wide = b"co64" in t
    kind = b"co64" if wide else b"stco"
    chunks = words(kind, 8, int(words(kind, 4, 1)[0]), ">u8" if wide else ">u4")
    runs = words(b"stsc", 8, 3 * int(words(b"stsc", 4, 1)[0])).reshape(-1, 3)
    per = np.repeat(runs[:, 1], np.diff(np.r_[runs[:, 0], len(chunks) + 1])) if len(runs) else np.empty(0, np.int64)
    if len(per) != len(chunks) or (len(per) and (per.min() < 0 or per.max() > len(data))) or per.sum() > len(data):
        raise ValueError("damaged sample to chunk table")
    of = np.repeat(np.arange(len(chunks)), per)[:n]
    if len(of) < n or (len(of) and (chunks.max() > len(data) or chunks.min() < 0)):
        raise ValueError("samples outside of the file")
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(per) - per
    offsets = chunks[of] + before - before[np.minimum(first[of], max(n - 1, 0))] if n else np.empty(0, np.int64)
    sync = words(b"stss", 8, int(words(b"stss", 4, 1)[0])) - 1 if b"stss" in t else np.arange(n)
    codec = data[t[b"stsd"][0] + 12 : t[b"stsd"][0] + 16].decode("latin-1")
    return Track(codec, timescale, duration, offsets, sizes, sync)


def describe(track: Track, media: bytes) -> str:
    """Codec, time scale, duration, samples, keyframes, and checksums of their byte ranges and of their bytes."""
    keys = track.keyframes()
    ranges = zlib.crc32(np.array(keys, "<u8").tobytes())
    frames = zlib.crc32(b"".join(media[a:b] for a, b in keys))
    return f"codec={track.codec.strip()};timescale={track.timescale};duration={track.duration};samples={len(track.sizes)};keyframes={len(keys)};first={keys[0][0]}-{keys[0][1]};last={keys[-1][0]}-{keys[-1][1]};ranges={ranges:08x};frames={frames:08x}"


SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codec string, timescale long, duration long, keyframes array<struct<start:long,stop:long>>, feature string"


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """One row per input row: the text stored as a container, read back, with its media columns.

    ``keyframes`` are byte ranges in the stored form; ``keep_media`` adds that form as ``media``. Null
    and empty texts become one frame of spaces. Equal texts give equal values. Other columns are left.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    keys = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def work(batch: pa.RecordBatch) -> dict:
        columns: dict[str, list] = {n: [] for n in [*names, "media"]}
        for text in byte_rows(batch.column(1)):
            text = text or b""
            media = build(pad(text))
            track = tracks(media)[0]
            back = track.payload(media)
            row = (len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), track.codec, track.timescale, track.duration, [{"start": a, "stop": b} for a, b in track.keyframes()], describe(track, media))
            for name, value in zip(names, row, strict=True):
                columns[name].append(value)
            columns["media"].append(media if keep_media else None)
        columns["keyframes"] = pa.array(columns["keyframes"], keys)
        return {id_col: batch.column(0)} | {k: v for k, v in columns.items() if k != "media" or keep_media}

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {SCHEMA}" + ", media binary" * keep_media
    return map_arrow(docs.select(F.col(id_col), F.col(text_col)), work, schema)
