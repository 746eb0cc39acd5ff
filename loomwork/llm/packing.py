"""Order-preserving packing of token sequences by dynamic programming.

Documents of a partition follow each other in input order. Cuts are chosen among document ends, sentence
ends and, where a sentence is long, fixed steps inside it. The cost of a window is its padding plus the
penalty of its cut. With positions ``p`` the least cost is ``penalty(j) + size - p(j) + min(cost(i) + p(i))``
over cuts ``i`` at most ``size`` tokens back, so a monotone queue finds every minimum in constant time.
"""

from __future__ import annotations

import base64
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomwork.llm.common import arrow_map

#: Tokens of a sequence, id put behind each document, cost of a cut at a sentence end and inside a sentence.
SIZE, END_ID, SENTENCE, INSIDE = 2048, 1, 4.0, 48.0
#: Tokens between possible cuts inside a long sentence; tokens planned at once.
STEP, PLAN = 256, 1 << 20
SPECIAL = "<|endoftext|>"


class Encoder:
    """The byte-level BPE of a tokenizer file, by its ranks; texts with a special token's string go by the file."""

    def __init__(self, json_path: str, ranks_path: str, ends: bytes = b".!?\n") -> None:
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.json_path, self.whole = json_path, None
        self.sentence_end = np.zeros(max(ranks.values()) + 2, bool)
        for token, number in ranks.items():
            self.sentence_end[number] = token[-1] in ends

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, "<u4")
        if SPECIAL not in text:
            return np.array(self.plain.encode_ordinary(text), "<u4")
        self.whole = self.whole or Tokenizer.from_file(self.json_path)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")


@lru_cache(maxsize=2)
def encoder(json_path: str, ranks_path: str) -> Encoder:
    return Encoder(json_path, ranks_path)


def plan(positions: list[int], penalties: list[float], size: int = SIZE) -> list[int]:
    """Indices of the cuts, first and last included; neighbours in ``positions`` are at most ``size`` apart."""
    n = len(positions)
    cost, back = [0.0] * n, [0] * n
    reach = [0.0] * n  # cost + position
    reach[0] = positions[0]
    queue = deque([0])
    for j in range(1, n):
        low = positions[j] - size
        while positions[queue[0]] < low:
            queue.popleft()
        back[j] = i = queue[0]
        cost[j] = here = reach[i] - low + penalties[j]
        reach[j] = here = here + positions[j]
        while queue and reach[queue[-1]] >= here:
            queue.pop()
        queue.append(j)
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def candidates(ids: np.ndarray, ends: np.ndarray, sentence_end: np.ndarray, size: int = SIZE, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the ids may be cut, from 0 to the end, and their penalties; ``ends`` are document ends."""
    total = len(ids)
    penalty = np.full(total + 1, np.inf, np.float32)
    penalty[np.flatnonzero(sentence_end[ids]) + 1] = SENTENCE
    penalty[ends] = 0
    penalty[[0, total]] = 0
    at = np.flatnonzero(np.isfinite(penalty))
    gaps = np.diff(at)
    step = min(step, size)
    for k in np.flatnonzero(gaps > step).tolist():
        inside = np.arange(at[k] + step, at[k + 1], step)
        penalty[inside] = INSIDE
    at = np.flatnonzero(np.isfinite(penalty))
    return at, penalty[at]


def powers(length: int) -> list[int]:
    """A length as powers of two, largest first."""
    return [1 << k for k in reversed(range(length.bit_length())) if length >> k & 1]


class Packer:
    """Takes documents in order and gives pieces (row, start, length, crc, sequence, offset)."""

    def __init__(self, sentence_end: np.ndarray, size: int = SIZE, ahead: int = PLAN) -> None:
        self.sentence_end, self.size, self.ahead = sentence_end, size, ahead
        self.parts: list[tuple[object, int, int, np.ndarray]] = []  # document, its tokens, start of the part, ids
        self.held = self.sequence = 0

    def add(self, document: object, ids: np.ndarray) -> Iterator[tuple]:
        self.parts.append((document, len(ids), 0, ids))
        self.held += len(ids)
        if self.held >= self.ahead:
            yield from self.flush()

    def flush(self, last: bool = False) -> Iterator[tuple]:
        """All windows but the last, which goes on with what follows; at the end that is cut into powers of two."""
        if not self.parts:
            return
        ids = np.concatenate([p[3] for p in self.parts])
        ends = np.cumsum([len(p[3]) for p in self.parts])
        at, penalty = candidates(ids, ends, self.sentence_end, self.size)
        cuts = at[plan(at.tolist(), penalty.tolist(), self.size)].tolist()
        rest = cuts[-2]
        if last:
            cuts = cuts[:-1] if cuts[-1] - rest < self.size else cuts
            for length in powers(len(ids) - cuts[-1]):
                cuts.append(cuts[-1] + length)
        else:
            cuts.pop()
        k = 0
        begins = (ends - [len(p[3]) for p in self.parts]).tolist()
        ends = ends.tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            while ends[k] <= a:
                k += 1
            j, offset = k, 0
            while j < len(ends) and begins[j] < b:
                document, tokens, start, _ = self.parts[j]
                low, high = max(a, begins[j]), min(b, ends[j])
                piece = ids[low:high]
                yield document, start + low - begins[j], high - low, zlib.crc32(piece), tokens, self.sequence, offset, piece
                offset += high - low
                j += 1
            self.sequence += 1
        if last:
            self.parts, self.held = [], 0
            return
        kept = []
        for (document, tokens, start, part), begin, end in zip(self.parts, begins, ends, strict=True):
            if end > rest:
                cut = max(0, rest - begin)
                kept.append((document, tokens, start + cut, part[cut:].copy()))
        self.parts, self.held = kept, len(ids) - rest


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID, json_path: str | None = None, ranks_path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Pieces of documents in sequences of at most ``size`` tokens.

    Cuts are the best within ``PLAN`` tokens ahead, not over a whole partition.
    A document is its ids and then ``end_id``; a null text is empty. Each id lies in exactly one piece.
    Sequences keep the input order of a partition, and ids are unique over partitions (the partition's
    number in the high bits). The last sequences of a partition have lengths that are powers of two. Repeated
    ids are documents of their own. ``keep_ids`` adds the ids of each piece. An empty table gives no piece.
    """
    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    id_type = docs.schema[id_col].dataType
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_path, ranks_path)
        packer = Packer(encode.sentence_end, size)
        base = TaskContext.get().partitionId() << 36
        id_arrow = None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            document, start, length, crc, tokens, sequence, offset, piece = zip(*rows, strict=True)
            numbers = [pa.array(x, pa.int64()) for x in (start, length, crc, tokens, [base + s for s in sequence], offset)]
            ids = [pa.array(piece, pa.list_(pa.int32()))] if keep_ids else []
            return pa.RecordBatch.from_arrays([pa.array(document, id_arrow), *numbers, *ids], names=names + ["ids"] * keep_ids)

        for batch in batches:
            id_arrow = batch.schema.field(0).type
            rows: list[tuple] = []
            for document, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows.extend(packer.add(document, np.append(encode.ids(text.as_py()), np.uint32(end_id))))
            if rows:
                yield batch_of(rows)
        if rows := list(packer.flush(last=True)):
            yield batch_of(rows)

    schema = f"`{id_col}` {id_type.simpleString()}, " + ", ".join(f"{n} long" for n in names[1:]) + ", ids array<int>" * keep_ids
    return arrow_map(docs.select(F.col(id_col), F.col(text_col)), run, schema)
