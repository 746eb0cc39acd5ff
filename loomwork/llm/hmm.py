"""Hidden Markov language model over words.

Hidden states emit word classes (the last bytes of a word, hashed; the end of a text is a class of its
own), and a class emits its words by their add-one frequency. Baum-Welch counts are summed over partitions;
the scaled forward recursion gives the exact likelihood of a text.

A long text is cut into pieces. The product of the transfer matrices of each piece carries the recursions
from one to the next exactly, so that memory doesn't grow with a text and pieces are computed side by side.

Word counts follow the corpus: documents are dealt into blocks, a block asks once for every distinct word it
holds, and the requests of a word are summed by a window over its hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import LOWER, arrow_map, byte_rows, small, stored, vector_sum

#: Word classes and hidden states.
CLASSES, STATES = 8192, 8
#: First model: rounds over a sample of so many documents of at most so many bytes.
WARM, SAMPLE, LONGEST = 12, 400, 1 << 16
#: Rounds over all documents go on while the log-likelihood of a token gains more than ``GAIN``, at most ``ROUNDS``.
GAIN, ROUNDS = 0.02, 12
#: Text bytes of a block, blocks at least, and equal rows from which on they are scored once.
BLOCK, BLOCKS, REPEATED = 16 << 20, 64, 1000
#: Cells (pieces x steps) of a batch of the recursions, and steps of a piece.
CELLS, PIECE = 1 << 18, 4096
_SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
_LOWER = np.frombuffer(LOWER, np.uint8)


def classes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, class of every word): texts' words one after another, each text closed by class CLASSES."""
    data = np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n", np.uint8)
    data = _LOWER[data]
    blank = _SPACE[data]
    ends = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1  # first blank behind each word
    begins = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    code = data[ends - 1].astype(np.uint32)
    size = ends - begins
    for back in (2, 3):
        part = data[np.maximum(ends - back, 0)].astype(np.uint32) + np.uint32(1)
        code = code * np.uint32(257) + np.where(size >= back, part, np.uint32(0))
    found = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - CLASSES.bit_length() + 1)).astype(np.int64)
    stops = np.cumsum([len(t or b"") + 1 for t in texts])
    words = np.searchsorted(begins, stops, "left")
    out = np.insert(found, words, CLASSES)
    return np.diff(np.r_[0, words]) + 1, out


@dataclass(frozen=True)
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # classes + 1 by states

    @classmethod
    def rough(cls, states: int = STATES, seed: int = 5) -> Model:
        rng = np.random.default_rng(seed)
        emit = rng.uniform(0.5, 1.5, (CLASSES + 1, states))
        move = np.full((states, states), 0.3 / max(1, states - 1)) + np.eye(states) * (0.7 - 0.3 / max(1, states - 1))
        return cls(np.full(states, 1 / states), move, emit / emit.sum(axis=0))

    @classmethod
    def of(cls, counts: np.ndarray, states: int, pull: float = 50.0) -> Model:
        """From expected counts; emissions are drawn towards the common distribution of classes."""
        start, move, emit = _split(counts, states)
        common = emit.sum(axis=1) + 0.5
        emit = emit + pull * (common / common.sum())[:, None]
        start, move = start + 0.1, move + 0.1
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _split(counts: np.ndarray, states: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b = states, states + states * states
    return counts[:a], counts[a:b].reshape(states, states), counts[b:].reshape(CLASSES + 1, states)


def _batches(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of similar size, longest first, about CELLS cells together."""
    order = np.argsort(-sizes, kind="stable")
    k = 0
    while k < len(order):
        n = max(1, CELLS // max(1, int(sizes[order[k]])))
        yield order[k : k + n]
        k += n


@dataclass
class _Swept:
    """Forward recursion over rows sorted longest first; a row for each state, and the cells step by step."""

    live: np.ndarray  # rows of each step
    starts: np.ndarray  # first cell of each step
    place: np.ndarray  # symbol of each cell
    alpha: np.ndarray
    scale: np.ndarray
    value: np.ndarray  # log-likelihood of each row
    last: np.ndarray  # last cell of each row


def _sweep(model: Model, begin: np.ndarray, sizes: np.ndarray, symbols: np.ndarray, expect: np.ndarray) -> _Swept:
    """``expect``: the distribution of states (states x rows) before the first symbol of each row is seen."""
    steps = int(sizes[0])
    live = np.searchsorted(-sizes, -np.arange(steps), "left")
    ends = np.cumsum(live)
    starts = ends - live
    row = np.arange(ends[-1]) - np.repeat(starts, live)
    place = symbols[begin[row] + np.repeat(np.arange(steps), live)]
    alpha, scale = model.emit.T[:, place], np.empty(len(place))
    move = np.ascontiguousarray(model.move.T)
    for a, n in zip(starts.tolist(), live.tolist(), strict=True):
        cell, total = alpha[:, a : a + n], scale[a : a + n]
        cell *= expect[:, :n]
        np.add.reduce(cell, axis=0, out=total)
        cell /= total
        expect = move @ cell
    value = np.bincount(row, np.log(scale), len(sizes))
    return _Swept(live, starts, place, alpha, scale, value, starts[sizes - 1] + np.arange(len(sizes)))


@dataclass
class _Pieces:
    """Pieces of texts: text, first symbol, size, whether it begins its text, and what the rest of the text
    says: the states before it, and the weights of the states at its end."""

    of: np.ndarray
    begin: np.ndarray
    sizes: np.ndarray
    first: np.ndarray
    before: np.ndarray
    after: np.ndarray
    value: np.ndarray  # log-likelihoods of the long texts, which come with the transfers


def _cut(model: Model, lengths: np.ndarray, symbols: np.ndarray) -> _Pieces:
    states = len(model.start)
    count = -(-lengths // PIECE)
    of = np.repeat(np.arange(len(lengths)), count)
    number = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    begin = (np.cumsum(lengths) - lengths)[of] + number * PIECE
    sizes = np.minimum(lengths[of] - number * PIECE, PIECE)
    out = _Pieces(of, begin, sizes, number == 0, np.ones((len(of), states)), np.ones((len(of), states)), np.zeros(len(lengths)))
    long = np.flatnonzero(count[of] > 1)
    if not len(long):
        return out
    # each later piece is swept from every state: the rows of its transfer matrix, and their logarithmic scales
    ends, scales = np.zeros((len(of), states, states)), np.zeros((len(of), states))
    rows = np.repeat(long, np.where(out.first[long], 1, states))
    state = np.concatenate([[0] if f else np.arange(states) for f in out.first[long]])
    expect = np.where(out.first[rows][:, None], model.start, model.move[state])
    for chosen in _batches(sizes[rows]):
        piece = rows[chosen]
        swept = _sweep(model, begin[piece], sizes[piece], symbols, expect[chosen].T)
        ends[piece, state[chosen]], scales[piece, state[chosen]] = swept.alpha[:, swept.last].T, swept.value
    top = scales.max(axis=1)
    transfer = np.exp(scales - top[:, None])[:, :, None] * ends
    for k in long.tolist():
        if out.first[k]:
            out.value[of[k]] = scales[k, 0]
            now = ends[k, 0]
        else:
            out.before[k] = now
            now = now @ transfer[k]
            out.value[of[k]] += top[k] + np.log(now.sum())
            now = now / now.sum()
    for k in long[::-1].tolist():
        if not out.first[k]:  # weights of the states before this piece
            weight = transfer[k] @ out.after[k]
            out.after[k - 1] = weight / (out.before[k] @ weight)
    return out


def forward(model: Model, lengths: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Natural log-likelihoods of texts that follow each other in ``symbols``."""
    cut = _cut(model, lengths, symbols)
    out = cut.value
    whole = np.flatnonzero(lengths[cut.of] <= PIECE)
    for chosen in _batches(cut.sizes[whole]):
        rows = whole[chosen]
        out[cut.of[rows]] = _sweep(model, cut.begin[rows], cut.sizes[rows], symbols, np.repeat(model.start[:, None], len(rows), axis=1)).value
    return out


def expected(model: Model, lengths: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, float]:
    """Baum-Welch counts of starts, moves and emissions, flat; and the log-likelihood of all texts."""
    states = len(model.start)
    start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((CLASSES + 1, states))
    cut = _cut(model, lengths, symbols)
    value = 0.0
    for rows in _batches(cut.sizes):
        first, before, weights = cut.first[rows], cut.before[rows].T, cut.after[rows].T
        expect = np.where(first, model.start[:, None], model.move.T @ before)
        swept = _sweep(model, cut.begin[rows], cut.sizes[rows], symbols, expect)
        value += float(swept.value.sum())
        weights = weights / (swept.alpha[:, swept.last] * weights).sum(axis=0)
        seen = model.emit.T[:, swept.place]
        seen /= swept.scale
        ahead = None
        for a, n in zip(swept.starts[::-1].tolist(), swept.live[::-1].tolist(), strict=True):
            cell, m = swept.alpha[:, a : a + n], 0 if ahead is None else ahead.shape[1]
            after = weights[:, :n].copy()
            if m:
                move += cell[:, :m] @ ahead.T
                after[:, :m] = model.move @ ahead
            ahead = seen[:, a : a + n]
            ahead *= after
            cell *= after  # the share of each state
        start += swept.alpha[:, : len(rows)][:, first].sum(axis=1)
        move += before[:, ~first] @ ahead[:, ~first].T
        for s in range(states):
            emit[:, s] += np.bincount(swept.place, swept.alpha[s], CLASSES + 1)
    return np.concatenate([start, (move * model.move).ravel(), emit.ravel()]), value


def _groups(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[list[bytes | None]]:
    """Texts of neighbouring rows, about ``limit`` bytes together: the more texts, the less a step costs each."""
    held, n = [], 0
    for batch in batches:
        for text in batch.column("t").to_pylist():
            held.append(text)
            n += len(text) if text else 0
            if n >= limit:
                yield held
                held, n = [], 0
    if held:
        yield held


def train(docs: DataFrame, where: Column, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, sample: int = SAMPLE, warm: int = WARM, rounds: int = ROUNDS, gain: float = GAIN, seed: int = 5) -> Model:
    """Baum-Welch over all rows that ``where`` admits, until a token gains at most ``gain``, ``rounds`` times at most.

    It begins with ``warm`` rounds over ``sample`` rows, least by a hash, of at most ``LONGEST`` bytes each. Without rows
    the model is a rough one.
    """
    source = docs.where(where).select(F.col(text_col).cast("binary").alias("t"), F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)).alias("h"))
    short = source.where(F.coalesce(F.octet_length("t"), F.lit(0)) <= LONGEST)
    least = [r.h for r in short.select("h").distinct().orderBy("h").limit(sample).collect()]  # hashes first: a partition has as many candidates
    model = Model.rough(states, seed)
    if least:
        texts = [bytes(r.t or b"") for r in short.where(F.col("h") <= max(least)).groupBy("h").agg(F.min("t").alias("t")).orderBy("h").collect()]
        lengths, symbols = classes(texts)
        for _ in range(warm):
            model = Model.of(expected(model, lengths, symbols)[0], states)
    last = None
    for _ in range(rounds):
        sums = _round(source.select("t"), model)
        if not sums:
            break
        value, tokens = sums["value"]
        model = Model.of(sums["counts"], states)
        if last is not None and value - last <= gain * tokens:
            break
        last = value
    return model


def _round(source: DataFrame, model: Model) -> dict[str, np.ndarray]:
    """``counts`` of Baum-Welch, and ``value``: the log-likelihood and the number of tokens. Nothing without rows."""
    shared = source.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, value = None, np.zeros(2)
        for texts in _groups(batches):
            lengths, symbols = classes(texts)
            part, likely = expected(shared.value, lengths, symbols)
            total = part if total is None else total + part
            value += likely, lengths.sum()
        if total is not None:
            yield pa.RecordBatch.from_pydict({"key": ["counts", "value"], "vector": [total.tobytes(), value.tobytes()], "kind": ["float64"] * 2})

    found = vector_sum(arrow_map(source, count, "key string, vector binary, kind string"))
    shared.unpersist()
    return found


def _words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(words of each text, hash of every word)."""
    sizes, parts = [], []
    for t in texts:
        words = t.translate(LOWER).split() if t else []
        sizes.append(len(words))
        parts.append(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))
    return np.array(sizes, np.int64), np.concatenate(parts) if parts else np.empty(0, np.uint64)


def _ask(table: pa.Table) -> pa.Table:
    """The distinct words of a block: their place in it, hash, class, and count in training rows."""
    texts = byte_rows(table.column("t").combine_chunks())
    n, hashes = _words(texts)
    _, symbols = classes(texts)
    own, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    times = np.where(table.column("train").to_numpy(), table.column("times").to_numpy(), 0)
    seen = np.bincount(inverse, np.repeat(times, n), len(own))
    kinds = symbols[symbols < CLASSES][at]
    block = np.full(len(own), table.column("block")[0].as_py())
    return pa.table({"block": pa.array(block, pa.int64()), "place": pa.array(np.arange(len(own)), pa.int32()), "hash": pa.array(own.view(np.int64)), "kind": pa.array(kinds, pa.int16()), "n": pa.array(seen.astype(np.int64))})


def score(docs: DataFrame, model: Model, where: Column, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, blocks: int = BLOCKS) -> DataFrame:
    """One row per input row: ``id_col``, ``train``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Tokens are words and one end. ``base_score`` is the add-one unigram score and ``score`` the model's log10
    probability; words are counted over all rows that ``where`` admits (``train``), by their 64-bit hashes. A word that no
    such row has shares the one place its class keeps for unknown words. Null texts are empty. Rows with a null id
    are scored as any other, and rows that repeat more than ``REPEATED`` times, or fill a block, are counted in full but computed once. An empty
    table gives an empty result; without training rows N is 0.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("t"), F.coalesce(where, F.lit(False)).alias("train"))
    size, ends = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)), F.count_if("train")).first()
    count = max(blocks, -(-size // block))
    content = F.xxhash64("__id", "t")
    copies = rows.groupBy(content.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce(F.octet_length("t"), F.lit(0))).alias("size"))
    often = stored(copies.where((F.col("n") > REPEATED) | ((F.col("n") > 1) & (F.col("n") * F.col("size") > block))).select("h"), "often")
    repeated = not often.isEmpty()
    if not repeated:
        dealt = rows.withColumn("times", F.lit(1).cast("long"))
    else:
        marked = rows.withColumn("h", content)
        once = marked.join(small(often), "h", "left_semi").groupBy("__id", "t", "train").agg(F.count(F.lit(1)).alias("times"))
        dealt = marked.join(small(often), "h", "left_anti").drop("h").withColumn("times", F.lit(1).cast("long")).unionByName(once)
    dealt = dealt.withColumn("block", F.pmod(content, F.lit(count)))
    asked = dealt.groupBy("block").applyInArrow(_ask, "block long, place int, hash long, kind short, n long")
    word = Window.partitionBy("hash")
    summed = asked.select("block", "place", "kind", F.sum("n").over(word).alias("total"), (F.row_number().over(word.orderBy("block")) == 1).alias("first"))
    answers = stored(summed, "answers")
    sums = np.zeros((2, CLASSES), np.int64)
    for r in answers.where("first").groupBy("kind").agg(F.sum("total").alias("n"), F.count_if(F.col("total") > 0).alias("v")).collect():  # a row for each class
        sums[:, r.kind] = r.n, r.v
    tokens, distinct = int(sums[0].sum()) + ends, int(sums[1].sum()) + (ends > 0)
    shared = spark.sparkContext.broadcast((model, np.log(sums[0] + sums[1] + 1.0)))
    floor = float(np.log10(tokens + distinct + 1))

    def work(table: pa.Table, reply: pa.Table) -> pa.Table:
        model, places = shared.value
        if not table.num_rows:
            return pa.table({name: pa.array([], kind) for name, kind in zip(names, kinds_of(table), strict=True)})
        texts = byte_rows(table.column("t").combine_chunks())
        n, hashes = _words(texts)
        lengths, symbols = classes(texts)
        own, inverse = np.unique(hashes, return_inverse=True)
        if len(own) != reply.num_rows:
            raise RuntimeError("the rows of a block have changed since its words were counted")
        counts = np.empty(len(own), np.int64)
        counts[reply.column("place").to_numpy()] = reply.column("total").to_numpy()
        found = counts[inverse]
        first = (np.cumsum(n) - n)[n > 0]

        def total(values: np.ndarray) -> np.ndarray:
            """Each text's own sum, whatever texts are beside it."""
            out = np.zeros(len(n))
            if len(values):
                out[n > 0] = np.add.reduceat(values, first)
            return out

        up = np.log(found + 1.0)
        base = (total(up) + np.log(ends + 1.0)) / np.log(10) - lengths * floor
        known = total((found > 0).astype(float)).astype(np.int64) + (ends > 0)
        value = (forward(model, lengths, symbols) + total(up - places[symbols[symbols < CLASSES]])) / np.log(10)
        return pa.table({"__id": table.column("__id"), "train": table.column("train"), "times": table.column("times"), "n_tokens": pa.array(lengths), "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(n), tokens)), "base_score": pa.array(base), "score": pa.array(value)})

    names = ["__id", "train", "times", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds_of = lambda t: [t.schema.field("__id").type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    schema = f"__id {docs.schema[id_col].dataType.simpleString()}, train boolean, times long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    left, right = dealt.groupBy("block"), answers.select("block", "place", "total").groupBy("block")
    scored = left.cogroup(right).applyInArrow(work, schema)
    if repeated:
        scored = scored.withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("__n")
    return scored.drop("times").withColumnRenamed("__id", id_col)
