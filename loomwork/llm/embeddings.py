"""Near-duplicate embeddings by cross-polytope hashing.

A hash rotates a vector by three rounds of random signs and a fast Hadamard transform and takes the axis, with
its sign, that the result is nearest to. A table joins as many hashes as the number of vectors needs
(``hashes_for``). A vector's *home* in a table is the bucket of its nearest axes; it is also a member of the
buckets of the next nearest ones (``probes``). Homes are compared with members, bucket by bucket, by sketches of
sign bits first; only rows that are near another by them bring their vectors, and cosines are computed in double
precision. There are so many tables that a pair at the threshold misses all of them with chance ``miss``.

A pair may meet in several buckets. It counts in the first one alone, which is known from the two vectors, so
that no list of pairs is needed: tasks leave sums of links a vector and a forest of the links.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import arrow_map, release, small, stored
from loomwork.llm.simhash import components, forest

#: Homes, and members, of a bucket that are compared at once; larger buckets are dealt in tiles of these.
TILE = 1024
#: Vectors that a bucket may be home to on average before a table takes one more hash.
HOMES = 256
#: Pairs whose sketches, or vectors, are compared at once.
PAIRS, PAIR_BYTES = 1 << 19, 1 << 25
#: Sign bits of a sketch, and deviations above the expectation that a pair at the threshold may differ more.
SKETCH, DEVIATIONS = 256, 4.5
#: Bits of a bucket's code, of its table and of the vectors' dimension.
CODE_BITS, TABLE_BITS, DIM_BITS = 40, 8, 15

#: What a row is in a cell, and whether the bucket is its home.
_HOME, _MEMBER, _AT_HOME = 1, 2, 4


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the normalised Hadamard matrix; their length is a power of two."""
    n, half = x.shape[1], 1
    while half < n:
        pairs = x.reshape(len(x), -1, 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
        half *= 2
    return x / math.sqrt(n)


def padded(dim: int) -> int:
    """The length that vectors are filled up to with zeros: a power of two, 16 at least."""
    return max(16, 1 << max(0, dim - 1).bit_length())


def rotate(x: np.ndarray, stream: int) -> np.ndarray:
    """Pseudo-random rotation number ``stream`` of the rows."""
    rng = np.random.default_rng([11, x.shape[1], stream])
    for _ in range(3):
        x = hadamard(x * rng.choice(np.array([-1.0, 1.0]), x.shape[1]))
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, without overflow or underflow, filled up to ``padded``."""
    x = np.asarray(x, np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.pad(x, ((0, 0), (0, padded(x.shape[1]) - x.shape[1])))


def hashes_for(vectors: int, dim: int, homes: int = HOMES) -> int:
    """Hashes of a table: buckets hold ``homes`` homes on average at most, as far as the code has bits."""
    axes = 2 * padded(dim)
    count = 1
    while vectors > homes * axes**count and (count + 1) * (axes.bit_length() - 1) <= CODE_BITS:
        count += 1
    return count


def codes(x: np.ndarray, table: int, hashes: int, probes: int) -> np.ndarray:
    """(row, probe) codes of unit rows in a table; probe 0 is the home, the others are next by their loss."""
    axes, width = 2 * x.shape[1], min(probes, x.shape[1])
    code, loss = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for k in range(hashes):
        turned = rotate(x, 1 + table * 64 + k)
        size = np.abs(turned)
        order = np.argsort(-size, axis=1, kind="stable")[:, :width]
        top = np.take_along_axis(size, order, 1)
        axis = order * 2 + (np.take_along_axis(turned, order, 1) < 0)
        loss = (loss[:, :, None] + ((top[:, :1] - top) ** 2)[:, None, :]).reshape(len(x), -1)
        code = (code[:, :, None] * axes + axis[:, None, :]).reshape(len(x), -1)
        best = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        loss, code = np.take_along_axis(loss, best, 1), np.take_along_axis(code, best, 1)
    return code


@cache
def tables_for(dim: int, hashes: int, probes: int, least: float, miss: float) -> int:
    """Tables that leave a pair of cosine ``least`` unmet with chance ``miss``; the chance is measured on 2,000 such pairs."""
    rng, size = np.random.default_rng(7), padded(dim)
    a = rng.normal(size=(2000, size))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = least * a + math.sqrt(max(0.0, 1 - least * least)) * b / np.linalg.norm(b, axis=1, keepdims=True)
    meets = [met(codes(a, t, hashes, probes)[:, None], codes(b, t, hashes, probes)[:, None])[0].mean() for t in range(4)]
    return max(2, min(200, math.ceil(math.log(miss) / math.log(1 - min(0.99, max(1e-3, float(np.mean(meets))))))))


def met(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair, table): whether the pair meets in the table, and whether it does so at both homes, which differ.

    ``left`` and ``right`` are the pairs' codes (pair, table, probe)."""
    at_left = (left[:, :, :1] == right).any(axis=2)
    at_right = (right[:, :, :1] == left).any(axis=2)
    return at_left | at_right, at_left & at_right & (left[:, :, 0] != right[:, :, 0])


class Scheme:
    """The tables for vectors of each dimension; small enough to go with every task."""

    def __init__(self, vectors: int, least: float, probes: int, miss: float, homes: int = HOMES) -> None:
        self.vectors, self.least, self.probes, self.miss, self.homes = vectors, least, probes, miss, homes

    def shape(self, dim: int) -> tuple[int, int]:
        """(tables, hashes)."""
        hashes = hashes_for(self.vectors, dim, self.homes)
        return tables_for(dim, hashes, self.probes, self.least, self.miss), hashes

    def codes(self, x: np.ndarray, dim: int) -> np.ndarray:
        """(row, table, probe)."""
        tables, hashes = self.shape(dim)
        return np.stack([codes(x, t, hashes, self.probes) for t in range(tables)], axis=1)

    def buckets(self, found: np.ndarray, dim: int) -> np.ndarray:
        tables = np.arange(found.shape[1], dtype=np.int64)[None, :, None]
        return ((np.int64(dim % (1 << DIM_BITS)) << np.int64(TABLE_BITS)) | tables) << np.int64(CODE_BITS) | found

    def sketches(self, x: np.ndarray) -> np.ndarray:
        """(row, word): sign bits of further rotations."""
        turns = [rotate(x, -1 - k & 0xFFFF) > 0 for k in range(-(-SKETCH // x.shape[1]))]
        return np.packbits(np.concatenate(turns, axis=1)[:, :SKETCH], axis=1).view(np.uint64)

    def sketch_bits(self) -> int:
        """Bits that the sketches of linked vectors differ in at most, but for ``DEVIATIONS`` deviations."""
        differ = math.acos(max(-1.0, min(1.0, self.least))) / math.pi
        return math.ceil(SKETCH * differ + DEVIATIONS * math.sqrt(SKETCH * differ * (1 - differ)))


def _by_dimension(vectors: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, rows, matrix) of a list column without nulls."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        yield dim, rows, flat[starts[rows][:, None] + np.arange(dim)]


_WORDS = [f"s{k}" for k in range(SKETCH // 64)]


def _spread(distinct: DataFrame, scheme: Scheme, sketched: bool) -> DataFrame:
    """A row for each bucket that a vector is at home in or a member of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                key = part.column("k").to_numpy(zero_copy_only=False)
                for dim, rows, matrix in _by_dimension(part.column("v")):
                    x = unit(matrix)
                    bucket = scheme.buckets(scheme.codes(x, dim), dim)
                    copies = bucket.shape[1] * bucket.shape[2]
                    out = {"bucket": pa.array(bucket.ravel())}
                    if sketched:
                        words = scheme.sketches(x)
                        home = np.broadcast_to(np.arange(bucket.shape[2]) == 0, bucket.shape)
                        out |= {"k": pa.array(np.repeat(key[rows], copies)), "home": pa.array(home.ravel())}
                        out |= {n: pa.array(np.repeat(np.ascontiguousarray(words[:, i]).view(np.int64), copies)) for i, n in enumerate(_WORDS)}
                    yield pa.RecordBatch.from_pydict(out)

    more = "".join(f", {n} long" for n in ("k", *_WORDS)).replace("k long", "k long, home boolean") if sketched else ""
    return arrow_map(distinct.select("k", "v"), run, f"bucket long{more}")


def _tiled(spread: DataFrame, hot: DataFrame | None, tile: int) -> DataFrame:
    """Cells (bucket, i, j) of part i of a bucket's homes and part j of its members: each home meets each member in one."""
    member = F.when(F.col("home"), _MEMBER | _AT_HOME).otherwise(_MEMBER)
    home = F.when(F.col("home"), _HOME | _MEMBER | _AT_HOME).otherwise(_MEMBER)
    if hot is None:
        return spread.select("bucket", F.lit(0).alias("i"), F.lit(0).alias("j"), home.alias("role"), "k", *_WORDS)
    parts = F.ceil(F.coalesce(F.col("members"), F.lit(1)) / tile).cast("int")
    placed = spread.join(hot, "bucket", "left").withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("k"), F.col("parts").cast("long")).cast("int"))
    cell = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), role.alias("role"))
    own, each = F.col("own"), F.sequence(F.lit(0), F.col("parts") - 1)
    as_member = F.transform(each, lambda p: cell(p, own, F.when(p == own, home).otherwise(member)))
    as_home = F.transform(F.filter(each, lambda p: F.col("home") & (p != own)), lambda p: cell(own, p, F.lit(_HOME | _AT_HOME)))
    return placed.withColumn("cell", F.explode(F.concat(as_member, as_home))).select("bucket", "cell.i", "cell.j", "cell.role", "k", *_WORDS)


_CELL = ("bucket", "i", "j")


def _cells(dealt: DataFrame, work: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``work`` on runs of whole cells: their rows and where each cell begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if rest is not None:
                batch = pa.concat_batches([rest, batch])
            at = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in _CELL], axis=1)
            starts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]).any(axis=1)])
            last = int(starts[-1])
            rest = pa.concat_batches([batch.slice(last)])  # the last cell may go on in the next batch
            if last and (out := work(batch.slice(0, last), starts[:-1])) is not None:
                yield out
        if rest is not None and (out := work(rest, np.zeros(1, np.int64))) is not None:
            yield out

    return arrow_map(dealt.repartition(*_CELL).sortWithinPartitions(*_CELL), run, schema)


def _pairs(starts: np.ndarray, role: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(home, member) row numbers of all pairs of each cell, about ``most`` at once."""
    group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(role)]))
    member, home = np.flatnonzero(role & _MEMBER), np.flatnonzero(role & _HOME)
    sizes = np.bincount(group[member], minlength=len(starts))
    first = np.cumsum(sizes) - sizes
    home = home[sizes[group[home]] > 0]
    ends = np.cumsum(sizes[group[home]])
    at = 0
    while at < len(home):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        part = home[at:to]
        sized = sizes[group[part]]
        left = np.repeat(part, sized)
        yield left, member[np.repeat(first[group[part]] - np.cumsum(sized) + sized, sized) + np.arange(sized.sum())]
        at = to


def _near(cells: DataFrame, scheme: Scheme) -> DataFrame:
    """The rows of cells whose sketch is near that of another row they are compared with."""
    most = scheme.sketch_bits()

    def work(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch | None:
        column = lambda n: batch.column(n).to_numpy(zero_copy_only=False)
        key, words = column("k"), [column(n).view(np.uint64) for n in _WORDS]
        found = np.zeros(batch.num_rows, bool)
        for left, right in _pairs(starts, column("role"), PAIRS):
            apart = np.bitwise_count(words[0][left] ^ words[0][right]).astype(np.uint16)
            for word in words[1:]:
                close = apart <= most
                left, right, apart = left[close], right[close], apart[close]
                apart = apart + np.bitwise_count(word[left] ^ word[right])
            close = (apart <= most) & (key[left] != key[right])
            found[left[close]] = found[right[close]] = True
        return batch.select([*_CELL, "role", "k"]).filter(pa.array(found)) if found.any() else None

    return _cells(cells, work, "bucket long, i int, j int, role int, k long")


def _verified(near: DataFrame, scheme: Scheme) -> DataFrame:
    """Rows (a, b, w): sums of links (b null; w counts the copies of the others) and links of a forest (w null)."""
    least = scheme.least

    def work(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        column = lambda n: batch.column(n).to_numpy(zero_copy_only=False)
        key, copies, role, bucket = column("k"), column("n"), column("role"), column("bucket")
        nodes, sums, a, b = [key[:0]], [copies[:0]], key[:0], key[:0]
        place = np.zeros(batch.num_rows, np.int64)
        dims = np.zeros(batch.num_rows, np.int64)
        units = {}
        for dim, rows, matrix in _by_dimension(batch.column("v")):
            units[dim], dims[rows], place[rows] = unit(matrix), dim, np.arange(len(rows))
        table = bucket >> CODE_BITS & (1 << TABLE_BITS) - 1
        for left, right in _pairs(starts, role, max(1, PAIR_BYTES // (8 * max(x.shape[1] for x in units.values())))):
            # two homes of one bucket meet twice
            once = (dims[left] == dims[right]) & (key[left] != key[right]) & (((role[right] & _AT_HOME) == 0) | (key[left] < key[right]))
            left, right = left[once], right[once]
            for dim, x in units.items():
                own = dims[left] == dim
                l, r = left[own], right[own]
                close = np.einsum("ij,ij->i", x[place[l]], x[place[r]]) >= least
                l, r = l[close], r[close]
                rows, flat = np.unique(np.concatenate([l, r]), return_inverse=True)
                if not len(rows):
                    continue
                found = scheme.codes(x[place[rows]], dim)
                for at in range(0, len(l), 1 << 14):
                    part = slice(at, at + (1 << 14))
                    i, j, pl, pr = l[part], r[part], found[flat[: len(l)][part]], found[flat[len(l) :][part]]
                    meets, twice = met(pl, pr)
                    number = np.arange(len(i))
                    first = meets.argmax(axis=1) == table[i]
                    homes = scheme.buckets(np.minimum(pl[:, :, :1], pr[:, :, :1]), dim)[number, table[i], 0]
                    first &= ~twice[number, table[i]] | (homes == bucket[i])
                    i, j = i[first], j[first]
                    nodes += [key[i], key[j]]
                    sums += [copies[j], copies[i]]
                    a, b = np.concatenate([a, key[i]]), np.concatenate([b, key[j]])
                if len(a) > PAIRS:
                    a, b = forest(a, b)
                    nodes, sums = _summed(nodes, sums)
        a, b = forest(a, b) if len(a) else (a, b)
        (node,), (total,) = _summed(nodes, sums)
        return pa.RecordBatch.from_pydict({
            "a": pa.array(np.concatenate([node, a]), pa.int64()),
            "b": pa.concat_arrays([pa.nulls(len(node), pa.int64()), pa.array(b, pa.int64())]),
            "w": pa.concat_arrays([pa.array(total, pa.int64()), pa.nulls(len(a), pa.int64())]),
        })

    return _cells(near, work, "a long, b long, w long")


def _summed(nodes: list[np.ndarray], sums: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    node, flat = np.unique(np.concatenate(nodes), return_inverse=True)
    total = np.zeros(len(node), np.int64)
    np.add.at(total, flat, np.concatenate(sums))
    return [node], [total]


def _usable(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_duplicate_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, probes: int = 2, miss: float = 0.01, tile: int = TILE, homes: int = HOMES) -> DataFrame:
    """One row per input row: ``id_col``, ``n_links``, ``component_id`` and ``kept``.

    Vectors link at a cosine of ``least`` or more, in double precision; equal vectors always do. ``n_links`` counts the
    other rows linked directly, ``component_id`` is the smallest id reachable, and ``kept`` tells whether it is the row's own.
    A vector that is null, empty or zero, or holds a null or non-finite component, has no link; vectors of
    different lengths have none with each other. Repeated rows, and rows that share an id, are rows of their own. Rows with a null id
    link like others; their component is null if no row of it has an id. An empty table gives an empty result.
    Other columns are not looked at. A pair is missed with chance ``miss`` at the threshold, and less above it.
    """
    single = rows.schema[vector_col].dataType.elementType.typeName() == "float"
    vector = F.col(vector_col).cast("array<float>" if single else "array<double>")
    keyed = rows.select(F.col(id_col).alias("id"), vector.alias("v")).withColumn("ok", _usable(F.col("v")))
    hashed = {"h1": F.when(F.col("ok"), F.xxhash64("v")), "h2": F.when(F.col("ok"), F.xxhash64(F.lit(1), "v"))}
    keyed = keyed.withColumns(hashed)
    groups = keyed.where("ok").groupBy("v", "h1", "h2").agg(F.min("id").alias("d"), F.count(F.lit(1)).alias("n"))
    groups = stored(groups.withColumn("k", F.monotonically_increasing_id()), "vectors")

    scheme = Scheme(groups.count(), least, probes, miss, homes)
    hot = stored(_spread(groups, scheme, False).groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > tile), "buckets")
    cells = _tiled(_spread(groups, scheme, True), None if hot.isEmpty() else small(hot), tile)
    near = stored(_near(cells, scheme), "near")
    found = stored(_verified(near.join(groups.select("k", "n", "v"), "k"), scheme), "links")
    sums = found.where("b is null").groupBy(F.col("a").alias("k")).agg(F.sum("w").alias("w"))
    roots = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "k")
    linked = groups.select("k", "h1", "h2", "d", "n").join(sums, "k", "left").join(roots, "k", "left").where("n > 1 or w > 0")
    linked = stored(linked.withColumn("root", F.coalesce("root", "k")), "linked")
    least_id = linked.groupBy("root").agg(F.min("d").alias("component"))
    known = stored(linked.join(least_id, "root").select("h1", "h2", (F.col("n") - 1 + F.coalesce("w", F.lit(0))).alias("links"), "component"), "known")
    release(groups, hot, near, found, linked)

    component = F.when(F.col("links").isNull(), F.col("id")).otherwise(F.col("component"))
    out = keyed.select("id", "h1", "h2").join(small(known), ["h1", "h2"], "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
