"""SimHash near-duplicate grouping with anchors of a covering code.

Fingerprints that differ in few bits differ in at most one bit of some *set* of bits. For a link within
``threshold`` bits of one fingerprint the sets are blocks, or groups of blocks, of which one has at most one
differing bit in any case (``exact_sets``). For a link over several fingerprints together they are so many
sets of sampled bits that one has at most one differing bit almost surely (``sampled_sets``).

In each set the anchors are the words of a covering code: a perfect Hamming code (covering radius 1) on the
first 2**m - 1 bits, times all values of the remaining bits. A fingerprint's *home* is its nearest anchor;
it is also replicated to every anchor within covering radius plus that one bit. Whoever links to ``x`` is
then found at the home of ``x``. Only links survive an anchor, reduced to a forest, and never all pairs of
a bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations, count, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import BROADCAST_ROWS, LOWER, arrow_map, byte_rows, cut_lineage, map_arrow, release, small, stored

#: Homes, and members, of an anchor that are compared at once; larger anchors are dealt in tiles of these.
TILE = 4096
#: Homes that an anchor may have on average before wider sets of bits take over.
HOMES = 128
#: Pairs held in memory at once.
PAIRS = 1 << 19


#: Odd constants that turn a shingle's hash into that of another plane.
PLANES = tuple(0x9E3779B97F4A7C15 * (2 * k + 1) & (1 << 64) - 1 for k in range(16))


def _mix(x: np.ndarray, constant: int) -> np.ndarray:
    x = (x ^ np.uint64(constant)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def fingerprints_of(text: bytes | None, width: int = 4, seed: int = 42, planes: int = 1) -> list[int]:
    """SimHashes over ``width``-word shingles of a UTF-8 text, repeats included; 0 without words or for null.
    The first is over the shingles' XXH64; further planes are independent ones, over mixed hashes."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return [0] * planes
    joined = b" ".join(words)
    if len(words) <= width:
        shingles = [joined]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        shingles = [joined[a:b] for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, len(shingles))
    out = []
    for plane in range(planes):
        own = _mix(hashes, PLANES[plane]) if plane else hashes
        counts = np.zeros(64, np.int64)
        for k in range(0, len(own), 1 << 16):
            bits = np.unpackbits(own[k : k + (1 << 16)].view(np.uint8), bitorder="little")
            counts += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(counts * 2 > len(own), bitorder="little").tobytes(), "little"))
    return out


def fingerprint(text: bytes | None, width: int = 4, seed: int = 42) -> int:
    return fingerprints_of(text, width, seed)[0]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42, planes: int = 1) -> DataFrame:
    """One row per document: its id and ``fp``, ``fp1``, ...: the fingerprints as signed longs."""
    names = _names(planes)

    def work(batch: pa.RecordBatch) -> dict:
        prints = np.array([fingerprints_of(x, width, seed, planes) for x in byte_rows(batch.column(1))], np.uint64).reshape(-1, planes)
        return {id_col: batch.column(0)} | {n: pa.array(np.ascontiguousarray(prints[:, k]).view(np.int64)) for k, n in enumerate(names)}

    source = docs.select(F.col(id_col), F.col(text_col))
    return map_arrow(source, work, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names))


def _names(planes: int) -> list[str]:
    return ["fp", *(f"fp{k}" for k in range(1, planes))]


def exact_sets(threshold: int, prints: int = 0) -> list[np.ndarray]:
    """Sets of bits of which one has at most one of any ``threshold`` differing bits.

    Single blocks of threshold // 2 + 1 do. For many fingerprints the sets are groups of r blocks of
    threshold + r - 1, whose least differing one has one such bit too: more replicas, but as many more anchors.
    """
    for r in count(1):
        n = threshold // 2 + 1 if r == 1 else threshold + r - 1
        edges = [64 * k // n for k in range(n + 1)]
        sets = [np.concatenate([np.arange(edges[k], edges[k + 1]) for k in group]) for group in combinations(range(n), r)]
        bits = min(map(len, sets))
        if prints <= HOMES << max(0, bits - 4) or bits >= 40:
            return sets


def sampled_sets(planes: int, least: float, prints: int = 0, miss: float = 0.02) -> list[np.ndarray]:
    """Sets of bits of several fingerprints, so many that two texts of similarity ``least`` differ in more than
    one bit of every set with chance ``miss`` at most. Many fingerprints take wider sets, and more of them."""
    differ = math.acos(min(1.0, 2 * least / (1 + least))) / math.pi
    width = 16
    while prints > HOMES << (width - 4) and width < 40:
        width += 4
    hit = (1 - differ) ** width + width * differ * (1 - differ) ** (width - 1)
    need = max(1, math.ceil(math.log(miss) / math.log(1 - hit)))
    rng, sets = np.random.default_rng(64), []
    while len(sets) < need:
        order = rng.permutation(64 * planes)
        sets += [np.sort(order[k : k + width]) for k in range(0, len(order) - width + 1, width)]
    return sets[:need]


def anchors(prints: list[np.ndarray], sets: list[np.ndarray], near: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is home) for every anchor that each row of fingerprints (a column for each plane) is replicated to."""
    rows, keys, homes = [], [], []
    index = np.arange(len(prints[0]), dtype=np.int64)

    def add(number: int, where: np.ndarray, key: np.ndarray, home: bool) -> None:
        rows.append(index[where])
        keys.append((np.int64(number) << np.int64(44)) | key[where])
        homes.append(np.full(int(where.sum()), home))

    for k, bits in enumerate(sets):
        bits = bits[:40]  # fewer bits still cover
        code = 15 if len(bits) >= 15 else 7 if len(bits) >= 7 else 3
        part = np.zeros(len(index), np.int64)
        for i, bit in enumerate(bits.tolist()):
            part |= (prints[bit // 64] >> np.uint64(bit % 64) & np.uint64(1)).astype(np.int64) << np.int64(i)
        syndrome = np.zeros(len(part), np.int64)
        for i in range(1, code + 1):
            syndrome ^= np.where((part >> (i - 1)) & 1, i, 0)
        every = np.ones(len(part), bool)
        off = syndrome > 0
        nearest = np.where(off, part ^ (np.int64(1) << np.maximum(syndrome - 1, 0)), part)
        add(k, every, nearest, True)
        if not near:
            continue
        for i in range(code, len(bits)):  # one bit outside the code differs
            add(k, every, nearest ^ (np.int64(1) << i), False)
        for i in range(1, code + 1):  # codewords at distance two: flip i and its partner
            partner = syndrome ^ i
            where = off & (partner > i)
            add(k, where, part ^ (np.int64(1) << (i - 1)) ^ (np.int64(1) << np.maximum(partner - 1, 0)), False)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it reaches) for the links a-b; a node that is the smallest itself has no row."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        low = np.minimum(label[u], label[v])
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


#: What a row is in its tile.
_HOME, _MEMBER = 1, 2


def _links(starts: np.ndarray, prints: list[np.ndarray], node: np.ndarray, role: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between homes and members of the groups of rows that begin at ``starts``."""
    group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(node)]))
    member, home = np.flatnonzero(role & _MEMBER), np.flatnonzero(role & _HOME)
    sizes = np.bincount(group[member], minlength=len(starts))
    first = np.cumsum(sizes) - sizes
    home = home[sizes[group[home]] > 0]
    a = b = np.empty(0, np.int64)
    ends = np.cumsum(sizes[group[home]])
    at = 0
    while at < len(home):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        part = home[at:to]
        sized = sizes[group[part]]
        left = np.repeat(part, sized)
        right = member[np.repeat(first[group[part]] - np.cumsum(sized) + sized, sized) + np.arange(sized.sum())]
        apart = np.zeros(len(left), np.uint16)
        for k, plane in enumerate(prints):
            if k > 1:  # two planes tell nearly all pairs apart
                close = apart <= threshold
                left, right, apart = left[close], right[close], apart[close]
            apart = apart + np.bitwise_count(plane[left] ^ plane[right])
        close = (apart <= threshold) & (node[left] != node[right])
        a, b = np.concatenate([a, node[left[close]]]), np.concatenate([b, node[right[close]]])
        if len(a) > PAIRS:
            a, b = forest(a, b)
        at = to
    return forest(a, b) if len(a) else (a, b)


def links(distinct: DataFrame, threshold: int = 4, tile: int = TILE, planes: int = 1, least: float = 0.8) -> DataFrame:
    """Columns ``a`` > ``b``: a forest, anchor by anchor, of the links between the rows (fp, ..., node).

    Rows link within ``threshold`` bits of all their fingerprints together. With one plane no link is missed;
    with several, two texts of similarity ``least`` miss each other's anchors with a chance of 2 %.
    An anchor with more than ``tile`` members is dealt in tiles of homes and members, so that no task holds it all.
    """
    names = _names(planes)
    prints = distinct.count()
    sets = exact_sets(threshold, prints) if planes == 1 else sampled_sets(planes, least, prints)
    near = min(1, threshold)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):  # a row becomes dozens
                part = batch.slice(at, 2000)
                node = part.column("node").to_numpy(zero_copy_only=False)
                columns = [part.column(n).to_numpy(zero_copy_only=False) for n in names]
                rows, keys, homes = anchors([c.view(np.uint64) for c in columns], sets, near)
                yield pa.RecordBatch.from_pydict({"anchor": pa.array(keys), "node": pa.array(node[rows]), "home": pa.array(homes)} | {n: pa.array(c[rows]) for n, c in zip(names, columns, strict=True)})

    spreaded = arrow_map(distinct.select(*names, "node"), spread, "anchor long, node long, home boolean, " + ", ".join(f"{n} long" for n in names))
    hot = cut_lineage(spreaded.groupBy("anchor").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > tile))
    home = F.when(F.col("home"), _HOME | _MEMBER).otherwise(_MEMBER)
    if hot.isEmpty():
        dealt = spreaded.select("anchor", F.lit(0).alias("i"), F.lit(0).alias("j"), home.alias("role"), "node", *names)
    else:
        parts = F.ceil(F.coalesce(F.col("members"), F.lit(1)) / tile).cast("int")
        placed = spreaded.join(hot, "anchor", "left").withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int"))
        placed = placed.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        tiled = lambda i, j, role: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), role.alias("role"))
        other = F.col("home") & (F.col("p") != F.col("own"))
        as_member = tiled("p", "own", F.when(other, _MEMBER).otherwise(home))
        cells = F.when(other, F.array(as_member, tiled("own", "p", F.lit(_HOME)))).otherwise(F.array(as_member))
        dealt = placed.withColumn("cell", F.explode(cells)).select("anchor", "cell.*", "node", *names)
    dealt = dealt.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def found(starts, place, node, role, *prints) -> pa.RecordBatch:
            a, b = _links(starts, [p.view(np.uint64) for p in prints], node, role, threshold)
            return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        for batch in batches:
            if not batch.num_rows:
                continue
            column = lambda n, batch=batch: batch.column(n).to_numpy(zero_copy_only=False)
            now = [np.stack([column("anchor"), column("i"), column("j")], axis=1), column("node"), column("role"), *map(column, names)]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            starts = np.flatnonzero(np.r_[True, (now[0][1:] != now[0][:-1]).any(axis=1)])
            last = int(starts[-1])
            rest = [x[last:].copy() for x in now]  # the last tile may go on in the next batch
            if last:
                yield found(starts[:-1], *(x[:last] for x in now))
        if rest is not None:
            yield found(np.zeros(1, np.int64), *rest)

    return arrow_map(dealt, compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of edges a > b that are not the smallest of their component.

    Alternating star contraction: every node hands its larger neighbours to its smallest one, then its
    smaller neighbours, until nothing moves. Each round is written, and the one before it deleted.
    """
    now = stored(edges.select("a", "b").distinct(), "edges")
    before = None
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, now = now, stored(moved.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        release(last)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, threshold: int = 4, seed: int = 42, planes: int = 1) -> DataFrame:
    """One row per input row: ``id_col``, ``fingerprint`` (16 hex digits) and ``component_id``.

    The component is the smallest id reachable through links of at most ``threshold`` differing bits; with ``planes``
    above 1, of several independent fingerprints together (``links``).
    Null or blank texts have fingerprint zero and link like any other. Repeated rows give repeated
    results. Rows with a null id take the component of the fingerprint they share with other rows, and
    null if there is none. An empty table gives an empty result. Other columns are not looked at.
    """
    prints = cut_lineage(fingerprints(docs, id_col, text_col, width, seed, planes))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return _with_components(prints, id_col, threshold, planes).select(id_col, hexed, "component_id")


def _with_components(prints: DataFrame, id_col: str, threshold: int, planes: int, least: float = 0.8) -> DataFrame:
    """The rows (id, fp, ...) with ``component_id``, the smallest id of the component, null if no row of it has an id."""
    names = _names(planes)
    distinct = cut_lineage(prints.groupBy(*names).agg(F.min(id_col).cast("long").alias("node")))
    roots = components(links(distinct.where("node is not null"), threshold, planes=planes, least=least))
    of_print = cut_lineage(distinct.join(roots, "node", "left").select(*(F.col(n).alias(f"of_{n}") for n in names), F.coalesce("root", "node").alias("component_id")))
    same = [F.col(n) == F.col(f"of_{n}") for n in names]
    return prints.join(of_print, same).select(*prints.columns, "component_id")


def shingle_set(text: bytes | None, width: int) -> frozenset[int]:
    """Hashes of the distinct shingles; a shorter text is one shingle, no words none."""
    words = text.translate(LOWER).split() if text else []
    return frozenset(xxhash.xxh64_intdigest(b" ".join(words[k : k + width])) for k in range(max(1, len(words) - width + 1))) if words else frozenset()


def similarity(a: frozenset[int], b: frozenset[int]) -> float:
    """Jaccard similarity; two empty sets are equal."""
    return len(a & b) / len(a | b) if a or b else 1.0


#: Most centres of a component in one round; each is compared with all that is left of the component.
CENTRES = 64
#: Fingerprints that groups are drawn by, and by how many deviations a pair of the least similarity may differ more
#: than it is expected to. Sharper ones for what is left of a group tell texts apart that share no more than a part.
LEVELS = ((3, 1.4), (8, 2.0), (16, 2.0))


def bits_apart(planes: int, least: float, deviations: float) -> int:
    """Bits in which texts of that similarity differ at most, up to so many deviations above the expectation."""
    differ, bits = math.acos(min(1.0, 2 * least / (1 + least))) / math.pi, 64 * planes
    return math.floor(bits * differ + deviations * math.sqrt(bits * differ * (1 - differ)))


def _digest(text: Column) -> list[Column]:
    """A text's MD5 as two longs ``m1`` and ``m2``; null is the empty text."""
    md5 = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return [F.conv(F.substring(md5, at, 16), 16, -10).cast("long").alias(name) for at, name in ((1, "m1"), (17, "m2"))]


def _alike(pairs: DataFrame, width: int, least: float) -> DataFrame:
    """(k, rep) of the pairs whose texts ``t`` and ``rt`` are at least that similar."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep, last, known = [], None, frozenset()
        for rep, text, other in zip(batch.column("rep").to_pylist(), byte_rows(batch.column("t")), byte_rows(batch.column("rt")), strict=True):
            if rep != last:
                last, known = rep, shingle_set(other, width)
            keep.append(similarity(shingle_set(text, width), known) >= least)
        return batch.select(["k", "rep"]).filter(pa.array(keep))

    return map_arrow(pairs.select("k", "rep", "t", "rt"), work, "k long, rep long")


def _majority(fp: str, n: str) -> Column:
    """The bits that most fingerprints of a group have, each counted ``n`` times."""
    bits = [F.when(F.sum(F.shiftrightunsigned(fp, k).bitwiseAND(F.lit(1).cast("long")) * F.col(n)) * 2 > F.sum(n), F.lit(((1 << k) ^ (1 << 63)) - (1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for k in range(64)]
    while len(bits) > 1:
        bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2], strict=True)]
    return bits[0]


def _apart(members: DataFrame, found: DataFrame, centres: int, width: int, least_similar: float) -> tuple[DataFrame, DataFrame]:
    """One round over groups (k, c, d, n, fp, m1, m2) with the texts ``found`` (k, t): the documents
    (d, m1, m2) that go, and the groups that are left with two texts or more."""
    major = stored(members.groupBy("c").agg(_majority("fp", "n").alias("major")), "majority")
    order = F.struct(F.bit_count(F.col("fp").bitwiseXOR(F.col("major"))).alias("away"), "d", "k")
    part = F.pmod(F.xxhash64("k"), F.lit(centres))
    first = stored(members.join(major, "c").groupBy("c", part.alias("part")).agg(F.min(order).alias("at")).select("c", "at", F.col("at.k").alias("rep")), "centres")
    pairs = stored(members.join(first.select("c", "rep"), "c").where("k <> rep").select("k", "rep"), "pairs")
    with_text = pairs.join(found, "k").join(found.select(F.col("k").alias("rep"), F.col("t").alias("rt")), "rep")
    alike = stored(_alike(with_text, width, least_similar), "alike")
    # a centre like one before it in the order isn't one
    ranks = first.select("rep", "at")
    like = alike.join(ranks, "rep").join(first.select(F.col("rep").alias("k"), F.col("at").alias("own")), "k").where("own > at").select(F.col("k").alias("rep")).distinct()
    valid = stored(ranks.join(like, "rep", "left_anti"), "valid")
    taken = alike.join(valid, "rep").groupBy("k").agg(F.min("at").alias("at")).select("k", F.col("at.k").alias("rep"))
    taken = stored(taken.union(valid.select(F.col("rep").alias("k"), "rep")), "taken")
    classes = stored(taken.join(members, "k").select("k", "rep", "d", "m1", "m2"), "classes")
    # the smallest id of a class stays, unless a text outside the class is like it; then the centre does
    least = classes.groupBy("rep").agg(F.min(F.struct("d", "k")).alias("least")).select("rep", F.col("least.k").alias("least"))
    least = stored(least.where("rep <> least").join(members.select(F.col("k").alias("rep"), "c"), "rep"), "least")
    outside = members.select("k", "c").join(taken.withColumnRenamed("rep", "own"), "k", "left").join(least, "c").where("own is null or own <> rep")
    outside = stored(outside.select("k", F.col("least").alias("rep")), "outside")
    texts_outside = outside.join(found, "k").join(found.select(F.col("k").alias("rep"), F.col("t").alias("rt")), "rep")
    unlike = least.join(_alike(texts_outside, width, least_similar).select(F.col("rep").alias("least")).distinct(), "least", "left_anti")
    stays = stored(valid.select("rep").join(unlike, "rep", "left").select("rep", F.coalesce("least", "rep").alias("stays")), "stays")
    gone = stored(classes.join(stays, "rep").where("k <> stays").select("d", "m1", "m2"), "near")
    rest = stored(members.join(taken.select("k"), "k", "left_anti"), "rest")
    left = stored(rest.join(rest.groupBy("c").count().where("count > 1").select("c"), "c").select(*members.columns), "left")
    release(major, first, pairs, alike, valid, taken, classes, least, outside, stays, rest)
    return gone, left


def _groups(texts: DataFrame, prints: DataFrame, level: tuple[int, float], least: float) -> DataFrame:
    """(k, c, d, n, fp, m1, m2) of the texts that are linked to others by the fingerprints of a level."""
    planes, deviations = level
    grouped = stored(_with_components(prints, "k", bits_apart(planes, least, deviations), planes, least).select("k", F.col("component_id").alias("c")), "components")
    large = grouped.groupBy("c").count().where("count > 1").select("c")
    members = stored(grouped.join(large, "c").join(texts.select("k", "d", "n", "fp", "m1", "m2"), "k"), "groups")
    release(grouped)
    return members


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8, levels: Sequence[tuple[int, float]] = LEVELS) -> DataFrame:
    """The rows without near copies: all columns as they are, one row left of each group.

    A document is an id with a text. Of equal texts the smallest id stays. Groups of the texts left come from
    several fingerprints that together differ in no more bits than texts of similarity ``least`` do (``bits_apart``). A
    group's centre is the text whose fingerprint is nearest to the majority of the group's bits; the texts at least ``least``
    similar to it in shingles are one class with it, and the smallest id of the class stays, or the centre if a text
    outside the class is like that of the smallest id: no two texts of a group stay that are alike. What is unlike the
    centre is drawn into groups anew, by the more fingerprints of the next of ``levels``; after the last, it is a group of its
    own, until none has two texts, with twice as many centres from round to round, up to ``CENTRES``. Different texts under one id are documents of their own; of rows with
    equal id and text the least stays, in the order of their JSON. Null and empty texts are equal texts. Rows with a null id stay. An
    empty table gives an empty result.
    """
    planes, names = levels[0][0], _names(levels[0][0])
    d = F.col(id_col).cast("long")
    rows = docs.select(d.alias("d"), F.col(text_col).alias("t")).where("d is not null").select("d", *_digest(F.col("t")), "t")
    prints = fingerprints(rows.select(F.struct("d", "m1", "m2").alias("i"), "t"), "i", "t", width, planes=planes)
    prints = stored(prints.select("i.*", *names), "prints")
    again = stored(prints.groupBy("d", "m1", "m2").count().where("count > 1").select("d", "m1", "m2"), "again")
    texts = prints.groupBy("m1", "m2", *names).agg(F.min("d").alias("d"), F.count(F.lit(1)).alias("n"))
    texts = stored(texts.withColumn("k", F.monotonically_increasing_id()), "texts")
    copied = stored(texts.where("n > 1").select("m1", "m2", F.col("d").alias("stays")), "copied")
    parts = [stored(prints.join(small(copied), ["m1", "m2"]).where("d > stays").select("d", "m1", "m2"), "copies")]

    members = _groups(texts, texts.select("k", *names), levels[0], least)
    release(copied)
    found = rows.join(small(members.select("k", "d", "m1", "m2"), BROADCAST_ROWS * 3 // 4), ["d", "m1", "m2"]).select("k", "t")
    found = stored(found if again.isEmpty() else found.dropDuplicates(["k"]), "members")
    centres, further = 1, list(levels[1:])
    while not members.isEmpty():
        near, left = _apart(members, found, centres, width, least)
        parts.append(near)
        release(members)
        if further and not left.isEmpty():
            level = further.pop(0)
            sharper = stored(fingerprints(found.join(left.select("k"), "k"), "k", "t", width, planes=level[0]), "sharper")
            members = _groups(left, sharper, level, least)
            release(left, sharper)
        else:
            members, centres = left, min(CENTRES, centres * 2)
    gone = parts[0]
    for part in parts[1:]:
        gone = gone.union(part)
    gone = stored(gone.distinct(), "gone")
    release(prints, texts, found, members, *parts)
    own = dict(zip(("__m1", "__m2"), _digest(F.col(text_col)), strict=True)) | {"__d": d}
    key = list(own)
    named = lambda df: df.select(*(F.col(x.lstrip("_")).alias(x) for x in key))
    kept = docs.withColumns(own).join(small(named(gone)), key, "left_anti")
    if again.isEmpty():
        return kept.select(*docs.columns)
    repeated = named(again)
    once = kept.join(small(repeated), key, "left_semi").groupBy(*key).agg(F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*docs.columns))).alias("__row"))
    return kept.join(small(repeated), key, "left_anti").select(*docs.columns).unionByName(once.select("__row.*"))
