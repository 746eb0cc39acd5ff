import random
import re
import zlib

import numpy as np
import xxhash

from loomwork.llm import queries, simhash

SF = "/root/testdata/sf0.01"


def plain_fingerprint(text, width=4):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, threshold=4):
    """{id: smallest id reachable} by comparing all pairs."""
    ids = list(prints)
    up = {d: d for d in ids}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    values = np.array([prints[d] for d in ids], np.uint64)
    for k, d in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values[:k] ^ values[k]) <= threshold).tolist():
            a, b = sorted((root(d), root(ids[j])))
            up[b] = a
    return {d: root(d) for d in ids}


def test_whole_table(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    prints = {d: plain_fingerprint(t) for d, t in rows.items()}
    want = components(prints)
    got = queries.op1_simhash(spark, SF).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {d: f"{p:016x}" for d, p in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(rows)


def test_chains_and_tiles(spark):
    rng = random.Random(9)
    prints = []
    for _ in range(40):
        p = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            prints.append(p)
            for b in rng.sample(range(64), rng.randint(1, 6)):
                p ^= 1 << b
    prints = list(dict.fromkeys(prints))
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame(list(zip(signed, range(len(prints)), strict=True)), "fp long, node long").repartition(3)
    for threshold, tile in ((4, 4096), (4, 2), (7, 4096), (3, 5), (0, 9)):
        roots = {r.node: r.root for r in simhash.components(simhash.links(df, threshold, tile)).collect()}
        want = components(dict(enumerate(prints)), threshold)
        assert {d: roots.get(d, d) for d in want} == want


def test_planes_link_together(spark):
    rng = random.Random(12)
    flip = lambda p, n: p ^ sum(1 << b for b in rng.sample(range(63), n))
    rows = [(rng.getrandbits(63), rng.getrandbits(63), rng.getrandbits(63), k) for k in range(60)]
    rows += [tuple(flip(p, n) for p, n in zip(rows[k][:3], (8, 2, 5), strict=True)) + (60 + k,) for k in range(20)]
    rows += [tuple(flip(p, 20) for p in rows[k][:3]) + (80 + k,) for k in range(20)]
    df = spark.createDataFrame(rows, "fp long, fp1 long, fp2 long, node long").repartition(3)
    for tile in (4096, 2):
        roots = {r.node: r.root for r in simhash.components(simhash.links(df, 20, tile, planes=3)).collect()}
        assert set(roots.items()) <= {(60 + k, k) for k in range(20)} and len(roots) >= 18


def test_hot_anchor_is_tiled(spark):
    """50,000 fingerprints on one anchor: only tiles of homes and members meet, and all links are found."""
    rng = np.random.default_rng(6)
    low = int(rng.integers(0, 1 << 20))
    high = rng.choice(1 << 42, 49_000, replace=False).astype(np.int64)
    prints = np.unique((high << 21) | low)
    prints = np.unique(np.r_[prints, prints[:1000] ^ (np.int64(7) << np.int64(30))])
    df = spark.createDataFrame([(p, k) for k, p in enumerate(prints.tolist())], "fp long, node long").repartition(4)
    edges = simhash.links(df, 4, planes=1)
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    place = {p: k for k, p in enumerate(prints.tolist())}
    for p in prints.tolist():
        q = p ^ 7 << 30
        if q in place:
            assert roots.get(place[p], place[p]) == roots.get(place[q], place[q])


def test_recall_near_the_bound(spark):
    """Pairs of texts of similarity 0.8 to 0.85 among many others."""
    rng = random.Random(31)
    word = lambda: f"w{rng.randint(0, 20000)}"
    texts, pairs = [], []
    while len(pairs) < 150:
        t = [word() for _ in range(300)]
        u = list(t)
        for k in rng.sample(range(300), 7):
            u[k] = word()
        s = simhash.similarity(*(simhash.shingle_set(" ".join(x).encode(), 5) for x in (t, u)))
        if 0.8 <= s <= 0.85:
            pairs.append((len(texts), len(texts) + 1))
            texts += [t, u]
    texts += [[word() for _ in range(300)] for _ in range(600)]
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    assert kept >= set(range(len(texts))) - {b for _, b in pairs}
    assert sum(b not in kept for _, b in pairs) >= 0.9 * len(pairs)


def test_anchors_cover():
    rng = np.random.default_rng(0)
    for threshold in (1, 2, 4, 5, 7):
        x = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
        y = x.copy()
        for k in range(300):
            for b in rng.choice(64, threshold, replace=False):
                y[k] ^= np.uint64(1) << np.uint64(b)
        for prints in (0, 1 << 25, 1 << 33):  # wider sets of bits for more fingerprints
            sets = simhash.exact_sets(threshold, prints)
            rows, keys, homes = simhash.anchors([x], sets)
            home = {(r, k) for r, k, h in zip(rows.tolist(), keys.tolist(), homes.tolist(), strict=True) if h}
            rows, keys, _ = simhash.anchors([y], sets)
            met = {r for r, k in zip(rows.tolist(), keys.tolist(), strict=True) if (r, k) in home}
            assert len(met) == 300
    assert [len(simhash.exact_sets(4, n)) for n in (0, 1 << 25, 1 << 33)] == [3, 10, 20]


def test_edges(spark):
    rows = [(3, None), (5, ""), (4, " \n"), (7, "one"), (7, "one"), (9, "ONE"), (None, "one"), (None, "lonely text")]
    docs = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, fp string")
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicate_components(docs).collect()}
    one = f"{plain_fingerprint('one'):016x}"
    assert got[(3, "0" * 16)] == got[(5, "0" * 16)] == got[(4, "0" * 16)] == 3
    assert got[(7, one)] == got[(9, one)] == got[(None, one)] == 7
    assert simhash.near_duplicate_components(docs).count() == len(rows)
    assert simhash.near_duplicate_components(docs.limit(0)).count() == 0


def test_one_of_each(spark):
    rng = random.Random(2)
    text = lambda n: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(n))
    long = text(400)
    near = long.replace(long.split()[200], "changed", 1)
    rows = [(1, long), (2, long), (3, near), (4, text(300)), (5, "short"), (6, "short"), (6, "short"), (None, "short"), (8, None), (9, None)]
    docs = spark.createDataFrame([(d, t, zlib.crc32(str(d).encode())) for d, t in rows], "doc_id long, text string, c long")
    kept = simhash.one_of_each(docs).collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted([1, 4, 5, None, 8], key=str) and kept[0].c is not None
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_ten_classes_in_one_component(spark):
    """Equal halves give all texts nearly one fingerprint; their other halves make ten classes."""
    rng = random.Random(4)
    same = " ".join(["the page of the site says"] * 200)
    tails = [[f"w{rng.randint(0, 9999)}" for _ in range(150)] for _ in range(10)]
    near = lambda t: " ".join([*t[:75], "changed", *t[76:]])
    rows = [(same + " " + (near(t) if copy == 3 else " ".join(t)), k) for copy in range(6) for k, t in enumerate(tails)]
    docs = spark.createDataFrame([(d, t, k) for d, (t, k) in enumerate(rows)], "doc_id long, text string, c long").repartition(3)
    assert len({r.component_id for r in simhash.near_duplicate_components(docs, width=5, threshold=36, planes=3).collect()}) == 1
    kept = simhash.one_of_each(docs).collect()
    assert sorted((r.doc_id, r.c) for r in kept) == [(k, k) for k in range(10)]


def test_null_and_repeated_ids(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(n))
    long, other, third = text(400), text(300), text(200)
    near = long.replace(long.split()[200], "changed", 1)
    alone = spark.createDataFrame([(None, other), (None, third), (1, long), (1, long)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in simhash.one_of_each(alone).collect()) == sorted([("None", other), ("None", third), ("1", long)])
    shared = spark.createDataFrame([(1, long), (2, near), (2, other), (2, third), (3, third), (3, third), (4, "a b"), (4, "a b")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in simhash.one_of_each(shared).collect()) == sorted([(1, long), (2, other), (2, third), (4, "a b")])
    twice = spark.createDataFrame([(4, "a b", "z"), (4, "a b", "y"), (4, "a b", None)], "doc_id long, text string, d string")
    assert [r.d for r in simhash.one_of_each(twice).collect()] == ["y"]


def test_no_kept_pair_is_alike(spark):
    """A is like C, variants of C and B, but B isn't like C; and mixed groups at random."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randint(0, 20000)}"

    def changed(words, at):
        return [word() if k in at else w for k, w in enumerate(words)]

    a = [word() for _ in range(300)]
    b, c = changed(a, range(270, 300)), changed(a, range(30))
    texts = [a, c, *(changed(c, {100 + k}) for k in range(4)), b]
    for _ in range(12):
        chain = [[word() for _ in range(300)]]
        for _ in range(6):
            at = rng.randint(0, 270)
            chain.append(changed(rng.choice(chain), range(at, at + 20)))
        texts += chain
    sets = [simhash.shingle_set(" ".join(t).encode(), 5) for t in texts]
    assert simhash.similarity(sets[0], sets[1]) >= 0.8 and simhash.similarity(sets[0], sets[6]) >= 0.8 > simhash.similarity(sets[1], sets[6])
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    kept = sorted(r.doc_id for r in simhash.one_of_each(docs).collect())
    linked = [(i, j) for j in range(len(texts)) for i in range(j) if simhash.similarity(sets[i], sets[j]) >= 0.8]
    left = [(i, j) for i, j in linked if i in kept and j in kept]
    assert not [p for p in left if p[1] < 7] and len(left) <= 0.1 * len(linked)
    assert {d for d in range(len(texts)) if not any(d in p for p in linked)} <= set(kept)
