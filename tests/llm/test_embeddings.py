import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import embeddings, queries

SF = "/root/testdata/sf0.01"


def brute(vectors, least=0.9):
    """(links, component) of each row by comparing all pairs; None links with nothing."""
    n = len(vectors)
    links, up = [0] * n, list(range(n))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(n):
        for j in range(i):
            a, b = vectors[i], vectors[j]
            if a is not None and b is not None and len(a) == len(b) and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                links[i] += 1
                links[j] += 1
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return links, [root(k) for k in range(n)]


def clusters(rng, dim, groups, most):
    out = []
    for _ in range(groups):
        centre = rng.normal(size=dim)
        out += [centre + rng.normal(size=dim) * rng.uniform(0.05, 0.4) for _ in range(rng.integers(1, most + 1))]
    return [np.float32(v) for v in out]


@pytest.mark.parametrize(("dim", "tile", "homes"), [(64, 1024, 256), (48, 16, 256), (24, 1024, 1)])
def test_against_all_pairs(spark, dim, tile, homes):
    rng = np.random.default_rng(dim)
    vectors = clusters(rng, dim, 60, 12)
    vectors += [vectors[3]] * 5 + [vectors[10] * 2] * 3
    links, component = brute([v.astype(float) for v in vectors])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(5)
    got = {r.vec_id: r for r in embeddings.near_duplicate_vectors(df, tile=tile, homes=homes).collect()}
    assert len(got) == len(vectors)
    assert all(got[k].n_links <= n for k, n in enumerate(links))
    assert sum(r.n_links for r in got.values()) >= 0.98 * sum(links) > 100
    assert np.mean([got[k].component_id == c for k, c in enumerate(component)]) >= 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_every_pair_counts_once_in_tiles(spark):
    """One group whose members all meet in every table."""
    rng = np.random.default_rng(1)
    centre = rng.normal(size=32)
    vectors = [(k, (centre + rng.normal(size=32) * 0.05).tolist()) for k in range(150)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(4)
    for tile in (8, 40, 1024):
        got = embeddings.near_duplicate_vectors(df, tile=tile).collect()
        assert {(r.n_links, r.component_id) for r in got} == {(149, 0)}


def test_registered_query(spark):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    links, component = brute([np.array(rows[k], float) for k in sorted(rows)])
    got = sorted(queries.op11_embeddings(spark, SF).collect())
    assert [(r.vec_id, r.n_links, r.component_id) for r in got] == [(i, n, sorted(rows)[c]) for i, n, c in zip(sorted(rows), links, component, strict=True)]


def test_recall_at_the_threshold():
    """Pairs of exactly the least cosine are met, whatever the number of hashes."""
    rng = np.random.default_rng(3)
    a = rng.normal(size=(1000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(axis=1)[:, None] * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1)[:, None]
    for vectors in (1000, 1_000_000, 10**8):
        scheme = embeddings.Scheme(vectors, 0.9, 2, 0.01)
        meets, _ = embeddings.met(scheme.codes(a, 64), scheme.codes(b, 64))
        assert meets.any(axis=1).mean() >= 0.97
        apart = np.bitwise_count(scheme.sketches(a) ^ scheme.sketches(b)).sum(axis=1)
        assert (apart <= scheme.sketch_bits()).mean() >= 0.999
    assert [embeddings.hashes_for(n, 64) for n in (1000, 1_000_000, 10**8)] == [1, 2, 3]


def test_rotations_keep_lengths():
    x = embeddings.unit(np.array([[3.0, 4.0, 0.0], [1e200, 0, 1e200], [5e-320, 0, 0]]))
    assert np.allclose((x * x).sum(axis=1), 1) and np.allclose((embeddings.rotate(x, 5) ** 2).sum(axis=1), 1)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, []), (5, [0.0, 0.0]), (5, [0.0, 0.0]), (6, [nan, 1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [2.0, 4.0]), (None, [0.0, -1.0]), (9, [1.0, 2.0, 0.0]), (0, [-1.0, -2.0]), (10, [2e-310, 4e-310])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, label string, n_links int")
    got = embeddings.near_duplicate_vectors(df)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    found = sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id, r.kept) for r in got.collect() if r.vec_id is not None)
    want = [(0, 0, 0, True), (1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (5, 0, 5, True), (6, 0, 6, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (10, 4, 1, False)]
    assert found == want
    assert sorted((r.n_links, r.component_id, r.kept) for r in got.where("vec_id is null").collect()) == [(0, None, True), (4, 1, False)] or {(r.n_links, r.component_id) for r in got.where("vec_id is null").collect()} == {(0, None), (4, 1)}
    assert embeddings.near_duplicate_vectors(df.where(F.lit(False))).count() == 0
