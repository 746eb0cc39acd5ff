import hashlib
import random

from loomwork.llm import queries, substring

SF = "/root/testdata/sf0.01"


def brute(rows, width):
    """{id: (words, removed, digest)} by comparing all windows."""
    first = {}
    for d, text in rows:
        words = (text or "").encode().split()
        for k in range(len(words) - width + 1):
            w = tuple(words[k : k + width])
            if d is not None:
                first[w] = min(first.get(w, d), d)
    out = []
    for d, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - width + 1):
            if d is not None and first[tuple(words[k : k + width])] < d:
                gone[k : k + width] = [True] * width
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out.append((d, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = result(queries.op3_substring(spark, SF))
    assert got == brute(rows, 50)
    assert sum(r[2] for r in got) > 0


def test_random_passages(spark):
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(40)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(8, 40))] for _ in range(12)]
    rows = []
    for d in range(150):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(passages)[rng.randint(0, 4) :] if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 30))]
        rows.append((d, " ".join(words)))
    rows += [(150, rows[3][1]), (150, "x " * 30), (151, "x " * 31), (None, rows[5][1]), (152, None), (153, " \t\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for width in (8, 13):
        assert result(substring.substring_dedup(df, width=width)) == brute(rows, width)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, d long, tk string")
    assert substring.substring_dedup(empty).count() == 0
    assert substring.without_repeats(empty).columns == empty.columns
    text = " ".join(f"a{k}" for k in range(60))
    rows = [(1, text, 9, "k"), (2, f"before\n{text} behind", 8, None), (3, text, 7, "m"), (4, None, 6, "n")]
    out = {r.doc_id: r for r in substring.without_repeats(spark.createDataFrame(rows, empty.schema)).collect()}
    assert out[1].text == text and out[2].text == "before\nbehind" and 3 not in out and out[4].text is None
    assert (out[2].d, out[2].tk) == (8, None)


def test_many_repeated_keys_are_joined(spark, monkeypatch):
    rng = random.Random(3)
    shared = [[f"s{rng.randint(0, 30)}" for _ in range(70)] for _ in range(6)]
    rows = [(d, " ".join([f"w{rng.randint(0, 400)}" for _ in range(rng.randint(0, 60))] + rng.choice(shared) + [f"w{rng.randint(0, 400)}" for _ in range(20)])) for d in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    few = result(substring.substring_dedup(docs))
    monkeypatch.setattr(substring, "KEYS", 0)
    assert result(substring.substring_dedup(docs)) == few == brute(rows, 50)


def test_cut_words():
    import numpy as np

    assert substring.cut_words(b" a b\n c d ", np.array([False, True, False, True])) == b" a c "


def test_repeated_rows_hold_each_window_once(spark, monkeypatch):
    kept, write = {}, substring.stored
    monkeypatch.setattr(substring, "release", lambda *tables: None)
    monkeypatch.setattr(substring, "stored", lambda df, name: kept.setdefault(name, write(df, name)))
    passage = " ".join(f"p{k * k % 997}" for k in range(120))
    rows = [(1, f"{passage} ends here")] + [(2, f"here begins {passage}")] * 40
    _, hits = substring.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    found = [r.found for r in kept["found"].collect()]
    assert len(found) == 2 and all(len(x) == len(set(map(tuple, x))) for x in found)
    assert [(r.d, sorted(r.starts)) for r in hits.collect()] == [(2, list(range(2, 73)))]
