"""Universes, requests, cycles, profile states, labels and ablations."""

import random

from pyspark.sql import functions as F

from loomwork.operators import dependency, evaluate, evidence, feasibility, lexicons, ranking, universe
from loomwork.sources import associations, matrices


def test_augment_keeps_flags_and_carries_the_disease(spark):
    base = spark.createDataFrame([("AAA", 0.4, None, "D1", "other"), ("BBB", None, True, None, None)], "symbol string, score double, has_evidence boolean, disease_id string, source string")
    required = spark.createDataFrame([("bbb",), ("ccc",)], "s string")
    rows = {r.symbol: (r.score, r.has_evidence, r.disease_id, r.source) for r in universe.augment(base, required, "symbol", "score").collect()}
    assert rows == {"AAA": (0.4, False, "D1", "other"), "BBB": (None, True, None, "association"), "CCC": (0.0, False, "D1", "required_symbol")}


def test_repeated_requests_are_told_without_a_window(spark):
    requests = spark.createDataFrame([("a", 1), ("A ", 2), ("a", 1), (None, 3), ("", 4), ("b", 5), ("zz", 6), ("zz", 7)], "q string, n int")
    labels = spark.createDataFrame([("A", "la"), ("B", "l1"), ("B", "l2")], "k string, label string")
    found = universe.resolve(requests, labels, "q", "k", "label")
    assert sorted((r.n, r.state) for r in found.collect()) == [(1, "duplicate"), (1, "duplicate"), (2, "resolved"), (3, "invalid"), (4, "invalid"), (5, "ambiguous"), (6, "unresolved"), (7, "unresolved")]
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


def plain_cycles(edges):
    """{node: largest node of its cycle} by reachability."""
    nodes = {x for e in edges for x in e}
    up = {n: {p for c, p in edges if c == n} for n in nodes}

    def reach(n):
        seen, todo = set(), list(up[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += up[x]
        return seen

    far = {n: reach(n) for n in nodes}
    return {n: max(m for m in nodes if m in far[n] and n in far[m]) for n in nodes if n in far[n]}


def test_cycles_apart_from_their_tails(spark):
    rng = random.Random(7)
    cases = [
        [("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("y", "x"), ("p", "q"), ("q", "p"), ("a", "p"), ("root", "top"), ("z", "z"), ("z", "w")],
        [(f"n{rng.randint(0, 25):02d}", f"n{rng.randint(0, 25):02d}") for _ in range(34)],
        [("a", "b")],
    ]
    for edges in cases:
        got = {r.node: r.cycle for r in evidence.cycle_members(spark.createDataFrame(edges, "child string, parent string")).collect()}
        assert got == plain_cycles(set(edges))


def test_every_profile_state(spark):
    names = ["ok", "gaps", "", "nofetch", "moved", "none", "many", "bad", "failed", "norecord", "shape", "norm", "profile", "other", "unfetched"]
    requests = spark.createDataFrame([(f"r{k}", n, "gene_symbol", "1") for k, n in enumerate(names)], "request_id string, target string, id_type string, source_release string")
    state = {"none": "unresolved", "many": "ambiguous", "bad": "invalid_identifier", "failed": "retrieval_failed"}
    resolutions = spark.createDataFrame([(n, "gene_symbol", state.get(n, "resolved_exact"), n) for n in names], "target string, id_type string, status string, resolved_id string")
    records = spark.createDataFrame([(n, "2" if n == "other" else "1", True, n != "shape", n != "norm", n != "profile") for n in names if n != "norecord"], "resolved_id string, release string, verified boolean, shape_ok boolean, normalized boolean, profile_ok boolean")
    covered = spark.createDataFrame([(n, "partial" if n == "gaps" else "observed") for n in names], "target string, state string")
    fetches = spark.createDataFrame([(n, "gene_symbol", n != "nofetch", "mismatch" if n == "moved" else "verified") for n in names if n != "unfetched"], "target string, id_type string, fetch_ok boolean, release_state string")
    got = {r.target: r.status for r in feasibility.profile_status(requests, resolutions, records, covered, fetches).collect()}
    assert got == {
        "ok": "built", "gaps": "built_with_gaps", "": "invalid_request", "nofetch": "invalid_fetch_result", "moved": "source_release_mismatch", "none": "target_unresolved", "many": "target_ambiguous", "bad": "target_invalid", "failed": "target_retrieval_failed",
        "norecord": "target_record_missing", "shape": "unsupported_source_shape", "norm": "normalization_failed", "profile": "invalid_profile", "other": "source_release_mismatch", "unfetched": "invalid_fetch_result",
    }
    assert {*got.values()} == {*feasibility.PROFILE_STATES}


def test_labels_that_look_like_repeats(spark, tmp_path):
    (tmp_path / "m.csv").write_text("ModelID,ABC,ABC#2,ABC,X#9\nm1,1,2,3,4\n")
    wide = matrices.read_wide(spark, str(tmp_path / "m.csv"))
    assert wide.columns == ["ModelID", "ABC", "ABC#2", "ABC#3", "X#9"] and tuple(wide.first()) == ("m1", "1", "2", "3", "4")
    assert [(r.name, r.label, r.state) for r in matrices.label_index(wide, "ModelID").orderBy("place").collect()] == [("ABC", "ABC", "duplicate_label"), ("ABC#2", "ABC#2", "malformed"), ("ABC#3", "ABC", "duplicate_label"), ("X#9", "X#9", "malformed")]


def test_the_worst_of_several_results_counts(spark):
    asked = spark.createDataFrame([("q",), ("r",)], "query string")
    answers = spark.createDataFrame([("q", 200, 3), ("q", 503, None), ("r", 200, 0)], "query string, status_code int, hit_count int")
    for df in (answers, answers.orderBy(F.desc("status_code"))):
        assert [(r.query, r.status, r.error_category) for r in associations.search_attempts(asked, df).orderBy("query").collect()] == [("q", "failed", "server_error"), ("r", "success_zero_results", None)]


def test_ablations_rank_all_subsets_at_once(spark):
    rng = random.Random(2)
    rows = [(k, k + 1 if k % 9 else None, rng.random(), rng.random() if k % 3 else None) for k in range(60)]
    df = spark.createDataFrame(rows, "id int, baseline_rank int, e double, p double").repartition(3)
    variants = {"both": {"e": True, "p": False}, "e": {"e": True}, "up": {"e": False}, "none": {"p": False}}
    got = {r.ablation: r for r in dependency.ablations(df, "id", variants, 1, 10).collect()}
    for name, components in variants.items():
        signed = ranking.reversed_signal(df, "id", components, 1, "s")
        ranked = ranking.signal_rank(signed, "s", "baseline_rank", "id", "a")
        want = ranking.membership_changes(ranked, [], "baseline_rank", "a", 10).first()
        assert abs(got[name].spearman - want.spearman) < 1e-12 and got[name].jaccard == want.jaccard and got[name].components == "|".join(components)
        assert got[name].eligible == ranked.where("s is not null and baseline_rank is not null").count()
    jobs = []
    for some in ({"e": {"e": True}}, variants):
        group = f"ablations-{len(some)}"
        spark.sparkContext.setJobGroup(group, group)
        dependency.ablations(df, "id", some, 1, 10)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[0] == jobs[1]


def test_confusion_has_all_pairs(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "a"), ("c", "a")], "x string, y string")
    assert sorted(map(tuple, evaluate.role_confusion(df, "x", "y").collect())) == [("a", "a", 1), ("a", "b", 1), ("a", "c", 0), ("b", "a", 0), ("b", "b", 0), ("b", "c", 0), ("c", "a", 1), ("c", "b", 0), ("c", "c", 0)]


def test_pages_end_where_a_reader_would(spark):
    pages = [("short", 0, [1, 2], 3), ("short", 1, [3], 3), ("short", 2, [9], 3), ("empty", 0, [1], 9), ("empty", 1, [], 9), ("empty", 2, [5], 9), ("gap", 0, [1], 9), ("gap", 2, [5], 9), ("late", 1, [1], 1), ("many", 0, [1], 9), ("many", 1, [2], 9), ("many", 2, [3], 9), ("many", 3, [4], 9), ("twice", 0, [2], 1), ("twice", 0, [1], 1), ("none", 0, None, 0)]
    df = spark.createDataFrame(pages, "q string, page int, rows array<int>, declared int")
    members, states = associations.pages_read(df, "q", "page", "rows", "declared", 3)
    got = {r.q: (r.n_pages, r.n_rows, r.ended, r.complete) for r in states.collect()}
    assert got == {"short": (2, 3, "count_reached", True), "empty": (2, 1, "empty_page", False), "gap": (1, 1, "page_missing", False), "late": (0, 0, "page_missing", False), "many": (3, 3, "page_limit", False), "twice": (1, 1, "count_reached", True), "none": (1, 0, "count_reached", True)}
    assert sorted((r.q, r.page, r.place, r.member) for r in members.collect()) == [("empty", 0, 0, 1), ("gap", 0, 0, 1), ("many", 0, 0, 1), ("many", 1, 0, 2), ("many", 2, 0, 3), ("short", 0, 0, 1), ("short", 0, 1, 2), ("short", 1, 0, 3), ("twice", 0, 0, 1)]


def test_thousands_of_markers(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcé") for _ in range(n))
    markers = sorted({word(rng.randint(2, 7)) for _ in range(9000)})[:5000]
    table = [(m if k % 2 else m.upper(), f"c{k % 50}", rng.choice(["blocker", "warning", None])) for k, m in enumerate(markers)] + [(markers[0], "other", "note"), ("", "x", "y"), (None, "x", "y")]
    texts = [" ".join(word(rng.randint(1, 12)).upper() for _ in range(30)) for _ in range(60)] + [None, "", "zzz"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(3)
    lexicon = spark.createDataFrame(table, "marker string, code string, severity string")
    want = sorted((k, m.lower(), c, s or "") for k, t in enumerate(texts) for m, c, s in table if m and t and m.lower() in t.lower())
    for block in (lexicons.BLOCK_BYTES, 100_000):
        got = sorted((r.k, r.marker, r.code, r.severity or "") for r in lexicons.marker_hits(df, ["k"], "t", lexicon, block).collect())
        assert got == want and len(want) > 10_000
    audit = {r.k: (r.n_markers, r.decision) for r in lexicons.lexicon_audit(df, "k", "t", lexicon).collect()}
    assert len(audit) == len(texts) and audit[60] == audit[61] == audit[62] == (0, "pass")
    assert lexicons.marker_hits(df, ["k"], "t", lexicon.limit(0)).count() == 0
