"""The record store and trees of digests."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from loomwork.operators import merkle, store
from loomwork.plans import closure
from loomwork.sources import sinks
from loomwork.sources.store import RecordStore, StoreError

FIELDS = "id long, h string, b string"


def records(spark, ids, body="b"):
    return spark.createDataFrame([(i, f"h{i}", body) for i in ids], FIELDS)


def files_read(df):
    """Files of each Parquet scan of a plan, after its partition filters."""
    plan = df._jdf.queryExecution().executedPlan()
    df.write.format("noop").mode("overwrite").save()
    return re.findall(r"PartitionFilters: \[([^\]]*)\]", plan.toString())


def test_reads_name_the_partitions_they_touch(spark, tmp_path):
    made = RecordStore.create(spark, str(tmp_path / "s"), FIELDS, "id", "h", "b", "1", digits=2)
    made.append(records(spark, range(300)), "one")
    wanted = records(spark, [3, 77]).select("id")
    found = made.lookup(wanted)
    assert sorted(r.id for r in found.collect()) == [3, 77]
    prefixes = {hashlib.sha256(f"h{i}".encode()).hexdigest()[:2] for i in (3, 77)}
    (shown,) = {x for x in files_read(found) if "prefix" in x}
    assert all(p in shown for p in prefixes) and len(re.findall(r"\b[0-9a-f]{2}\b", shown)) == len(prefixes)
    # the partitions that an append is held against don't grow with the store
    seen = []
    touched = made._touched
    made._touched = lambda rows, column: seen.append(c := touched(rows, column)) or c
    made.append(records(spark, [900, 901]), "two")
    assert len(seen) == 2 and all(str(c).count(",") <= 2 for c in seen)
    assert {r.id for r in made.with_digest(records(spark, [900, 5])).collect()} == {900, 5}
    assert made.scan({"id": [1, 2]}).count() == 2 and made.items().count() == 302


def test_outcomes_and_repeated_batches(spark, tmp_path):
    made = RecordStore.create(spark, str(tmp_path / "s"), FIELDS, "id", "h", "b", "1", digits=1)
    first = {(r.id, r.outcome) for r in made.append(records(spark, [1, 2, 2]), "one").collect()}
    assert first == {(1, "new"), (2, "new"), (2, "duplicate")}
    rows = spark.createDataFrame([(1, "h1", "b"), (1, "other", "b"), (4, "h2", "x"), (5, "h5", "b"), (None, "h6", "b"), (7, None, "b")], FIELDS)
    want = {(1, "h1", "duplicate"), (1, "other", "rejected_mutation"), (4, "h2", "collision"), (5, "h5", "new"), (None, "h6", "new"), (7, None, "new")}
    for _ in range(2):
        assert {(r.id, r.h, r.outcome) for r in made.append(rows, "two").collect()} == want
        assert made.items().count() == 5 and made.audit().count() == 4
    assert made.append(records(spark, []), "three").count() == 0 and made.items().count() == 5


def test_opening_needs_the_same_versions_and_columns(spark, tmp_path):
    path = str(tmp_path / "s")
    with pytest.raises(StoreError, match="no store"):
        RecordStore.open(spark, path, "1")
    RecordStore.create(spark, path, FIELDS, "id", "h", "b", "1", digits=1).append(records(spark, [1]), "one")
    assert RecordStore.open(spark, path, "1", fields=FIELDS).items().count() == 1
    for bad in ({"version": "2"}, {"version": "1", "canonicalization": "2"}, {"version": "1", "fields": "id string, h string, b string"}):
        with pytest.raises(StoreError):
            RecordStore.open(spark, path, **bad)
    with pytest.raises(StoreError):
        RecordStore.create(spark, path, FIELDS, "id", "h", "b", "2")
    with pytest.raises(StoreError, match="digits"):
        RecordStore.create(spark, path + "x", FIELDS, "id", "h", "b", "1", digits=9)
    records(spark, [2]).drop("b").withColumn("prefix", F.lit("0")).withColumn("batch", F.lit("x")).write.mode("overwrite").partitionBy("prefix", "batch").parquet(path)
    with pytest.raises(StoreError, match="stored items"):
        RecordStore.open(spark, path, "1")


def test_tree_is_the_same_for_any_order(spark):
    df = spark.range(3000).select(F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    nodes = {(r.depth, r.prefix): (r.n_rows, r.hash) for r in merkle.tree(df, "id", "h").collect()}
    other = {(r.depth, r.prefix): (r.n_rows, r.hash) for r in merkle.tree(df.repartition(7).orderBy(F.desc("h")), "id", "h").collect()}
    assert nodes == other and max(d for d, _ in nodes) == 1 and nodes[0, ""][0] == 3000 and len(nodes) == 17
    entry = lambda k: hashlib.sha256(f'{{"k":"{k}","d":"{hashlib.sha256(str(k).encode()).hexdigest()}"}}'.encode()).hexdigest()
    entries = [entry(k) for k in range(3000)]
    leaf = lambda p: hashlib.sha256("\n".join(sorted(f"{e}:1" for e in entries if e[0] == p)).encode()).hexdigest()
    leaves = {p: leaf(p) for p in "0123456789abcdef"}
    assert all(nodes[1, p][1] == h for p, h in leaves.items())
    assert nodes[0, ""][1] == hashlib.sha256("\n".join(sorted(f"{p}:{h}" for p, h in leaves.items())).encode()).hexdigest()


def test_differences_are_located(spark):
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 5).cast("string").alias("h"))
    one = merkle.tree(df, "id", "h")
    assert merkle.differences(one, one).count() == 0
    moved = df.withColumn("h", F.when(F.col("id") == 17, "x").otherwise(F.col("h")))
    apart = merkle.differences(one, merkle.tree(moved, "id", "h"))
    assert 1 <= apart.count() <= 2
    with pytest.raises(ValueError, match="depth"):
        merkle.differences(one, merkle.tree(df, "id", "h", depth=2))
    rows = moved.where("id <> 9").union(spark.createDataFrame([(5000, "n"), (11, "1"), (None, None)], "id long, h string"))
    got = {r.id: (r.state, r.n_one, r.n_other) for r in merkle.changed_rows(df, rows, "id", "h").collect()}
    assert got == {17: ("changed", 1, 1), 9: ("removed", 1, 0), 5000: ("added", 0, 1), 11: ("changed", 1, 2), None: ("added", 0, 1)}
    assert merkle.changed_rows(df, df.repartition(3), "id").count() == 0
    empty = df.limit(0)
    assert merkle.identity(empty, "id", "h").first().n_rows == 0 and merkle.changed_rows(empty, df.limit(1), "id").first().state == "added"


def test_manifests_tell_forged_sums_apart(spark):
    """Equal numbers of rows whose single digests differ have other roots; repeated rows count."""
    a, b = (spark.createDataFrame(x, "id string, h string") for x in ([("1", "a"), ("2", "b")], [("1", "b"), ("2", "a")]))
    roots = [merkle.identity(df, "id", "h").first().hash for df in (a, b, a.union(a))]
    assert len(set(roots)) == 3
    assert sinks.table_digest(a).first() == sinks.table_digest(a.repartition(2)).first() != sinks.table_digest(b).first()


def test_reviewed_snapshot_validates_and_reads_twice(spark):
    digest = hashlib.sha256(b"x").hexdigest()
    good = spark.createDataFrame([("b", digest, "x"), ("a", digest, "x"), ("c", "bad", "y")], "id string, h string, lang string")
    rows, manifest = store.reviewed_snapshot(lambda: good, F.col("lang") == "x", "id", "h")
    assert [(r.position, r.id) for r in rows.orderBy("position").collect()] == [(1, "a"), (2, "b")] and manifest.first().n_items == 2
    with pytest.raises(ValueError, match="digest_invalid"):
        store.reviewed_snapshot(lambda: good, F.lit(True), "id", "h")
    found = sorted(tuple(r) for r in merkle.issues(good.union(good.limit(1)).union(spark.createDataFrame([(" ", digest, "x")], good.schema)), "id", "h").collect())
    assert found == [(" ", "id_missing"), ("b", "id_repeated"), ("c", "digest_invalid")]
    reads = iter([good, good, good.where("id <> 'a'"), good])
    with pytest.raises(ValueError, match="changed between two reads"):
        store.reviewed_snapshot(lambda: next(reads), F.col("lang") == "x", "id", "h")


def test_closed_runs_restart_behind_the_last_stage(spark, tmp_path):
    calls = []
    base = spark.range(50).select("id", (F.col("id") % 7).alias("v"))

    def stages(fail):
        def second(results):
            calls.append("second")
            if fail:
                raise RuntimeError("no space on /var/tmp/x/y, token=abc")
            return results["first"].groupBy("v").agg(F.count(F.lit(1)).alias("n"))

        return [closure.Stage("first", lambda r: calls.append("first") or base, "id"), closure.Stage("second", second, "v"), closure.Stage("third", lambda r: calls.append("third") or r["second"].where("v > 2"), "v")]

    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    broken = {r.stage: r for r in closure.run_closed(spark, a, stages(True), "x").collect()}
    assert [broken[s].state for s in ("first", "second", "third")] == ["completed", "failed", "not_run"] and "abc" not in broken["second"].error
    states = closure.run_closed(spark, a, stages(False), "x")
    assert [r.state for r in states.orderBy("position").collect()] == ["reused", "completed", "completed"] and calls == ["first", "second", "second", "third"]
    assert [r.state for r in closure.run_closed(spark, a, stages(False), "x").collect()] == ["reused"] * 3
    closure.run_closed(spark, b, stages(False), "y")
    compared = closure.compare_closed(spark, a, b, stages(False))
    assert closure.decision(states, compared).first().state == "closed" and {r.state for r in compared.collect()} == {"same"}
    base = base.withColumn("v", F.when(F.col("id") == 3, 6).otherwise(F.col("v")))
    closure.run_closed(spark, b, stages(False), "z")
    found = {r.stage: (r.state, r.n_added, r.n_removed, r.n_changed) for r in closure.compare_closed(spark, a, b, stages(False)).collect()}
    assert found == {"first": ("different", 0, 0, 1), "second": ("different", 0, 0, 2), "third": ("different", 0, 0, 2)}
    assert [r.state for r in closure.run_closed(spark, str(tmp_path / "c"), stages(False), "x", ["release is missing"]).collect()] == ["not_run"] * 3
