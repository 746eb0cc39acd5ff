"""Content hashes, finalisation, and what a store can do to a request."""

import hashlib
import json

from pyspark.sql import functions as F

from loomwork.operators import persistence
from loomwork.plans import reviews


def hashes(spark, items):
    rows = spark.createDataFrame(list(enumerate(map(json.dumps, items))), "k int, j string")
    return [r.h for r in sorted(rows.select("k", persistence.record_hash(F.col("j")).alias("h")).collect())]


ITEM = {"evidence_id": "e", "record_hash": None, "derived_from": ["b", "a"], "source": "s", "n": None, "provenance_history": [{"step_type": "x", "recorded_at": "t1", "is_operational": True, "details": {"k": [2, 1]}}, {"step_type": "y", "recorded_at": "t2", "is_operational": False, "details": {}}]}


def test_hash_covers_content_alone(spark):
    payload = {"derived_from": ["a", "b"], "n": None, "provenance_history": [{"details": {"k": [2, 1]}, "is_operational": True, "step_type": "x"}, {"details": {}, "is_operational": False, "recorded_at": "t2", "step_type": "y"}], "source": "s"}
    want = hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    moved = json.loads(json.dumps(ITEM))
    moved["provenance_history"][0]["recorded_at"] = "later"
    changed = json.loads(json.dumps(ITEM))
    changed["provenance_history"][1]["recorded_at"] = "later"
    got = hashes(spark, [ITEM, ITEM | {"evidence_id": "f", "record_hash": "h", "derived_from": ["a", "b"]}, moved, changed, ITEM | {"source": "t"}, {}])
    assert got[0] == got[1] == got[2] == want and len(set(got[2:])) == 4
    assert got[5] == hashlib.sha256(b'{"derived_from":[],"provenance_history":[]}').hexdigest()
    same = spark.createDataFrame([(json.dumps(ITEM), json.dumps(moved)), (json.dumps(ITEM), json.dumps(changed)), ("{", "{}")], "a string, b string").coalesce(1)
    assert [r[0] for r in same.select(persistence.same_content(F.col("a"), F.col("b"))).collect()] == [True, False, None]


def test_finalisation(spark):
    rows = [("e1", "files", "1", "manual", "text", "quote", json.dumps(ITEM)), ("e2", "files", "1", "manual", "text", "quote", json.dumps(ITEM | {"evidence_id": "e2"})), ("e3", "files", "1", "manual", "text", "absent", json.dumps(ITEM | {"source": "3"})), ("e4", "files", "1", "manual", "text", "quote", json.dumps(ITEM | {"source": "4"})), ("e5", "files", "1", "manual", "text", "quote", json.dumps(ITEM | {"source": "5"}))]
    records = spark.createDataFrame(rows, "evidence_id string, source string, source_id string, extraction_method string, evidence_type string, quoted_span string, item_json string").withColumn("computed_support", F.lit(None).cast("string"))
    documents = spark.createDataFrame([("files", "1", "a quote here")], "source string, source_id string, text string")
    issues = spark.createDataFrame([("e4", "species"), ("e4", "source")], "evidence_id string, field string")
    families = spark.createDataFrame([("e1", "f1")], "evidence_id string, family string")
    existing = spark.createDataFrame([("old", hashes(spark, [ITEM | {"source": "5"}])[0])], "evidence_id string, record_hash string")
    got = {r.evidence_id: (r.state, r.family, r.duplicate_of, r.record_hash is not None, r.validation_status) for r in persistence.finalize(records, documents, issues, families, existing).collect()}
    assert got == {
        "e1": ("final", "f1", None, True, "citation_verified"), "e2": ("duplicate", None, "e1", True, "citation_verified"), "e3": ("unverified", None, None, True, "citation_unverified"),
        "e4": ("invalid", None, None, False, "citation_verified"), "e5": ("duplicate", None, "old", True, "citation_verified"),
    }


class Odd:
    """A store that says and keeps what it is told."""

    meta = {"version": "1"}

    def __init__(self, spark, outcome, kept):
        self.spark, self.outcome, self.kept, self.rows = spark, outcome, kept, None

    def append(self, rows, batch):
        self.rows = rows
        return rows.withColumn("outcome", F.lit(self.outcome))

    def lookup(self, wanted):
        empty = self.spark.createDataFrame([], "evidence_id string, record_hash string, item_json string")
        return empty if self.rows is None or not self.kept else self.rows.withColumn("record_hash", F.when(F.lit(self.kept == "other"), "zz").otherwise(F.col("record_hash")))


def test_what_a_store_can_do(spark):
    request = reviews._requests(spark, "/root/testdata/sf0.001").where("persistence_request_id = '15'").drop("n")
    cases = [("new", "own", "persisted"), ("new", None, "round_trip_verification_failed"), ("new", "other", "round_trip_verification_failed"), ("collision", None, "store_write_failed"), ("rejected_mutation", "other", "content_conflict"), ("duplicate", None, "content_conflict"), ("duplicate", "own", "already_persisted")]
    for outcome, kept, want in cases:
        (receipt,) = persistence.persist(request, Odd(spark, outcome, kept), "store", "b").collect()
        assert receipt.status == want and receipt.new_write == (want == "persisted") and receipt.persisted == (want in ("persisted", "already_persisted"))
        assert len(receipt.idempotency_key) == len(receipt.payload_hash) == 64
    used = {*reviews.PERSISTED, *(want for _, _, want in cases)}
    assert used == {*persistence.PERSISTENCE_STATES} and {*reviews.PROMOTIONS} == {*persistence.PROMOTION_STATES}


def test_dispositions(spark):
    rows = [(["a", "b"], True), (["b", "a"], True), (["a"], False), (["a", "b", "b"], False), (["a", "b", "c"], False), (["a", "b", "x"], False), ([], False)]
    df = spark.createDataFrame([(r,) for r, _ in rows], "r array<string>").coalesce(1)
    words = lambda *x: F.array(*map(F.lit, x))
    assert [r[0] for r in df.select(persistence.dispositions_valid(F.col("r"), words("a", "b"), words("c"))).collect()] == [ok for _, ok in rows]


def test_each_text_is_parsed_once_per_use(spark):
    """A VARIANT that is named again is not parsed again: the plan holds a parser for each text, not for each field."""
    ids = ("packet", "decision", "candidate", "card", "audit", "reviewer")
    df = spark.createDataFrame([("{}", *ids)], "j string, " + ", ".join(f"promotion_{n}_id string" for n in ids))
    plan = df.select(persistence.record_payload(F.col("j")).alias("a"), persistence.provenance_valid(F.col("j")).alias("b"))._jdf.queryExecution().analyzed().toString()
    assert 0 < plan.count("try_parse_json(") <= 3
