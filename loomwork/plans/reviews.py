"""Registered queries from verified records to stored ones. A document's id tells, by its remainder, what is wrong with its case."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions.nested import canonical
from loomwork.operators import evidence, persistence
from loomwork.plans.catalog import register
from loomwork.session import cut_lineage, ensure_checkpoint_dir
from loomwork.sources import table
from loomwork.sources.store import RecordStore

MAPPING_FIELDS = ("source", "target")


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())), {"ignoreNullFields": "false"})


def _digest(json: Column) -> Column:
    return F.sha2(canonical(json), 256)


def _unless(case: Column, number: int, usual: Column, other: Column) -> Column:
    return F.when(case == number, other).otherwise(usual)


# --- promotion -------------------------------------------------------------------------------------------------------

#: The state of each case.
PROMOTIONS = (
    "promoted", "invalid_input", "identity_mismatch", "invalid_grounding", "identity_mismatch", "invalid_grounding", "identity_mismatch", "blocked_by_audit", "invalid_grounding", "rejected_by_reviewer", "deferred_by_reviewer",
    "warning_disposition_required", "invalid_review", "invalid_mapping", "invalid_mapping", "evidence_validation_failed", "promoted", "invalid_grounding", "identity_mismatch", "warning_disposition_required",
)


def _reviews(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" The end of the text.")).alias("source_text"))
    n, name, other = F.col("doc_id") % 20, F.col("doc_id").cast("string"), F.lit("other")
    text, quote, hashed = F.col("source_text"), F.substring("source_text", 1, 15), F.sha2("source_text", 256)
    candidate = _json(kind=F.lit("candidate"), doc=name)
    card, audit = _json(kind=F.lit("card"), doc=name), _json(kind=F.lit("audit"), doc=name)
    packet, decision = _json(kind=F.lit("packet"), doc=name), _json(kind=F.lit("decision"), doc=name)
    base = cut_lineage(docs.select("doc_id", "source_text", n.alias("n"), _digest(candidate).alias("cid"), _digest(card).alias("kid"), _digest(audit).alias("aid"), _digest(packet).alias("pid"), _digest(decision).alias("did")))
    n, words = F.col("n"), lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    mapping = F.concat(F.lit('{"target": "t", "source": "'), name, F.lit('"}'))
    requests = base.select(
        name.alias("request_id"), F.col("cid").alias("selected_candidate_id"), F.col("aid").alias("audit_id"), F.col("pid").alias("requested_packet_id"), F.col("did").alias("requested_decision_id"), F.concat(F.lit("x"), name).alias("extraction_result_id"),
        name.alias("source_document_id"), text.alias("source_text"), _unless(n, 14, mapping, F.lit('{"source":"s","more":1}')).alias("mapping"),
    )
    candidates = base.where("n <> 1").select(F.col("cid").alias("candidate_id"), _unless(n, 2, candidate, F.lit("{}")).alias("candidate_json"), name.alias("candidate_document_id"), hashed.alias("candidate_content_hash"), _unless(n, 17, F.lit(0), F.lit(1)).alias("quote_start"), _unless(n, 17, F.lit(15), F.lit(16)).alias("quote_end"), _unless(n, 17, quote, F.lit("\u0001")).alias("quoted_span"))
    state = F.when(n == 7, "blocked").when(n == 8, "invalid_grounding").when(n.isin(11, 16, 19), "requires_finding_disposition").otherwise("eligible_for_review")
    cards = base.select(F.col("kid").alias("card_id"), F.col("cid").alias("card_candidate_id"), card.alias("card_json"), F.when(n.isin(11, 16, 19), words("w1", "w2")).otherwise(words()).alias("warnings"), words("b1").alias("blockers"), state.alias("eligibility"))
    audits = base.select(F.col("aid").alias("audit_result_id"), audit.alias("audit_json"), name.alias("audit_document_id"), _unless(n, 3, hashed, other).alias("audit_content_hash"))
    packets = base.select(F.col("pid").alias("packet_id"), packet.alias("packet_json"), _unless(n, 4, F.concat(F.lit("x"), name), other).alias("packet_extraction_id"), F.col("aid").alias("packet_audit_id"), _unless(n, 5, name, other).alias("packet_document_id"), hashed.alias("packet_content_hash"))
    entries = base.select(F.col("pid").alias("entry_packet_id"), F.col("cid").alias("entry_candidate_id"), _unless(n, 18, F.col("kid"), other).alias("entry_card_id"))
    answered = F.when(n == 16, words("w2", "w1")).when(n == 11, words("w1")).when(n == 19, words("w1", "w2", "b1")).when(n == 12, words("w9")).otherwise(words())
    decisions = base.select(
        F.col("did").alias("review_decision_id"), decision.alias("decision_json"), F.when(n == 9, "reject").when(n == 10, "defer").otherwise("approve").alias("decision"), answered.alias("answered"),
        F.when(n == 13, F.lit('{"source":"z","target":"t"}')).when(n == 14, F.lit('{"more":1,"source":"s"}')).otherwise(mapping).alias("decision_mapping"), F.col("pid").alias("decision_packet_id"), F.col("cid").alias("decision_candidate_id"), F.col("kid").alias("decision_card_id"), _unless(n, 6, F.col("aid"), other).alias("decision_audit_id"),
    )
    issues = base.where("n = 15").select(name.alias("request_id"), F.lit("species").alias("field"))
    return {"requests": requests, "candidates": candidates, "cards": cards, "audits": audits, "packets": packets, "entries": entries, "decisions": decisions, "issues": issues}


_ID = "SHA256('{\"candidate_id\":\"' || SHA256('{\"doc\":\"' || doc_id || '\",\"kind\":\"candidate\"}') || '\",\"mapping\":{\"source\":\"' || doc_id || '\",\"target\":\"t\"},\"review_decision_id\":\"' || SHA256('{\"doc\":\"' || doc_id || '\",\"kind\":\"decision\"}') || '\"}')"


@register("SELECT CAST(doc_id AS VARCHAR) AS request_id, CASE doc_id % 20 " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(PROMOTIONS)) + f" END AS state, CASE WHEN doc_id % 20 IN (0, 16) THEN {_ID} END AS evidence_item_id FROM documents")
def promotion_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request to promote a candidate for each document."""
    return persistence.promote(**_reviews(spark, sf_dir), mapping_fields=MAPPING_FIELDS).select("request_id", "state", "evidence_item_id")


# --- persistence -------------------------------------------------------------------------------------------------------

#: The status of each case.
PERSISTED = (
    "persisted", "already_persisted", "invalid_request", "store_schema_mismatch", "invalid_promotion", "identity_mismatch", "not_promoted", "invalid_promotion", "missing_evidence_item", "identity_mismatch", "identity_mismatch",
    "identity_mismatch", "evidence_validation_failed", "content_conflict", "identity_mismatch", "persisted",
)
_FIELDS = "evidence_id string, record_hash string, item_json string"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, name, other = F.col("doc_id") % 16, F.col("doc_id").cast("string"), F.lit("other")
    mapping = F.concat(F.lit('{"source":"'), name, F.lit('","target":"t"}'))
    identity = F.concat(F.lit('{"candidate_id":"c'), name, F.lit('","mapping":'), mapping, F.lit(',"review_decision_id":"d'), name, F.lit('"}'))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content"), F.sha2(_unless(n, 14, identity, F.lit("x")), 256).alias("item_id"))
    docs = cut_lineage(docs)
    promoted = _json(kind=F.lit("promotion"), doc=name)
    of = lambda letter: F.concat(F.lit(letter), name)
    details = F.struct(*(c.alias(k) for k, c in zip(persistence.REVIEW_DETAILS, (of("p"), of("d"), of("c"), of("k"), of("a"), name, F.col("content"), of("r")), strict=True)))
    steps = F.array(F.struct(_unless(n, 11, F.lit("manual_review"), F.lit("import")).alias("step_type"), F.lit("2024-01-01").alias("recorded_at"), F.lit(True).alias("is_operational"), details.alias("details")))
    item = F.to_json(F.struct(F.col("item_id").alias("evidence_id"), F.lit(None).cast("string").alias("record_hash"), F.array(F.lit("z"), F.lit("a")).alias("derived_from"), steps.alias("provenance_history"), name.alias("source")), {"ignoreNullFields": "false"})
    return docs.select(
        n.alias("n"), name.alias("persistence_request_id"), _unless(n, 2, F.lit("store"), other).alias("logical_store_id"), F.when(n == 3, "0").when(n == 0, "1").alias("expected_version"), _unless(n, 9, _digest(promoted), other).alias("request_promotion_id"), F.col("item_id").alias("request_item_id"), of("d").alias("request_decision_id"),
        of("a").alias("request_audit_id"), of("c").alias("request_candidate_id"), F.when(n != 4, _digest(promoted)).alias("promotion_result_id"), _unless(n, 10, F.col("item_id"), other).alias("promotion_item_id"), of("d").alias("promotion_decision_id"), of("p").alias("promotion_packet_id"), of("a").alias("promotion_audit_id"), of("k").alias("promotion_card_id"),
        of("c").alias("promotion_candidate_id"), of("r").alias("promotion_reviewer_id"), _unless(n, 5, promoted, F.lit("{}")).alias("promotion_json"), _unless(n, 6, F.lit("promoted"), F.lit("invalid_mapping")).alias("promotion_status"), (n == 7).alias("promotion_persisted"), "item_id", F.when(n != 8, item).alias("item_json"), mapping.alias("item_mapping"), (n == 12).cast("int").alias("n_issues"),
    )


@register("SELECT CAST(doc_id AS VARCHAR) AS persistence_request_id, CASE doc_id % 16 " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(PERSISTED)) + " END AS status, doc_id % 16 IN (0, 1, 15) AS persisted, doc_id % 16 IN (0, 15) AS new_write FROM documents UNION ALL SELECT CAST(doc_id AS VARCHAR) || 'b', 'already_persisted', TRUE, FALSE FROM documents WHERE doc_id % 16 = 15")
def persistence_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request to persist for each document, some of them twice, against a store that holds some already."""
    ensure_checkpoint_dir(spark)
    requests = cut_lineage(_requests(spark, sf_dir))
    store = RecordStore.create(spark, f"{spark.sparkContext.getCheckpointDir()}/reviewed-{uuid.uuid4().hex}", _FIELDS, "evidence_id", "record_hash", "item_json", "1", digits=1)
    payload = persistence.record_payload(F.when(F.col("n") == 13, F.lit('{"source":"older"}')).otherwise(F.col("item_json")))
    held = requests.where("n in (1, 13)").select(F.col("item_id").alias("evidence_id"), payload.alias("item_json"))
    held = held.select("evidence_id", F.sha2(F.concat("item_json", F.when(F.get_json_object("item_json", "$.source") == "older", F.col("evidence_id")).otherwise("")), 256).alias("record_hash"), "item_json")
    store.append(held, "before")
    twice = requests.unionByName(requests.where("n = 15").withColumn("persistence_request_id", F.concat("persistence_request_id", F.lit("b"))))
    return persistence.persist(twice.drop("n"), store, "store", "now").select("persistence_request_id", "status", "persisted", "new_write")


# --- verification ------------------------------------------------------------------------------------------------------

_REASON = lambda k: persistence.CITATION_REASONS[k].replace("'", "''")


@register(f"""WITH d AS (SELECT doc_id, doc_id % 8 AS k, text FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS evidence_id, CASE k WHEN 1 THEN '{_REASON(0)}' WHEN 2 THEN '{_REASON(1)}' WHEN 3 THEN '{_REASON(2)}' WHEN 4 THEN '{_REASON(3)}' WHEN 5 THEN '{_REASON(5)}' WHEN 7 THEN CASE WHEN text IS NULL THEN '{_REASON(4)}' END WHEN 0 THEN CASE WHEN text IS NULL THEN '{_REASON(3)}' WHEN text = '' THEN '{_REASON(3)}' END END AS reason,
 k = 6 OR (k = 7 AND text IS NOT NULL) OR (k = 0 AND COALESCE(text, '') <> '') AS verified FROM d""")
def citation_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record a document, held against the document as its frozen source: all six reasons."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n, name = F.col("doc_id") % 8, F.col("doc_id").cast("string")
    quote = F.when(n == 4, "").when(n == 5, F.concat("text", F.lit(" and more"))).when(n == 7, F.substring(F.coalesce("text", F.lit("x")), 1, 1)).otherwise(F.col("text"))
    quote = F.when(n == 7, F.coalesce(F.when(quote != "", quote), F.lit(" "))).otherwise(F.when(n == 5, F.coalesce(quote, F.lit("q"))).otherwise(quote))
    records = docs.select(
        name.alias("evidence_id"), F.when(n == 1, "Unknown").otherwise("files").alias("source"), F.when(n == 2, F.concat(F.lit("no"), name)).otherwise(name).alias("source_id"), F.when(n.isin(3, 6), "computed").otherwise("manual").alias("extraction_method"), F.lit("literature").alias("evidence_type"),
        F.when(n == 3, " ").when(n == 6, "table 1").alias("computed_support"), quote.alias("quoted_span"),
    )
    found = persistence.verify_records(records, docs.select(F.lit("files").alias("source"), name.alias("source_id"), "text"))
    return found.select("evidence_id", "reason", (F.col("validation_status") == "citation_verified").alias("verified"))


# --- lineage --------------------------------------------------------------------------------------------------------------

@register("WITH t AS (SELECT conv_id, turn, MAX(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) SELECT conv_id * 1000 + turn AS node, conv_id * 1000 + last AS cycle FROM t WHERE conv_id % 5 = 0")
def lineage_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns descend from the turn before; the first of some conversations from their last, and of some others from another conversation's first."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    node, first = F.col("conv_id") * 1000 + F.col("turn"), F.col("turn") == 0
    parent = F.when(~first, node - 1).when(F.col("conv_id") % 5 == 0, F.col("conv_id") * 1000 + F.col("last")).when(F.col("conv_id") % 5 == 1, (F.col("conv_id") - 1) * 1000)
    return evidence.cycle_members(turns.join(last, "conv_id").select(node.alias("child"), parent.alias("parent")))
