"""From verified records to stored ones: content hashes, citation checks, finalisation, promotion, and persistence with receipts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import GENERIC_IDS, strip
from loomwork.functions.nested import canonical, items_of, member, names_of, once, parsed, quoted, text_of
from loomwork.session import cut_lineage

# What a promotion comes to, and what becomes of a request to persist.
PROMOTION_STATES = ("promoted", "rejected_by_reviewer", "deferred_by_reviewer", "blocked_by_audit", "warning_disposition_required", "invalid_review", "invalid_mapping", "invalid_grounding", "identity_mismatch", "evidence_validation_failed", "invalid_input")
PERSISTENCE_STATES = (
    "persisted", "already_persisted", "invalid_request", "store_schema_mismatch", "invalid_promotion", "not_promoted", "missing_evidence_item", "identity_mismatch",
    "evidence_validation_failed", "content_conflict", "store_write_failed", "round_trip_verification_failed",
)
# Methods and types of records whose support is computed; why a citation isn't verified.
COMPUTED_METHODS, DATABASE_TYPE = ("computed", "database_import"), "database_assertion"
CITATION_REASONS = (
    "stable source identity is required", "frozen document identity does not match evidence source identity", "computed or database evidence requires non-empty computed_support",
    "literature evidence requires a non-empty quoted_span", "frozen document text is required for literature verification", "quoted_span is not contained literally in frozen document text",
)
# Texts that the manual review step of a stored record must hold.
REVIEW_DETAILS = ("human_review_packet_id", "human_review_decision_id", "candidate_id", "card_id", "audit_result_id", "source_document_id", "source_content_hash", "curator_id")


def _said(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) != ""


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _same(*pairs: tuple[Column, Column]) -> Column:
    return reduce(lambda a, b: a & b, (a.eqNullSafe(b) for a, b in pairs))


# --- content hashes ---------------------------------------------------------------------------------------

def record_payload(json: Column) -> Column:
    """The canonical JSON of what a record's hash covers: all but its id and hash, parents sorted, and the times of
    operational steps left out."""
    operational = lambda step: _true(F.try_variant_get(step, "$.is_operational", "boolean"))
    step = lambda s: F.to_json(F.map_filter(F.try_variant_get(s, "$", "map<string,variant>"), lambda k, _: ~((k == "recorded_at") & operational(s))))

    def whole(value: Column) -> Column:
        fields = F.try_variant_get(value, "$", "map<string,variant>")
        kept = F.map_filter(fields, lambda k, _: ~k.isin("evidence_id", "record_hash", "derived_from", "provenance_history"))
        parents = F.to_json(F.array_sort(F.coalesce(F.try_variant_get(member(value, "derived_from"), "$", "array<string>"), F.array().cast("array<string>"))))
        steps = F.array_join(F.transform(F.coalesce(items_of(member(value, "provenance_history")), F.array().cast("array<variant>")), step), ",")
        rest = once(kept, lambda m: F.when(F.size(m) > 0, F.concat(F.lit(","), F.substring(F.to_json(m), 2, 2**30))).when(m.isNotNull(), "}"))
        return F.concat(F.lit('{"derived_from":'), parents, F.lit(',"provenance_history":['), steps, F.lit("]"), rest)  # null if it has no fields

    return canonical(once(parsed(json), whole))


def record_hash(json: Column) -> Column:
    return F.sha2(record_payload(json), 256)


def same_content(one: Column, other: Column) -> Column:
    """Whether two records have one content hash; null if either isn't JSON."""
    return record_hash(one) == record_hash(other)


# --- verification and finalisation ---------------------------------------------------------------------------

def verification_reason() -> Column:
    """Why a record isn't verified, or null. Columns: source, source_id, extraction_method, evidence_type, computed_support, quoted_span, and
    document_source, document_source_id, document_text of the frozen document."""
    stable = lambda c: _said(F.col(c)) & ~F.lower(strip(F.col(c))).isin(*GENERIC_IDS)
    mine = _true(F.col("document_source") == F.col("source")) & _true(F.col("document_source_id") == F.col("source_id"))
    computed = _true(F.col("extraction_method").isin(*COMPUTED_METHODS)) | _true(F.col("evidence_type") == DATABASE_TYPE)
    steps = (~(stable("source") & stable("source_id")), ~mine, computed & ~_said(F.col("computed_support")), ~computed & (F.coalesce("quoted_span", F.lit("")) == ""), ~computed & F.col("document_text").isNull(), ~computed & ~_true(F.contains("document_text", F.col("quoted_span"))))
    reason = None
    for condition, text in zip(steps, CITATION_REASONS, strict=True):
        reason = F.when(condition, text) if reason is None else reason.when(condition, text)
    return reason


def verify_records(records: DataFrame, documents: DataFrame) -> DataFrame:
    """The records with ``reason`` and ``validation_status``. ``documents`` has (source, source_id, text), one row for each pair."""
    have = documents.select(F.col("source").alias("document_source"), F.col("source_id").alias("document_source_id"), F.col("text").alias("document_text"))
    joined = records.join(have, (F.col("source") == F.col("document_source")) & (F.col("source_id") == F.col("document_source_id")), "left").withColumn("reason", verification_reason())
    state = F.when(F.col("reason").isNull(), "citation_verified").otherwise("citation_unverified")
    return joined.withColumn("validation_status", state).drop("document_source", "document_source_id", "document_text")


def finalize(records: DataFrame, documents: DataFrame, issues: DataFrame, families: DataFrame, existing: DataFrame, key: str = "evidence_id", json: str = "item_json") -> DataFrame:
    """Validate, verify, take the family, hash, and tell exact duplicates: the records with ``state``, ``family``, ``record_hash`` and ``duplicate_of``.

    ``issues`` (key, field) keep a record from going on; ``families`` is (key, family); ``existing`` is (key, record_hash). The first
    key of equal content stands for it: among the existing, else among the records.
    """
    broken = issues.groupBy(F.col(key).alias("__b")).agg(F.count(F.lit(1)).alias("n_issues"))
    marked = verify_records(records, documents).join(broken, F.col(key) == F.col("__b"), "left").drop("__b")
    valid = F.coalesce("n_issues", F.lit(0)) == 0
    hashed = cut_lineage(marked.join(families.select(F.col(key).alias("__f"), "family"), F.col(key) == F.col("__f"), "left").drop("__f").withColumn("record_hash", F.when(valid, record_hash(F.col(json)))))
    known = existing.groupBy(F.col("record_hash").alias("__h")).agg(F.min(key).alias("__known"))
    first = hashed.where("record_hash is not null").groupBy(F.col("record_hash").alias("__g")).agg(F.min(key).alias("__first"))
    joined = hashed.join(known, F.col("record_hash") == F.col("__h"), "left").join(first, F.col("record_hash") == F.col("__g"), "left")
    other = F.coalesce("__known", F.when(F.col("__first") != F.col(key), F.col("__first")))
    state = F.when(~valid, "invalid").when(F.col("reason").isNotNull(), "unverified").when(other.isNotNull(), "duplicate").otherwise("final")
    return joined.withColumns({"duplicate_of": other, "state": state}).drop("__h", "__g", "__known", "__first", "n_issues")


# --- promotion --------------------------------------------------------------------------------------------------

def dispositions_valid(answered: Column, warnings: Column, blockers: Column) -> Column:
    """Every warning answered once, no blocker, nothing else."""
    once = F.size(F.array_distinct(answered)) == F.size(answered)
    return _true(once & (F.size(F.array_except(answered, warnings)) == 0) & (F.size(F.array_except(warnings, answered)) == 0) & ~F.arrays_overlap(answered, blockers))


def evidence_id() -> Column:
    """The id of a promoted record: over its candidate, the decision and the mapping."""
    text = F.concat(F.lit('{"candidate_id":'), quoted(F.col("candidate_id")), F.lit(',"mapping":'), canonical(F.col("mapping")), F.lit(',"review_decision_id":'), quoted(F.col("review_decision_id")), F.lit("}"))
    return F.sha2(text, 256)


def promotion_state(mapping_fields: Sequence[str]) -> Column:
    """What a request to promote a candidate comes to; columns as in ``promote``."""
    c = F.col
    chain = lambda json, own: F.sha2(canonical(c(json)), 256).eqNullSafe(c(own))
    source_hash = F.sha2("source_text", 256)
    span = F.substring("source_text", c("quote_start") + 1, c("quote_end") - c("quote_start"))
    grounded = _same((c("candidate_document_id"), c("source_document_id")), (c("candidate_document_id"), c("audit_document_id")), (c("candidate_content_hash"), source_hash), (c("audit_content_hash"), source_hash)) & _true((c("quote_start") >= 0) & (c("quote_end") >= c("quote_start")) & (span == c("quoted_span")))
    packet = chain("packet_json", "packet_id") & _same((c("packet_extraction_id"), c("extraction_result_id")), (c("packet_audit_id"), c("audit_result_id")))
    packet_source = _same((c("packet_document_id"), c("source_document_id")), (c("packet_document_id"), c("audit_document_id")), (c("packet_content_hash"), source_hash), (c("packet_content_hash"), c("audit_content_hash")))
    review = _same((c("entry_card_id"), c("card_id")), (c("decision_packet_id"), c("packet_id")), (c("decision_candidate_id"), c("candidate_id")), (c("decision_card_id"), c("card_id")), (c("decision_audit_id"), c("audit_result_id"))) & chain("decision_json", "review_decision_id")
    empty = F.array().cast("array<string>")
    answered, warnings, blockers = (F.coalesce(c(n), empty) for n in ("answered", "warnings", "blockers"))
    mapped = names_of(parsed(c("mapping")))
    wanted = F.array(*map(F.lit, mapping_fields))
    return (
        F.when(c("candidate_id").isNull() | c("card_id").isNull(), "invalid_input").when(~(chain("candidate_json", "candidate_id") & chain("card_json", "card_id") & chain("audit_json", "audit_result_id")), "identity_mismatch")
        .when(~grounded, "invalid_grounding").when(~packet, "identity_mismatch").when(~packet_source, "invalid_grounding").when(c("entry_card_id").isNull() | ~review, "identity_mismatch")
        .when(c("eligibility") == "blocked", "blocked_by_audit").when(c("eligibility").isin("invalid_audit", "invalid_grounding"), "invalid_grounding")
        .when(c("decision") == "reject", "rejected_by_reviewer").when(c("decision") == "defer", "deferred_by_reviewer")
        .when((c("eligibility") == "requires_finding_disposition") & ~dispositions_valid(answered, warnings, blockers), "warning_disposition_required")
        .when((c("eligibility") == "eligible_for_review") & (F.size(answered) > 0), "invalid_review")
        .when(~_true(canonical(c("decision_mapping")) == canonical(c("mapping"))), "invalid_mapping").when(~_true((F.size(F.array_except(mapped, wanted)) == 0) & (F.size(F.array_except(wanted, mapped)) == 0)), "invalid_mapping")
        .when(c("n_issues") > 0, "evidence_validation_failed").otherwise("promoted")
    )


def promote(requests: DataFrame, candidates: DataFrame, cards: DataFrame, audits: DataFrame, packets: DataFrame, entries: DataFrame, decisions: DataFrame, issues: DataFrame, mapping_fields: Sequence[str]) -> DataFrame:
    """Every request with ``state`` and, if it is promoted, ``evidence_item_id``. An id must be the digest of its canonical payload.

    ``requests``: request_id, selected_candidate_id, audit_id, requested_packet_id, requested_decision_id, extraction_result_id, source_document_id, source_text, mapping.
    ``candidates``: candidate_id, candidate_json, candidate_document_id, candidate_content_hash, quote_start, quote_end, quoted_span.
    ``cards``: card_id, card_candidate_id, card_json, warnings, blockers, eligibility. ``audits``: audit_result_id, audit_json, audit_document_id, audit_content_hash.
    ``packets``: packet_id, packet_json, packet_extraction_id, packet_audit_id, packet_document_id, packet_content_hash. ``entries``: entry_packet_id, entry_candidate_id, entry_card_id.
    ``decisions``: review_decision_id, decision_json, decision, answered, decision_mapping, decision_packet_id, decision_candidate_id, decision_card_id, decision_audit_id.
    ``issues``: request_id, field: what is wrong with the record that would be built.
    """
    wrong = issues.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_issues"))
    c = F.col
    joined = requests.join(candidates, c("selected_candidate_id") == c("candidate_id"), "left").join(cards, c("selected_candidate_id") == c("card_candidate_id"), "left")
    joined = joined.join(audits, c("audit_id") == c("audit_result_id"), "left").join(packets, c("requested_packet_id") == c("packet_id"), "left")
    joined = joined.join(entries, (c("packet_id") == c("entry_packet_id")) & (c("candidate_id") == c("entry_candidate_id")), "left").join(decisions, c("requested_decision_id") == c("review_decision_id"), "left").join(wrong, "request_id", "left")
    found = cut_lineage(joined).withColumn("state", promotion_state(mapping_fields))
    return found.select("request_id", "selected_candidate_id", "card_id", "audit_result_id", "packet_id", "review_decision_id", "state", F.when(c("state") == "promoted", evidence_id()).alias("evidence_item_id"))


# --- persistence ---------------------------------------------------------------------------------------------------

class Store(Protocol):
    """What persistence asks of a store of (evidence_id, record_hash, item_json)."""

    meta: dict

    def append(self, rows: DataFrame, batch: str) -> DataFrame: ...

    def lookup(self, wanted: DataFrame) -> DataFrame: ...


def provenance_valid(json: Column) -> Column:
    """Whether a record has one manual review step that names what the promotion does. Other columns: the promotion's ids."""
    of = {"human_review_packet_id": "promotion_packet_id", "human_review_decision_id": "promotion_decision_id", "candidate_id": "promotion_candidate_id", "card_id": "promotion_card_id", "audit_result_id": "promotion_audit_id", "curator_id": "promotion_reviewer_id"}

    def named(details: Column) -> Column:
        said = reduce(lambda a, b: a & b, (_said(text_of(member(details, n))) for n in REVIEW_DETAILS))
        matching = reduce(lambda a, b: a & b, (_true(text_of(member(details, n)) == F.col(p)) for n, p in of.items()))
        return said & matching & _true(text_of(member(details, "source_content_hash")).rlike("^[0-9a-f]{64}$"))

    steps = F.filter(F.coalesce(items_of(member(parsed(json), "provenance_history")), F.array().cast("array<variant>")), lambda s: _true(text_of(member(s, "step_type")) == "manual_review"))
    return _true(once(steps, lambda found: (F.size(found) == 1) & once(member(F.get(found, F.lit(0)), "details"), named)))


def item_identity_valid() -> Column:
    """Whether the record's id is the digest of its candidate, decision and mapping."""
    text = F.concat(F.lit('{"candidate_id":'), quoted(F.col("promotion_candidate_id")), F.lit(',"mapping":'), canonical(F.col("item_mapping")), F.lit(',"review_decision_id":'), quoted(F.col("promotion_decision_id")), F.lit("}"))
    return F.sha2(text, 256).eqNullSafe(F.col("item_id"))


def request_state(store_id: str, version: str) -> Column:
    """Why a request doesn't reach the store, or null; ``payload`` is the record's."""
    c = F.col
    mine = _same((c("promotion_result_id"), c("request_promotion_id")), (c("item_id"), c("request_item_id")), (c("promotion_decision_id"), c("request_decision_id")), (c("promotion_audit_id"), c("request_audit_id")), (c("promotion_candidate_id"), c("request_candidate_id")))
    chain = reduce(lambda a, b: a & b, (_said(c(f"promotion_{n}_id")) for n in ("decision", "packet", "audit", "card", "candidate", "reviewer")))
    return (
        F.when(~c("logical_store_id").eqNullSafe(F.lit(store_id)), "invalid_request").when(_true(c("expected_version") != version), "store_schema_mismatch").when(c("promotion_result_id").isNull(), "invalid_promotion")
        .when(~F.sha2(canonical(c("promotion_json")), 256).eqNullSafe(c("promotion_result_id")), "identity_mismatch").when(~c("promotion_status").eqNullSafe(F.lit("promoted")), "not_promoted")
        .when(_true(c("promotion_persisted")), "invalid_promotion").when(c("item_json").isNull(), "missing_evidence_item").when(~c("item_id").eqNullSafe(c("promotion_item_id")) | ~mine | ~chain | ~provenance_valid(c("item_json")), "identity_mismatch")
        .when((F.coalesce("n_issues", F.lit(0)) > 0) | c("payload").isNull(), "evidence_validation_failed")
    )


def persist(requests: DataFrame, store: Store, store_id: str, batch: str) -> DataFrame:
    """Persists promoted records and returns a receipt a request: ``status``, ``payload_hash``, ``idempotency_key``, ``persisted``, ``new_write``.

    Checked before the store: the store's id and version, the promotion's identity, state and record, the ids of the request, the review step,
    issues. Then what the store holds under the record's id; then the record is appended and read back. Of equal requests of a batch the
    first by its id writes. Columns: persistence_request_id, logical_store_id, expected_version, request_{promotion,item,decision,audit,candidate}_id,
    promotion_{result,item,decision,packet,audit,card,candidate,reviewer}_id, promotion_json, promotion_status, promotion_persisted, item_id, item_json, item_mapping, n_issues.
    """
    version = store.meta["version"]
    judged = cut_lineage(requests.withColumn("payload", record_payload(F.col("item_json"))).withColumns({"status": request_state(store_id, version), "payload_hash": F.sha2("payload", 256)}))
    hit = lambda df, name: df.groupBy(F.col("evidence_id").alias(f"__{name}_id")).agg(F.min("record_hash").alias(f"__{name}"))
    asking = judged.where("status is null")
    have = cut_lineage(hit(store.lookup(asking.select(F.col("item_id").alias("evidence_id"))), "have"))
    seen = judged.join(have, F.col("item_id") == F.col("__have_id"), "left")
    there = F.col("__have").isNotNull()
    status = F.coalesce("status", F.when(there & (F.col("__have") != F.col("payload_hash")), "content_conflict").when(~item_identity_valid(), "identity_mismatch").when(there, "already_persisted"))
    seen = cut_lineage(seen.withColumn("status", status))
    ready = seen.where("status is null").groupBy(F.col("item_id").alias("evidence_id"), F.col("payload_hash").alias("record_hash")).agg(F.min("persistence_request_id").alias("writer"), F.min("payload").alias("item_json"))
    ready = cut_lineage(ready)
    outcome = store.append(ready.select("evidence_id", "record_hash", "item_json"), batch).select(F.col("evidence_id").alias("__o"), F.col("record_hash").alias("__oh"), "outcome")
    back = hit(store.lookup(ready.select("evidence_id")), "back")
    written = ready.select(F.col("evidence_id").alias("__w"), F.col("record_hash").alias("__wh"), "writer")
    full = seen.join(written, (F.col("item_id") == F.col("__w")) & (F.col("payload_hash") == F.col("__wh")), "left").join(outcome, (F.col("item_id") == F.col("__o")) & (F.col("payload_hash") == F.col("__oh")), "left").join(back, F.col("item_id") == F.col("__back_id"), "left")
    same = F.col("__back").eqNullSafe(F.col("payload_hash"))
    final = F.coalesce(
        "status", F.when(F.col("outcome") == "collision", "store_write_failed").when(F.col("outcome") == "rejected_mutation", "content_conflict").when((F.col("outcome") == "duplicate") & ~same, "content_conflict")
        .when(~same, "round_trip_verification_failed").when((F.col("outcome") == "duplicate") | (F.col("persistence_request_id") != F.col("writer")), "already_persisted").otherwise("persisted"),
    )
    reached = ~F.col("final").isin("invalid_request", "store_schema_mismatch", "invalid_promotion", "not_promoted", "missing_evidence_item", "evidence_validation_failed")
    named = full.withColumn("final", final)
    parts = F.to_json(F.struct(F.col("payload_hash").alias("canonical_evidence_payload_hash"), F.col("request_item_id").alias("evidence_item_id"), "logical_store_id", F.col("request_promotion_id").alias("promotion_result_id"), F.col("request_decision_id").alias("review_decision_id")), {"ignoreNullFields": "false"})
    return named.select(
        "persistence_request_id", F.col("final").alias("status"), F.when(reached, F.col("payload_hash")).alias("payload_hash"), F.when(reached, F.sha2(parts, 256)).alias("idempotency_key"),
        F.col("final").isin("persisted", "already_persisted").alias("persisted"), (F.col("final") == "persisted").alias("new_write"),
    )
