"""Structured responses: strict parsing into grounded claims with a code for each rejection, and synthesis responses."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import strip
from loomwork.functions.nested import is_whole, items_of, member, names_of, parsed, text_of, type_of
from loomwork.session import cut_lineage

# Fields of a response and of a claim, stances, and fields that may not be there.
TOP_FIELDS = ("schema_id", "schema_version", "source_document_id", "claims")
REQUIRED_FIELDS = ("claim_text", "quoted_span", "quote_start", "quote_end", "stance")
LIST_FIELDS = ("target_mentions", "disease_mentions", "species_mentions", "model_system_mentions")
TEXT_FIELDS = ("cohort_description", "effect_description", "limitations", "source_locator", "evidence_type_hint")
HIDDEN_FIELDS = ("thinking", "reasoning", "chain_of_thought", "scratchpad", "analysis")
STANCES = ("supports", "contradicts", "contextual", "unclear")
# Codes of a rejected response, and of a rejected claim.
RESPONSE_CODES = ("response_not_successful", "structured_output_missing", "invalid_top_level_shape", "schema_mismatch", "source_document_mismatch", "claims_not_array")
CLAIM_CODES = (
    "claim_not_object", "unknown_claim_field", "empty_claim_text", "empty_quote", "invalid_offset_type", "invalid_offset_range", "quote_mismatch",
    "quote_not_found", "ambiguous_quote", "invalid_stance", "hidden_reasoning_field", "duplicate_candidate", "malformed_optional_field",
)


@dataclass(frozen=True)
class Schema:
    """The identifier and version that a response must name."""

    id: str
    version: str


def _among(names: Column, allowed: Sequence[str]) -> Column:
    return F.size(F.array_except(names, F.array(*map(F.lit, allowed)))) == 0


def _lacks(names: Column, required: Sequence[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, required)), names)) > 0


def _safe(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def response_code(schema: Schema) -> Column:
    """Why a response yields no claims, or null. Columns: status, request_id and own_request_id, source_document_id (the
    request's) and own_document_id (the response's), request_schema_id, request_schema_version, schema_id, schema_version, output (a VARIANT)."""
    out, names = F.col("output"), names_of(F.col("output"))
    same = lambda *columns: reduce(lambda a, b: a & b, (_safe(c == F.lit(v)) for c, v in columns))
    versions = same(*((c, schema.id) for c in (text_of(member(out, "schema_id")), F.col("request_schema_id"), F.col("schema_id"))), *((c, schema.version) for c in (text_of(member(out, "schema_version")), F.col("request_schema_version"), F.col("schema_version"))))
    mine = _safe(text_of(member(out, "source_document_id")) == F.col("source_document_id")) & _safe(F.col("own_document_id") == F.col("source_document_id"))
    return (
        F.when(~_safe(F.col("status") == "success"), "response_not_successful").when(out.isNull(), "structured_output_missing")
        .when(names.isNull(), "invalid_top_level_shape").when(~F.col("own_request_id").eqNullSafe(F.col("request_id")), "source_document_mismatch")
        .when(~_among(names, TOP_FIELDS) | _lacks(names, TOP_FIELDS), "invalid_top_level_shape").when(~versions, "schema_mismatch")
        .when(~mine, "source_document_mismatch").when(items_of(member(out, "claims")).isNull(), "claims_not_array")
    )


def _claim_parts(claim: Column) -> dict[str, Column]:
    """What the code of a claim depends on, each taken from the VARIANT once."""
    lists = [items_of(member(claim, n)) for n in LIST_FIELDS]
    wrong = [F.when(F.array_contains(names_of(claim), n), ~_safe(F.forall(x, lambda y: type_of(y) == "string"))) for n, x in zip(LIST_FIELDS, lists, strict=True)]
    wrong += [F.when(F.array_contains(names_of(claim), n), text_of(member(claim, n)).isNull()) for n in TEXT_FIELDS]
    return {
        "__names": names_of(claim), "__text": text_of(member(claim, "claim_text")), "__quote": text_of(member(claim, "quoted_span")), "__stance": text_of(member(claim, "stance")),
        "__whole": is_whole(member(claim, "quote_start")) & is_whole(member(claim, "quote_end")), "__malformed": F.exists(F.array(*wrong), lambda x: _safe(x)),
        **{f"__{n}": F.try_variant_get(claim, f"$.quote_{n}", "decimal(38,0)") for n in ("start", "end")},
    }


def claim_code(source: Column, locate: bool = False) -> Column:
    """Why a claim is rejected, repetition apart, or null, from the columns of ``_claim_parts``. With ``locate`` a quote that isn't at
    its offsets is told from one that is nowhere in the source and one that is there more than once."""
    names, text, quote, start, end = (F.col(f"__{n}") for n in ("names", "text", "quote", "start", "end"))
    missing = F.array_except(F.array(*map(F.lit, REQUIRED_FIELDS)), names)
    offsets = F.array(F.lit("quote_start"), F.lit("quote_end"))
    there = F.substring(source, (start + 1).cast("int"), (end - start).cast("int")) == quote
    mismatch = F.lit("quote_mismatch")
    if locate:
        times = F.size(F.split(source, F.concat(F.lit("\\Q"), F.replace(quote, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)) - 1
        mismatch = F.when(~F.contains(source, quote), "quote_not_found").when(times > 1, "ambiguous_quote").otherwise("quote_mismatch")
    return (
        F.when(names.isNull(), "claim_not_object").when(F.arrays_overlap(names, F.array(*map(F.lit, HIDDEN_FIELDS))), "hidden_reasoning_field")
        .when(~_among(names, (*REQUIRED_FIELDS, *LIST_FIELDS, *TEXT_FIELDS)), "unknown_claim_field")
        .when(F.size(missing) > 0, F.when(F.arrays_overlap(missing, offsets), "invalid_offset_type").otherwise("claim_not_object"))
        .when(F.coalesce(strip(text), F.lit("")) == "", "empty_claim_text").when(F.coalesce(quote, F.lit("")) == "", "empty_quote")
        .when(~F.col("__whole"), "invalid_offset_type").when(~_safe((start >= 0) & (end > start) & (end <= F.length(source))), "invalid_offset_range")
        .when(~_safe(there), mismatch).when(~_safe(F.col("__stance").isin(*STANCES)), "invalid_stance").when(F.col("__malformed"), "malformed_optional_field")
    )


def extract_claims(responses: DataFrame, schema: Schema, output: str = "structured_output", source: str = "source_text", locate: bool = False) -> DataFrame:
    """The columns of each response with ``claim_index``, ``claim`` (its canonical JSON), ``candidate_id`` and ``code``.

    A rejected response is one row without an index. A claim that is accepted has no code; its id is a digest of what it
    says and where, and the second of two equal claims of a response is a ``duplicate_candidate``. An output without claims
    gives no rows. Columns as for ``response_code``, with ``output`` as JSON text; a text that isn't JSON is missing.
    """
    names = responses.columns
    keyed = responses.withColumn("__row", F.monotonically_increasing_id()).withColumn("output", parsed(F.col(output)))
    judged = cut_lineage(keyed).withColumn("code", response_code(schema))  # read twice, but each text is parsed once
    broken = judged.where("code is not null").select(*names, F.lit(None).cast("int").alias("claim_index"), F.lit(None).cast("string").alias("claim"), F.lit(None).cast("string").alias("candidate_id"), "code")
    each = judged.where("code is null").select(*names, "__row", F.posexplode(items_of(member(F.col("output"), "claims"))).alias("claim_index", "__claim"))
    parts = each.withColumns(_claim_parts(F.col("__claim"))).withColumn("claim", F.to_json("__claim"))
    coded = parts.withColumn("code", claim_code(F.col(source), locate))
    # accepted claims have equal fields if their canonical texts are equal
    identity = F.sha2(F.concat_ws("\n", F.col("source_document_id"), F.sha2(F.col(source), 256), F.col("claim")), 256)
    coded = coded.withColumn("candidate_id", F.when(F.col("code").isNull(), identity))
    again = F.row_number().over(Window.partitionBy("__row", "candidate_id").orderBy("claim_index")) > 1  # the claims of one response
    code = F.when(F.col("code").isNull() & again, "duplicate_candidate").otherwise(F.col("code"))
    return coded.withColumn("code", code).select(*names, "claim_index", "claim", "candidate_id", "code").unionByName(broken)


@dataclass(frozen=True)
class Synthesis:
    """Vocabularies of a synthesis response."""

    schema: Schema
    sections: Sequence[str]
    relations: Sequence[str]
    uncertainty: Sequence[str]
    reasons: Sequence[str]


# Fields of a synthesis response, of its statements and of its coverage records.
SYNTHESIS_FIELDS = ("schema_id", "schema_version", "snapshot_id", "inventory_id", "target_identity", "synthesis_purpose", "sections", "statements", "evidence_coverage", "research_only", "non_clinical_use")
STATEMENT_FIELDS = ("local_statement_key", "section_identifier", "statement_text", "evidence_item_ids", "support_relation", "uncertainty_level")
COVERAGE_FIELDS = ("evidence_item_id", "disposition")


def synthesis_issue(value: Column, rules: Synthesis) -> Column:
    """The first thing that is wrong with a synthesis response (a VARIANT), or null.

    Fields that are missing or unknown, another schema, blank identities, sections that are unknown or repeated, boundary
    flags, statements (fields, keys that are blank or repeated, values, limitation) and coverage records.
    """
    names = names_of(value)
    blank = lambda v, n: F.coalesce(strip(text_of(member(v, n))), F.lit("")) == ""
    true = lambda n: _safe((type_of(member(value, n)) == "boolean") & F.try_variant_get(value, f"$.{n}", "boolean"))
    said = lambda v, n, words: _safe(text_of(member(v, n)).isin(*words))
    sections, statements, coverage = (items_of(member(value, n)) for n in ("sections", "statements", "evidence_coverage"))
    once = lambda texts: F.size(F.array_distinct(texts)) == F.size(texts)
    listed = _safe(F.forall(sections, lambda x: _safe(text_of(x).isin(*rules.sections))) & once(F.transform(sections, text_of)))

    def statement_ok(x: Column) -> Column:
        given = names_of(x)
        return _safe(_among(given, (*STATEMENT_FIELDS, "limitation_text")) & ~_lacks(given, STATEMENT_FIELDS))

    def statement_values(x: Column) -> Column:
        cited = items_of(member(x, "evidence_item_ids"))
        return _safe((F.size(cited) > 0) & F.forall(cited, lambda y: F.coalesce(text_of(y), F.lit("")) != "")) & said(x, "section_identifier", rules.sections) & ~blank(x, "statement_text") & said(x, "support_relation", rules.relations) & said(x, "uncertainty_level", rules.uncertainty)

    def coverage_ok(x: Column) -> Column:
        given = names_of(x)
        shape = _safe(_among(given, (*COVERAGE_FIELDS, "reason")) & ~_lacks(given, COVERAGE_FIELDS))
        return shape & (F.coalesce(text_of(member(x, "evidence_item_id")), F.lit("")) != "") & said(x, "disposition", ("cited", "unsynthesized"))

    def reason_ok(x: Column) -> Column:
        cited = _safe(text_of(member(x, "disposition")) == "cited")
        return F.when(cited, ~F.array_contains(names_of(x), "reason")).otherwise(said(x, "reason", rules.reasons))

    limitation = lambda x: type_of(member(x, "limitation_text"))
    keys = F.transform(statements, lambda x: text_of(member(x, "local_statement_key")))
    items = F.transform(coverage, lambda x: text_of(member(x, "evidence_item_id")))
    return (
        F.when(names.isNull(), "not_an_object").when(~_among(names, SYNTHESIS_FIELDS) | _lacks(names, SYNTHESIS_FIELDS), "fields_invalid")
        .when(~(_safe(text_of(member(value, "schema_id")) == rules.schema.id) & _safe(text_of(member(value, "schema_version")) == rules.schema.version)), "schema_mismatch")
        .when(reduce(lambda a, b: a | b, (blank(value, n) for n in ("snapshot_id", "inventory_id", "target_identity", "synthesis_purpose"))), "identity_invalid")
        .when(~listed, "sections_invalid").when(statements.isNull() | coverage.isNull() | ~true("research_only") | ~true("non_clinical_use"), "boundary_invalid")
        .when(~F.forall(statements, statement_ok), "statement_fields_invalid").when(F.exists(statements, lambda x: blank(x, "local_statement_key")) | ~once(keys), "statement_key_invalid")
        .when(~F.forall(statements, statement_values), "statement_values_invalid").when(F.exists(statements, lambda x: _safe(~limitation(x).isin("string", "null"))), "limitation_invalid")
        .when(~F.forall(coverage, coverage_ok) | ~once(items), "coverage_invalid").when(~F.forall(coverage, reason_ok), "coverage_reason_invalid")
    )


def parse_synthesis(responses: DataFrame, rules: Synthesis, output: str = "structured_output") -> DataFrame:
    """The responses with ``issue``; those without one also have their canonical JSON as ``response``."""
    judged = responses.withColumn("__value", parsed(F.col(output)))
    issue = F.when(F.col("__value").isNull(), "not_json").otherwise(synthesis_issue(F.col("__value"), rules))
    judged = judged.withColumn("issue", issue)
    return judged.withColumn("response", F.when(F.col("issue").isNull(), F.to_json("__value"))).drop("__value")

