"""Grounded claims: quotes checked against their source, lexical audit, decisions, review and promotion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import matched_markers, quote_at, strip, unnegated_markers, word_count
from loomwork.operators.rules import collect_reasons, worst

STANCES = ("supports", "contradicts", "contextual", "unclear")


def extract(claims: DataFrame, documents: DataFrame, doc: str = "doc_id", text: str = "source_text") -> DataFrame:
    """The claims with ``rejection`` (null: accepted): no document, blank text or quote, bad offsets, quote
    elsewhere or nowhere, unknown stance, repeated claim."""
    have = documents.select(F.col(doc).alias("__d"), F.col(text).alias("__t"))
    joined = claims.join(have, F.col(doc) == F.col("__d"), "left")
    blank = lambda c: F.coalesce(strip(F.col(c)), F.lit("")) == ""
    a, b = F.col("quote_start"), F.col("quote_end")
    again = F.row_number().over(Window.partitionBy(doc, "claim_text", "quoted_span", "stance").orderBy(a, b)) > 1
    offsets = a.isNull() | b.isNull() | (a < 0) | (b <= a) | (b > F.length("__t"))
    reason = (
        F.when(F.col("__d").isNull(), "document_missing").when(blank("claim_text"), "claim_blank").when(blank("quoted_span"), "quote_blank")
        .when(~F.col("stance").isin(*STANCES) | F.col("stance").isNull(), "stance_unknown").when(~F.contains("__t", F.col("quoted_span")), "quote_not_in_source")
        .when(offsets, "offsets_invalid").when(quote_at(F.col("__t"), a, b) != F.col("quoted_span"), "offsets_mismatch").when(again, "claim_repeated")
    )
    return joined.withColumn("rejection", reason).drop("__d", "__t")


def audit(claims: DataFrame, lexicon: Mapping[str, tuple[str, Sequence[str]]], text: str = "claim_text") -> DataFrame:
    """``findings`` (codes), ``severities`` and ``decision``; the lexicon maps a code to its severity and markers."""
    hit = {code: F.size(matched_markers(F.coalesce(F.col(text), F.lit("")), markers)) > 0 for code, (_, markers) in lexicon.items()}
    found = claims.withColumns({"findings": collect_reasons(*((c, code) for code, c in hit.items())), "severities": collect_reasons(*((c, lexicon[code][0]) for code, c in hit.items()))})
    return found.withColumn("decision", decision(F.col("severities")))


def decision(severities: Column) -> Column:
    return worst(severities, [("blocker", "block"), ("warning", "review")], "pass")


@dataclass(frozen=True)
class Lexicon:
    """Markers of the lexical rules, in lower case."""

    causal: Sequence[str] = ()
    associative: Sequence[str] = ()
    certain: Sequence[str] = ()
    uncertain: Sequence[str] = ()
    limits: Sequence[str] = ()
    preclinical: Sequence[str] = ()
    clinical: Sequence[str] = ()
    advice: Sequence[str] = ()
    advice_negated: Sequence[str] = ()
    guidance: Sequence[str] = ()
    broad: Sequence[str] = ()


#: Severities of the rules.
SEVERITIES = {
    "grounding_integrity_failure": "blocker", "source_identity_mismatch": "blocker", "unsupported_therapeutic_recommendation": "blocker", "clinical_guidance_language": "blocker",
    "association_presented_as_causation": "warning", "certainty_inflation": "warning", "preclinical_presented_as_clinical": "blocker", "unsupported_population_generalization": "warning",
    "missing_source_limitation": "warning", "invented_or_unanchored_identifier": "blocker", "ambiguous_support_relation": "warning", "within_source_contradiction": "warning",
    "candidate_not_audited": "blocker", "audit_input_invalid": "blocker",
}


def taxonomy(claims: DataFrame, documents: DataFrame, lexicon: Lexicon, doc: str = "doc_id", text: str = "source_text", digest: str = "source_hash", group: str | None = None) -> DataFrame:
    """The claims with ``findings``, ``severities`` and ``decision`` by all rules.

    A claim has claim_id, claim_text, quoted_span, quote_start, quote_end, stance, ``digest``, and arrays target_mentions,
    disease_mentions, species_mentions, model_mentions and the text cohort. A document has its text, digest and ``valid``
    (whether its extraction succeeded). Contradictions are sought within ``group``, by default the document.
    """
    have = documents.select(F.col(doc).alias("__d"), F.col(text).alias("__t"), F.col(digest).alias("__h"), F.col("valid").alias("__valid"))
    joined = claims.join(have, F.col(doc) == F.col("__d"), "left")
    low = lambda c: F.coalesce(F.lower(c), F.lit(""))
    said = lambda c, words: F.exists(F.array(*map(F.lit, words)), lambda m: F.contains(c, m)) if words else F.lit(False)
    claim, quote = low(F.col("claim_text")), low(F.col("quoted_span"))
    lists = ("target_mentions", "disease_mentions", "species_mentions", "model_mentions")
    cohort = F.coalesce(F.col("cohort"), F.lit(""))
    raw = F.lower(F.concat_ws(" ", *(F.concat_ws(" ", c) for c in lists), "cohort"))
    a, b, source = F.col("quote_start"), F.col("quote_end"), F.col("__t")
    grounded = (a >= 0) & (a < b) & (b <= F.length(source)) & (quote_at(source, a, b) == F.col("quoted_span"))
    limits = F.array(*map(F.lit, lexicon.limits)) if lexicon.limits else F.array().cast("array<string>")
    named = F.filter(limits, lambda m: F.contains(F.concat(quote, F.lit(" "), raw), m))
    anchors = F.filter(F.concat(*(F.coalesce(F.col(c), F.array().cast("array<string>")) for c in lists), F.array(F.col("cohort"))), lambda x: F.coalesce(x, F.lit("")) != "")
    loose = F.exists(anchors, lambda x: ~F.contains(F.coalesce(source, F.lit("")), x) & ~F.contains(F.coalesce(F.col("quoted_span"), F.lit("")), x))
    opposed = _opposed(claims, group or doc)
    joined = joined.join(opposed.select(F.col("claim_id").alias("__o")), F.col("claim_id") == F.col("__o"), "left")
    rules = {
        "candidate_not_audited": F.coalesce(F.col("claim_id").cast("string"), F.lit("")) == "",
        "source_identity_mismatch": ~F.col("__h").eqNullSafe(F.col(digest)),
        "grounding_integrity_failure": ~F.coalesce(grounded, F.lit(False)),
        "unsupported_therapeutic_recommendation": F.size(unnegated_markers(claim, lexicon.advice, lexicon.advice_negated)) > 0 if lexicon.advice and lexicon.advice_negated else said(claim, lexicon.advice),
        "clinical_guidance_language": said(claim, lexicon.guidance),
        "association_presented_as_causation": said(claim, lexicon.causal) & said(quote, lexicon.associative) & ~said(quote, lexicon.causal),
        "certainty_inflation": said(claim, lexicon.certain) & said(quote, lexicon.uncertain),
        "preclinical_presented_as_clinical": said(raw, lexicon.preclinical) & said(claim, lexicon.clinical),
        "unsupported_population_generalization": said(claim, lexicon.broad) & ((F.size(F.coalesce("disease_mentions", F.array().cast("array<string>"))) > 0) | (cohort != "")),
        "missing_source_limitation": (F.size(named) > 0) & ~F.exists(named, lambda m: F.contains(claim, m)),
        "invented_or_unanchored_identifier": loose,
        "ambiguous_support_relation": F.coalesce(F.col("stance").isin("unclear", "contextual"), F.lit(False)),
        "audit_input_invalid": ~F.coalesce(F.col("__valid"), F.lit(False)),
        "within_source_contradiction": F.col("__o").isNotNull(),
    }
    found = joined.withColumns({"findings": collect_reasons(*((c, code) for code, c in rules.items())), "severities": collect_reasons(*((c, SEVERITIES[code]) for code, c in rules.items()))})
    return found.withColumn("decision", decision(F.col("severities"))).drop("__d", "__t", "__h", "__valid", "__o")


def _opposed(claims: DataFrame, doc: str) -> DataFrame:
    """claim_id of claims of a document whose lower-cased targets and diseases (neither empty) another claim shares with
    the opposite stance. Anchors are counted, claims are never paired."""
    lower = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), F.lower)
    keyed = claims.select("claim_id", doc, "stance", lower("target_mentions").alias("ts"), lower("disease_mentions").alias("ds")).where("size(ts) > 0 and size(ds) > 0 and stance in ('supports', 'contradicts')")
    both = keyed.groupBy(doc, "ts", "ds").agg(F.count_distinct("stance").alias("n")).where("n > 1").drop("n")
    return keyed.join(both, [doc, "ts", "ds"], "left_semi").select("claim_id").distinct()


def roll_up(audited: DataFrame, documents: DataFrame, doc: str = "doc_id") -> DataFrame:
    """A decision for each document: invalid if its extraction failed (column ``valid``, if there is one), then block,
    review, pass; without candidates ``no_candidates``."""
    by = audited.groupBy(doc).agg(F.collect_set("decision").alias("__all"))
    have = documents.withColumn("valid", F.lit(True)) if "valid" not in documents.columns else documents
    state = F.when(~F.col("__valid"), "invalid_input").when(F.col("__all").isNull(), "no_candidates").otherwise(worst(F.col("__all"), [("block", "block"), ("review", "review")], "pass"))
    return have.groupBy(doc).agg(F.min(F.coalesce("valid", F.lit(False))).alias("__valid")).join(by, doc, "left").select(doc, state.alias("decision"))


def review_packet(candidates: DataFrame, cards: DataFrame, key: str = "claim_id") -> DataFrame:
    """Candidates with their cards, and whether a reviewer may decide: not if it is blocked, nor if the card is of other content."""
    joined = candidates.join(cards.select(key, "decision", "findings", F.col("content_hash").alias("__h")), key)
    eligibility = F.when(F.col("decision") == "block", "not_eligible_blocked").when(~F.col("content_hash").eqNullSafe(F.col("__h")), "not_eligible_changed").when(F.col("decision") == "review", "eligible_with_warnings").otherwise("eligible")
    return joined.withColumn("eligibility", eligibility).drop("__h")


#: Columns of a review decision.
DECISION = "claim_id string, verdict string, content_hash string, reviewer string, answered array<string>"


def parse_decisions(texts: DataFrame, column: str = "json") -> DataFrame:
    """Review decisions from JSON texts, with ``problem``: no JSON, a field missing, an unknown verdict or an unknown field."""
    parsed = texts.withColumn("__r", F.from_json(column, DECISION, {"mode": "PERMISSIVE"}))
    names = F.json_object_keys(column)
    known = [x.split()[0] for x in DECISION.split(", ")]
    problem = (
        F.when(names.isNull(), "not_json").when(F.size(F.array_except(F.array(*map(F.lit, known)), names)) > 0, "field_missing").when(F.size(F.array_except(names, F.array(*map(F.lit, known)))) > 0, "unknown_field")
        .when(~F.coalesce(F.col("__r.verdict").isin("approve", "reject", "defer"), F.lit(False)), "verdict_unknown").when(F.coalesce(F.trim("__r.reviewer"), F.lit("")) == "", "reviewer_missing")
    )
    return parsed.select(*texts.columns, "__r.*", problem.alias("problem"))


def inventory(items: DataFrame, target: str, context: str | None = None, key: str = "evidence_id") -> DataFrame:
    """The verified records of a target, and of a context if one is given."""
    chosen = items.where((F.col("target") == target) & F.col("status").isin("citation_verified", "manually_curated"))
    return (chosen if context is None else chosen.where(F.col("context") == context)).orderBy(key)


def synthesis_issues(statements: DataFrame, evidence: DataFrame, lexicon: Lexicon, most_words: int = 60) -> DataFrame:
    """(statement_id, issue): statements (statement_id, text, citations) without citations, with citations that are not
    there or repeated, too long, that advise, or more certain than what they cite. ``evidence`` has (evidence_id, text)."""
    cited = statements.select("statement_id", "text", F.posexplode("citations").alias("at", "evidence_id"))
    joined = cited.join(evidence.select("evidence_id", F.col("text").alias("__e")), "evidence_id", "left")
    said = lambda c, words: F.exists(F.array(*map(F.lit, words)), lambda m: F.contains(F.lower(c), m)) if words else F.lit(False)
    per = joined.groupBy("statement_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("__e").isNull()).alias("n_unknown"), F.count_distinct("evidence_id").alias("n_distinct"), F.bool_or(said(F.col("__e"), lexicon.uncertain)).alias("unsure"))
    rows = statements.join(per, "statement_id", "left")
    rules = [
        (F.coalesce(F.col("n"), F.lit(0)) == 0, "no_citation"), (F.col("n_unknown") > 0, "unknown_citation"), (F.col("n_distinct") < F.col("n"), "repeated_citation"), (word_count(F.col("text")) > most_words, "too_long"),
        (F.size(unnegated_markers(F.col("text"), lexicon.advice, lexicon.advice_negated)) > 0 if lexicon.advice and lexicon.advice_negated else said(F.col("text"), lexicon.advice), "recommends"),
        (said(F.col("text"), lexicon.certain) & F.coalesce(F.col("unsure"), F.lit(False)), "more_certain_than_cited"),
    ]
    return rows.select("statement_id", F.explode(collect_reasons(*rules)).alias("issue"))
