"""Rules of evidence records, retrieval attempts, finalisation, reviewed snapshots and persistence."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import GENERIC_IDS, strip
from loomwork.operators.merkle import identity, issues, stable_identity
from loomwork.operators.ranking import placed

#: States of a retrieval attempt.
ATTEMPT_STATES = ("success", "success_zero_results", "not_executed", "failed")


def has_text(name: str) -> Column:
    return F.coalesce(strip(F.col(name)), F.lit("")) != ""


def _issue(broken: Column, field: str, message: str) -> Column:
    return F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(message).alias("message")))


def issue_rows(df: DataFrame, key: str, rules: Sequence[tuple[Column, str, str]]) -> DataFrame:
    """(key, field, message): a row for every rule that a record breaks."""
    return df.select(key, F.explode(F.array_compact(F.array(*(_issue(*r) for r in rules)))).alias("x")).select(key, "x.*")


def intrinsic_rules(required: Sequence[str], optional: Sequence[str], vocabularies: Mapping[str, Sequence[str]], numbers: Sequence[str] = ()) -> list[tuple[Column, str, str]]:
    """Rules of single fields: texts that must or may be there, vocabularies, numbers, sample size, confidence, hash."""
    rules = [(~has_text(f), f, "must be a non-empty string") for f in required]
    rules += [(F.col(f).isNotNull() & ~has_text(f), f, "must be a non-empty string") for f in optional]
    rules += [(~F.coalesce(F.col(f).isin(*values), F.lit(False)), f, "is not in its vocabulary") for f, values in vocabularies.items()]
    rules += [(F.isnan(f) | F.abs(F.col(f)).isin(float("inf")), f, "must be a finite number or null") for f in numbers]
    return rules + [
        ((F.col("extraction_confidence") < 0) | (F.col("extraction_confidence") > 1), "extraction_confidence", "must be in [0, 1]"),
        (F.col("sample_size") <= 0, "sample_size", "must be a positive integer or null"),
        (F.col("retrieved_at").isNull(), "retrieved_at", "must be an instant"),
        (F.exists("derived_from", lambda p: p.isNull() | (F.trim(p) == "")), "derived_from", "must be a list of non-empty strings"),
        (F.col("record_hash").isNotNull() & ~F.col("record_hash").rlike("^[0-9a-f]{64}$"), "record_hash", "must be a SHA-256 in lower case or null"),
        *independence_rules(),
    ]


def independence_rules() -> list[tuple[Column, str, str]]:
    """What an eligible record must have and an ineligible one must not."""
    eligible = F.coalesce(F.col("independence_eligible"), F.lit(False))
    return [
        (F.col("independence_eligible").isNull(), "independence_eligible", "must be a boolean"),
        (~eligible & F.col("evidence_family").isNotNull(), "evidence_family", "must be null when ineligible"),
        (~eligible & ~F.col("evidence_family_basis").eqNullSafe("ineligible"), "evidence_family_basis", "must be 'ineligible' when ineligible"),
        (~eligible & ~has_text("independence_ineligibility_reason"), "independence_ineligibility_reason", "must be given when ineligible"),
        (eligible & ~has_text("evidence_family"), "evidence_family", "must be given when eligible"),
        (eligible & F.col("evidence_family_basis").eqNullSafe("ineligible"), "evidence_family_basis", "must not be 'ineligible' when eligible"),
        (eligible & F.col("independence_ineligibility_reason").isNotNull(), "independence_ineligibility_reason", "must be null when eligible"),
    ]


def reviewed(provenance: Column) -> Column:
    """A manual review step with curator, rationale and what was reviewed. Steps are (step_type, details map)."""
    given = lambda step, name: F.coalesce(F.trim(F.try_element_at(step["details"], F.lit(name))), F.lit("")) != ""
    return F.exists(provenance, lambda s: (s["step_type"] == "manual_review") & given(s, "curator_id") & given(s, "review_rationale") & (given(s, "reviewed_source_material") | given(s, "reviewed_computed_output")))


def citation_checked(provenance: Column) -> Column:
    """A citation check that says it succeeded."""
    said = lambda s, name, value: F.coalesce(F.try_element_at(s["details"], F.lit(name)) == value, F.lit(False))
    return F.exists(provenance, lambda s: (s["step_type"] == "citation_verification") & (said(s, "success", "true") | said(s, "status", "success")))


def semantic_rules() -> list[tuple[Column, str, str]]:
    """Rules across fields: support by kind of evidence, status and provenance, paired metrics, required contexts."""
    text = has_text
    computed = F.coalesce(F.col("extraction_method").isin("computed", "database_import") | (F.col("evidence_type") == "database_assertion"), F.lit(False))
    status = F.coalesce(F.col("validation_status"), F.lit(""))
    literature = text("publication_id") | ((status == "citation_verified") & ~computed)
    support = text("quoted_span") | text("computed_support")
    stable = text("source") & text("source_id") & ~F.lower(strip(F.col("source"))).isin(*GENERIC_IDS) & ~F.lower(strip(F.col("source_id"))).isin(*GENERIC_IDS)
    curated = status == "manually_curated"
    place = text("patient_cohort_id") | text("experiment_id")
    return [
        (computed & ~text("computed_support"), "computed_support", "must be given for computed evidence"),
        (literature & ~text("quoted_span"), "quoted_span", "must be given for literature"),
        (~computed & ~literature & ~support, "quoted_span", "or computed_support must give support"),
        ((status == "citation_verified") & ~F.coalesce(citation_checked(F.col("provenance")), F.lit(False)), "validation_status", "needs a successful citation check"),
        (curated & ~stable, "source_id", "manual curation needs a stable source"),
        (curated & ~F.coalesce(reviewed(F.col("provenance")), F.lit(False)), "provenance", "manual curation needs a complete review"),
        (curated & ~support, "quoted_span", "or computed_support must support manual curation"),
        (F.col("effect_size").isNull() != F.col("effect_size_metric").isNull(), "effect_size_metric", "goes with effect_size"),
        (F.col("uncertainty").isNull() != F.col("uncertainty_metric").isNull(), "uncertainty_metric", "goes with uncertainty"),
        ((F.col("evidence_type") == "clinical_cohort") & ~text("patient_cohort_id"), "patient_cohort_id", "is required for a cohort"),
        ((F.col("model_system") == "patient_tumor_biopsy") & ~text("patient_cohort_id"), "patient_cohort_id", "is required for a biopsy"),
        (F.col("evidence_type").isin("in_vivo_model", "in_vitro_model", "functional_genomics") & ~text("experiment_id"), "experiment_id", "is required for an experiment"),
        ((text("comparison") | text("endpoint")) & ~place, "comparison", "needs a cohort or an experiment"),
        ((F.col("extraction_method") == "mock") & F.col("interpretation").isNotNull(), "interpretation", "must be null for a mock"),
        *independence_rules(),
    ]


def attempt_rules() -> list[tuple[Column, str, str]]:
    """Rules of a retrieval attempt: its texts, its state, and what count and error go with the state."""
    status, n = F.col("status"), F.col("result_count")
    return [
        *((~has_text(f), f, "must be a non-empty string") for f in ("retrieval_attempt_id", "target_identifier", "disease_context", "source", "query", "status")),
        *((F.col(f).isNotNull() & ~has_text(f), f, "must be a non-empty string") for f in ("treatment_context", "error_category", "source_release")),
        (~F.coalesce(status.isin(*ATTEMPT_STATES), F.lit(False)), "status", "is not in its vocabulary"), (F.col("timestamp").isNull(), "timestamp", "must be an instant"), (n < 0, "result_count", "must not be negative"),
        ((status == "success") & n.isNull(), "result_count", "is required for success"), ((status == "success_zero_results") & ~n.eqNullSafe(0), "result_count", "must be 0"),
        (status.isin("not_executed", "failed") & n.isNotNull(), "result_count", "must be null for this status"),
        ((status == "failed") & ~has_text("error_category"), "error_category", "is required for a failure"), (~status.eqNullSafe("failed") & F.col("error_category").isNotNull(), "error_category", "must be null without a failure"),
    ]


def lineage_issues(items: DataFrame, edges: DataFrame, key: str, rootless: DataFrame) -> DataFrame:
    """(key, field, message): parents that are not there, and records that descend from a cycle alone."""
    missing = edges.join(items.select(F.col(key).alias("parent")), "parent", "left_anti").select(F.col("child").alias(key), F.lit("derived_from").alias("field"), F.concat(F.lit("parent '"), F.col("parent"), F.lit("' is not there")).alias("message"))
    cyclic = items.select(key).join(rootless.select(F.col("node").alias(key)), key, "left_semi").select(key, F.lit("derived_from").alias("field"), F.lit("lineage contains a cycle").alias("message"))
    return missing.unionByName(cyclic)


def finalizable(items: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """The records without an issue."""
    return items.join(issues.select(key).distinct(), key, "left_anti")


def revisions_of(edges: DataFrame, item: str) -> DataFrame:
    """Revision edges of a record, whichever side it is on."""
    return edges.where((F.col("item") == item) | (F.col("revises") == item))


def new_attempts(incoming: DataFrame, log: DataFrame, key: str = "retrieval_attempt_id") -> DataFrame:
    """Attempts that the log hasn't got, one for each id: the least of its rows as JSON."""
    one = incoming.groupBy(key).agg(F.min_by(F.struct(*incoming.columns), F.to_json(F.struct(*incoming.columns))).alias("__row")).select("__row.*")
    return one.join(log.select(key), key, "left_anti")


def independent_families(items: DataFrame, by: Sequence[str], family: str = "family", eligible: str = "eligible") -> DataFrame:
    """Rows, eligible rows and distinct families of the eligible, composites left out of the count."""
    single = F.when(F.col(eligible) & ~F.col(family).startswith("composite:"), F.col(family))
    return items.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(eligible).alias("n_eligible"), F.count_distinct(single).alias("n_families"))


def selector(rules: Mapping[str, object], ids: Sequence[str] | None = None, key: str = "id", allowed: Sequence[str] | None = None) -> Column:
    """Explicit ids, or all of: a field equals a value or is among several. Unknown fields are an error."""
    if ids is not None:
        return F.col(key).isin(*ids) if ids else F.lit(False)
    if allowed is not None and (unknown := set(rules) - set(allowed)):
        raise ValueError(f"fields that may not be selected by: {sorted(unknown)}")
    out = F.lit(True)
    for name, value in rules.items():
        out = out & (F.col(name).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return out


def snapshot(items: DataFrame, chosen: Column, key: str, digest: str) -> tuple[DataFrame, DataFrame]:
    """(references, manifest): ids and digests of the chosen records in order of id, and one row with their number and an
    identity: the root of a tree of digests over ids and digests, so that no list of all records is built."""
    own = items.where(chosen).select(key, digest)
    rows = placed(own, [F.col(key), F.col(digest)], (), "position")
    return rows, identity(own, key, digest).select(F.col("n_rows").alias("n_items"), F.col("hash").alias("snapshot_id"))


def reviewed_snapshot(read: Callable[[], DataFrame], chosen: Column, key: str, digest: str) -> tuple[DataFrame, DataFrame]:
    """``snapshot`` of what ``read`` gives: its records are validated, and it is read a second time and compared; what is wrong is an error."""
    if wrong := issues(read().where(chosen), key, digest).take(5):
        raise ValueError(f"records that can't be listed: {[tuple(r) for r in wrong]}")
    manifest = stable_identity(lambda: read().where(chosen), key, digest)
    rows, _ = snapshot(read(), chosen, key, digest)
    return rows, manifest.select(F.col("n_rows").alias("n_items"), F.col("hash").alias("snapshot_id"))


def schema_issues(df: DataFrame, wanted: str) -> list[tuple[str, str]]:
    """(field, issue): fields that are missing, of another type, or not wanted; ``wanted`` is a DDL schema."""
    want = {f.name: f.dataType.simpleString() for f in df.sparkSession.createDataFrame([], wanted).schema}
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    out = [(n, "missing" if n not in have else "type") for n, t in want.items() if have.get(n) != t]
    return out + [(n, "unexpected") for n in have if n not in want]
