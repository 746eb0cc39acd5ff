"""Feasibility observations: nested records to entity-attribute-value rows, coverage and contradictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import usable_id

#: Spellings of modalities; any other has none.
MODALITIES = {"ANTIBODY": "antibody", "SMALL MOLECULE": "small_molecule", "PROTAC": "protac", "OTHER": "other_clinical", "OTHER CLINICAL": "other_clinical"}
RECORD = "target string, knownDrugs array<struct<drug:struct<id:string,name:string>,phase:int,status:string>>, tractability array<struct<label:string,modality:string,value:boolean>>, safetyLiabilities array<struct<event:string,datasource:string>>"


def modality(c: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in MODALITIES.items() for x in kv))
    return F.try_element_at(table, F.upper(F.trim(c)))


def observations(records: DataFrame) -> DataFrame:
    """target, dimension, modality, factor, value (JSON text), availability.

    A field that is absent gives ``not_available``, an empty list ``not_observed``; neither is a negative.
    """
    parts = (
        ("known_drug", "knownDrugs", lambda x: (F.lit(None).cast("string"), F.coalesce(usable_id(x["drug"]["id"]), F.sha2(F.to_json(x), 256)), F.to_json(F.struct(x["phase"].alias("phase"), x["status"].alias("status")), {"ignoreNullFields": "false"}))),
        ("tractability", "tractability", lambda x: (modality(x["modality"]), x["label"], x["value"].cast("string"))),
        ("safety", "safetyLiabilities", lambda x: (F.lit(None).cast("string"), x["event"], F.to_json(F.struct(x["datasource"].alias("datasource")), {"ignoreNullFields": "false"}))),
    )
    out = None
    for dimension, field, make in parts:
        rows = records.select("target", F.col(field).isNull().alias("absent"), F.explode_outer(field).alias("x"))
        kind, factor, value = make(F.col("x"))
        seen = F.col("x").isNotNull()
        state = F.when(F.col("absent"), "not_available").when(~seen, "not_observed").otherwise("observed")
        part = rows.select("target", F.lit(dimension).alias("dimension"), F.when(seen, kind).alias("modality"), F.when(seen, factor).alias("factor"), F.when(seen, value).alias("value"), state.alias("availability"))
        out = part if out is None else out.unionByName(part)
    return out


def contradictory(obs: DataFrame) -> DataFrame:
    """The observations with ``contradictory``: the same factor has another value, or is marked conflicting."""
    keys = ("target", "dimension", "modality", "factor")
    groups = obs.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg((F.min("value") != F.max("value")).alias("__differ"), (F.count_if(F.col("availability") == "conflicting") > 0).alias("__marked"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    joined = obs.join(groups, same, "left")
    there = F.col("availability").isin("observed", "conflicting")
    return joined.select(*obs.columns, (there & (F.coalesce("__differ", F.lit(False)) | F.coalesce("__marked", F.lit(False)))).alias("contradictory"))


STATES = ("observed", "not_observed", "not_available", "conflicting", "retrieval_failed")


def coverage_state(n: dict[str, Column], conflicting: Column, applicable: Column, unsupported: Column, failed: Column) -> Column:
    """First of: retrieval failed, conflicting, partial, observed, nothing seen though asked, not available, partial."""
    gaps = (unsupported > 0) | (n["not_available"] > 0)
    return (
        F.when(failed > 0, "retrieval_failed").when(conflicting > 0, "conflicting").when((n["observed"] > 0) & gaps, "partial").when(n["observed"] > 0, "observed")
        .when((n["not_observed"] > 0) & ~gaps, "observed").when((applicable == 0) | (n["not_available"] > 0), "not_available").otherwise("partial")
    )


def coverage(obs: DataFrame, unsupported: DataFrame | None = None) -> DataFrame:
    """Counts and a state for each target, dimension and modality, and for tractability over all modalities (null).

    ``unsupported`` has (target, dimension, modality, n_unsupported): source values of no known kind.
    """
    marked = contradictory(obs)
    whole = marked.where("dimension = 'tractability' and modality is not null").withColumn("modality", F.lit(None).cast("string"))
    rows = marked.unionByName(whole)
    counts = rows.groupBy("target", "dimension", "modality").agg(*(F.count_if(F.col("availability") == s).alias(f"n_{s}") for s in STATES if s != "conflicting"), F.count_if("contradictory").alias("n_conflicting"))
    if unsupported is None:
        joined = counts.withColumn("n_unsupported", F.lit(0).cast("long"))
    else:
        other = unsupported.select(*(F.col(c).alias(f"__{c}") for c in ("target", "dimension", "modality")), "n_unsupported")
        same = (F.col("target") == F.col("__target")) & (F.col("dimension") == F.col("__dimension")) & F.col("modality").eqNullSafe(F.col("__modality"))
        joined = counts.join(other, same, "left").drop("__target", "__dimension", "__modality").withColumn("n_unsupported", F.coalesce("n_unsupported", F.lit(0)))
    n = {s: F.col(f"n_{s}") for s in STATES}
    return joined.withColumn("state", coverage_state(n, F.col("n_conflicting"), F.lit(1), F.col("n_unsupported"), F.col("n_retrieval_failed")))


#: What becomes of a request for a profile.
PROFILE_STATES = (
    "built", "built_with_gaps", "invalid_request", "invalid_fetch_result", "source_release_mismatch", "target_unresolved", "target_ambiguous", "target_invalid", "target_retrieval_failed",
    "target_record_missing", "unsupported_source_shape", "normalization_failed", "invalid_profile",
)


def profile_status(requests: DataFrame, resolutions: DataFrame, records: DataFrame, covered: DataFrame, fetches: DataFrame | None = None) -> DataFrame:
    """Every request with the status of its profile and what decides it.

    ``requests``: request_id, target, id_type, source_release. ``resolutions``: target, id_type, status, resolved_id; more than
    one for a request is as none. ``records``: resolved_id, release, verified, shape_ok, and, if they are there, normalized and profile_ok.
    ``covered``: target, state. ``fetches``: target, id_type, fetch_ok, release_state; a fetch that isn't valid, or of another release,
    is told before its resolutions are looked at.
    """
    key = ["target", "id_type"]
    one = resolutions.groupBy(*key).agg(F.count(F.lit(1)).alias("n_resolutions"), F.min("status").alias("resolution"), F.min("resolved_id").alias("resolved_id"))
    flags = {c: F.min(c) if c in records.columns else F.lit(True) for c in ("normalized", "profile_ok")}
    found = records.groupBy("resolved_id").agg(F.count(F.lit(1)).alias("n_records"), F.min("release").alias("release"), F.min("verified").alias("verified"), F.min("shape_ok").alias("shape_ok"), *(c.alias(n) for n, c in flags.items()))
    gaps = covered.groupBy("target").agg((F.count_if(F.col("state") != "observed") > 0).alias("has_gaps"))
    again = requests.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_requests"))
    joined = requests.join(one, key, "left").join(found, "resolved_id", "left").join(gaps, "target", "left").join(again, "request_id", "left")
    if fetches is None:
        joined = joined.withColumns({"fetch_ok": F.lit(True), "release_state": F.lit("verified")})
    else:
        joined = joined.join(fetches.groupBy(*key).agg(F.min("fetch_ok").alias("fetch_ok"), F.min(F.when(F.col("release_state") == "mismatch", "a mismatch").otherwise(F.col("release_state"))).alias("release_state")), key, "left")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    lacks = lambda c: ~F.coalesce(F.col(c), F.lit(True))
    status = (
        F.when(blank("request_id") | blank("target") | ~F.col("id_type").isin("gene_symbol", "ensembl_gene_id") | (F.col("n_requests") > 1), "invalid_request")
        .when(~F.coalesce(F.col("fetch_ok"), F.lit(False)), "invalid_fetch_result").when(F.col("release_state") == "a mismatch", "source_release_mismatch")
        .when(F.coalesce(F.col("n_resolutions"), F.lit(0)) != 1, "invalid_fetch_result").when(F.col("resolution") == "unresolved", "target_unresolved").when(F.col("resolution") == "ambiguous", "target_ambiguous")
        .when(F.col("resolution") == "invalid_identifier", "target_invalid").when(F.col("resolution") == "retrieval_failed", "target_retrieval_failed")
        .when((F.col("id_type") == "ensembl_gene_id") & (F.col("resolved_id") != F.col("target")), "target_invalid").when(F.coalesce(F.col("n_records"), F.lit(0)) != 1, "target_record_missing")
        .when(~F.col("release").eqNullSafe(F.col("source_release")), "source_release_mismatch").when(lacks("shape_ok"), "unsupported_source_shape").when(lacks("normalized"), "normalization_failed").when(lacks("profile_ok"), "invalid_profile")
        .when(~F.coalesce(F.col("verified"), F.lit(False)) | F.coalesce(F.col("has_gaps"), F.lit(True)), "built_with_gaps").otherwise("built")
    )
    return joined.select(*requests.columns, status.alias("status"))


def batch_totals(status: DataFrame, covered: DataFrame) -> DataFrame:
    """(kind, name, n): requests of each status, and observed facts of each dimension and of each modality of tractability."""
    by_status = status.groupBy(F.col("status").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("status").alias("kind"), "name", "n")
    by_dimension = covered.where("modality is null").groupBy(F.col("dimension").alias("name")).agg(F.sum("n_observed").alias("n")).select(F.lit("dimension").alias("kind"), "name", "n")
    by_modality = covered.where("dimension = 'tractability' and modality is not null").groupBy(F.col("modality").alias("name")).agg(F.sum("n_observed").alias("n")).select(F.lit("modality").alias("kind"), "name", "n")
    return by_status.unionByName(by_dimension).unionByName(by_modality)


def compose(assessments: DataFrame, obs: DataFrame, covered: DataFrame | None, dimensions: tuple[str, ...]) -> DataFrame:
    """Every assessment (target, modality) and dimension, with its facts of that modality and of the target as a whole,
    the state that was supplied or follows from these facts alone, and how many contradict each other."""
    grid = assessments.withColumn("dimension", F.explode(F.array(*map(F.lit, dimensions))))
    marked = contradictory(obs)
    per = marked.groupBy(F.col("target").alias("__t"), F.col("dimension").alias("__d"), F.col("modality").alias("__m")).agg(F.count(F.lit(1)).alias("n_facts"), *(F.count_if(F.col("availability") == s).alias(f"n_{s}") for s in ("conflicting", "retrieval_failed")), F.count_if("contradictory").alias("n_contradictory"))
    alone = F.when(F.col("n_retrieval_failed") > 0, "retrieval_failed").when(F.col("n_conflicting") > 0, "conflicting").otherwise("observed")
    per = per.withColumn("alone", alone)
    side = lambda p: per.withColumnsRenamed({c: f"{p}_{c}" for c in per.columns})
    own, context = side("own"), side("context").where("context___m is null")
    joined = grid.join(own, (F.col("target") == F.col("own___t")) & (F.col("dimension") == F.col("own___d")) & (F.col("modality") == F.col("own___m")), "left")
    joined = joined.join(context, (F.col("target") == F.col("context___t")) & (F.col("dimension") == F.col("context___d")), "left")
    supplied = {"own": F.lit(None).cast("string"), "context": F.lit(None).cast("string")}
    if covered is not None:
        for p in supplied:
            c = covered.select(F.col("target").alias(f"__{p}_t"), F.col("dimension").alias(f"__{p}_d"), F.col("modality").alias(f"__{p}_m"), F.col("state").alias(f"__{p}_state"))
            of = F.col(f"__{p}_m").isNull() if p == "context" else F.col("modality") == F.col(f"__{p}_m")
            joined = joined.join(c, (F.col("target") == F.col(f"__{p}_t")) & (F.col("dimension") == F.col(f"__{p}_d")) & of, "left")
            supplied[p] = F.col(f"__{p}_state")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select(
        "target", "modality", "dimension", n("own_n_facts").alias("n_own"), n("context_n_facts").alias("n_context"), (n("own_n_contradictory") + n("context_n_contradictory")).alias("n_contradictory"),
        F.coalesce(supplied["own"], F.col("own_alone"), F.lit("not_available")).alias("own_state"), F.coalesce(supplied["context"], F.col("context_alone"), F.lit("not_available")).alias("context_state"),
    )


def release_check(declared: Column, observed: Column, verified: Column) -> Column:
    """verified, declared but not verified, mismatch, or not reported."""
    return F.when(observed.isNull(), "not_reported").when(declared != observed, "mismatch").when(F.coalesce(verified, F.lit(False)), "verified").otherwise("declared_unverified")


def observation_issues(obs: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """(target, dimension, factor, issue) of observations that break their contract."""
    rules = [
        (F.coalesce(F.trim("target"), F.lit("")) == "", "blank_target"), (~F.col("dimension").isin(*dimensions), "unknown_dimension"), (~F.col("availability").isin(*STATES), "unknown_state"),
        (F.col("modality").isNotNull() & ~F.col("modality").isin(*set(MODALITIES.values())), "unknown_modality"), ((F.col("availability") == "observed") & F.col("value").isNull(), "observed_without_value"),
        (F.col("availability").isin("not_available", "not_observed") & F.col("value").isNotNull(), "absent_with_value"),
    ]
    return obs.select("target", "dimension", "factor", F.explode(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(i)) for c, i in rules)))).alias("issue"))
