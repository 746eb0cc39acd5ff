"""Landed association payloads: nested JSON to one row per entity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.session import cut_lineage

_SCORES = "array<struct<id:string,score:double>>"
PAYLOAD = f"disease struct<id:string,name:string>, associatedTargets struct<count:int,rows:array<struct<score:double,datatypeScores:{_SCORES},datasourceScores:{_SCORES},target:struct<id:string,approvedSymbol:string,approvedName:string,biotype:string>>>>"


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Whole-file JSON documents, either payloads or cache envelopes that hold one under ``data``."""
    wrapped = spark.read.schema(f"{PAYLOAD}, data struct<{_colons(PAYLOAD)}>").json(path, multiLine=True)
    return wrapped.select(F.coalesce("disease", "data.disease").alias("disease"), F.coalesce("associatedTargets", "data.associatedTargets").alias("associatedTargets"))


def _colons(schema: str) -> str:
    return schema.replace("disease struct", "disease:struct", 1).replace(", associatedTargets struct", ",associatedTargets:struct", 1)


def score_map(scores: Column) -> Column:
    """[{id, score}] to a map; null ids go, the last of equal ids stays."""
    known = F.filter(F.coalesce(scores, F.array().cast(_SCORES)), lambda x: x["id"].isNotNull())
    last = F.filter(known, lambda x, i: ~F.exists(F.slice(known, i + 2, F.size(known)), lambda y: y["id"] == x["id"]))
    return F.map_from_entries(last)


def flatten(payloads: DataFrame) -> DataFrame:
    """target, disease, score and component maps, one row per association."""
    rows = payloads.select("disease", F.explode("associatedTargets.rows").alias("r"))
    t = "r.target"
    return rows.select(
        F.col(f"{t}.id").alias("target_id"), F.col(f"{t}.approvedSymbol").alias("target_symbol"), F.col(f"{t}.approvedName").alias("target_name"), F.col(f"{t}.biotype").alias("biotype"),
        F.col("disease.id").alias("disease_id"), F.col("disease.name").alias("disease_name"), F.col("r.score").alias("association_score"),
        score_map(F.col("r.datatypeScores")).alias("datatype_scores"), score_map(F.col("r.datasourceScores")).alias("datasource_scores"),
    )


def first_pages(df: DataFrame, page_size: int = 100, pages: int = 3) -> DataFrame:
    """What the first pages of a list ordered by score hold: it ends at the first empty page, or after ``pages``."""
    return ordered(df).limit(page_size * pages)


def pages_read(pages: DataFrame, key: str, page: str, rows: str, declared: str, most_pages: int = 3) -> tuple[DataFrame, DataFrame]:
    """(members, states): what reading the landed pages of each request one after the other gives.

    Pages are numbered from 0. Reading ends behind the page with which the declared count is reached, behind the first empty
    page, after ``most_pages``, or before a page that isn't there. ``members`` has (key, page, place, member); ``states`` has (key, n_pages, n_rows, declared,
    ended, complete), a row for each request, ``complete`` telling whether as many rows as declared were read. Of a page that is landed twice
    one copy is read: the least as JSON. Only sizes go through the windows, a row a page.
    """
    one = pages.groupBy(key, page).agg(F.min_by(F.struct(F.col(rows).alias("rows"), F.col(declared).cast("long").alias("declared")), F.to_json(F.struct(rows, declared))).alias("p")).select(key, page, "p.*")
    one = cut_lineage(one.withColumn("n", F.coalesce(F.size("rows"), F.lit(0))))
    by = Window.partitionBy(key).orderBy(page)  # the pages of one request
    sized = one.select(key, page, "n", "declared").withColumns({"read": F.sum("n").over(by), "turn": F.row_number().over(by) - 1})
    why = F.when(F.col("read") >= F.coalesce("declared", F.lit(0)), "count_reached").when(F.col("n") == 0, "empty_page").when(F.col(page) + 1 >= most_pages, "page_limit")
    sized = sized.withColumn("why", why)
    earlier = F.count("why").over(by.rowsBetween(Window.unboundedPreceding, -1))
    kept = cut_lineage(sized.withColumn("earlier", earlier).where((F.col(page) == F.col("turn")) & (F.col("earlier") == 0) & (F.col(page) < most_pages)))
    found = kept.groupBy(key).agg(F.count(F.lit(1)).alias("n_pages"), F.sum("n").alias("n_rows"), F.max_by("declared", page).alias("declared"), F.max("why").alias("ended"))
    states = one.select(key).distinct().join(found, key, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_pages", "n_rows")})
    states = states.withColumns({"ended": F.coalesce("ended", F.lit("page_missing")), "complete": F.coalesce(F.col("n_rows") >= F.col("declared"), F.lit(False))})
    members = one.join(kept.select(key, page), [key, page], "left_semi").select(key, page, F.posexplode("rows").alias("place", "member"))
    return members, states


def ordered(df: DataFrame) -> DataFrame:
    """By score, the largest first, then by target."""
    return df.orderBy(F.desc_nulls_last("association_score"), F.asc("target_id"))


def complete(payloads: DataFrame) -> DataFrame:
    """(disease_id, n_rows, declared, complete): whether the landed pages hold as many rows as the payload declares."""
    by = payloads.groupBy(F.col("disease.id").alias("disease_id")).agg(F.sum(F.coalesce(F.size("associatedTargets.rows"), F.lit(0))).cast("long").alias("n_rows"), F.max("associatedTargets.count").cast("long").alias("declared"))
    return by.withColumn("complete", F.col("n_rows") >= F.col("declared"))


def land(payloads: DataFrame, path: str, source: str, mode: str = "error") -> None:
    """Payloads written as envelopes (created_at, source, data); ``mode`` ``overwrite`` refreshes what is there."""
    data = F.struct(*payloads.columns)
    payloads.select(F.current_timestamp().alias("created_at"), F.lit(source).alias("source"), data.alias("data")).write.mode(mode).json(path)


def landed(spark: SparkSession, path: str, fetch: Callable[[], DataFrame], source: str, refresh: bool = False) -> DataFrame:
    """Payloads read from where they landed; fetched and landed first if they haven't, or with ``refresh``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    if refresh or not there:
        land(fetch(), path, source, "overwrite")
    return read_payloads(spark, path)


def clear(spark: SparkSession, path: str) -> bool:
    """Delete what landed there; whether there was anything."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True))


def resolve_exact(requests: DataFrame, candidates: DataFrame, symbol: str = "symbol") -> DataFrame:
    """(symbol, state, target_id): resolved if exactly one validated candidate has the exact symbol. If one of the candidates
    of a request isn't validated, its answer is open."""
    exact = candidates.groupBy(F.col("query").alias(symbol)).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(F.col("validated"), F.lit(False))).alias("n_open"),
        F.count_distinct(F.when(F.col("approved_symbol") == F.col("query"), F.col("target_id"))).alias("n_exact"), F.min(F.when(F.col("approved_symbol") == F.col("query"), F.col("target_id"))).alias("target_id"),
    )
    joined = requests.select(symbol).distinct().join(exact, symbol, "left")
    state = F.when(F.coalesce(F.trim(symbol), F.lit("")) == "", "invalid_identifier").when(F.col("n").isNull(), "unresolved").when(F.col("n_open") > 0, "retrieval_failed").when(F.col("n_exact") == 1, "resolved_exact").when(F.col("n_exact") > 1, "ambiguous").otherwise("unresolved")
    return joined.select(symbol, state.alias("state"), F.when(state == "resolved_exact", F.col("target_id")).alias("target_id"))


def query_plan(requests: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """(request, step, operation): what is to be fetched for each request, in order; with ``done`` (request, operation) only the rest."""
    steps = F.array(*(F.struct(F.lit(k).alias("step"), F.lit(o).alias("operation")) for k, o in enumerate(("resolve", "fetch_record", "validate"), 1)))
    plan = requests.select(F.col("symbol").alias("request"), F.explode(steps).alias("x")).select("request", "x.*")
    return plan if done is None else plan.join(done, ["request", "operation"], "left_anti").select("request", "step", "operation")


def cached(entries: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, payload, state) of a cache keyed by content: one payload whose digest is right, else corrupt or ambiguous."""
    checked = entries.withColumn("__ok", F.sha2(payload, 256) == F.col("payload_sha256"))
    by = checked.groupBy(key).agg(F.count_distinct(payload).alias("n"), F.min("__ok").alias("ok"), F.min(payload).alias(payload))
    state = F.when(~F.coalesce(F.col("ok"), F.lit(False)), "corrupt").when(F.col("n") > 1, "ambiguous").otherwise("found")
    return by.select(key, F.when(state == "found", F.col(payload)).alias(payload), state.alias("state"))


def search_attempts(requests: DataFrame, results: DataFrame, key: str = "query") -> DataFrame:
    """One attempt for every request: not executed, failed with its category, no results, or success with their number.

    Of several results of a request the largest status code counts, so that a failure isn't hidden by a success."""
    by = results.groupBy(key).agg(F.max("status_code").alias("code"), F.max("hit_count").alias("hits"))
    joined = requests.join(by, key, "left")
    category = F.when(F.col("code") == 429, "rate_limited").when(F.col("code") >= 500, "server_error").when(F.col("code") >= 400, "client_error").when(F.col("code").isNotNull() & F.col("hits").isNull(), "invalid_response")
    status = F.when(F.col("code").isNull(), "not_executed").when(category.isNotNull(), "failed").when(F.col("hits") == 0, "success_zero_results").otherwise("success")
    return joined.select(*requests.columns, status.alias("status"), F.when(status.isin("success", "success_zero_results"), F.col("hits")).alias("result_count"), category.alias("error_category"))


def literature(results: DataFrame, column: str = "resultList") -> DataFrame:
    """Nested literature results to flat, nullable columns."""
    names = ("id", "source", "pmid", "doi", "title", "authorString", "journalTitle", "pubYear", "abstractText", "isOpenAccess")
    have = {f.name for f in results.schema[column].dataType["result"].dataType.elementType}
    one = results.select(F.explode(f"{column}.result").alias("r"))
    return one.select(*(F.col(f"r.{n}").cast("string").alias(n) if n in have else F.lit(None).cast("string").alias(n) for n in names))
