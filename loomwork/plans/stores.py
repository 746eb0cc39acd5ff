"""Registered queries of the record store, of trees of digests, and of two runs compared."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.operators import merkle
from loomwork.plans import closure
from loomwork.plans.catalog import _APPENDS as APPENDS
from loomwork.plans.catalog import register
from loomwork.session import ensure_checkpoint_dir
from loomwork.sources import associations, table
from loomwork.sources.store import RecordStore

# --- the record store -----------------------------------------------------------------------------------

_FIRST = APPENDS.replace("s AS (SELECT doc_id AS k, md5(text) AS g, lang AS b FROM documents WHERE n_chars >= 800)", "s AS (SELECT MIN(doc_id) AS k, md5(text) AS g, MIN(lang) AS b FROM documents WHERE n_chars >= 800 AND text IS NOT NULL GROUP BY 2)")


def _store(spark: SparkSession, sf_dir: str) -> RecordStore:
    """A store that holds each distinct longer text once."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/store-{uuid.uuid4().hex}"
    store = RecordStore.create(spark, path, "k bigint, digest string, body string", "k", "digest", "body", "1", digits=1)
    longer = table(spark, sf_dir, "documents").where("n_chars >= 800 and text is not null")
    first = longer.groupBy(F.md5(F.col("text").cast("binary")).alias("digest")).agg(F.min("doc_id").alias("k"), F.min("lang").alias("body"))
    store.append(first, "first")
    return store


@register(f"""WITH {_FIRST} SELECT r.k, r.g AS digest, r.b AS body, CASE WHEN COALESCE(sd.b, first_b) <> r.b THEN 'collision' WHEN sd.g IS NOT NULL OR by_g > 1 THEN 'duplicate' WHEN COALESCE(sk.g, first_g) <> r.g THEN 'rejected_mutation' ELSE 'new' END AS outcome
FROM r LEFT JOIN sd ON sd.g = r.g LEFT JOIN sk ON sk.k = r.k""")
def store_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second batch against a store on disk: clashing keys, digests and bodies."""
    docs = table(spark, sf_dir, "documents")
    row = lambda key, body: [key.alias("k"), F.md5(F.col("text").cast("binary")).alias("digest"), F.col(body).alias("body")]
    halves = docs.where("n_chars < 1200").select(*row(F.floor(F.col("doc_id") / 2), "source"))
    incoming = halves.unionByName(docs.where("n_chars BETWEEN 700 AND 1500").select(*row(F.col("doc_id"), "lang")))
    return _store(spark, sf_dir).append(incoming, "second")


@register(f"WITH {_FIRST} SELECT k, g AS digest, b AS body FROM s WHERE k % 13 = 0")
def store_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by key, by way of the keys' and the digests' partitions."""
    wanted = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k")).where("k % 13 = 0")
    return _store(spark, sf_dir).lookup(wanted)


@register(f"WITH {_FIRST} SELECT k, g AS digest, b AS body FROM s WHERE b IN ('fr', 'de')")
def store_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).scan({"body": ["fr", "de"]})


# --- trees of digests ---------------------------------------------------------------------------------------

@register("""WITH e AS (SELECT SHA256('{"k":"' || doc_id || '","d":' || COALESCE('"' || SHA256(text) || '"', 'null') || '}') AS entry, COUNT(*) AS n FROM documents GROUP BY 1),
two AS (SELECT SUBSTR(entry, 1, 2) AS prefix, SUM(n) AS n, SHA256(STRING_AGG(entry || ':' || n, chr(10) ORDER BY entry || ':' || n)) AS hash FROM e GROUP BY 1),
one AS (SELECT SUBSTR(prefix, 1, 1) AS prefix, SUM(n) AS n, SHA256(STRING_AGG(prefix || ':' || hash, chr(10) ORDER BY prefix || ':' || hash)) AS hash FROM two GROUP BY 1),
top AS (SELECT '' AS prefix, SUM(n) AS n, SHA256(STRING_AGG(prefix || ':' || hash, chr(10) ORDER BY prefix || ':' || hash)) AS hash FROM one)
SELECT 2 AS depth, prefix, CAST(n AS BIGINT) AS n_rows, hash FROM two UNION ALL SELECT 1, prefix, CAST(n AS BIGINT), hash FROM one UNION ALL SELECT 0, prefix, CAST(n AS BIGINT), hash FROM top""")
def digest_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the tree over documents and the digests of their texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return merkle.tree(docs, "doc_id", "digest", depth=2)


@register("""SELECT doc_id, CASE WHEN doc_id % 97 = 5 THEN 'removed' ELSE 'changed' END AS state, 1::BIGINT AS n_one, CASE WHEN doc_id % 97 = 5 THEN 0 ELSE 1 END::BIGINT AS n_other FROM documents WHERE doc_id % 97 = 5 OR doc_id % 101 = 7
UNION ALL SELECT -doc_id - 1, 'added', 0, 1 FROM documents WHERE doc_id % 89 = 3""")
def run_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over documents, the second with rows left out, changed and added: the rows that differ."""
    one = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    changed = one.where("doc_id % 97 <> 5").withColumn("source", F.when(F.col("doc_id") % 101 == 7, F.concat("source", F.lit("!"))).otherwise(F.col("source")))
    other = changed.unionByName(one.where("doc_id % 89 = 3").withColumn("doc_id", -F.col("doc_id") - 1))
    return merkle.changed_rows(one, other, "doc_id")


# --- landed pages -------------------------------------------------------------------------------------------

_PAGES = """r AS (SELECT s_nationkey AS k, s_suppkey, (ROW_NUMBER() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) AS pos, COUNT(*) OVER (PARTITION BY s_nationkey) AS total FROM supplier)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of each nation in pages of three; some nations declare more than there are, some have an empty page."""
    own = Window.partitionBy("s_nationkey")
    placed = table(spark, sf_dir, "supplier").withColumns({"at": F.row_number().over(own.orderBy("s_suppkey")) - 1, "total": F.count(F.lit(1)).over(own)})
    pages = placed.groupBy(F.col("s_nationkey").alias("k"), F.floor(F.col("at") / 3).cast("int").alias("page")).agg(F.array_sort(F.collect_list("s_suppkey")).alias("rows"), F.max("total").alias("declared"))
    empty = (F.col("k") % 4 == 1) & (F.col("page") == 1)
    return pages.withColumns({"rows": F.when(empty, F.slice("rows", 1, 0)).otherwise(F.col("rows")), "declared": F.col("declared") + F.when(F.col("k") % 5 == 0, 5).otherwise(0)})


@register(f"WITH {_PAGES} SELECT k, CAST(pos // 3 AS INT) AS page, CAST(pos % 3 AS INT) AS place, s_suppkey AS member FROM r WHERE pos < 9 AND (k % 4 <> 1 OR pos < 3)")
def page_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read page by page."""
    return associations.pages_read(_pages(spark, sf_dir), "k", "page", "rows", "declared", 3)[0]


@register(f"""WITH {_PAGES}, n AS (SELECT k, MAX(total) AS t, MAX(total) + CASE WHEN k % 5 = 0 THEN 5 ELSE 0 END AS d FROM r GROUP BY k)
SELECT k, CASE WHEN k % 4 = 1 THEN LEAST(2, CEIL(t / 3.0)) ELSE LEAST(3, CEIL(t / 3.0)) END::BIGINT AS n_pages, CASE WHEN k % 4 = 1 THEN LEAST(t, 3) ELSE LEAST(t, 9) END::BIGINT AS n_rows, d::BIGINT AS declared,
 CASE WHEN LEAST(t, CASE WHEN k % 4 = 1 THEN 3 ELSE 9 END) >= d THEN 'count_reached' WHEN k % 4 = 1 AND t > 3 THEN 'empty_page' WHEN k % 4 <> 1 AND t > 6 THEN 'page_limit' ELSE 'page_missing' END AS ended, LEAST(t, CASE WHEN k % 4 = 1 THEN 3 ELSE 9 END) >= d AS complete FROM n""")
def page_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the reading of each request's pages ended."""
    return associations.pages_read(_pages(spark, sf_dir), "k", "page", "rows", "declared", 3)[1]


# --- closed runs ---------------------------------------------------------------------------------------------

def _stages(spark: SparkSession, sf_dir: str, changed: int) -> list[closure.Stage]:
    """Documents, their words by source, and the larger sources; ``changed`` gives one document another source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") == changed, "elsewhere").otherwise(F.col("source")).alias("source"), "n_chars")
    by = lambda r: r["documents"].groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
    return [closure.Stage("documents", lambda r: docs, "doc_id"), closure.Stage("sources", by, "source"), closure.Stage("named", lambda r: r["sources"].select("source").where("source like 'src%'"), "source")]


@register("""WITH c AS (SELECT COUNT(*) AS n, MAX(CASE WHEN doc_id = 7 THEN source END) AS own FROM documents), o AS (SELECT COUNT(*) AS n FROM documents, c WHERE source = c.own)
SELECT 'documents' AS stage, 'different' AS state, 0::BIGINT AS n_added, 0::BIGINT AS n_removed, 1::BIGINT AS n_changed UNION ALL SELECT 'sources', 'different', 1, CASE WHEN o.n = 1 THEN 1 ELSE 0 END, CASE WHEN o.n = 1 THEN 0 ELSE 1 END FROM o
UNION ALL SELECT 'named', CASE WHEN o.n = 1 THEN 'different' ELSE 'same' END, 0, CASE WHEN o.n = 1 THEN 1 ELSE 0 END, 0 FROM o""")
def closed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of a chain of stages, one document changed: the stages and rows that differ."""
    ensure_checkpoint_dir(spark)
    paths = [f"{spark.sparkContext.getCheckpointDir()}/closed-{uuid.uuid4().hex}" for _ in range(2)]
    for path, changed in zip(paths, (-1, 7), strict=True):
        closure.run_closed(spark, path, _stages(spark, sf_dir, changed), f"documents {changed}")
    return closure.compare_closed(spark, *paths, _stages(spark, sf_dir, -1))
