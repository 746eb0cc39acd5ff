"""Registered queries over nested records: walks, canonical texts, deny-lists, and structured responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import nested
from loomwork.operators import extraction, lexicons
from loomwork.plans.catalog import register
from loomwork.sources import table

# --- events and conversations as nested JSON ------------------------------------------------------------

_EVENT = """'{"z":[' || user_id || ',{"b":null,"a":"' || event_type || '"}], "props": ' || props || ',"list":["' || event_type || '",' || (user_id % 10) || ',"b",{"n":[' || (user_id % 7) || ',3]}], "m n":true}'"""
_TURN = "json_object('turn', turn, 'said', json_object('role', role, 'text', text), 'parts', to_json(string_split(role, 's')), 'user_secret', conv_id)"
_KIND = "CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END"
_VALUE = "CASE WHEN type IN ('OBJECT', 'ARRAY') THEN NULL WHEN type = 'NULL' THEN 'null' ELSE value->>'$' END"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.expr(_EVENT).alias("json"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.struct("role", "text").alias("said")
    whole = F.struct("turn", said, F.split("role", "s").alias("parts"), F.col("conv_id").alias("user_secret"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(whole).alias("json"))


@register(f"SELECT event_id, fullkey AS path, {_KIND} AS type, {_VALUE} AS value FROM (SELECT event_id, {_EVENT} AS j FROM events) e, json_tree(e.j)")
def nested_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of every event's record."""
    return nested.walk(_events(spark, sf_dir).select("event_id", "json"), ["event_id"], "json").select("event_id", "path", "type", "value")


@register(f"SELECT conv_id, turn, fullkey AS path, {_KIND} AS type, {_VALUE} AS value FROM (SELECT conv_id, turn, {_TURN} AS j FROM conversations) c, json_tree(c.j) t")
def nested_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of every turn's record, whole texts among them."""
    return nested.walk(_turns(spark, sf_dir), ["conv_id", "turn"], "json").select("conv_id", "turn", "path", "type", "value")


_PLAIN = """'{"list":["' || event_type || '",' || (user_id % 10) || ',"b",{"n":[' || (user_id % 7) || ',3]}],"m n":true,"props":' || REPLACE(props, ' ', '') || ',"z":[' || user_id || ',{"a":"' || event_type || '","b":null}]}'"""
_SORTED = """'{"list":[' || ARRAY_TO_STRING(LIST_SORT(['"' || event_type || '"', (user_id % 10)::VARCHAR, '"b"', '{"n":[' || LEAST(user_id % 7, 3) || ',' || GREATEST(user_id % 7, 3) || ']}']), ',') || '],"m n":true,"props":' || REPLACE(props, ' ', '') || ',"z":[' || user_id || ',{"a":"' || event_type || '","b":null}]}'"""


@register(f"SELECT event_id, {_PLAIN} AS canonical, 'record_' || SHA256({_PLAIN}) AS content_id, {_SORTED} AS unordered FROM events")
def nested_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical texts with sorted keys, their ids, and texts that no order of a list changes."""
    rows = _events(spark, sf_dir).select("event_id", "json").withColumn("canonical", nested.canonical(F.col("json")))
    rows = rows.withColumn("content_id", F.concat(F.lit("record_"), F.sha2("canonical", 256)))
    return nested.canonical_unordered(rows, ["event_id", "canonical", "content_id"], "json", "unordered")


@register(f"""WITH n AS (SELECT conv_id, turn, fullkey AS path, key, type, value->>'$' AS v FROM (SELECT conv_id, turn, {_TURN} AS j FROM conversations) c, json_tree(c.j) t)
SELECT conv_id, turn, path, 'name' AS kind FROM n WHERE LOWER(key) LIKE '%secret%' OR LOWER(key) LIKE '%token%' UNION ALL SELECT conv_id, turn, path, 'value' FROM n WHERE type = 'VARCHAR' AND (LOWER(v) LIKE '%password%' OR LOWER(v) LIKE '%license%' OR LOWER(v) LIKE '%assist%')""")
def nested_forbidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields with a forbidden name, and texts with a forbidden word, by path."""
    return nested.forbidden(_turns(spark, sf_dir), ["conv_id", "turn"], "json", ["secret", "token"], ["password", "license", "assist"])


# --- structured responses about documents -----------------------------------------------------------------

SCHEMA = extraction.Schema("claims", "1.0.0")
_SOURCE = "COALESCE(text, '') || ' Here ends document ' || doc_id || ', and nothing follows it at all, dear reader.'"


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'"{name}":'), value)


def _object(*fields: Column) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))


def _claim(said: Column, quote: Column, start: Column, end: Column, stance: str = "supports", more: Column | None = None) -> Column:
    whole = [_field("stance", F.lit(f'"{stance}"')), _field("claim_text", nested.quoted(said)), _field("quote_start", start.cast("string")), _field("quoted_span", nested.quoted(quote)), _field("quote_end", end.cast("string"))]
    return _object(*whole, *([more] if more is not None else []))


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response a document; the remainder of its id by 20 tells what is wrong with it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_SOURCE).alias("source_text"))
    case, source = F.col("doc_id") % 20, F.col("source_text")
    quote, zero, forty = F.substring(source, 1, 40), F.lit(0), F.lit(40)
    good = _claim(F.lit("it says so"), quote, zero, forty)
    claims = {
        0: F.concat(good, F.lit(","), good, F.lit(","), _claim(F.lit("it says \"so\""), quote, zero, forty, "contextual", _field("species_mentions", F.lit('["mouse"]')))), 7: F.lit('"a claim"'),
        8: _claim(F.lit("x"), quote, zero, forty, more=_field("colour", F.lit("1"))), 9: _claim(F.lit("  "), quote, zero, forty), 10: _claim(F.lit("x"), F.lit(""), zero, forty), 11: _claim(F.lit("x"), quote, F.lit('"0"'), forty),
        12: _claim(F.lit("x"), quote, zero, F.length(source) + 5), 13: _claim(F.lit("x"), quote, F.lit(1), F.lit(41)), 14: _claim(F.lit("x"), F.lit("#!not there!#"), zero, forty),
        15: _claim(F.lit("x"), F.lit("e"), F.length(source) - 1, F.length(source)), 16: _claim(F.lit("x"), quote, zero, forty, "maybe"), 17: _claim(F.lit("x"), quote, zero, forty, more=_field("reasoning", F.lit('"y"'))),
        18: _claim(F.lit("x"), quote, zero, forty, more=_field("target_mentions", F.lit('["a",1]'))), 19: F.lit(""),
    }
    listed = good
    for number, text in claims.items():
        listed = F.when(case == number, text).otherwise(listed)
    inside = F.when(case == 6, _object(_field("n", F.lit("1")))).otherwise(F.concat(F.lit("["), listed, F.lit("]")))
    document = F.when(case == 5, "another").otherwise(F.col("doc_id").cast("string"))
    output = _object(_field("schema_version", F.when(case == 4, '"2.0.0"').otherwise('"1.0.0"')), _field("source_document_id", nested.quoted(document)), _field("claims", inside), _field("schema_id", F.lit('"claims"')))
    output = F.when(case == 3, "[]").when(case != 2, output)
    own = F.col("doc_id").cast("string")
    return docs.select(
        "doc_id", "source_text", F.when(case == 1, "failed").otherwise("success").alias("status"), own.alias("request_id"), own.alias("own_request_id"), own.alias("source_document_id"), own.alias("own_document_id"),
        *(F.lit(v).alias(n) for n, v in (("request_schema_id", "claims"), ("request_schema_version", "1.0.0"), ("schema_id", "claims"), ("schema_version", "1.0.0"))), output.alias("structured_output"),
    )


@register(f"""WITH d AS (SELECT doc_id, doc_id % 20 AS k, {_SOURCE} AS s FROM documents), x AS (SELECT *, UNNEST(CASE WHEN k = 0 THEN [0, 1, 2] WHEN k BETWEEN 1 AND 6 THEN [NULL] WHEN k = 19 THEN [] ELSE [0] END) AS claim_index FROM d)
SELECT doc_id, CAST(COALESCE(claim_index, -1) AS INT) AS claim_index, CASE k WHEN 0 THEN CASE WHEN claim_index = 1 THEN 'duplicate_candidate' END WHEN 1 THEN 'response_not_successful' WHEN 2 THEN 'structured_output_missing' WHEN 3 THEN 'invalid_top_level_shape' WHEN 4 THEN 'schema_mismatch' WHEN 5 THEN 'source_document_mismatch' WHEN 6 THEN 'claims_not_array'
 WHEN 7 THEN 'claim_not_object' WHEN 8 THEN 'unknown_claim_field' WHEN 9 THEN 'empty_claim_text' WHEN 10 THEN 'empty_quote' WHEN 11 THEN 'invalid_offset_type' WHEN 12 THEN 'invalid_offset_range'
 WHEN 13 THEN CASE WHEN SUBSTR(s, 2, 40) = SUBSTR(s, 1, 40) THEN NULL WHEN LENGTH(s) - LENGTH(REPLACE(s, SUBSTR(s, 1, 40), '')) > 40 THEN 'ambiguous_quote' ELSE 'quote_mismatch' END
 WHEN 14 THEN 'quote_not_found' WHEN 15 THEN 'ambiguous_quote' WHEN 16 THEN 'invalid_stance' WHEN 17 THEN 'hidden_reasoning_field' WHEN 18 THEN 'malformed_optional_field' END AS code FROM x""")
def extraction_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every claim of every response, and every rejected response, with its code."""
    found = extraction.extract_claims(_responses(spark, sf_dir), SCHEMA, locate=True)
    return found.withColumn("claim_index", F.coalesce("claim_index", F.lit(-1))).select("doc_id", "claim_index", "code")


SYNTHESIS = extraction.Synthesis(extraction.Schema("synthesis", "1.0.0"), ("overview", "limits"), ("supports", "mixed"), ("low", "high"), ("out_of_scope",))
ISSUES = ("", "not_json", "not_an_object", "fields_invalid", "schema_mismatch", "identity_invalid", "sections_invalid", "boundary_invalid", "statement_fields_invalid", "statement_key_invalid", "statement_values_invalid", "limitation_invalid", "coverage_invalid", "coverage_reason_invalid")


@register("SELECT doc_id, CASE doc_id % 14 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(ISSUES) if x) + " END AS issue FROM documents")
def synthesis_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A synthesis response a document; the remainder of its id by 14 tells what is wrong with it."""
    case = F.col("doc_id") % 14
    pick = lambda usual, **other: _pick(case, usual, other)
    statement = lambda key, section, more="": f'{{"local_statement_key":"{key}","section_identifier":"{section}","statement_text":"t","evidence_item_ids":["e1"],"support_relation":"supports","uncertainty_level":"low"{more}}}'
    first = pick(statement("a", "overview"), k8=statement("a", "overview", ',"x":1'), k10=statement("a", "elsewhere"), k11=statement("a", "overview", ',"limitation_text":3'))
    second = pick(statement("b", "limits", ',"limitation_text":null'), k9=statement("a", "limits"))
    coverage = pick('{"evidence_item_id":"e1","disposition":"cited"},{"evidence_item_id":"e2","disposition":"unsynthesized","reason":"out_of_scope"}', k12='{"evidence_item_id":"e1","disposition":"cited"},{"evidence_item_id":"e1","disposition":"cited"}', k13='{"evidence_item_id":"e1","disposition":"unsynthesized"}')
    whole = _object(
        _field("schema_id", F.lit('"synthesis"')), _field("schema_version", pick('"1.0.0"', k4='"1.0.1"')), _field("snapshot_id", nested.quoted(F.col("doc_id").cast("string"))), _field("inventory_id", pick('"i"', k5='" "')), _field("target_identity", F.lit('"t"')), _field("synthesis_purpose", F.lit('"p"')),
        _field("sections", pick('["overview","limits"]', k6='["limits","limits"]')), _field("statements", F.concat(F.lit("["), first, F.lit(","), second, F.lit("]"))), _field("evidence_coverage", F.concat(F.lit("["), coverage, F.lit("]"))), _field("research_only", pick("true", k7="1")), _field("non_clinical_use", F.lit("true"))
    )
    extra = F.when(case == 3, F.concat(F.lit('{"y":0,'), F.expr("substring(w, 2)")))
    docs = table(spark, sf_dir, "documents").select("doc_id", whole.alias("w"))
    output = F.when(case == 1, F.concat("w", F.lit("}"))).when(case == 2, F.concat(F.lit("["), "w", F.lit("]"))).otherwise(F.coalesce(extra, F.col("w")))
    return extraction.parse_synthesis(docs.select("doc_id", output.alias("structured_output")), SYNTHESIS).select("doc_id", "issue")


def _pick(case: Column, usual: str, other: dict[str, str]) -> Column:
    out = F.lit(usual)
    for name, text in other.items():
        out = F.when(case == int(name[1:]), text).otherwise(out)
    return out


# --- lexicons ------------------------------------------------------------------------------------------------

_WORDS = "w AS (SELECT DISTINCT LOWER(word) AS marker FROM (SELECT UNNEST(STRING_SPLIT(text, ' ')) AS word FROM benchmark) WHERE LENGTH(word) >= 6)"


@register(f"""WITH {_WORDS}, l AS (SELECT marker, 'c' || (LENGTH(marker) % 7) AS code, CASE LENGTH(marker) % 9 WHEN 0 THEN 'blocker' WHEN 1 THEN 'warning' ELSE 'note' END AS severity FROM w),
h AS (SELECT d.doc_id, l.* FROM documents d JOIN l ON CONTAINS(LOWER(d.text), l.marker))
SELECT d.doc_id, COUNT(DISTINCT h.marker) AS n_markers, '[' || COALESCE(STRING_AGG(DISTINCT '"' || h.code || '"', ',' ORDER BY '"' || h.code || '"'), '') || ']' AS findings,
 CASE WHEN COUNT_IF(h.severity = 'blocker') > 0 THEN 'block' WHEN COUNT_IF(h.severity = 'warning') > 0 THEN 'review' ELSE 'pass' END AS decision FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id GROUP BY 1""")
def lexicon_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents against a lexicon of all longer words of the benchmark."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("word")).where(F.length("word") >= 6).select(F.lower("word").alias("marker")).distinct()
    size = F.length("marker")
    lexicon = words.select("marker", F.concat(F.lit("c"), (size % 7).cast("string")).alias("code"), F.when(size % 9 == 0, "blocker").when(size % 9 == 1, "warning").otherwise("note").alias("severity"))
    return lexicons.lexicon_audit(table(spark, sf_dir, "documents"), "doc_id", "text", lexicon)
