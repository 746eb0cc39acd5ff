"""Nested JSON: strict parsing, canonical texts, walks, deny-lists, responses."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwork.functions import nested
from loomwork.operators import extraction


def column(spark, texts, c):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, j string").select("k", c(F.col("j")).alias("x")).collect()
    return [r.x for r in sorted(rows)]


values = st.recursive(st.none() | st.booleans() | st.integers(-(2**62), 2**62) | st.text(st.characters(max_codepoint=0xD7FF, min_codepoint=32), max_size=8), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(st.characters(max_codepoint=0xD7FF, min_codepoint=32), max_size=5), x, max_size=4), max_leaves=20)


def plain_nodes(value, path="$"):
    yield path, value
    if isinstance(value, dict):
        for k, v in value.items():
            simple = k != "" and all(c.isascii() and (c.isalnum() or c == "_") for c in k)
            yield from plain_nodes(v, f"{path}.{k}" if simple else f"{path}.{json.dumps(k, ensure_ascii=False)}")
    elif isinstance(value, list):
        for k, v in enumerate(value):
            yield from plain_nodes(v, f"{path}[{k}]")


def unordered(value):
    dumped = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    if isinstance(value, dict):
        return {k: unordered(v) for k, v in value.items()}
    return sorted((unordered(v) for v in value), key=dumped) if isinstance(value, list) else value


@settings(max_examples=2, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(values, min_size=30, max_size=30))
def test_against_plain_walks(spark, found):
    dumped = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    texts = [json.dumps(v, indent=1) for v in found]
    assert column(spark, texts, nested.canonical) == [dumped(v) for v in found]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, j string")
    nodes = {(r.k, r.path): (r.type, r.value) for r in nested.walk(df, ["k"], "j").collect()}
    kind = lambda v: "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, int) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"
    shown = lambda v: v if isinstance(v, str) else None if isinstance(v, (list, dict)) else json.dumps(v)
    assert nodes == {(k, p): (kind(v), shown(v)) for k, value in enumerate(found) for p, v in plain_nodes(value)}
    free = {r.k: r.c for r in nested.canonical_unordered(df, ["k"], "j", "c").collect()}
    assert free == {k: dumped(unordered(v)) for k, v in enumerate(found)}


def test_what_is_not_json(spark):
    bad = ["", "{", '{"a":1} x', "1 2", "1,2", '{"a":1,"a":2}', '{"a":NaN}', "[1,]", None]
    assert column(spark, bad, nested.canonical) == [None] * len(bad)
    assert column(spark, ["1.50", "1.0", "null", ' {"b":1,"a":[]} ', '"x"'], nested.canonical) == ["1.5", "1", "null", '{"a":[],"b":1}', '"x"']
    df = spark.createDataFrame([(1, None), (2, "{")], "k int, j string")
    assert nested.walk(df, ["k"], "j").count() == 0 and nested.canonical_unordered(df, ["k"], "j").count() == 0


def test_deny_list_by_name_and_value(spark):
    df = spark.createDataFrame([(1, '{"a":{"API_Key":1},"b":["the PASSWORD is x",{"c":"fine"}],"token":{"token":"a.b"}}'), (2, '{"a":"key"}')], "k int, j string")
    got = sorted(tuple(r) for r in nested.forbidden(df, ["k"], "j", ["api_key", "token"], ["password", "a.b"]).collect())
    assert got == [(1, "$.a.API_Key", "name"), (1, "$.b[0]", "value"), (1, "$.token", "name"), (1, "$.token.token", "name"), (1, "$.token.token", "value")]


def test_list_fields(spark):
    texts = ['{"x":[1,"a"]}', '{"x":{"rows":[2],"count":1}}', '{"x":{"n":1}}', '{"x":null}', "{}", '{"x":"s"}', '{"x":{"rows":3}}']
    state = column(spark, texts, lambda c: nested.list_field(nested.parsed(c), "x")[0])
    size = column(spark, texts, lambda c: F.size(nested.list_field(nested.parsed(c), "x")[1]))
    assert state == ["items", "items", "bad_shape", "missing", "missing", "bad_shape", "bad_shape"] and size[:2] == [2, 1]


SOURCE = "alpha beta alpha é gamma."


def response(claims, **change):
    whole = {"schema_id": "s", "schema_version": "1", "source_document_id": "d", "claims": claims} | change.pop("output", {})
    row = {"status": "success", "request_id": "r", "own_request_id": "r", "source_document_id": "d", "own_document_id": "d", "request_schema_id": "s", "request_schema_version": "1", "schema_id": "s", "schema_version": "1", "source_text": SOURCE, "structured_output": json.dumps(whole)}
    return row | change


def claim(**change):
    return {"claim_text": "t", "quoted_span": "é gamma", "quote_start": 17, "quote_end": 24, "stance": "supports"} | change


CASES = [
    (response([claim()]), [None]), (response([]), []), (response([claim(), claim(), claim(stance="unclear")]), [None, "duplicate_candidate", None]),
    (response([], status="timeout"), ["response_not_successful"]), (response([], structured_output=None), ["structured_output_missing"]), (response([], structured_output="[]"), ["invalid_top_level_shape"]),
    (response([], output={"x": 1}), ["invalid_top_level_shape"]), (response([], own_request_id="q"), ["source_document_mismatch"]), (response([], output={"schema_version": "2"}), ["schema_mismatch"]), (response([], request_schema_id="t"), ["schema_mismatch"]),
    (response([], output={"source_document_id": 3}), ["source_document_mismatch"]), (response({"a": 1}), ["claims_not_array"]),
    (response([1, claim(x=1), claim(analysis="a", x=1), {"claim_text": "t"}, {k: v for k, v in claim().items() if k != "stance"}]), ["claim_not_object", "unknown_claim_field", "hidden_reasoning_field", "invalid_offset_type", "claim_not_object"]),
    (response([claim(claim_text=" \t"), claim(claim_text=3), claim(quoted_span=""), claim(quote_start=True), claim(quote_start=17.0), claim(quote_end=10**25), claim(quote_end=17), claim(quote_start=-1)]), ["empty_claim_text", "empty_claim_text", "empty_quote", "invalid_offset_type", "invalid_offset_type", "invalid_offset_range", "invalid_offset_range", "invalid_offset_range"]),
    (response([claim(quote_start=16, quote_end=23), claim(quoted_span="é gamm"), claim(quoted_span="alpha", quote_start=1, quote_end=6), claim(quoted_span="delta"), claim(quoted_span="a\\E.*", quote_start=1, quote_end=5)]), ["quote_mismatch", "quote_mismatch", "ambiguous_quote", "quote_not_found", "quote_not_found"]),
    (response([claim(stance="yes"), claim(species_mentions="mouse"), claim(species_mentions=["mouse", 1]), claim(limitations=None), claim(limitations="few", species_mentions=[])]), ["invalid_stance", "malformed_optional_field", "malformed_optional_field", "malformed_optional_field", None]),
]


def test_every_code(spark):
    names = list(response([]))
    df = spark.createDataFrame([(k, *(row[n] for n in names)) for k, (row, _) in enumerate(CASES)], "k int, " + ", ".join(f"{n} string" for n in names))
    for locate in (True, False):
        got = {}
        for r in extraction.extract_claims(df, extraction.Schema("s", "1"), locate=locate).collect():
            got.setdefault(r.k, []).append((-1 if r.claim_index is None else r.claim_index, r.code, r.candidate_id))
        for k, (_, want) in enumerate(CASES):
            codes = [code for _, code, _ in sorted(got.get(k, []), key=lambda x: x[0])]
            assert codes == (want if locate else ["quote_mismatch" if c in ("ambiguous_quote", "quote_not_found") else c for c in want]), k
        assert all((cid is None) == (code not in (None, "duplicate_candidate")) for rows in got.values() for _, code, cid in rows)
    used = {c for _, want in CASES for c in want if c}
    assert used == {*extraction.RESPONSE_CODES, *extraction.CLAIM_CODES}


def test_synthesis_needs_each_field(spark):
    from loomwork.plans.records import SYNTHESIS

    good = {"schema_id": "synthesis", "schema_version": "1.0.0", "snapshot_id": "a", "inventory_id": "b", "target_identity": "c", "synthesis_purpose": "d", "sections": [], "statements": [], "evidence_coverage": [], "research_only": True, "non_clinical_use": True}
    cases = [good, *({k: v for k, v in good.items() if k != missing} for missing in good), good | {"research_only": False}, good | {"sections": ["x"]}, good | {"statements": {}}, good | {"statements": [1]}, good | {"target_identity": None}]
    df = spark.createDataFrame([(k, json.dumps(c)) for k, c in enumerate(cases)], "k int, structured_output string")
    got = [r.issue for r in sorted(extraction.parse_synthesis(df, SYNTHESIS).collect())]
    assert got == [None, *["fields_invalid"] * len(good), "boundary_invalid", "sections_invalid", "boundary_invalid", "statement_fields_invalid", "identity_invalid"]
    assert extraction.parse_synthesis(df, SYNTHESIS).where("issue is null").first().response == json.dumps(good, sort_keys=True, separators=(",", ":"))
    with pytest.raises(AttributeError):
        SYNTHESIS.sections = ()


def test_shallow_texts_are_neither_written_nor_shuffled(spark):
    """Walks and folds of usual depth are one pass over the texts."""
    df = spark.range(20).selectExpr("id as k", """'{"z":[' || id || ',{"b":null,"a":[3,1]}],"m n":true}' as j""")
    for found in (nested.walk(df, ["k"], "j"), nested.canonical_unordered(df, ["k"], "j", "c")):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "ExistingRDD" not in plan and "Exchange" not in plan and "Join" not in plan


def test_any_depth(spark):
    """Around the number of levels of a round, and far beyond it; brackets in strings don't nest."""
    texts = {}
    for depth in (0, 1, nested.ROW_LEVELS - 1, nested.ROW_LEVELS, nested.ROW_LEVELS + 1, 2 * nested.ROW_LEVELS + 1):
        value = '\\"[[{{'
        for k in range(depth):
            value = {"b": [3, k, "]"], "a": value} if k % 2 else ["x", value, "b"]
        texts[depth] = value
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in texts.items()], "k int, j string")
    nodes = {(r.k, r.path) for r in nested.walk(df, ["k"], "j").collect()}
    assert nodes == {(k, p) for k, v in texts.items() for p, _ in plain_nodes(v)}
    free = {r.k: r.c for r in nested.canonical_unordered(df, ["k"], "j", "c").collect()}
    assert free == {k: json.dumps(unordered(v), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for k, v in texts.items()}
