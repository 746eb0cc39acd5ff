import json

from pyspark.sql import functions as F

from loomwork.sources import associations, matrices, sinks
from loomwork.streaming import appends


def test_associations(spark, tmp_path):
    row = {"score": 0.1, "datatypeScores": [{"id": "a", "score": 0.2}, {"id": None, "score": 1}, {"id": "a", "score": 0.3}], "datasourceScores": [], "target": {"id": "E1", "approvedSymbol": "AAA", "approvedName": "n", "biotype": "b"}}
    payload = {"disease": {"id": "D", "name": "d"}, "associatedTargets": {"count": 1, "rows": [row]}}
    (tmp_path / "a.json").write_text(json.dumps(payload, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"created_at": "x", "data": payload}))
    rows = associations.flatten(associations.read_payloads(spark, str(tmp_path))).collect()
    assert len(rows) == 2 and {(r.target_symbol, r.disease_id, r.association_score, r.datatype_scores["a"], len(r.datatype_scores)) for r in rows} == {("AAA", "D", 0.1, 0.3, 1)}


def test_matrices(spark, tmp_path):
    (tmp_path / "m.csv").write_text("ModelID,AAA (1),BBB (1),bad-\nM1,0.5,,x\nM1,1,2,3\n")
    df = matrices.read_wide(spark, str(tmp_path / "m.csv"))
    assert sorted((r.ModelID, r.issue) for r in matrices.structure_issues(df, "ModelID").collect()) == [("M1", "not_numeric"), ("M1", "repeated_key")]
    assert [r.state for r in matrices.label_index(df, "ModelID").orderBy("place").collect()] == ["resolved", "resolved", "unresolved_format"]
    assert matrices.subset(df, "ModelID", ["BBB (1)"]).columns == ["ModelID", "BBB (1)"]
    files = matrices.file_digests(spark, str(tmp_path))
    manifest = files.select("name", "length", F.lit("0").alias("sha256"))
    assert [r.state for r in matrices.release_state(files, manifest).collect()] == ["hash_mismatch"]
    assert [r.state for r in matrices.release_state(files, files).collect()] == ["verified"]


def test_snapshot(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, None), (2, "b")], "k int, v string")
    sinks.export_snapshot({"one": df, "two": df.limit(1)}, str(tmp_path / "s"))
    assert {r.table: r.state for r in sinks.verify_snapshot(spark, str(tmp_path / "s")).collect()} == {"one": "verified", "two": "verified"}
    df.limit(2).write.mode("overwrite").parquet(str(tmp_path / "s" / "one"))
    assert {r.table: r.state for r in sinks.verify_snapshot(spark, str(tmp_path / "s")).collect()}["one"] == "row_count_mismatch"


def test_cards(spark):
    row = spark.range(1).select(sinks.markdown_card(F.lit("a_b"), score=F.lit(0.5), none=F.lit(None).cast("string")).alias("m"), sinks.html_card(F.lit("<t>"), x=F.lit("&")).alias("h")).first()
    assert row.m == "# a\\_b\n\n- **score**: 0.5\n- **none**: not available" and "&lt;t&gt;" in row.h and "&amp;" in row.h


def test_stream_appends_once(spark, tmp_path):
    source, store, mark = (str(tmp_path / n) for n in ("in", "store", "mark"))
    fields = "id long, h string, b string"
    for ids in ([1, 2, 2], [2, 3]):
        spark.createDataFrame([(i, f"h{i}", "b") for i in ids], fields).write.mode("append").parquet(source)
        stream = spark.readStream.schema(fields).parquet(source)
        appends.append_new(stream, store, "id", mark, "h", "b").start().awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(store).collect()) == [1, 2, 3]
    # a fresh checkpoint over the same store adds to it, and audits what it has
    other = str(tmp_path / "other")
    spark.createDataFrame([(3, "changed", "b"), (4, "h4", "b"), (5, "h4", "c")], fields).write.parquet(other)
    appends.append_new(spark.readStream.schema(fields).parquet(other), store, "id", str(tmp_path / "mark2"), "h", "b").start().awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(store).collect()) == [1, 2, 3, 4]
    assert {(r.id, r.outcome) for r in spark.read.parquet(store + "_audit").collect()} >= {(2, "duplicate"), (3, "rejected_mutation"), (5, "collision")}
