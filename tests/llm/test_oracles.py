import duckdb

from loomwork.llm import queries

SF = "/root/testdata/sf0.001"


def test_sql_agrees(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in queries.ORACLES.items():
        want = con.execute(sql)
        columns = [c[0] for c in want.description]
        got = sorted(tuple(r) for r in queries.QUERIES[name](spark, SF).select(*columns).collect())
        assert got == sorted(want.fetchall()), name
