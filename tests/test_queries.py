"""Every registered query with SQL against DuckDB at the smallest scale."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from loomwork.plans import catalog, chains, records, reviews, stores, targets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


assert chains and records and reviews and stores and targets  # register their queries


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    key = lambda v: "NULL" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{float(v):.12g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(key(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, database, name):
    df = catalog.QUERIES[name](spark, SF)
    want = database.execute(catalog.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain(df.collect(), df.columns) == plain(want.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_task_sees_a_whole_table(spark):
    """Rows meet in one partition only as aggregates, as counts of partitions, or as the first k."""
    for name in ("ranked_parts", "midrank_percentile", "bounded_overlay", "benchmark_predictions", "intent_metrics", "ranking_metrics", "group_quantiles", "sensitivity_summary", "lineage_roots", "ontology_annotate"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().splitlines()
        for k, line in enumerate(plan):
            if "SinglePartition" in line:
                below = plan[k + 1]
                assert "Aggregate(keys=[]" in below or "__part" in below or "__p#" in below or "Limit" in below, (name, below)
