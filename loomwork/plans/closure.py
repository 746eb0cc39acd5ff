"""Closed runs: stages whose results are written with their identity, restarted behind the last finished one, and compared."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import sanitized_error
from loomwork.operators import merkle

Results = Mapping[str, DataFrame]
#: What a stage comes to.
STATES = ("completed", "reused", "failed", "not_run")
_STATE = "stage string, position int, state string, n_rows long, hash string, inputs string, error string"


@dataclass(frozen=True)
class Stage:
    """A named step from the results before it to a table with a key."""

    name: str
    run: Callable[[Results], DataFrame]
    key: str


def _read_state(spark: SparkSession, path: str) -> dict | None:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_state")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    rows = spark.read.schema(_STATE).json(f"{path}/_state").collect()
    return rows[0].asDict() if len(rows) == 1 else None


def tree_of(df: DataFrame, key: str) -> DataFrame:
    marked = df.select(F.col(key), merkle.row_digest(df).alias("__digest"))
    return merkle.tree(marked, key, "__digest")


def run_closed(spark: SparkSession, path: str, stages: Sequence[Stage], fingerprint: str, preflight: Sequence[str] = ()) -> DataFrame:
    """(stage, position, state, n_rows, hash, inputs, error): a row a stage, in order.

    A stage is reused if its state is there, finished from the same ``fingerprint`` (of sources and settings) and the same
    results before it; else it is run, its table written, and its state last. A stage that fails ends the run: its error is kept without
    paths and secrets, and those behind it are ``not_run``. Names in ``preflight`` are issues found before: nothing is run with any.
    """
    results: dict[str, DataFrame] = {}
    states, chain, ended = [], hashlib.sha256(fingerprint.encode()).hexdigest(), bool(preflight)
    for position, stage in enumerate(stages):
        where, inputs = f"{path}/{stage.name}", chain
        if ended:
            states.append((stage.name, position, "not_run", None, None, inputs, "; ".join(preflight) or None))
            continue
        before = _read_state(spark, where)
        if before and before["state"] in ("completed", "reused") and before["inputs"] == inputs:
            row = (stage.name, position, "reused", before["n_rows"], before["hash"], inputs, None)
        else:
            try:
                stage.run(results).write.mode("overwrite").parquet(f"{where}/data")
                root = merkle.root(tree_of(spark.read.parquet(f"{where}/data"), stage.key)).first()
                row = (stage.name, position, "completed", root.n_rows, root.hash, inputs, None)
            except Exception as error:  # a failed stage is a result of the run
                told = spark.range(1).select(sanitized_error(F.lit(str(error).split("\n")[0]))).first()[0]
                row, ended = (stage.name, position, "failed", None, None, inputs, told), True
            spark.createDataFrame([row], _STATE).coalesce(1).write.mode("overwrite").json(f"{where}/_state")
        states.append(row)
        if not ended:
            results[stage.name] = spark.read.parquet(f"{where}/data")
            chain = hashlib.sha256(f"{inputs}\n{stage.name}\n{row[4]}".encode()).hexdigest()
    return spark.createDataFrame(states, _STATE)


def compare_closed(spark: SparkSession, one: str, other: str, stages: Sequence[Stage]) -> DataFrame:
    """(stage, state, n_added, n_removed, n_changed): whether two runs gave each stage the same rows. Roots tell; only stages whose
    roots differ are compared row by row. ``missing``: a run hasn't finished the stage."""
    rows = []
    for stage in stages:
        first, second = (_read_state(spark, f"{p}/{stage.name}") for p in (one, other))
        done = [s and s["state"] in ("completed", "reused") for s in (first, second)]
        if not all(done):
            rows.append((stage.name, "missing", None, None, None))
        elif first["hash"] == second["hash"]:
            rows.append((stage.name, "same", 0, 0, 0))
        else:
            tables = [spark.read.parquet(f"{p}/{stage.name}/data") for p in (one, other)]
            found = {r.state: r["count"] for r in merkle.changed_rows(*tables, stage.key).groupBy("state").count().collect()}
            rows.append((stage.name, "different", *(found.get(s, 0) for s in ("added", "removed", "changed"))))
    return spark.createDataFrame(rows, "stage string, state string, n_added long, n_removed long, n_changed long")


def decision(states: DataFrame, compared: DataFrame) -> DataFrame:
    """(state, n_unfinished, n_different): ``closed`` if all stages are finished and equal in both runs, else what stands against it."""
    unfinished = states.agg(F.count_if(F.col("state").isin("failed", "not_run")).alias("n_unfinished"))
    different = compared.agg(F.count_if(F.col("state") != "same").alias("n_different"))
    state = F.when(F.col("n_unfinished") > 0, "incomplete").when(F.col("n_different") > 0, "not_reproducible").otherwise("closed")
    return unfinished.join(F.broadcast(different)).select(state.alias("state"), "n_unfinished", "n_different")
