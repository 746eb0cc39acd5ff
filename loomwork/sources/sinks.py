"""Writers: tables with a manifest, sorted snapshots and their verification, rendered cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import escape_html, escape_markdown
from loomwork.operators import merkle


def write_csv(df: DataFrame, path: str, separator: str = ",") -> None:
    df.write.mode("overwrite").csv(path, header=True, sep=separator)


def table_tree(df: DataFrame, depth: int | None = None) -> DataFrame:
    """The tree of digests over all rows and columns of a table (``merkle.tree``)."""
    marked = df.select(merkle.row_digest(df).alias("digest"))
    return merkle.tree(marked, "digest", "digest", depth)


def table_digest(df: DataFrame) -> DataFrame:
    """(n_rows, digest): the root of a table's tree, which no order or partitioning changes."""
    return merkle.root(table_tree(df)).select("n_rows", F.col("hash").alias("digest"))


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def export_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet, range-partitioned and sorted by all columns; the manifest is written last, and an export
    that fails is removed."""
    spark = next(iter(tables.values())).sparkSession
    try:
        manifest = None
        for name, df in tables.items():
            df.repartitionByRange(*df.columns).sortWithinPartitions(*df.columns).write.mode("overwrite").parquet(f"{path}/{name}")
            row = table_digest(df).withColumn("table", F.lit(name))
            manifest = row if manifest is None else manifest.unionByName(row)
        manifest.write.mode("overwrite").parquet(f"{path}/_manifest_table")
    except Exception:
        _delete(spark, path)
        raise


def write_bundle(tables: dict[str, DataFrame], path: str, manifest: dict[str, str], formats: dict[str, str] | None = None, checks: dict[str, DataFrame] | None = None) -> None:
    """Several tables below one path, and a manifest of names, rows, digests and the given fields, written last.

    ``formats`` gives a table's format: csv, tsv, json or parquet (the default is tsv; nested values become JSON texts). A
    row in one of ``checks`` (issues by name) stops the export before anything is written. A failed export is removed.
    """
    for name, issues in (checks or {}).items():
        if found := issues.take(1):
            raise ValueError(f"{name}: {found[0]}")
    spark = next(iter(tables.values())).sparkSession
    try:
        rows = None
        for name, df in tables.items():
            kind = (formats or {}).get(name, "tsv")
            if kind == "parquet":
                df.write.mode("overwrite").parquet(f"{path}/{name}")
            elif kind == "json":
                df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{name}")
            else:
                write_csv(flat(df), f"{path}/{name}", "\t" if kind == "tsv" else ",")
            row = table_digest(df).select(F.lit(name).alias("table"), F.lit(kind).alias("format"), "n_rows", "digest")
            rows = row if rows is None else rows.unionByName(row)
        rows.withColumns({k: F.lit(v) for k, v in manifest.items()}).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    except Exception:
        _delete(spark, path)
        raise


def flat(df: DataFrame) -> DataFrame:
    """Columns sorted by name, nested values as JSON texts."""
    return df.select(*(F.to_json(f"`{c}`").alias(c) if t.startswith(("array", "struct", "map")) else F.col(f"`{c}`") for c, t in sorted(df.dtypes)))


def verify_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """(table, state) of every table that the manifest names."""
    manifest = spark.read.parquet(f"{path}/_manifest_table")
    found = None
    for row in manifest.select("table").collect():  # one row per table
        now = table_digest(spark.read.parquet(f"{path}/{row.table}")).select(F.lit(row.table).alias("table"), F.col("n_rows").alias("n"), F.col("digest").alias("d"))
        found = now if found is None else found.unionByName(now)
    state = F.when(F.col("n_rows") != F.col("n"), "row_count_mismatch").when(F.col("digest") != F.col("d"), "digest_mismatch").otherwise("verified")
    return manifest.join(found, "table").select("table", state.alias("state"))


def markdown_card(title: Column, **fields: Column) -> Column:
    lines = [F.concat(F.lit(f"- **{name}**: "), F.coalesce(escape_markdown(c.cast("string")), F.lit("not available"))) for name, c in fields.items()]
    return F.concat_ws("\n", F.concat(F.lit("# "), escape_markdown(title)), F.lit(""), *lines)


def html_card(title: Column, **fields: Column) -> Column:
    rows = [F.concat(F.lit(f"<tr><th>{name}</th><td>"), F.coalesce(escape_html(c.cast("string")), F.lit("not available")), F.lit("</td></tr>")) for name, c in fields.items()]
    return F.concat(F.lit("<h1>"), escape_html(title), F.lit("</h1><table>"), *rows, F.lit("</table>"))


def note(front: dict[str, Column], title: Column, sections: dict[str, Column]) -> Column:
    """A Markdown note with YAML front matter; values are quoted as JSON strings, which YAML reads."""
    quoted = lambda c: F.to_json(F.array(F.coalesce(c.cast("string"), F.lit(""))))
    head = [F.concat(F.lit(f"{k}: "), F.regexp_replace(quoted(c), r"^\[|\]$", "")) for k, c in front.items()]
    body = [F.concat(F.lit(f"## {name}\n\n"), F.coalesce(escape_markdown(c.cast("string")), F.lit("not available"))) for name, c in sections.items()]
    return F.concat_ws("\n", F.lit("---"), *head, F.lit("---"), F.concat(F.lit("# "), escape_markdown(title)), *body)


def note_plan(notes: DataFrame, existing: DataFrame, name: str = "name", text: str = "text") -> DataFrame:
    """What an export does with each note: create, skip (same content), or refuse (other content, or a name twice)."""
    have = existing.select(F.col(name).alias("__n"), F.sha2(text, 256).alias("__h"))
    twice = notes.groupBy(F.col(name).alias("__t")).count().where("count > 1").select("__t")
    joined = notes.join(have, F.col(name) == F.col("__n"), "left").join(twice, F.col(name) == F.col("__t"), "left")
    action = F.when(F.col("__t").isNotNull(), "refuse_repeated").when(F.col("__n").isNull(), "create").when(F.col("__h") == F.sha2(text, 256), "skip").otherwise("refuse_changed")
    return joined.withColumn("action", action).drop("__n", "__h", "__t")


def html_index(pages: DataFrame, name: str, title: str) -> DataFrame:
    """(name, line): the lines of an index page, one for each page."""
    return pages.select(name, F.concat(F.lit('<li><a href="'), escape_html(F.col(name)), F.lit('.html">'), escape_html(F.col(title)), F.lit("</a></li>")).alias("line"))


def report_sections(title: Column, sections: dict[str, Column]) -> Column:
    """A Markdown report: a heading, and a section for each text; a missing text says so."""
    parts = [F.concat(F.lit(f"## {name}\n\n"), F.coalesce(escape_markdown(c.cast("string")), F.lit("not available"))) for name, c in sections.items()]
    return F.concat_ws("\n\n", F.concat(F.lit("# "), escape_markdown(title)), *parts)


def priority_class(label: Column) -> Column:
    """The style of a priority label."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in {"high": "priority-high", "medium": "priority-medium", "low": "priority-low"}.items() for x in kv)), F.lower(F.trim(label))), F.lit("priority-none"))
