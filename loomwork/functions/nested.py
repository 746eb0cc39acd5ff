"""Nested JSON as VARIANT values: strict parsing, canonical text, types, walks by path, deny-lists, list fields.

Objects are kept with sorted keys (in UTF-16 order), whatever order the text has; an object that names a key twice,
trailing text and NaN aren't JSON. Numbers are printed in plain form, without trailing zeros after the point.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.session import cut_lineage

#: Levels that are taken from a text anew, without writing; texts that nest no deeper are folded within their row.
ROW_LEVELS = 8


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parsed(json: Column) -> Column:
    """The text as a VARIANT; null if it isn't one JSON value."""
    values = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), json, F.lit("]"))), "$", "array<variant>")
    return once(values, lambda v: F.when(F.size(v) == 1, F.get(v, F.lit(0))))


def canonical(json: Column) -> Column:
    """Compact text with sorted keys at every depth; null if it isn't JSON."""
    return F.to_json(parsed(json))


def _kind_type(kind: Column) -> Column:
    return (
        F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").when(kind.isNotNull(), "number")
    )


def type_of(value: Column) -> Column:
    """null, boolean, number, string, array or object: the type of a VARIANT."""
    return once(F.schema_of_variant(value), _kind_type)


def is_whole(value: Column) -> Column:
    """Whether a VARIANT is an integer written without a point."""
    return F.coalesce(F.schema_of_variant(value).rlike(r"^(BIGINT|DECIMAL\((19|[23][0-9]),0\))$"), F.lit(False))


def member(value: Column, name: str) -> Column:
    """A field of an object, as a VARIANT; null if there is none."""
    return F.try_variant_get(value, "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']", "variant")


def text_of(value: Column) -> Column:
    """A string's text; null for any other type."""
    return once(value, lambda v: F.when(type_of(v) == "string", F.try_variant_get(v, "$", "string")))


def names_of(value: Column) -> Column:
    """The names of an object's fields; null for any other type."""
    return F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))


def items_of(value: Column) -> Column:
    """An array's members as VARIANTs; null for any other type."""
    return F.try_variant_get(value, "$", "array<variant>")


def list_field(value: Column, name: str, page: str = "rows") -> tuple[Column, Column]:
    """(state, members) of a list field: ``items`` for an array, or an object whose ``page`` is one; ``missing`` if the field
    isn't there or null; ``bad_shape`` for anything else."""
    found = member(value, name)
    kind, inner = type_of(found), member(found, page)
    members = F.when(kind == "array", items_of(found)).when(kind == "object", items_of(inner))
    state = F.when(kind.isNull() | (kind == "null"), "missing").when(members.isNotNull(), "items").otherwise("bad_shape")
    return state, members


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)


def _present(value: Column) -> Column:
    """A row if the value isn't null; unlike in a filter, it is computed once."""
    return F.explode(F.array_compact(F.array(value)))


def _step(name: Column) -> Column:
    """What a field's name adds to a path."""
    return F.concat(F.lit("."), F.when(name.rlike("^[A-Za-z0-9_]+$"), name).otherwise(quoted(name)))


def walk_levels(df: DataFrame, keys: Sequence[str], json: str) -> list[DataFrame]:
    """The nodes of each depth: keys, ``path``, ``parent``, ``name``, ``type`` and the VARIANT ``node``.

    A level is a plan over the level before; each ``ROW_LEVELS``-th is written, so that any depth takes as many rounds and no
    plan opens more levels than that. Texts that aren't JSON have no nodes.
    """
    tvf, none = df.sparkSession.tvf, F.lit(None).cast("string")
    level = df.select(*keys, F.lit("$").alias("path"), none.alias("parent"), none.alias("name"), _present(parsed(F.col(json))).alias("node"))
    levels = []
    while not level.select("node").isEmpty():
        levels.append(level.withColumn("__kind", F.schema_of_variant("node")).select(*keys, "path", "parent", "name", _kind_type(F.col("__kind")).alias("type"), "node"))
        each = level.select(*keys, F.col("path").alias("parent"), "node").lateralJoin(tvf.variant_explode(F.col("node").outer()))  # scalars give no rows
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(_step(F.col("key")))
        level = each.select(*keys, F.concat("parent", step).alias("path"), "parent", F.col("key").alias("name"), F.col("value").alias("node"))
        if len(levels) % ROW_LEVELS == 0:
            level = cut_lineage(level)
    return levels


def nesting(json: Column) -> Column:
    """How deep the brackets of a text nest, those in strings apart; exact for JSON."""
    plain = F.replace(F.replace(json, F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit(""))
    brackets = F.regexp_replace(F.regexp_replace(plain, '"[^"]*"', ""), r"[^\[\]{}]", "")
    at = lambda x, c: x["at"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("most"))
    return F.aggregate(F.split(brackets, ""), start, lambda x, c: F.struct(at(x, c).alias("at"), F.greatest(x["most"], at(x, c)).alias("most")), lambda x: x["most"])


def walk(df: DataFrame, keys: Sequence[str], json: str) -> DataFrame:
    """Every node of every JSON text: keys, ``path``, ``depth``, ``name``, ``type`` and ``value`` (strings as they are, other
    scalars as JSON, containers null)."""
    out = None
    for depth, level in enumerate(walk_levels(df, keys, json)):
        value = F.when(F.col("type") == "string", F.try_variant_get("node", "$", "string")).when(~F.col("type").isin("object", "array"), F.to_json("node"))
        part = level.select(*keys, "path", F.lit(depth).alias("depth"), "name", "type", value.alias("value"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return df.select(*keys).limit(0).select(*keys, *(F.lit(None).cast(t).alias(n) for n, t in (("path", "string"), ("depth", "int"), ("name", "string"), ("type", "string"), ("value", "string"))))
    return out


def _folded(value: Column, levels: int) -> Column:
    """The canonical text of a VARIANT that nests no deeper than ``levels``, with sorted lists."""
    if levels == 0:
        return F.to_json(value)

    def text(v: Column, fields: Column) -> Column:
        named = F.transform(F.map_entries(fields), lambda x: F.struct(x["key"].alias("name"), F.concat(quoted(x["key"]), F.lit(":")).alias("head"), x["value"].alias("node")))
        items = F.transform(items_of(v), lambda x: F.struct(F.lit("").alias("name"), F.lit("").alias("head"), x.alias("node")))
        joined = lambda members: F.array_join(F.transform(F.sort_array(F.transform(members, lambda m: F.struct(m["name"].alias("name"), F.concat(m["head"], _folded(m["node"], levels - 1)).alias("text")))), lambda m: m["text"]), ",")
        ends = lambda a, b: F.when(fields.isNotNull(), a).otherwise(b)
        return once(F.coalesce(named, items), lambda members: F.when(members.isNull(), F.to_json(v)).otherwise(F.concat(ends("{", "["), joined(members), ends("}", "]"))))

    return once(value, lambda v: once(F.try_variant_get(v, "$", "map<string,variant>"), lambda fields: text(v, fields)))


def canonical_unordered(df: DataFrame, keys: Sequence[str], json: str, name: str = "canonical") -> DataFrame:
    """keys and the canonical text with the members of arrays sorted, at every depth: equal for any order of rows in a list.

    Texts that nest deeper than ``ROW_LEVELS`` are folded from the deepest level upwards; a group is a container's members. ``keys`` must
    tell these records apart.
    """
    depth, levels = nesting(F.col(json)), len(walk_levels(df, [], json)) - 1
    near, deep = (df, df.limit(0)) if levels <= ROW_LEVELS else (df.where(depth <= ROW_LEVELS), df.where(depth > ROW_LEVELS))
    out = near.select(*keys, _present(_folded(parsed(F.col(json)), max(0, min(levels, ROW_LEVELS)))).alias(name))
    below = None
    for level in reversed(walk_levels(deep, keys, json) if levels > ROW_LEVELS else ()):
        text = F.when(~F.col("type").isin("object", "array"), F.to_json("node"))
        rows = level.select(*keys, "path", "parent", "name", "type", text.alias("text"))
        if below is not None:
            inner = below.groupBy(*keys, F.col("parent").alias("path")).agg(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("name"), F.lit("")).alias("name"), "text"))).alias("members"))
            rows = rows.join(inner, [*keys, "path"], "left")
        else:
            rows = rows.withColumn("members", F.lit(None).cast("array<struct<name:string,text:string>>"))
        members = F.coalesce("members", F.array())
        whole = F.when(F.col("type") == "object", F.concat(F.lit("{"), F.array_join(F.transform(members, lambda x: F.concat(quoted(x["name"]), F.lit(":"), x["text"])), ","), F.lit("}")))
        whole = whole.when(F.col("type") == "array", F.concat(F.lit("["), F.array_join(F.transform(members, lambda x: x["text"]), ","), F.lit("]"))).otherwise(F.col("text"))
        below = cut_lineage(rows.select(*keys, "parent", "name", whole.alias("text")))
    return out if below is None else out.unionByName(below.select(*keys, F.col("text").alias(name)))


def forbidden(df: DataFrame, keys: Sequence[str], json: str, names: Sequence[str] = (), values: Sequence[str] = ()) -> DataFrame:
    """(keys, path, kind): fields whose lower-cased name holds one of ``names``, and strings whose lower-cased text holds one of ``values``."""
    holds = lambda c, parts: F.coalesce(F.lower(c).rlike("|".join(map(re.escape, parts))), F.lit(False)) if parts else F.lit(False)
    nodes = walk(df, keys, json)
    by_name = holds(F.col("name"), names)
    by_value = (F.col("type") == "string") & holds(F.col("value"), values)
    kinds = F.array_compact(F.array(F.when(by_name, "name"), F.when(by_value, "value")))
    return nodes.select(*keys, "path", F.explode(kinds).alias("kind"))
