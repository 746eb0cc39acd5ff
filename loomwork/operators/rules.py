"""Ordered rule ladders: the first rule that holds decides."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[Column, Mapping[str, object]]


def apply_ladder(df: DataFrame, rules: Sequence[Rule], default: Mapping[str, object]) -> DataFrame:
    """A column for each output of ``default``; a null condition doesn't hold."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)

    def column(name: str) -> Column:
        chain = None
        for condition, values in rules:
            value = as_column(values[name])
            chain = F.when(condition, value) if chain is None else chain.when(condition, value)
        return as_column(default[name]) if chain is None else chain.otherwise(as_column(default[name]))

    return df.withColumns({name: column(name) for name in default})


def rule_table(df: DataFrame, table: DataFrame, key: str, outputs: Sequence[str], default: Mapping[str, object]) -> DataFrame:
    """Rules as rows (``key``, priority, outputs): the least priority that matches, for rule sets too large for CASE."""
    best = table.groupBy(key).agg(F.min_by(F.struct(*outputs), F.struct("priority", *outputs)).alias("__rule"))
    joined = df.join(best, key, "left")
    return joined.withColumns({o: F.coalesce(F.col("__rule")[o], F.lit(default[o])) for o in outputs}).drop("__rule")


def any_contains(c: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(F.lower(c), F.lit(w)) for w in words))


def collect_reasons(*reasons: tuple[Column, str | Column]) -> Column:
    """Texts of the conditions that hold, in order, repeats included."""
    return F.array_compact(F.array(*(F.when(c, t if isinstance(t, Column) else F.lit(t)) for c, t in reasons)))


def join_unique(parts: Column, separator: str = " | ") -> Column:
    return F.concat_ws(separator, F.array_distinct(parts))


def issues(df: DataFrame, rules: Mapping[str, Column], *keys: str) -> DataFrame:
    """One row per key and rule broken; ``rules`` maps a code to the condition of breaking it."""
    found = F.array_compact(F.array(*(F.when(c, F.lit(code)) for code, c in rules.items())))
    return df.select(*keys, F.explode(found).alias("issue"))


def worst(decisions: Column, order: Sequence[tuple[str, str]], otherwise: str) -> Column:
    """The decision of the first severity that the array holds."""
    chain = None
    for severity, decision in order:
        held = F.array_contains(decisions, severity)
        chain = F.when(held, decision) if chain is None else chain.when(held, decision)
    return chain.otherwise(otherwise)
