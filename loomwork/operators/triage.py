"""From rule sets to a feature table: classes, fits, evidence, confidence, limits and notes.

Rule sets belong to the user. A set rule names its members; a condition is a column; the first rule that holds
decides, so the order of the rules settles members of several sets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import fixed, is_missing, normalize_symbol, pipe_list, round_exactly, safe_bool, safe_double, safe_str
from loomwork.operators.rules import apply_ladder, collect_reasons, join_unique

#: Levels that count as strong, and as weak.
STRONG, WEAK = ("high", "medium-high"), ("low", "unclear")


@dataclass(frozen=True)
class SetRule:
    """Outputs of the members of a set; ``nested`` replaces some of them for members that are in another set too."""

    members: Sequence[str]
    values: Mapping[str, str]
    nested: tuple[Sequence[str], Mapping[str, str]] | None = None


@dataclass(frozen=True)
class RuleSet:
    """Set rules first, then conditions on columns, then defaults."""

    sets: Sequence[SetRule]
    default: Mapping[str, object]
    conditions: Sequence[tuple[Column, Mapping[str, object]]] = field(default_factory=tuple)


def classify(df: DataFrame, rules: RuleSet, key: str) -> DataFrame:
    """A column for each output of the first rule that holds.

    Members of the sets become a table (symbol, outputs), in which a symbol of several sets has the row of the first;
    it is as small as the rule sets, and broadcast.
    """
    outputs = list(rules.default)
    first: dict[str, tuple] = {}
    for rule in rules.sets:
        inner = {m.upper() for m in rule.nested[0]} if rule.nested else set()
        for member in rule.members:
            values = dict(rule.values) | (dict(rule.nested[1]) if member.upper() in inner else {})
            first.setdefault(member.upper(), (member.upper(), *(values[o] for o in outputs)))
    schema = "__symbol string, " + ", ".join(f"`__set_{o}` string" for o in outputs)
    table = df.sparkSession.createDataFrame(list(first.values()), schema)
    joined = df.join(F.broadcast(table), normalize_symbol(F.col(key)) == F.col("__symbol"), "left")
    known = F.col("__symbol").isNotNull()
    steps = [(known, {o: F.col(f"__set_{o}") for o in outputs}), *rules.conditions]
    return apply_ladder(joined, steps, rules.default).drop("__symbol", *(f"__set_{o}" for o in outputs))


def contains_any(c: Column, *parts: str) -> Column:
    """Whether the lower-cased text contains one of the parts."""
    lower, out = F.lower(safe_str(c)), F.lit(False)
    for p in parts:
        out = out | F.contains(lower, F.lit(p))
    return out


def level(c: Column, among: Sequence[str]) -> Column:
    return safe_str(c).isin(*among)


def score_reasons(score: Column, high: float = 0.7, moderate: float = 0.4, what: str = "association score") -> tuple[list, list]:
    """(for, against): what a score says for or against an entity; a score that is missing or no number speaks against it."""
    number = safe_double(score, float("nan"))
    text = lambda word: F.concat(F.lit(f"{word} {what} ("), fixed(number, 3), F.lit(")"))
    there = ~F.isnan(number)
    for_it = [(there & (number >= high), text("High")), (there & (number >= moderate) & (number < high), text("Moderate"))]
    against = [(there & (number < moderate), text("Low")), (~there & safe_str(score).isin(""), F.lit(f"Missing {what}")), (~there & ~safe_str(score).isin(""), F.lit(f"{what} could not be read"))]
    return for_it, against


def audit(df: DataFrame, reasons_for: Sequence, reasons_against: Sequence, own_for: str | None = None, own_against: str | None = None) -> DataFrame:
    """``evidence_for`` and ``evidence_against``, joined without repeats, and ``n_against`` with repeats.

    ``own_for`` and ``own_against`` are columns of pipe-separated statements that come first.
    """
    listed = lambda own, reasons: F.concat(pipe_list(F.col(own)), collect_reasons(*reasons)) if own else collect_reasons(*reasons)
    with_lists = df.withColumns({"__for": listed(own_for, reasons_for), "__against": listed(own_against, reasons_against)})
    return with_lists.withColumns({"evidence_for": join_unique(F.col("__for")), "evidence_against": join_unique(F.col("__against")), "n_against": F.size("__against")}).drop("__for", "__against")


def contradiction(n_against: Column, poor: Column, role: Column, fits: Mapping[str, Column], each: float = 0.08, most: float = 0.4) -> Column:
    """A sum of penalties: reasons against, the poor flag, marker roles with a combination fit, driver roles with an
    antibody fit, a combination without an antibody, and no fit at all; at most 1, to 3 places."""
    antibody, combination = fits["antibody"], fits["combination"]
    nothing = F.lit(True)
    for fit in fits.values():
        nothing = nothing & level(fit, WEAK)
    add = lambda condition, value: F.when(F.coalesce(condition, F.lit(False)), value).otherwise(0.0)
    total = (
        F.least(F.lit(most), F.lit(each) * n_against) + add(safe_bool(poor), 0.25) + add(contains_any(role, "biomarker") & level(combination, STRONG), 0.10)
        + add(contains_any(role, "tumor-intrinsic driver") & level(antibody, ["high"]), 0.15) + add(level(antibody, ["low"]) & level(combination, ["high"]), 0.15) + add(nothing, 0.20)
    )
    return round_exactly(F.least(F.lit(1.0), total), 3)


def first_text(ladder: Sequence[tuple[Column, str | Column]], otherwise: str | Column) -> Column:
    """The text of the first condition that holds: limits, reasons to deprioritise, notes."""
    as_column = lambda t: t if isinstance(t, Column) else F.lit(t)
    chain = None
    for condition, text in ladder:
        chain = F.when(condition, as_column(text)) if chain is None else chain.when(condition, as_column(text))
    return chain.otherwise(as_column(otherwise))


def template(text: str, **values: Column) -> Column:
    """A text with ``{name}`` replaced by columns; nulls are blank."""
    parts, rest = [], text
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), safe_str(values[name])]
    return F.concat(*parts, F.lit(rest))


def completeness(df: DataFrame, fields: Sequence[str], score: str = "completeness", missing: str = "missing_fields") -> DataFrame:
    """The share of the fields that say something, to 3 places, and an array of the others."""
    gone = [is_missing(F.col(f)) if f in df.columns else F.lit(True) for f in fields]
    present = sum((F.when(m, 0).otherwise(1) for m in gone), F.lit(0))
    return df.withColumns({score: round_exactly(present / F.lit(float(len(fields))), 3), missing: collect_reasons(*zip(gone, fields, strict=True))})


def confidence(score: Column, role_confidence: Column, mapped: Column, has_for: Column, has_against: Column, has_modality: Column, contradiction_score: Column) -> Column:
    """insufficient below 0.45; high, medium or low by how complete, consistent and specific the evidence is."""
    role = F.lower(safe_str(role_confidence))
    high = (score >= 0.85) & role.isin(*STRONG) & mapped & has_for & has_against & has_modality & (safe_double(contradiction_score) <= 0.45)
    medium = (score >= 0.65) & role.isin(*STRONG, "medium") & has_for & has_modality
    return F.when(score < 0.45, "insufficient").when(high, "high").when(medium, "medium").otherwise("low")


def uncertainty(missing: Column, reasons: Sequence[tuple[Column, str | Column]], level_name: Column) -> Column:
    """What makes a call uncertain, joined; one of two sentences if nothing does."""
    listed = collect_reasons((F.size(missing) > 0, F.concat(F.lit("Missing fields: "), F.concat_ws(", ", missing))), *reasons)
    none = F.when(level_name == "high", "Evidence is fairly complete").otherwise("No particular reason")
    return F.when(F.size(listed) > 0, F.concat_ws(" | ", listed)).otherwise(none)


def reorder(df: DataFrame, first: Sequence[str]) -> DataFrame:
    """The named columns that are there, then the others as they were."""
    return df.select(*(c for c in first if c in df.columns), *(c for c in df.columns if c not in set(first)))


def without_generated(df: DataFrame, prefixes: Sequence[str], suffixes: Sequence[str], also: Sequence[str] = ()) -> DataFrame:
    """The table without the columns that an earlier scoring added: prefix_suffix for all pairs, and ``also``."""
    gone = {f"{p}_{s}" for p in prefixes for s in suffixes} | set(also)
    return df.drop(*(c for c in df.columns if c in gone))


def key_issues(df: DataFrame, key: str) -> DataFrame:
    """(symbol, issue): blank keys and keys that occur more than once, after normalisation."""
    symbols = df.groupBy(normalize_symbol(F.col(key)).alias("symbol")).agg(F.count(F.lit(1)).alias("n"))
    return symbols.where("symbol = '' or n > 1").select("symbol", F.when(F.col("symbol") == "", "blank").otherwise("duplicate").alias("issue"), "n")
