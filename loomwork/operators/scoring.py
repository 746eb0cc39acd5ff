"""Weighted profiles: component scores, penalties, scenarios of perturbed weights."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import clip01, is_missing, lookup, round_exactly, safe_bool, safe_double

#: Components in the order in which they are summed.
COMPONENTS = ("baseline", "axis", "role", "modality", "confidence", "balance", "novelty")


@dataclass(frozen=True)
class Profile:
    """Weights of the components, lookup tables and penalties of one view of the entities."""

    name: str
    weights: Mapping[str, float]
    roles: Mapping[str, float] = field(default_factory=dict)
    confidences: Mapping[str, float] = field(default_factory=dict)
    modalities: Mapping[str, Mapping[str, float]] = field(default_factory=dict)  # column: level: score
    modality_weights: Mapping[str, float] = field(default_factory=dict)
    poor: float = 0.0
    contradiction: float = 0.0
    unmapped: float = 0.0
    mismatch: Mapping[str, float] = field(default_factory=dict)


def normalized(weights: Mapping[str, float]) -> dict[str, float]:
    if any(w < 0 for w in weights.values()) or not (total := sum(weights.values())):
        raise ValueError("weights must not be negative, nor all zero")
    return {k: w / total for k, w in weights.items()}


def perturbed(profile: Profile, weight: str, factor: float) -> Profile:
    return replace(profile, weights=normalized(dict(profile.weights) | {weight: profile.weights.get(weight, 0.0) * factor}))


def scenarios(profiles: list[Profile], factors: Mapping[str, float]) -> list[tuple[str, str, str, Profile]]:
    """(profile, weight, direction, perturbed profile), one weight at a time."""
    return [(p.name, w, d, perturbed(p, w, f)) for p, w, (d, f) in product(profiles, COMPONENTS, factors.items())]


def components(df: DataFrame, p: Profile) -> dict[str, Column]:
    have = set(df.columns)
    col = lambda name, default: safe_double(F.col(name), default) if name in have else F.lit(default)
    text = lambda name: F.col(name).cast("string") if name in have else F.lit(None).cast("string")
    parts = [(p.modality_weights.get(c, 1.0), lookup(text(c), levels, 0.0)) for c, levels in p.modalities.items() if c in have]
    total = sum(w for w, _ in parts)
    modality = reduce(lambda a, b: a + b, (F.lit(w) * s for w, s in parts)) / F.lit(total) if total else F.lit(0.0)
    novelty = col("novelty", 0.5) if "novelty" in have else F.lit(1.0) - col("crowding", 0.5) if "crowding" in have else F.lit(0.5)
    return {
        "baseline": clip01(col("baseline", 0.0)),
        "axis": clip01(col("axis_score", 0.0)),
        "role": clip01(lookup(text("role"), p.roles, 0.0)),
        "modality": clip01(modality),
        "confidence": clip01(lookup(text("confidence"), p.confidences, 0.0)),
        "balance": clip01(F.lit(1.0) - clip01(col("contradiction", 0.0))),
        "novelty": clip01(novelty),
    }


def penalty(df: DataFrame, p: Profile) -> Column:
    have = set(df.columns)
    poor = F.when(safe_bool(F.col("poor_target")), p.poor).otherwise(0.0) if "poor_target" in have else F.lit(0.0)
    against = F.when(safe_double(F.col("contradiction")) >= 0.6, p.contradiction).otherwise(0.0) if "contradiction" in have else F.lit(0.0)
    unmapped = F.when(is_missing(F.col("axis_ids")), p.unmapped).otherwise(0.0) if "axis_ids" in have else F.lit(0.0)
    role = lookup(F.col("role"), p.mismatch, 0.0) if "role" in have else F.lit(0.0)
    return poor + against + unmapped + role


#: Decimals of scores.
DIGITS = 4


def score(df: DataFrame, p: Profile, keep_parts: bool = True, digits: int = DIGITS) -> DataFrame:
    """``<name>_score``, and with ``keep_parts`` its components and penalty, each rounded; terms are added unrounded
    in a fixed order."""
    found = components(df, p)
    total = reduce(lambda a, b: a + b, (F.lit(float(p.weights.get(c, 0.0))) * found[c] for c in COMPONENTS))
    parts = {f"{p.name}_{c}": found[c] for c in COMPONENTS} | {f"{p.name}_penalty": penalty(df, p)}
    out = (parts if keep_parts else {}) | {f"{p.name}_score": clip01(total + penalty(df, p))}
    return df.withColumns({name: round_exactly(c, digits) for name, c in out.items()})


def score_long(df: DataFrame, cases: list[tuple[str, Profile]], key: str, digits: int = DIGITS) -> DataFrame:
    """(case, key, baseline, score) for many profiles at once: components once, weights as a small table.

    All profiles must share their lookup tables and penalties, as the scenarios of one profile do.
    """
    p = cases[0][1]
    parts = df.select(F.col(key), F.col("baseline").alias("__b"), F.array(*(components(df, p)[c] for c in COMPONENTS)).alias("__c"), penalty(df, p).alias("__p"))
    table = df.sparkSession.createDataFrame([(name, [float(q.weights.get(c, 0.0)) for c in COMPONENTS]) for name, q in cases], "case string, weights array<double>")
    total = reduce(lambda a, b: a + b, (F.col("weights")[k] * F.col("__c")[k] for k in range(len(COMPONENTS))))
    return parts.join(F.broadcast(table)).select("case", key, F.col("__b").alias("baseline"), round_exactly(clip01(total + F.col("__p")), digits).alias("score"))


def scenario_scores(df: DataFrame, profiles: list[Profile], factors: Mapping[str, float], key: str) -> DataFrame:
    """(profile, scenario, key, baseline, score) of every profile as it is (``none|base``) and with each weight perturbed."""
    out = None
    for p in profiles:
        cases = [("none|base", p), *((f"{w}|{d}", q) for _, w, d, q in scenarios([p], factors))]
        rows = score_long(df, cases, key).select(F.lit(p.name).alias("profile"), F.col("case").alias("scenario"), key, "baseline", "score")
        out = rows if out is None else out.unionByName(rows)
    return out


def profile_issues(config: Mapping[str, object], name: str | None = None) -> list[str]:
    """What is wrong with a profile as it was loaded: sections that are missing, weights that are none, an id that isn't its own."""
    need = ("name", "weights", "roles", "confidences", "modalities")
    issues = [f"missing: {n}" for n in need if n not in config]
    weights = config.get("weights") or {}
    issues += [f"unknown weight: {n}" for n in weights if n not in COMPONENTS] + [f"negative weight: {n}" for n, w in weights.items() if w < 0]
    if name is not None and config.get("name") != name:
        issues.append("name doesn't agree")
    return issues


def profile_of(config: Mapping[str, object], name: str | None = None) -> Profile:
    """A profile from a loaded configuration; raises with all that is wrong with it."""
    if issues := profile_issues(config, name):
        raise ValueError("; ".join(issues))
    return Profile(**config)
