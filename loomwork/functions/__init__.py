"""Column functions: coercion, missing values, lookups, text and identifiers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.functions import nested

#: What counts as uninformative, as a generic identifier, and as true.
UNINFORMATIVE = ("", "nan", "none", "null", "unclear", "unmapped", "not assessed")
GENERIC_IDS = ("", "unknown", "none", "null", "missing", "n/a", "na", "unspecified", "unavailable", "not_applicable", "not available")
TRUE_WORDS = ("true", "1", "yes", "y")
#: Least scores of the priority labels.
HIGH, MEDIUM, LOW = 0.70, 0.45, 0.10
_WHITE = r"^\s+|\s+$"


def strip(c: Column) -> Column:
    """All white space off both ends."""
    return F.regexp_replace(c, _WHITE, "")


def safe_str(c: Column) -> Column:
    text = strip(c.cast("string"))
    return F.coalesce(F.when(F.lower(text) == "nan", F.lit("")).otherwise(text), F.lit(""))


def safe_double(c: Column, default: float = 0.0) -> Column:
    """A finite or infinite number, or the default for null, NaN and what is no number."""
    value = c.try_cast("double")
    return F.coalesce(F.when(~F.isnan(value), value), F.lit(default))


def safe_bool(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c.cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def normalize_symbol(c: Column) -> Column:
    return F.upper(safe_str(c))


def is_missing(c: Column, words: Sequence[str] = UNINFORMATIVE) -> Column:
    return c.isNull() | F.lower(strip(c.cast("string"))).isin(*words)


def usable_id(c: Column) -> Column:
    """The stripped identifier, or null if it says nothing."""
    return F.when(~is_missing(c, GENERIC_IDS), strip(c.cast("string")))


def lookup(c: Column, table: Mapping[str, float], default: float) -> Column:
    """Exact match first, then regardless of case, else the default."""
    if not table:
        return F.lit(default)
    pairs = lambda m: F.create_map(*(F.lit(x) for kv in m.items() for x in kv))
    lower: dict[str, float] = {}
    for k, v in table.items():
        lower.setdefault(k.lower(), v)
    return F.coalesce(F.try_element_at(pairs(dict(table)), c), F.try_element_at(pairs(lower), F.lower(c)), F.lit(default))


def priority_label(score: Column) -> Column:
    known = ~F.isnan(score)
    return F.when(known & (score >= HIGH), "high").when(known & (score >= MEDIUM), "medium").when(known & (score > LOW), "low").otherwise("not prioritized")


def pipe_list(c: Column, separator: str = r"\|") -> Column:
    """Trimmed, non-blank parts."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), separator), strip), lambda x: x != "")


def collapse_spaces(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def phrase(c: Column) -> Column:
    """A quoted search phrase: white space collapsed, backslashes and quotes escaped."""
    text = collapse_spaces(c)
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def and_query(*columns: Column) -> Column:
    return F.concat_ws(" AND ", *(F.when(strip(c) != "", phrase(c)) for c in columns))


def matched_markers(c: Column, markers: Sequence[str]) -> Column:
    """Markers that the lower-cased text contains."""
    return F.filter(F.array(*map(F.lit, markers)), lambda m: F.contains(F.lower(c), m))


def clauses(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"[.!?;]+"), strip), lambda x: x != "")


def unnegated_markers(c: Column, markers: Sequence[str], negations: Sequence[str]) -> Column:
    """Markers in clauses that hold no negation."""
    plain = F.filter(clauses(F.lower(c)), lambda x: ~reduce(lambda a, b: a | b, (F.contains(x, F.lit(n)) for n in negations)))
    return F.array_distinct(F.flatten(F.transform(plain, lambda x: F.filter(F.array(*map(F.lit, markers)), lambda m: F.contains(x, m)))))


def quote_at(source: Column, start: Column, end: Column) -> Column:
    return F.substring(source, start + 1, end - start)


def content_id(prefix: str, json: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.sha2(json, 256))


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with sorted keys and explicit nulls."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def parse_label(c: Column) -> tuple[Column, Column, Column]:
    """(symbol, number, state) of labels such as ``ABC (12)``."""
    whole, alone = r"^([A-Za-z][A-Za-z0-9-]*) \(([1-9][0-9]*)\)$", r"^[A-Za-z][A-Za-z0-9-]*$"
    full, only = F.coalesce(c.rlike(whole), F.lit(False)), F.coalesce(c.rlike(alone), F.lit(False))
    symbol = F.when(full, F.regexp_extract(c, whole, 1)).when(only, c)
    number = F.when(full, F.regexp_extract(c, whole, 2))
    return symbol, number, F.when(full, "resolved").when(only, "unresolved_format").otherwise("malformed")


def identity(symbol: Column, number: Column) -> Column:
    return F.concat(F.lit("symbol:"), symbol, F.lit("|entrez:"), number)


def escape_html(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def escape_markdown(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\`*_{}\[\]()#+\-!|<>])", r"\\$1")


def redact_paths(c: Column, put: str = "[path]") -> Column:
    return F.regexp_replace(c, r"(?:/(?:home|root|tmp|Users|mnt)/[^\s\"']*)|(?:[A-Za-z]:\\[^\s\"']*)", put)


def safe_release_path(c: Column) -> Column:
    """Relative, without ``..`` and without a scheme."""
    return F.coalesce(c.rlike(r"^[^/\\:][^\\:]*$") & ~c.rlike(r"(^|/)\.\.(/|$)"), F.lit(False))


def criterion(observed: Column, op: Column, bound: Column) -> Column:
    met = F.when(op == ">=", observed >= bound).when(op == "<=", observed <= bound).when(op == "==", observed == bound)
    return F.when(observed.isNull(), "unavailable").when(met, "pass").otherwise("fail")


def word_count(c: Column) -> Column:
    text = strip(F.coalesce(c, F.lit("")))
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, r"\s+")))


def first_usable(*columns: Column) -> Column:
    return F.coalesce(*(usable_id(c) for c in columns))


def round_exactly(c: Column, digits: int) -> Column:
    """The nearest decimal of ``digits`` places, ties of the binary value to the even neighbour.

    Other roundings look at the shortest decimal form of a double, where more ties seem to be. Here the double
    is split into two halves of 26 bits, whose products with 2 * 10**digits are exact, so that the comparison
    with the middle of two neighbours is exact for magnitudes below 2**52 / 10**digits.
    """
    scale = float(10**digits)

    def nearest(x: Column) -> Column:
        big = x * F.lit(134217729.0)
        high = big - (big - x)
        base = F.floor(x * F.lit(scale)).cast("double")
        over = (high * F.lit(2 * scale) - (base * 2 + 1)) + (x - high) * F.lit(2 * scale)
        up = (over > 0) | ((over == 0) & (F.pmod(base, F.lit(2.0)) == 1))
        return F.when(~F.isnan(x), (base + F.when(up, 1.0).otherwise(0.0)) / F.lit(scale))

    # inside a function of one element, the argument is computed once and not written out for each of its uses
    return F.get(F.transform(F.array(c.cast("double")), nearest), F.lit(0))


def json_safe(c: Column) -> Column:
    """NaN and infinities, which JSON has no words for, as null."""
    return F.when(~(F.isnan(c) | F.abs(c).isin(float("inf"))), c)


def fixed(c: Column, digits: int) -> Column:
    """A number with that many decimals, as text."""
    return F.format_string(f"%.{digits}f", round_exactly(c, digits))


def utc_text(c: Column) -> Column:
    """An instant as ISO text with microseconds; the session's time zone is UTC."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def utc_instant(text: Column) -> Column:
    """The instant of an ISO text that names UTC; null for any other offset, or none."""
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,6})?(Z|\+00:00)$"), F.try_to_timestamp(text))


def canonical_unordered(c: Column) -> Column:
    """JSON of an array regardless of its order: members' JSON, sorted."""
    members = F.array_sort(F.transform(c, lambda x: F.regexp_replace(F.to_json(F.array(x), {"ignoreNullFields": "false"}), r"^\[|\]$", "")))
    return F.when(c.isNotNull(), F.concat(F.lit("["), F.concat_ws(",", members), F.lit("]")))


def allowed_entries(c: Column, keys: Sequence[str]) -> Column:
    """A map's entries of those keys."""
    return F.map_filter(c, lambda k, _: k.isin(*keys))


def json_type(text: Column) -> Column:
    """null, boolean, number, string, array or object: the type of a JSON value; null if the text isn't one, or is null."""
    return F.coalesce(nested.type_of(nested.parsed(text)), F.lit("null"))


def gene_id(c: Column) -> Column:
    """Whether an identifier is a fixed prefix and eleven digits."""
    return F.coalesce(c.rlike("^ENSG[0-9]{11}$"), F.lit(False))


def percent(c: Column) -> Column:
    """A share as a whole percentage from 0 to 100."""
    return F.floor(clip01(F.coalesce(c, F.lit(0.0))) * 100 + 0.5).cast("int")


def score_bar(c: Column, width: int = 10) -> Column:
    """A share as a bar of ``width`` places."""
    full = F.floor(clip01(F.coalesce(c, F.lit(0.0))) * width + 0.5).cast("int")
    return F.concat(F.repeat(F.lit("#"), full), F.repeat(F.lit("."), F.lit(width) - full))


def sanitized_error(c: Column, longest: int = 500) -> Column:
    """An error message on one line, without paths and secrets, cut to ``longest``."""
    hidden = F.regexp_replace(redact_paths(c), r"(?i)(api[_-]?key|token|secret|password|authorization)(\s*[=:]\s*)\S+", "$1$2[hidden]")
    return F.substring(collapse_spaces(hidden), 1, longest)


def names_inside(json: Column) -> Column:
    """The names of all fields of a JSON text, at any depth."""
    return F.array_distinct(F.regexp_extract_all(json, F.lit(r'"((?:[^"\\]|\\.)*)"\s*:'), F.lit(1)))


def forbidden_names(json: Column, parts: Sequence[str]) -> Column:
    """Field names, at any depth, that contain one of the parts."""
    return F.filter(names_inside(json), lambda n: reduce(lambda a, b: a | b, (F.contains(F.lower(n), F.lit(p)) for p in parts)))
