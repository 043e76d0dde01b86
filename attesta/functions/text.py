"""Scalar text functions as native Column expressions (no Python code runs per row)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Strings that count as "no value" in completeness checks.
EMPTY_MARKERS = ["", "NA", "N/A", "nan", "None"]


def as_col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it any number of times in `body`.

    Inside array functions an expression is evaluated again for every element it is used for; a bound
    value is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def distinct_by(items: Column, key: Callable[[Column], Column]) -> Column:
    """First item per key, in order of occurrence; sorts instead of comparing all pairs."""
    tagged = F.transform(items, lambda t, i: F.struct(key(t).alias("k"), i.alias("i"), t.alias("t")))
    firsts = let(
        F.array_sort(tagged), lambda a: F.filter(a, lambda s, n: (n == 0) | (F.get(a, n - 1)["k"] != s["k"]))
    )
    ordered = F.array_sort(F.transform(firsts, lambda s: F.struct(s["i"].alias("i"), s["t"].alias("t"))))
    return F.transform(ordered, lambda s: s["t"])


def text_or_empty(c: ColumnOrName) -> Column:
    """NULL and '' mean the same everywhere in the data model."""
    return F.coalesce(as_col(c).cast("string"), F.lit(""))


def null_if_blank(c: ColumnOrName) -> Column:
    return F.nullif(as_col(c).cast("string"), F.lit(""))


def has_text(c: ColumnOrName) -> Column:
    return text_or_empty(c) != ""


def first_text(*cols: ColumnOrName, default: str | None = None) -> Column:
    """First value that is neither NULL nor ''."""
    parts = [null_if_blank(c) for c in cols]
    if default is not None:
        parts.append(F.lit(default))
    return F.coalesce(*parts)


def strip(c: ColumnOrName) -> Column:
    return F.regexp_replace(as_col(c), r"^\s+|\s+$", "")


def compact_text(c: ColumnOrName) -> Column:
    """Collapse every whitespace run to one blank and trim."""
    return F.trim(F.regexp_replace(text_or_empty(c), r"\s+", " "))


def nonblank(c: ColumnOrName, markers: list[str] | None = None) -> Column:
    """True when the trimmed value is not one of the "no value" markers."""
    return ~strip(text_or_empty(c)).isin(EMPTY_MARKERS if markers is None else markers)


def any_nonblank(cols: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [nonblank(c) for c in cols])


def any_has_text(cols: list[str]) -> Column:
    return F.coalesce(*[null_if_blank(c) for c in cols]).isNotNull()


def contains_ci(c: ColumnOrName, needle: str | Column) -> Column:
    """Case-insensitive substring test; % and _ in the needle are ordinary characters."""
    wanted = F.lit(needle.lower()) if isinstance(needle, str) else F.lower(needle)
    return F.contains(F.lower(text_or_empty(c)), wanted)


def contains_any(c: ColumnOrName, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [contains_ci(c, n) for n in needles], F.lit(False))


def joined_lower(cols: list[str], sep: str = " ") -> Column:
    """Lower-cased row text: the fields joined by `sep`, NULL as ''."""
    return F.lower(F.concat_ws(sep, *[text_or_empty(c) for c in cols]))


def normalize_pmcid(c: ColumnOrName) -> Column:
    return F.upper(F.regexp_extract(text_or_empty(c), r"(?i)^\s*(PMC\d+)", 1))


# The internal marker removed from names, and the status wording used in publications.
INTERNAL_NAME_SUFFIX = r"(?i)\s*\(v1 extraction artefact, pending source re-verification\)\s*$"
STATUS_WORDING = {
    "needs_curator_sequence_curation": "sequence_not_available",
    "needs_curator_modification_curation": "modification_not_available",
    "candidate_needs_curator_review": "curation_lead",
}


def strip_name_suffix(c: ColumnOrName, pattern: str = INTERNAL_NAME_SUFFIX) -> Column:
    return strip(F.regexp_replace(as_col(c), pattern, ""))


def map_status(c: ColumnOrName, wording: dict[str, str] | None = None) -> Column:
    out = as_col(c)
    for old, new in (wording or STATUS_WORDING).items():
        out = F.when(as_col(c) == old, F.lit(new)).otherwise(out)
    return out


def year_from_pubdate(c: ColumnOrName, mode: str = "digits") -> Column:
    """First 4-digit token of a publication date; `mode` says how tokens are cut.

    'digits' cuts at every non-digit, 'blanks' only at blanks (so '2019-05' has no year).
    """
    text = text_or_empty(c)
    if mode == "digits":
        token = F.regexp_extract(text, r"(?:^|\D)(\d{4})(?:\D|$)", 1)
    else:
        token = F.regexp_extract(text, r"(?:^|\s)(\d{4})(?:\s|$)", 1)
    return F.nullif(token, F.lit("")).try_cast("int")


def split_terms(*cols: ColumnOrName) -> Column:
    """User terms: cut at , ; / |, trimmed, two characters or more, case-insensitive first-seen distinct."""
    pieces = F.split(F.concat_ws(",", *[text_or_empty(c) for c in cols]), r"[,;/|]+")
    cleaned = F.filter(F.transform(pieces, lambda t: strip(t)), lambda t: F.length(t) >= 2)
    return distinct_by(cleaned, F.lower)


def node_id(prefix: str, c: ColumnOrName) -> Column:
    """Graph identifier `prefix:value` with a safe alphabet and at most 80 value characters."""
    raw = F.regexp_replace(first_text(c, default="unknown"), r"[^a-zA-Z0-9_-]+", "_")
    cut = F.substring(F.regexp_replace(raw, r"^_+|_+$", ""), 1, 80)
    return F.concat(F.lit(f"{prefix}:"), first_text(cut, default="unknown"))


def anchor_hash(c: ColumnOrName) -> Column:
    return F.substring(F.sha2(as_col(c), 256), 1, 16)


def report_id(*cols: ColumnOrName) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[text_or_empty(c) for c in cols]), 256), 1, 16)


def hash_bucket(c: ColumnOrName, buckets: int = 100) -> Column:
    """Stable bucket from the first 32 bits of sha256."""
    return F.conv(F.substring(F.sha2(as_col(c), 256), 1, 8), 16, 10).cast("bigint") % F.lit(buckets)


def title_score(c: ColumnOrName, weights: dict[str, int]) -> Column:
    """Sum of the weights of the keywords contained in the text."""
    low = F.lower(text_or_empty(c))
    return reduce(
        lambda a, b: a + b,
        [F.when(F.contains(low, F.lit(k)), F.lit(w)).otherwise(F.lit(0)) for k, w in weights.items()],
        F.lit(0),
    )


def percent(n: ColumnOrName, d: ColumnOrName) -> Column:
    """100 * n / max(d, 1), unrounded."""
    return as_col(n).cast("double") / F.greatest(as_col(d).cast("double"), F.lit(1.0)) * F.lit(100.0)


def rank_of(c: ColumnOrName, ranks: dict[str, int], otherwise: int) -> Column:
    """Position of a label in a fixed ranking, for ORDER BY."""
    out = F.lit(otherwise)
    for label, rank in ranks.items():
        out = F.when(as_col(c) == label, F.lit(rank)).otherwise(out)
    return out


# The orders used in listings.
PRIORITY_RANK = {"high": 0, "medium": 1}
CONFIDENCE_RANK = {"high_candidate": 0, "medium_candidate": 1}
GRADE_RANK = {"A": 3, "B": 2, "C": 1}
