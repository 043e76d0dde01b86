"""Search text to term groups, as Column expressions over a table of queries and for one query string."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions.text import ColumnOrName, as_col, distinct_by, let, text_or_empty
from attesta.lexicons import SEARCH_STOPWORDS, SEARCH_SYNONYMS

TOKEN = r"[a-z0-9']+"  # fixed value: what a search token is
GROUP_TYPE = "array<array<string>>"


def joined_offtarget(c: ColumnOrName) -> Column:
    """Lower case with both spellings of off-target written as one word."""
    return F.regexp_replace(F.lower(text_or_empty(c)), "off[ -]target", "offtarget")


def _synonym_map(synonyms: dict[str, list[str]]) -> Column:
    if not synonyms:
        return F.create_map().cast("map<string,array<string>>")
    pairs = [x for k, v in synonyms.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))]
    return F.create_map(*pairs)


def _string_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def query_terms(
    c: ColumnOrName,
    synonyms: dict[str, list[str]] = SEARCH_SYNONYMS,
    stopwords: list[str] = SEARCH_STOPWORDS,
    maximum: int = 8,
) -> Column:
    """Term groups of a query column: an array of synonym lists, first-seen distinct, at most `maximum`."""
    stop, lookup = _string_array(stopwords), _synonym_map(synonyms)
    tokens = F.filter(
        F.regexp_extract_all(joined_offtarget(c), F.lit(TOKEN), F.lit(0)),
        lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t),
    )
    groups = F.transform(F.array_distinct(tokens), lambda t: F.coalesce(lookup[t], F.array(t)))
    return F.slice(distinct_by(groups, lambda g: F.array_join(F.array_sort(g), "|")), 1, maximum)


def parse_terms(
    text: str,
    synonyms: dict[str, list[str]] = SEARCH_SYNONYMS,
    stopwords: list[str] = SEARCH_STOPWORDS,
    maximum: int = 8,
) -> list[list[str]]:
    """Term groups of one query string, on the driver, for building a filter expression."""
    words = re.findall(TOKEN, re.sub("off[ -]target", "offtarget", text.lower()))
    groups: dict[frozenset[str], list[str]] = {}
    for word in words:
        if len(word) >= 2 and word not in stopwords:
            spellings = synonyms.get(word, [word])
            groups.setdefault(frozenset(spellings), spellings)
    return list(groups.values())[:maximum]


def search_condition(
    fields: list[str],
    text: str,
    synonyms: dict[str, list[str]] = SEARCH_SYNONYMS,
    stopwords: list[str] = SEARCH_STOPWORDS,
) -> Column:
    """AND over term groups of OR over fields and spellings; the raw text when no group survives."""
    groups = parse_terms(text, synonyms, stopwords) or [[text]]

    def matches(blob: Column) -> Column:
        def any_spelling(group: list[str]) -> Column:
            return reduce(lambda a, b: a | b, [F.contains(blob, F.lit(s.lower())) for s in group])

        return reduce(lambda a, b: a & b, [any_spelling(g) for g in groups])

    return let(field_blob(fields), matches)


# A character no search term can hold: fields joined by it are searched as separate fields.
FIELD_BREAK = "\u0001"


def field_blob(fields: list[str]) -> Column:
    return F.lower(F.concat_ws(FIELD_BREAK, *[text_or_empty(f) for f in fields]))


def field_values(fields: list[str]) -> list[Column]:
    return [F.lower(text_or_empty(f)) for f in fields]


def any_field_contains(fields: list[str], needle: str) -> Column:
    return F.contains(field_blob(fields), F.lit(needle.lower()))


def lower_groups(groups: Column) -> Column:
    return F.transform(groups, lambda g: F.transform(g, lambda s: F.lower(s)))


def groups_or_raw(c: ColumnOrName, groups: Column) -> Column:
    """Groups of a query, or the raw query as the only group."""
    return F.when(F.size(groups) == 0, F.array(F.array(F.lower(text_or_empty(as_col(c)))))).otherwise(lower_groups(groups))
