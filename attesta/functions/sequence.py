"""Nucleotide sequence features as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions.text import ColumnOrName, let, text_or_empty


def canonical_sequence(c: ColumnOrName) -> Column:
    """Upper case, U read as T, only A C G T N kept."""
    return F.regexp_replace(F.translate(F.upper(text_or_empty(c)), "U", "T"), "[^ACGTN]", "")


def sequence_from_helm(c: ColumnOrName) -> Column:
    """Bases written as (A) (C) (G) (T) (U) in a HELM string, in order."""
    return F.array_join(F.regexp_extract_all(F.upper(text_or_empty(c)), F.lit(r"\(([ACGTU])\)"), F.lit(1)), "")


def kmer_windows(seq: ColumnOrName, k: int = 7, maximum: int = 12) -> Column:
    """Distinct k-mers in first-seen order, at most `maximum`; empty when the sequence is shorter than k."""
    s = text_or_empty(seq)

    def grams(t: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(t) - (k - 1), F.lit(1)))
        return F.array_distinct(F.transform(starts, lambda i: F.substr(t, i, F.lit(k))))

    # The head of the sequence nearly always holds enough distinct windows; only repeats need all of it.
    head = let(F.substring(s, 1, 40 * maximum), grams)
    full = F.when(F.size(head) >= maximum, head).otherwise(let(s, grams))
    return F.when(F.length(s) >= k, F.slice(full, 1, maximum)).otherwise(F.array().cast("array<string>"))


def seed_2_8(seq: ColumnOrName) -> Column:
    s = text_or_empty(seq)
    return F.when(F.length(s) >= 8, F.substring(s, 2, 7)).otherwise(F.lit(""))


def invalid_characters(raw: ColumnOrName) -> Column:
    """Distinct characters outside A C G T U N and blanks, in first-seen order."""
    left = F.regexp_replace(F.upper(text_or_empty(raw)), r"[ACGTUN\s]+", "")
    return F.array_distinct(F.regexp_extract_all(left, F.lit("(?s)."), F.lit(0)))


def has_ambiguous(seq: ColumnOrName) -> Column:
    return F.contains(text_or_empty(seq), F.lit("N"))
