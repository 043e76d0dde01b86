"""Patterns rewritten for search: found in the same texts, with less work for each letter of a text.

Lists of terms share their beginnings, and a letter that no match begins with is passed by at once.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from re import _constants as op
from re import _parser as parser

# The signs that a case-insensitive search takes for i, s or k.
SIGNS = {"\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k"}


def _tree(terms: Sequence[tuple[str, ...]]) -> str:
    """Pattern of the same terms, each given by its signs, that tests a beginning shared by several only once."""
    heads: dict[str, list[tuple[str, ...]]] = {}
    for t in terms:
        if t:
            heads.setdefault(t[0], []).append(t[1:])
    arms = [head + _tree(rest) for head, rest in sorted(heads.items())]
    if not arms or (len(arms) == 1 and () not in terms):
        return "".join(arms)
    return f"(?:{'|'.join(arms)}){'?' if () in terms else ''}"


_SIGN = r"(?:[A-Za-z0-9 &<>,'/-]|\\[^A-Za-z0-9])"
_LIST = re.compile(rf"\((?:\?:)?((?:{_SIGN}\??)+(?:\|(?:{_SIGN}\??)+)+)\)")


def _listed(found: re.Match) -> str:
    terms = []
    for term in found[1].split("|"):
        spelt: list[tuple[str, ...]] = [()]
        for sign, optional in re.findall(rf"({_SIGN})(\??)", term.lower()):
            spelt = [s + (sign,) for s in spelt] + (spelt if optional else [])
        terms += spelt
    return f"(?:{_tree(sorted(set(terms)))})"


def _letters(kind, value) -> set[str] | None:
    """Letters and signs that a part of one letter can match, None when not only ASCII."""
    if kind is op.LITERAL:
        return {chr(value)} if value < 128 else None
    if kind is op.IN:
        spans = [(v, v) if k is op.LITERAL else v if k is op.RANGE else (0, 128) for k, v in value]
        return {chr(c) for a, b in spans for c in range(a, b + 1)} if all(b < 128 for _, b in spans) else None
    return None


def _heads(parts) -> tuple[set[str] | None, bool]:
    """Letters that a match can begin with, None when any, and whether the parts can match nothing."""
    heads: set[str] = set()
    for kind, value in parts:
        if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            continue
        optional = False
        if kind is op.SUBPATTERN:
            first, optional = _heads(value[3])
        elif kind is op.BRANCH:
            each = [_heads(b) for b in value[1]]
            first = None if any(h is None for h, _ in each) else set().union(*[h for h, _ in each])
            optional = any(o for _, o in each)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            first, optional = _heads(value[2])
            optional = optional or value[0] == 0
        else:
            first = _letters(kind, value)
        if first is None:
            return None, False
        heads |= first
        if not optional:
            return heads, False
    return heads, True


def _ahead(pattern: str, cased: bool = False) -> str:
    """Looks whether a match can begin with the next letter, in either case unless `cased`; nothing when any letter can."""
    try:
        heads, empty = _heads(parser.parse(pattern))
    except re.error:
        return ""
    if not heads or empty:
        return ""
    every = heads
    if not cased:
        every = {x for h in heads for x in (h.lower(), h.upper())}
        every |= {sign for sign, letter in SIGNS.items() if letter in every}
    return f"(?=[{''.join(re.escape(x) for x in sorted(every))}])"


_BORDERS = {"(?<![A-Za-z0-9])": "(?<!", "(?![A-Za-z0-9])": "(?!"}


def searched_as(pattern: str) -> str:
    """The pattern as one that is found in the same texts, when case is ignored and words follow Unicode."""
    if "(?" in re.sub(r"\(\?(?::|<?!)", "", pattern) or re.search(r"\\[1-9]", pattern):
        return "(?iU)" + pattern
    out = _LIST.sub(_listed, pattern)
    for border, kind in _BORDERS.items():
        out = out.replace(border, f"(?-i:{kind}[A-Za-z0-9{''.join(SIGNS)}]))")
    return f"{_ahead(pattern)}(?iU:{out})"


def extracted_as(pattern: str) -> str:
    """The pattern with the same matches, where words follow Unicode; groups and the case of letters stay as they are."""
    plain = pattern.removeprefix("(?i)")
    return f"{_ahead(plain, cased=plain == pattern)}({'?iU' if plain != pattern else '?U'}:{plain})"
