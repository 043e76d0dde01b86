"""Names of molecules in a passage: known names first, then patterns in order, then the target beside its modality."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions.text import ColumnOrName, as_col, compact_text, let, null_if_blank, text_or_empty
from attesta.operators.patterns import extracted_as
from attesta.operators.rules import found
from attesta.operators.searches import may_hold


@dataclass(frozen=True)
class Naming:
    """How one variant names a molecule. Patterns are tried in order; `bad` are no names, `needs` a name must contain."""

    known: tuple[str, ...]
    patterns: tuple[str, ...]
    targets: tuple[str, ...] = ()  # patterns whose first group is a target
    bad: tuple[str, ...] = ()
    needs: str = ""
    known_suffix: str = ""  # for known names without a modality in them
    modality_words: str = ""  # pattern of a modality in a known name
    tidy: bool = False  # names are trimmed and screened by the two patterns below
    starts: str = ""
    holds: str = ""
    refuses: str = ""  # a match with it is no name
    unspecified: bool = False  # end with the target column or "unspecified <modality>" in place of nothing


# Names, patterns and words of the three variants.
NAMES_009 = Naming(
    known=(
        "inclisiran", "patisiran", "vutrisiran", "givosiran", "lumasiran", "fitusiran", "olezarsen", "volanesorsen",
        "tofersen", "nusinersen", "inotersen", "bepirovirsen", "elebsiran", "ISIS 405879", "CpG ODN 1826", "CpG 1018",
    ),
    patterns=(
        r"(?i)\bsi[A-Z0-9][A-Za-z0-9-]{1,20}\b",
        r"(?i)\b[A-Za-z0-9-]+-siRNA\b",
        r"(?i)\b[A-Za-z0-9-]+ ASO\b",
        r"(?i)\b[A-Z0-9-]+-ASO\b",
        r"(?i)\banti-miR-[0-9A-Za-z-]+\b",
        r"(?i)\b[A-Z]{2,}[0-9][A-Z0-9-]*\b",
    ),
    unspecified=True,
)
NAMES_011 = Naming(
    known=(
        "inclisiran", "patisiran", "vutrisiran", "givosiran", "lumasiran", "fitusiran", "olezarsen", "volanesorsen",
        "tofersen", "nusinersen", "inotersen", "bepirovirsen", "pelacarsen", "mipomersen",
    ),
    patterns=(
        r"(?i)\bGalNAc-[A-Za-z0-9-]*si[A-Za-z0-9-]+\b",
        r"(?i)\bsi[A-Z0-9][A-Za-z0-9-]*\d[A-Za-z0-9-]*\b",
        r"(?i)\b[A-Z0-9]{2,}(?:-[A-Z0-9]+)*-siRNA\b",
        r"(?i)\b[A-Z0-9]{2,}(?:-[A-Z0-9]+)*-ASO\b",
        r"(?i)\b[A-Z][A-Z0-9-]{1,12} ASO\b",
        r"(?i)\b[A-Z0-9-]+-ASO\b",
    ),
    targets=(r"\b(?:targeting|against|silencing|knockdown of)\s+([A-Z][A-Z0-9-]{1,12})\b",),
    bad=(
        "sirna", "sirnas", "silencing", "signal", "significant", "situ", "site", "silico", "suggest aso", "the aso",
        "gapmer aso", "overlapping aso", "required aso", "selected aso", "on aso", "nt aso", "pe- sirna", "vs sirna",
    ),
    needs=r"\d|[A-Z]{2,}",
)
NAMES_012 = Naming(
    known=(
        "F7-1", "siCD46", "sli-siRNA", "bulge-siRNA", "fork-siRNA", "ss-siRNA", "siMek1s", "PF-655", "ISIS 121736",
        "LTR-247as", "Anti-N1", "nusinersen", "siDirect2", "siRNA-247", "siRNA-4", "siRNA45", "siRNA-M184V",
    ),
    patterns=(
        r"(?i)\b(?:DNA|LNA|2'-O-methyl|2'-O-Me|fluoro|chemically|base|backbone)-modified siRNA\b",
        r"\b[A-Z0-9]{2,}(?:-[A-Z0-9]+)*-(?:siRNA|shRNA|ASO|AON)\b",
        r"\b(?:si|sh)[A-Z0-9][A-Za-z0-9-]*\d[A-Za-z0-9-]*\b",
        r"\b[A-Z0-9]{2,}[A-Z0-9-]{0,12}\s+(?:siRNA|shRNA|ASO|AON)\b",
        r"\b[A-Z0-9]{2,}\-\d+\b",
        r"(?i)\b(?:artificial|miRNA-like|DNA-modified|modified)\s+(?:siRNA|duplex|miRNA/miRNA\\* duplex)\b",
    ),
    targets=(
        r"\btargeting\s+(?:human\s+)?(?:coagulation factor\s+)?([A-Z][A-Z0-9-]{1,12})\b",
        r"\bagainst\s+(?:the\s+)?([A-Z][A-Z0-9-]{1,12})\b",
        r"\bknockdown of\s+([A-Z][A-Z0-9-]{1,12})\b",
        r"\bsilencing of\s+([A-Z][A-Z0-9-]{1,12})\b",
    ),
    bad=("siRNA", "siRNAs", "RNAi", "ASO", "ASOs", "AON", "duplex", "oligonucleotide", "seed", "target", "control siRNA", "mismatch siRNA"),
    needs=r"\d|[A-Z]{2,}|modified|duplex|siRNA|ASO|shRNA",
    known_suffix=" siRNA",
    modality_words=r"(?i)siRNA|ASO|AON|shRNA|nusinersen",
    tidy=True,
    starts=r"(?i)^(?:are|of|upon|each|on|mer|short|selected|required|transfected|control|mismatch)\b",
    holds=r"(?i)\b(?:Huh-?7|HepG2|Hep3B|HEK293|HeLa|HL-1|cells?|transcripts?)\b",
    refuses=r"(?i)\b(?:small interfering RNA|control siRNA|mismatch siRNA)\b",
)


def _literal(token: str) -> str:
    return r"\b" + token.replace(".", r"\.") + r"\b"


def tidy_name(naming: Naming, name: Column) -> Column:
    """The name without article, edge punctuation and false starts; NULL when nothing fit for a name is left."""
    if not naming.tidy:
        return null_if_blank(name)
    bare = F.regexp_replace(F.regexp_replace(compact_text(name), r"(?i)^(?:the|a|an)\s+", ""), r"^[ ;,.:()\[\]]+|[ ;,.:()\[\]]+$", "")
    bad = sorted({b.lower() for b in naming.bad})
    return let(bare, lambda n: F.when((n != "") & ~n.rlike(naming.starts) & ~n.rlike(naming.holds) & ~F.lower(n).isin(bad), n))


def modality_012(text: ColumnOrName) -> Column:
    """Modality word put behind a target."""
    return F.when(found(text, r"\bASO|antisense oligonucleotide|gapmer|AON\b"), "ASO").when(found(text, r"\bshRNA|short hairpin\b"), "shRNA").otherwise("siRNA")


def _any_known(naming: Naming) -> str:
    return r"\b(?:" + "|".join(t.replace(".", r"\.") for t in naming.known) + r")\b"


def name_hints(naming: Naming, text: Column) -> Column:
    """Which searches of `name_molecule` may find something in the text, by a linear search of it: an argument that saves the others."""
    return may_hold(["(?i)" + _any_known(naming), *naming.patterns, *naming.targets])(text)


def name_molecule(
    naming: Naming, text: ColumnOrName, modality: ColumnOrName, existing: Sequence[ColumnOrName] = (), target: ColumnOrName | None = None,
    hints: ColumnOrName | None = None,
) -> Column:
    """Name of the molecule of a passage, empty when there is none.

    The first nonblank existing name wins (after tidying, where the variant tidies), then the first known name in
    list order, then the first pattern whose first match is fit, then a target with the modality.
    """
    source, kind = text_or_empty(text), text_or_empty(modality)
    choices = []

    def hinted(n: int, search: Column) -> Column:
        return search if hints is None else F.when(F.getbit(as_col(hints), F.lit(n)) == 1, search)

    if existing:
        choices.append(tidy_name(naming, F.coalesce(*[null_if_blank(c) for c in existing], F.lit(""))))
    with_modality = F.lit(naming.known_suffix)
    names = []
    for token in naming.known:
        name = F.lit(token)
        if naming.known_suffix:
            name = F.concat(name, F.when(name.rlike(naming.modality_words), "").otherwise(with_modality))
        names.append(F.when(found(source, _literal(token)), name))
    # One search for all known names comes first: most passages hold none.
    choices.append(hinted(0, F.when(found(source, _any_known(naming)), F.coalesce(*names))))
    for n, pattern in enumerate(naming.patterns, 1):

        def fit(n: Column) -> Column:
            ok = n != ""
            if naming.needs:
                ok = ok & n.rlike(naming.needs)
            if naming.bad:
                ok = ok & ~F.lower(n).isin([b.lower() for b in naming.bad])
            if naming.refuses:
                ok = ok & ~n.rlike(naming.refuses)
            return F.when(ok, n)

        match = F.regexp_extract(source, extracted_as(pattern), 0)
        choices.append(hinted(n, let(F.coalesce(tidy_name(naming, match), F.lit("")) if naming.tidy else match, fit)))
    if naming.targets:
        # Only the first pattern that matches gives the target, fit or not.
        found_target = F.coalesce(*[hinted(n, null_if_blank(F.regexp_extract(source, extracted_as(p), 1))) for n, p in enumerate(naming.targets, 1 + len(naming.patterns))])
        choices.append(let(found_target, lambda t: F.when(t.isNotNull(), tidy_name(naming, F.concat_ws(" ", t, kind)))))
    if naming.unspecified:
        if target is not None:
            choices.append(F.when(null_if_blank(as_col(target)).isNotNull(), F.concat_ws(" ", as_col(target), kind)))
        choices.append(F.concat(F.lit("unspecified "), kind))
    return F.coalesce(*choices, F.lit(""))
