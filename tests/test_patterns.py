"""Rewritten patterns are found in the same texts and share what they test."""

import random
import re

from pyspark.sql import functions as F

from attesta.operators.molecules import NAMES_009, NAMES_011, NAMES_012
from attesta.operators.patterns import extracted_as, searched_as
from attesta.operators.rules import any_word, has_words
from attesta.rulesets import ATTRIBUTES, ATTRIBUTES_OFFTARGET
from attesta.variants import SCORES_003, SCORES_009, SCORES_011, VARIANTS

ODD = ["\u00df", "\u00f6", "_", "-", "  ", ". ", "/", "\n", "\u017f", "\u212a", "\u0130", "\u0131", "\u0301", "1", "s", "&", "(", "\u65e5"]


def patterns():
    def of(t):
        return [p for x in t.tests for p in of(x)] if hasattr(t, "tests") else [t.pattern]

    labels = [label for table in (ATTRIBUTES, ATTRIBUTES_OFFTARGET) for labels, _ in table.values() for label in labels]
    ruled = [r for v in VARIANTS.values() for r in [*v.rejects, *v.grades]]
    scored = [p for s in [*SCORES_003, *SCORES_009, *SCORES_011] for p in (s.pattern, s.unless) if p]
    return list(dict.fromkeys([p for r in [*ruled, *labels] for p in of(r)] + scored))


def texts(known, n=1500):
    rnd = random.Random(3)
    pieces = sorted({w for p in known for w in re.findall(r"[A-Za-z0-9][A-Za-z0-9 &<'-]*", re.sub(r"\\.|\?|\(\?i?:?", "|", p))})

    def word():
        w, k = rnd.choice(pieces), rnd.random()
        w = w.upper() if k < 0.2 else w.capitalize() if k < 0.3 else w[:-1] if k < 0.4 else w
        return w.replace("s", "\u017f").replace("k", "\u212a").replace("i", rnd.choice("\u0130\u0131")) if k > 0.9 else w

    return ["".join(word() + (rnd.choice(ODD) if rnd.random() < 0.5 else " ") for _ in range(rnd.randint(0, 8))) for _ in range(n)]


def test_all_searches_are_found_in_the_same_texts(spark):
    known = patterns()
    df = spark.createDataFrame([(t,) for t in texts(known)], "t string").repartition(4).cache()
    for i in range(0, len(known), 60):
        some = known[i : i + 60]
        wrong = df.agg(*[F.count(F.when(F.col("t").rlike("(?iU)" + p) != F.col("t").rlike(searched_as(p)), 1)).alias(str(k)) for k, p in enumerate(some)]).first()
        assert not [p for p, n in zip(some, wrong, strict=True) if n]


def test_names_are_extracted_alike(spark):
    known = [p for n in (NAMES_009, NAMES_011, NAMES_012) for p in [*n.patterns, *n.targets]]
    df = spark.createDataFrame([(t,) for t in texts(known)], "t string").repartition(4)
    same = [F.count(F.when(F.regexp_extract("t", "(?U)" + p, 0) != F.regexp_extract("t", extracted_as(p), 0), 1)).alias(str(k)) for k, p in enumerate(known)]
    assert not any(df.agg(*same).first())


def test_lists_share_beginnings_and_letters_are_passed_by(spark):
    assert searched_as(any_word(["toxic", "toxicity", "toxin"])).count("tox") == 1
    assert searched_as(has_words("t", ["rat", "rats"]).pattern).startswith("(?=[Rr])")
    assert extracted_as(r"\bA[0-9]") == r"(?=[A])(?U:\bA[0-9])"
    # What is not understood stays as it is.
    assert searched_as(r"\S") == r"(?iU:\S)" and searched_as("(?-i)Abstract") == "(?iU)(?-i)Abstract"
