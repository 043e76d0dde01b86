"""The four cascades on hand-written cases, scores and molecule names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from attesta.operators import rules
from attesta.operators.molecules import NAMES_009, NAMES_011, NAMES_012, modality_012, name_molecule
from attesta.plans.q10_variants import CASES, decided, plain_rows
from attesta.variants import REASON, SCORES_003, SCORES_009, SCORES_011, VARIANTS


@pytest.mark.parametrize("variant", sorted(VARIANTS))
def test_every_rule_fires_on_its_case(spark, variant):
    rows = plain_rows(spark, variant)
    out = decided(rows, variant).join(rows.select("row_id", "want", "want_grade"), "row_id").collect()
    wrong = [(r.want, r.reason, r.grade) for r in out if (r.reason.removeprefix(REASON), r.grade) != (r.want, r.want_grade)]
    assert not wrong
    assert {r.reason for r in out if r.reason} == {x.reason for x in VARIANTS[variant].rejects}
    assert len(out) == len(CASES[variant])


def test_null_fields_and_clashing_columns(spark):
    """Null title, text and place count as empty; columns that the caller has already are kept."""
    df = spark.createDataFrame([(1, None, None, None, None, "toxicity", "mine")], "row_id int, title string, text string, location string, source_kind string, evidence_domain string, scope string")
    for v in VARIANTS.values():
        row = rules.decision_cascade(rules.rule_fields(df), v.rejects, v.grades, v.default_grade).first()
        assert row.decision == "reject" and row.scope == "mine" and row.grade == ""
    assert rules.decision_cascade(rules.rule_fields(df.limit(0)), VARIANTS["003"].rejects, VARIANTS["003"].grades, "B").count() == 0


def test_a_word_is_found_between_letters_and_digits_only(spark):
    texts = ["rats", "a rat.", "rat1", "c. elegans", "cx elegans", "(RAT)", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(rules.has_words("t", ["rat", "c. elegans"]).column().alias("x"))
    assert [r.x for r in df.collect()] == [False, True, False, True, False, True, False]


def test_tests_combine_and_negate(spark):
    df = spark.createDataFrame([("ab",), ("a",), ("b",), ("",)], "t string")
    a, b = rules.has("t", "a"), rules.has("t", "b")
    got = df.select(rules.either(a, ~b).column().alias("x"), (~rules.every(a, b)).column().alias("y")).collect()
    assert [(r.x, r.y) for r in got] == [(True, False), (True, True), (False, True), (True, True)]


def test_scores_by_hand(spark):
    rows = [
        ("toxicity", "the siRNA was well tolerated in mice", "Results", "pmc_full_text", "true"),
        ("offtarget", "siRNA seed match by RNA-seq, a review", "Introduction", "pubmed_abstract", "false"),
        ("toxicity", "", "Abstract", "pubmed_abstract", "false"),
    ]
    df = spark.createDataFrame(rows, "evidence_domain string, text string, location string, source_kind string, hash_exact string")
    got = df.select(*[rules.score(s).alias(n) for n, s in (("a", SCORES_003), ("b", SCORES_009), ("c", SCORES_011))]).collect()
    # 003: terms sirna (5); was well tolerated, mice (4); tolerated (6); hash 10, results 12.
    # Second row: sirna (5); rna-seq (2); seed, rna-seq (16); introduction -10, review -8.
    assert [r.a for r in got] == [37, 5, 2]
    # 009: hash 20, full text 4, results 12, oligo 10, primary 5, safety 8, result 12; then -18 + 10 + 10 + 18 + 12 + 5.
    assert [r.b for r in got] == [71, 37, 0]
    # 011: oligo 10, mice 8 + 6; then 35 + 18 + 10 + 8 + 6.
    assert [r.c for r in got] == [24, 77, 0]


def test_molecule_names(spark):
    cases = [
        # text, 009, 011, 012
        ("Inclisiran and siTTR-1 in mice", "inclisiran", "inclisiran", "siTTR-1"),
        ("signal of siTTR2", "signal", "siTTR2", "siTTR2"),
        ("dose of TTR-ASO", "TTR-ASO", "TTR-ASO", "TTR-ASO"),
        ("siRNA targeting human TTR", "siRNA", "", "TTR siRNA"),
        ("a gapmer silencing of TTR", "silencing", "", "TTR ASO"),
        ("LNA-modified siRNA", "siRNA", "", "LNA-modified siRNA"),
        ("F7-1 was given", "unspecified siRNA", "", "F7-1 siRNA"),
        ("shRNA against the HeLa line", "unspecified siRNA", "", ""),
        ("", "unspecified siRNA", "", ""),
        (None, "unspecified siRNA", "", ""),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string")
    got = df.select(
        "t",
        name_molecule(NAMES_009, "t", F.lit("siRNA")).alias("a"),
        name_molecule(NAMES_011, "t", F.lit("siRNA")).alias("b"),
        name_molecule(NAMES_012, "t", modality_012("t")).alias("c"),
    )
    assert [tuple(r) for r in got.collect()] == cases


def test_existing_names_and_targets_win_in_order(spark):
    df = spark.createDataFrame([("", "the siABC1.", "TTR"), ("old", None, None), (None, "siRNA", "TTR")], "canonical string, proposed string, target string")
    names = ["canonical", "proposed"]
    got = df.select(
        name_molecule(NAMES_009, F.lit("x"), F.lit("ASO"), names, "target").alias("a"),
        name_molecule(NAMES_012, F.lit("x"), F.lit("ASO"), names).alias("b"),
        name_molecule(NAMES_009, F.lit("x"), F.lit("ASO"), target="target").alias("c"),
    ).collect()
    assert [tuple(r) for r in got] == [("the siABC1.", "siABC1", "TTR ASO"), ("old", "old", "unspecified ASO"), ("siRNA", "", "TTR ASO")]
