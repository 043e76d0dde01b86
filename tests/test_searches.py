"""Ordered rules by linear search: the same decisions as rule by rule, words as in the SQL checks."""

from pyspark.sql import functions as F

from attesta.operators import rules, searches
from attesta.operators.molecules import NAMES_009, NAMES_011, NAMES_012, modality_012, name_hints, name_molecule
from attesta.operators.windows import passage_window
from attesta.plans.q10_variants import decided, plain_rows
from attesta.variants import REASON, VARIANTS
from tests.test_patterns import patterns, texts


def test_a_word_begins_after_a_letter_that_is_not_ascii(spark):
    """As in the SQL of decision_cascade_011, where three rows of sf0.1 hold such a word."""
    row = (1, 1, "siRNA and off-target effects ßtest", "", "Abstract", "pubmed_abstract", "offtarget")
    df = spark.createDataFrame([row], "row_id long, position int, text string, title string, location string, source_kind string, evidence_domain string")
    got = decided(rules.rule_fields(df), "011").first()
    assert got.reason == REASON + "off-target mention is not supported by primary analysis"


def test_decisions_are_those_of_the_rules_one_by_one(spark):
    words = spark.createDataFrame([(t,) for t in texts(patterns(), 400) if t.isascii()], "more string")
    for variant in VARIANTS:
        cases = plain_rows(spark, variant).select("text", "title", "location", "source_kind", "evidence_domain", "article_type", "molecule")
        odd = cases.crossJoin(words).where(F.abs(F.xxhash64("text", "more")) % 12 == 0).withColumn("text", F.concat_ws(" ", "text", "more")).drop("more")
        rows = rules.rule_fields(cases.unionByName(odd).withColumn("title", F.nullif("title", F.lit("")))).withColumns({"row_id": F.monotonically_increasing_id(), "position": F.lit(1)})
        rows = rows.localCheckpoint()
        linear = decided(rows, variant)
        assert "ArrowEvalPython" in linear._jdf.queryExecution().executedPlan().toString()
        v = VARIANTS[variant]
        single = rules.decision_cascade(rows, v.rejects, v.grades, v.default_grade).select(linear.columns)
        assert "ArrowEvalPython" not in single._jdf.queryExecution().executedPlan().toString()
        assert linear.count() == rows.count() and linear.exceptAll(single).count() == 0


def test_nested_tests_and_their_opposites():
    import pyarrow as pa

    columns = {"t": pa.array(["ab", "a", "b", "", "abc"])}
    a, b, c = ("t", "a", True), ("t", "b", True), ("t", "c", True)
    cases = [((a, b), True, True), ((a, b), False, True), ((a, b), True, False), ((((a, b), True, True), c), False, False), ((((a, b), False, False), c), False, True)]
    want = [[0, 4], [0, 1, 2, 4], [1, 2, 3], [1, 2, 3], [3, 4]]
    at = pa.array(range(5), pa.int32())
    assert [searches.first_rule(columns, [[t]], at)[0].to_pylist() for t in cases] == want
    # The first rule decides; those left come last.
    assert [x.to_pylist() for x in searches.first_rule(columns, [[c], [a, b], [a]], at)] == [[4], [0], [1], [2, 3]]


def test_late_fields_are_worked_out_for_rows_left(spark):
    df = spark.createDataFrame([("x",), ("y1",), ("y",)], "text string")
    some = [rules.Reject("has x", (rules.has("text", "x"),)), rules.Reject("no name", (rules.lacks("name", "."),))]
    late = {"name": F.regexp_extract("text", "[0-9]|x", 0)}
    for linear in (False, True):
        got = rules.decision_cascade(df, some, [], "A", late=late, linear=linear)
        assert sorted((r.text, r.reason, r.name, r.grade) for r in got.collect()) == [("x", "has x", "", ""), ("y", "no name", "", ""), ("y1", "", "1", "A")]


def test_words_follow_unicode_unless_the_search_is_linear(spark):
    df = spark.createDataFrame([("\u00dftest",)], "text string")
    some = [rules.Reject("test", (rules.has("text", r"\btest"),))]
    assert [rules.decision_cascade(df, some, [], linear=x).first().reason for x in (False, True)] == ["", "test"]


def test_hints_lose_no_name(spark):
    odd = [" siRNA", "TTR-٤ ASO", "sıTTR-1", "SİX9", "LNA-modified siRNA", "a TTR-12", "against the TTR", "nothing"]
    df = spark.createDataFrame([(t,) for t in odd + texts([p for n in (NAMES_009, NAMES_011, NAMES_012) for p in [*n.known, *n.patterns, *n.targets]], 600)], "t string")
    for naming in (NAMES_009, NAMES_011, NAMES_012):
        hinted = df.withColumn("h", name_hints(naming, F.col("t")))
        both = hinted.select("t", name_molecule(naming, "t", modality_012("t")).alias("a"), name_molecule(naming, "t", modality_012("t"), hints="h").alias("b"))
        assert both.where("a <> b").collect() == []


def test_windows_over_long_documents_and_gaps(spark):
    at = [*range(0, 300), 302, 303, 304]
    df = spark.createDataFrame([(1, p, f"t{p}", p * 2) for p in at] + [(2, 64, "only", 0)], "page_id int, position int, text string, more int")
    got = {(r.page_id, r.position): (r.window_text, r.more) for r in passage_window(df).collect()}
    want = {(1, p): (" ".join(f"t{q}" for q in (p - 1, p, p + 1) if q in at), p * 2) for p in at} | {(2, 64): ("only", 0)}
    assert got == want
