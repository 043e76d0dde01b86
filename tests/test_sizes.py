"""What steps keep or shuffle stays small against their input, with the same results."""

import gzip
from pathlib import Path

from pyspark.sql import functions as F

from attesta import session
from attesta.lexicons import QuestionTerm
from attesta.operators import release, search, spelling, windows
from attesta.sources import tables as sources
from attesta.sources.adapters import evidence_tables

TINY = "/root/testdata/sf0.001"
TERMS = [QuestionTerm("small", ("small",), ("small", "tiny")), QuestionTerm("two", ("ring",), ("gear small", "thtion", "tiny ring"))]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_lookup_keeps_distinct_combinations_not_rows(spark, monkeypatch):
    kept = []

    def counted(df):
        kept.append(df.count())
        return df

    monkeypatch.setattr(spelling, "store", counted)
    i = F.col("id")
    data = spark.range(3000).select("id", F.concat(F.lit("name"), i % 10).alias("a"), F.concat(F.lit("title "), F.floor(i / 10) % 20).alias("b"), F.concat(F.lit("odd\u0001"), i % 2).alias("c"))
    asked = spark.createDataFrame([("name3",), ("title 1",), ("odd",), ("zz",), ("",)], "spelling string")
    got = spelling.signed_rows(data, [[F.col("a")], [F.col("b"), F.col("c")]], asked)
    assert rows(got.select("id", F.size("found"))) == [
        (n, 1 + (n % 10 == 3) + str(n // 10 % 20).startswith("1") + 1) for n in range(3000)
    ]
    assert sum(kept) < 300


def test_counts_and_first_rows_equal_the_whole_search(spark):
    view = release.release_view(evidence_tables(spark, TINY))
    asked = [f"{w} {a}" for w in ("small ring", "tiny", "ring", "hot") for a in ("toxicity grade A/B", "off-target", "seed grade b", "any")]
    questions = spark.createDataFrame([(q, q) for q in asked], "question_id string, question string")
    whole = search.ask_filter(view, questions, TERMS)
    assert rows(search.ask_counts(view, questions, TERMS)) == rows(search.ask_summary(whole))
    first = search.ask_citations(search.ask_first(view, questions, TERMS)).select("question_id", "evidence_id", "position")
    assert rows(first) == rows(search.ask_citations(whole).select("question_id", "evidence_id", "position"))
    queries = questions.select(F.col("question_id").alias("query_id"), F.col("question").alias("q")).unionByName(spark.createDataFrame([("r", "small ring"), ("t", "tiny")], "query_id string, q string"))
    hits = search.synonym_search(view, search.EVIDENCE_FIELDS, queries, ["entity_table", "evidence_id"])
    assert rows(search.synonym_counts(view, search.EVIDENCE_FIELDS, queries)) == rows(hits.groupBy("query_id").agg(F.count("*").alias("hits")))


def test_cards_join_sources_once_per_combination(spark, monkeypatch):
    kept = []

    def counted(df):
        kept.append(df.count())
        return df.localCheckpoint()

    monkeypatch.setattr(search, "store", counted)
    tables = evidence_tables(spark, TINY)
    view = release.release_view(tables)
    cards = search.record_cards(view, tables["curation_audit"], tables["source_document"])
    sources = view.select("source_document_id").distinct().count()
    assert kept == [sources, sources]
    assert cards.count() == view.count()


def test_cards_tell_a_null_from_a_neighbouring_field(spark):
    fields = [c for c in release.RELEASE_COLUMNS if c not in ("evidence_id", "entity_table", "pmid", "doi")]
    rows_in = spark.createDataFrame([("t", 1, "7", None), ("t", 2, None, "7"), ("t", 3, None, None)], "entity_table string, evidence_id long, pmid string, doi string")
    view = rows_in.withColumns({c: F.lit(None).cast("string") for c in fields})
    sources = spark.createDataFrame([(1, "7", "a"), (2, "b", "7")], "id long, pmid string, doi string").withColumns(
        {c: F.lit("").cast("string") for c in ("title", "pmcid", "source_url", "license_status")}
    )
    audit = spark.createDataFrame([], "id long, entity_table string, entity_id long, validation_status string, curator_decision string")
    got = search.record_cards(view, audit, sources).select("evidence_id", "matched_source_id", "pmid", "doi")
    assert rows(got) == [(1, 1, "7", "a"), (2, 2, "b", "7"), (3, None, "", "")]


def test_newest_audit_sorts_without_the_columns_its_filter_fixes(spark):
    audit = evidence_tables(spark, TINY)["curation_audit"]
    newest = windows.latest_accept_audit(audit)
    sorts = [line for line in newest._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window" in line]
    assert sorts and newest.columns == audit.columns
    assert not [n for n in ("validation_status", "curator_decision") if n in newest._jdf.queryExecution().optimizedPlan().toString().split("Window", 1)[1]]
    assert {tuple(r) for r in newest.select("validation_status", "curator_decision").distinct().collect()} == {("curator_verified", "accept")}


def test_task_bounds_leave_named_sizes_alone(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", "7m")
    session.bound_tasks(own)
    assert own.conf.get("spark.sql.files.maxPartitionBytes") == "7m"
    assert own.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"


def test_group_split_does_not_shuffle_rows_by_task(spark):
    data = spark.range(3_000_000).select("id", F.lit("t").alias("task_name"), (F.col("id") % 5).cast("string").alias("leakage_group"))
    got = windows.ordinal_group_split(data)
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert rows(got.groupBy("split_name").count()) == [("test", 600_000), ("train", 1_800_000), ("validation", 600_000)]


def test_exports_are_stored_compressed(spark, tmp_path):
    tables = evidence_tables(spark, TINY)
    version = sources.publish_exports(tables, str(tmp_path), ["curation_candidate"])
    for form in ("csv", "json"):
        parts = [p for p in Path(version, f"curation_candidate_{form}").iterdir() if p.name.startswith("part-")]
        assert parts and all(p.suffix == ".gz" for p in parts)
        plain = sum(len(gzip.decompress(p.read_bytes())) for p in parts)
        assert sum(p.stat().st_size for p in parts) < plain / 4
        read = sources.read_export(spark, version, "curation_candidate", form)
        assert read.count() == tables["curation_candidate"].count() > 0


def test_rows_are_read_once_when_dimensions_are_given(spark, monkeypatch):
    tables = evidence_tables(spark, TINY)
    view, among = release.release_view(tables), release.dimension_rows(tables)
    parts = release.by_dimension(search.QUESTION_FIELDS)
    assert len(parts) == 4 and None not in release.holding(parts, among)
    read = []
    monkeypatch.setattr(spelling, "key_source", lambda rows: read.append(rows) or rows)
    questions = spark.createDataFrame([(q, q) for q in ("small ring toxicity", "tiny off-target grade a", "ring")], "question_id string, question string")
    got = rows(search.ask_counts(view, questions, TERMS, among=among))
    assert not read and got == rows(search.ask_counts(view, questions, TERMS)) and got
    assert len(read) == 1
    queries = spark.createDataFrame([("r", "small ring"), ("t", "tiny"), ("n", "results")], "query_id string, q string")
    counted = [rows(search.synonym_counts(view, search.EVIDENCE_FIELDS, queries, among=a)) for a in (among, ())]
    assert counted[0] == counted[1] and counted[0]
