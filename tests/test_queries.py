"""Registered queries against their SQL checks on the smallest tables.

ALL_QUERIES=1 runs every query; by default one or two per family run, and `python -m tests.checks 0.01` runs all.
"""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tests.checks import TESTDATA, compare, duck

SF = f"{TESTDATA}/sf0.001"
DEFAULT = """release_view release_scope latest_accept_audit human_verified_count polymorphic_left source_or_join facets coverage
field_completeness offtarget_taxonomy license_manifest evidence_filter query_terms ask_filter search_all record_citation cohen_kappa
baseline_eval ordinal_group_split stratified_sample quota_select kmer_windows split_terms identifier_repair redact_columns leak_scan
table_fingerprint ingest_sources merge_manifest best_location build_candidates append_candidates text_anchors anchor_join
best_context_exact decision_cascade infer_attributes grounding_join verify_grounding validate_review promote_counts apply_verdicts
placeholder_metrics core_field_packet change_diff term_variants evidence_state evidence_graph_edges dq_report""".split()
NAMES = sorted(entry.queries()) if os.environ.get("ALL_QUERIES") else DEFAULT


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.columns and df.count() >= 0
        return
    problem, _ = compare(df, con, sql)
    assert problem is None, problem


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 3095


def test_every_check_names_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 140
