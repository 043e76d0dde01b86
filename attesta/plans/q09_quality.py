"""Queries: data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import quality, release, stats, windows
from attesta.plans.q04_metrics import _PACKET, _packet_pool
from attesta.plans.registry import query
from attesta.sources.adapters import evidence_tables

MINIMUM = {"source_document": 500, "curation_candidate": 100}
EXACT = {"modality": 5}


def _status(sql: str) -> str:
    return f"SELECT *, CASE WHEN violations = 0 THEN 'pass' ELSE 'fail' END AS status FROM ({sql})"


def _dq_sql() -> str:
    parts = [f"SELECT 'minimum_rows:{t}' AS check, greatest({n} - count(*), 0) AS violations FROM {t}" for t, n in MINIMUM.items()]
    parts += [f"SELECT 'exact_rows:{t}', abs({n} - count(*)) FROM {t}" for t, n in EXACT.items()]
    parts += [
        """SELECT 'release_without_accept', count(*) FROM evidence_rows e WHERE NOT EXISTS (SELECT 1 FROM curation_audit a WHERE a.entity_table = e.entity_table
           AND a.entity_id = e.evidence_id AND a.validation_status = 'curator_verified' AND a.curator_decision = 'accept')""",
        "SELECT 'bad_grade_or_location', count(*) FROM evidence_rows WHERE evidence_grade NOT IN ('A', 'B', 'C') OR coalesce(source_location, '') = ''",
        """SELECT 'split_not_grade_ab', count(*) FROM benchmark_split b LEFT JOIN evidence_rows e ON e.entity_table = b.entity_table AND e.evidence_id = b.entity_id
           WHERE coalesce(e.evidence_grade, '') NOT IN ('A', 'B')""",
        "SELECT 'duplicate_pmid', count(*) FROM (SELECT pmid FROM source_document WHERE coalesce(pmid, '') <> '' GROUP BY pmid HAVING count(*) > 1)",
        "SELECT 'duplicate_modality_name', count(*) FROM (SELECT name FROM modality GROUP BY name HAVING count(*) > 1)",
        "SELECT 'forbidden_redistribution', count(*) FROM curation_candidate WHERE redistribution_level <> 'derived_annotations_only'",
        "SELECT 'forbidden_modality_in_scope', count(*) FROM modality WHERE contains(lower(name), 'crispr') AND in_core_scope = 1",
        "SELECT 'forbidden_modality_molecules', count(*) FROM molecule m JOIN modality mo ON mo.id = m.modality_id WHERE contains(lower(mo.name), 'crispr')",
        "SELECT 'unproven_accept', count(*) FROM curation_audit WHERE validation_status IN ('needs_full_text_check', 'unverified', 'curator_verified_abstract_level') AND curator_decision = 'accept'",
        "SELECT 'disabled_script', count(*) FROM curation_audit WHERE contains(lower(extractor_model_or_script), 'curator_batch1') OR contains(lower(extraction_method), 'curator_batch1')",
    ]
    parts += [
        f"SELECT 'orphan:{c}.{k}', count(*) FROM {c} c WHERE c.{k} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} p WHERE p.id = c.{k})" for c, k, p in quality.FOREIGN_KEYS
    ]
    parts += [
        f"SELECT 'duplicate_id:{t}', count(*) FROM (SELECT id FROM {t} GROUP BY id HAVING count(*) > 1)"
        for t in ("source_document", "molecule", "toxicity_endpoint", "offtarget_evidence", "curation_audit")
    ]
    return _status(" UNION ALL ".join(parts))


@query("dq_report", _dq_sql())
def _(spark, sf_dir):
    return quality.dq_report(evidence_tables(spark, sf_dir), MINIMUM, EXACT)


@query(
    "packet_report",
    f"WITH {_PACKET.format(target=700)}, p AS (SELECT c.* FROM curation_candidate c JOIN sel ON sel.id = c.id) "
    + _status(
        """SELECT 'packet_minimum_rows' AS check, greatest(800 - count(*), 0) AS violations FROM p UNION ALL SELECT 'packet_duplicate_ids', count(*) - count(DISTINCT id) FROM p
      UNION ALL SELECT 'packet_pre_accepted', count(*) FILTER (curator_decision = 'accept') FROM p UNION ALL SELECT 'packet_pre_verified', count(*) FILTER (validation_status = 'curator_verified') FROM p
      UNION ALL SELECT 'packet_wrong_domain', count(*) FILTER (evidence_domain NOT IN ('toxicity', 'offtarget')) FROM p
      UNION ALL SELECT 'packet_no_identifier_or_location', count(*) FILTER (NOT ((coalesce(pmid, '') <> '' OR coalesce(doi, '') <> '') AND source_location <> '')) FROM p
      UNION ALL SELECT 'packet_offtarget_minimum', greatest(90 - count(*) FILTER (evidence_domain = 'offtarget'), 0) FROM p
      UNION ALL SELECT 'audits_equal_release_rows', abs((SELECT count(*) FROM evidence_rows) - (SELECT count(*) FROM curation_audit WHERE validation_status = 'curator_verified' AND curator_decision = 'accept'))"""
    ),
)
def _(spark, sf_dir):
    tables = evidence_tables(spark, sf_dir)
    packet = windows.quota_select(_packet_pool(tables), target=700, max_offtarget=100).withColumnRenamed("id", "candidate_id")
    return quality.packet_report(packet, tables, 800, 90)


@query(
    "export_agreement",
    """SELECT 'release_view' AS form, count(*) AS n_rows, true AS agrees FROM release_view
      UNION ALL SELECT 'audited_facts', (SELECT count(*) FROM latest_audit), (SELECT count(*) FROM latest_audit) = (SELECT count(*) FROM release_view)
      UNION ALL SELECT 'license_manifest', (SELECT count(*) FROM source_document), (SELECT count(*) FROM source_document) = (SELECT count(*) FROM release_view)""",
)
def _(spark, sf_dir):
    tables = evidence_tables(spark, sf_dir)
    forms = {
        "release_view": release.release_view(tables),
        "audited_facts": windows.latest_accept_audit(tables["curation_audit"]),
        "license_manifest": stats.license_manifest(tables),
    }
    return quality.export_agreement(forms).select("form", "n_rows", F.col("agrees"))
