"""Registry of runnable queries: a builder over (spark, sf_dir) and, where SQL can say it, a check query."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from attesta.sources.adapters import ADAPTER_SQL

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    check_sql: str | None


QUERIES: dict[str, Query] = {}

# The release view in SQL, shared by every check that starts from it.
RELEASE_SQL = r"""
latest_audit AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY entity_table, entity_id ORDER BY audited_at DESC, id DESC) AS rn
    FROM curation_audit WHERE validation_status = 'curator_verified' AND curator_decision = 'accept') WHERE rn = 1),
evidence_rows AS (
  SELECT 'toxicity' AS evidence_domain, 'toxicity_endpoint' AS entity_table, id AS evidence_id,
         endpoint_category AS category, endpoint_name AS evidence_label, 0 AS is_computational_prediction,
         CAST(NULL AS VARCHAR) AS match_type, evidence_grade, source_location, source_document_id, molecule_id,
         assay_id, is_observed_experimental
  FROM toxicity_endpoint
  UNION ALL
  SELECT 'offtarget', 'offtarget_evidence', id, evidence_type, evidence_type, is_computational_prediction,
         match_type, evidence_grade, source_location, source_document_id, molecule_id, assay_id,
         is_observed_experimental
  FROM offtarget_evidence),
evidence_star AS (
  SELECT e.*, m.canonical_name, mo.name AS modality, m.target_gene_symbol, m.disease_context, m.sense_sequence,
         m.antisense_sequence, m.guide_sequence, m.passenger_sequence, m.seed_region, m.backbone_chemistry,
         m.sugar_modification, m.base_modification, m.conjugate_delivery, m.sequence_annotation_status,
         m.modification_annotation_status, s.title AS source_title, s.pmid, s.pmcid AS source_pmcid, s.doi,
         s.source_url, s.license_status AS source_license_status, s.reuse_category AS source_reuse_category
  FROM evidence_rows e JOIN molecule m ON m.id = e.molecule_id JOIN modality mo ON mo.id = m.modality_id
  JOIN source_document s ON s.id = e.source_document_id),
release_view AS (
  SELECT evidence_domain, e.entity_table, evidence_id, canonical_name, modality, target_gene_symbol,
         disease_context, sense_sequence, antisense_sequence, guide_sequence, passenger_sequence, seed_region,
         backbone_chemistry, sugar_modification, base_modification, conjugate_delivery,
         sequence_annotation_status, modification_annotation_status, category, evidence_label, evidence_grade,
         source_location, source_document_id, source_title, pmid, source_pmcid, doi, source_url,
         source_license_status, source_reuse_category,
         CASE WHEN contains(lower(source_location), 'paragraph') OR contains(lower(source_location), 'results')
                OR contains(lower(source_location), 'table') OR contains(lower(source_location), 'figure')
              THEN 'source-localized derived annotation' ELSE 'source-linked derived annotation' END AS curation_basis,
         'false' AS raw_quote_included, is_observed_experimental, is_computational_prediction,
         a.validation_status AS audit_validation_status, a.curator_decision, a.curator_id, a.audit_note, a.audited_at
  FROM evidence_star e JOIN latest_audit a ON a.entity_table = e.entity_table AND a.entity_id = e.evidence_id
  WHERE evidence_grade IN ('A', 'B', 'C'))
""".strip()


def with_views(sql: str) -> str:
    """Prefix a check query with the adapter and release CTEs."""
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ADAPTER_SQL},\n{RELEASE_SQL},\n{body[5:]}"
    return f"WITH {ADAPTER_SQL},\n{RELEASE_SQL}\n{body}"


def query(name: str, check: str | None = None) -> Callable[[Builder], Builder]:
    """Register a builder; `check` is DuckDB SQL over the adapter and release CTEs."""

    def register(build: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = Query(name, build, with_views(check) if check else None)
        return build

    return register
