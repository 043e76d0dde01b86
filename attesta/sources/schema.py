"""The ten tables of the data model, with explicit types.

Flags are 0/1 integers, timestamps are ISO-8601 text, JSON and lists are text columns.
"""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "int": T.IntegerType()}


def _schema(spec: str) -> T.StructType:
    """Build a schema from `name[:type]` words; the default type is string."""
    fields = []
    for word in spec.split():
        name, _, kind = word.partition(":")
        fields.append(T.StructField(name, _TYPES[kind or "string"], True))
    return T.StructType(fields)


# Table and column names of the data model.
TABLES: dict[str, T.StructType] = {
    "source_document": _schema(
        "id:bigint source_type source_url pmid pmcid doi title journal_or_agency publication_year:int "
        "license_status reuse_category accessed_at"
    ),
    "modality": _schema("id:bigint name in_core_scope:int scope_note"),
    "molecule": _schema(
        "id:bigint canonical_name modality_id:bigint target_gene_symbol disease_context therapeutic_status "
        "sense_sequence antisense_sequence guide_sequence passenger_sequence seed_region backbone_chemistry "
        "sugar_modification base_modification conjugate_delivery sequence_annotation_status "
        "modification_annotation_status external_ids created_at"
    ),
    "assay": _schema(
        "id:bigint assay_type organism model_system cell_line_or_tissue dose_value:double dose_unit "
        "exposure_time_value:double exposure_time_unit replicate_count:bigint source_document_id:bigint "
        "source_location"
    ),
    "toxicity_endpoint": _schema(
        "id:bigint molecule_id:bigint assay_id:bigint endpoint_name endpoint_category measured_value:double "
        "measured_unit direction significance_label is_observed_experimental:int source_document_id:bigint "
        "source_location evidence_grade"
    ),
    "offtarget_evidence": _schema(
        "id:bigint molecule_id:bigint assay_id:bigint offtarget_gene_symbol offtarget_transcript_id "
        "evidence_type measured_effect effect_unit match_type seed_match_length:bigint "
        "is_observed_experimental:int is_computational_prediction:int source_document_id:bigint "
        "source_location evidence_grade"
    ),
    "curation_audit": _schema(
        "id:bigint entity_table entity_id:bigint extraction_method extractor_model_or_script "
        "validation_status curator_decision curator_id audit_note audited_at"
    ),
    "benchmark_split": _schema(
        "id:bigint task_name split_name entity_table entity_id:bigint split_strategy leakage_group version created_at"
    ),
    "curation_queue": _schema(
        "id:bigint source_document_id:bigint pmid doi source_title source_type candidate_modality "
        "evidence_domain extraction_target suggested_evidence_grade priority queue_status curator_id created_at"
    ),
    "curation_candidate": _schema(
        "id:bigint queue_id:bigint source_document_id:bigint pmid doi evidence_domain candidate_modality "
        "source_location matched_terms candidate_signal suggested_evidence_grade confidence_label "
        "extraction_method validation_status curator_decision redistribution_level created_at"
    ),
}

# Column groups used by several operators.
SEQUENCE_FIELDS = ["sense_sequence", "antisense_sequence", "guide_sequence", "passenger_sequence", "seed_region"]
CHEMISTRY_FIELDS = ["backbone_chemistry", "sugar_modification", "base_modification", "conjugate_delivery"]
FACTS = ["toxicity_endpoint", "offtarget_evidence"]
# Columns of `molecule` that older table versions lack, with the defaults they get.
LATE_MOLECULE_COLUMNS = {
    "sense_sequence": "",
    "antisense_sequence": "",
    "guide_sequence": "",
    "passenger_sequence": "",
    "seed_region": "",
    "backbone_chemistry": "",
    "sugar_modification": "",
    "base_modification": "",
    "conjugate_delivery": "",
    "sequence_annotation_status": "needs_curator_sequence_curation",
    "modification_annotation_status": "needs_curator_modification_curation",
}
