"""The release view: both fact tables star-joined and reduced to verified, graded evidence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import ColumnOrName, contains_ci
from attesta.operators.windows import latest_accept_audit
from attesta.sources.schema import FACTS

Tables = Mapping[str, DataFrame]

# Words in a location that mark a localized annotation, and the two wordings.
LOCALIZED_MARKERS = ["paragraph", "Results", "Table", "Figure"]
LOCALIZED = "source-localized derived annotation"
LINKED = "source-linked derived annotation"

MOLECULE_COLUMNS = (
    "canonical_name target_gene_symbol disease_context sense_sequence antisense_sequence guide_sequence "
    "passenger_sequence seed_region backbone_chemistry sugar_modification base_modification conjugate_delivery "
    "sequence_annotation_status modification_annotation_status"
).split()

SOURCE_COLUMNS = "source_title pmid source_pmcid doi source_url source_license_status source_reuse_category".split()
AUDIT_COLUMNS = "validation_status curator_decision curator_id audit_note audited_at".split()


def curation_basis(location: ColumnOrName) -> Column:
    marked = reduce(lambda a, b: a | b, [contains_ci(location, m) for m in LOCALIZED_MARKERS])
    return F.when(marked, LOCALIZED).otherwise(LINKED)


def release_scope(tables: Tables, kind: str) -> DataFrame:
    """Distinct ids of the sources, molecules or assays that either fact table refers to."""
    column = {"source": "source_document_id", "molecule": "molecule_id", "assay": "assay_id"}[kind]
    ids = [tables[fact].select(F.col(column).alias("id")) for fact in FACTS]
    return ids[0].union(ids[1]).distinct()


def scope_semi(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is in the id set."""
    return df.join(ids.select(F.col("id").alias("_scope_id")), F.col(key) == F.col("_scope_id"), "left_semi")


def in_scope(tables: Tables, kind: str) -> DataFrame:
    """Release-scoped sources, molecules or assays; the facts are reduced by the semi join itself."""
    table = {"source": "source_document", "molecule": "molecule", "assay": "assay"}[kind]
    return scope_semi(tables[table], release_scope(tables, kind))


def dimension_columns(tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Molecule with its modality name, and source, under the column names of the release view.

    No broadcast hint: molecule and source tables grow with the data. Spark broadcasts a side whose size
    it has checked against the threshold and uses a sort-merge join with skew handling otherwise.
    """
    modality = tables["modality"].select(F.col("id").alias("modality_id"), F.col("name").alias("modality"))
    molecule = (
        tables["molecule"]
        .join(modality, "modality_id")
        .select(F.col("id").alias("molecule_id"), "modality", *MOLECULE_COLUMNS)
    )
    source = tables["source_document"].select(
        F.col("id").alias("source_document_id"),
        F.col("title").alias("source_title"),
        "pmid",
        F.col("pmcid").alias("source_pmcid"),
        "doi",
        "source_url",
        F.col("license_status").alias("source_license_status"),
        F.col("reuse_category").alias("source_reuse_category"),
    )
    return molecule, source


def by_dimension(fields: Sequence[str]) -> list[list[str]]:
    """Fields in groups that vary together: molecule, source, audit, the fact itself."""
    own = {f: "molecule" for f in ["modality", *MOLECULE_COLUMNS]} | {f: "source" for f in SOURCE_COLUMNS} | {f: "audit" for f in AUDIT_COLUMNS}
    groups: dict[str, list[str]] = {}
    for f in fields:
        groups.setdefault(own.get(f, "fact"), []).append(f)
    return list(groups.values())


def dimension_rows(tables: Tables) -> list[DataFrame]:
    """Tables that hold all values of the release view by dimension: molecule, source, accepted audit, the fact itself."""
    accepted = tables["curation_audit"].filter("validation_status = 'curator_verified' AND curator_decision = 'accept'")
    return [*dimension_columns(tables), accepted.select(*AUDIT_COLUMNS), fact_rows(tables)]


def holding(fields: Sequence[Sequence[str]], among: Sequence[DataFrame]) -> list[DataFrame | None]:
    """For each group of fields the first of the tables that has them all."""
    return [next((t for t in among if set(some) <= set(t.columns)), None) for some in fields]


def star_join(fact: DataFrame, tables: Tables) -> DataFrame:
    """Inner star join of evidence rows with molecule, modality and source."""
    molecule, source = dimension_columns(tables)
    return fact.join(molecule, "molecule_id").join(source, "source_document_id")


def fact_rows(tables: Tables) -> DataFrame:
    """Both fact tables in one shape, before any dimension is joined."""
    shared = "evidence_grade source_location source_document_id molecule_id assay_id is_observed_experimental".split()
    toxicity = tables["toxicity_endpoint"].select(
        F.lit("toxicity").alias("evidence_domain"),
        F.lit("toxicity_endpoint").alias("entity_table"),
        F.col("id").alias("evidence_id"),
        F.col("endpoint_category").alias("category"),
        F.col("endpoint_name").alias("evidence_label"),
        F.lit(0).alias("is_computational_prediction"),
        F.lit(None).cast("string").alias("match_type"),
        *shared,
    )
    offtarget = tables["offtarget_evidence"].select(
        F.lit("offtarget").alias("evidence_domain"),
        F.lit("offtarget_evidence").alias("entity_table"),
        F.col("id").alias("evidence_id"),
        F.col("evidence_type").alias("category"),
        F.col("evidence_type").alias("evidence_label"),
        "is_computational_prediction",
        "match_type",
        *shared,
    )
    return toxicity.unionByName(offtarget)


def evidence_tables(tables: Tables) -> DataFrame:
    """Both fact tables star-joined, whether audited or not."""
    return star_join(fact_rows(tables), tables)


def audit_left_join(evidence: DataFrame, audit: DataFrame) -> DataFrame:
    """Evidence with its newest accepted audit; rows without one are kept with NULLs."""
    latest = latest_accept_audit(audit).select(
        "entity_table",
        F.col("entity_id").alias("evidence_id"),
        F.col("validation_status").alias("audit_validation_status"),
        *AUDIT_COLUMNS[1:],
    )
    return evidence.join(latest, ["entity_table", "evidence_id"], "left")


RELEASE_COLUMNS = (
    "evidence_domain entity_table evidence_id canonical_name modality target_gene_symbol disease_context "
    "sense_sequence antisense_sequence guide_sequence passenger_sequence seed_region backbone_chemistry "
    "sugar_modification base_modification conjugate_delivery sequence_annotation_status "
    "modification_annotation_status category evidence_label evidence_grade source_location source_document_id "
    "source_title pmid source_pmcid doi source_url source_license_status source_reuse_category curation_basis "
    "raw_quote_included is_observed_experimental is_computational_prediction audit_validation_status "
    "curator_decision curator_id audit_note audited_at"
).split()


def verified_facts(tables: Tables) -> DataFrame:
    """Graded fact rows that carry an accepted audit, with the newest audit's columns.

    The audit join comes before the dimension joins: it drops unverified rows while they are narrow.
    """
    graded = fact_rows(tables).filter(F.col("evidence_grade").isin("A", "B", "C"))
    return audit_left_join(graded, tables["curation_audit"]).filter(
        "audit_validation_status = 'curator_verified' AND curator_decision = 'accept'"
    )


def release_view(tables: Tables, ordered: bool = False) -> DataFrame:
    """Verified A/B/C evidence with molecule, modality, source and newest accepted audit.

    `ordered=True` adds the published order (domain descending, id); leave it off when the result feeds
    another operator.
    """
    view = (
        star_join(verified_facts(tables), tables)
        .withColumn("curation_basis", curation_basis("source_location"))
        .withColumn("raw_quote_included", F.lit("false"))
        .select(*RELEASE_COLUMNS)
    )
    return view.orderBy(F.desc("evidence_domain"), F.asc("evidence_id")) if ordered else view
