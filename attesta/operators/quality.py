"""Data-quality checks: each yields (check, violations, status)."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import contains_ci, has_text, text_or_empty
from attesta.operators.joins import accepted_keys, unaudited_anti
from attesta.operators.release import Tables, fact_rows
from attesta.operators.stats import duplicate_keys
from attesta.sources.schema import FACTS

# Statuses that may not be accepted, the disabled extraction method (also part of its script name),
# and the modality kept out of scope.
UNPROVEN = ["needs_full_text_check", "unverified", "curator_verified_abstract_level"]
DISABLED_METHOD = "curator_batch1"
OUT_OF_SCOPE_MODALITY = "crispr"
REDISTRIBUTABLE = "derived_annotations_only"
# Smallest table sizes of a complete curation database.
MINIMUM_ROWS = {"source_document": 30000, "curation_queue": 36000, "curation_candidate": 10000}
# Fixed values: (child table, column, parent table) of the foreign keys.
FOREIGN_KEYS = [
    ("molecule", "modality_id", "modality"),
    ("toxicity_endpoint", "molecule_id", "molecule"),
    ("toxicity_endpoint", "source_document_id", "source_document"),
    ("toxicity_endpoint", "assay_id", "assay"),
    ("offtarget_evidence", "molecule_id", "molecule"),
    ("offtarget_evidence", "source_document_id", "source_document"),
    ("offtarget_evidence", "assay_id", "assay"),
    ("curation_queue", "source_document_id", "source_document"),
    ("curation_candidate", "queue_id", "curation_queue"),
    ("curation_candidate", "source_document_id", "source_document"),
]


def _count(check: str, df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("violations")).select(F.lit(check).alias("check"), "violations")


def _sums(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Several checks on one table in one pass."""
    wide = df.agg(*[F.count(F.when(c, 1)).alias(k) for k, c in checks.items()])
    return wide.unpivot([], list(checks), "check", "violations")


def _orphans(tables: Tables, child: str, column: str, parent: str) -> DataFrame:
    keys = tables[child].select(F.col(column).alias("_k")).filter("_k IS NOT NULL")
    return keys.join(tables[parent].select(F.col("id").alias("_k")), "_k", "left_anti")


def dq_report(tables: Tables, minimum: Mapping[str, int] = MINIMUM_ROWS, exact: Mapping[str, int] | None = None) -> DataFrame:
    """All invariants of the curation database; status is pass when there is no violation."""
    facts = fact_rows(tables)
    parts: list[DataFrame] = []
    for name, least in minimum.items():
        short = tables[name].agg(F.greatest(F.lit(least) - F.count("*"), F.lit(0)).alias("violations"))
        parts.append(short.select(F.lit(f"minimum_rows:{name}").alias("check"), "violations"))
    for name, wanted in (exact or {}).items():
        off = tables[name].agg(F.abs(F.lit(wanted) - F.count("*")).alias("violations"))
        parts.append(off.select(F.lit(f"exact_rows:{name}").alias("check"), "violations"))
    parts.append(_count("release_without_accept", unaudited_anti(tables)))
    parts.append(
        _sums(facts, {"bad_grade_or_location": ~F.coalesce(F.col("evidence_grade").isin("A", "B", "C"), F.lit(False)) | ~has_text("source_location")})
    )
    graded = facts.filter("evidence_grade IN ('A', 'B')").select("entity_table", F.col("evidence_id").alias("entity_id"))
    parts.append(_count("split_not_grade_ab", tables["benchmark_split"].join(graded, ["entity_table", "entity_id"], "left_anti")))
    parts.append(_count("duplicate_pmid", duplicate_keys(tables["source_document"], ["pmid"])))
    parts.append(_count("duplicate_modality_name", duplicate_keys(tables["modality"], ["name"])))
    for child, column, parent in FOREIGN_KEYS:
        parts.append(_count(f"orphan:{child}.{column}", _orphans(tables, child, column, parent)))
    for name in ("source_document", "molecule", *FACTS, "curation_audit"):
        parts.append(_count(f"duplicate_id:{name}", duplicate_keys(tables[name], ["id"])))
    parts.append(_sums(tables["curation_candidate"], {"forbidden_redistribution": text_or_empty("redistribution_level") != REDISTRIBUTABLE}))
    named = tables["modality"].filter(contains_ci("name", OUT_OF_SCOPE_MODALITY))
    parts.append(_count("forbidden_modality_in_scope", named.filter("in_core_scope = 1")))
    parts.append(_count("forbidden_modality_molecules", tables["molecule"].join(named.select(F.col("id").alias("modality_id")), "modality_id", "left_semi")))
    accepted = F.col("curator_decision") == "accept"
    parts.append(
        _sums(
            tables["curation_audit"],
            {
                "unproven_accept": F.col("validation_status").isin(UNPROVEN) & accepted,
                "disabled_script": contains_ci("extractor_model_or_script", DISABLED_METHOD) | contains_ci("extraction_method", DISABLED_METHOD),
            },
        )
    )
    return with_status(reduce(DataFrame.unionByName, parts))


def with_status(checks: DataFrame) -> DataFrame:
    return checks.select("check", "violations", F.when(F.col("violations") == 0, "pass").otherwise("fail").alias("status"))


def packet_report(packet: DataFrame, tables: Tables, minimum: int = 3000, minimum_offtarget: int = 500) -> DataFrame:
    """Invariants of a mined review packet and of the audits behind the release."""
    place = has_text("source_location") if "proposed_source_location" not in packet.columns else has_text("source_location") | has_text("proposed_source_location")
    offtarget = F.count(F.when(F.col("evidence_domain") == "offtarget", 1))
    checks = {
        "packet_minimum_rows": F.greatest(F.lit(minimum) - F.count("*"), F.lit(0)),
        "packet_duplicate_ids": F.count("*") - F.countDistinct("candidate_id"),
        "packet_pre_accepted": F.count(F.when(F.col("curator_decision") == "accept", 1)),
        "packet_pre_verified": F.count(F.when(F.col("validation_status") == "curator_verified", 1)),
        "packet_wrong_domain": F.count(F.when(~F.col("evidence_domain").isin("toxicity", "offtarget"), 1)),
        "packet_no_identifier_or_location": F.count(F.when(~((has_text("pmid") | has_text("doi")) & place), 1)),
        "packet_offtarget_minimum": F.greatest(F.lit(minimum_offtarget) - offtarget, F.lit(0)),
    }
    wide = packet.agg(*[c.cast("bigint").alias(k) for k, c in checks.items()]).unpivot([], list(checks), "check", "violations")
    audits = accepted_keys(tables["curation_audit"]).filter(F.col("entity_table").isin(FACTS)).agg(F.count("*").alias("_n"))
    gap = fact_rows(tables).agg(F.abs(F.count("*") - audits.scalar()).alias("violations"))
    return with_status(wide.unionByName(gap.select(F.lit("audits_equal_release_rows").alias("check"), "violations")))


def export_agreement(counts: Mapping[str, DataFrame]) -> DataFrame:
    """Row counts of several published forms of one table, and whether each agrees with the first."""
    names = list(counts)
    rows = [counts[n].agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("form"), "n_rows") for n in names]
    first = counts[names[0]].agg(F.count("*")).scalar()
    return reduce(DataFrame.unionByName, rows).withColumn("agrees", F.col("n_rows") == first)
