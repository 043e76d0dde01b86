"""Joins between facts, audits, splits, sources and reviews; set operations on keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import has_text, null_if_blank, text_or_empty
from attesta.operators.release import Tables, fact_rows
from attesta.operators.windows import first_occurrence, latest_status_by_curator

VERIFIED_ACCEPT = "validation_status = 'curator_verified' AND curator_decision = 'accept'"


def accepted_keys(audit: DataFrame) -> DataFrame:
    return audit.filter(VERIFIED_ACCEPT).select("entity_table", F.col("entity_id").alias("evidence_id"))


def human_verified_count(tables: Tables) -> DataFrame:
    """Number of release rows, over both facts, that carry a verified accept."""
    keys = accepted_keys(tables["curation_audit"])
    rows = fact_rows(tables).join(keys, ["entity_table", "evidence_id"], "left_semi")
    return rows.agg(F.count("*").alias("n"))


def unaudited_anti(tables: Tables) -> DataFrame:
    """Evidence rows without a verified accept."""
    return fact_rows(tables).join(accepted_keys(tables["curation_audit"]), ["entity_table", "evidence_id"], "left_anti")


def split_lookup(splits: DataFrame, view: DataFrame) -> DataFrame:
    """Split rows enriched from the release view; rows that are not released are dropped."""
    keys = splits.select(
        "task_name", "split_name", "entity_table", "entity_id", "leakage_group", "split_strategy", "version"
    )
    record = view.select(
        "entity_table",
        F.col("evidence_id").alias("entity_id"),
        "evidence_domain",
        "evidence_grade",
        "canonical_name",
        "modality",
        "target_gene_symbol",
        "disease_context",
        "category",
        "evidence_label",
        "source_title",
        F.col("pmid").alias("source_pmid"),
        F.col("doi").alias("source_doi"),
    )
    return keys.join(record, ["entity_table", "entity_id"])


def polymorphic_left(splits: DataFrame, tables: Tables) -> DataFrame:
    """Rows with an (entity_table, entity_id) key, left joined to whichever fact it names.

    One join on the composite key to the union of the facts replaces two half joins.
    """
    facts = fact_rows(tables).withColumnRenamed("evidence_id", "entity_id")
    return splits.join(facts, ["entity_table", "entity_id"], "left")


def source_or_join(rows: DataFrame, sources: DataFrame, row_key: list[str]) -> DataFrame:
    """First source (by id) that shares the pmid, the doi or the url with a row.

    Three equi joins are united and reduced by min(id): no OR join, so no nested loop. Each branch
    reduces the sources per identifier first, so a repeated identifier does not multiply the rows.
    """

    def branch(identifier: str) -> DataFrame:
        known = (
            sources.filter(has_text(identifier)).groupBy(F.col(identifier).alias("_value")).agg(F.min("id").alias("_source"))
        )
        wanted = rows.filter(has_text(identifier)).select(*row_key, F.col(identifier).alias("_value"))
        return wanted.join(known, "_value").select(*row_key, "_source")

    matches = reduce(DataFrame.unionByName, [branch(i) for i in ("pmid", "doi", "source_url")])
    return matches.groupBy(*row_key).agg(F.min("_source").alias("matched_source_id"))


def dictionary_anti(new: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """New non-blank keys that no known table holds."""
    return new.filter(has_text(key)).join(known.filter(has_text(key)).select(key), key, "left_anti")


def override_lookup(reviews: DataFrame, tables: Tables, curator_id: str) -> DataFrame:
    """Reviewed rows with the live entity, one curator's newest status, and the first DOI of their pmid."""
    live = fact_rows(tables).select(
        "entity_table",
        F.col("evidence_id").alias("entity_id"),
        "evidence_grade",
        F.col("source_location").alias("live_location"),
        "is_observed_experimental",
        F.when(F.col("entity_table") == "offtarget_evidence", F.col("is_computational_prediction")).alias("is_computational_prediction"),
        F.lit(True).alias("is_live"),
    )
    status = latest_status_by_curator(tables["curation_audit"], curator_id).select(
        "entity_table", "entity_id", F.col("validation_status").alias("current_status"), F.col("curator_decision").alias("curator_status")
    )
    dois = first_occurrence(tables["source_document"].filter(has_text("pmid") & has_text("doi")), "pmid", [F.asc("id")])
    joined = (
        reviews.join(live, ["entity_table", "entity_id"], "left")
        .join(status, ["entity_table", "entity_id"], "left")
        .join(dois.select("pmid", F.col("doi").alias("_doi")), "pmid", "left")
    )
    own = null_if_blank("doi") if "doi" in reviews.columns else F.lit(None).cast("string")
    return joined.withColumns(
        {
            "is_live": F.coalesce("is_live", F.lit(False)),
            "curator_status": text_or_empty("curator_status"),
            "current_status": text_or_empty("current_status"),
            "evidence_grade": text_or_empty("evidence_grade"),
            "doi": F.coalesce(own, "_doi", F.lit("")),
        }
    ).drop("_doi")


def override_table(reviews: DataFrame, tables: Tables, curator_id: str) -> DataFrame:
    """Reproducibility table of human decisions against the live release.

    `reviews` has entity_table, entity_id, pmid, final_decision and, optionally, doi and claimed_location;
    the live location wins over the claimed one.
    """
    looked_up = override_lookup(reviews, tables, curator_id)
    claimed = text_or_empty("claimed_location") if "claimed_location" in reviews.columns else F.lit("")
    return looked_up.select(
        F.concat_ws(":", "entity_table", F.col("entity_id").cast("string")).alias("candidate_id"),
        "entity_table",
        "entity_id",
        "pmid",
        "doi",
        F.coalesce(null_if_blank("live_location"), claimed).alias("source_location"),
        "final_decision",
        "is_observed_experimental",
        "is_computational_prediction",
        F.col("current_status").alias("current_validation_status"),
        F.lit(curator_id).alias("curator_id"),
    )


def union_distinct(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, frames).distinct()


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def difference(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    return a.join(b.select(*key), key, "left_anti")


def intersection(df: DataFrame, by: list[str], column: str, values: list[str]) -> DataFrame:
    """Per group, whether any row has one of the values."""
    return df.groupBy(*by).agg(F.max(F.when(F.col(column).isin(values), 1).otherwise(0)).alias("meets"))


def rank_sort(df: DataFrame, column: str, ranks: dict[str, int], tie: list[Column], otherwise: int = 2) -> DataFrame:
    from attesta.functions.text import rank_of

    return df.orderBy(rank_of(column, ranks, otherwise), *tie)


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)
