"""Queries: release view, joins between facts, audits and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import joins, release, windows
from attesta.plans.registry import query
from attesta.sources.adapters import evidence_tables, raw_table


@query("release_view", "SELECT * FROM release_view")
def _(spark, sf_dir):
    return release.release_view(evidence_tables(spark, sf_dir))


@query(
    "release_scope",
    """SELECT 'source' AS kind, id FROM (SELECT source_document_id AS id FROM toxicity_endpoint UNION
       SELECT source_document_id FROM offtarget_evidence)
       UNION ALL SELECT 'molecule', id FROM (SELECT molecule_id AS id FROM toxicity_endpoint UNION
       SELECT molecule_id FROM offtarget_evidence)
       UNION ALL SELECT 'assay', id FROM (SELECT assay_id AS id FROM toxicity_endpoint UNION
       SELECT assay_id FROM offtarget_evidence)""",
)
def _(spark, sf_dir):
    tables = evidence_tables(spark, sf_dir)
    parts = [release.release_scope(tables, k).select(F.lit(k).alias("kind"), "id") for k in ("source", "molecule", "assay")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("latest_accept_audit", "SELECT id, entity_table, entity_id, audited_at FROM latest_audit")
def _(spark, sf_dir):
    audit = evidence_tables(spark, sf_dir)["curation_audit"]
    return windows.latest_accept_audit(audit).select("id", "entity_table", "entity_id", "audited_at")


@query(
    "latest_status_by_curator",
    """SELECT entity_table, entity_id, validation_status, curator_decision, audited_at FROM (
         SELECT *, row_number() OVER (PARTITION BY entity_table, entity_id ORDER BY audited_at DESC, id) AS rn
         FROM curation_audit WHERE curator_id = 'curator1') WHERE rn = 1""",
)
def _(spark, sf_dir):
    return windows.latest_status_by_curator(evidence_tables(spark, sf_dir)["curation_audit"], "curator1")


@query(
    "curation_basis",
    """SELECT source_location, CASE WHEN regexp_matches(lower(source_location), 'paragraph|results|table|figure')
         THEN 'source-localized derived annotation' ELSE 'source-linked derived annotation' END AS curation_basis,
         count(*) AS n FROM evidence_rows GROUP BY ALL""",
)
def _(spark, sf_dir):
    facts = release.fact_rows(evidence_tables(spark, sf_dir))
    return facts.groupBy("source_location", release.curation_basis("source_location").alias("curation_basis")).agg(
        F.count("*").alias("n")
    )


@query("star_join", "SELECT entity_table, evidence_id, canonical_name, modality, pmid FROM evidence_star WHERE entity_table = 'toxicity_endpoint'")
def _(spark, sf_dir):
    tables = evidence_tables(spark, sf_dir)
    toxicity = release.fact_rows(tables).filter("entity_table = 'toxicity_endpoint'")
    return release.star_join(toxicity, tables).select("entity_table", "evidence_id", "canonical_name", "modality", "pmid")


@query(
    "evidence_tables",
    """SELECT entity_table, evidence_id, canonical_name, modality, category, evidence_label, evidence_grade,
       source_location, is_computational_prediction, source_title, pmid, doi, source_url FROM evidence_star""",
)
def _(spark, sf_dir):
    return release.evidence_tables(evidence_tables(spark, sf_dir)).select(
        "entity_table", "evidence_id", "canonical_name", "modality", "category", "evidence_label", "evidence_grade",
        "source_location", "is_computational_prediction", "source_title", "pmid", "doi", "source_url",
    )


@query(
    "audit_left_join",
    """SELECT e.entity_table, e.evidence_id, a.validation_status AS audit_validation_status, a.curator_decision,
       a.curator_id, a.audit_note, a.audited_at
       FROM evidence_rows e LEFT JOIN latest_audit a ON a.entity_table = e.entity_table AND a.entity_id = e.evidence_id""",
)
def _(spark, sf_dir):
    tables = evidence_tables(spark, sf_dir)
    return release.audit_left_join(release.fact_rows(tables).select("entity_table", "evidence_id"), tables["curation_audit"])


@query(
    "scope_semi",
    """SELECT id, canonical_name FROM molecule WHERE id IN (SELECT molecule_id FROM toxicity_endpoint UNION
       SELECT molecule_id FROM offtarget_evidence)""",
)
def _(spark, sf_dir):
    return release.in_scope(evidence_tables(spark, sf_dir), "molecule").select("id", "canonical_name")


@query(
    "human_verified_count",
    """SELECT (SELECT count(*) FROM toxicity_endpoint WHERE id IN (SELECT entity_id FROM curation_audit
         WHERE entity_table = 'toxicity_endpoint' AND validation_status = 'curator_verified' AND curator_decision = 'accept'))
       + (SELECT count(*) FROM offtarget_evidence WHERE id IN (SELECT entity_id FROM curation_audit
         WHERE entity_table = 'offtarget_evidence' AND validation_status = 'curator_verified' AND curator_decision = 'accept')) AS n""",
)
def _(spark, sf_dir):
    return joins.human_verified_count(evidence_tables(spark, sf_dir))


@query(
    "unaudited_anti",
    """SELECT entity_table, evidence_id FROM evidence_rows e WHERE NOT EXISTS (SELECT 1 FROM curation_audit a
       WHERE a.entity_table = e.entity_table AND a.entity_id = e.evidence_id
       AND a.validation_status = 'curator_verified' AND a.curator_decision = 'accept')""",
)
def _(spark, sf_dir):
    return joins.unaudited_anti(evidence_tables(spark, sf_dir)).select("entity_table", "evidence_id")


@query(
    "split_lookup",
    """SELECT b.task_name, b.split_name, b.entity_table, b.entity_id, r.evidence_domain, r.evidence_grade,
       r.canonical_name, r.modality, r.target_gene_symbol, r.disease_context, r.category, r.evidence_label,
       r.source_title, b.leakage_group, b.split_strategy, b.version, r.pmid AS source_pmid, r.doi AS source_doi
       FROM benchmark_split b JOIN release_view r ON r.entity_table = b.entity_table AND r.evidence_id = b.entity_id""",
)
def _(spark, sf_dir):
    tables = evidence_tables(spark, sf_dir)
    return joins.split_lookup(tables["benchmark_split"], release.release_view(tables))


@query(
    "polymorphic_left",
    """SELECT b.task_name, b.entity_table, b.entity_id, coalesce(t.evidence_grade, o.evidence_grade) AS evidence_grade,
       coalesce(t.source_document_id, o.source_document_id) AS source_document_id,
       coalesce(t.molecule_id, o.molecule_id) AS molecule_id
       FROM benchmark_split b
       LEFT JOIN toxicity_endpoint t ON b.entity_table = 'toxicity_endpoint' AND b.entity_id = t.id
       LEFT JOIN offtarget_evidence o ON b.entity_table = 'offtarget_evidence' AND b.entity_id = o.id""",
)
def _(spark, sf_dir):
    tables = evidence_tables(spark, sf_dir)
    return joins.polymorphic_left(tables["benchmark_split"], tables).select(
        "task_name", "entity_table", "entity_id", "evidence_grade", "source_document_id", "molecule_id"
    )


@query(
    "source_or_join",
    """WITH m AS (
         SELECT q.id AS queue_id, s.id AS matched_source_id FROM curation_queue q JOIN source_document s
           ON s.pmid = q.pmid AND q.pmid <> ''
         UNION ALL SELECT q.id, s.id FROM curation_queue q JOIN source_document s ON s.doi = q.doi AND q.doi <> ''
         UNION ALL SELECT q.id, s.id FROM curation_queue q JOIN source_document s
           ON s.source_url = 'https://example.org/doc/' || q.source_document_id)
       SELECT queue_id, min(matched_source_id) AS matched_source_id FROM m GROUP BY queue_id""",
)
def _(spark, sf_dir):
    tables = evidence_tables(spark, sf_dir)
    rows = tables["curation_queue"].select(
        F.col("id").alias("queue_id"), "pmid", "doi",
        F.concat(F.lit("https://example.org/doc/"), F.col("source_document_id").cast("string")).alias("source_url"),
    )
    return joins.source_or_join(rows, tables["source_document"], ["queue_id"]).select("queue_id", "matched_source_id")


@query(
    "override_lookup",
    """WITH rv AS (SELECT 'toxicity_endpoint' AS entity_table, t.id AS entity_id, s.pmid,
                  CASE WHEN l.quality = 1 THEN 'accept' ELSE 'reject' END AS final_decision
                FROM toxicity_endpoint t JOIN labels l ON l.doc_id = t.source_document_id
                JOIN source_document s ON s.id = t.source_document_id),
       st AS (SELECT entity_table, entity_id, curator_decision, audited_at FROM (
                SELECT *, row_number() OVER (PARTITION BY entity_table, entity_id ORDER BY audited_at DESC, id) AS rn
                FROM curation_audit WHERE curator_id = 'curator1') WHERE rn = 1),
       d AS (SELECT pmid, doi FROM (SELECT pmid, doi, row_number() OVER (PARTITION BY pmid ORDER BY id) AS rn
                FROM source_document WHERE coalesce(pmid, '') <> '' AND coalesce(doi, '') <> '') WHERE rn = 1)
       SELECT rv.entity_table, rv.entity_id, rv.final_decision, coalesce(st.curator_decision, '') AS curator_status,
              coalesce(d.doi, '') AS doi, e.evidence_id IS NOT NULL AS is_live, coalesce(e.evidence_grade, '') AS evidence_grade
       FROM rv LEFT JOIN evidence_rows e ON e.entity_table = rv.entity_table AND e.evidence_id = rv.entity_id
       LEFT JOIN st ON st.entity_table = rv.entity_table AND st.entity_id = rv.entity_id
       LEFT JOIN d ON d.pmid = rv.pmid""",
)
def _(spark, sf_dir):
    tables = evidence_tables(spark, sf_dir)
    labels = raw_table(spark, sf_dir, "labels")
    source = tables["source_document"].select(F.col("id").alias("source_document_id"), "pmid")
    reviews = (
        tables["toxicity_endpoint"]
        .join(labels.withColumnRenamed("doc_id", "source_document_id"), "source_document_id")
        .join(source, "source_document_id")
        .select(
            F.lit("toxicity_endpoint").alias("entity_table"), F.col("id").alias("entity_id"), "pmid",
            F.when(F.col("quality") == 1, "accept").otherwise("reject").alias("final_decision"),
        )
    )
    return joins.override_lookup(reviews, tables, "curator1").select(
        "entity_table", "entity_id", "final_decision", "curator_status", "doi", "is_live", "evidence_grade"
    )


@query(
    "dictionary_anti",
    "SELECT pmid FROM (SELECT DISTINCT pmid FROM curation_queue WHERE coalesce(pmid, '') <> '') WHERE pmid NOT IN (SELECT pmid FROM source_document WHERE pmid IS NOT NULL AND publication_year > 2018)",
)
def _(spark, sf_dir):
    tables = evidence_tables(spark, sf_dir)
    known = tables["source_document"].filter("publication_year > 2018")
    return joins.dictionary_anti(tables["curation_queue"].select("pmid").distinct(), known, "pmid")
