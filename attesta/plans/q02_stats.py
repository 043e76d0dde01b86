"""Queries: counts, facets, coverage, completeness and policy tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.lexicons import Term
from attesta.operators import joins, release, stats
from attesta.plans.registry import query
from attesta.sources.adapters import evidence_tables, raw_table

SCOPE = """src AS (SELECT * FROM source_document WHERE id IN (SELECT source_document_id FROM evidence_rows)),
  mol AS (SELECT * FROM molecule WHERE id IN (SELECT molecule_id FROM evidence_rows)),
  aud AS (SELECT a.* FROM latest_audit a WHERE EXISTS (SELECT 1 FROM evidence_rows e
           WHERE e.entity_table = a.entity_table AND e.evidence_id = a.entity_id))"""

# Test vocabularies: words of the test prose and names, so that the counts are not empty.
TEST_MODIFICATIONS = [
    Term("economy", "Economy line", ("economy", "promo"), "line"),
    Term("lnp", "Carrier", ("lnp carrier",), "delivery"),
    Term("sirna", "siRNA", ("sirna", "brand#1"), "modality"),
    Term("tion", "Ending", ("thtion", "attion", "ertion"), "text"),
    Term("none", "Never found", ("zzzzzz",), "text"),
]
TEST_CLASSES = [
    Term("ot0", "Type 0", ("ot0", "widget")),
    Term("prose", "Prose", ("thtion", "attion", "hely")),
    Term("asia", "Region", ("asia", "europe", "aso")),
    Term("general", "Other", ("unused",)),
]


def any_of(text: str, terms: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{t}')" for t in terms) + ")"


def blob(cols: list[str]) -> str:
    return "lower(concat_ws(' ', " + ", ".join(f"coalesce({c}, '')" for c in cols) + "))"


@query(
    "release_stats",
    f"""WITH {SCOPE}
    SELECT 'counts' AS section, 'source_document' AS label, count(*) AS n FROM src
    UNION ALL SELECT 'counts', 'modality', count(DISTINCT modality_id) FROM mol
    UNION ALL SELECT 'counts', 'molecule', count(*) FROM mol
    UNION ALL SELECT 'counts', 'toxicity_endpoint', count(*) FROM toxicity_endpoint
    UNION ALL SELECT 'counts', 'offtarget_evidence', count(*) FROM offtarget_evidence
    UNION ALL SELECT 'counts', 'curation_audit', count(*) FROM aud
    UNION ALL SELECT 'counts', 'benchmark_split', count(*) FROM benchmark_split
    UNION ALL SELECT 'evidence_grades', evidence_grade, count(*) FROM evidence_rows GROUP BY evidence_grade""",
)
def _(spark, sf_dir):
    return stats.release_stats(evidence_tables(spark, sf_dir))


@query(
    "summary_counts",
    f"""WITH {SCOPE}
    SELECT 'modality' AS section, name AS label, count(*) AS n FROM mol JOIN modality mo ON mo.id = modality_id GROUP BY name
    UNION ALL SELECT 'sources_by_type', source_type, count(*) FROM src GROUP BY source_type
    UNION ALL (SELECT 'sources_by_year', coalesce(CAST(publication_year AS VARCHAR), 'unknown'), count(*) FROM src
      GROUP BY publication_year ORDER BY publication_year DESC NULLS LAST LIMIT 10)
    UNION ALL (SELECT 'toxicity_by_category', endpoint_category, count(*) AS n FROM toxicity_endpoint
      GROUP BY endpoint_category ORDER BY n DESC, endpoint_category LIMIT 12)
    UNION ALL (SELECT 'offtarget_by_type', evidence_type, count(*) AS n FROM offtarget_evidence
      GROUP BY evidence_type ORDER BY n DESC, evidence_type LIMIT 12)""",
)
def _(spark, sf_dir):
    return stats.summary_counts(evidence_tables(spark, sf_dir))


@query(
    "facets",
    f"""WITH {SCOPE}
    SELECT 'modalities' AS facet, name AS value, name AS label, CAST(NULL AS BIGINT) AS n FROM
      (SELECT DISTINCT mo.name FROM mol JOIN modality mo ON mo.id = modality_id)
    UNION ALL SELECT 'source_types', source_type, source_type, count(*) FROM src GROUP BY source_type
    UNION ALL SELECT 'source_years', CAST(publication_year AS VARCHAR), CAST(publication_year AS VARCHAR), count(*)
      FROM src WHERE publication_year IS NOT NULL GROUP BY publication_year
    UNION ALL SELECT 'evidence_grades', evidence_grade, evidence_grade, count(*) FROM evidence_rows GROUP BY evidence_grade
    UNION ALL SELECT 'toxicity_categories', endpoint_category, endpoint_category, count(*) FROM toxicity_endpoint GROUP BY endpoint_category
    UNION ALL SELECT 'evidence_categories', category, category, count(*) FROM evidence_rows GROUP BY category
    UNION ALL SELECT 'audit_statuses', validation_status, validation_status, count(*) FROM aud GROUP BY validation_status
    UNION ALL (SELECT 'targets', target_gene_symbol, target_gene_symbol, count(*) AS n FROM mol
      WHERE coalesce(target_gene_symbol, '') <> '' GROUP BY target_gene_symbol ORDER BY n DESC, target_gene_symbol LIMIT 200)
    UNION ALL SELECT 'modification_terms', value, label, NULL FROM (VALUES {", ".join(f"('{t.key}', '{t.label}')" for t in TEST_MODIFICATIONS)}) v(value, label)""",
)
def _(spark, sf_dir):
    return stats.facets(evidence_tables(spark, sf_dir), TEST_MODIFICATIONS)


@query(
    "coverage",
    f"""WITH {SCOPE}
    (SELECT 'source_years' AS section, coalesce(CAST(publication_year AS VARCHAR), 'unknown') AS label, '' AS sublabel, count(*) AS n
      FROM src GROUP BY publication_year ORDER BY publication_year DESC NULLS LAST LIMIT 16)
    UNION ALL (SELECT 'top_journals', coalesce(journal_or_agency, 'unknown') AS j, '', count(*) AS n FROM src
      GROUP BY journal_or_agency ORDER BY n DESC, j LIMIT 16)
    UNION ALL SELECT 'release_grade_domain', evidence_domain, evidence_grade, count(*) FROM evidence_rows GROUP BY evidence_domain, evidence_grade
    UNION ALL SELECT 'release_modality', mo.name, '', count(DISTINCT mol.id) FROM mol JOIN modality mo ON mo.id = modality_id GROUP BY mo.name""",
)
def _(spark, sf_dir):
    return stats.coverage(evidence_tables(spark, sf_dir))


PROTOCOL_SQL = f"""WITH {SCOPE}, f AS (SELECT e.source_location, s.pmid, s.doi, m.* FROM evidence_rows e
      LEFT JOIN source_document s ON s.id = e.source_document_id LEFT JOIN molecule m ON m.id = e.molecule_id)
    SELECT 'release' AS section, 'with_source_location' AS label, count(*) FILTER (coalesce(source_location, '') <> '') AS n FROM f
    UNION ALL SELECT 'release', 'with_pmid', count(*) FILTER (coalesce(pmid, '') <> '') FROM f
    UNION ALL SELECT 'release', 'with_doi', count(*) FILTER (coalesce(doi, '') <> '') FROM f
    UNION ALL SELECT 'release', 'with_any_sequence', count(*) FILTER (coalesce(nullif(sense_sequence, ''),
      nullif(antisense_sequence, ''), nullif(guide_sequence, ''), nullif(passenger_sequence, ''), nullif(seed_region, '')) IS NOT NULL) FROM f
    UNION ALL SELECT 'release', 'with_any_chemistry', count(*) FILTER (coalesce(nullif(backbone_chemistry, ''),
      nullif(sugar_modification, ''), nullif(base_modification, ''), nullif(conjugate_delivery, '')) IS NOT NULL) FROM f
    UNION ALL SELECT 'sources', 'source_documents', count(*) FROM src
    UNION ALL SELECT 'sources', 'with_pmid', count(*) FILTER (coalesce(pmid, '') <> '') FROM src
    UNION ALL SELECT 'sources', 'with_doi', count(*) FILTER (coalesce(doi, '') <> '') FROM src
    UNION ALL SELECT 'sources', 'with_pmcid', count(*) FILTER (coalesce(pmcid, '') <> '') FROM src
    UNION ALL SELECT 'release_audit_by_domain', entity_table || '|' || evidence_grade, count(*) FROM evidence_rows GROUP BY ALL
    UNION ALL (SELECT 'source_license', license_status || '|' || reuse_category AS l, count(*) AS n FROM src GROUP BY l ORDER BY n DESC, l LIMIT 12)
    UNION ALL (SELECT 'audit_methods', extraction_method || '|' || extractor_model_or_script || '|' || validation_status || '|' || curator_decision AS l,
      count(*) AS n FROM aud GROUP BY l ORDER BY n DESC, l LIMIT 12)"""


@query("protocol_counts", PROTOCOL_SQL)
def _(spark, sf_dir):
    return stats.protocol_counts(evidence_tables(spark, sf_dir))


@query(
    "quality_gates",
    f"""WITH {SCOPE}, c AS (SELECT (SELECT count(*) FROM evidence_rows) AS r, (SELECT count(*) FROM aud) AS v,
      (SELECT count(*) FROM benchmark_split) AS b, (SELECT count(*) FROM src) AS s)
    SELECT 'human_verified_release' AS gate, v AS value, r AS expected,
      CASE WHEN v >= 600 AND v = r THEN 'pass' ELSE 'review' END AS status FROM c
    UNION ALL SELECT 'minimum_release_size', r, 600, CASE WHEN r >= 600 THEN 'pass' ELSE 'review' END FROM c
    UNION ALL SELECT 'primary_study_scope', s, 1, CASE WHEN s >= 1 THEN 'pass' ELSE 'review' END FROM c
    UNION ALL SELECT 'benchmark_reuse', b, 1, CASE WHEN b > 0 THEN 'pass' ELSE 'review' END FROM c""",
)
def _(spark, sf_dir):
    return stats.quality_gates(evidence_tables(spark, sf_dir))


def _completeness_sql() -> str:
    def filled(c: str) -> str:
        return f"(trim(coalesce({c}, '')) NOT IN ('', 'NA', 'N/A', 'nan', 'None'))"

    parts = []
    for field, group, strict in stats.COMPLETENESS_FIELDS:
        hi, lo = (95, 80) if strict else (70, 25)
        parts.append(
            f"SELECT '{field}' AS field, '{group}' AS field_group, count(*) FILTER {filled(field)} AS filled, count(*) AS total, "
            f"{hi} AS hi, {lo} AS lo FROM release_view"
        )
    strict_sum = " + ".join(f"count(*) FILTER {filled(f)}" for f, _, s in stats.COMPLETENESS_FIELDS if s)
    strict_n = sum(1 for _, _, s in stats.COMPLETENESS_FIELDS if s)
    seq = " OR ".join(filled(c) for c in stats.SEQUENCE_FIELDS)
    chem = " OR ".join(filled(c) for c in stats.CHEMISTRY_FIELDS)
    return (
        "WITH p AS (" + " UNION ALL ".join(parts) + ") SELECT field, field_group, filled, total, "
        "filled::DOUBLE / greatest(total, 1) * 100 AS completeness_pct, CASE WHEN filled::DOUBLE / greatest(total, 1) * 100 >= hi THEN 'pass' "
        "WHEN filled::DOUBLE / greatest(total, 1) * 100 >= lo THEN 'partial' ELSE 'gap' END AS status FROM p "
        f"UNION ALL SELECT 'any_sequence', 'summary', count(*) FILTER ({seq}), count(*), (count(*) FILTER ({seq}))::DOUBLE / greatest(count(*), 1) * 100, '' FROM release_view "
        f"UNION ALL SELECT 'any_chemistry', 'summary', count(*) FILTER ({chem}), count(*), (count(*) FILTER ({chem}))::DOUBLE / greatest(count(*), 1) * 100, '' FROM release_view "
        f"UNION ALL SELECT 'strict_mean', 'summary', {strict_sum}, count(*), (({strict_sum}) / {strict_n}.0::DOUBLE) / greatest(count(*), 1) * 100, '' FROM release_view"
    )


@query("field_completeness", _completeness_sql())
def _(spark, sf_dir):
    return stats.field_completeness(release.release_view(evidence_tables(spark, sf_dir)))


_SEQ = "(coalesce(nullif(sense_sequence, ''), nullif(antisense_sequence, ''), nullif(guide_sequence, ''), nullif(passenger_sequence, ''), nullif(seed_region, '')) IS NOT NULL)"
_CHEM = "(coalesce(nullif(backbone_chemistry, ''), nullif(sugar_modification, ''), nullif(base_modification, ''), nullif(conjugate_delivery, '')) IS NOT NULL)"
_COVER = f"""count(*) AS molecules, count(*) FILTER {_SEQ} AS sequence_nonempty,
  count(*) FILTER ({_SEQ} AND sequence_annotation_status = 'curator_verified') AS sequence_verified,
  count(*) FILTER {_CHEM} AS modification_nonempty,
  count(*) FILTER ({_CHEM} AND modification_annotation_status = 'curator_verified') AS modification_verified,
  greatest(count(*) - count(*) FILTER ({_SEQ} AND sequence_annotation_status = 'curator_verified'), 0) AS needs_sequence,
  greatest(count(*) - count(*) FILTER ({_CHEM} AND modification_annotation_status = 'curator_verified'), 0) AS needs_modification"""


@query(
    "sequence_coverage",
    f"""SELECT 'all' AS modality, {_COVER} FROM molecule
    UNION ALL SELECT mo.name, {_COVER} FROM molecule m JOIN modality mo ON mo.id = m.modality_id GROUP BY mo.name""",
)
def _(spark, sf_dir):
    return stats.sequence_coverage(evidence_tables(spark, sf_dir))


_RB = "r.entity_table = b.entity_table AND r.evidence_id = b.entity_id"
_CAND = "(SELECT c.*, s.title AS source_title FROM curation_candidate c JOIN source_document s ON s.id = c.source_document_id)"


def _profile_sql() -> str:
    rel = blob(stats.PROFILE_RELEASE_FIELDS)
    cand = blob(stats.PROFILE_CANDIDATE_FIELDS)
    parts = []
    for t in TEST_MODIFICATIONS:
        parts.append(
            f"""SELECT '{t.key}' AS term, '{t.label}' AS label, '{t.kind}' AS kind, count(*) AS release_records,
            count(*) FILTER (in_b) AS benchmark_records,
            count(*) FILTER (evidence_domain = 'toxicity') AS toxicity_records,
            count(*) FILTER (evidence_domain = 'offtarget') AS offtarget_records,
            count(*) FILTER (evidence_grade = 'A') AS grade_a, count(*) FILTER (evidence_grade = 'B') AS grade_b,
            count(*) FILTER (evidence_grade = 'C') AS grade_c,
            (SELECT count(*) FROM cb WHERE {any_of("t", t.synonyms)}) AS candidate_records
            FROM rb WHERE {any_of("t", t.synonyms)}"""
        )
    return f"""WITH rb AS (SELECT r.evidence_domain, r.evidence_grade, {rel} AS t,
        EXISTS (SELECT 1 FROM benchmark_split b WHERE {_RB}) AS in_b FROM release_view r),
      cb AS (SELECT {cand} AS t FROM {_CAND} WHERE evidence_domain IN ('toxicity', 'offtarget', 'chemistry', 'delivery'))
      {" UNION ALL ".join(parts)}"""


@query("modification_profile", _profile_sql())
def _(spark, sf_dir):
    tables = evidence_tables(spark, sf_dir)
    candidates = stats.candidate_rows(tables["curation_candidate"], tables["source_document"])
    return stats.modification_profile(release.release_view(tables), candidates, tables["benchmark_split"], TEST_MODIFICATIONS)


@query(
    "modification_examples",
    "WITH x AS (" + " UNION ALL ".join(
        f"SELECT '{t.key}' AS term, * FROM release_view WHERE {any_of(blob(stats.PROFILE_RELEASE_FIELDS), t.synonyms)}"
        for t in TEST_MODIFICATIONS
    ) + """) SELECT term, evidence_domain, entity_table, evidence_id, canonical_name, evidence_grade, position FROM (
      SELECT *, row_number() OVER (PARTITION BY term ORDER BY evidence_domain DESC, evidence_id) AS position FROM x)
      WHERE position <= 8""",
)
def _(spark, sf_dir):
    return stats.modification_examples(release.release_view(evidence_tables(spark, sf_dir)), TEST_MODIFICATIONS)


def _class_case(text: str) -> str:
    whens = " ".join(f"WHEN {any_of(text, c.synonyms)} THEN '{c.key}'" for c in TEST_CLASSES)
    return f"CASE {whens} ELSE '{TEST_CLASSES[-1].key}' END"


@query(
    "offtarget_taxonomy",
    f"""WITH rb AS (SELECT {_class_case(blob(stats.CLASS_RELEASE_FIELDS))} AS k, evidence_grade,
        EXISTS (SELECT 1 FROM benchmark_split b WHERE {_RB}) AS in_b FROM release_view r WHERE evidence_domain = 'offtarget'),
      cb AS (SELECT {_class_case(blob(stats.PROFILE_CANDIDATE_FIELDS))} AS k FROM {_CAND} WHERE evidence_domain = 'offtarget'),
      v AS (SELECT * FROM (VALUES {", ".join(f"('{c.key}', '{c.label}')" for c in TEST_CLASSES)}) v(class_key, label))
    SELECT class_key, label, (SELECT count(*) FROM rb WHERE k = class_key) AS release_records,
      (SELECT count(*) FROM rb WHERE k = class_key AND in_b) AS benchmark_records,
      (SELECT count(*) FROM rb WHERE k = class_key AND evidence_grade = 'A') AS grade_a,
      (SELECT count(*) FROM rb WHERE k = class_key AND evidence_grade = 'B') AS grade_b,
      (SELECT count(*) FROM rb WHERE k = class_key AND evidence_grade = 'C') AS grade_c,
      (SELECT count(*) FROM cb WHERE k = class_key) AS candidate_records FROM v""",
)
def _(spark, sf_dir):
    tables = evidence_tables(spark, sf_dir)
    candidates = stats.candidate_rows(tables["curation_candidate"], tables["source_document"])
    return stats.offtarget_taxonomy(release.release_view(tables), candidates, tables["benchmark_split"], TEST_CLASSES)


@query(
    "offtarget_examples",
    f"""SELECT class_key, entity_table, evidence_id, canonical_name, evidence_label, evidence_grade, pmid, position FROM (
      SELECT *, row_number() OVER (PARTITION BY class_key ORDER BY evidence_id) AS position FROM (
        SELECT *, {_class_case(blob(stats.CLASS_RELEASE_FIELDS))} AS class_key FROM release_view WHERE evidence_domain = 'offtarget'))
      WHERE position <= 4""",
)
def _(spark, sf_dir):
    return stats.offtarget_examples(release.release_view(evidence_tables(spark, sf_dir)), TEST_CLASSES)


@query(
    "task_cards",
    """SELECT task_name, count(*) FILTER (split_name = 'train') AS train_rows,
      count(*) FILTER (split_name = 'validation') AS validation_rows, count(*) FILTER (split_name = 'test') AS test_rows,
      count(*) FILTER (e.evidence_grade = 'A') AS grade_a_rows, count(*) FILTER (e.evidence_grade = 'B') AS grade_b_rows
      FROM benchmark_split b LEFT JOIN evidence_rows e ON e.entity_table = b.entity_table AND e.evidence_id = b.entity_id
      GROUP BY task_name""",
)
def _(spark, sf_dir):
    return stats.task_cards(evidence_tables(spark, sf_dir))


LICENSE_SQL = """SELECT s.id AS source_document_id, source_type, pmid, pmcid, doi, source_url, journal_or_agency, publication_year,
      license_status, reuse_category, coalesce(r.n, 0) AS release_evidence_rows, coalesce(c.n, 0) AS candidate_rows,
      coalesce(nullif(license_status, ''), 'not_recorded') AS article_license,
      CASE WHEN pmcid <> '' AND license_status IN ('open_access', 'official_guideline', 'official_notice')
           THEN 'open_or_official_source_recorded' WHEN pmcid <> '' THEN 'pmcid_present_license_not_verified'
           ELSE 'not_applicable' END AS oa_subset_status,
      CASE WHEN reuse_category = 'query_linkout_only' THEN 'false' WHEN license_status = 'open_access' THEN 'not_claimed'
           ELSE 'false' END AS raw_redistribution_allowed,
      CASE WHEN reuse_category = 'query_linkout_only' THEN 'external_linkout_only' ELSE 'true' END AS derived_annotation_allowed,
      'unknown' AS commercial_reuse_allowed,
      CASE WHEN reuse_category = 'query_linkout_only' THEN 'restricted_linkout' WHEN license_status = 'open_access'
           THEN 'source_class_reviewed' ELSE 'conservative_source_metadata_review' END AS license_review_status,
      source_type IN ('regulatory', 'official') AS is_official_source
      FROM source_document s
      LEFT JOIN (SELECT source_document_id, count(*) AS n FROM evidence_rows GROUP BY 1) r ON r.source_document_id = s.id
      LEFT JOIN (SELECT source_document_id, count(*) AS n FROM curation_candidate GROUP BY 1) c ON c.source_document_id = s.id"""


@query("license_manifest", LICENSE_SQL)
def _(spark, sf_dir):
    return stats.license_manifest(evidence_tables(spark, sf_dir))


@query("duplicate_keys", "SELECT title, count(*) AS n FROM source_document WHERE coalesce(title, '') <> '' GROUP BY title HAVING count(*) > 1")
def _(spark, sf_dir):
    return stats.duplicate_keys(evidence_tables(spark, sf_dir)["source_document"], ["title"])


@query(
    "leakage_violations",
    """SELECT task_name, leakage_group, count(DISTINCT split_name) AS n_splits, count(*) AS n_rows FROM (
      SELECT task_name, split_name, split_part(leakage_group, '|', 1) AS leakage_group FROM benchmark_split)
      GROUP BY task_name, leakage_group HAVING count(DISTINCT split_name) > 1""",
)
def _(spark, sf_dir):
    splits = evidence_tables(spark, sf_dir)["benchmark_split"]
    by_source = splits.withColumn("leakage_group", F.split_part("leakage_group", F.lit("|"), F.lit(1)))
    return stats.leakage_violations(by_source)


@query("decision_confusion", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY quality, toxic")
def _(spark, sf_dir):
    return stats.decision_confusion(raw_table(spark, sf_dir, "labels"), "quality", "toxic")


@query(
    "sampling_summary",
    """SELECT d.lang AS sampling_stratum, CASE WHEN l.quality = l.toxic THEN 'agree' ELSE 'differ' END AS error_category, count(*) AS n
      FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY ALL""",
)
def _(spark, sf_dir):
    labels = raw_table(spark, sf_dir, "labels").join(raw_table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    tagged = labels.select(
        F.col("lang").alias("sampling_stratum"),
        F.when(F.col("quality") == F.col("toxic"), "agree").otherwise("differ").alias("error_category"),
    )
    return stats.sampling_summary(tagged)


@query(
    "facet_counts",
    """SELECT coalesce(nullif(target_gene_symbol, ''), 'unknown') AS label, count(*) AS n FROM release_view
      GROUP BY label ORDER BY n DESC, label LIMIT 8""",
)
def _(spark, sf_dir):
    return stats.facet_counts(release.release_view(evidence_tables(spark, sf_dir)), "target_gene_symbol")


@query("union_distinct", "SELECT source_document_id AS id FROM toxicity_endpoint UNION SELECT sid FROM curation_base")
def _(spark, sf_dir):
    tables = evidence_tables(spark, sf_dir)
    id_col = F.col("source_document_id").alias("id")
    return joins.union_distinct(tables["toxicity_endpoint"].select(id_col), tables["curation_candidate"].select(id_col))


@query("union_all", "SELECT evidence_grade, source_location, count(*) AS n FROM evidence_rows GROUP BY ALL")
def _(spark, sf_dir):
    tables = evidence_tables(spark, sf_dir)
    cols = ["evidence_grade", "source_location"]
    both = joins.union_all(tables["toxicity_endpoint"].select(*cols), tables["offtarget_evidence"].select(*cols))
    return both.groupBy(*cols).agg(F.count("*").alias("n"))


@query(
    "difference",
    """SELECT DISTINCT source_document_id, evidence_domain FROM curation_candidate EXCEPT
      SELECT source_document_id, evidence_domain FROM evidence_rows WHERE evidence_grade = 'A'""",
)
def _(spark, sf_dir):
    tables = evidence_tables(spark, sf_dir)
    key = ["source_document_id", "evidence_domain"]
    graded = release.fact_rows(tables).filter("evidence_grade = 'A'").select(*key).distinct()
    return joins.difference(tables["curation_candidate"].select(*key).distinct(), graded, key)


@query(
    "intersection",
    "SELECT molecule_id, max(CASE WHEN evidence_grade IN ('A', 'B') THEN 1 ELSE 0 END) AS meets FROM evidence_rows GROUP BY molecule_id",
)
def _(spark, sf_dir):
    return joins.intersection(release.fact_rows(evidence_tables(spark, sf_dir)), ["molecule_id"], "evidence_grade", ["A", "B"])


@query(
    "rank_sort",
    """SELECT id, confidence_label FROM curation_candidate ORDER BY CASE confidence_label WHEN 'high_candidate' THEN 0
      WHEN 'medium_candidate' THEN 1 ELSE 2 END, id""",
)
def _(spark, sf_dir):
    from attesta.functions.text import CONFIDENCE_RANK

    candidates = evidence_tables(spark, sf_dir)["curation_candidate"].select("id", "confidence_label")
    return joins.rank_sort(candidates, "confidence_label", CONFIDENCE_RANK, [F.asc("id")])


@query("top_n", "SELECT id, publication_year FROM source_document ORDER BY publication_year DESC NULLS LAST, id LIMIT 50")
def _(spark, sf_dir):
    sources = evidence_tables(spark, sf_dir)["source_document"].select("id", "publication_year")
    return joins.top_n(sources, [F.desc_nulls_last("publication_year"), F.asc("id")], 50)
