"""Queries: review checks, promotion, verdicts, repairs, packets, gene symbols."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.operators import curation, genes, joins, stats
from attesta.plans.registry import query
from attesta.sources.adapters import evidence_tables, raw_table

NOW = "2024-06-01"

# Reviews derived from the candidates: accepts and rejects, some with errors.
REVIEWS = """rvw AS (SELECT id AS candidate_id, source_document_id, evidence_domain,
    CASE id % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' ELSE 'pending' END AS curator_decision,
    CASE id % 3 WHEN 0 THEN 'curator_verified' WHEN 1 THEN 'curator_rejected' ELSE 'candidate_needs_curator_review' END AS validation_status,
    CASE WHEN id % 15 = 0 THEN 'X' ELSE suggested_evidence_grade END AS evidence_grade,
    CASE WHEN id % 21 = 0 THEN 'Machine pre-curation only' WHEN id % 22 = 1 THEN '' ELSE 'checked ' || id END AS audit_note,
    CASE WHEN id % 33 = 0 THEN '' ELSE 'mol ' || (id % 50) END AS molecule_canonical_name, candidate_modality,
    CASE evidence_domain WHEN 'toxicity' THEN 'toxicity_endpoint' WHEN 'offtarget' THEN 'offtarget_evidence' ELSE '' END AS verified_entity_table,
    'ep' || (id % 7) AS endpoint_name, 'cat' || (id % 3) AS endpoint_category, 'ot' || (id % 3) AS evidence_type,
    source_location AS source_location_verified, CASE WHEN id % 2 = 0 THEN 'assay' ELSE '' END AS assay_type
  FROM curation_candidate),
  chk AS (SELECT *, CASE curator_decision WHEN 'accept' THEN concat_ws('; ', CASE WHEN evidence_grade NOT IN ('A', 'B', 'C') THEN 'evidence_grade must be A, B or C' END,
      CASE WHEN audit_note = '' THEN 'audit_note is missing' END, CASE WHEN contains(lower(audit_note), 'precuration only') OR contains(lower(audit_note), 'machine pre-curation only') THEN 'audit_note is machine-only' END,
      CASE WHEN molecule_canonical_name = '' THEN 'molecule is missing' END,
      CASE WHEN verified_entity_table = '' THEN 'verified_entity_table must be a release table' END,
      CASE WHEN verified_entity_table <> '' AND source_location_verified = '' THEN 'source_location_verified is missing' END)
    WHEN 'reject' THEN concat_ws('; ', CASE WHEN audit_note = '' THEN 'audit_note is missing' END) ELSE 'not decided' END AS errors FROM rvw)"""


def _reviews(tables) -> DataFrame:
    i = F.col("id")
    third = i % 3
    domain = F.col("evidence_domain")

    def numbered(prefix: str, n) -> F.Column:
        return F.concat(F.lit(prefix), n.cast("string"))

    return tables["curation_candidate"].select(
        i.alias("candidate_id"),
        F.when(third == 0, "accept").when(third == 1, "reject").otherwise("pending").alias("curator_decision"),
        F.when(third == 0, "curator_verified").when(third == 1, "curator_rejected").otherwise("candidate_needs_curator_review").alias("validation_status"),
        F.when(i % 15 == 0, "X").otherwise(F.col("suggested_evidence_grade")).alias("evidence_grade"),
        F.when(i % 21 == 0, "Machine pre-curation only").when(i % 22 == 1, "").otherwise(numbered("checked ", i)).alias("audit_note"),
        F.lit("").alias("molecule_id"),
        F.when(i % 33 == 0, "").otherwise(numbered("mol ", i % 50)).alias("molecule_canonical_name"),
        "candidate_modality",
        F.lit("").alias("target_gene_symbol"),
        F.when(domain == "toxicity", "toxicity_endpoint").when(domain == "offtarget", "offtarget_evidence").otherwise("").alias("verified_entity_table"),
        numbered("ep", i % 7).alias("endpoint_name"),
        numbered("cat", i % 3).alias("endpoint_category"),
        numbered("ot", i % 3).alias("evidence_type"),
        F.col("source_location").alias("source_location_verified"),
        F.when(i % 2 == 0, "assay").otherwise("").alias("assay_type"),
        F.lit("curator1").alias("curator_id"),
        F.when(i % 4 == 0, "true").otherwise("false").alias("benchmark_eligible_proposed"),
    )


@query("validate_review", f"WITH {REVIEWS} SELECT candidate_id, curator_decision, errors FROM chk")
def _(spark, sf_dir):
    valid, invalid = curation.validate_review(_reviews(evidence_tables(spark, sf_dir)))
    good = valid.select("candidate_id", "curator_decision", F.lit("").alias("errors"))
    return good.unionByName(invalid.select("candidate_id", "curator_decision", F.array_join("errors", "; ").alias("errors")))


@query(
    "promote_review",
    f"""WITH {REVIEWS}, acc AS (SELECT *, CASE candidate_modality WHEN 'ASO/siRNA' THEN 'ASO/siRNA mixed context' ELSE candidate_modality END AS modality FROM chk WHERE curator_decision = 'accept' AND errors = '')
      SELECT candidate_id, verified_entity_table AS entity_table, CASE verified_entity_table WHEN 'toxicity_endpoint' THEN endpoint_name ELSE evidence_type END AS label,
        source_document_id, source_location_verified AS source_location, evidence_grade, molecule_canonical_name AS canonical_name, modality FROM acc""",
)
def _(spark, sf_dir):
    tables = evidence_tables(spark, sf_dir)
    reviews = _reviews(tables)
    out = curation.promote_review(tables, reviews, NOW)
    names = out["modality"].select(F.col("id").alias("modality_id"), F.col("name").alias("modality"))
    molecule = out["molecule"].join(names, "modality_id").select(F.col("id").alias("molecule_id"), "canonical_name", "modality")
    keys = reviews.select("candidate_id", F.xxhash64(F.lit("fact"), "candidate_id").alias("id"))

    def facts(name: str, label: str) -> DataFrame:
        return out[name].join(keys, "id").select(
            "candidate_id", F.lit(name).alias("entity_table"), F.col(label).alias("label"), "source_document_id", "source_location", "evidence_grade", "molecule_id"
        )

    both = facts("toxicity_endpoint", "endpoint_name").unionByName(facts("offtarget_evidence", "evidence_type"))
    return both.join(molecule, "molecule_id").drop("molecule_id")


@query(
    "promote_counts",
    f"""WITH {REVIEWS}, acc AS (SELECT *, CASE candidate_modality WHEN 'ASO/siRNA' THEN 'ASO/siRNA mixed context' ELSE candidate_modality END AS modality FROM chk WHERE curator_decision = 'accept' AND errors = '')
      SELECT 'modality' AS table_name, (SELECT count(*) FROM modality) + (SELECT count(DISTINCT modality) FROM acc) AS n
      UNION ALL SELECT 'molecule', (SELECT count(*) FROM molecule) + (SELECT count(*) FROM (SELECT DISTINCT molecule_canonical_name, modality FROM acc))
      UNION ALL SELECT 'assay', (SELECT count(*) FROM assay) + (SELECT count(*) FROM acc WHERE assay_type <> '')
      UNION ALL SELECT 'toxicity_endpoint', (SELECT count(*) FROM toxicity_endpoint) + (SELECT count(*) FROM acc WHERE verified_entity_table = 'toxicity_endpoint')
      UNION ALL SELECT 'offtarget_evidence', (SELECT count(*) FROM offtarget_evidence) + (SELECT count(*) FROM acc WHERE verified_entity_table = 'offtarget_evidence')
      UNION ALL SELECT 'curation_audit', (SELECT count(*) FROM curation_audit) + (SELECT count(*) FROM acc)
      UNION ALL SELECT 'benchmark_split', (SELECT count(*) FROM benchmark_split) + (SELECT count(*) FROM acc WHERE candidate_id % 4 = 0 AND evidence_grade IN ('A', 'B'))
      UNION ALL SELECT 'curation_candidate', (SELECT count(*) FROM curation_candidate)""",
)
def _(spark, sf_dir):
    tables = evidence_tables(spark, sf_dir)
    out = curation.promote_review(tables, _reviews(tables), NOW)
    names = "modality molecule assay toxicity_endpoint offtarget_evidence curation_audit benchmark_split curation_candidate".split()
    return reduce(DataFrame.unionByName, [out[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for n in names])


@query(
    "sync_rejects",
    f"""WITH {REVIEWS}, r AS (SELECT candidate_id FROM chk WHERE curator_decision = 'reject' AND errors = '')
      SELECT 'candidate' AS kind, c.id, CASE WHEN r.candidate_id IS NOT NULL THEN 'curator_rejected' ELSE c.validation_status END AS status,
        CASE WHEN r.candidate_id IS NOT NULL THEN 'reject' ELSE c.curator_decision END AS decision FROM curation_candidate c LEFT JOIN r ON r.candidate_id = c.id
      UNION ALL SELECT 'audit', candidate_id, 'curator_rejected', 'reject' FROM r""",
)
def _(spark, sf_dir):
    tables = evidence_tables(spark, sf_dir)
    out = curation.sync_rejects(tables, _reviews(tables), NOW)
    state = [F.col("validation_status").alias("status"), F.col("curator_decision").alias("decision")]
    candidates = out["curation_candidate"].select(F.lit("candidate").alias("kind"), "id", *state)
    audits = out["curation_audit"].filter("entity_table = 'curation_candidate'").select(F.lit("audit").alias("kind"), F.col("entity_id").alias("id"), *state)
    return candidates.unionByName(audits)


# Verdicts on toxicity rows of labelled documents; some are incomplete, some entities are judged twice.
VERDICTS = """vrd AS (SELECT t.id AS ord, CASE WHEN t.id % 20 = 1 THEN 'molecule' ELSE 'toxicity_endpoint' END AS entity_table, t.id AS entity_id,
    CASE l.quality WHEN 1 THEN 'Accept ' ELSE 'reject' END AS human_decision, CASE WHEN t.source_document_id % 4 = 3 THEN '' ELSE 'curator9' END AS human_curator_id
  FROM toxicity_endpoint t JOIN labels l ON l.doc_id = t.source_document_id
  UNION ALL SELECT t.id + 1000000000, 'toxicity_endpoint', t.id, 'accept', 'curator9' FROM toxicity_endpoint t JOIN labels l ON l.doc_id = t.source_document_id WHERE l.quality = 0
  UNION ALL SELECT id + 2000000000, 'toxicity_endpoint', -id, 'accept', 'curator9' FROM source_document
  UNION ALL SELECT id + 3000000000, 'toxicity_endpoint', id, 'abstain', 'curator9' FROM source_document),
  out AS (SELECT v.*, CASE WHEN lower(trim(human_decision)) NOT IN ('accept', 'reject') THEN 'skipped_blank_or_abstain'
      WHEN v.entity_table NOT IN ('toxicity_endpoint', 'offtarget_evidence') THEN 'skipped_bad_table' WHEN human_curator_id = '' THEN 'skipped_no_curator'
      WHEN e.evidence_id IS NULL OR ord > gone THEN 'unknown_entity' WHEN lower(trim(human_decision)) = 'reject' THEN 'rejected_removed' ELSE 'accept_confirmed' END AS outcome
    FROM vrd v LEFT JOIN evidence_rows e ON e.entity_table = v.entity_table AND e.evidence_id = v.entity_id
    LEFT JOIN (SELECT w.entity_table, w.entity_id, min(ord) AS gone FROM vrd w JOIN evidence_rows x ON x.entity_table = w.entity_table AND x.evidence_id = w.entity_id
      WHERE human_decision = 'reject' AND human_curator_id <> '' GROUP BY ALL) g ON g.entity_table = v.entity_table AND g.entity_id = v.entity_id),
  gone AS (SELECT entity_table, entity_id FROM out WHERE outcome = 'rejected_removed')"""


def _verdicts(spark, sf_dir, tables) -> DataFrame:
    labels = raw_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("source_document_id"), "quality")
    judged = tables["toxicity_endpoint"].join(labels, "source_document_id")
    i = F.col("id")
    who = F.lit("curator9").alias("human_curator_id")
    first = judged.select(
        i.alias("ord"),
        F.when(i % 20 == 1, "molecule").otherwise("toxicity_endpoint").alias("entity_table"),
        i.alias("entity_id"),
        F.when(F.col("quality") == 1, "Accept ").otherwise("reject").alias("human_decision"),
        F.when(F.col("source_document_id") % 4 == 3, "").otherwise("curator9").alias("human_curator_id"),
    )
    table = F.lit("toxicity_endpoint").alias("entity_table")
    again = judged.filter("quality = 0").select((i + 1000000000).alias("ord"), table, i.alias("entity_id"), F.lit("accept").alias("human_decision"), who)
    sources = tables["source_document"]
    unknown = sources.select((i + 2000000000).alias("ord"), table, (-i).alias("entity_id"), F.lit("accept").alias("human_decision"), who)
    abstain = sources.select((i + 3000000000).alias("ord"), table, i.alias("entity_id"), F.lit("abstain").alias("human_decision"), who)
    rows = reduce(DataFrame.unionByName, [first, again, unknown, abstain])
    return rows.withColumns({"human_note": F.lit(""), "grounding_quote": F.lit("quoted")})


@query(
    "apply_verdicts",
    f"""WITH {VERDICTS} SELECT outcome, count(*) AS n FROM out GROUP BY outcome
      UNION ALL SELECT 'benchmark_removed', count(*) FROM benchmark_split b WHERE EXISTS (SELECT 1 FROM gone g WHERE g.entity_table = b.entity_table AND g.entity_id = b.entity_id)""",
)
def _(spark, sf_dir):
    tables = evidence_tables(spark, sf_dir)
    return curation.apply_verdicts(tables, _verdicts(spark, sf_dir, tables), NOW)[1]


@query(
    "apply_verdicts_tables",
    f"""WITH {VERDICTS} SELECT 'toxicity_endpoint' AS table_name, id, '' AS status FROM toxicity_endpoint WHERE id NOT IN (SELECT entity_id FROM gone)
      UNION ALL SELECT 'curation_audit', entity_id, CASE outcome WHEN 'rejected_removed' THEN 'recurated_rejected' ELSE 'curator_verified' END FROM out WHERE outcome IN ('rejected_removed', 'accept_confirmed')""",
)
def _(spark, sf_dir):
    tables = evidence_tables(spark, sf_dir)
    new, _ = curation.apply_verdicts(tables, _verdicts(spark, sf_dir, tables), NOW)
    facts = new["toxicity_endpoint"].select(F.lit("toxicity_endpoint").alias("table_name"), "id", F.lit("").alias("status"))
    audits = new["curation_audit"].filter(F.col("audited_at") == NOW)
    return facts.unionByName(audits.select(F.lit("curation_audit").alias("table_name"), F.col("entity_id").alias("id"), F.col("validation_status").alias("status")))


_SHARED = "(SELECT id AS molecule_id, canonical_name AS label, modality_id FROM molecule WHERE disease_context = 'PROMO')"


def _placeholders(tables) -> DataFrame:
    return tables["molecule"].filter("disease_context = 'PROMO'").select(F.col("id").alias("placeholder_id"), F.col("canonical_name").alias("label"), "modality_id")


@query(
    "split_shared_placeholders",
    f"""WITH p AS {_SHARED}, prs AS (SELECT DISTINCT e.source_document_id, e.molecule_id FROM evidence_rows e JOIN p ON p.molecule_id = e.molecule_id)
      SELECT prs.source_document_id, p.modality_id, CASE WHEN regexp_extract(lower(s.title), 'hation|thtion') <> '' THEN regexp_extract(lower(s.title), 'hation|thtion') || ' (recovered from PMID:' || coalesce(s.pmid, '') || ')'
        WHEN coalesce(s.pmid, '') <> '' THEN 'unspecified ' || p.label || ' (PMID:' || s.pmid || ', source-only)' ELSE 'unspecified ' || p.label || ' (source_doc:' || prs.source_document_id || ', source-only)' END AS canonical_name,
        count(*) AS facts
      FROM prs JOIN p ON p.molecule_id = prs.molecule_id JOIN source_document s ON s.id = prs.source_document_id
      JOIN evidence_rows e ON e.source_document_id = prs.source_document_id AND e.molecule_id = prs.molecule_id
      GROUP BY prs.source_document_id, prs.molecule_id, p.modality_id, p.label, s.title, s.pmid""",
)
def _(spark, sf_dir):
    from attesta.operators.release import fact_rows

    tables = evidence_tables(spark, sf_dir)
    # The test titles hold no word boundaries around these endings, so the name list is one plain code pattern.
    new, _ = curation.split_shared_placeholders(tables, _placeholders(tables), ["zzzz"], "(?i)hation|thtion")
    created = new["molecule"].join(tables["molecule"].select("id"), "id", "left_anti")
    facts = fact_rows(new).groupBy(F.col("molecule_id").alias("id"), "source_document_id").agg(F.count("*").alias("facts"))
    named = F.when(F.col("canonical_name").startswith("unspecified"), F.col("canonical_name")).otherwise(
        F.concat(F.lower(F.regexp_extract("canonical_name", r"^\S+", 0)), F.regexp_extract("canonical_name", r"\s.*$", 0))
    )
    return created.join(facts, "id").select("source_document_id", "modality_id", named.alias("canonical_name"), "facts")


@query(
    "placeholder_metrics",
    f"""WITH p AS {_SHARED}, f AS (SELECT e.*, p.molecule_id IS NOT NULL AS shared FROM evidence_rows e LEFT JOIN p ON p.molecule_id = e.molecule_id),
      n AS (SELECT *, CASE WHEN shared THEN 'new:' || source_document_id || ':' || molecule_id ELSE CAST(molecule_id AS VARCHAR) END AS nid FROM f),
      s AS (SELECT b.*, CASE WHEN n.shared THEN 'source:' || n.source_document_id || '|molecule:' || n.nid ELSE b.leakage_group END AS g
        FROM benchmark_split b LEFT JOIN n ON n.entity_table = b.entity_table AND n.evidence_id = b.entity_id),
      v AS (SELECT g FROM s GROUP BY g HAVING count(DISTINCT split_name) > 1)
      SELECT 'before' AS phase, 'placeholder_rows' AS metric, count(*) FILTER (shared) AS n FROM f
      UNION ALL SELECT 'before', 'release_molecules', count(DISTINCT f.molecule_id) FROM f JOIN molecule m ON m.id = f.molecule_id
      UNION ALL SELECT 'before', 'split_rows', count(*) FROM benchmark_split
      UNION ALL SELECT 'before', 'spanning_groups', count(*) FROM (SELECT leakage_group FROM benchmark_split GROUP BY leakage_group HAVING count(DISTINCT split_name) > 1)
      UNION ALL SELECT 'after', 'placeholder_rows', 0
      UNION ALL SELECT 'after', 'release_molecules', count(DISTINCT nid) FROM n LEFT JOIN molecule m ON m.id = n.molecule_id LEFT JOIN source_document d ON d.id = n.source_document_id WHERE m.id IS NOT NULL AND (d.id IS NOT NULL OR NOT shared)
      UNION ALL SELECT 'after', 'split_rows', count(*) FROM s WHERE g NOT IN (SELECT g FROM v)
      UNION ALL SELECT 'after', 'spanning_groups', 0""",
)
def _(spark, sf_dir):
    tables = evidence_tables(spark, sf_dir)
    return curation.split_shared_placeholders(tables, _placeholders(tables))[1]


_HV = "lower(trim(coalesce(CAST({c} AS VARCHAR), ''))) NOT IN ('', 'na', 'n/a', 'nan', 'none', 'null')"


def _none(cols: str) -> str:
    return "NOT (" + " OR ".join(_HV.format(c=c) for c in cols.split()) + ")"


CORE = f"""cor AS (SELECT e.*, a.organism, a.model_system, a.cell_line_or_tissue, a.dose_value, a.dose_unit, a.exposure_time_value, a.exposure_time_unit,
    EXISTS (SELECT 1 FROM benchmark_split b WHERE b.entity_table = e.entity_table AND b.entity_id = e.evidence_id) AS in_b
    FROM evidence_star e LEFT JOIN assay a ON a.id = e.assay_id),
  pkt AS (SELECT 'core-field-' || substr(sha256(entity_table || ':' || evidence_id), 1, 12) AS packet_row_id, entity_table, evidence_id,
    CASE WHEN in_b THEN 'P0' WHEN evidence_grade IN ('A', 'B') THEN 'P1' ELSE 'P2' END AS priority,
    {_none("sense_sequence antisense_sequence guide_sequence passenger_sequence")} AS missing_sequence, {_none("seed_region")} AS missing_seed,
    {_none("backbone_chemistry sugar_modification base_modification")} AS missing_modification, {_none("conjugate_delivery")} AS missing_delivery,
    {_none("dose_value dose_unit")} AS missing_dose, {_none("exposure_time_value exposure_time_unit")} AS missing_exposure,
    {_none("organism model_system cell_line_or_tissue")} AS missing_model FROM cor)"""


@query("core_field_packet", f"WITH {CORE} SELECT * FROM pkt")
def _(spark, sf_dir):
    packet = curation.core_field_packet(evidence_tables(spark, sf_dir))
    return packet.select("packet_row_id", "entity_table", "evidence_id", "priority", *stats.MISSING_FLAGS)


@query(
    "core_field_coverage",
    f"WITH {CORE} "
    + " UNION ALL ".join(
        f"SELECT 'available' AS section, '{f.removeprefix('missing_')}' AS label, count(*) FILTER (NOT {f}) AS n, count(*) AS total FROM pkt" for f in stats.MISSING_FLAGS
    )
    + "".join(f" UNION ALL SELECT 'priority', '{p}', count(*) FILTER (priority = '{p}'), count(*) FROM pkt" for p in ("P0", "P1", "P2")),
)
def _(spark, sf_dir):
    return stats.core_field_coverage(curation.core_field_packet(evidence_tables(spark, sf_dir)))


def _sample_sql(name: str, rows: str) -> str:
    """Stratified sample of `rows` (rid, stratum) in SQL."""
    return f"""{name}r AS ({rows}), {name}z AS (SELECT stratum, count(*) AS sz, (SELECT count(*) FROM {name}r) AS total FROM {name}r GROUP BY stratum),
  {name}q AS (SELECT stratum, least(sz, greatest(3, round_even(sz::DOUBLE / total * 250.0, 0)::BIGINT)) AS quota FROM {name}z),
  {name}k AS (SELECT *, sha256(stratum || ':' || rid) AS h, row_number() OVER (PARTITION BY stratum ORDER BY sha256(stratum || ':' || rid)) AS rn FROM {name}r),
  {name}c AS (SELECT k.* FROM {name}k k JOIN {name}q USING (stratum) WHERE rn <= quota),
  {name}f AS (SELECT rid, stratum, row_number() OVER (ORDER BY sha256('fill:' || rid)) AS rn FROM {name}r WHERE rid NOT IN (SELECT rid FROM {name}c)),
  {name} AS ((SELECT rid, stratum FROM {name}c ORDER BY stratum, h LIMIT 250) UNION ALL SELECT rid, stratum FROM {name}f WHERE rn <= 250 - (SELECT count(*) FROM {name}c))"""


@query(
    "validation_packet",
    f"""WITH {CORE}, {_sample_sql("rel", "SELECT entity_table || ':' || evidence_id AS rid, 'release_accept/' || entity_table || '/' || evidence_grade || '/' || CASE WHEN in_b THEN 'yes' ELSE 'no' END AS stratum FROM cor")},
      {_sample_sql("rej", "SELECT 'curation_candidate:' || id AS rid, 'candidate_reject_control/' || evidence_domain || '/' || suggested_evidence_grade || '/' || candidate_modality AS stratum FROM curation_candidate WHERE curator_decision = 'reject'")}
      SELECT 'iv-release-' || substr(sha256(rid), 1, 12) AS validation_sample_id, 'release_accept' AS item_type, stratum FROM rel
      UNION ALL SELECT 'iv-reject-' || substr(sha256(rid), 1, 12), 'candidate_reject_control', stratum FROM rej""",
)
def _(spark, sf_dir):
    return curation.validation_packet(evidence_tables(spark, sf_dir)).select("validation_sample_id", "item_type", "stratum")


@query(
    "override_table",
    """WITH rv AS (SELECT 'toxicity_endpoint' AS entity_table, t.id AS entity_id, s.pmid, CASE WHEN l.quality = 1 THEN 'accept' ELSE 'reject' END AS final_decision
          FROM toxicity_endpoint t JOIN labels l ON l.doc_id = t.source_document_id JOIN source_document s ON s.id = t.source_document_id
        UNION ALL SELECT 'offtarget_evidence', -id, pmid, 'reject' FROM source_document),
      st AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_table, entity_id ORDER BY audited_at DESC, id) AS rn FROM curation_audit WHERE curator_id = 'curator1') WHERE rn = 1),
      d AS (SELECT pmid, doi FROM (SELECT pmid, doi, row_number() OVER (PARTITION BY pmid ORDER BY id) AS rn FROM source_document WHERE coalesce(pmid, '') <> '' AND coalesce(doi, '') <> '') WHERE rn = 1)
      SELECT rv.entity_table || ':' || rv.entity_id AS candidate_id, rv.pmid, coalesce(d.doi, '') AS doi, coalesce(nullif(e.source_location, ''), 'claimed') AS source_location, final_decision,
        e.is_observed_experimental, CASE WHEN e.entity_table = 'offtarget_evidence' THEN e.is_computational_prediction END AS is_computational_prediction,
        coalesce(st.validation_status, '') AS current_validation_status
      FROM rv LEFT JOIN evidence_rows e ON e.entity_table = rv.entity_table AND e.evidence_id = rv.entity_id
      LEFT JOIN st ON st.entity_table = rv.entity_table AND st.entity_id = rv.entity_id LEFT JOIN d ON d.pmid = rv.pmid""",
)
def _(spark, sf_dir):
    tables = evidence_tables(spark, sf_dir)
    labels = raw_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("source_document_id"), "quality")
    sources = tables["source_document"]
    pmids = sources.select(F.col("id").alias("source_document_id"), "pmid")
    judged = tables["toxicity_endpoint"].join(labels, "source_document_id").join(pmids, "source_document_id")
    live = judged.select(F.lit("toxicity_endpoint").alias("entity_table"), F.col("id").alias("entity_id"), "pmid", F.when(F.col("quality") == 1, "accept").otherwise("reject").alias("final_decision"))
    gone = sources.select(F.lit("offtarget_evidence").alias("entity_table"), (-F.col("id")).alias("entity_id"), "pmid", F.lit("reject").alias("final_decision"))
    reviews = live.unionByName(gone).withColumn("claimed_location", F.lit("claimed"))
    return joins.override_table(reviews, tables, "curator1").drop("entity_table", "entity_id", "curator_id")


@query(
    "change_diff",
    """WITH o AS (SELECT id, target_gene_symbol AS a, backbone_chemistry AS b FROM molecule WHERE disease_context <> 'SMALL'),
      n AS (SELECT id, coalesce(target_gene_symbol, 'unspecified') AS a, nullif(backbone_chemistry, '') AS b FROM molecule WHERE disease_context <> 'LARGE'),
      j AS (SELECT coalesce(o.id, n.id) AS id, o.a AS oa, n.a AS na, o.b AS ob, n.b AS nb FROM o FULL JOIN n ON n.id = o.id)
      SELECT id, 'a' AS column_name, oa AS old_value, na AS new_value FROM j WHERE oa IS DISTINCT FROM na
      UNION ALL SELECT id, 'b', ob, nb FROM j WHERE ob IS DISTINCT FROM nb""",
)
def _(spark, sf_dir):
    molecule = evidence_tables(spark, sf_dir)["molecule"]
    old = molecule.filter("disease_context <> 'SMALL'").select("id", F.col("target_gene_symbol").alias("a"), F.col("backbone_chemistry").alias("b"))
    new = molecule.filter("disease_context <> 'LARGE'").select(
        "id", F.coalesce("target_gene_symbol", F.lit("unspecified")).alias("a"), F.nullif("backbone_chemistry", F.lit("")).alias("b")
    )
    return curation.change_diff(old, new, "id", ["a", "b"])


@query(
    "accession_extract",
    r"""WITH q AS (SELECT doc_id, text || ' NM_' || doc_id || '.2 and ENST0' || doc_id || ', NM_' || doc_id || '.2' AS quote FROM documents),
      a AS (SELECT doc_id, unnest(x) AS acc, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, regexp_extract_all(quote, '\b((?:NM|NR|XM|XR|NP)_\d+(?:\.\d+)?|ENS[TGP]\d+(?:\.\d+)?)\b', 1) AS x FROM q)),
      f AS (SELECT doc_id, acc, min(i) AS i FROM a GROUP BY ALL) SELECT doc_id, string_agg(acc, ';' ORDER BY i) AS accessions FROM f GROUP BY doc_id""",
)
def _(spark, sf_dir):
    number = F.col("doc_id").cast("string")
    quote = F.concat(F.col("text"), F.lit(" NM_"), number, F.lit(".2 and ENST0"), number, F.lit(", NM_"), number, F.lit(".2"))
    return raw_table(spark, sf_dir, "documents").select("doc_id", F.array_join(genes.accession_extract(quote), ";").alias("accessions"))


_GENES = genes.GeneLexicon(known=("THTION", "ATTION", "RETION", "ONTION", "QUEQUE"), noise=("NOISE",), cues=("with", "the"), wide_cues=("ertion",))


@query(
    "intended_targets",
    """WITH m AS (SELECT id, 'si' || upper(canonical_name) AS name, coalesce(target_gene_symbol, '') AS t FROM molecule)
      SELECT id, concat_ws(';', nullif(upper(t), ''), CASE WHEN regexp_matches(name, '\\bRING\\b') THEN 'RING' END, CASE WHEN regexp_matches(name, '\\bGEAR\\b') THEN 'GEAR' END) AS targets FROM m""",
)
def _(spark, sf_dir):
    molecule = evidence_tables(spark, sf_dir)["molecule"].select("id", "target_gene_symbol", F.concat(F.lit("si"), F.upper("canonical_name")).alias("canonical_name"))
    lexicon = genes.GeneLexicon(known=("RING", "GEAR"), noise=())
    return molecule.select("id", F.array_join(genes.intended_targets(lexicon=lexicon), ";").alias("targets"))


@query("gene_symbol_decide")
def _(spark, sf_dir):
    """Symbols in the test prose with a test vocabulary; checked against hand-made rows in the tests."""
    quotes = raw_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("quote"), F.array(F.lit("QUEQUE")).alias("intended"))
    return genes.gene_symbol_decide(quotes, lexicon=_GENES).drop("quote", "intended")
