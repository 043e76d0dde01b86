"""Queries: text and sequence functions, redaction, table maintenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions import sequence, text
from attesta.functions.redaction import sensitive_columns
from attesta.operators import redact, search, stats
from attesta.plans.q02_stats import LICENSE_SQL, PROTOCOL_SQL
from attesta.plans.q04_metrics import WEIGHTS, score_sql
from attesta.plans.registry import query
from attesta.session import checkpoint_dir
from attesta.sources import tables as io
from attesta.sources.adapters import evidence_tables, raw_table, text_table
from attesta.sources.schema import TABLES


def _docs(spark, sf_dir):
    return text_table(spark, sf_dir, "documents", "doc_id")


_CANON = "regexp_replace(translate(upper(text), 'U', 'T'), '[^ACGTN]', '', 'g')"


@query("canonical_sequence", f"SELECT doc_id, {_CANON} AS seq FROM documents")
def _(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", sequence.canonical_sequence("text").alias("seq"))


@query(
    "sequence_from_helm",
    """WITH h AS (SELECT id, 'RNA1{' || regexp_replace(coalesce(guide_sequence, ''), '([ACGTU])', 'R(\\1)P.', 'g') || '}$$$$' AS helm FROM molecule)
      SELECT id, array_to_string(regexp_extract_all(upper(helm), '\\(([ACGTU])\\)', 1), '') AS bases FROM h""",
)
def _(spark, sf_dir):
    molecule = evidence_tables(spark, sf_dir)["molecule"]
    helm = F.concat(F.lit("RNA1{"), F.regexp_replace(F.coalesce("guide_sequence", F.lit("")), "([ACGTU])", r"R($1)P."), F.lit("}$$$$"))
    return molecule.select("id", sequence.sequence_from_helm(helm).alias("bases"))


@query(
    "kmer_windows",
    f"""WITH s AS (SELECT doc_id, {_CANON} AS seq FROM documents),
      k AS (SELECT doc_id, unnest(range(1, greatest(length(seq) - 5, 1))) AS i, seq FROM s),
      f AS (SELECT doc_id, substr(seq, i::BIGINT, 7) AS w, min(i) AS i FROM k GROUP BY doc_id, w),
      r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM f)
      SELECT s.doc_id, coalesce(string_agg(w, ',' ORDER BY i) FILTER (rn <= 12), '') AS windows FROM s LEFT JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id""",
)
def _(spark, sf_dir):
    seq = _docs(spark, sf_dir).select("doc_id", sequence.canonical_sequence("text").alias("seq"))
    return seq.select("doc_id", F.array_join(sequence.kmer_windows("seq"), ",").alias("windows"))


@query(
    "seed_2_8",
    f"SELECT doc_id, CASE WHEN length({_CANON}) >= 8 THEN substr({_CANON}, 2, 7) ELSE '' END AS seed, contains({_CANON}, 'N') AS has_n FROM documents",
)
def _(spark, sf_dir):
    seq = _docs(spark, sf_dir).select("doc_id", sequence.canonical_sequence("text").alias("seq"))
    return seq.select("doc_id", sequence.seed_2_8("seq").alias("seed"), sequence.has_ambiguous("seq").alias("has_n"))


@query(
    "invalid_characters",
    r"""WITH c AS (SELECT doc_id, unnest(a) AS ch, generate_subscripts(a, 1) AS i FROM (
        SELECT doc_id, regexp_extract_all(regexp_replace(upper(replace(text, 'ß', 'ss')), '[ACGTUN\s]+', '', 'g'), '.') AS a FROM documents)),
      f AS (SELECT doc_id, ch, min(i) AS i FROM c GROUP BY ALL)
      SELECT d.doc_id, coalesce(string_agg(ch, '' ORDER BY i), '') AS invalid FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id""",
)
def _(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(sequence.invalid_characters("text"), "").alias("invalid"))


@query(
    "normalize_pmcid",
    r"SELECT id, upper(regexp_extract(' pmc' || id || ';', '(?i)^\s*(PMC\d+)', 1)) AS a, upper(regexp_extract(coalesce(pmid, ''), '(?i)^\s*(PMC\d+)', 1)) AS b FROM source_document",
)
def _(spark, sf_dir):
    sources = evidence_tables(spark, sf_dir)["source_document"]
    messy = F.concat(F.lit(" pmc"), F.col("id").cast("string"), F.lit(";"))
    return sources.select("id", text.normalize_pmcid(messy).alias("a"), text.normalize_pmcid("pmid").alias("b"))


_SUFFIX = " (v1 extraction artefact, pending source re-verification) "


@query(
    "strip_name_suffix",
    """SELECT id, canonical_name AS name, CASE sequence_annotation_status WHEN 'needs_curator_sequence_curation'
      THEN 'sequence_not_available' ELSE sequence_annotation_status END AS status FROM molecule""",
)
def _(spark, sf_dir):
    molecule = evidence_tables(spark, sf_dir)["molecule"]
    named = F.concat(F.col("canonical_name"), F.lit(_SUFFIX))
    return molecule.select("id", text.strip_name_suffix(named).alias("name"), text.map_status("sequence_annotation_status").alias("status"))


@query(
    "identifier_repair",
    """SELECT id, CASE WHEN pmcid = '' THEN '' ELSE pmcid END AS pmcid, pmcid <> '' AS changed,
      CASE WHEN pmcid <> '' AND id % 2 = 1 THEN 'invalid identifier' ELSE '' END AS reason FROM source_document WHERE NOT (pmcid <> '' AND id % 2 = 1)
      UNION ALL SELECT id, '', true, 'invalid identifier' FROM source_document WHERE pmcid <> '' AND id % 2 = 1""",
)
def _(spark, sf_dir):
    sources = evidence_tables(spark, sf_dir)["source_document"].select("id", "pmcid")
    # Even ids get a lower-case form to repair, odd ids a text without a PMC number.
    messy = sources.withColumn(
        "pmcid",
        F.when(F.col("pmcid") == "", "").when(F.col("id") % 2 == 0, F.concat(F.lower("pmcid"), F.lit(" x"))).otherwise("unknown"),
    )
    fixed, rejected = redact.identifier_repair(messy)
    return fixed.join(rejected, "id", "left").na.fill("", ["reason"]).select("id", "pmcid", "changed", "reason")


_DATES = r"""SELECT o_orderkey, strftime(o_orderdate, '%Y %b %d') AS a, strftime(o_orderdate, '%Y-%m-%d') AS b FROM orders"""


@query(
    "year_from_pubdate",
    f"""SELECT o_orderkey, CAST(substr(a, 1, 4) AS INT) AS y_words, CAST(substr(b, 1, 4) AS INT) AS y_digits, CAST(NULL AS INT) AS y_blanks FROM ({_DATES})""",
)
def _(spark, sf_dir):
    orders = raw_table(spark, sf_dir, "orders")
    words, dashed = F.date_format("o_orderdate", "yyyy MMM dd"), F.date_format("o_orderdate", "yyyy-MM-dd")
    return orders.select(
        "o_orderkey",
        text.year_from_pubdate(words, "blanks").alias("y_words"),
        text.year_from_pubdate(dashed, "digits").alias("y_digits"),
        text.year_from_pubdate(dashed, "blanks").alias("y_blanks"),
    )


@query("compact_text", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS compact FROM documents")
def _(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.compact_text("text").alias("compact"))


@query(
    "split_terms",
    r"""WITH t AS (SELECT doc_id, unnest(a) AS raw, generate_subscripts(a, 1) AS i FROM (
        SELECT doc_id, string_split_regex(text, '[,;/|]+') AS a FROM documents)),
      u AS (SELECT doc_id, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS term, i FROM t),
      f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(term) ORDER BY i) AS rn FROM u WHERE length(term) >= 2) WHERE rn = 1)
      SELECT d.doc_id, coalesce(string_agg(term, chr(1) ORDER BY i), '') AS terms FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id""",
)
def _(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(text.split_terms("text"), "\u0001").alias("terms"))


@query(
    "node_id",
    r"""SELECT doc_id, 'source:' || coalesce(nullif(substr(regexp_replace(regexp_replace(coalesce(nullif(text, ''), 'unknown'), '[^a-zA-Z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 80), ''), 'unknown') AS node FROM documents""",
)
def _(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.node_id("source", "text").alias("node"))


@query("anchor_hash", "SELECT doc_id, substr(sha256(text), 1, 16) AS h FROM documents")
def _(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.anchor_hash("text").alias("h"))


@query(
    "report_id",
    "SELECT id, substr(sha256(concat_ws('|', coalesce(guide_sequence, ''), coalesce(target_gene_symbol, ''), backbone_chemistry, conjugate_delivery, disease_context, '', '')), 1, 16) AS report FROM molecule",
)
def _(spark, sf_dir):
    parts = ["guide_sequence", "target_gene_symbol", "backbone_chemistry", "conjugate_delivery", "disease_context"]
    return evidence_tables(spark, sf_dir)["molecule"].select("id", text.report_id(*parts, F.lit(""), F.lit("")).alias("report"))


@query(
    "nonblank",
    "SELECT id, trim(coalesce(target_gene_symbol, '')) NOT IN ('', 'NA', 'N/A', 'nan', 'None') AS has_target, coalesce(nullif(target_gene_symbol, ''), nullif(sugar_modification, ''), 'none') AS first_value FROM molecule",
)
def _(spark, sf_dir):
    molecule = evidence_tables(spark, sf_dir)["molecule"]
    return molecule.select(
        "id", text.nonblank("target_gene_symbol").alias("has_target"), text.first_text("target_gene_symbol", "sugar_modification", default="none").alias("first_value")
    )


@query("title_score", f"SELECT doc_id, {score_sql('text')} AS score FROM documents")
def _(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.title_score("text", WEIGHTS).alias("score"))


@query(
    "grade_text",
    "SELECT evidence_grade, 'Grade ' || evidence_grade AS label, count(*) AS n FROM release_view GROUP BY ALL",
)
def _(spark, sf_dir):
    from attesta.operators.release import release_view

    view = release_view(evidence_tables(spark, sf_dir))
    return view.groupBy("evidence_grade", search.grade_text()["label"].alias("label")).agg(F.count("*").alias("n"))


# --- redaction -----------------------------------------------------------------------------------------


@query(
    "redact_columns",
    """SELECT d.doc_id, CASE WHEN text = '' THEN '' ELSE sha256(text) END AS abstract_text_sha256, text <> '' AS abstract_text_withheld,
      '{"note_sha256":"' || sha256('note on ' || d.doc_id) || '","note_withheld":true}' AS audit_note_meta, lang AS source_type FROM documents d""",
)
def _(spark, sf_dir):
    rows = _docs(spark, sf_dir).select(
        "doc_id", F.col("text").alias("abstractText"), F.concat(F.lit("note on "), F.col("doc_id").cast("string")).alias("audit_note"),
        F.col("lang").alias("source_type"),
    )
    return redact.redact_columns(rows)


@query(
    "redact_json_column",
    """SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || ',"detail":{"quote_sha256":"' || sha256(event_type) || '","quote_withheld":true}}' AS payload FROM events""",
)
def _(spark, sf_dir):
    events = raw_table(spark, sf_dir, "events")
    nested = F.to_json(
        F.struct(
            F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.struct(F.col("event_type").alias("quote")).alias("detail")
        )
    )
    return redact.redact_json_column(events.select("event_id", nested.alias("payload")), "payload")


@query(
    "leak_scan",
    r"""SELECT * FROM (
      SELECT 'documents' AS table_name, 'full_text' AS column_name, 'free_text_column' AS problem, count(*) FILTER (text <> '') AS violations FROM documents
      UNION ALL SELECT 'documents', 'full_text', 'forbidden_text', count(*) FILTER (contains(lower(text), 'thtion')) FROM documents
      UNION ALL SELECT 'sources', 'title', 'forbidden_text', count(*) FILTER (contains(lower(title), 'thtion')) FROM source_document
      UNION ALL SELECT 'sources', 'pmcid', 'bad_pmcid', count(*) FILTER (pmcid <> '' AND NOT regexp_full_match(lower(pmcid), 'PMC\d+')) FROM source_document
      UNION ALL SELECT 'events', 'props', 'free_text_in_json', 0 FROM events LIMIT 1000) WHERE violations > 0""",
)
def _(spark, sf_dir):
    sources = evidence_tables(spark, sf_dir)["source_document"].select("id", "title", F.lower("pmcid").alias("pmcid"))
    published = {
        "documents": _docs(spark, sf_dir).select("doc_id", F.col("text").alias("full_text")),
        "sources": sources,
        "events": raw_table(spark, sf_dir, "events").select("event_id", "props"),
    }
    return redact.leak_scan(published, ["thtion"])


@query(
    "sensitive_columns",
    "SELECT 'curation_audit' AS table_name, 'audit_note' AS column_name, count(*) FILTER (audit_note <> '') AS filled FROM curation_audit",
)
def _(spark, sf_dir):
    tables = evidence_tables(spark, sf_dir)
    names = ["source_document", "molecule", "curation_audit", "curation_candidate"]
    parts = []
    for name in names:
        cols = tables[name].columns
        flagged = sensitive_columns(cols)
        filled = [F.count(F.when(text.text_or_empty(c) != "", 1)).alias(c) for c in flagged]
        if filled:
            parts.append(tables[name].agg(*filled).unpivot([], flagged, "column_name", "filled").withColumn("table_name", F.lit(name)))
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b), parts)


# --- table maintenance -----------------------------------------------------------------------------------


@query("load_table", "SELECT l_orderkey AS id, nullif(l_returnflag, '') AS flag, CAST(NULL AS VARCHAR) AS absent FROM lineitem")
def _(spark, sf_dir):
    schema = T.StructType([T.StructField("l_orderkey", T.LongType()), T.StructField("l_returnflag", T.StringType()), T.StructField("absent", T.StringType())])
    loaded = io.load_table(spark, [f"{sf_dir}/lineitem.parquet"], schema)
    return loaded.select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("flag"), "absent")


@query(
    "add_missing_columns",
    "SELECT p_partkey AS id, p_name AS canonical_name, p_type AS backbone_chemistry, '' AS guide_sequence, 'needs_curator_sequence_curation' AS sequence_annotation_status FROM part",
)
def _(spark, sf_dir):
    old = raw_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("canonical_name"), F.col("p_type").alias("backbone_chemistry")
    )
    return io.add_missing_columns(old).select("id", "canonical_name", "backbone_chemistry", "guide_sequence", "sequence_annotation_status")


@query(
    "publish_table",
    """SELECT 'molecule' AS table_name, id FROM molecule WHERE id IN (SELECT molecule_id FROM evidence_rows)
      UNION ALL SELECT 'source_document', id FROM source_document WHERE id IN (SELECT source_document_id FROM evidence_rows)
      UNION ALL SELECT 'curation_audit', id FROM latest_audit a WHERE EXISTS (SELECT 1 FROM evidence_rows e WHERE e.entity_table = a.entity_table AND e.evidence_id = a.entity_id)
      UNION ALL SELECT 'toxicity_endpoint', id FROM toxicity_endpoint""",
)
def _(spark, sf_dir):
    from attesta.operators.joins import union_all

    tables = evidence_tables(spark, sf_dir)
    names = ["molecule", "source_document", "curation_audit", "toxicity_endpoint"]
    return union_all(*[io.publish_table(tables, n).select(F.lit(n).alias("table_name"), "id") for n in names])


@query(
    "publish_manifest_filter",
    f"SELECT source_document_id, pmid, article_license FROM ({LICENSE_SQL}) WHERE source_document_id IN (SELECT source_document_id FROM evidence_rows)",
)
def _(spark, sf_dir):
    from attesta.operators.release import release_scope

    tables = evidence_tables(spark, sf_dir)
    return io.publish_manifest_filter(
        stats.license_manifest(tables), "source_document_id", release_scope(tables, "source"), ["source_document_id", "pmid", "article_license"]
    )


# Columns of the data model that the test tables do not fill.
_ABSENT = set(
    "molecule.created_at assay.replicate_count assay.source_document_id assay.source_location toxicity_endpoint.measured_value "
    "toxicity_endpoint.measured_unit toxicity_endpoint.direction toxicity_endpoint.significance_label offtarget_evidence.offtarget_gene_symbol "
    "offtarget_evidence.offtarget_transcript_id offtarget_evidence.measured_effect offtarget_evidence.effect_unit "
    "offtarget_evidence.seed_match_length benchmark_split.created_at".split()
)


def _filled(table: str) -> list[T.StructField]:
    return [f for f in TABLES[table].fields if f"{table}.{f.name}" not in _ABSENT]


def _row_code_sql(table: str, blank: bool = False) -> str:
    """The row code of a table; `blank` takes '' as null, as exports do."""
    tags = {"string": "s", "int": "i", "bigint": "i", "double": "f"}
    said = "CASE WHEN {c} IS NULL THEN 'n' ELSE '{t}' || strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    name = lambda f: f"nullif({f.name}, '')" if blank and tags[f.dataType.simpleString()] == "s" else f.name
    return " || ".join(said.format(c=name(f), t=tags[f.dataType.simpleString()]) for f in _filled(table))


def _fingerprint_sql(table: str, blank: bool = False) -> str:
    return f"""count(*) AS n, concat_ws(':', CAST(coalesce(sum(('0x' || substr(h, 1, 16))::UBIGINT), 0) AS VARCHAR),
      CAST(coalesce(sum(('0x' || substr(h, 17, 16))::UBIGINT), 0) AS VARCHAR)) AS hash_sum FROM (SELECT md5({_row_code_sql(table, blank)}) AS h FROM {table})"""


@query(
    "table_fingerprint",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, {_fingerprint_sql(t)}" for t in TABLES),
)
def _(spark, sf_dir):
    tables = evidence_tables(spark, sf_dir)
    marks = [io.table_fingerprint(tables[t], [f.name for f in _filled(t)]).withColumn("table_name", F.lit(t)) for t in TABLES]
    return reduce(DataFrame.unionByName, marks)


@query(
    "export_review_template",
    """SELECT id AS candidate_id, queue_id, coalesce(pmid, '') AS pmid, coalesce(doi, '') AS doi, evidence_domain, candidate_modality, source_location, matched_terms,
      confidence_label, 'pending' AS curator_decision, CASE evidence_domain WHEN 'toxicity' THEN 'toxicity_endpoint' WHEN 'offtarget' THEN 'offtarget_evidence'
      ELSE 'curation_audit_only' END AS verified_entity_table, '' AS source_location_verified, '' AS evidence_grade,
      'candidate_needs_curator_review' AS validation_status, '' AS audit_note FROM curation_candidate""",
)
def _(spark, sf_dir):
    return io.export_review_template(evidence_tables(spark, sf_dir)["curation_candidate"])


@query(
    "sequence_curation_template",
    """SELECT m.id AS molecule_id, canonical_name, mo.name AS modality, target_gene_symbol, guide_sequence, sequence_annotation_status, '' AS curator_decision,
      'needs_curator_verification' AS validation_status, '2024-01-01' AS updated_at FROM molecule m JOIN modality mo ON mo.id = m.modality_id""",
)
def _(spark, sf_dir):
    tables = evidence_tables(spark, sf_dir)
    return io.sequence_curation_template(tables["molecule"], tables["modality"], "2024-01-01").select(
        "molecule_id", "canonical_name", "modality", "target_gene_symbol", "guide_sequence", "sequence_annotation_status", "curator_decision", "validation_status", "updated_at"
    )


@query(
    "overlay_checkpoint",
    """SELECT c.id AS candidate_id, CASE WHEN d.doc_id IS NOT NULL AND lang = 'en' THEN substr(sha256(d.text), 1, 16) ELSE '' END AS source_anchor_hash,
      CASE WHEN d.doc_id IS NOT NULL AND lang = 'en' THEN lang ELSE '' END AS article_type,
      CASE WHEN d.doc_id IS NOT NULL AND lang = 'en' THEN 'first; last' ELSE 'first; no_machine_full_text_anchor; last' END AS risk_flags
      FROM curation_candidate c LEFT JOIN documents d ON d.doc_id = c.id""",
)
def _(spark, sf_dir):
    rows = evidence_tables(spark, sf_dir)["curation_candidate"].select(
        F.col("id").alias("candidate_id"), F.lit("").alias("source_anchor_hash"), F.lit("").alias("article_type"),
        F.lit("first; no_machine_full_text_anchor; last").alias("risk_flags"),
    )
    ckpt = _docs(spark, sf_dir).select(
        F.col("doc_id").alias("candidate_id"), F.col("lang").alias("article_type"),
        F.when(F.col("lang") == "en", text.anchor_hash("text")).otherwise("").alias("source_anchor_hash"),
    )
    return io.overlay_checkpoint(rows, ckpt).select("candidate_id", "source_anchor_hash", "article_type", "risk_flags")


@query(
    "resume_anti",
    "SELECT c.id FROM curation_candidate c WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_id = c.id AND e.event_type NOT IN ('', 'error'))",
)
def _(spark, sf_dir):
    done = raw_table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("decision"))
    return io.resume_anti(evidence_tables(spark, sf_dir)["curation_candidate"].select("id"), done, "id", ["", "error"])


@query(
    "ingest_sources",
    """WITH c AS (SELECT id AS ord, pmid, evidence_domain AS source_type FROM curation_candidate WHERE coalesce(pmid, '') <> ''
         AND pmid NOT IN (SELECT pmid FROM source_document WHERE pmid IS NOT NULL AND source_type = 'en')),
      f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pmid ORDER BY ord) AS rn FROM c) WHERE rn = 1)
      SELECT f.pmid, f.source_type, 'https://pubmed.ncbi.nlm.nih.gov/' || f.pmid || '/' AS source_url, m.pmcid, m.doi, m.title, m.publication_year
      FROM f JOIN source_document m ON m.pmid = f.pmid""",
)
def _(spark, sf_dir):
    tables = evidence_tables(spark, sf_dir)
    sources = tables["source_document"]
    candidates = tables["curation_candidate"].select(
        F.col("id").alias("ord"), "pmid", F.col("evidence_domain").alias("source_type"), F.lit("abstract_metadata_only").alias("license_status"),
        F.lit("derived_annotations_only").alias("reuse_category"),
    )
    metadata = sources.filter(text.has_text("pmid")).select(
        "pmid", F.concat(F.lit("pmc-id: "), F.col("pmcid"), F.lit(";")).alias("pmcid"), "doi", "title", F.col("journal_or_agency").alias("journal"),
        F.concat(F.col("publication_year").cast("string"), F.lit(" Jan 1")).alias("pubdate"),
    )
    rows = io.ingest_sources(candidates, sources.filter("source_type = 'en'"), metadata, "2024-01-01")
    return rows.select("pmid", "source_type", "source_url", "pmcid", "doi", "title", "publication_year")


@query(
    "merge_manifest",
    f"""WITH man AS (SELECT 'pmid_' || pmid AS source_key, pmid, lang AS source_type, '' AS notes FROM documents d JOIN source_document s ON s.id = d.doc_id WHERE pmid IS NOT NULL AND lang = 'en'),
      rec AS (SELECT s.id AS ord, s.pmid, source_type, title, coalesce(CAST(publication_year AS VARCHAR), '') AS y, {score_sql("title")} AS score FROM source_document s
        WHERE pmid IS NOT NULL AND pmid NOT IN (SELECT pmid FROM source_document WHERE pmid IS NOT NULL AND source_type = 'fr')),
      sel AS (SELECT * FROM rec ORDER BY score DESC, y DESC, pmid DESC LIMIT 500)
      SELECT source_key, pmid, source_type, notes FROM man
      UNION ALL SELECT 'pubmed_discovery_' || pmid, pmid, source_type, 'scan; score=' || score || '; ' || title FROM sel WHERE pmid NOT IN (SELECT pmid FROM man)""",
)
def _(spark, sf_dir):
    sources = evidence_tables(spark, sf_dir)["source_document"]
    manifest = sources.filter("pmid IS NOT NULL AND source_type = 'en'").select(
        F.concat(F.lit("pmid_"), F.col("pmid")).alias("source_key"), "pmid", "source_type", F.lit("").alias("notes")
    )
    records = sources.select(
        F.col("id").alias("ord"), "pmid", "source_type", "title", F.lit("scan").alias("query_label"), F.col("publication_year").cast("string").alias("pubdate")
    )
    selected = io.discover_sources(records, sources.filter("source_type = 'fr'"), 500, WEIGHTS)
    return io.merge_manifest(manifest, selected)


@query(
    "source_manifest",
    r"""SELECT CASE WHEN coalesce(pmid, '') <> '' THEN 'pmid_' || pmid ELSE 'source_' || id END AS source_key, coalesce(pmid, '') AS pmid, source_type, reuse_category, license_status,
      'candidate_pool' AS priority, substr(concat_ws('; ', nullif(regexp_replace(replace(title, chr(10), ' '), '^\s+|\s+$', '', 'g'), ''), nullif(journal_or_agency, ''),
      CAST(publication_year AS VARCHAR)), 1, 600) AS notes FROM source_document""",
)
def _(spark, sf_dir):
    return io.source_manifest(evidence_tables(spark, sf_dir)["source_document"])


@query("protocol_snapshot", PROTOCOL_SQL)
def _(spark, sf_dir):
    import uuid

    path = f"{checkpoint_dir(spark)}/protocol_snapshot-{uuid.uuid4().hex}"
    return io.protocol_snapshot(spark, stats.protocol_counts(evidence_tables(spark, sf_dir)), path)


def _export_dir(spark) -> str:
    import uuid

    return f"{checkpoint_dir(spark)}/exports-{uuid.uuid4().hex}"


@query(
    "refresh_exports",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{form}' AS form, {_fingerprint_sql(t, True)}" for t in io.EXPORTED for form in ("csv", "json"))
    + " UNION ALL SELECT 'source_manifest', 'csv', count(*), NULL FROM source_document",
)
def _(spark, sf_dir):
    """Every exported table in both forms, by content, read from the published version."""
    out = _export_dir(spark)
    io.publish_exports(evidence_tables(spark, sf_dir), out)
    at = io.current_export(spark, out)
    marks = [
        io.table_fingerprint(io.read_export(spark, at, t, form)).select(F.lit(t).alias("table_name"), F.lit(form).alias("form"), "n", "hash_sum")
        for t in io.EXPORTED
        for form in ("csv", "json")
    ]
    listed = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{at}/source_manifest_csv")
    count = listed.agg(F.count("*").alias("n")).select(F.lit("source_manifest").alias("table_name"), F.lit("csv").alias("form"), "n", F.lit(None).cast("string").alias("hash_sum"))
    return reduce(DataFrame.unionByName, [*marks, count])


@query("read_jsonl", "SELECT id, pmid, evidence_domain, matched_terms, confidence_label FROM curation_candidate")
def _(spark, sf_dir):
    candidates = evidence_tables(spark, sf_dir)["curation_candidate"]
    out = _export_dir(spark)
    candidates.write.json(f"{out}/candidates")
    return io.read_jsonl(spark, f"{out}/candidates", candidates.schema).select("id", "pmid", "evidence_domain", "matched_terms", "confidence_label")
