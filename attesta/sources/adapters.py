"""Evidence-shaped tables derived from the generic test tables.

`evidence_tables(spark, sf_dir)` returns the ten tables of the data model as lazy DataFrames over the
parquet files. `ADAPTER_SQL` states the same tables as CTEs for the SQL checks, so an operator's query
and its check start from one definition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions.text import hash_bucket
from attesta.session import spread

RAW_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def raw_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table of long texts, spread over the task slots when its files are few."""
    return spread(raw_table(spark, sf_dir, name), key)


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _grade(flag: str) -> Column:
    return F.when(F.col(flag) == "A", "A").when(F.col(flag) == "R", "B").otherwise("C")


def _pmid(doc: Column) -> Column:
    return F.when(doc % 7 != 0, _text(doc + 10000))


def _doi(doc: Column) -> Column:
    return F.when(doc % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("10.1000/"), _text(doc)))


def line_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (order, line): the line items repeat some pairs."""
    flag = ["l_returnflag", "l_linestatus"]
    rest = ["l_partkey", "l_suppkey", "l_shipdate"]
    # One-letter flags are compared as code points: numeric minima stay in a hash aggregate.
    return (
        raw_table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(*[F.min(c).alias(c) for c in rest], *[F.min(F.ascii(c)).alias(c) for c in flag])
        .withColumns({c: F.char(F.col(c)) for c in flag})
    )


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_docs = raw_table(spark, sf_dir, "documents").agg(F.count("*")).scalar()
    key = F.col("l_orderkey")
    return line_unique(spark, sf_dir).select(
        (key * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_partkey").alias("molecule_id"),
        F.col("l_suppkey").alias("assay_id"),
        (key % n_docs).alias("source_document_id"),
        _grade("l_returnflag").alias("evidence_grade"),
        F.when(key % 2 == 0, "Results; paragraph 1").otherwise("Abstract").alias("source_location"),
        F.col("l_linenumber").alias("line"),
        F.col("l_suppkey"),
        F.col("l_linestatus"),
        _text(F.col("l_shipdate").cast("date")).alias("observed_on"),
    )


def _toxicity(facts: DataFrame) -> DataFrame:
    return facts.filter("line < 4").select(
        "id",
        "molecule_id",
        "assay_id",
        F.concat(F.lit("ep"), _text(F.col("l_suppkey") % 10)).alias("endpoint_name"),
        F.concat(F.lit("cat"), _text(F.col("l_suppkey") % 6)).alias("endpoint_category"),
        F.lit(1).alias("is_observed_experimental"),
        "source_document_id",
        "source_location",
        "evidence_grade",
        "observed_on",
    )


def _offtarget(facts: DataFrame) -> DataFrame:
    predicted = F.when(F.col("l_linestatus") == "O", 1).otherwise(0)
    return facts.filter("line >= 4").select(
        "id",
        "molecule_id",
        "assay_id",
        F.concat(F.lit("ot"), _text(F.col("l_suppkey") % 4)).alias("evidence_type"),
        F.when(F.col("l_suppkey") % 2 == 0, "seed").otherwise("").alias("match_type"),
        (1 - predicted).alias("is_observed_experimental"),
        predicted.alias("is_computational_prediction"),
        "source_document_id",
        "source_location",
        "evidence_grade",
        "observed_on",
    )


def _audit(toxicity: DataFrame, offtarget: DataFrame) -> DataFrame:
    def rows(df: DataFrame, table: str, audit_id: Column, decision: Column) -> DataFrame:
        return df.select(
            audit_id.alias("id"),
            F.lit(table).alias("entity_table"),
            F.col("id").alias("entity_id"),
            F.when(F.col("evidence_grade") == "A", "full_text").otherwise("abstract").alias("extraction_method"),
            F.lit("rule_scan_v1").alias("extractor_model_or_script"),
            F.lit("curator_verified").alias("validation_status"),
            decision.alias("curator_decision"),
            F.concat(F.lit("curator"), _text(F.col("id") % 3)).alias("curator_id"),
            F.concat(F.lit("note on "), _text("id")).alias("audit_note"),
            F.col("observed_on").alias("audited_at"),
        )

    eid = F.col("id")
    accept = F.lit("accept")
    return reduce(
        DataFrame.unionByName,
        [
            rows(toxicity, "toxicity_endpoint", eid * 2, F.when(eid % 10 == 3, "reject").otherwise(accept)),
            rows(offtarget.filter("evidence_grade <> 'C'"), "offtarget_evidence", eid * 2, accept),
            rows(toxicity.filter(eid % 10 == 1), "toxicity_endpoint", eid * 2 + 1, accept),
        ],
    )


def _splits(toxicity: DataFrame, offtarget: DataFrame) -> DataFrame:
    def rows(df: DataFrame, table: str, task: str) -> DataFrame:
        return df.filter("evidence_grade <> 'C'").select(
            "id",
            F.lit(task).alias("task_name"),
            F.lit(table).alias("entity_table"),
            F.col("id").alias("entity_id"),
            F.concat(
                F.lit("source:"), _text("source_document_id"), F.lit("|molecule:"), _text("molecule_id")
            ).alias("leakage_group"),
        )

    both = rows(toxicity, "toxicity_endpoint", "toxicity_safety").unionByName(
        rows(offtarget, "offtarget_evidence", "offtarget_safety")
    )
    bucket = hash_bucket("leakage_group")
    return both.select(
        "*",
        F.when(bucket < 70, "train").when(bucket < 85, "validation").otherwise("test").alias("split_name"),
        F.lit("grouped_hash").alias("split_strategy"),
        F.lit("v1").alias("version"),
    )


def _sources(documents: DataFrame) -> DataFrame:
    doc = F.col("doc_id")
    return documents.select(
        doc.alias("id"),
        F.col("lang").alias("source_type"),
        F.concat(F.lit("https://example.org/doc/"), _text(doc)).alias("source_url"),
        _pmid(doc).alias("pmid"),
        F.when(doc % 5 == 0, F.concat(F.lit("PMC"), _text(doc))).otherwise("").alias("pmcid"),
        _doi(doc).alias("doi"),
        F.regexp_extract("text", r"^[^.!?]*[.!?]?", 0).alias("title"),
        F.col("source").alias("journal_or_agency"),
        F.when(doc % 11 != 0, (2015 + doc % 10).cast("int")).alias("publication_year"),
        F.when(doc % 2 == 0, "open_access").otherwise("abstract_metadata_only").alias("license_status"),
        F.when(doc % 9 == 0, "query_linkout_only").otherwise("derived_annotations_only").alias("reuse_category"),
        F.lit("2024-01-01").alias("accessed_at"),
    )


def _molecules(part: DataFrame) -> DataFrame:
    key = F.col("p_partkey")
    sequence = F.upper(
        F.translate(F.substring(F.md5(_text(key)), 1, 20), "0123456789abcdef", "ACGTACGTACGTACGU")
    )
    return part.select(
        key.alias("id"),
        F.col("p_name").alias("canonical_name"),
        (key % 5).alias("modality_id"),
        F.when(key % 3 == 1, "").when(key % 3 == 2, F.col("p_brand")).alias("target_gene_symbol"),
        F.col("p_type").alias("disease_context"),
        F.lit("preclinical").alias("therapeutic_status"),
        _null().alias("sense_sequence"),
        _null().alias("antisense_sequence"),
        F.when(key % 4 == 0, sequence).alias("guide_sequence"),
        _null().alias("passenger_sequence"),
        _null().alias("seed_region"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("").alias("backbone_chemistry"),
        F.when(F.col("p_size") % 5 == 0, F.lower("p_brand")).alias("sugar_modification"),
        _null().alias("base_modification"),
        F.when(F.col("p_type") == "PROMO", "lnp carrier").otherwise("").alias("conjugate_delivery"),
        F.when(F.col("p_size") % 3 == 0, "curator_verified")
        .otherwise("needs_curator_sequence_curation")
        .alias("sequence_annotation_status"),
        F.when(F.col("p_size") % 4 == 0, "curator_verified")
        .otherwise("needs_curator_modification_curation")
        .alias("modification_annotation_status"),
        _null().alias("external_ids"),
    )


def _assays(supplier: DataFrame) -> DataFrame:
    key = F.col("s_suppkey")
    return supplier.select(
        key.alias("id"),
        F.concat(F.lit("assay"), _text(key % 4)).alias("assay_type"),
        F.when(F.col("s_nationkey") % 4 == 0, "").otherwise("mouse").alias("organism"),
        F.when(F.col("s_nationkey") % 3 == 0, "in vivo").alias("model_system"),
        _null().alias("cell_line_or_tissue"),
        F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("dose_value"),
        F.when(F.col("s_acctbal") > 0, "mg/kg").otherwise("").alias("dose_unit"),
        _null("double").alias("exposure_time_value"),
        F.when(key % 2 == 0, "h").otherwise("").alias("exposure_time_unit"),
    )


def _curation_base(orders: DataFrame, n_docs: Column) -> DataFrame:
    doc = F.col("source_document_id")
    return orders.withColumn("source_document_id", F.col("o_orderkey") % n_docs).select(
        F.col("o_orderkey").alias("id"),
        "source_document_id",
        _pmid(doc).alias("pmid"),
        _doi(doc).alias("doi"),
        F.when(F.col("o_orderstatus") == "F", "toxicity")
        .when(F.col("o_orderstatus") == "O", "offtarget")
        .otherwise("chemistry")
        .alias("evidence_domain"),
        F.when(F.col("o_custkey") % 3 == 0, "siRNA")
        .when(F.col("o_custkey") % 3 == 1, "ASO")
        .otherwise("ASO/siRNA")
        .alias("candidate_modality"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "B").otherwise("C").alias("suggested_evidence_grade"),
        "o_custkey",
        "o_orderstatus",
        "o_orderpriority",
        _text(F.col("o_orderdate").cast("date")).alias("created_at"),
    )


def _queue(base: DataFrame, sources: DataFrame) -> DataFrame:
    titles = sources.select(F.col("id").alias("source_document_id"), F.col("title").alias("source_title"), "source_type")
    urgent = F.col("o_orderpriority")
    return base.join(titles, "source_document_id").select(
        "id",
        "source_document_id",
        "pmid",
        "doi",
        "source_title",
        "source_type",
        "candidate_modality",
        "evidence_domain",
        F.concat(F.col("evidence_domain"), F.lit("_target")).alias("extraction_target"),
        "suggested_evidence_grade",
        F.when(urgent.isin("1-URGENT", "2-HIGH"), "high").when(urgent == "3-MEDIUM", "medium").otherwise("low").alias("priority"),
        F.lit("candidate").alias("queue_status"),
        F.lit("").alias("curator_id"),
        "created_at",
    )


def _candidates(base: DataFrame) -> DataFrame:
    urgent = F.col("o_orderpriority")
    terms = F.lower(F.concat_ws(";", urgent, "candidate_modality"))
    return base.select(
        "id",
        F.col("id").alias("queue_id"),
        "source_document_id",
        "pmid",
        "doi",
        "evidence_domain",
        "candidate_modality",
        F.when(F.col("o_custkey") % 5 == 0, "").otherwise("PubMed abstract sentence 2").alias("source_location"),
        terms.alias("matched_terms"),
        F.concat(F.col("evidence_domain"), F.lit(" candidate; matched derived terms: "), terms).alias("candidate_signal"),
        "suggested_evidence_grade",
        F.when(urgent.isin("1-URGENT", "2-HIGH"), "high_candidate")
        .when(urgent == "3-MEDIUM", "medium_candidate")
        .otherwise("low_candidate")
        .alias("confidence_label"),
        F.lit("rule_scan_v1").alias("extraction_method"),
        F.lit("candidate_needs_curator_review").alias("validation_status"),
        F.when(F.col("o_custkey") % 10 == 0, "accept")
        .when(F.col("o_custkey") % 4 == 1, "reject")
        .otherwise("pending")
        .alias("curator_decision"),
        F.when(F.col("o_custkey") % 50 == 7, "full_text").otherwise("derived_annotations_only").alias("redistribution_level"),
        "created_at",
    )


class LazyTables(Mapping):
    """Tables by name, each DataFrame built on first use: a query plans only what it reads."""

    def __init__(self, builders: dict[str, Callable[[LazyTables], DataFrame]]):
        self._builders = builders
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name](self)
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return (n for n in self._builders if not n.startswith("_"))

    def __len__(self) -> int:
        return sum(1 for _ in self)


def _modalities(region: DataFrame) -> DataFrame:
    return region.select(
        F.col("r_regionkey").cast("bigint").alias("id"),
        F.col("r_name").alias("name"),
        F.when(F.col("r_regionkey") < 3, 1).otherwise(0).alias("in_core_scope"),
        F.lit("").alias("scope_note"),
    )


def evidence_tables(spark: SparkSession, sf_dir: str) -> LazyTables:
    """The ten tables over the parquet files of `sf_dir`; nothing is read until an action runs."""

    def raw(name: str) -> DataFrame:
        return raw_table(spark, sf_dir, name)

    return LazyTables(
        {
            "_facts": lambda t: _facts(spark, sf_dir),
            "_curation": lambda t: _curation_base(raw("orders"), raw("documents").agg(F.count("*")).scalar()),
            "source_document": lambda t: _sources(raw("documents")),
            "modality": lambda t: _modalities(raw("region")),
            "molecule": lambda t: _molecules(raw("part")),
            "assay": lambda t: _assays(raw("supplier")),
            "toxicity_endpoint": lambda t: _toxicity(t["_facts"]),
            "offtarget_evidence": lambda t: _offtarget(t["_facts"]),
            "curation_audit": lambda t: _audit(t["toxicity_endpoint"], t["offtarget_evidence"]),
            "benchmark_split": lambda t: _splits(t["toxicity_endpoint"], t["offtarget_evidence"]),
            "curation_queue": lambda t: _queue(t["_curation"], t["source_document"]),
            "curation_candidate": lambda t: _candidates(t["_curation"]),
        }
    )


ADAPTER_SQL = r"""
line_unique AS (
  SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey,
         min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus, min(l_shipdate) AS l_shipdate
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
facts AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS molecule_id, l_suppkey AS assay_id,
         l_orderkey % (SELECT count(*) FROM documents) AS source_document_id,
         CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'R' THEN 'B' ELSE 'C' END AS evidence_grade,
         CASE WHEN l_orderkey % 2 = 0 THEN 'Results; paragraph 1' ELSE 'Abstract' END AS source_location,
         l_linenumber AS line, l_suppkey, l_linestatus,
         CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS observed_on
  FROM line_unique),
toxicity_endpoint AS (
  SELECT id, molecule_id, assay_id, 'ep' || (l_suppkey % 10) AS endpoint_name,
         'cat' || (l_suppkey % 6) AS endpoint_category, 1 AS is_observed_experimental,
         source_document_id, source_location, evidence_grade, observed_on
  FROM facts WHERE line < 4),
offtarget_evidence AS (
  SELECT id, molecule_id, assay_id, 'ot' || (l_suppkey % 4) AS evidence_type,
         CASE WHEN l_suppkey % 2 = 0 THEN 'seed' ELSE '' END AS match_type,
         CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS is_observed_experimental,
         CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS is_computational_prediction,
         source_document_id, source_location, evidence_grade, observed_on
  FROM facts WHERE line >= 4),
audit_rows AS (
  SELECT id * 2 AS id, 'toxicity_endpoint' AS entity_table, id AS entity_id, evidence_grade, observed_on,
         CASE WHEN id % 10 = 3 THEN 'reject' ELSE 'accept' END AS curator_decision FROM toxicity_endpoint
  UNION ALL SELECT id * 2, 'offtarget_evidence', id, evidence_grade, observed_on, 'accept'
  FROM offtarget_evidence WHERE evidence_grade <> 'C'
  UNION ALL SELECT id * 2 + 1, 'toxicity_endpoint', id, evidence_grade, observed_on, 'accept'
  FROM toxicity_endpoint WHERE id % 10 = 1),
curation_audit AS (
  SELECT id, entity_table, entity_id,
         CASE WHEN evidence_grade = 'A' THEN 'full_text' ELSE 'abstract' END AS extraction_method,
         'rule_scan_v1' AS extractor_model_or_script, 'curator_verified' AS validation_status,
         curator_decision, 'curator' || (entity_id % 3) AS curator_id,
         'note on ' || entity_id AS audit_note, observed_on AS audited_at
  FROM audit_rows),
split_rows AS (
  SELECT id, 'toxicity_safety' AS task_name, 'toxicity_endpoint' AS entity_table, id AS entity_id,
         'source:' || source_document_id || '|molecule:' || molecule_id AS leakage_group
  FROM toxicity_endpoint WHERE evidence_grade <> 'C'
  UNION ALL
  SELECT id, 'offtarget_safety', 'offtarget_evidence', id,
         'source:' || source_document_id || '|molecule:' || molecule_id
  FROM offtarget_evidence WHERE evidence_grade <> 'C'),
benchmark_split AS (
  SELECT *, CASE WHEN b < 70 THEN 'train' WHEN b < 85 THEN 'validation' ELSE 'test' END AS split_name,
         'grouped_hash' AS split_strategy, 'v1' AS version
  FROM (SELECT *, ('0x' || substr(sha256(leakage_group), 1, 8))::BIGINT % 100 AS b FROM split_rows)),
modality AS (
  SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name,
         CASE WHEN r_regionkey < 3 THEN 1 ELSE 0 END AS in_core_scope, '' AS scope_note FROM region),
molecule AS (
  SELECT p_partkey AS id, p_name AS canonical_name, p_partkey % 5 AS modality_id,
         CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN '' ELSE p_brand END AS target_gene_symbol,
         p_type AS disease_context, 'preclinical' AS therapeutic_status,
         CAST(NULL AS VARCHAR) AS sense_sequence, CAST(NULL AS VARCHAR) AS antisense_sequence,
         CASE WHEN p_partkey % 4 = 0 THEN upper(translate(substr(md5(CAST(p_partkey AS VARCHAR)), 1, 20),
              '0123456789abcdef', 'ACGTACGTACGTACGU')) ELSE NULL END AS guide_sequence,
         CAST(NULL AS VARCHAR) AS passenger_sequence, CAST(NULL AS VARCHAR) AS seed_region,
         CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS backbone_chemistry,
         CASE WHEN p_size % 5 = 0 THEN lower(p_brand) ELSE NULL END AS sugar_modification,
         CAST(NULL AS VARCHAR) AS base_modification,
         CASE WHEN p_type = 'PROMO' THEN 'lnp carrier' ELSE '' END AS conjugate_delivery,
         CASE WHEN p_size % 3 = 0 THEN 'curator_verified' ELSE 'needs_curator_sequence_curation' END
           AS sequence_annotation_status,
         CASE WHEN p_size % 4 = 0 THEN 'curator_verified' ELSE 'needs_curator_modification_curation' END
           AS modification_annotation_status,
         CAST(NULL AS VARCHAR) AS external_ids
  FROM part),
source_document AS (
  SELECT doc_id AS id, lang AS source_type, 'https://example.org/doc/' || doc_id AS source_url,
         CASE WHEN doc_id % 7 = 0 THEN NULL ELSE CAST(10000 + doc_id AS VARCHAR) END AS pmid,
         CASE WHEN doc_id % 5 = 0 THEN 'PMC' || doc_id ELSE '' END AS pmcid,
         CASE WHEN doc_id % 3 = 0 THEN '' ELSE '10.1000/' || doc_id END AS doi,
         regexp_extract(text, '^[^.!?]*[.!?]?') AS title, source AS journal_or_agency,
         CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(2015 + doc_id % 10 AS INT) END AS publication_year,
         CASE WHEN doc_id % 2 = 0 THEN 'open_access' ELSE 'abstract_metadata_only' END AS license_status,
         CASE WHEN doc_id % 9 = 0 THEN 'query_linkout_only' ELSE 'derived_annotations_only' END AS reuse_category,
         '2024-01-01' AS accessed_at
  FROM documents),
assay AS (
  SELECT s_suppkey AS id, 'assay' || (s_suppkey % 4) AS assay_type,
         CASE WHEN s_nationkey % 4 = 0 THEN '' ELSE 'mouse' END AS organism,
         CASE WHEN s_nationkey % 3 = 0 THEN 'in vivo' END AS model_system,
         CAST(NULL AS VARCHAR) AS cell_line_or_tissue,
         CASE WHEN s_acctbal > 0 THEN s_acctbal END AS dose_value,
         CASE WHEN s_acctbal > 0 THEN 'mg/kg' ELSE '' END AS dose_unit,
         CAST(NULL AS DOUBLE) AS exposure_time_value,
         CASE WHEN s_suppkey % 2 = 0 THEN 'h' ELSE '' END AS exposure_time_unit
  FROM supplier),
curation_base AS (
  SELECT *, CASE WHEN sid % 7 = 0 THEN NULL ELSE CAST(10000 + sid AS VARCHAR) END AS pmid,
         CASE WHEN sid % 3 = 0 THEN '' ELSE '10.1000/' || sid END AS doi,
         CASE o_orderstatus WHEN 'F' THEN 'toxicity' WHEN 'O' THEN 'offtarget' ELSE 'chemistry' END AS evidence_domain,
         CASE o_custkey % 3 WHEN 0 THEN 'siRNA' WHEN 1 THEN 'ASO' ELSE 'ASO/siRNA' END AS candidate_modality,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'B' ELSE 'C' END AS suggested_evidence_grade,
         CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS created_at
  FROM (SELECT *, o_orderkey % (SELECT count(*) FROM documents) AS sid FROM orders)),
curation_queue AS (
  SELECT o_orderkey AS id, sid AS source_document_id, b.pmid, b.doi, title AS source_title, source_type,
         candidate_modality, evidence_domain, evidence_domain || '_target' AS extraction_target,
         suggested_evidence_grade,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN o_orderpriority = '3-MEDIUM' THEN 'medium'
              ELSE 'low' END AS priority,
         'candidate' AS queue_status, '' AS curator_id, created_at
  FROM curation_base b JOIN source_document s ON s.id = b.sid),
curation_candidate AS (
  SELECT o_orderkey AS id, o_orderkey AS queue_id, sid AS source_document_id, pmid, doi, evidence_domain,
         candidate_modality,
         CASE WHEN o_custkey % 5 = 0 THEN '' ELSE 'PubMed abstract sentence 2' END AS source_location,
         lower(o_orderpriority || ';' || candidate_modality) AS matched_terms,
         evidence_domain || ' candidate; matched derived terms: ' || lower(o_orderpriority || ';' || candidate_modality)
           AS candidate_signal,
         suggested_evidence_grade,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high_candidate'
              WHEN o_orderpriority = '3-MEDIUM' THEN 'medium_candidate' ELSE 'low_candidate' END AS confidence_label,
         'rule_scan_v1' AS extraction_method, 'candidate_needs_curator_review' AS validation_status,
         CASE WHEN o_custkey % 10 = 0 THEN 'accept' WHEN o_custkey % 4 = 1 THEN 'reject' ELSE 'pending' END
           AS curator_decision,
         CASE WHEN o_custkey % 50 = 7 THEN 'full_text' ELSE 'derived_annotations_only' END AS redistribution_level,
         created_at
  FROM curation_base)
""".strip()
