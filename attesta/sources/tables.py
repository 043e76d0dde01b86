"""Reading, publishing and maintaining the tables: typed loads, release-scoped dumps, manifests, templates."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions.text import (
    CONFIDENCE_RANK,
    has_text,
    null_if_blank,
    rank_of,
    strip,
    text_or_empty,
    title_score,
    year_from_pubdate,
)
from attesta.lexicons import CONTEXT_SOURCE_TYPES, CORE_SOURCE_TYPES, TITLE_WEIGHTS
from attesta.operators.release import Tables, in_scope
from attesta.operators.stats import release_audits
from attesta.operators.windows import best_by_score, first_occurrence
from attesta.sources.schema import LATE_MOLECULE_COLUMNS, TABLES


def blank_to_null(df: DataFrame) -> DataFrame:
    """'' becomes NULL in every string column."""
    return df.select(
        *[null_if_blank(f.name).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema]
    )


def read_csv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """`multi_line` is for files whose quoted texts hold line ends; such a file cannot be read in parts."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", "")
        .option("emptyValue", "")
        .csv(path)
    )


def load_table(spark: SparkSession, path: str | list[str], schema: T.StructType, form: str | None = None, multi_line: bool = False) -> DataFrame:
    """Typed load of CSV, JSON-lines or parquet files or folders, several per table; '' is read as NULL.

    `form` is csv, json or parquet; without it the ending tells. A file without a column of the schema gets NULL there.
    """

    def one(p: str) -> DataFrame:
        kind = form or ("csv" if p.endswith((".csv", ".csv.gz")) else "json" if p.endswith((".json", ".jsonl")) else "parquet")
        if kind == "csv":
            return read_csv(spark, p, schema, multi_line)
        if kind == "json":
            return spark.read.schema(schema).json(p)
        found = spark.read.parquet(p)
        return found.select(
            *[
                (F.col(f.name).cast(f.dataType) if f.name in found.columns else F.lit(None).cast(f.dataType)).alias(f.name)
                for f in schema
            ]
        )

    parts = [path] if isinstance(path, str) else path
    return blank_to_null(reduce(DataFrame.unionByName, [one(p) for p in parts]))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def add_missing_columns(df: DataFrame, specs: dict[str, str] = LATE_MOLECULE_COLUMNS) -> DataFrame:
    """Add absent columns with their defaults; present columns are left alone."""
    absent = {name: F.lit(default) for name, default in specs.items() if name not in df.columns}
    return df.withColumns(absent) if absent else df


SCOPED_TABLES = {"source_document": "source", "molecule": "molecule", "assay": "assay"}


def publish_table(tables: Tables, name: str) -> DataFrame:
    """The published rows of a table: release-scoped for sources, molecules, assays and audits, else all."""
    if name in SCOPED_TABLES:
        return in_scope(tables, SCOPED_TABLES[name])
    if name == "curation_audit":
        return release_audits(tables)
    return tables[name]


def publish_manifest_filter(manifest: DataFrame, column: str, keys: list[str] | DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Manifest rows with a public key, public columns only; keys are a short list or a table of ids."""
    if isinstance(keys, DataFrame):
        key = keys.columns[0]
        kept = manifest.join(keys.select(F.col(key).alias("_k")), F.col(column) == F.col("_k"), "left_semi")
    else:
        kept = manifest.filter(text_or_empty(column).isin(keys))
    return kept.select(*cols) if cols else kept


def _type_tag(kind: T.DataType) -> str:
    """One letter for the kind of a value, so that 1 and '1' differ."""
    tags = {T.StringType: "s", T.BooleanType: "b", T.FloatType: "f", T.DoubleType: "f", T.DecimalType: "f", T.BinaryType: "x", T.ByteType: "i", T.ShortType: "i", T.IntegerType: "i", T.LongType: "i"}
    return tags.get(type(kind), "j" if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else "o")


def row_code(df: DataFrame, cols: list[str]) -> Column:
    """A text that no other row of values has: each value with the letter of its kind and its length, `n` for null."""

    def said(name: str) -> Column:
        column, kind = F.col(f"`{name}`"), df.schema[name].dataType
        tag = _type_tag(kind)
        text = F.to_json(F.struct(column)) if tag == "j" else F.hex(column) if tag == "x" else column.cast("string")
        return F.coalesce(F.when(column.isNotNull(), F.concat(F.lit(tag), F.octet_length(text).cast("string"), F.lit(":"), text)), F.lit("n"))

    return F.concat(*[said(c) for c in cols])


def table_fingerprint(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(n, hash_sum): row count, and the sums of both 64-bit halves of the rows' hashes.

    Sums commute, so neither the order nor the partitioning of rows matters, and repeated rows count; tables can be
    fingerprinted in parts and added up.
    """
    word = F.md5(row_code(df, cols or df.columns))
    halves = [F.coalesce(F.sum(F.conv(F.substring(word, at, 16), 16, 10).cast("decimal(20,0)").cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").cast("string") for at in (1, 17)]
    return df.agg(F.count("*").alias("n"), F.concat_ws(":", *halves).alias("hash_sum"))


def export_review_template(candidates: DataFrame) -> DataFrame:
    """Candidates as blank review rows, the most confident first."""
    domain = F.col("evidence_domain")
    target = (
        F.when(domain == "toxicity", "toxicity_endpoint")
        .when(domain == "offtarget", "offtarget_evidence")
        .otherwise("curation_audit_only")
    )
    blank = F.lit("")
    return (
        candidates.orderBy(rank_of("confidence_label", CONFIDENCE_RANK, 2), "id")
        .select(
            F.col("id").alias("candidate_id"),
            "queue_id",
            *[text_or_empty(c).alias(c) for c in "pmid doi evidence_domain candidate_modality source_location matched_terms confidence_label".split()],
            F.lit("pending").alias("curator_decision"),
            target.alias("verified_entity_table"),
            blank.alias("source_location_verified"),
            blank.alias("evidence_grade"),
            F.lit("candidate_needs_curator_review").alias("validation_status"),
            blank.alias("audit_note"),
        )
    )


def sequence_curation_template(molecule: DataFrame, modality: DataFrame, now: str = "") -> DataFrame:
    """Molecules with their annotations and blank review columns."""
    names = modality.select(F.col("id").alias("modality_id"), F.col("name").alias("modality"))
    kept = (
        "canonical_name modality target_gene_symbol disease_context therapeutic_status sense_sequence "
        "antisense_sequence guide_sequence passenger_sequence seed_region backbone_chemistry sugar_modification "
        "base_modification conjugate_delivery sequence_annotation_status modification_annotation_status"
    ).split()
    blanks = "source_pmid source_doi source_url source_location_verified curator_decision reviewer_note".split()
    return molecule.join(names, "modality_id").select(
        F.col("id").alias("molecule_id"),
        *kept,
        *[F.lit("").alias(c) for c in blanks],
        F.lit("needs_curator_verification").alias("validation_status"),
        F.lit(now).alias("updated_at"),
    )


# Columns taken from a checkpoint, and the flag a full-text anchor clears.
CHECKPOINT_COLUMNS = (
    "pmc_full_text_available fetch_status article_type pmc_license proposed_source_location source_anchor_hash "
    "machine_matched_terms candidate_source_location"
).split()
NO_ANCHOR_FLAG = "no_machine_full_text_anchor"


def without_flag(flags: Column, flag: str) -> Column:
    """A `; `-joined flag list without one flag."""
    return F.array_join(F.filter(F.split(flags, "; "), lambda f: (f != flag) & (f != "")), "; ")


def overlay_checkpoint(rows: DataFrame, checkpoint: DataFrame, key: str = "candidate_id", cols: list[str] = CHECKPOINT_COLUMNS) -> DataFrame:
    """Where the checkpoint has an anchor for a row, take its columns and clear the no-anchor flag."""
    present = [c for c in cols if c in checkpoint.columns]
    anchored = checkpoint.filter(has_text("source_anchor_hash")).select(
        key, *[F.col(c).alias(f"_c_{c}") for c in present], F.lit(True).alias("_hit")
    )
    joined = rows.join(anchored, key, "left")
    hit = F.coalesce("_hit", F.lit(False))
    changed = {c: F.when(hit, F.col(f"_c_{c}")).otherwise(F.col(c) if c in rows.columns else F.lit("")) for c in present}
    changed["risk_flags"] = F.when(hit, without_flag(text_or_empty("risk_flags"), NO_ANCHOR_FLAG)).otherwise(F.col("risk_flags"))
    out = joined.withColumns(changed)
    return out.drop("_hit", *[f"_c_{c}" for c in present])


REDO_STATES = ["", "PENDING_RERUN", "llm_error"]  # fixed values: decisions that are tried again


def resume_anti(rows: DataFrame, done: DataFrame, key: str, redo_states: list[str] = REDO_STATES, decision: str = "decision") -> DataFrame:
    """Rows not yet decided; blank and failed decisions count as undecided."""
    decided = done.filter(~text_or_empty(decision).isin(redo_states)).select(key)
    return rows.join(decided, key, "left_anti")


def ingest_sources(candidates: DataFrame, seed: DataFrame, metadata: DataFrame, now: str, arrival: str = "ord") -> DataFrame:
    """New source rows: first candidate per pmid that the seed lacks, with fetched metadata.

    Candidates without metadata are dropped. Ids are hashes of the pmid, so no counter is needed.
    """
    fresh = candidates.filter(has_text("pmid")).join(seed.filter(has_text("pmid")).select("pmid"), "pmid", "left_anti")
    first = first_occurrence(fresh, "pmid", [F.asc(arrival)])
    return first.join(metadata, "pmid").select(
        F.xxhash64("pmid").alias("id"),
        "source_type",
        F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), F.col("pmid"), F.lit("/")).alias("source_url"),
        "pmid",
        F.regexp_replace(text_or_empty("pmcid"), "pmc-id: |;", "").alias("pmcid"),
        text_or_empty("doi").alias("doi"),
        text_or_empty("title").alias("title"),
        text_or_empty("journal").alias("journal_or_agency"),
        year_from_pubdate("pubdate", "blanks").alias("publication_year"),
        "license_status",
        "reuse_category",
        F.lit(now).alias("accessed_at"),
    )


def discover_sources(records: DataFrame, known: DataFrame, n: int, weights: dict[str, int] = TITLE_WEIGHTS, arrival: str = "ord") -> DataFrame:
    """Records whose pmid is unknown, scored by title; the best per pmid, then the n best."""
    fresh = records.filter(has_text("pmid")).join(known.filter(has_text("pmid")).select("pmid"), "pmid", "left_anti")
    scored = fresh.withColumns(
        {"score": title_score("title", weights), "publication_year": text_or_empty(year_from_pubdate("pubdate"))}
    )
    return best_by_score(scored, "pmid", "score", n, arrival)


def merge_manifest(manifest: DataFrame, selected: DataFrame) -> DataFrame:
    """The manifest plus selected discoveries whose key and pmid it does not hold."""
    new = selected.withColumns(
        {
            "source_key": F.concat(F.lit("pubmed_discovery_"), F.col("pmid")),
            "notes": F.format_string("%s; score=%s; %s", "query_label", "score", "title"),
        }
    )
    fresh = new.join(manifest.select("source_key"), "source_key", "left_anti").join(
        manifest.filter(has_text("pmid")).select("pmid"), "pmid", "left_anti"
    )
    return manifest.unionByName(fresh.select(*manifest.columns))


def source_manifest(sources: DataFrame) -> DataFrame:
    """One manifest row per source with its priority class and a short note."""
    kind = text_or_empty("source_type")
    pmid = text_or_empty("pmid")
    priority = F.when(kind.isin(CORE_SOURCE_TYPES), "core").when(kind.isin(CONTEXT_SOURCE_TYPES), "context").otherwise("candidate_pool")
    title = strip(F.regexp_replace(text_or_empty("title"), "\n", " "))
    parts = [null_if_blank(title), null_if_blank(strip(text_or_empty("journal_or_agency"))), null_if_blank(strip(text_or_empty("publication_year")))]
    return sources.select(
        F.when(pmid != "", F.concat(F.lit("pmid_"), pmid)).otherwise(F.concat(F.lit("source_"), F.col("id").cast("string"))).alias("source_key"),
        pmid.alias("pmid"),
        kind.alias("source_type"),
        text_or_empty("reuse_category").alias("reuse_category"),
        text_or_empty("license_status").alias("license_status"),
        priority.alias("priority"),
        # A note is a label of at most 600 characters by definition of the manifest.
        F.substring(F.concat_ws("; ", *parts), 1, 600).alias("notes"),
    )


def protocol_snapshot(spark: SparkSession, counts: DataFrame, path: str) -> DataFrame:
    """Write the protocol counts to `path` and return the stored copy."""
    counts.coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


EXPORTED = ("source_document", "curation_queue", "curation_candidate")


def read_export(spark: SparkSession, version: str, name: str, form: str) -> DataFrame:
    """One exported table of a version folder, typed, blank as null."""
    path = f"{version}/{name}_{form}"
    table = read_csv(spark, path, TABLES[name], multi_line=True) if form == "csv" else read_jsonl(spark, path, TABLES[name])
    return blank_to_null(table)


def current_export(spark: SparkSession, out_dir: str) -> str:
    """The version folder that was published last."""
    return spark.read.schema("version string").json(f"{out_dir}/current").first()["version"]


def refresh_exports(tables: Tables, out_dir: str, names: list[str] | None = None) -> None:
    """Write the curation tables as CSV and JSON lines, and the source manifest as CSV, in place and gzipped; one job per file set."""
    for name in names or EXPORTED:
        tables[name].write.mode("overwrite").option("header", True).option("escape", '"').option("compression", "gzip").csv(f"{out_dir}/{name}_csv")
        tables[name].write.mode("overwrite").option("compression", "gzip").json(f"{out_dir}/{name}_json")
    manifest = source_manifest(tables["source_document"])
    manifest.write.mode("overwrite").option("header", True).option("escape", '"').option("compression", "gzip").csv(f"{out_dir}/source_manifest_csv")


def publish_exports(tables: Tables, out_dir: str, names: list[str] | None = None) -> str:
    """Publish the curation tables as CSV and JSON lines, and the source manifest as CSV, gzipped; the new version's folder.

    Files are written beside the published ones, read again and compared with the tables by content; only then the
    entry `current` names the new version. A run that fails before leaves the published version whole.
    """
    spark = tables["source_document"].sparkSession
    version = f"{out_dir}/version-{uuid.uuid4().hex}"
    marks = []
    for name in names or EXPORTED:
        table = tables[name].select(*[f.name for f in TABLES[name].fields])
        table.write.option("header", True).option("escape", '"').option("compression", "gzip").csv(f"{version}/{name}_csv")
        table.write.option("compression", "gzip").json(f"{version}/{name}_json")
        forms = {"table": blank_to_null(table)} | {form: read_export(spark, version, name, form) for form in ("csv", "json")}
        marks += [table_fingerprint(df).select(F.lit(name).alias("name"), F.lit(form).alias("form"), "n", "hash_sum") for form, df in forms.items()]
    source_manifest(tables["source_document"]).write.option("header", True).option("escape", '"').option("compression", "gzip").csv(f"{version}/source_manifest_csv")
    unequal = reduce(DataFrame.unionByName, marks).groupBy("name").agg(F.count_distinct("n", "hash_sum").alias("kinds")).where("kinds > 1")
    wrong = [r["name"] for r in unequal.collect()]  # one row per exported table
    if wrong:
        raise ValueError(f"exports differ from their tables: {sorted(wrong)}")
    spark.createDataFrame([(version,)], "version string").write.mode("overwrite").json(f"{out_dir}/current")
    return version


def table_schema(name: str) -> T.StructType:
    return TABLES[name]


