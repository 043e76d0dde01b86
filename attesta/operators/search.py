"""Filters, listings, search and question answering over the release and the curation tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.queries import (
    any_field_contains,
    field_values,
    groups_or_raw,
    query_terms,
    search_condition,
)
from attesta.functions.text import (
    CONFIDENCE_RANK,
    PRIORITY_RANK,
    contains_any,
    contains_ci,
    first_text,
    has_text,
    joined_lower,
    let,
    rank_of,
    text_or_empty,
)
from attesta.lexicons import (
    GRADE_TEXT,
    QUESTION_NON_TARGETS,
    QUESTION_OFFTARGET_WORDS,
    QUESTION_TERMS,
    QUESTION_TOXICITY_WORDS,
    SEARCH_STOPWORDS,
    SEARCH_SYNONYMS,
    QuestionTerm,
)
from attesta.operators.joins import VERIFIED_ACCEPT, source_or_join
from attesta.operators.release import Tables, by_dimension, evidence_tables, holding, in_scope
from attesta.operators.spelling import SpellingIndex, signed_rows, spellings_of
from attesta.operators.stats import CLASS_RELEASE_FIELDS, offtarget_class
from attesta.operators.windows import first_occurrence, top_per_group
from attesta.session import store

# The fields each search looks into.
EVIDENCE_FIELDS = (
    "canonical_name category evidence_label target_gene_symbol disease_context backbone_chemistry "
    "sugar_modification base_modification conjugate_delivery modality source_location source_title pmid doi"
).split()
SOURCE_FIELDS = "title journal_or_agency doi pmid source_type".split()
MOLECULE_FIELDS = (
    "canonical_name modality target_gene_symbol disease_context therapeutic_status backbone_chemistry "
    "sugar_modification base_modification conjugate_delivery"
).split()
AUDIT_FIELDS = "entity_table extraction_method validation_status curator_decision curator_id".split()
QUEUE_FIELDS = "source_title pmid doi candidate_modality evidence_domain extraction_target".split()
CANDIDATE_FIELDS = "candidate_signal matched_terms pmid source_title".split()
CANDIDATE_SEARCH_FIELDS = (
    "candidate_signal matched_terms pmid doi candidate_modality source_location source_title"
).split()
TOXICITY_SEARCH_FIELDS = (
    "evidence_label category source_location canonical_name modality target_gene_symbol disease_context "
    "backbone_chemistry sugar_modification base_modification conjugate_delivery source_title pmid doi"
).split()
OFFTARGET_SEARCH_FIELDS = (
    "category match_type source_location canonical_name modality target_gene_symbol disease_context "
    "backbone_chemistry sugar_modification base_modification conjugate_delivery source_title pmid doi"
).split()


def limit_clamp(raw: object, default: int = 250, maximum: int = 1000) -> int:
    """A row limit from user input: the default when it is no integer, else within 1..maximum."""
    try:
        wanted = int(str(raw).strip())
    except ValueError:
        return default
    return max(1, min(wanted, maximum))


def _equal_filters(df: DataFrame, **wanted: str | None) -> DataFrame:
    for column, value in wanted.items():
        if value:
            df = df.filter(F.col(column) == value)
    return df


def evidence_filter(
    view: DataFrame,
    domain: str | None = None,
    grade: str | None = None,
    modality: str | None = None,
    category: str | None = None,
    target: str | None = None,
    q: str | None = None,
    limit: int | None = 250,
    synonyms: dict[str, list[str]] = SEARCH_SYNONYMS,
    stopwords: list[str] = SEARCH_STOPWORDS,
) -> DataFrame:
    """Release rows by exact fields, target substring and synonym search, in published order."""
    out = _equal_filters(view, evidence_domain=domain, evidence_grade=grade, modality=modality, category=category)
    if target:
        out = out.filter(contains_ci("target_gene_symbol", target))
    if q:
        out = out.filter(search_condition(EVIDENCE_FIELDS, q, synonyms, stopwords))
    out = out.orderBy(F.desc("evidence_domain"), F.asc("evidence_id"))
    return out if limit is None else out.limit(limit)


def raw_count(
    view: DataFrame,
    domain: str | None = None,
    grade: str | None = None,
    modality: str | None = None,
    category: str | None = None,
    target: str | None = None,
    q: str | None = None,
) -> DataFrame:
    """Release rows by exact fields and the raw query text, without synonyms."""
    out = _equal_filters(view, evidence_domain=domain, evidence_grade=grade, modality=modality, category=category)
    if target:
        out = out.filter(contains_ci("target_gene_symbol", target))
    if q:
        out = out.filter(any_field_contains(EVIDENCE_FIELDS, q))
    return out.agg(F.count("*").alias("n"))


def synonym_search(
    df: DataFrame,
    fields: list[str],
    queries: DataFrame,
    row_columns: list[str],
    synonyms: dict[str, list[str]] = SEARCH_SYNONYMS,
    stopwords: list[str] = SEARCH_STOPWORDS,
) -> DataFrame:
    """Search for a table of queries (query_id, q): one output row per (query, matching row)."""
    parsed = queries.select("query_id", groups_or_raw("q", query_terms("q", synonyms, stopwords)).alias("_groups"))
    signed = signed_rows(df.select(*dict.fromkeys([*row_columns, *fields])), [field_values(part) for part in by_dimension(fields)], spellings_of(parsed, "_groups"))
    return SpellingIndex(store(signed.select("_sig", "found", *row_columns))).rows_of(parsed, "query_id", "_groups", row_columns)


def synonym_counts(
    df: DataFrame, fields: list[str], queries: DataFrame, synonyms: dict[str, list[str]] = SEARCH_SYNONYMS, stopwords: list[str] = SEARCH_STOPWORDS,
    among: Sequence[DataFrame] = (),
) -> DataFrame:
    """Matching rows per query as (query_id, hits), without queries that match none: rows are counted by signature before they meet queries.

    `among` are tables that hold all values of the rows by dimension (`dimension_rows`); with them the rows are read once.
    """
    parsed = queries.select("query_id", groups_or_raw("q", query_terms("q", synonyms, stopwords)).alias("_groups"))
    parts = by_dimension(fields)
    signed = signed_rows(df.select(*fields), [field_values(part) for part in parts], spellings_of(parsed, "_groups"), among=holding(parts, among))
    counted = signed.groupBy("_sig").agg(F.first("found").alias("found"), F.count(F.lit(1)).alias("_rows"))
    return SpellingIndex(store(counted)).rows_of(parsed, "query_id", "_groups", ["_rows"]).groupBy("query_id").agg(F.sum("_rows").alias("hits"))


def list_sources(
    tables: Tables, q: str | None = None, source_type: str | None = None, year: str | None = None, limit: int = 250,
    synonyms: dict[str, list[str]] = SEARCH_SYNONYMS,
) -> DataFrame:
    out = _equal_filters(in_scope(tables, "source"), source_type=source_type)
    if year:
        out = out.filter(F.col("publication_year").cast("string") == year)
    if q:
        out = out.filter(search_condition(SOURCE_FIELDS, q, synonyms))
    columns = "id source_type title journal_or_agency publication_year doi pmid pmcid reuse_category source_url".split()
    return out.select(*columns).orderBy(F.desc_nulls_last("publication_year"), F.asc("id")).limit(limit)


def molecules_with_modality(tables: Tables) -> DataFrame:
    names = tables["modality"].select(F.col("id").alias("modality_id"), F.col("name").alias("modality"))
    return tables["molecule"].join(names, "modality_id")


def list_molecules(
    tables: Tables, modality: str | None = None, q: str | None = None, limit: int = 250,
    synonyms: dict[str, list[str]] = SEARCH_SYNONYMS,
) -> DataFrame:
    names = tables["modality"].select(F.col("id").alias("modality_id"), F.col("name").alias("modality"))
    out = _equal_filters(in_scope(tables, "molecule").join(names, "modality_id"), modality=modality)
    if q:
        out = out.filter(search_condition(MOLECULE_FIELDS, q, synonyms))
    columns = (
        "id canonical_name modality target_gene_symbol disease_context therapeutic_status sense_sequence "
        "antisense_sequence guide_sequence passenger_sequence seed_region backbone_chemistry sugar_modification "
        "base_modification conjugate_delivery sequence_annotation_status modification_annotation_status external_ids"
    ).split()
    return out.select(*columns).orderBy("id").limit(limit)


def list_audit(audits: DataFrame, entity_table: str | None = None, validation_status: str | None = None, q: str | None = None, limit: int = 250) -> DataFrame:
    """Audit rows, newest id first; pass the release audits or the whole log."""
    out = _equal_filters(audits, entity_table=entity_table, validation_status=validation_status)
    if q:
        out = out.filter(any_field_contains(AUDIT_FIELDS, q))
    return out.orderBy(F.desc("id")).limit(limit)


def list_queue(tables: Tables, domain: str | None = None, priority: str | None = None, q: str | None = None, limit: int = 250) -> DataFrame:
    out = _equal_filters(tables["curation_queue"], evidence_domain=domain, priority=priority)
    if q:
        out = out.filter(any_field_contains(QUEUE_FIELDS, q))
    columns = (
        "id pmid doi source_type candidate_modality evidence_domain extraction_target suggested_evidence_grade "
        "priority queue_status source_title"
    ).split()
    return out.select(*columns).orderBy(rank_of("priority", PRIORITY_RANK, 2), "id").limit(limit)


def _candidates(tables: Tables) -> DataFrame:
    source = tables["source_document"].select(
        F.col("id").alias("source_document_id"), F.col("title").alias("source_title"), "source_url"
    )
    return tables["curation_candidate"].join(source, "source_document_id")


def list_candidates(tables: Tables, domain: str | None = None, confidence: str | None = None, q: str | None = None, limit: int = 250) -> DataFrame:
    out = _equal_filters(_candidates(tables), evidence_domain=domain, confidence_label=confidence)
    if q:
        out = out.filter(any_field_contains(CANDIDATE_FIELDS, q))
    columns = (
        "id queue_id pmid doi evidence_domain candidate_modality source_location matched_terms candidate_signal "
        "suggested_evidence_grade confidence_label validation_status curator_decision redistribution_level source_title"
    ).split()
    return out.select(*columns).orderBy(rank_of("confidence_label", CONFIDENCE_RANK, 2), "id").limit(limit)


def source_detail(tables: Tables, q: str) -> DataFrame:
    """The first source that is, or is titled like, `q`, with everything that refers to it.

    Rows are (section, id, label, status), the source itself first.
    """
    named = (F.col("id").cast("string") == q) | (F.col("pmid") == q) | (F.col("doi") == q) | contains_ci("title", q)
    chosen = (
        tables["source_document"].filter(named).orderBy(F.desc_nulls_last("publication_year"), F.asc("id")).limit(1)
    )
    sid = chosen.select(F.col("id").alias("source_document_id"))

    def part(section: str, df: DataFrame, label: str, status: str, id_col: str = "id") -> DataFrame:
        return df.join(sid, "source_document_id", "left_semi").select(
            F.lit(section).alias("section"), F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(status).alias("status")
        )

    accepted = tables["curation_audit"].filter(VERIFIED_ACCEPT).select("entity_table", F.col("entity_id").alias("evidence_id"))
    facts = evidence_tables(tables).join(sid, "source_document_id", "left_semi")
    released = facts.join(accepted, ["entity_table", "evidence_id"], "left_semi").select(
        F.col("evidence_domain").alias("section"), F.col("evidence_id").alias("id"),
        F.col("evidence_label").alias("label"), F.col("evidence_grade").alias("status"),
    )
    own = chosen.select(F.lit("source").alias("section"), "id", F.col("title").alias("label"), F.col("license_status").alias("status"))
    return reduce(
        DataFrame.unionByName,
        [
            own,
            part("queue", tables["curation_queue"], "extraction_target", "priority"),
            part("candidates", tables["curation_candidate"], "matched_terms", "confidence_label"),
            released,
        ],
    )


def search_all(tables: Tables, q: str, limit: int = 20, synonyms: dict[str, list[str]] = SEARCH_SYNONYMS) -> DataFrame:
    """One query over five kinds of entities, the first `limit` of each in its own order."""

    def hits(kind: str, df: DataFrame, fields: list[str], order: list[Column], id_col: str, label: str) -> DataFrame:
        found = df.filter(search_condition(fields, q, synonyms)).orderBy(*order).limit(limit)
        return found.select(F.lit(kind).alias("kind"), F.col(id_col).alias("id"), F.col(label).alias("label"))

    facts = evidence_tables(tables)
    by_id = [F.asc("evidence_id")]
    return reduce(
        DataFrame.unionByName,
        [
            hits("sources", tables["source_document"], SOURCE_FIELDS, [F.desc_nulls_last("publication_year"), F.asc("id")], "id", "title"),
            list_molecules(tables, q=q, limit=limit, synonyms=synonyms).select(
                F.lit("molecules").alias("kind"), "id", F.col("canonical_name").alias("label")
            ),
            hits("candidates", _candidates(tables), CANDIDATE_SEARCH_FIELDS, [rank_of("confidence_label", CONFIDENCE_RANK, 2), F.asc("id")], "id", "matched_terms"),
            hits("toxicity", facts.filter("evidence_domain = 'toxicity'"), TOXICITY_SEARCH_FIELDS, by_id, "evidence_id", "evidence_label"),
            hits("offtarget", facts.filter("evidence_domain = 'offtarget'"), OFFTARGET_SEARCH_FIELDS, by_id, "evidence_id", "category"),
        ],
    )


# --- record level -----------------------------------------------------------------------------------

# Wording of the limitation notes.
LIMITATIONS = {
    "no_sequence": "Exact release-grade oligo sequence is not curated for this record.",
    "chemistry": "Chemical modification fields should be treated as incomplete unless source text is inspected.",
    "grade_c": "Grade C records are contextual release evidence and are excluded from A/B benchmark splits.",
    "no_location": "Source location is missing; do not reuse without checking the original source.",
    "no_audit": "No audit row was found for this record in the current database snapshot.",
    "none": "Reuse is appropriate when the user's claim matches the endpoint, source location, and grade policy.",
}


def audit_summary(audit: DataFrame) -> DataFrame:
    """Per entity: audit rows, whether any is a verified accept, and the newest status by id."""
    verified = (F.lower("validation_status") == "curator_verified") & (F.lower("curator_decision") == "accept")
    newest = F.max(F.struct("id", "validation_status", "curator_decision"))
    return (
        audit.groupBy("entity_table", F.col("entity_id").alias("evidence_id"))
        .agg(F.count("*").alias("audit_rows"), F.max(verified).alias("curator_verified_accept"), newest.alias("_newest"))
        .select(
            "entity_table", "evidence_id", "audit_rows", "curator_verified_accept",
            F.col("_newest.validation_status").alias("latest_validation_status"),
            F.col("_newest.curator_decision").alias("latest_decision"),
        )
    )


def limitation_rules() -> dict[str, Column]:
    """What a release row lacks by itself, under the names of its notes."""
    sequence = ["sense_sequence", "antisense_sequence", "guide_sequence", "passenger_sequence"]
    return {
        "no_sequence": reduce(lambda a, b: a & b, [~has_text(c) for c in sequence]),
        "chemistry": text_or_empty("modification_annotation_status") != "curator_verified",
        "grade_c": F.upper(text_or_empty("evidence_grade")) == "C",
        "no_location": ~has_text("source_location"),
    }


def limitation_notes(audit_rows: Column, rules: dict[str, Column] | None = None) -> Column:
    """What a reader must know before reusing the record, as an array of notes."""
    lacks = (limitation_rules() if rules is None else rules) | {"no_audit": F.coalesce(audit_rows, F.lit(0)) == 0}
    notes = F.array_compact(F.array(*[F.when(c, F.lit(LIMITATIONS[k])) for k, c in lacks.items()]))
    return F.when(F.size(notes) == 0, F.array(F.lit(LIMITATIONS["none"]))).otherwise(notes)


def record_limitations(view: DataFrame, audit: DataFrame) -> DataFrame:
    joined = view.join(audit_summary(audit).select("entity_table", "evidence_id", "audit_rows"), ["entity_table", "evidence_id"], "left")
    return joined.select("entity_table", "evidence_id", limitation_notes(F.col("audit_rows")).alias("limitations"))


def citation_parts(resource: str, version: str, url: str) -> dict[str, Column]:
    """Citation text, key and BibTeX entry of a release row; the source is its PMID, else its DOI."""
    domain = first_text("evidence_domain", default="evidence")
    number = F.coalesce(F.col("evidence_id").cast("string"), F.lit("0"))
    name = first_text("canonical_name", default="record")
    source = (
        F.when(has_text("pmid"), F.concat(F.lit("PMID:"), F.col("pmid")))
        .when(has_text("doi"), F.concat(F.lit("DOI:"), F.col("doi")))
        .otherwise("source linked")
    )
    title = F.format_string(f"{resource} record %s:%s", domain, number)
    key = F.format_string(f"{resource}_%s_%s_v{version.replace('.', '_')}", domain, number)
    plain = F.format_string(
        f"%s. %s; %s; grade %s; %s. {resource} release v{version}.", title, name, F.col("category"), F.col("evidence_grade"), source
    )
    bibtex = F.format_string(
        "@misc{%s,\n  title = {%s: %s},\n  note = {%s; evidence grade %s},\n"
        f"  howpublished = {{{resource} release v{version}}},\n  url = {{{url}?domain=%s&id=%s}}\n}}",
        key, title, name, source, F.col("evidence_grade"), domain, number,
    )
    return {"plain_text": plain, "record_key": key, "bibtex": bibtex}


def record_citation(view: DataFrame, resource: str = "Evidence", version: str = "1.0", url: str = "https://example.org/record") -> DataFrame:
    parts = citation_parts(resource, version, url)
    return view.select("entity_table", "evidence_id", *[c.alias(k) for k, c in parts.items()])


def grade_text(c: str = "evidence_grade") -> Column:
    """Struct of label, meaning and recommended use of a grade."""
    value = F.upper(text_or_empty(c))
    unknown = F.struct(
        F.concat(F.lit("Grade "), first_text(value, default="unknown")).alias("label"),
        F.lit("Evidence grade not recognized by the current release policy.").alias("meaning"),
        F.lit("Inspect audit trail before reuse.").alias("recommended_use"),
    )
    out = unknown
    for grade, (label, meaning, use) in GRADE_TEXT.items():
        known = F.struct(F.lit(label).alias("label"), F.lit(meaning).alias("meaning"), F.lit(use).alias("recommended_use"))
        out = F.when(value == grade, known).otherwise(out)
    return out


def record_cards(view: DataFrame, audit: DataFrame, sources: DataFrame) -> DataFrame:
    """One card per release row: audit summary, matched source, grade text, mechanism, notes, provenance.

    What a card shows of the row itself is worked out before the joins. Source fields vary together: their few distinct
    combinations are kept and matched by pmid, doi or url once, and meet the rows by key after the audits.
    """
    key = ["entity_table", "evidence_id"]
    fields = ["pmid", "doi", "source_url", "source_title"]
    named = F.xxhash64(F.to_json(F.struct(*fields)))  # JSON tells a null from a neighbouring field
    cited = store(view.select(*fields).distinct().withColumn("_k", named))
    source = sources.select(
        F.col("id").alias("matched_source_id"), F.col("title").alias("_title"), F.col("pmid").alias("_pmid"),
        F.col("doi").alias("_doi"), F.col("license_status").alias("matched_license"),
    )
    matched = source_or_join(cited, sources, ["_k"]).join(source, "matched_source_id")
    provenance = store(
        cited.join(matched, "_k", "left").select(
            "_k", "matched_source_id",
            first_text("source_title", "_title", default="").alias("source_title"),
            first_text("pmid", "_pmid", default="").alias("pmid"),
            first_text("doi", "_doi", default="").alias("doi"),
            text_or_empty("matched_license").alias("license_status"),
        )
    )
    lacks = limitation_rules()
    shown = view.select(
        *key,
        named.alias("_k"),
        first_text("canonical_name", default="This record").alias("_name"),
        first_text("modality", default="oligonucleotide").alias("_modality"),
        first_text("evidence_label", "category", default="a safety/off-target endpoint").alias("_label"),
        F.when(F.col("evidence_domain") == "offtarget", offtarget_class(joined_lower(CLASS_RELEASE_FIELDS))).alias("mechanism"),
        "evidence_grade",
        *[c.alias(f"_{k}") for k, c in lacks.items()],
    )
    joined = shown.join(audit_summary(audit), key, "left").join(provenance, "_k")
    return joined.select(
        *key,
        "audit_rows", "curator_verified_accept", "latest_validation_status", "latest_decision", "matched_source_id",
        F.format_string("%s links %s context to %s.", "_name", "_modality", "_label").alias("evidence_statement"),
        "mechanism",
        grade_text()["label"].alias("grade_label"),
        F.concat_ws(" ", limitation_notes(F.col("audit_rows"), {k: F.col(f"_{k}") for k in lacks})).alias("limitations"),
        (~F.col("_no_location") & F.coalesce("curator_verified_accept", F.lit(False))).alias("source_location_verified"),
        "source_title", "pmid", "doi", "license_status",
    )


def evidence_detail(view: DataFrame, tables: Tables, entity_table: str, evidence_id: int) -> tuple[DataFrame, DataFrame]:
    """The card of one release row, and its audit rows, newest id first."""
    record = view.filter((F.col("entity_table") == entity_table) & (F.col("evidence_id") == evidence_id))
    trail = tables["curation_audit"].filter((F.col("entity_table") == entity_table) & (F.col("entity_id") == evidence_id))
    return record_cards(record, trail, tables["source_document"]), trail.orderBy(F.desc("id"))


# --- questions --------------------------------------------------------------------------------------

QUESTION_FIELDS = (
    "canonical_name modality target_gene_symbol disease_context backbone_chemistry sugar_modification "
    "base_modification conjugate_delivery category evidence_label source_location source_title pmid doi audit_note"
).split()


def question_plan(questions: DataFrame, terms: list[QuestionTerm] = QUESTION_TERMS, targets: bool = True) -> DataFrame:
    """Interpret (question_id, question): domain, grades, modalities, target and required term groups.

    Toxicity words are looked at after off-target words and win.
    """
    raw, low = text_or_empty("question"), F.lower(text_or_empty("question"))
    domain = F.when(contains_any(low, QUESTION_TOXICITY_WORDS), "toxicity").when(
        contains_any(low, QUESTION_OFFTARGET_WORDS), "offtarget"
    )
    both = low.rlike(r"\bgrade\s*a\s*/\s*b\b") | F.contains(low, F.lit("a/b")) | F.contains(low, F.lit("a and b"))
    single = F.array_compact(F.array(*[F.when(low.rlike(rf"\bgrade\s*{g.lower()}\b"), F.lit(g)) for g in "ABC"]))
    grades = F.when(both, F.array(F.lit("A"), F.lit("B"))).otherwise(single)
    modalities = F.array_compact(
        F.array(
            F.when(low.rlike(r"\bsirna\b|\brnai\b"), "siRNA"), F.when(low.rlike(r"\baso\b|antisense|gapmer"), "ASO")
        )
    )
    capitals = F.filter(
        F.regexp_extract_all(raw, F.lit(r"\b[A-Z0-9]{2,10}\b"), F.lit(0)),
        lambda t: ~t.isin(QUESTION_NON_TARGETS),
    )
    target = F.coalesce(F.get(capitals, F.lit(0)), F.lit("")) if targets else F.lit("")
    wanted = F.array_compact(
        F.array(*[
            F.when(
                contains_any(low, list(t.labels)),
                F.struct(F.lit(t.key).alias("key"), F.array(*[F.lit(s.lower()) for s in t.synonyms]).alias("synonyms")),
            )
            for t in terms
        ])
    )
    return questions.select(
        "question_id", F.coalesce(domain, F.lit("")).alias("domain"), grades.alias("grades"),
        modalities.alias("modalities"), F.lower(target).alias("target"), wanted.alias("term_groups"),
    )


#: What an answer depends on besides its spellings and its terms of several words.
_ANSWERED_BY = ["evidence_domain", "evidence_grade", "modality", "target_gene_symbol"]


def _asked(view: DataFrame, questions: DataFrame, terms: list[QuestionTerm], targets: bool, among: Sequence[DataFrame] = ()) -> tuple[DataFrame, DataFrame, Column]:
    """The rows with `_sig`, `found` and `_phrases`, the plans of the questions, and the condition over row and plan."""
    plans = question_plan(questions, terms, targets).withColumns({f"_{c}": F.col(c) for c in ("domain", "grades", "modalities", "target")})
    # The target must be in one of the searched fields before it is looked for in its own.
    # A term of several words may run over the joint of two fields: its longest word is looked for, then the term in the joined text.
    terms_of = F.col("term_groups")["synonyms"]
    longest = lambda s: F.reduce(F.split(s, " "), F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    several = F.filter(terms_of, lambda g: F.exists(g, lambda s: F.contains(s, F.lit(" "))))
    wanted = F.concat(F.transform(terms_of, lambda g: F.transform(g, longest)), F.when(F.col("target") != "", F.array(F.array("target"))).otherwise(F.array().cast("array<array<string>>")))
    plans = store(plans.select("question_id", "_domain", "_grades", "_modalities", "_target", wanted.alias("_groups"), several.alias("_several")))

    answers = (
        ((F.col("_domain") == "") | (F.col("_domain") == F.col("evidence_domain")))
        & ((F.size("_grades") == 0) | F.array_contains("_grades", F.col("evidence_grade")))
        & ((F.size("_modalities") == 0) | F.array_contains("_modalities", F.col("modality")))
        & ((F.col("_target") == "") | F.contains(F.lower(text_or_empty("target_gene_symbol")), F.col("_target")))
        & F.forall("_several", lambda g: F.arrays_overlap(g, F.col("_phrases")))
    )
    # Groups with a term of several words are looked for whole, with their terms of one word.
    phrases = sorted({s.lower() for t in terms if any(" " in s for s in t.synonyms) for s in t.synonyms})
    held = F.array_compact(F.array(*[F.when(F.contains(joined_lower(QUESTION_FIELDS), F.lit(s)), F.lit(s)) for s in phrases])) if phrases else F.array().cast("array<string>")
    parts = by_dimension(QUESTION_FIELDS)
    signed = signed_rows(view, [field_values(part) for part in parts], spellings_of(plans, "_groups"), among=holding(parts, among))
    return signed.withColumn("_phrases", held), plans, answers


def ask_filter(view: DataFrame, questions: DataFrame, terms: list[QuestionTerm] = QUESTION_TERMS, targets: bool = True) -> DataFrame:
    """Release rows that answer each question, as (question_id, row columns)."""
    signed, plans, answers = _asked(view, questions, terms, targets)
    return SpellingIndex(store(signed)).rows_of(plans, "question_id", "_groups", view.columns, answers)


def ask_counts(view: DataFrame, questions: DataFrame, terms: list[QuestionTerm] = QUESTION_TERMS, targets: bool = True, among: Sequence[DataFrame] = ()) -> DataFrame:
    """The summary of `ask_filter`: rows that answer the same plans are counted before they meet the questions; `among` as in `synonym_counts`."""
    signed, plans, answers = _asked(view, questions, terms, targets, among)
    counted = signed.groupBy("_sig", "_phrases", *_ANSWERED_BY).agg(F.first("found").alias("found"), F.count(F.lit(1)).alias("_rows"))
    kept = ["evidence_grade", "evidence_domain", "_rows"]
    return ask_summary(SpellingIndex(store(counted)).rows_of(plans, "question_id", "_groups", kept, answers), "_rows")


def ask_first(view: DataFrame, questions: DataFrame, terms: list[QuestionTerm] = QUESTION_TERMS, targets: bool = True, shown: int = 25) -> DataFrame:
    """The rows of `ask_filter` that can be among the first `shown` of a question: the first of those that answer the same plans."""
    signed, plans, answers = _asked(view, questions, terms, targets)
    first = top_per_group(signed, ["_sig", "_phrases", *_ANSWERED_BY], [F.desc("evidence_domain"), F.asc("evidence_id")], shown)
    return SpellingIndex(store(first)).rows_of(plans, "question_id", "_groups", view.columns, answers)


def ask_summary(answers: DataFrame, rows: str | None = None) -> DataFrame:
    """Per question: matched rows and counts by grade and domain; `rows` names a column with the rows each answer stands for."""
    each = F.col(rows) if rows else F.lit(1).cast("long")

    def count(condition: Column) -> Column:
        return F.sum(F.when(condition, each).otherwise(F.lit(0).cast("long")))

    return answers.groupBy("question_id").agg(
        F.sum(each).alias("matched"),
        *[count(F.col("evidence_grade") == g).alias(f"grade_{g.lower()}") for g in "ABC"],
        *[count(F.col("evidence_domain") == d).alias(d) for d in ("toxicity", "offtarget")],
    )


def ask_citations(answers: DataFrame, shown: int = 25, citations: int = 10) -> DataFrame:
    """Distinct sources of the first `shown` rows per question, at most `citations`."""
    order = [F.desc("evidence_domain"), F.asc("evidence_id")]
    top = top_per_group(answers, ["question_id"], order, shown).withColumn("source_key", first_text("pmid", "doi", "source_url"))
    unique = first_occurrence(top.filter("source_key IS NOT NULL"), ["question_id", "source_key"], order)
    return top_per_group(unique, ["question_id"], order, citations, rank_col="position")
