"""Counts, facets, coverage and completeness over the release."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import (
    any_has_text,
    any_nonblank,
    first_text,
    has_text,
    joined_lower,
    let,
    nonblank,
    percent,
    text_or_empty,
)
from attesta.lexicons import COMPLETENESS_FIELDS, MODIFICATIONS, OFFTARGET_CLASSES, Term
from attesta.operators.joins import human_verified_count
from attesta.operators.release import Tables, fact_rows, in_scope, release_scope, scope_semi
from attesta.operators.windows import latest_accept_audit, top_per_group
from attesta.sources.schema import CHEMISTRY_FIELDS, FACTS, SEQUENCE_FIELDS


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def release_audits(tables: Tables) -> DataFrame:
    """One row per release entity: its newest accepted audit."""
    latest = latest_accept_audit(tables["curation_audit"])
    keys = fact_rows(tables).select("entity_table", F.col("evidence_id").alias("entity_id"))
    return latest.join(keys, ["entity_table", "entity_id"], "left_semi")


def release_stats(tables: Tables) -> DataFrame:
    """Seven counts and the grade histogram as (section, label, n)."""
    molecules = in_scope(tables, "molecule")

    def count(label: str, df: DataFrame, expr: Column | None = None) -> DataFrame:
        n = F.count("*") if expr is None else expr
        return df.agg(n.alias("n")).select(F.lit("counts").alias("section"), F.lit(label).alias("label"), "n")

    counts = [
        count("source_document", in_scope(tables, "source")),
        count("modality", molecules, F.countDistinct("modality_id")),
        count("molecule", molecules),
        count("toxicity_endpoint", tables["toxicity_endpoint"]),
        count("offtarget_evidence", tables["offtarget_evidence"]),
        count("curation_audit", release_audits(tables)),
        count("benchmark_split", tables["benchmark_split"]),
    ]
    grades = fact_rows(tables).groupBy(F.col("evidence_grade").alias("label")).agg(F.count("*").alias("n"))
    return _union([*counts, grades.select(F.lit("evidence_grades").alias("section"), "label", "n")])


def histogram(df: DataFrame, section: str, label: Column, order: list[Column] | None = None, top: int | None = None) -> DataFrame:
    """(section, label, n); with `top`, only the first rows by `order` (default: n descending, label)."""
    counts = df.groupBy(label.alias("label")).agg(F.count("*").alias("n"))
    if top is not None:
        counts = counts.orderBy(*(order or [F.desc("n"), F.asc_nulls_first("label")])).limit(top)
    return counts.select(F.lit(section).alias("section"), "label", "n")


def _year_histogram(sources: DataFrame, section: str, top: int) -> DataFrame:
    counts = sources.groupBy("publication_year").agg(F.count("*").alias("n"))
    newest = counts.orderBy(F.desc_nulls_last("publication_year")).limit(top)
    return newest.select(
        F.lit(section).alias("section"), F.coalesce(F.col("publication_year").cast("string"), F.lit("unknown")).alias("label"), "n"
    )


def _with_modality(molecules: DataFrame, tables: Tables) -> DataFrame:
    names = tables["modality"].select(F.col("id").alias("modality_id"), F.col("name").alias("modality"))
    return molecules.join(names, "modality_id")


def summary_counts(tables: Tables, top: int = 12, years: int = 10) -> DataFrame:
    sources = in_scope(tables, "source")
    molecules = _with_modality(in_scope(tables, "molecule"), tables)
    return _union(
        [
            histogram(molecules, "modality", F.col("modality")),
            histogram(sources, "sources_by_type", F.col("source_type")),
            _year_histogram(sources, "sources_by_year", years),
            histogram(tables["toxicity_endpoint"], "toxicity_by_category", F.col("endpoint_category"), top=top),
            histogram(tables["offtarget_evidence"], "offtarget_by_type", F.col("evidence_type"), top=top),
        ]
    )


def facets(tables: Tables, modifications: list[Term] = MODIFICATIONS, targets: int = 200) -> DataFrame:
    """Facet values as (facet, value, label, n); n is NULL where the facet has no count."""
    sources = in_scope(tables, "source")
    molecules = in_scope(tables, "molecule")
    facts = fact_rows(tables)

    def counted(df: DataFrame, facet: str, value: Column, top: int | None = None) -> DataFrame:
        return histogram(df, facet, value, top=top).select(
            F.col("section").alias("facet"), F.col("label").alias("value"), "label", "n"
        )

    none = F.lit(None).cast("bigint")
    used = _with_modality(molecules, tables).select("modality").distinct()
    spark = facts.sparkSession
    terms = spark.createDataFrame([(t.key, t.label) for t in modifications], "value string, label string")
    return _union(
        [
            used.select(F.lit("modalities").alias("facet"), F.col("modality").alias("value"), F.col("modality").alias("label"), none.alias("n")),
            counted(sources, "source_types", F.col("source_type")),
            counted(sources.filter("publication_year IS NOT NULL"), "source_years", F.col("publication_year").cast("string")),
            counted(facts, "evidence_grades", F.col("evidence_grade")),
            counted(tables["toxicity_endpoint"], "toxicity_categories", F.col("endpoint_category")),
            counted(facts, "evidence_categories", F.col("category")),
            counted(release_audits(tables), "audit_statuses", F.col("validation_status")),
            counted(molecules.filter(has_text("target_gene_symbol")), "targets", F.col("target_gene_symbol"), top=targets),
            terms.select(F.lit("modification_terms").alias("facet"), "value", "label", none.alias("n")),
        ]
    )


def coverage(tables: Tables, top: int = 16) -> DataFrame:
    """Years, journals, domain x grade and molecules per modality as (section, label, sublabel, n)."""
    sources = in_scope(tables, "source")
    journals = histogram(sources, "top_journals", F.coalesce("journal_or_agency", F.lit("unknown")), top=top)
    blank = F.lit("")
    crosstab = fact_rows(tables).groupBy("evidence_domain", "evidence_grade").agg(F.count("*").alias("n"))
    modality = (
        _with_modality(in_scope(tables, "molecule"), tables).groupBy("modality").agg(F.countDistinct("id").alias("n"))
    )
    return _union(
        [
            _year_histogram(sources, "source_years", top).select("section", "label", blank.alias("sublabel"), "n"),
            journals.select("section", "label", blank.alias("sublabel"), "n"),
            crosstab.select(
                F.lit("release_grade_domain").alias("section"), F.col("evidence_domain").alias("label"),
                F.col("evidence_grade").alias("sublabel"), "n",
            ),
            modality.select(F.lit("release_modality").alias("section"), F.col("modality").alias("label"), blank.alias("sublabel"), "n"),
        ]
    )


def protocol_counts(tables: Tables, top: int = 12) -> DataFrame:
    """Provenance and annotation counts of the release as (section, label, n)."""
    facts = fact_rows(tables)
    molecule = tables["molecule"].select(
        F.col("id").alias("molecule_id"),
        any_has_text(SEQUENCE_FIELDS).alias("_sequence"),
        any_has_text(CHEMISTRY_FIELDS).alias("_chemistry"),
    )
    source = tables["source_document"].select(
        F.col("id").alias("source_document_id"), has_text("pmid").alias("_pmid"), has_text("doi").alias("_doi")
    )

    def named(df: DataFrame, section: str, sums: dict[str, Column]) -> DataFrame:
        wide = df.agg(*[F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).alias(k) for k, c in sums.items()])
        long = wide.unpivot([], list(sums), "label", "n")
        return long.select(F.lit(section).alias("section"), "label", "n")

    scoped = in_scope(tables, "source")
    licenses = (
        scoped.groupBy(F.concat_ws("|", "license_status", "reuse_category").alias("label"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), F.asc("label"))
        .limit(top)
    )
    methods = (
        release_audits(tables)
        .groupBy(
            F.concat_ws(
                "|", "extraction_method", "extractor_model_or_script", "validation_status", "curator_decision"
            ).alias("label")
        )
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), F.asc("label"))
        .limit(top)
    )
    by_domain = facts.groupBy(F.concat_ws("|", "entity_table", "evidence_grade").alias("label")).agg(F.count("*").alias("n"))
    return _union(
        [
            named(facts, "release", {"with_source_location": has_text("source_location")}),
            named(
                facts.select("source_document_id").join(source, "source_document_id"),
                "release",
                {"with_pmid": F.col("_pmid"), "with_doi": F.col("_doi")},
            ),
            named(
                facts.select("molecule_id").join(molecule, "molecule_id"),
                "release",
                {"with_any_sequence": F.col("_sequence"), "with_any_chemistry": F.col("_chemistry")},
            ),
            named(
                scoped,
                "sources",
                {
                    "source_documents": F.lit(1),
                    "with_pmid": has_text("pmid"),
                    "with_doi": has_text("doi"),
                    "with_pmcid": has_text("pmcid"),
                },
            ),
            by_domain.select(F.lit("release_audit_by_domain").alias("section"), "label", "n"),
            licenses.select(F.lit("source_license").alias("section"), "label", "n"),
            methods.select(F.lit("audit_methods").alias("section"), "label", "n"),
        ]
    )


def quality_gates(tables: Tables, minimum: int = 600) -> DataFrame:
    """Release gates as (gate, value, expected, status)."""
    facts = fact_rows(tables).agg(F.count("*").alias("release_rows"))
    verified = human_verified_count(tables).withColumnRenamed("n", "verified_rows")
    splits = tables["benchmark_split"].agg(F.count("*").alias("split_rows"))
    sources = in_scope(tables, "source").agg(F.count("*").alias("source_rows"))
    # Four one-row aggregates side by side.
    row = facts.select(
        "release_rows", verified.scalar().alias("verified_rows"), splits.scalar().alias("split_rows"), sources.scalar().alias("source_rows")
    )

    def gate(name: str, value: str, expected: Column, passed: Column) -> Column:
        return F.struct(
            F.lit(name).alias("gate"),
            F.col(value).alias("value"),
            expected.cast("bigint").alias("expected"),
            F.when(passed, "pass").otherwise("review").alias("status"),
        )

    v, r = F.col("verified_rows"), F.col("release_rows")
    gates = F.array(
        gate("human_verified_release", "verified_rows", r, (v >= minimum) & (v == r)),
        gate("minimum_release_size", "release_rows", F.lit(minimum), r >= minimum),
        gate("primary_study_scope", "source_rows", F.lit(1), F.col("source_rows") >= 1),
        gate("benchmark_reuse", "split_rows", F.lit(1), F.col("split_rows") > 0),
    )
    return row.select(F.inline(gates))


def field_completeness(view: DataFrame, fields: list[tuple[str, str, bool]] = COMPLETENESS_FIELDS) -> DataFrame:
    """Per field: filled rows, all rows, unrounded percentage and status; one pass over the view.

    Three summary rows follow: records with any sequence, with any chemistry, and the strict-field mean.
    """
    names = [f for f, _, _ in fields]
    sums = [F.coalesce(F.sum(nonblank(f).cast("bigint")), F.lit(0)).alias(f) for f in names]
    extra = {"any_sequence": any_nonblank(SEQUENCE_FIELDS), "any_chemistry": any_nonblank(CHEMISTRY_FIELDS)}
    sums += [F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).alias(k) for k, c in extra.items()]
    wide = view.agg(F.count("*").alias("total"), *sums)

    def pct(c: str) -> Column:
        return percent(c, "total")

    def row(field: str, group: str, filled: Column, value: Column, status: Column) -> Column:
        return F.struct(
            F.lit(field).alias("field"), F.lit(group).alias("field_group"), filled.alias("filled"),
            F.col("total").alias("total"), value.alias("completeness_pct"), status.alias("status"),
        )

    def status(c: str, strict: bool) -> Column:
        high, low = (95, 80) if strict else (70, 25)
        return F.when(pct(c) >= high, "pass").when(pct(c) >= low, "partial").otherwise("gap")

    strict = [f for f, _, s in fields if s]
    strict_sum = reduce(lambda a, b: a + b, [F.col(f) for f in strict])
    mean = percent(strict_sum / F.lit(float(len(strict))), "total")
    rows = [row(f, g, F.col(f), pct(f), status(f, s)) for f, g, s in fields]
    rows += [row(k, "summary", F.col(k), pct(k), F.lit("")) for k in extra]
    rows.append(row("strict_mean", "summary", strict_sum, mean, F.lit("")))
    return wide.select(F.inline(F.array(*rows)))


MISSING_FLAGS = (
    "missing_sequence missing_seed missing_modification missing_delivery missing_dose missing_exposure missing_model"
).split()


def core_field_coverage(packet: DataFrame) -> DataFrame:
    """Available rows per core field and rows per priority, as (section, label, n, total)."""
    flags = [F.coalesce(F.sum((~F.col(f)).cast("bigint")), F.lit(0)).alias(f.removeprefix("missing_")) for f in MISSING_FLAGS]
    levels = [F.count(F.when(F.col("priority") == p, 1)).alias(p) for p in ("P0", "P1", "P2")]
    wide = packet.agg(F.count("*").alias("total"), *flags, *levels)
    names = [f.removeprefix("missing_") for f in MISSING_FLAGS]
    fields = wide.unpivot(["total"], names, "label", "n").select(F.lit("available").alias("section"), "label", "n", "total")
    priorities = wide.unpivot(["total"], ["P0", "P1", "P2"], "label", "n").select(
        F.lit("priority").alias("section"), "label", "n", "total"
    )
    return fields.unionByName(priorities)


def sequence_coverage(tables: Tables) -> DataFrame:
    """Molecules with sequence or chemistry annotation, overall and per modality."""
    sequence, chemistry = any_has_text(SEQUENCE_FIELDS), any_has_text(CHEMISTRY_FIELDS)
    sums = {
        "sequence_nonempty": sequence,
        "sequence_verified": sequence & (F.col("sequence_annotation_status") == "curator_verified"),
        "modification_nonempty": chemistry,
        "modification_verified": chemistry & (F.col("modification_annotation_status") == "curator_verified"),
    }
    aggs = [F.count("*").alias("molecules")]
    aggs += [F.count(F.when(c, 1)).alias(k) for k, c in sums.items()]
    total = tables["molecule"].agg(*aggs).withColumn("modality", F.lit("all"))
    by_modality = _with_modality(tables["molecule"], tables).groupBy("modality").agg(*aggs)
    return total.unionByName(by_modality).select(
        "*",
        F.greatest(F.col("molecules") - F.col("sequence_verified"), F.lit(0)).alias("needs_sequence"),
        F.greatest(F.col("molecules") - F.col("modification_verified"), F.lit(0)).alias("needs_modification"),
    )


# Fields searched for modification terms.
PROFILE_RELEASE_FIELDS = (
    "canonical_name modality target_gene_symbol disease_context backbone_chemistry sugar_modification "
    "base_modification conjugate_delivery category evidence_label source_title audit_note"
).split()
PROFILE_CANDIDATE_FIELDS = "candidate_modality matched_terms candidate_signal source_title".split()
PROFILE_CANDIDATE_DOMAINS = ["toxicity", "offtarget", "chemistry", "delivery"]
CLASS_RELEASE_FIELDS = (
    "category evidence_label source_location source_title audit_note modality target_gene_symbol"
).split()


def labels_in_text(text: Column, terms: list[Term]) -> Column:
    """Keys of all terms with a synonym in the (already lower-cased) text."""

    def keys(low: Column) -> Column:
        def hit(t: Term) -> Column:
            return reduce(lambda a, b: a | b, [F.contains(low, F.lit(s.lower())) for s in t.synonyms])

        return F.array_compact(F.array(*[F.when(hit(t), F.lit(t.key)) for t in terms]))

    return let(text, keys)


def in_benchmark(view: DataFrame, splits: DataFrame) -> DataFrame:
    """The view with a flag for rows that are part of a benchmark split."""
    keys = splits.select("entity_table", F.col("entity_id").alias("evidence_id")).distinct().withColumn("_b", F.lit(True))
    return view.join(keys, ["entity_table", "evidence_id"], "left").withColumn(
        "in_benchmark", F.coalesce("_b", F.lit(False))
    ).drop("_b")


def candidate_rows(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """Candidates with the title of their source."""
    titles = sources.select(F.col("id").alias("source_document_id"), F.col("title").alias("source_title"))
    return candidates.join(titles, "source_document_id")


def _term_frame(df: DataFrame, terms: list[Term]) -> DataFrame:
    rows = [(t.key, t.label, t.kind, i) for i, t in enumerate(terms)]
    return df.sparkSession.createDataFrame(rows, "term string, label string, kind string, ord int")


def modification_profile(view: DataFrame, candidates: DataFrame, splits: DataFrame, terms: list[Term] = MODIFICATIONS) -> DataFrame:
    """Release, candidate and benchmark rows per modification term; a row counts under every term it holds."""
    tagged = in_benchmark(view, splits).select(
        "evidence_domain", "evidence_grade", "in_benchmark",
        F.explode(labels_in_text(joined_lower(PROFILE_RELEASE_FIELDS), terms)).alias("term"),
    )
    release = tagged.groupBy("term").agg(
        F.count("*").alias("release_records"),
        F.count(F.when(F.col("in_benchmark"), 1)).alias("benchmark_records"),
        *[F.count(F.when(F.col("evidence_domain") == d, 1)).alias(f"{d}_records") for d in ("toxicity", "offtarget")],
        *[F.count(F.when(F.col("evidence_grade") == g, 1)).alias(f"grade_{g.lower()}") for g in "ABC"],
    )
    pool = candidates.filter(F.col("evidence_domain").isin(PROFILE_CANDIDATE_DOMAINS))
    found = (
        pool.select(F.explode(labels_in_text(joined_lower(PROFILE_CANDIDATE_FIELDS), terms)).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("candidate_records"))
    )
    counted = _term_frame(view, terms).join(release, "term", "left").join(found, "term", "left")
    return counted.na.fill(0).select("term", "label", "kind", *[c for c in counted.columns if c not in ("term", "label", "kind", "ord")])


def modification_examples(view: DataFrame, terms: list[Term] = MODIFICATIONS, n: int = 8) -> DataFrame:
    """First n release rows per modification term, in published order."""
    tagged = view.select(
        "evidence_domain", "entity_table", "evidence_id", "canonical_name", "evidence_grade",
        F.explode(labels_in_text(joined_lower(PROFILE_RELEASE_FIELDS), terms)).alias("term"),
    )
    return top_per_group(tagged, ["term"], [F.desc("evidence_domain"), F.asc("evidence_id")], n, rank_col="position")


def offtarget_class(text: Column, classes: list[Term] = OFFTARGET_CLASSES) -> Column:
    """Key of the first class with a synonym in the text; the last class is the fallback."""

    def first(low: Column) -> Column:
        out = F.lit(classes[-1].key)
        for c in reversed(classes):
            hit = reduce(lambda a, b: a | b, [F.contains(low, F.lit(s.lower())) for s in c.synonyms])
            out = F.when(hit, F.lit(c.key)).otherwise(out)
        return out

    return let(F.lower(text), first)


def offtarget_taxonomy(view: DataFrame, candidates: DataFrame, splits: DataFrame, classes: list[Term] = OFFTARGET_CLASSES) -> DataFrame:
    """Release, benchmark and candidate rows per mechanism class; every row has exactly one class."""
    release = in_benchmark(view.filter("evidence_domain = 'offtarget'"), splits).select(
        offtarget_class(joined_lower(CLASS_RELEASE_FIELDS), classes).alias("term"), "in_benchmark", "evidence_grade"
    )
    counted = release.groupBy("term").agg(
        F.count("*").alias("release_records"),
        F.count(F.when(F.col("in_benchmark"), 1)).alias("benchmark_records"),
        *[F.count(F.when(F.col("evidence_grade") == g, 1)).alias(f"grade_{g.lower()}") for g in "ABC"],
    )
    found = (
        candidates.filter("evidence_domain = 'offtarget'")
        .select(offtarget_class(joined_lower(PROFILE_CANDIDATE_FIELDS), classes).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("candidate_records"))
    )
    out = _term_frame(view, classes).join(counted, "term", "left").join(found, "term", "left")
    return out.na.fill(0).drop("kind", "ord").withColumnRenamed("term", "class_key")


def offtarget_examples(view: DataFrame, classes: list[Term] = OFFTARGET_CLASSES, n: int = 4) -> DataFrame:
    tagged = view.filter("evidence_domain = 'offtarget'").select(
        offtarget_class(joined_lower(CLASS_RELEASE_FIELDS), classes).alias("class_key"),
        "entity_table", "evidence_id", "canonical_name", "evidence_label", "evidence_grade", "pmid",
    )
    return top_per_group(tagged, ["class_key"], [F.asc("evidence_id")], n, rank_col="position")


def task_cards(tables: Tables) -> DataFrame:
    """Per benchmark task: rows per split and per grade A/B."""
    splits = tables["benchmark_split"]
    by_split = splits.groupBy("task_name").agg(
        *[F.count(F.when(F.col("split_name") == s, 1)).alias(f"{s}_rows") for s in ("train", "validation", "test")]
    )
    keys = splits.select("task_name", "entity_table", F.col("entity_id").alias("evidence_id"))
    grades = (
        fact_rows(tables)
        .select("entity_table", "evidence_id", "evidence_grade")
        .join(keys, ["entity_table", "evidence_id"])
        .groupBy("task_name")
        .agg(*[F.count(F.when(F.col("evidence_grade") == g, 1)).alias(f"grade_{g.lower()}_rows") for g in "AB"])
    )
    return by_split.join(grades, "task_name", "left").na.fill(0)


# License classes treated as open, and the policy words.
OPEN_LICENSES = ["open_access", "official_guideline", "official_notice"]
OFFICIAL_TYPES = ["regulatory", "official"]
LINKOUT_ONLY = "query_linkout_only"


def license_manifest(tables: Tables) -> DataFrame:
    """Per source: release and candidate rows, and the reuse policy that follows from its license."""
    release = fact_rows(tables).groupBy("source_document_id").agg(F.count("*").alias("release_evidence_rows"))
    found = tables["curation_candidate"].groupBy("source_document_id").agg(F.count("*").alias("candidate_rows"))
    open_like = text_or_empty("license_status").isin(OPEN_LICENSES)
    linkout = text_or_empty("reuse_category") == LINKOUT_ONLY
    has_pmcid = has_text("pmcid")
    counted = (
        tables["source_document"]
        .withColumnRenamed("id", "source_document_id")
        .join(release, "source_document_id", "left")
        .join(found, "source_document_id", "left")
        .na.fill(0, ["release_evidence_rows", "candidate_rows"])
    )
    return counted.select(
        "source_document_id", "source_type", "pmid", "pmcid", "doi", "source_url", "journal_or_agency",
        "publication_year", "license_status", "reuse_category", "release_evidence_rows", "candidate_rows",
        first_text("license_status", default="not_recorded").alias("article_license"),
        F.when(open_like & has_pmcid, "open_or_official_source_recorded")
        .when(has_pmcid, "pmcid_present_license_not_verified")
        .otherwise("not_applicable")
        .alias("oa_subset_status"),
        F.when(linkout | ~open_like, "false").otherwise("not_claimed").alias("raw_redistribution_allowed"),
        F.when(linkout, "external_linkout_only").otherwise("true").alias("derived_annotation_allowed"),
        F.lit("unknown").alias("commercial_reuse_allowed"),
        F.when(linkout, "restricted_linkout")
        .when(open_like, "source_class_reviewed")
        .otherwise("conservative_source_metadata_review")
        .alias("license_review_status"),
        text_or_empty("source_type").isin(OFFICIAL_TYPES).alias("is_official_source"),
    )


def duplicate_keys(df: DataFrame, cols: list[str]) -> DataFrame:
    """Non-blank keys that occur more than once."""
    filled = reduce(lambda a, b: a & b, [has_text(c) for c in cols])
    return df.filter(filled).groupBy(*cols).agg(F.count("*").alias("n")).filter("n > 1")


def leakage_violations(splits: DataFrame) -> DataFrame:
    """Leakage groups whose rows are in more than one split of a task."""
    return (
        splits.groupBy("task_name", "leakage_group")
        .agg(F.countDistinct("split_name").alias("n_splits"), F.count("*").alias("n_rows"))
        .filter("n_splits > 1")
    )


def decision_confusion(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def sampling_summary(df: DataFrame, stratum: str = "sampling_stratum", category: str = "error_category") -> DataFrame:
    return df.groupBy(stratum, category).agg(F.count("*").alias("n"))


def facet_counts(df: DataFrame, key: str, limit: int = 8) -> DataFrame:
    """Rows per value, blank as 'unknown', the most frequent first."""
    return (
        df.groupBy(first_text(key, default="unknown").alias("label"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), F.asc("label"))
        .limit(limit)
    )
