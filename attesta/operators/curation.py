"""Curation state changes: review checks, promotion, verdicts, repairs and packets. Every merge returns new tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import (
    first_text,
    has_text,
    null_if_blank,
    strip,
    text_or_empty,
)
from attesta.operators.release import Tables, fact_rows
from attesta.operators.stats import leakage_violations
from attesta.operators.windows import split_by_hash, stratified_sample
from attesta.session import materialize
from attesta.sources.schema import FACTS

MIXED = ("ASO/siRNA", "ASO/siRNA mixed context")  # fixed values: queue wording -> modality name
MACHINE_NOTES = ["machine pre-curation only", "precuration only"]  # fixed values: notes that are no review


# Column names that a review may carry the same thing under, in order.
MODALITY_NAMES = ["modality_name", "molecule_modality", "candidate_modality"]
MOLECULE_NAMES = ["molecule_canonical_name", "molecule_name", "molecule_name_verified"]
TARGET_NAMES = ["target_gene_symbol", "target_gene_symbol_verified"]


def _field(c: str, df: DataFrame) -> Column:
    return strip(text_or_empty(c)) if c in df.columns else F.lit("")


def _either(names: list[str], df: DataFrame) -> Column:
    """The first of several columns that is not blank, or ''."""
    found = [strip(text_or_empty(c)) for c in names if c in df.columns]
    return first_text(*found, default="") if found else F.lit("")


def _flag(c: str, df: DataFrame) -> Column:
    """A lookup's result where it was made; without lookup nothing counts as unknown."""
    return F.col(c) if c in df.columns else F.lit(True)


def review_errors(df: DataFrame) -> Column:
    """Array of error messages of a review row; empty when it may be applied."""
    f = {c: _field(c, df) for c in (
        "candidate_id curator_decision validation_status evidence_grade audit_note molecule_id "
        "verified_entity_table endpoint_name endpoint_category evidence_type source_location_verified"
    ).split()}
    f["_name"], f["_modality"] = _either(MOLECULE_NAMES, df), _either(MODALITY_NAMES, df)
    table = f["verified_entity_table"]
    note = F.lower(f["audit_note"])
    accept = [
        (~f["evidence_grade"].isin("A", "B", "C"), "evidence_grade must be A, B or C"),
        (f["validation_status"] != "curator_verified", "accepted row must be curator_verified"),
        (f["audit_note"] == "", "audit_note is missing"),
        (reduce(lambda a, b: a | b, [F.contains(note, F.lit(n)) for n in MACHINE_NOTES]), "audit_note is machine-only"),
        ((f["molecule_id"] == "") & (f["_name"] == ""), "molecule is missing"),
        ((f["molecule_id"] == "") & (f["_name"] != "") & (f["_modality"] == ""), "modality is missing"),
        ((f["molecule_id"] != "") & f["molecule_id"].try_cast("bigint").isNull(), "molecule_id is no number"),
        (f["molecule_id"].try_cast("bigint").isNotNull() & ~_flag("_known_molecule", df), "unknown molecule_id"),
        (~table.isin(FACTS), "verified_entity_table must be a release table"),
        ((table == "toxicity_endpoint") & ((f["endpoint_name"] == "") | (f["endpoint_category"] == "")), "endpoint fields are missing"),
        ((table == "offtarget_evidence") & (f["evidence_type"] == ""), "evidence_type is missing"),
        (table.isin(FACTS) & (f["source_location_verified"] == ""), "source_location_verified is missing"),
    ]
    reject = [
        (f["validation_status"] != "curator_rejected", "rejected row must be curator_rejected"),
        (f["audit_note"] == "", "audit_note is missing"),
    ]
    unknown = (~_flag("_known_candidate", df), "unknown candidate_id")
    accept, reject = [unknown, *accept], [unknown, *reject]

    def messages(rules: list[tuple[Column, str]]) -> Column:
        return F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in rules]))

    return (
        F.when(f["curator_decision"] == "accept", messages(accept))
        .when(f["curator_decision"] == "reject", messages(reject))
        .otherwise(F.array(F.lit("not decided")))
    )


def validate_review(reviews: DataFrame, tables: Tables | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid rows, invalid rows with an `errors` array); with tables, candidate and molecule ids are looked up as well."""
    looked_up = reviews
    if tables is not None:
        molecules = tables["molecule"].select(F.col("id").alias("_mol"), F.lit(True).alias("_known_molecule")).distinct()
        given = strip(text_or_empty("molecule_id")).try_cast("bigint") if "molecule_id" in reviews.columns else F.lit(None).cast("bigint")
        looked_up = reviews.withColumn("_given", given).join(molecules, F.col("_given") == F.col("_mol"), "left").drop("_given", "_mol")
        looked_up = looked_up.withColumn("_known_molecule", F.coalesce("_known_molecule", F.lit(False)))
        if "_known_candidate" not in reviews.columns:
            candidates = tables["curation_candidate"].select(F.col("id").alias("candidate_id"), F.lit(True).alias("_known_candidate")).distinct()
            looked_up = looked_up.join(candidates, "candidate_id", "left").withColumn("_known_candidate", F.coalesce("_known_candidate", F.lit(False)))
    kept = [c for c in reviews.columns if c != "_known_candidate"]
    checked = looked_up.select(*kept, review_errors(looked_up).alias("errors"))
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


def pending_reviews(tables: Tables, reviews: DataFrame) -> DataFrame:
    """Reviews that are not yet in the reviewed state, with the candidate's source and whether the candidate is known."""
    state = tables["curation_candidate"].select(
        F.col("id").alias("candidate_id"), "source_document_id",
        F.col("validation_status").alias("_status"), F.col("curator_decision").alias("_decision"), F.lit(True).alias("_known_candidate"),
    )
    joined = reviews.join(state, "candidate_id", "left").withColumn("_known_candidate", F.coalesce("_known_candidate", F.lit(False)))
    synced = (F.col("_status") == F.col("validation_status")) & (F.col("_decision") == F.col("curator_decision"))
    return joined.filter(~F.coalesce(synced, F.lit(False))).drop("_status", "_decision")


def ensure_dimension(existing: DataFrame, wanted: DataFrame, key: list[str], extra: dict[str, Column], first: tuple[str, ...] = ()) -> DataFrame:
    """Existing rows plus one new row per unknown key; a new id is the hash of the key.

    The columns `first` come from the wanted row with the smallest candidate id.
    """
    carried = [c for c in first if c in wanted.columns]
    one = wanted.groupBy(*key).agg(F.min_by(F.struct(*carried), "candidate_id").alias("_first")).select(*key, "_first.*") if carried else wanted.select(*key).distinct()
    new = one.join(existing.select(*key), key, "left_anti")
    rows = new.withColumn("id", F.xxhash64(*key)).withColumns(extra)
    return existing.unionByName(rows, allowMissingColumns=True)


def _audit_rows(df: DataFrame, table: Column, entity: Column, status: Column, decision: Column, now: str) -> DataFrame:
    return df.select(
        F.xxhash64(table, entity, decision, F.lit(now)).alias("id"),
        table.alias("entity_table"),
        entity.alias("entity_id"),
        F.lit("curator_review_v1").alias("extraction_method"),
        F.lit("promote_review").alias("extractor_model_or_script"),
        status.alias("validation_status"),
        decision.alias("curator_decision"),
        text_or_empty("curator_id").alias("curator_id"),
        text_or_empty("audit_note").alias("audit_note"),
        F.lit(now).alias("audited_at"),
    )


def _updated_candidates(candidates: DataFrame, decided: DataFrame) -> DataFrame:
    new = decided.select(
        F.col("candidate_id").alias("id"), F.col("validation_status").alias("_status"), F.col("curator_decision").alias("_decision")
    )
    joined = candidates.join(new, "id", "left")
    return joined.withColumns(
        {
            "validation_status": F.coalesce("_status", "validation_status"),
            "curator_decision": F.coalesce("_decision", "curator_decision"),
        }
    ).drop("_status", "_decision")


def sync_rejects(tables: Tables, reviews: DataFrame, now: str) -> dict[str, DataFrame]:
    """Apply valid reject reviews: candidate status and one audit row each."""
    valid, _ = validate_review(pending_reviews(tables, reviews), tables)
    rejects = valid.filter("curator_decision = 'reject'")
    audits = _audit_rows(rejects, F.lit("curation_candidate"), F.col("candidate_id"), F.col("validation_status"), F.col("curator_decision"), now)
    return {
        **dict(tables),
        "curation_candidate": _updated_candidates(tables["curation_candidate"], rejects),
        "curation_audit": tables["curation_audit"].unionByName(audits, allowMissingColumns=True),
    }


def resolved_reviews(tables: Tables, reviews: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accepted reviews with modality and molecule ids; and the modality and molecule tables that hold them."""
    valid, _ = validate_review(pending_reviews(tables, reviews), tables)
    accepts = valid.filter("curator_decision = 'accept'")
    name = _either(MODALITY_NAMES, accepts)
    named = accepts.withColumns(
        {
            "_modality": F.when(name == MIXED[0], MIXED[1]).otherwise(name),
            "canonical_name": _either(MOLECULE_NAMES, accepts),
            "target_gene_symbol": _either(TARGET_NAMES, accepts),
            **{c: null_if_blank(strip(text_or_empty(c))) for c in ("disease_context", "therapeutic_status") if c in accepts.columns},
            **({"external_ids": first_text(strip(text_or_empty("external_ids")), default="{}")} if "external_ids" in accepts.columns else {}),
        }
    )
    modality = ensure_dimension(
        tables["modality"],
        named.filter(~has_text("molecule_id")).select(F.col("_modality").alias("name")).filter(has_text("name")),
        ["name"],
        {"in_core_scope": F.lit(1), "scope_note": F.lit("Created during curator-verified release promotion")},
    )
    ids = modality.select(F.col("name").alias("_modality"), F.col("id").alias("modality_id"))
    # A review with a molecule id needs no modality; without one, the checks have made sure that it has.
    with_modality = named.join(ids, "_modality", "left")
    key = ["canonical_name", "modality_id", "_target"]
    existing = tables["molecule"].withColumn("_target", text_or_empty("target_gene_symbol"))
    wanted = with_modality.filter(~has_text("molecule_id")).withColumn("_target", F.col("target_gene_symbol"))
    molecule = ensure_dimension(existing, wanted, key, {"target_gene_symbol": null_if_blank("_target")}, ("disease_context", "therapeutic_status", "external_ids"))
    known = molecule.groupBy(*key).agg(F.min("id").alias("_mid"))
    given = F.col("molecule_id").cast("string").try_cast("bigint")
    resolved = (
        with_modality.withColumn("_target", F.col("target_gene_symbol"))
        .join(known, key, "left")
        .withColumn("molecule_id", F.coalesce(given, F.col("_mid")))
        .withColumn("fact_id", F.xxhash64(F.lit("fact"), "candidate_id"))
        .withColumn("assay_id", F.when(has_text("assay_type"), F.xxhash64(F.lit("assay"), "candidate_id")))
    )
    return resolved, modality, molecule.drop("_target")


def promote_review(tables: Tables, reviews: DataFrame, now: str) -> dict[str, DataFrame]:
    """Turn valid accepted reviews into release rows, with their molecule, assay, audit and split rows.

    New ids are hashes of natural keys, so the merge is one set of joins without counters, and running it
    again adds nothing.
    """
    rows, modality, molecule = resolved_reviews(tables, reviews)
    rows = materialize(rows)  # read by every table below; as many rows as accepted reviews
    shared = [
        F.col("fact_id").alias("id"), "molecule_id", "assay_id", "source_document_id",
        F.col("source_location_verified").alias("source_location"), "evidence_grade", F.lit(1).alias("is_observed_experimental"),
    ]
    toxicity = rows.filter("verified_entity_table = 'toxicity_endpoint'").select(*shared, "endpoint_name", "endpoint_category")
    offtarget = rows.filter("verified_entity_table = 'offtarget_evidence'").select(
        *shared, "evidence_type", F.lit(0).alias("is_computational_prediction")
    )
    assays = rows.filter("assay_id IS NOT NULL").select(
        F.col("assay_id").alias("id"), "assay_type", "source_document_id", F.col("source_location_verified").alias("source_location")
    )
    audits = _audit_rows(rows, F.col("verified_entity_table"), F.col("fact_id"), F.col("validation_status"), F.col("curator_decision"), now)
    group = F.concat(F.lit("source:"), F.col("source_document_id").cast("string"), F.lit("|molecule:"), F.col("molecule_id").cast("string"))
    eligible = F.lower(text_or_empty("benchmark_eligible_proposed")).isin("1", "true", "yes", "y") & F.col("evidence_grade").isin("A", "B")
    splits = (
        rows.filter(eligible)
        .select(
            F.col("fact_id").alias("id"),
            F.when(F.col("verified_entity_table") == "offtarget_evidence", "offtarget_safety").otherwise("toxicity_safety").alias("task_name"),
            F.col("verified_entity_table").alias("entity_table"),
            F.col("fact_id").alias("entity_id"),
            group.alias("leakage_group"),
            split_by_hash(group).alias("split_name"),
            F.lit("source_plus_molecule_grouped_hash_v1").alias("split_strategy"),
            F.lit("curator_review").alias("version"),
        )
        .join(tables["benchmark_split"].select("entity_table", "entity_id"), ["entity_table", "entity_id"], "left_anti")
    )

    def plus(name: str, new: DataFrame) -> DataFrame:
        return tables[name].unionByName(new, allowMissingColumns=True)

    return {
        **dict(tables),
        "modality": modality,
        "molecule": molecule,
        "assay": plus("assay", assays),
        "toxicity_endpoint": plus("toxicity_endpoint", toxicity),
        "offtarget_evidence": plus("offtarget_evidence", offtarget),
        "curation_audit": plus("curation_audit", audits),
        "benchmark_split": plus("benchmark_split", splits),
        "curation_candidate": _updated_candidates(tables["curation_candidate"], rows),
    }


def verdict_outcomes(tables: Tables, verdicts: DataFrame) -> DataFrame:
    """Add the outcome of each verdict. `verdicts` has ord, entity_table, entity_id, human_decision, human_curator_id.

    A verdict on an entity that an earlier verdict removed counts as unknown.
    """
    live = fact_rows(tables).select("entity_table", F.col("evidence_id").alias("entity_id"), F.lit(True).alias("_live"))
    decision = F.lower(strip(text_or_empty("human_decision")))
    rows = verdicts.withColumn("_d", decision).join(live, ["entity_table", "entity_id"], "left")
    complete = has_text("human_curator_id") & F.coalesce("_live", F.lit(False))
    removals = rows.filter((F.col("_d") == "reject") & complete).groupBy("entity_table", "entity_id").agg(F.min("ord").alias("_gone"))
    joined = rows.join(removals, ["entity_table", "entity_id"], "left")
    gone = F.coalesce(F.col("ord") > F.col("_gone"), F.lit(False))
    outcome = (
        F.when(~F.col("_d").isin("accept", "reject"), "skipped_blank_or_abstain")
        .when(~text_or_empty("entity_table").isin(FACTS), "skipped_bad_table")
        .when(F.col("entity_id").isNull(), "unknown_entity")
        .when(~has_text("human_curator_id"), "skipped_no_curator")
        .when(F.col("_live").isNull() | gone, "unknown_entity")
        .when(F.col("_d") == "reject", "rejected_removed")
        .otherwise("accept_confirmed")
    )
    return joined.withColumn("outcome", outcome).drop("_live", "_d", "_gone")


def apply_verdicts(tables: Tables, verdicts: DataFrame, now: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Apply human verdicts: rejected facts and their split rows go, every applied verdict leaves an audit row.

    Returns the new tables and the counts per outcome, with the number of split rows removed. Nothing is
    written, so a dry run is simply not writing the result.
    """
    decided = materialize(verdict_outcomes(tables, verdicts))  # as many rows as verdicts
    removed = decided.filter("outcome = 'rejected_removed'").select("entity_table", "entity_id")
    applied = decided.filter(F.col("outcome").isin("rejected_removed", "accept_confirmed"))
    reject = F.col("outcome") == "rejected_removed"
    noted = applied.withColumns(
        {"curator_id": F.col("human_curator_id"), "audit_note": first_text(strip(text_or_empty("human_note")), "grounding_quote", default="")}
    )
    audits = _audit_rows(
        noted, F.col("entity_table"), F.col("entity_id"), F.when(reject, "recurated_rejected").otherwise("curator_verified"),
        F.when(reject, "reject").otherwise("accept"), now,
    )
    out = dict(tables)
    for fact in FACTS:
        gone = removed.filter(F.col("entity_table") == fact).select(F.col("entity_id").alias("id"))
        out[fact] = tables[fact].join(gone, "id", "left_anti")
    out["benchmark_split"] = tables["benchmark_split"].join(removed, ["entity_table", "entity_id"], "left_anti")
    out["curation_audit"] = tables["curation_audit"].unionByName(audits, allowMissingColumns=True)
    dropped = tables["benchmark_split"].join(removed, ["entity_table", "entity_id"], "left_semi")
    counts = decided.groupBy("outcome").agg(F.count("*").alias("n"))
    lost = dropped.agg(F.count("*").alias("n")).select(F.lit("benchmark_removed").alias("outcome"), "n")
    return out, counts.unionByName(lost)


# Product names and development codes accepted as a molecule name in a title.
PRODUCT_NAMES = (
    "patisiran givosiran lumasiran inclisiran vutrisiran nedosiran fitusiran cemdisiran teprasiran olpasiran "
    "zilebesiran plozasiran nusinersen mipomersen inotersen volanesorsen eteplirsen golodirsen viltolarsen casimersen "
    "tofersen donidalorsen olezarsen sepofarsen tominersen defibrotide fomivirsen pegaptanib avacincaptad solbinsiran"
).split()
PRODUCT_CODES = (
    r"\b(?:AZD\d{3,5}|ION[- ]?\d{3,6}|ISIS[- ]?\d{3,6}|AKCEA[- ]?[A-Z0-9-]+|GSK\d{3,6}|RG\d{3,6}|RO\d{6,7}|LY\d{6}|"
    r"LX\d{4}|ARO[- ]?[A-Z0-9]+|ALN[- ]?[A-Z0-9]+|SLN\d{2,4}|MTL[- ]?[A-Z0-9]+|VIR[- ]?\d{3,6}|IONIS[- ]?[A-Z][A-Z]+(?:[- ]?[A-Z0-9]+)?)\b"
)


def name_from_title(title: str = "title", names: list[str] | None = None, codes: str = PRODUCT_CODES) -> Column:
    """Product name (lower case) or code (upper case, hyphenated) in a title, else NULL."""
    product = F.lower(F.regexp_extract(text_or_empty(title), r"(?i)\b(?:" + "|".join(names or PRODUCT_NAMES) + r")\b", 0))
    code = F.replace(F.upper(F.regexp_extract(text_or_empty(title), codes, 0)), F.lit(" "), F.lit("-"))
    return F.coalesce(null_if_blank(product), null_if_blank(code))


def split_shared_placeholders(
    tables: Tables, placeholders: DataFrame, names: list[str] | None = None, codes: str = PRODUCT_CODES
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Give each (source, placeholder molecule) pair its own molecule and repair the split groups.

    `placeholders` is a short table (placeholder_id, label, modality_id). The new id is the hash of the
    pair, so facts are repointed by an expression, without a lookup of the new rows.
    """
    marks = placeholders.select(F.col("placeholder_id").alias("molecule_id"), F.lit(True).alias("_shared"))
    new_id = F.xxhash64("source_document_id", "molecule_id")

    def repoint(df: DataFrame) -> DataFrame:
        joined = df.join(marks, "molecule_id", "left")
        return joined.withColumn("molecule_id", F.when(F.col("_shared"), new_id).otherwise(F.col("molecule_id"))).drop("_shared").select(*df.columns)

    shared = fact_rows(tables).join(marks, "molecule_id", "left_semi")
    pairs = shared.select("source_document_id", "molecule_id").distinct()
    source = tables["source_document"].select(F.col("id").alias("source_document_id"), "pmid", "title")
    info = placeholders.select(F.col("placeholder_id").alias("molecule_id"), "label", "modality_id")
    described = pairs.join(source, "source_document_id").join(info, "molecule_id")
    recovered = name_from_title("title", names, codes)
    canonical = (
        F.when(recovered.isNotNull(), F.format_string("%s (recovered from PMID:%s)", recovered, text_or_empty("pmid")))
        .when(has_text("pmid"), F.format_string("unspecified %s (PMID:%s, source-only)", F.col("label"), F.col("pmid")))
        .otherwise(F.format_string("unspecified %s (source_doc:%s, source-only)", F.col("label"), F.col("source_document_id").cast("string")))
    )
    created = described.select(
        new_id.alias("id"), canonical.alias("canonical_name"), "modality_id", F.lit("unspecified").alias("therapeutic_status"),
        F.lit("unspecified").alias("sequence_annotation_status"), F.lit("unspecified").alias("modification_annotation_status"),
    )
    gone = placeholders.select(F.col("placeholder_id").alias("id"))
    out = dict(tables)
    out["molecule"] = tables["molecule"].join(gone, "id", "left_anti").unionByName(created, allowMissingColumns=True)
    for fact in FACTS:
        out[fact] = repoint(tables[fact])
    touched = shared.select(
        "entity_table", F.col("evidence_id").alias("entity_id"),
        F.concat(F.lit("source:"), F.col("source_document_id").cast("string"), F.lit("|molecule:"), new_id.cast("string")).alias("_group"),
    )
    regrouped = (
        tables["benchmark_split"]
        .join(touched, ["entity_table", "entity_id"], "left")
        .withColumn("leakage_group", F.coalesce("_group", "leakage_group"))
        .drop("_group")
    )
    bad = leakage_violations(regrouped.withColumn("task_name", F.lit("all"))).select("leakage_group")
    out["benchmark_split"] = regrouped.join(bad, "leakage_group", "left_anti")

    def metrics(phase: str, t: Mapping[str, DataFrame]) -> DataFrame:
        facts = fact_rows(t)
        attached = facts.join(marks, "molecule_id", "left_semi").agg(F.count("*").alias("n"))
        molecules = facts.join(t["molecule"].select(F.col("id").alias("molecule_id")), "molecule_id", "left_semi").agg(F.countDistinct("molecule_id").alias("n"))
        splits = t["benchmark_split"].agg(F.count("*").alias("n"))
        spanning = leakage_violations(t["benchmark_split"].withColumn("task_name", F.lit("all"))).agg(F.count("*").alias("n"))
        parts = {"placeholder_rows": attached, "release_molecules": molecules, "split_rows": splits, "spanning_groups": spanning}
        return reduce(DataFrame.unionByName, [d.select(F.lit(phase).alias("phase"), F.lit(k).alias("metric"), "n") for k, d in parts.items()])

    return out, metrics("before", tables).unionByName(metrics("after", out))


# --- packets -----------------------------------------------------------------------------------------------

MISSING_MARKERS = ["", "na", "n/a", "nan", "none", "null"]  # fixed values: lower-case "no value" in packets


def has_value(c: str) -> Column:
    return ~F.lower(strip(text_or_empty(c))).isin(MISSING_MARKERS)


def _none_of(cols: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [~has_value(c) for c in cols])


def _row_hash(*cols: Column | str) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols]), 256), 1, 12)


def release_rows_with_assay(tables: Tables) -> DataFrame:
    """Facts with molecule, modality, source, assay, benchmark membership and first accepted audit."""
    from attesta.operators.release import star_join

    assay = tables["assay"].select(
        F.col("id").alias("assay_id"), "organism", "model_system", "cell_line_or_tissue", "dose_value", "dose_unit",
        "exposure_time_value", "exposure_time_unit",
    )
    split = tables["benchmark_split"].select("entity_table", F.col("entity_id").alias("evidence_id")).distinct()
    accepted = tables["curation_audit"].filter("curator_decision = 'accept'")
    first = accepted.groupBy("entity_table", F.col("entity_id").alias("evidence_id")).agg(
        F.min(F.struct("id", "validation_status", "curator_decision", "audit_note")).alias("_a")
    )
    rows = star_join(fact_rows(tables), tables).join(assay, "assay_id", "left")
    keyed = rows.join(split.withColumn("_b", F.lit(True)), ["entity_table", "evidence_id"], "left").join(first, ["entity_table", "evidence_id"], "left")
    return keyed.withColumns(
        {
            "benchmark_eligible": F.when(F.col("_b"), "yes").otherwise("no"),
            "original_validation_status": F.col("_a.validation_status"),
            "original_curator_decision": F.col("_a.curator_decision"),
            "original_audit_note": F.col("_a.audit_note"),
        }
    ).drop("_a", "_b")


def core_field_packet(tables: Tables) -> DataFrame:
    """Release rows with seven missing-field flags and a priority; the row id is a hash of the record key."""
    grade = F.col("evidence_grade")
    priority = F.when(F.col("benchmark_eligible") == "yes", "P0").when(grade.isin("A", "B"), "P1").otherwise("P2")
    return release_rows_with_assay(tables).select(
        F.concat(F.lit("core-field-"), _row_hash("entity_table", "evidence_id")).alias("packet_row_id"),
        "evidence_domain", "entity_table", "evidence_id", "evidence_grade", "benchmark_eligible", "canonical_name", "modality",
        "pmid", "doi", "source_location",
        priority.alias("priority"),
        _none_of(["sense_sequence", "antisense_sequence", "guide_sequence", "passenger_sequence"]).alias("missing_sequence"),
        _none_of(["seed_region"]).alias("missing_seed"),
        _none_of(["backbone_chemistry", "sugar_modification", "base_modification"]).alias("missing_modification"),
        _none_of(["conjugate_delivery"]).alias("missing_delivery"),
        _none_of(["dose_value", "dose_unit"]).alias("missing_dose"),
        _none_of(["exposure_time_value", "exposure_time_unit"]).alias("missing_exposure"),
        _none_of(["organism", "model_system", "cell_line_or_tissue"]).alias("missing_model"),
        F.lit("pending").alias("curator_decision"),
        F.lit("needs_core_field_curation").alias("review_status"),
    )


REVIEWER_COLUMNS = (
    "reviewer2_decision reviewer2_evidence_grade reviewer2_source_location_verified reviewer2_error_type reviewer2_note "
    "adjudication_decision adjudicator_note"
).split()


def validation_packet(tables: Tables, existing: DataFrame | None = None, target: int = 250) -> DataFrame:
    """Sample of released rows and of rejected candidates for a second review; given answers are kept.

    The sample id is a hash of the record, so an answer stays with its record when the sample changes.
    """
    released = release_rows_with_assay(tables).select(
        F.lit("release_accept").alias("item_type"), "entity_table", F.col("evidence_id").alias("entity_id"), "evidence_domain", "evidence_grade",
        F.concat_ws("/", F.lit("release_accept"), "entity_table", text_or_empty("evidence_grade"), "benchmark_eligible").alias("stratum"),
        first_text("original_curator_decision", default="accept").alias("original_curator_decision"),
        F.concat_ws(":", "entity_table", F.col("evidence_id").cast("string")).alias("record"),
    )
    candidates = tables["curation_candidate"].filter("curator_decision = 'reject' OR validation_status = 'curator_rejected'")
    rejected = candidates.select(
        F.lit("candidate_reject_control").alias("item_type"), F.lit("curation_candidate").alias("entity_table"), F.col("id").alias("entity_id"),
        "evidence_domain", F.col("suggested_evidence_grade").alias("evidence_grade"),
        F.concat_ws("/", F.lit("candidate_reject_control"), "evidence_domain", text_or_empty("suggested_evidence_grade"), text_or_empty("candidate_modality")).alias("stratum"),
        F.col("curator_decision").alias("original_curator_decision"),
        F.concat(F.lit("curation_candidate:"), F.col("id").cast("string")).alias("record"),
    )
    sample = stratified_sample(released, "stratum", "record", target).unionByName(stratified_sample(rejected, "stratum", "record", target))
    prefix = F.when(F.col("item_type") == "release_accept", "iv-release-").otherwise("iv-reject-")
    packet = sample.withColumn("validation_sample_id", F.concat(prefix, _row_hash("record"))).drop("record")
    if existing is None:
        return packet.withColumns({c: F.lit("") for c in REVIEWER_COLUMNS})
    answers = existing.select("validation_sample_id", *[c for c in REVIEWER_COLUMNS if c in existing.columns])
    joined = packet.join(answers, "validation_sample_id", "left")
    return joined.withColumns({c: text_or_empty(c) if c in joined.columns else F.lit("") for c in REVIEWER_COLUMNS})


def change_diff(old: DataFrame, new: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """One row per changed value: (key, column_name, old_value, new_value); NULL-safe, added and removed rows included."""
    o = old.select(F.col(key).alias("_k"), *[F.col(c).cast("string").alias(f"o_{c}") for c in cols])
    n = new.select(F.col(key).alias("_n"), *[F.col(c).cast("string").alias(f"n_{c}") for c in cols])
    both = o.join(n, F.col("_k") == F.col("_n"), "full").withColumn(key, F.coalesce("_k", "_n"))
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(f"o_{c}").alias("old_value"), F.col(f"n_{c}").alias("new_value")) for c in cols]
    )
    return both.select(key, F.inline(pairs)).filter(~F.col("old_value").eqNullSafe(F.col("new_value")))



