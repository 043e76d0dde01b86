"""Safety triage: designs against concerns, evidence states, evidence graph and dossier.

Everything is batched over a table of designs. A design has design_id and the text columns of
DESIGN_FIELDS; absent columns count as ''.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.queries import field_values, groups_or_raw, joined_offtarget, query_terms
from attesta.functions.sequence import (
    canonical_sequence,
    has_ambiguous,
    invalid_characters,
    kmer_windows,
    seed_2_8,
    sequence_from_helm,
)
from attesta.functions.text import (
    CONFIDENCE_RANK,
    GRADE_RANK,
    first_text,
    has_text,
    node_id,
    rank_of,
    report_id,
    split_terms,
    strip,
    text_or_empty,
)
from attesta.lexicons import CONCERNS, SEARCH_STOPWORDS, SEARCH_SYNONYMS, Concern
from attesta.operators.release import by_dimension
from attesta.operators.search import CANDIDATE_FIELDS as LISTED
from attesta.operators.search import EVIDENCE_FIELDS
from attesta.operators.spelling import SpellingIndex, signed_rows, spellings_of
from attesta.operators.windows import first_occurrence, top_per_group
from attesta.session import materialize, store

DESIGN_FIELDS = "sequence helm target modification delivery endpoint species cell_type".split()
# Fields a concern is looked for in.
RELEASE_FIELDS = (
    "canonical_name category evidence_label target_gene_symbol disease_context backbone_chemistry sugar_modification "
    "base_modification conjugate_delivery modality source_location source_title pmid doi"
).split()
CANDIDATE_FIELDS = "candidate_signal matched_terms candidate_modality source_location source_title pmid doi".split()
# Confidence as a number; candidates are listed with the low values first.
CONFIDENCE_VALUE = {"high_candidate": 3, "medium_candidate": 2, "low_candidate": 1}
# States, from strongest to weakest.
STATES = ["evidence-supported concern", "contextual release evidence", "evidence gap", "not assessable from current release"]


def term_variants(
    terms: Column, synonyms: dict[str, list[str]] = SEARCH_SYNONYMS, stopwords: list[str] = SEARCH_STOPWORDS
) -> Column:
    """Normalized terms followed by the spellings of their tokens, distinct, two characters or more."""

    def variants(term: Column) -> Column:
        cleaned = strip(joined_offtarget(term))
        spellings = F.flatten(query_terms(cleaned, synonyms, stopwords, 4))
        return F.when(F.length(cleaned) >= 2, F.concat(F.array(cleaned), spellings)).otherwise(F.array().cast("array<string>"))

    flat = F.transform(F.flatten(F.transform(terms, variants)), lambda v: strip(joined_offtarget(v)))
    return F.array_distinct(F.filter(flat, lambda v: F.length(v) >= 2))


def matched_variants(found: Column, variants: Column) -> Column:
    """The variants among the spellings found in a row, in their order."""
    return F.filter(variants, lambda v: F.array_contains(found, v))


def match_score(found: Column, variants: Column, target: Column) -> Column:
    """Matched distinct variants, plus 3 when the target is in the row."""
    hits = F.size(matched_variants(found, variants))
    return hits + F.when((target != "") & F.array_contains(found, target), F.lit(3)).otherwise(F.lit(0))


def design_features(designs: DataFrame) -> DataFrame:
    """Designs with every text column, the canonical sequence and its features."""
    full = designs.withColumns({c: text_or_empty(c) if c in designs.columns else F.lit("") for c in DESIGN_FIELDS})
    raw = F.when(F.col("sequence") == "", sequence_from_helm("helm")).otherwise(F.col("sequence"))
    return (
        full.withColumn("raw_sequence", raw)
        .withColumn("canonical", canonical_sequence("raw_sequence"))
        .withColumns(
            {
                "seed": seed_2_8("canonical"),
                "windows": kmer_windows("canonical"),
                "ambiguous": has_ambiguous("canonical"),
                "invalid": invalid_characters("raw_sequence"),
                "report_id": report_id("canonical", "target", "modification", "delivery", "endpoint", "species", "cell_type"),
            }
        )
        .withColumn(
            "sequence_status",
            F.when((F.length("canonical") >= 7) & (F.size("invalid") == 0), "valid seed-aware input").otherwise(
                "sequence input incomplete for seed-aware triage"
            ),
        )
    )


def triage_plans(
    designs: DataFrame,
    concerns: Sequence[Concern] = CONCERNS,
    synonyms: dict[str, list[str]] = SEARCH_SYNONYMS,
    stopwords: list[str] = SEARCH_STOPWORDS,
) -> DataFrame:
    """One row per (design, concern): the domain, the search variants and the normalized target."""
    featured = design_features(designs)
    listed = split_terms("target", "modification", "delivery", "endpoint", "species", "cell_type")
    inputs = F.slice(F.when(F.col("seed") != "", F.concat(listed, F.array("seed"))).otherwise(listed), 1, 5)

    def plan(c: Concern) -> Column:
        own = F.array(*[F.lit(t) for t in c.terms])
        if c.extra_from:
            own = F.when(has_text(c.extra_from), F.concat(own, F.array(F.col(c.extra_from)))).otherwise(own)
        terms = F.concat(inputs, F.slice(own, 1, 6))
        return F.struct(
            F.lit(c.key).alias("concern_id"), F.lit(c.domain).alias("domain"), F.lit(c.label).alias("concern"), terms.alias("terms")
        )

    rows = featured.select("design_id", F.col("target").alias("_t"), F.inline(F.array(*[plan(c) for c in concerns])))
    return rows.select(
        "design_id", "concern_id", "concern", "domain",
        term_variants(F.col("terms"), synonyms, stopwords).alias("variants"),
        strip(joined_offtarget("_t")).alias("target"),
        F.concat_ws("\u0001", "design_id", "concern_id").alias("plan_key"),
    )


def _best_matches(rows: DataFrame, fields: list[str], plans: DataFrame, order: list[Column], keep: list[str], with_target: bool, limit: int) -> DataFrame:
    """The best `limit` rows per (design, concern) with score > 0, with their rank: by score, then by `order`.

    Rows of one domain and signature have one score, so the first of them by `order` are all that can be among the best.
    """
    target = F.col("target") if with_target else F.lit("")
    wanted = plans.select(
        "design_id", "concern_id", F.col("domain").alias("evidence_domain"), "plan_key", "variants", target.alias("_target"),
        F.when(target != "", F.concat("variants", F.array(target))).otherwise(F.col("variants")).alias("_spellings"),
    )
    values = [[text_or_empty(f) for f in part] for part in by_dimension(fields)]
    signed = signed_rows(rows, values, store(wanted.select(F.explode("_spellings").alias("spelling"))), joined_offtarget)
    shown_rows = top_per_group(signed, ["evidence_domain", "_sig"], order, limit).select("_sig", "found", *dict.fromkeys([*keep, "evidence_domain"]))
    index = SpellingIndex(store(shown_rows))
    on_target = (F.col("_target") != "") & F.array_contains("found", F.col("_target"))
    shown = F.when(on_target & ~F.array_contains("_matched", F.col("_target")), F.concat("_matched", F.array("_target"))).otherwise(F.col("_matched"))
    scored = (
        index.sharing(wanted, "plan_key", "_spellings")
        .join(wanted, "plan_key")
        .withColumn("_matched", matched_variants(F.col("found"), F.col("variants")))
        .select(
            "design_id", "concern_id", "evidence_domain", "_sig",
            match_score(F.col("found"), F.col("variants"), F.col("_target")).alias("match_score"),
            F.array_join(F.slice(shown, 1, 8), ", ").alias("matched_terms_shown"),
        )
    )
    hits = index.rows.join(store(scored), ["evidence_domain", "_sig"])
    best = top_per_group(hits, ["design_id", "concern_id"], [F.desc("match_score"), *order], limit, rank_col="rank")
    return best.select("design_id", "concern_id", "match_score", "matched_terms_shown", *keep, "rank")


def concern_matches(plans: DataFrame, view: DataFrame, candidates: DataFrame, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """The best release rows and the best open candidates per design and concern, with their rank.

    Release rows: score, grade, record. Candidates: score, then low confidence first, then id.
    """
    record = F.concat_ws(":", "evidence_domain", F.col("evidence_id").cast("string"))
    keep = "record entity_table evidence_id evidence_domain evidence_grade canonical_name evidence_label pmid doi source_title source_url".split()
    by_grade = [F.desc(rank_of("evidence_grade", GRADE_RANK, 0)), F.asc("record")]
    release = _best_matches(view.withColumn("record", record), RELEASE_FIELDS, plans, by_grade, keep, True, limit)
    pool = candidates.filter(text_or_empty("curator_decision") != "accept")
    open_keep = ["id", "evidence_domain", "confidence_label", "matched_terms", "source_location", "pmid"]
    by_confidence = [F.asc(rank_of("confidence_label", CONFIDENCE_VALUE, 0)), F.asc("id")]
    return release, _best_matches(pool, CANDIDATE_FIELDS, plans, by_confidence, open_keep, False, limit)


def evidence_state(plans: DataFrame, release: DataFrame, gaps: DataFrame) -> DataFrame:
    """State of every (design, concern): supported by A/B, contextual by C, a gap with candidates only, or neither."""
    key = ["design_id", "concern_id"]
    graded = F.col("evidence_grade").isin("A", "B")
    found = release.groupBy(*key).agg(
        F.count("*").alias("release_records"),
        F.count(F.when(graded, 1)).alias("benchmark_eligible_records"),
        F.max(F.when(graded, 2).when(F.col("evidence_grade") == "C", 1).otherwise(0)).alias("_best"),
    )
    opened = gaps.groupBy(*key).agg(F.count("*").alias("candidate_records"))
    joined = plans.select(*key, "concern", "domain").join(found, key, "left").join(opened, key, "left").na.fill(0)
    state = (
        F.when(F.col("_best") == 2, STATES[0])
        .when(F.col("_best") == 1, STATES[1])
        .when(F.col("candidate_records") > 0, STATES[2])
        .otherwise(STATES[3])
    )
    return joined.withColumn("evidence_state", state).drop("_best")


def risk_matrix(states: DataFrame) -> DataFrame:
    """Concerns of a design in reporting order: state, records, label."""
    rank = rank_of("evidence_state", {s: 3 - i for i, s in enumerate(STATES)}, 0)
    order = [F.desc(rank), F.desc("release_records"), F.asc("concern")]
    return states.withColumn("position", F.row_number().over(Window.partitionBy("design_id").orderBy(*order)))


def safety_triage(
    designs: DataFrame,
    view: DataFrame,
    candidates: DataFrame,
    concerns: Sequence[Concern] = CONCERNS,
    synonyms: dict[str, list[str]] = SEARCH_SYNONYMS,
    stopwords: list[str] = SEARCH_STOPWORDS,
    limit: int = 20,
) -> dict[str, DataFrame]:
    """Triage of all designs: plans, release, gaps, states, matrix, report."""
    plans = store(triage_plans(designs, concerns, synonyms, stopwords))
    # Matches are bounded by designs x concerns x limit, and every later table reads them.
    release, gaps = (materialize(m) for m in concern_matches(plans, view, candidates, limit))
    states = evidence_state(plans, release, gaps)
    considered = release.filter("rank <= 8").select("design_id", "record").distinct()
    gap_rows = gaps.filter("rank <= 8").select("design_id", "id").distinct()
    summary = states.groupBy("design_id").agg(
        *[F.count(F.when(F.col("evidence_state") == s, 1)).alias(n) for s, n in zip(
            STATES, ["supported_concerns", "contextual_concerns", "gap_concerns", "not_assessable_concerns"], strict=True
        )]
    )
    report = (
        design_features(designs)
        .select("design_id", "report_id", F.length("canonical").alias("length"), "seed", "ambiguous", "sequence_status", "target", "modification", "delivery", "endpoint")
        .join(summary, "design_id", "left")
        .join(considered.groupBy("design_id").agg(F.count("*").alias("release_considered")), "design_id", "left")
        .join(gap_rows.groupBy("design_id").agg(F.count("*").alias("candidates_considered")), "design_id", "left")
        .na.fill(0)
        .withColumn(
            "interpretation",
            F.when(F.col("supported_concerns") >= 3, "Evidence-dense safety review required.").otherwise(
                "Use as a source-grounded triage report with complementary sequence assessment."
            ),
        )
    )
    return {"plans": plans, "release": release, "gaps": gaps, "states": states, "matrix": risk_matrix(states), "report": report}


def matched_release_records(triage: dict[str, DataFrame], first: int = 30) -> DataFrame:
    """Distinct records of the top 8 per concern, best grade first, at most `first` per design."""
    top = triage["release"].filter("rank <= 8")
    unique = first_occurrence(top, ["design_id", "record"], [F.asc("concern_id"), F.asc("rank")])
    return top_per_group(
        unique, ["design_id"], [F.desc(rank_of("evidence_grade", GRADE_RANK, 0)), F.asc("record")], first, rank_col="position"
    )


def sequence_search(designs: DataFrame, view: DataFrame, candidates: DataFrame, limit: int = 25, synonyms: dict[str, list[str]] = SEARCH_SYNONYMS, stopwords: list[str] = SEARCH_STOPWORDS) -> DataFrame:
    """Release and candidate hits for designs: (design_id, kind, id, position).

    The query is the first four of target, modification, endpoint and the seed words; without a release hit
    the target alone is searched. Candidates must contain the raw first term.
    """
    featured = design_features(designs)
    words = F.filter(F.array("target", "modification", "endpoint"), lambda t: t != "")
    seeded = F.when(F.col("seed") != "", F.array(*[F.lit(t) for t in ("seed", "off-target", "hybridization", "mismatch")])).otherwise(
        F.array().cast("array<string>")
    )
    terms = F.concat(words, seeded)
    terms = F.when(F.size(terms) == 0, F.array(F.lit("seed"), F.lit("off-target"), F.lit("hybridization"))).otherwise(terms)
    q = F.array_join(F.slice(terms, 1, 4), " ")
    raw = first_text("modification", "endpoint", "target", F.when(F.col("seed") != "", "seed").otherwise(q))

    def groups(text: Column) -> Column:
        return groups_or_raw(text, query_terms(text, synonyms, stopwords))

    plans = featured.select(
        "design_id", groups(q).alias("groups"), F.lower("target").alias("_target"),
        F.when(F.col("target") != "", groups(F.col("target"))).alias("fallback"), F.array(F.array(F.lower(raw))).alias("raw"),
    )
    plans = store(plans)
    order = [F.desc("evidence_domain"), F.asc("evidence_id")]
    wanted = spellings_of(plans, "groups").unionByName(spellings_of(plans.filter("fallback IS NOT NULL"), "fallback"))
    # What a plan asks depends on signature and target alone: the first rows of each pair are all that can be listed.
    signed = signed_rows(view, [field_values(part) for part in by_dimension(EVIDENCE_FIELDS)], wanted)
    first = top_per_group(signed, ["_sig", "target_gene_symbol"], order, limit)
    index = SpellingIndex(store(first.select("_sig", "found", "target_gene_symbol", "evidence_domain", "evidence_id")))

    on_target = (F.col("_target") == "") | F.contains(F.lower(text_or_empty("target_gene_symbol")), F.col("_target"))
    keep = ["evidence_domain", "evidence_id"]
    main = index.rows_of(plans.select("design_id", "groups", "_target"), "design_id", "groups", keep, on_target)
    found = store(top_per_group(main, ["design_id"], order, limit, rank_col="position"))
    again = plans.filter("fallback IS NOT NULL").join(found.select("design_id").distinct(), "design_id", "left_anti")
    second = index.rows_of(again.select("design_id", "fallback"), "design_id", "fallback", keep)
    release = found.unionByName(top_per_group(second, ["design_id"], order, limit, rank_col="position"))
    pool = candidates.withColumn("_rank", rank_of("confidence_label", CONFIDENCE_RANK, 2))
    by_rank = [F.asc("_rank"), F.asc("id")]
    listed = signed_rows(pool, [field_values(part) for part in by_dimension(LISTED)], spellings_of(plans, "raw"))
    leads = SpellingIndex(store(top_per_group(listed, ["_sig"], by_rank, limit).select("_sig", "found", "id", "_rank")))
    gaps = leads.rows_of(plans.select("design_id", "raw"), "design_id", "raw", ["id", "_rank"])
    opened = top_per_group(gaps, ["design_id"], by_rank, limit, rank_col="position")
    return release.select("design_id", F.lit("release").alias("kind"), F.col("evidence_id").alias("id"), "position").unionByName(
        opened.select("design_id", F.lit("candidate").alias("kind"), "id", "position")
    )


# --- graph ---------------------------------------------------------------------------------------------------


def evidence_graph(triage: dict[str, DataFrame], concerns: int = 8, records: int = 3, candidates: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) per design: the design, its concerns, their best records, sources and candidates."""
    matrix = triage["matrix"].filter(F.col("position") <= concerns)
    order = matrix.select("design_id", "concern_id", F.col("position").alias("_c"))
    concern_node = node_id("concern", "concern_id")
    design_node = F.lit("design:query")
    release = triage["release"].filter(F.col("rank") <= records).join(order, ["design_id", "concern_id"])
    gaps = triage["gaps"].filter(F.col("rank") <= candidates).join(order, ["design_id", "concern_id"])
    record_node = node_id("release", "record")
    source_node = node_id("source", first_text("pmid", "doi", "source_title"))
    gap_node = node_id("candidate", "id")

    def node(df: DataFrame, branch: int, ident: Column, label: Column, kind: str, detail: Column, at: Column) -> DataFrame:
        return df.select(
            "design_id", ident.alias("id"), label.alias("label"), F.lit(kind).alias("type"), detail.cast("string").alias("detail"),
            F.struct(F.lit(branch).alias("b"), at.cast("int").alias("at")).alias("_o"),
        )

    def edge(df: DataFrame, a: Column, b: Column, label: str, kind: str) -> DataFrame:
        return df.select("design_id", a.alias("source"), b.alias("target"), F.lit(label).alias("label"), F.lit(kind).alias("type"))

    report = triage["report"]
    design_label = F.concat_ws(
        " / ", first_text("target", default="any target"), first_text("modification", "delivery", default="any chemistry"), first_text("endpoint", default="safety endpoint")
    )
    at = F.col("_c") * 100 + F.col("rank")
    nodes = reduce(
        DataFrame.unionByName,
        [
            node(report, 0, design_node, design_label, "design_query", F.col("report_id"), F.lit(0)),
            node(matrix, 1, concern_node, F.col("concern"), "safety_concern", F.col("evidence_state"), F.col("position")),
            node(release, 2, record_node, first_text("canonical_name", "evidence_label", "record"), "verified_release_record", F.col("evidence_grade"), at),
            node(release, 3, source_node, first_text("pmid", "doi", default="source"), "source_document", F.col("source_title"), at),
            node(gaps, 4, gap_node, first_text("matched_terms", "source_location", default="candidate gap"), "candidate_gap", F.col("confidence_label"), at),
        ],
    )
    edges = reduce(
        DataFrame.unionByName,
        [
            edge(matrix, design_node, concern_node, "assessed for", "assesses"),
            edge(release, concern_node, record_node, "supported by", "supported_by"),
            edge(release, record_node, source_node, "has source", "has_source"),
            edge(gaps, concern_node, gap_node, "candidate gap", "candidate_gap"),
        ],
    )
    return first_occurrence(nodes, ["design_id", "id"], [F.asc("_o")]).drop("_o"), edges


def prov_edges(nodes: DataFrame, edges: DataFrame, report: DataFrame) -> DataFrame:
    """Derivations from the edges, and what the report generated, as (design_id, relation, subject, object, role)."""
    derived = edges.filter(F.col("type").isin("supported_by", "has_source", "candidate_gap")).select(
        "design_id", F.lit("wasDerivedFrom").alias("relation"), F.col("source").alias("subject"), F.col("target").alias("object"), F.col("type").alias("role")
    )
    activity = report.select("design_id", F.concat(F.lit("activity:"), F.col("report_id")).alias("object"))
    generated = nodes.filter(F.col("type").isin("design_query", "safety_concern")).join(activity, "design_id").select(
        "design_id", F.lit("wasGeneratedBy").alias("relation"), F.col("id").alias("subject"), "object", F.lit("").alias("role")
    )
    return derived.unionByName(generated)


def dossier(report: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per design: the triage summary with the size of its graph."""
    kinds = {"verified_release_nodes": "verified_release_record", "source_nodes": "source_document", "candidate_gap_nodes": "candidate_gap"}
    sized = nodes.groupBy("design_id").agg(
        F.count("*").alias("nodes"), *[F.count(F.when(F.col("type") == t, 1)).alias(n) for n, t in kinds.items()]
    )
    linked = edges.groupBy("design_id").agg(F.count("*").alias("edges"))
    return report.join(sized, "design_id", "left").join(linked, "design_id", "left").na.fill(0)
