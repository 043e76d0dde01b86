"""Evidence mining over texts: sentences, keyword hits, best places, candidates, passages, grounding."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions.text import (
    anchor_hash,
    compact_text,
    contains_any,
    has_text,
    let,
    null_if_blank,
    text_or_empty,
)
from attesta.lexicons import DOMAIN_KEYWORDS, QUEUE_EXCLUDED_TYPES, QUEUE_TASKS, QueueTask
from attesta.operators.rules import Score, found, match_terms, score, term_count
from attesta.operators.windows import first_occurrence, quota_select

SENTENCE_END = r"(?<=[.!?])\s+"
SENTENCE_END_CASED = r"(?<=[.!?])\s+(?=[A-Z0-9])"


def sentence_array(text: Column | str, cased: bool = False) -> Column:
    """Sentences of a text, whitespace collapsed. `cased` also needs a capital or digit next, and 20 characters."""
    parts = F.split(compact_text(text), SENTENCE_END_CASED if cased else SENTENCE_END)
    return F.filter(parts, (lambda s: F.length(F.trim(s)) >= 20) if cased else (lambda s: F.trim(s) != ""))


def sentences(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), cased: bool = False) -> DataFrame:
    """One row per sentence with its 1-based position."""
    rows = docs.select(*keep, F.posexplode(sentence_array(text, cased)).alias("_p", "sentence"))
    return rows.select(*keep, (F.col("_p") + 1).alias("position"), "sentence")


def hits_in(sentence: Column, terms: Sequence[str]) -> Column:
    """Distinct terms in a sentence; usable inside array functions."""

    def count(low: Column) -> Column:
        return reduce(lambda a, b: a + b, [F.contains(low, F.lit(t.lower())).cast("int") for t in terms], F.lit(0))

    return let(F.lower(sentence), count)


def sentence_hits(sentences_col: str, terms: Sequence[str]) -> Column:
    """Distinct terms per sentence of a sentence array."""
    return F.transform(sentences_col, lambda s: hits_in(s, terms))


def best_location(docs: DataFrame, lexicon: dict[str, list[str]], keep: Sequence[str] = ("source_document_id",), title: str = "title", text: str = "text") -> DataFrame:
    """Per document and domain the place with the most distinct terms: first best sentence, or the title if better.

    Each document is read once for all domains and nothing is shuffled: the best sentence is found inside
    the row, by position of the maximum.
    """
    prepared = docs.select(*keep, text_or_empty(title).alias("_title"), sentence_array(text).alias("_s"))
    counts = {f"_n_{d}": sentence_hits("_s", terms) for d, terms in lexicon.items()}
    counted = prepared.withColumns(counts)

    def place(domain: str, terms: list[str]) -> Column:
        n = F.col(f"_n_{domain}")
        best = F.coalesce(F.array_max(n), F.lit(0))
        at = F.when(best > 0, F.array_position(n, best).cast("int")).otherwise(F.lit(0))
        in_title = term_count("_title", terms)
        title_wins = in_title > best
        sentence = F.get(F.col("_s"), at - 1)
        label = (
            F.when(title_wins, "PubMed title")
            .when(at > 0, F.concat(F.lit("PubMed abstract sentence "), at.cast("string")))
            .otherwise("source title")
        )
        chosen = F.when(title_wins | (at == 0), F.col("_title")).otherwise(sentence)
        return F.struct(
            F.lit(domain).alias("evidence_domain"),
            label.alias("source_location"),
            match_terms(chosen, terms).alias("terms"),
            F.when(title_wins, F.lit(0)).otherwise(at).alias("position"),
            F.greatest(best, in_title).alias("n_terms"),
            chosen.alias("best_text"),
        )

    return counted.select(*keep, F.inline(F.array(*[place(d, t) for d, t in lexicon.items()])))


def confidence_label(location: Column | str, terms: Column | str) -> Column:
    loc = F.col(location) if isinstance(location, str) else location
    n = F.size(terms)
    return (
        F.when(loc.startswith("PubMed abstract") & (n >= 2), "high_candidate")
        .when(n > 0, "medium_candidate")
        .otherwise("low_candidate")
    )


def candidate_signal(domain: str, terms: Column, title: str) -> Column:
    with_terms = F.format_string("%s candidate; matched derived terms: %s; source title: %s", F.col(domain), F.array_join(terms, ", "), text_or_empty(title))
    bare = F.format_string("%s candidate from queue only; source title: %s", F.col(domain), text_or_empty(title))
    return F.when(F.size(terms) > 0, with_terms).otherwise(bare)


def infer_modality(c: Column | str) -> Column:
    return (
        F.when(contains_any(c, ["sirna", "rnai"]), "siRNA")
        .when(contains_any(c, ["antisense", "aso", "oligonucleotide"]), "ASO")
        .otherwise("ASO/siRNA")
    )


def queue_tasks(sources: DataFrame, tasks: Sequence[QueueTask] = QUEUE_TASKS, excluded: Sequence[str] = QUEUE_EXCLUDED_TYPES) -> DataFrame:
    """One row per source and curation task that its title or type opens."""
    kind = text_or_empty("source_type")

    def opened(t: QueueTask) -> Column:
        if t.always:
            return F.lit(True)
        by_title = contains_any("title", list(t.title_words))
        return by_title | kind.isin(list(t.source_types)) if t.source_types else by_title

    rows = F.array_compact(
        F.array(*[
            F.when(
                opened(t),
                F.struct(
                    F.lit(t.domain).alias("evidence_domain"), F.lit(t.target).alias("extraction_target"),
                    F.lit(t.grade).alias("suggested_evidence_grade"), F.lit(t.priority).alias("priority"),
                ),
            )
            for t in tasks
        ])
    )
    return sources.filter(~kind.isin(list(excluded))).select(
        F.col("id").alias("source_document_id"), "pmid", "doi", text_or_empty("title").alias("source_title"), "source_type",
        infer_modality("title").alias("candidate_modality"), F.inline(rows),
    )


def build_candidates(queue: DataFrame, docs: DataFrame, lexicon: dict[str, list[str]] = DOMAIN_KEYWORDS) -> DataFrame:
    """Candidates for the queued (source, domain) tasks.

    `docs` has source_document_id, title and text. Texts are reduced to their best places before the
    join, so no text travels with the queue rows.
    """
    places = best_location(docs, lexicon).select("source_document_id", "evidence_domain", "source_location", "terms")
    tasks = queue.filter(F.col("evidence_domain").isin(list(lexicon)))
    joined = tasks.join(places, ["source_document_id", "evidence_domain"], "left")
    has_pmid = has_text("pmid")
    fallback = reduce(
        lambda out, item: F.when(F.col("evidence_domain") == item[0], match_terms("source_title", item[1])).otherwise(out),
        lexicon.items(),
        F.array().cast("array<string>"),
    )
    terms = F.when(has_pmid & (F.size(F.coalesce("terms", F.array().cast("array<string>"))) > 0), F.col("terms")).otherwise(fallback)
    resolved = joined.withColumn("_terms", terms).withColumn(
        "source_location",
        F.when(~has_pmid, "external source title").otherwise(F.coalesce("source_location", F.lit("source title"))),
    )
    return resolved.select(
        F.col("id").alias("queue_id"), "source_document_id", text_or_empty("pmid").alias("pmid"), text_or_empty("doi").alias("doi"),
        "evidence_domain", "candidate_modality", "source_location", F.array_join("_terms", ";").alias("matched_terms"),
        candidate_signal("evidence_domain", F.col("_terms"), "source_title").alias("candidate_signal"),
        "suggested_evidence_grade", confidence_label("source_location", "_terms").alias("confidence_label"),
    )


def append_candidates(
    sources: DataFrame, docs: DataFrame, existing: DataFrame, lexicon: dict[str, list[str]], required: list[str], excluded: Sequence[str] = QUEUE_EXCLUDED_TYPES
) -> DataFrame:
    """New (source, domain) candidates only: the source is in context, the pair is new, and terms were found."""
    usable = sources.filter(has_text("pmid") & ~text_or_empty("source_type").isin(list(excluded))).select(
        F.col("id").alias("source_document_id"), "pmid", "doi", "source_type"
    )
    context = F.concat_ws(" ", text_or_empty("title"), compact_text("text"))
    inside = docs.filter(contains_any(context, required)).withColumn("candidate_modality", infer_modality(context))
    places = best_location(inside, lexicon, keep=("source_document_id", "candidate_modality")).filter(F.size("terms") > 0)
    titles = docs.select("source_document_id", text_or_empty("title").alias("source_title"))
    new = places.join(existing.select("source_document_id", "evidence_domain"), ["source_document_id", "evidence_domain"], "left_anti")
    label = confidence_label("source_location", "terms")
    rows = new.join(usable, "source_document_id").join(titles, "source_document_id").withColumn("confidence_label", label)
    return rows.select(
        F.xxhash64("source_document_id", "evidence_domain").alias("id"), "source_document_id", "pmid", text_or_empty("doi").alias("doi"),
        "evidence_domain", "candidate_modality", "source_location", F.array_join("terms", ";").alias("matched_terms"),
        candidate_signal("evidence_domain", F.col("terms"), "source_title").alias("candidate_signal"),
        F.when((F.col("evidence_domain") == "offtarget") | (F.col("confidence_label") != "low_candidate"), "B").otherwise("C").alias("suggested_evidence_grade"),
        "confidence_label",
        F.when(F.col("confidence_label") == "high_candidate", "high").otherwise("medium").alias("priority"),
    )


# --- passages --------------------------------------------------------------------------------------------

BLOCK = r"<(p|caption|figcaption)(?:\s[^>]*)?>"
BLOCK_END = r"(?is)</(?:p|caption|figcaption|article|body|html)>.*$"


def strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))


def text_anchors(pages: DataFrame, key: str = "page_id", html: str = "html", min_len: int = 50, min_caption: int = 30) -> DataFrame:
    """Passages of HTML pages: paragraphs and captions that are long enough, with a running number and hash.

    The location is `section; paragraph n` with the page's first heading as section. Unclosed blocks end at
    the next block.
    """
    tags = F.regexp_extract_all(F.col(html), F.lit("(?i)" + BLOCK), F.lit(1))
    bodies = F.slice(F.split(F.col(html), "(?i)" + BLOCK), 2, F.greatest(F.size(tags), F.lit(1)))
    texts = F.transform(bodies, lambda b: strip_tags(F.regexp_replace(b, BLOCK_END, "")))
    section = strip_tags(F.regexp_extract(F.col(html), r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    kinds = F.transform(tags, lambda t: F.when(F.lower(t) == "p", "paragraph").otherwise("caption"))
    blocks = F.filter(
        F.arrays_zip(kinds.alias("kind"), texts.alias("text")),
        lambda b: F.length(b["text"]) >= F.when(b["kind"] == "paragraph", min_len).otherwise(min_caption),
    )
    rows = pages.select(key, null_if_blank(section).alias("_section"), F.posexplode(blocks).alias("_p", "_b"))
    position = F.col("_p") + 1
    return rows.select(
        key,
        position.alias("position"),
        F.concat(F.coalesce("_section", F.lit("article body")), F.lit("; "), F.col("_b.kind"), F.lit(" "), position.cast("string")).alias("location"),
        F.col("_b.text").alias("text"),
        anchor_hash(F.col("_b.text")).alias("anchor_hash"),
    )



def score_anchor(anchors: DataFrame, rules: Sequence[Score]) -> DataFrame:
    return anchors.withColumn("score", score(rules))


def best_anchor(anchors: DataFrame, rules: Sequence[Score], domain_terms: list[str], required: list[str], key: str = "page_id", title: str = "title") -> DataFrame:
    """Best passage per document among those with a domain term and a required term in text or title."""
    usable = anchors.filter((term_count("text", domain_terms) > 0) & (contains_any("text", required) | contains_any(title, required)))
    return first_occurrence(score_anchor(usable, rules), key, [F.desc("score"), F.asc("position")])


def anchor_join(rows: DataFrame, anchors: DataFrame, key: str = "page_id") -> DataFrame:
    """Find each row's passage by anchor hash, else by its location text, with the window text around it.

    `rows` has row_id, the document key, source_anchor_hash and wanted_location. Both lookups are equi
    joins; the hash match wins, and the first passage in the document wins among equals.
    """
    from attesta.operators.windows import passage_window

    passages = passage_window(anchors, key, "position", "text")
    by_hash = first_occurrence(passages, [key, "anchor_hash"], [F.asc("position")])
    by_place = first_occurrence(passages.withColumn("_place", compact_text("location")), [key, "_place"], [F.asc("position")])

    def renamed(df: DataFrame, prefix: str, on: str, target: str) -> DataFrame:
        return df.select(key, F.col(on).alias(target), *[F.col(c).alias(f"{prefix}{c}") for c in ("position", "location", "anchor_hash", "window_text")])

    joined = (
        rows.withColumn("_h", null_if_blank("source_anchor_hash"))
        .withColumn("_place", compact_text("wanted_location"))
        .join(renamed(by_hash, "h_", "anchor_hash", "_h"), [key, "_h"], "left")
        .join(renamed(by_place, "p_", "_place", "_place"), [key, "_place"], "left")
    )
    hit = F.col("h_position").isNotNull()

    def pick(c: str) -> Column:
        return F.when(hit, F.col(f"h_{c}")).otherwise(F.col(f"p_{c}")).alias(c)

    return joined.select("row_id", key, pick("position"), pick("location"), pick("anchor_hash"), pick("window_text"), hit.alias("hash_exact")).filter("position IS NOT NULL")


def mark_exact(passages: DataFrame, wanted: DataFrame, key: str = "page_id") -> DataFrame:
    """Add hash_exact: whether a row of `wanted` names the passage by its hash (an equi join on document and hash)."""
    named = wanted.select(key, null_if_blank("source_anchor_hash").alias("anchor_hash")).where("anchor_hash IS NOT NULL").distinct()
    joined = passages.join(named.withColumn("_named", F.lit(True)), [key, "anchor_hash"], "left")
    return joined.withColumn("hash_exact", F.coalesce("_named", F.lit(False))).drop("_named")


def context_score(ctx: DataFrame, rules: Sequence[Score]) -> DataFrame:
    """Add the score of each context; an exact hash match counts by its own rule in the table."""
    return ctx.withColumn("score", score(rules))


def best_context(scored: DataFrame, mode: str, key: str = "row_id", relevant: Column | None = None) -> DataFrame:
    """One context per row.

    'exact': the hash-exact passage, unless the best passage beats it by 12, or it is introduction and the
    best is not (and scores above 0). 'prefer': the best relevant one, else the best. 'only': the best
    relevant one, else none.
    """
    order = [F.desc("score"), F.asc("position")]
    if mode == "only":
        return first_occurrence(scored.filter(relevant), key, order)
    if mode == "prefer":
        return first_occurrence(scored.withColumn("_r", F.coalesce(relevant, F.lit(False))), key, [F.desc("_r"), *order]).drop("_r")
    best = first_occurrence(scored, key, order)
    exact = first_occurrence(scored.filter("hash_exact"), key, [F.asc("position")])
    intro = r"\bIntroduction\b"
    e = exact.select(key, F.struct(*[c for c in exact.columns if c != key]).alias("_e"))
    b = best.select(key, F.struct(*[c for c in best.columns if c != key]).alias("_b"))
    both = b.join(e, key, "left")
    leaves_intro = found(F.col("_e.location"), intro) & ~found(F.col("_b.location"), intro) & (F.col("_b.score") > 0)
    take_best = F.col("_e").isNull() | leaves_intro | (F.col("_b.score") >= F.col("_e.score") + 12)
    return both.select(key, F.when(take_best, F.col("_b")).otherwise(F.col("_e")).alias("_w")).select(key, "_w.*")


def benchmark_eligible(grade: Column | str = "grade") -> Column:
    """A/B full-text rows outside introduction, discussion and conclusion."""
    g = F.col(grade) if isinstance(grade, str) else grade
    return g.isin("A", "B") & (F.col("source_kind") == "full_text") & ~found("location", r"\bIntroduction\b|\bDiscussion\b|\bConclusion")


def risk_flags(domain_matches: Column | str, review_words: str = "review|guidance|perspective|meta-analysis") -> Column:
    """What a reviewer must watch for, as an array of flags."""
    matches = F.col(domain_matches) if isinstance(domain_matches, str) else domain_matches
    rules = [
        (F.contains(text_or_empty("location"), F.lit("Abstract")), "abstract_anchor_only"),
        (found("location", r"\bIntroduction\b"), "intro_anchor_needs_primary_result"),
        (found("location", r"\bDiscussion\b|\bConclusion"), "discussion_or_conclusion_anchor"),
        ((text_or_empty("article_type") == "review-article") | found("title", review_words), "review_or_meta_analysis"),
        (F.size(matches) == 0, "domain_term_weak"),
        ((F.col("evidence_domain") == "toxicity") & (F.size(matches) == 1) & F.array_contains(matches, "safety"), "broad_safety_only"),
        (F.col("candidate_modality") == "ASO/siRNA", "mixed_modality_needs_resolution"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(f)) for c, f in rules]))


def review_priority(flags: Column | str = "risk_flags", location: str = "proposed_source_location") -> Column:
    """P0 to P3 by flags, full-text place and confidence."""
    high = F.col("confidence_label") == "high_candidate"
    likely = F.col("confidence_label").isin("high_candidate", "medium_candidate")
    return (
        F.when((text_or_empty(flags) == "none") & high, "P0_full_text_high_confidence")
        .when(has_text(location) & likely, "P1_full_text_review")
        .when(likely, "P2_source_location_review")
        .otherwise("P3_low_confidence_backfill")
    )


def release_packet(tables, anchors: DataFrame, target: int = 3000, max_offtarget: int = 1000) -> DataFrame:
    """Pending candidates with a location and an identifier, quota-selected, with their passage and priority.

    `anchors` has candidate_id, proposed_source_location, source_anchor_hash and risk_flags.
    """
    source = tables["source_document"].select(
        F.col("id").alias("source_document_id"), "pmcid", "title", "publication_year", "source_url"
    )
    pending = tables["curation_candidate"].filter(
        "validation_status = 'candidate_needs_curator_review' AND curator_decision = 'pending'"
    )
    pool = pending.filter(has_text("source_location") & (has_text("pmid") | has_text("doi"))).join(source, "source_document_id")
    chosen = quota_select(pool, target, max_offtarget).withColumnRenamed("id", "candidate_id")
    enriched = chosen.join(anchors, "candidate_id", "left").withColumn(
        "risk_flags", F.coalesce("risk_flags", F.lit("no_machine_full_text_anchor"))
    )
    return enriched.withColumn("review_priority", review_priority())


# --- grounding -------------------------------------------------------------------------------------------


def passage_precedence(rows: DataFrame, fulltext: DataFrame, abstracts: DataFrame, key: str = "row_id") -> DataFrame:
    """The passage a decision is checked against: full text, else abstract, else snippet; with its kind."""
    full = fulltext.select(key, F.col("text").alias("_full"))
    short = abstracts.select(key, F.col("text").alias("_abstract"))
    joined = rows.join(full, key, "left").join(short, key, "left")
    kind = F.when(has_text("_full"), "full_text").when(has_text("_abstract"), "abstract").when(has_text("snippet"), "snippet").otherwise("none")
    passage = F.coalesce(null_if_blank("_full"), null_if_blank("_abstract"), null_if_blank("snippet"), F.lit(""))
    return joined.withColumns({"passage": passage, "passage_kind": kind}).drop("_full", "_abstract")


def grounded(quote: Column | str, passage: Column | str, min_len: int = 12) -> Column:
    """The quote is long enough, is not 'none', and occurs in the passage; case and whitespace do not matter."""
    q, p = F.lower(compact_text(quote)), F.lower(compact_text(passage))
    return (F.length(q) >= min_len) & (q != "none") & F.contains(p, q)


def verify_grounding(decisions: DataFrame, passages: DataFrame, min_len: int = 12, key: str = "row_id") -> DataFrame:
    """Accepts whose quote is not in the passage become rejects with grade NA and a marked reason."""
    joined = decisions.join(passages.select(key, "passage"), key, "left")
    failed = (F.lower(text_or_empty("decision")) == "accept") & ~grounded("quote", "passage", min_len)
    return joined.withColumns(
        {
            "decision": F.when(failed, "reject").otherwise(F.col("decision")),
            "grade": F.when(failed, "NA").otherwise(F.col("grade")),
            "reason": F.when(failed, F.concat(F.lit("ungrounded quote: "), text_or_empty("reason"))).otherwise(F.col("reason")),
            "grounding_failed": failed,
        }
    ).drop("passage")


def _fingerprints(text: str | None, width: int, run: int) -> np.ndarray:
    """Smallest hash of every `run` consecutive pieces of `width` characters, distinct."""
    codes = np.frombuffer((text or "").encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    pieces = len(codes) - width + 1
    if pieces < run:
        return np.empty(0, dtype=np.int64)
    h = np.zeros(pieces, dtype=np.uint64)
    for j in range(width):
        h = h * np.uint64(1099511628211) + codes[j : j + pieces]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    if run > 1:
        h = np.lib.stride_tricks.sliding_window_view(h, run).min(axis=1)
    return np.unique(h.view(np.int64))


def fingerprints(width: int, run: int):
    """Arrow function: text -> array of piece fingerprints; linear in the length of the text."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def compute(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _fingerprints(t, width, run))

    return compute


def grounding_join(
    quotes: DataFrame, docs: DataFrame, quote_key: str, doc_key: str, quote: str = "text", passage: str = "text", min_len: int = 12, width: int = 16, run: int = 17
) -> DataFrame:
    """All (quote, document) pairs where the document contains the quote, case and whitespace aside.

    A document that contains a quote has, for each run of pieces inside the quote, the same smallest piece
    hash. So one hash of a quote is enough to find every document that can hold it: an equi join on hashes,
    then a check of the texts of the pairs found. Quotes too short for a full run use all their pieces of
    `min_len` characters. Nothing is capped: every quote of at least `min_len` characters is looked up.
    """
    q = quotes.select(F.col(quote_key).alias("_q"), F.lower(compact_text(quote)).alias("_t")).filter(F.length("_t") >= min_len)
    texts = docs.select(F.col(doc_key).alias("_d"), F.lower(compact_text(passage)).alias("_p"))

    def candidates(some: DataFrame, size: int, length: int) -> DataFrame:
        prints = fingerprints(size, length)
        keys = some.select("_q", F.array_min(prints("_t")).alias("_g"))
        pieces = texts.select("_d", F.explode(prints("_p")).alias("_g"))
        return pieces.join(keys, "_g").select("_q", "_d")

    full = width + run - 1
    pairs = candidates(q.filter(F.length("_t") >= full), width, run)
    pairs = pairs.unionByName(candidates(q.filter(F.length("_t") < full), min_len, 1))
    verified = pairs.distinct().join(q, "_q").join(texts, "_d").filter(F.contains("_p", F.col("_t")))
    return verified.select(F.col("_q").alias(quote_key), F.col("_d").alias(doc_key))
