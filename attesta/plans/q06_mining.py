"""Queries: sentences, keyword scans, candidates, passages, rule tables, grounding."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.lexicons import QueueTask
from attesta.operators import mining, rules
from attesta.operators.rules import Label, Reject, Score, any_word, has, lacks
from attesta.plans.registry import query
from attesta.rulesets import ATTRIBUTES, ATTRIBUTES_OFFTARGET, GRADES_COMPUTATIONAL, anchor_scores
from attesta.sources.adapters import evidence_tables, raw_table, text_table

# Test vocabulary: words of the test prose.
LEXICON = {
    "toxicity": ["thtion", "attion", "ertion", "hehely", "oument"],
    "offtarget": ["antion", "retion", "ontion", "ononst", "enkeit"],
    "chemistry": ["thanea", "eriner", "queque", "enlich"],
}
REQUIRED = ["the", "les", "der"]
EXPERIMENTAL = ["inging", "stanin", "thedre", "ouelle"]


def n_sql(text: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"contains(lower({text}), '{t}')::INT" for t in terms) + ")"


def list_sql(text: str, terms: list[str], sep: str = ";") -> str:
    return f"concat_ws('{sep}', " + ", ".join(f"CASE WHEN contains(lower({text}), '{t}') THEN '{t}' END" for t in terms) + ")"


def any_sql(text: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{t}')" for t in terms) + ")"


def bounds_sql(pattern: str) -> str:
    r"""A pattern with Unicode word boundaries spelled out: \b is ASCII-only in the check engine."""
    out = ""
    for i, part in enumerate(pattern.split(r"\b")):
        if i:
            opens = out == "" or out.endswith(("|", "(", "(?:"))
            out += r"(?:^|[^\p{L}\p{N}_])" if opens else r"(?:[^\p{L}\p{N}_]|$)"
        out += part
    return out


def re_sql(field: str, pattern: str, present: bool = True) -> str:
    return f"{'' if present else 'NOT '}regexp_matches(coalesce({field}, ''), '(?i){bounds_sql(pattern)}')"


SENT = r"""snt AS (SELECT doc_id, trim(unnest(a)) AS sentence, generate_subscripts(a, 1) AS position FROM (
    SELECT doc_id, string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS a FROM documents))"""


def _docs(spark, sf_dir):
    docs = text_table(spark, sf_dir, "documents", "doc_id").select(F.col("doc_id").alias("source_document_id"), "text")
    titles = evidence_tables(spark, sf_dir)["source_document"].select(F.col("id").alias("source_document_id"), "title")
    return docs.join(titles, "source_document_id")


@query("sentences", f"WITH {SENT} SELECT doc_id, position, sentence FROM snt WHERE sentence <> ''")
def _(spark, sf_dir):
    return mining.sentences(text_table(spark, sf_dir, "documents", "doc_id"))


@query(
    "sentences_cased",
    r"""WITH c AS (SELECT doc_id, string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS a FROM documents),
      s AS (SELECT doc_id, unnest(list_filter(a, lambda x: length(trim(x)) >= 20)) AS sentence FROM c)
      SELECT doc_id, count(*) AS n, sum(length(sentence)) AS chars FROM s GROUP BY doc_id""",
)
def _(spark, sf_dir):
    rows = mining.sentences(text_table(spark, sf_dir, "documents", "doc_id"), cased=True)
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("sentence")).alias("chars"))


@query(
    "match_terms",
    "SELECT doc_id, "
    + list_sql("text", LEXICON["toxicity"])
    + " AS substring_terms, concat_ws(';', "
    + ", ".join(f"CASE WHEN regexp_matches(lower(text), '(^|[^A-Za-z0-9]){t}([^A-Za-z0-9]|$)') THEN '{t}' END" for t in LEXICON["toxicity"])
    + ") AS word_terms FROM documents",
)
def _(spark, sf_dir):
    terms = LEXICON["toxicity"]
    return text_table(spark, sf_dir, "documents", "doc_id").select(
        "doc_id",
        F.array_join(rules.match_terms("text", terms), ";").alias("substring_terms"),
        F.array_join(rules.match_terms("text", terms, "word"), ";").alias("word_terms"),
    )


def _best_sql() -> str:
    """Best place per (document, domain) in SQL."""
    parts = [
        f"""SELECT '{d}' AS dom, s.id AS doc, s.title, b.position, coalesce(b.n, 0) AS n, {n_sql("s.title", t)} AS tn, b.sentence,
        {list_sql("coalesce(b.sentence, '')", t)} AS sterms, {list_sql("s.title", t)} AS tterms
        FROM source_document s LEFT JOIN (SELECT * FROM (SELECT doc_id, position, sentence, {n_sql("sentence", t)} AS n,
          row_number() OVER (PARTITION BY doc_id ORDER BY {n_sql("sentence", t)} DESC, position) AS rn FROM snt WHERE sentence <> '')
          WHERE rn = 1 AND n > 0) b ON b.doc_id = s.id"""
        for d, t in LEXICON.items()
    ]
    return f"""{SENT}, bst AS ({" UNION ALL ".join(parts)}),
      plc AS (SELECT dom AS evidence_domain, doc AS source_document_id,
        CASE WHEN tn > n THEN 'PubMed title' WHEN n > 0 THEN 'PubMed abstract sentence ' || position ELSE 'source title' END AS source_location,
        CASE WHEN tn > n THEN tterms WHEN n > 0 THEN sterms ELSE tterms END AS terms, greatest(n, tn) AS n_terms,
        CASE WHEN tn > n OR n = 0 THEN 0 ELSE position END AS position FROM bst)"""


@query("best_location", f"WITH {_best_sql()} SELECT * FROM plc")
def _(spark, sf_dir):
    places = mining.best_location(_docs(spark, sf_dir), LEXICON)
    return places.select(
        "evidence_domain", "source_document_id", "source_location", F.array_join("terms", ";").alias("terms"), "n_terms", "position"
    )


_CONF = "CASE WHEN source_location LIKE 'PubMed abstract%' AND {n} >= 2 THEN 'high_candidate' WHEN {n} >= 1 THEN 'medium_candidate' ELSE 'low_candidate' END"


@query(
    "confidence_label",
    f"WITH {_best_sql()} SELECT evidence_domain, {_CONF.format(n='n_terms')} AS confidence, count(*) AS n FROM plc GROUP BY ALL",
)
def _(spark, sf_dir):
    places = mining.best_location(_docs(spark, sf_dir), LEXICON)
    labelled = places.withColumn("confidence", mining.confidence_label("source_location", "terms"))
    return labelled.groupBy("evidence_domain", "confidence").agg(F.count("*").alias("n"))


def _fallback(title: str) -> str:
    return "CASE q.evidence_domain " + " ".join(f"WHEN '{d}' THEN {list_sql(title, t)}" for d, t in LEXICON.items()) + " END"


@query(
    "build_candidates",
    f"""WITH {_best_sql()}, j AS (SELECT q.*, CASE WHEN coalesce(q.pmid, '') = '' THEN 'external source title' ELSE p.source_location END AS source_location,
        CASE WHEN coalesce(q.pmid, '') <> '' AND p.terms <> '' THEN p.terms ELSE {_fallback("q.source_title")} END AS t
        FROM curation_queue q LEFT JOIN plc p ON p.source_document_id = q.source_document_id AND p.evidence_domain = q.evidence_domain)
      SELECT id AS queue_id, source_document_id, coalesce(pmid, '') AS pmid, doi, evidence_domain, candidate_modality, source_location, t AS matched_terms,
        CASE WHEN t <> '' THEN evidence_domain || ' candidate; matched derived terms: ' || replace(t, ';', ', ') || '; source title: ' || source_title
             ELSE evidence_domain || ' candidate from queue only; source title: ' || source_title END AS candidate_signal,
        suggested_evidence_grade, {_CONF.format(n="(CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ';')) END)")} AS confidence_label FROM j""",
)
def _(spark, sf_dir):
    return mining.build_candidates(evidence_tables(spark, sf_dir)["curation_queue"], _docs(spark, sf_dir), LEXICON)


@query(
    "append_candidates",
    f"""WITH {_best_sql()}, d AS (SELECT doc_id, {any_sql("text", REQUIRED)} OR {any_sql("s.title", REQUIRED)} AS core FROM documents JOIN source_document s ON s.id = doc_id),
      n AS (SELECT p.*, s.pmid, s.doi, s.title FROM plc p JOIN source_document s ON s.id = p.source_document_id JOIN d ON d.doc_id = p.source_document_id AND core
        WHERE p.evidence_domain IN ('toxicity', 'offtarget') AND coalesce(s.pmid, '') <> '' AND p.terms <> '' AND NOT EXISTS (SELECT 1 FROM curation_candidate c
          WHERE c.source_document_id = p.source_document_id AND c.evidence_domain = p.evidence_domain AND c.confidence_label = 'high_candidate')),
      l AS (SELECT *, {_CONF.format(n="n_terms")} AS confidence_label FROM n)
      SELECT source_document_id, pmid, evidence_domain, source_location, terms AS matched_terms, confidence_label, 'B' AS suggested_evidence_grade,
        CASE confidence_label WHEN 'high_candidate' THEN 'high' ELSE 'medium' END AS priority FROM l""",
)
def _(spark, sf_dir):
    tables = evidence_tables(spark, sf_dir)
    existing = tables["curation_candidate"].filter("confidence_label = 'high_candidate'")
    two = {d: LEXICON[d] for d in ("toxicity", "offtarget")}
    rows = mining.append_candidates(tables["source_document"], _docs(spark, sf_dir), existing, two, REQUIRED)
    return rows.select(
        "source_document_id", "pmid", "evidence_domain", "source_location", "matched_terms", "confidence_label", "suggested_evidence_grade", "priority"
    )


TASKS = [
    QueueTask("source_provenance", "source_location", "C", "high", always=True),
    QueueTask("toxicity", "toxicity_target", "B", "high", tuple(LEXICON["toxicity"])),
    QueueTask("benchmark", "benchmark_target", "C", "medium", tuple(LEXICON["chemistry"]), ("de",)),
]


@query(
    "queue_tasks",
    f"""WITH s AS (SELECT *, CASE WHEN contains(lower(title), 'sirna') OR contains(lower(title), 'rnai') THEN 'siRNA'
        WHEN contains(lower(title), 'antisense') OR contains(lower(title), 'aso') OR contains(lower(title), 'oligonucleotide') THEN 'ASO' ELSE 'ASO/siRNA' END AS m
        FROM source_document WHERE source_type <> 'es')
      SELECT id AS source_document_id, 'source_provenance' AS evidence_domain, 'source_location' AS extraction_target, 'C' AS suggested_evidence_grade, 'high' AS priority, m AS candidate_modality FROM s
      UNION ALL SELECT id, 'toxicity', 'toxicity_target', 'B', 'high', m FROM s WHERE {any_sql("title", LEXICON["toxicity"])}
      UNION ALL SELECT id, 'benchmark', 'benchmark_target', 'C', 'medium', m FROM s WHERE {any_sql("title", LEXICON["chemistry"])} OR source_type = 'de'""",
)
def _(spark, sf_dir):
    rows = mining.queue_tasks(evidence_tables(spark, sf_dir)["source_document"], TASKS, ["es"])
    return rows.select("source_document_id", "evidence_domain", "extraction_target", "suggested_evidence_grade", "priority", "candidate_modality")


# --- passages ----------------------------------------------------------------------------------------

ANCHORS = r"""blk AS (SELECT page_id, html, regexp_extract_all(html, '(?i)<(p|caption|figcaption)(\s[^>]*)?>', 1) AS tags,
    string_split_regex(html, '(?i)<(p|caption|figcaption)(\s[^>]*)?>')[2:] AS bodies FROM pages),
  prt AS (SELECT page_id, html, lower(unnest(tags)) AS tag, unnest(bodies) AS body, generate_subscripts(tags, 1) AS i FROM blk),
  cln AS (SELECT page_id, i, CASE WHEN tag = 'p' THEN 'paragraph' ELSE 'caption' END AS kind,
    coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), ''), 'article body') AS section,
    trim(regexp_replace(regexp_replace(regexp_replace(body, '(?is)</(p|caption|figcaption|article|body|html)>.*$', ''), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM prt),
  anc AS (SELECT page_id, position, section || '; ' || kind || ' ' || position AS location, text, substr(sha256(text), 1, 16) AS anchor_hash FROM (
    SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS position FROM cln WHERE length(text) >= CASE kind WHEN 'paragraph' THEN 50 ELSE 30 END))"""


def _anchors(spark, sf_dir):
    return mining.text_anchors(text_table(spark, sf_dir, "pages", "page_id"))


@query("text_anchors", f"WITH {ANCHORS} SELECT page_id, position, location, text, anchor_hash FROM anc")
def _(spark, sf_dir):
    return _anchors(spark, sf_dir)


_DOM = LEXICON["toxicity"]
_SCORE = f"""(6 * {n_sql("text", _DOM)} + 3 * {n_sql("text", REQUIRED)} + 2 * {n_sql("text", EXPERIMENTAL)}
  + CASE WHEN contains(location, 'Abstract') THEN -8 ELSE 3 END + CASE WHEN regexp_matches(location, '(?i)\\bIntroduction\\b') THEN -5 ELSE 0 END
  + CASE WHEN regexp_matches(location, '(?i)\\bDiscussion\\b|\\bConclusion') THEN -2 ELSE 0 END + CASE WHEN regexp_matches(location, '(?i)\\bResults\\b') THEN 7 ELSE 0 END
  + CASE WHEN regexp_matches(location, '(?i)\\b(Fig|Figure|Table|Supplement)') THEN 8 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)hation|thedre') THEN 2 ELSE 0 END)"""
_RULES = anchor_scores(_DOM, REQUIRED, EXPERIMENTAL, "hation|thedre")


@query("score_anchor", f"WITH {ANCHORS} SELECT page_id, position, {_SCORE} AS score FROM anc")
def _(spark, sf_dir):
    return mining.score_anchor(_anchors(spark, sf_dir), _RULES).select("page_id", "position", "score")


@query(
    "best_anchor",
    f"""WITH {ANCHORS}, u AS (SELECT page_id, position, {_SCORE} AS score FROM anc WHERE {n_sql("text", _DOM)} > 0 AND {any_sql("text", REQUIRED)})
      SELECT page_id, position, score FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, position) AS rn FROM u) WHERE rn = 1""",
)
def _(spark, sf_dir):
    anchors = _anchors(spark, sf_dir).withColumn("title", F.lit(""))
    return mining.best_anchor(anchors, _RULES, _DOM, REQUIRED).select("page_id", "position", "score")


# Rows that look for a passage: by the hash of the page's first long passage on even pages, else by location.
_WANTED = """wnt AS (SELECT p.page_id AS row_id, p.page_id, CASE WHEN p.page_id % 2 = 0 THEN coalesce(a.anchor_hash, '') ELSE 'missing' END AS h,
    coalesce(b.location, '') AS place FROM pages p LEFT JOIN anc a ON a.page_id = p.page_id AND a.position = 2 LEFT JOIN anc b ON b.page_id = p.page_id AND b.position = 1)"""


@query(
    "anchor_join",
    f"""WITH {ANCHORS}, {_WANTED}, win AS (SELECT *, concat_ws(' ', lag(text) OVER w, text, lead(text) OVER w) AS window_text FROM anc WINDOW w AS (PARTITION BY page_id ORDER BY position)),
      byh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, anchor_hash ORDER BY position) AS rn FROM win) WHERE rn = 1)
      SELECT row_id, wnt.page_id, coalesce(x.position, y.position) AS position, coalesce(x.location, y.location) AS location, coalesce(x.anchor_hash, y.anchor_hash) AS anchor_hash,
        coalesce(x.window_text, y.window_text) AS window_text, x.position IS NOT NULL AS hash_exact
      FROM wnt LEFT JOIN byh x ON x.page_id = wnt.page_id AND x.anchor_hash = wnt.h AND wnt.h <> ''
      LEFT JOIN win y ON y.page_id = wnt.page_id AND y.location = wnt.place WHERE coalesce(x.position, y.position) IS NOT NULL""",
)
def _(spark, sf_dir):
    anchors = _anchors(spark, sf_dir)
    return mining.anchor_join(_wanted(spark, sf_dir, anchors), anchors)


@query(
    "context_score_exact",
    f"""WITH {ANCHORS}, {_WANTED}, u AS (SELECT anc.page_id, position, {_SCORE} AS plain, anchor_hash = h AND h <> '' AS hash_exact FROM anc JOIN wnt ON wnt.page_id = anc.page_id),
      r AS (SELECT *, plain + CASE WHEN hash_exact THEN 10 ELSE 0 END AS score, row_number() OVER (PARTITION BY page_id ORDER BY plain DESC, position) AS before FROM u)
      SELECT page_id, position, score, hash_exact, before = 1 AS wins_without FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, position) AS rn FROM r) WHERE rn = 1""",
)
def _(spark, sf_dir):
    """The best passage of every page when a hash match counts, and whether it would win without."""
    anchors = _anchors(spark, sf_dir)
    marked = mining.mark_exact(anchors, _wanted(spark, sf_dir, anchors))
    plain = mining.first_occurrence(mining.context_score(anchors, _RULES), "page_id", [F.desc("score"), F.asc("position")])
    scored = mining.context_score(marked, [*_RULES, Score(10, "hash_exact", "^true$")])
    best = mining.first_occurrence(scored, "page_id", [F.desc("score"), F.asc("position")])
    winners = plain.select("page_id", F.col("position").alias("_plain"))
    return best.join(winners, "page_id").select("page_id", "position", "score", "hash_exact", (F.col("position") == F.col("_plain")).alias("wins_without"))


def _wanted(spark, sf_dir, anchors):
    first = anchors.filter("position = 1").select("page_id", F.col("location").alias("wanted_location"))
    second = anchors.filter("position = 2").select("page_id", F.col("anchor_hash").alias("_h2"))
    rows = text_table(spark, sf_dir, "pages", "page_id").select("page_id").join(first, "page_id", "left").join(second, "page_id", "left")
    return rows.select(
        F.col("page_id").alias("row_id"), "page_id", F.coalesce("wanted_location", F.lit("")).alias("wanted_location"),
        F.when(F.col("page_id") % 2 == 0, F.coalesce("_h2", F.lit(""))).otherwise("missing").alias("source_anchor_hash"),
    )


# --- rule tables over the sentences of the test prose ---------------------------------------------------

TEST_SCORES = [
    Score(5, "text", terms=("thtion", "attion", "the"), match="word"),
    Score(6, "text", any_word(["ertion", "oument"]), domain="toxicity"),
    Score(8, "text", any_word(["antion", "retion"]), domain="offtarget"),
    Score(-4, "text", "hely"),
]
CTX = f"""{SENT}, ctx AS (SELECT s.doc_id AS row_id, position, sentence AS text, d.lang AS source_kind, so.title, so.title || ' ' || sentence AS combined,
    CASE WHEN position <= 2 THEN 'Introduction' WHEN position <= 5 THEN 'Results' ELSE 'Discussion' END AS location,
    CASE WHEN s.doc_id % 2 = 0 THEN 'toxicity' ELSE 'offtarget' END AS evidence_domain, position = 1 AS hash_exact
    FROM snt s JOIN documents d ON d.doc_id = s.doc_id JOIN source_document so ON so.id = s.doc_id WHERE sentence <> ''),
  sc AS (SELECT *, 5 * ((regexp_matches(lower(text), '(^|[^A-Za-z0-9])thtion([^A-Za-z0-9]|$)'))::INT + (regexp_matches(lower(text), '(^|[^A-Za-z0-9])attion([^A-Za-z0-9]|$)'))::INT
      + (regexp_matches(lower(text), '(^|[^A-Za-z0-9])the([^A-Za-z0-9]|$)'))::INT)
    + CASE WHEN evidence_domain = 'toxicity' AND {re_sql("text", any_word(["ertion", "oument"]))} THEN 6 ELSE 0 END
    + CASE WHEN evidence_domain = 'offtarget' AND {re_sql("text", any_word(["antion", "retion"]))} THEN 8 ELSE 0 END
    + CASE WHEN contains(lower(text), 'hely') THEN -4 ELSE 0 END AS score FROM ctx)"""


def _contexts(spark, sf_dir):
    docs = text_table(spark, sf_dir, "documents", "doc_id")
    titles = evidence_tables(spark, sf_dir)["source_document"].select(F.col("id").alias("doc_id"), "title")
    rows = mining.sentences(docs, keep=("doc_id", "lang")).join(titles, "doc_id")
    return rows.select(
        F.col("doc_id").alias("row_id"), "position", F.col("sentence").alias("text"), F.col("lang").alias("source_kind"), "title",
        F.concat_ws(" ", "title", "sentence").alias("combined"),
        F.when(F.col("position") <= 2, "Introduction").when(F.col("position") <= 5, "Results").otherwise("Discussion").alias("location"),
        F.when(F.col("doc_id") % 2 == 0, "toxicity").otherwise("offtarget").alias("evidence_domain"),
        (F.col("position") == 1).alias("hash_exact"),
    )


def _scored(spark, sf_dir):
    return mining.context_score(_contexts(spark, sf_dir), TEST_SCORES)


@query("context_score", f"WITH {CTX} SELECT row_id, position, score FROM sc")
def _(spark, sf_dir):
    return _scored(spark, sf_dir).select("row_id", "position", "score")


_BESTCTX = f"{CTX}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, position) AS rn FROM sc) WHERE rn = 1)"


@query(
    "best_context_exact",
    f"""WITH {_BESTCTX}, e AS (SELECT * FROM sc WHERE hash_exact)
      SELECT b.row_id, CASE WHEN e.row_id IS NULL OR (e.location = 'Introduction' AND b.location <> 'Introduction' AND b.score > 0) OR b.score >= e.score + 12
        THEN b.position ELSE e.position END AS position FROM b LEFT JOIN e ON e.row_id = b.row_id""",
)
def _(spark, sf_dir):
    return mining.best_context(_scored(spark, sf_dir), "exact").select("row_id", "position")


@query(
    "best_context_prefer",
    f"""WITH {CTX} SELECT row_id, position, score FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY contains(lower(text), 'ontion') DESC, score DESC, position) AS rn FROM sc) WHERE rn = 1""",
)
def _(spark, sf_dir):
    return mining.best_context(_scored(spark, sf_dir), "prefer", relevant=rules.found("text", "ontion")).select("row_id", "position", "score")


@query(
    "best_context_only",
    f"""WITH {CTX} SELECT row_id, position, score FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, position) AS rn FROM sc WHERE contains(lower(text), 'ontion')) WHERE rn = 1""",
)
def _(spark, sf_dir):
    return mining.best_context(_scored(spark, sf_dir), "only", relevant=rules.found("text", "ontion")).select("row_id", "position", "score")


TEST_REJECTS = [
    Reject("junk title", (has("title", r"\|"),)),
    Reject("no endpoint", (lacks("text", any_word(["the", "les", "der", "los"])),)),
    Reject("background only", (has("location", "Introduction"), lacks("text", "tion"))),
    Reject("efficacy readout", (has("text", "ing"), lacks("combined", "hation|thtion")), domain="toxicity"),
    Reject("generic", (has("text", "ea"), lacks("text", "on")), domain="offtarget"),
]
TEST_GRADES = [
    Label("B", (has("source_kind", "^fr$"), has("text", "tion"))),
    Label("C", (has("location", "Introduction|Discussion"),)),
    Label("A", (has("location", "Results"), has("text", "the"))),
]




def tests_sql(tests, domain: str = "") -> str:
    parts = [re_sql(t.field, t.pattern, t.present) for t in tests]
    return " AND ".join(parts + ([f"evidence_domain = '{domain}'"] if domain else []))


def cascade_sql() -> str:
    reason = "CASE " + " ".join(f"WHEN {tests_sql(r.tests, r.domain)} THEN '{r.reason}'" for r in TEST_REJECTS) + " ELSE '' END"
    grade = "CASE " + " ".join(f"WHEN {tests_sql(g.tests)} THEN '{g.value}'" for g in TEST_GRADES) + " ELSE 'C' END"
    return f"dec AS (SELECT *, {reason} AS reason, {grade} AS g FROM ctx), dcd AS (SELECT *, CASE WHEN reason = '' THEN 'accept' ELSE 'reject' END AS decision, CASE WHEN reason = '' THEN g ELSE '' END AS grade FROM dec)"


def _decided(spark, sf_dir):
    return rules.decision_cascade(_contexts(spark, sf_dir), TEST_REJECTS, TEST_GRADES)


@query("decision_cascade", f"WITH {CTX}, {cascade_sql()} SELECT row_id, position, decision, reason, grade FROM dcd")
def _(spark, sf_dir):
    return _decided(spark, sf_dir).select("row_id", "position", "decision", "reason", "grade")


@query("reason_histogram", f"WITH {CTX}, {cascade_sql()} SELECT decision, reason, grade, count(*) AS n FROM dcd GROUP BY ALL")
def _(spark, sf_dir):
    return rules.reason_histogram(_decided(spark, sf_dir))


@query("grade_rules", f"WITH {CTX}, {cascade_sql()} SELECT source_kind, location, g AS grade, count(*) AS n FROM dcd GROUP BY ALL")
def _(spark, sf_dir):
    graded = _contexts(spark, sf_dir).withColumn("grade", rules.first_match(TEST_GRADES, "C"))
    return graded.groupBy("source_kind", "location", "grade").agg(F.count("*").alias("n"))


@query(
    "grade_rules_computational",
    f"""WITH {CTX}, g AS (SELECT row_id, position, row_id % 7 = 0 AS computed, row_id % 4 = 0 AS abstract, CASE WHEN position > 8 THEN 'Methods' ELSE location END AS place,
        lower(text || CASE row_id % 5 WHEN 0 THEN ' was well tolerated' WHEN 1 THEN ' off-target' WHEN 2 THEN ' subclinical' ELSE '' END) AS t FROM ctx)
      SELECT row_id, position, CASE WHEN computed THEN 'C'
        WHEN abstract AND regexp_matches(t, '(?:^|[^\\p{{L}}\\p{{N}}_])clinical|phase|patient|well tolerated|adverse|off-target(?:[^\\p{{L}}\\p{{N}}_]|$)') THEN 'B'
        WHEN abstract OR place IN ('Introduction', 'Discussion') THEN 'C' WHEN place = 'Results' THEN 'A' ELSE 'B' END AS grade FROM g""",
)
def _(spark, sf_dir):
    """The shipped grade table over whole sentences with words appended; computed evidence is grade C."""
    row = F.col("row_id")
    added = F.when(row % 5 == 0, " was well tolerated").when(row % 5 == 1, " off-target").when(row % 5 == 2, " subclinical").otherwise("")
    rows = _contexts(spark, sf_dir).withColumns(
        {
            "is_computational_prediction": (row % 7 == 0).cast("int"),
            "source_kind": F.when(row % 4 == 0, "abstract").otherwise("full_text"),
            "location": F.when(F.col("position") > 8, "Methods").otherwise(F.col("location")),
            "text": F.concat("text", added),
        }
    )
    return rows.select("row_id", "position", rules.first_match(GRADES_COMPUTATIONAL, "C").alias("grade"))


@query(
    "benchmark_eligible",
    f"""WITH {CTX}, {cascade_sql()} SELECT location, grade IN ('A', 'B') AND source_kind = 'en' AND NOT regexp_matches(location, 'Introduction|Discussion|Conclusion') AS eligible, count(*) AS n FROM dcd GROUP BY ALL""",
)
def _(spark, sf_dir):
    rows = _decided(spark, sf_dir).withColumn("source_kind", F.when(F.col("source_kind") == "en", "full_text").otherwise("abstract"))
    return rows.groupBy("location", mining.benchmark_eligible("grade").alias("eligible")).agg(F.count("*").alias("n"))


def attribute_sql(name: str) -> str:
    labels, default = ATTRIBUTES[name]
    whens = " ".join(
        "WHEN " + " AND ".join(re_sql(t.field, t.pattern.replace("'", "''"), t.present) for t in label.tests) + f" THEN '{label.value}'" for label in labels
    )
    return f"CASE {whens} ELSE '{default}' END AS {name}"


@query("infer_attributes", f"WITH {CTX} SELECT row_id, position, {', '.join(attribute_sql(n) for n in ATTRIBUTES)} FROM ctx")
def _(spark, sf_dir):
    return rules.infer_attributes(_contexts(spark, sf_dir), ATTRIBUTES).select("row_id", "position", *ATTRIBUTES)


# Words of the rule tables, dealt over the sentences in their place, so that every assay occurs in both domains.
ASSAY_WORDS = [
    "a clinical phase 2 study", "RNA-seq of liver", "MTT was used", "LDH release", "serum ALT", "haemolysis", "a microarray", "a luciferase reporter", "an in silico tool", "nothing else",
]


def _worded(spark, sf_dir):
    words = F.array(*[F.lit(w) for w in ASSAY_WORDS])
    said = F.element_at(words, (F.pmod(F.col("row_id") + F.col("position"), F.lit(len(ASSAY_WORDS))) + 1).cast("int"))
    return _contexts(spark, sf_dir).withColumn("text", said).withColumn("combined", said)


@query(
    "infer_assays",
    f"""WITH {CTX}, w AS (SELECT row_id, position, ['{"', '".join(ASSAY_WORDS)}'][1 + (row_id + position) % {len(ASSAY_WORDS)}] AS word FROM ctx)
      SELECT row_id, position,
        CASE word WHEN 'a clinical phase 2 study' THEN 'clinical safety assessment' WHEN 'RNA-seq of liver' THEN 'RNA-seq' WHEN 'MTT was used' THEN 'cell viability assay'
          WHEN 'LDH release' THEN 'LDH cytotoxicity assay' WHEN 'serum ALT' THEN 'in vivo toxicity' WHEN 'haemolysis' THEN 'hemolysis assay' ELSE 'experimental safety assessment' END AS toxicity_assay,
        CASE word WHEN 'RNA-seq of liver' THEN 'RNA-seq/transcriptome profiling' WHEN 'a microarray' THEN 'microarray' WHEN 'a luciferase reporter' THEN 'luciferase reporter'
          WHEN 'an in silico tool' THEN 'computational off-target prediction' ELSE 'off-target assessment' END AS offtarget_assay FROM w""",
)
def _(spark, sf_dir):
    """The real assay tables of both domains; the check names the outcome of each word by hand."""
    worded = _worded(spark, sf_dir)
    both = {"toxicity_assay": ATTRIBUTES["assay_type"], "offtarget_assay": ATTRIBUTES_OFFTARGET["assay_type"]}
    return rules.infer_attributes(worded, both).select("row_id", "position", *both)


@query(
    "infer_molecules",
    r"""WITH t AS (SELECT doc_id, unnest(a) AS tok, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '(?i)[a-z]+(tion|heit|ment)') AS a FROM documents)),
      f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(tok) ORDER BY i) AS rn FROM t WHERE lower(tok) NOT IN ('thtion', 'attion')) WHERE rn = 1),
      g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM f)
      SELECT d.doc_id, coalesce(string_agg(tok, '; ' ORDER BY k) FILTER (k <= 3), '') AS names FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id GROUP BY d.doc_id""",
)
def _(spark, sf_dir):
    names = rules.distinct_matches("text", [r"[a-z]+(?:tion|heit|ment)"], ["thtion", "attion"], 3)
    return text_table(spark, sf_dir, "documents", "doc_id").select("doc_id", F.array_join(names, "; ").alias("names"))


_FLAGS = f"""concat_ws('; ', CASE WHEN location = 'Introduction' THEN 'intro_anchor_needs_primary_result' END, CASE WHEN location = 'Discussion' THEN 'discussion_or_conclusion_anchor' END,
  CASE WHEN {re_sql("title", "hation|thtion")} THEN 'review_or_meta_analysis' END, CASE WHEN {list_sql("text", LEXICON["toxicity"])} = '' THEN 'domain_term_weak' END,
  CASE WHEN source_kind = 'fr' THEN 'mixed_modality_needs_resolution' END)"""


@query("risk_flags", f"WITH {CTX} SELECT row_id, position, {_FLAGS} AS flags FROM ctx")
def _(spark, sf_dir):
    rows = _contexts(spark, sf_dir).withColumns(
        {
            "article_type": F.lit("research-article"),
            "candidate_modality": F.when(F.col("source_kind") == "fr", "ASO/siRNA").otherwise("siRNA"),
            "_m": rules.match_terms("text", LEXICON["toxicity"]),
        }
    )
    return rows.select("row_id", "position", F.array_join(mining.risk_flags("_m", "hation|thtion"), "; ").alias("flags"))


_PRIO = """CASE WHEN coalesce(source_location, '') = '' AND confidence_label = 'high_candidate' THEN 'P0_full_text_high_confidence'
  WHEN coalesce(doi, '') <> '' AND confidence_label IN ('high_candidate', 'medium_candidate') THEN 'P1_full_text_review'
  WHEN confidence_label IN ('high_candidate', 'medium_candidate') THEN 'P2_source_location_review' ELSE 'P3_low_confidence_backfill' END"""


@query("review_priority", f"SELECT id, {_PRIO} AS priority FROM curation_candidate")
def _(spark, sf_dir):
    rows = evidence_tables(spark, sf_dir)["curation_candidate"].select(
        "id", "confidence_label", F.col("doi").alias("proposed_source_location"), F.when(F.col("source_location") == "", "none").otherwise("some").alias("risk_flags")
    )
    return rows.select("id", mining.review_priority().alias("priority"))


@query(
    "release_packet",
    """WITH p AS (SELECT c.id, c.evidence_domain, c.confidence_label, s.publication_year, s.id AS sid,
        CASE c.confidence_label WHEN 'high_candidate' THEN 300 WHEN 'medium_candidate' THEN 200 ELSE 100 END + CASE WHEN coalesce(s.pmcid, '') <> '' THEN 50 ELSE 0 END AS sc
        FROM curation_candidate c JOIN source_document s ON s.id = c.source_document_id WHERE c.evidence_domain IN ('toxicity', 'offtarget') AND c.curator_decision = 'pending'
          AND c.source_location <> '' AND (coalesce(c.pmid, '') <> '' OR coalesce(c.doi, '') <> '')),
      r AS (SELECT *, row_number() OVER (PARTITION BY evidence_domain ORDER BY sc DESC, coalesce(publication_year, 0) DESC, id) AS rn FROM p),
      t AS (SELECT * FROM (SELECT *, CASE WHEN evidence_domain = 'offtarget' AND rn <= 60 THEN 0 WHEN evidence_domain = 'toxicity' THEN 1 ELSE 2 END AS pass FROM r)
        ORDER BY pass, sc DESC, coalesce(publication_year, 0) DESC, id LIMIT 400)
      SELECT t.id AS candidate_id, CASE WHEN l.doc_id IS NOT NULL THEN 'none' ELSE 'no_machine_full_text_anchor' END AS risk_flags,
        CASE WHEN l.doc_id IS NOT NULL AND confidence_label = 'high_candidate' THEN 'P0_full_text_high_confidence' WHEN l.doc_id IS NOT NULL AND confidence_label = 'medium_candidate' THEN 'P1_full_text_review'
          WHEN confidence_label IN ('high_candidate', 'medium_candidate') THEN 'P2_source_location_review' ELSE 'P3_low_confidence_backfill' END AS review_priority
      FROM t LEFT JOIN labels l ON l.doc_id = t.sid""",
)
def _(spark, sf_dir):
    tables = evidence_tables(spark, sf_dir)
    labels = raw_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("source_document_id"))
    anchors = tables["curation_candidate"].join(labels, "source_document_id").select(
        F.col("id").alias("candidate_id"), F.lit("Results; paragraph 1").alias("proposed_source_location"), F.lit("h").alias("source_anchor_hash"), F.lit("none").alias("risk_flags")
    )
    return mining.release_packet(tables, anchors, 400, 60).select("candidate_id", "risk_flags", "review_priority")


# --- grounding -------------------------------------------------------------------------------------------


@query(
    "grounding_join",
    r"""SELECT b.item_id, d.doc_id FROM documents d JOIN benchmark b
      ON contains(lower(trim(regexp_replace(d.text, '\s+', ' ', 'g'))), lower(trim(regexp_replace(b.text, '\s+', ' ', 'g'))))""",
)
def _(spark, sf_dir):
    return mining.grounding_join(raw_table(spark, sf_dir, "benchmark"), text_table(spark, sf_dir, "documents", "doc_id"), "item_id", "doc_id")


_PREC = r"""pp AS (SELECT d.doc_id AS row_id, CASE WHEN d.lang = 'en' AND d.text <> '' THEN 'full_text' WHEN coalesce(l.doc_id, -1) >= 0 AND s.title <> '' THEN 'abstract' ELSE 'snippet' END AS passage_kind,
    CASE WHEN d.lang = 'en' AND d.text <> '' THEN d.text WHEN coalesce(l.doc_id, -1) >= 0 AND s.title <> '' THEN s.title ELSE 'snippet ' || d.doc_id END AS passage
    FROM documents d JOIN source_document s ON s.id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def _passages(spark, sf_dir):
    docs = text_table(spark, sf_dir, "documents", "doc_id")
    titles = evidence_tables(spark, sf_dir)["source_document"].select(F.col("id").alias("row_id"), F.col("title").alias("text"))
    labels = raw_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"))
    rows = docs.select(F.col("doc_id").alias("row_id"), F.concat(F.lit("snippet "), F.col("doc_id").cast("string")).alias("snippet"))
    full = docs.filter("lang = 'en'").select(F.col("doc_id").alias("row_id"), "text")
    return mining.passage_precedence(rows, full, titles.join(labels, "row_id"))


@query("passage_precedence", f"WITH {_PREC} SELECT row_id, passage_kind, sha256(passage) AS h FROM pp")
def _(spark, sf_dir):
    return _passages(spark, sf_dir).select("row_id", "passage_kind", F.sha2("passage", 256).alias("h"))


@query(
    "verify_grounding",
    rf"""WITH {_PREC}, d AS (SELECT s.id AS row_id, CASE WHEN s.id % 4 = 0 THEN replace(s.title, ' ', '  ') WHEN s.id % 4 = 1 THEN 'none' ELSE s.title END AS quote,
        CASE WHEN s.id % 5 = 0 THEN 'reject' ELSE 'accept' END AS decision FROM source_document s),
      g AS (SELECT d.*, lower(d.decision) = 'accept' AND NOT (length(lower(trim(regexp_replace(quote, '\s+', ' ', 'g')))) >= 12 AND quote <> 'none'
        AND contains(lower(trim(regexp_replace(passage, '\s+', ' ', 'g'))), lower(trim(regexp_replace(quote, '\s+', ' ', 'g'))))) AS failed FROM d JOIN pp ON pp.row_id = d.row_id)
      SELECT row_id, CASE WHEN failed THEN 'reject' ELSE decision END AS decision, CASE WHEN failed THEN 'NA' ELSE 'B' END AS grade,
        CASE WHEN failed THEN 'ungrounded quote: checked' ELSE 'checked' END AS reason, failed AS grounding_failed FROM g""",
)
def _(spark, sf_dir):
    sources = evidence_tables(spark, sf_dir)["source_document"]
    kind = F.col("id") % 4
    decisions = sources.select(
        F.col("id").alias("row_id"),
        F.when(kind == 0, F.replace("title", F.lit(" "), F.lit("  "))).when(kind == 1, "none").otherwise(F.col("title")).alias("quote"),
        F.when(F.col("id") % 5 == 0, "reject").otherwise("accept").alias("decision"), F.lit("B").alias("grade"), F.lit("checked").alias("reason"),
    )
    return mining.verify_grounding(decisions, _passages(spark, sf_dir)).select("row_id", "decision", "grade", "reason", "grounding_failed")
