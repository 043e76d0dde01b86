"""Queries: safety triage of designs, evidence graph and dossier."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.lexicons import Concern
from attesta.operators import release, stats, triage
from attesta.operators.search import EVIDENCE_FIELDS
from attesta.plans.q03_search import STOP, SYNONYMS, _terms_sql
from attesta.plans.registry import query
from attesta.sources.adapters import evidence_tables

TEST_CONCERNS = [
    Concern("prose", "toxicity", "Prose evidence", ("thtion", "attion")),
    Concern("parts", "offtarget", "Named parts", ("gear", "widget", "off-target")),
    Concern("places", "toxicity", "Places", ("asia", "tiny"), "modification"),
    Concern("nothing", "safety", "No such domain", ("zzzzzz",), "delivery"),
]


def _designs(tables):
    """One design per disease context, described by its molecules."""
    return (
        tables["molecule"]
        .groupBy(F.col("disease_context").alias("design_id"))
        .agg(
            F.min("guide_sequence").alias("sequence"),
            F.min(F.nullif("target_gene_symbol", F.lit(""))).alias("target"),
            F.min(F.nullif("backbone_chemistry", F.lit(""))).alias("modification"),
            F.max("conjugate_delivery").alias("delivery"),
        )
        .withColumn("endpoint", F.lit("ring; hot"))
    )


def _triage(spark, sf_dir):
    tables = evidence_tables(spark, sf_dir)
    candidates = stats.candidate_rows(tables["curation_candidate"], tables["source_document"])
    return triage.safety_triage(_designs(tables), release.release_view(tables), candidates, TEST_CONCERNS, SYNONYMS, STOP)


def _norm(c: str) -> str:
    return f"regexp_replace(lower(coalesce(CAST({c} AS VARCHAR), '')), 'off[ -]target', 'offtarget', 'g')"


def _text(cols: list[str]) -> str:
    return "concat_ws(' | ', " + ", ".join(_norm(c) for c in cols) + ")"


_OWN = ", ".join(
    f"('{c.key}', '{c.domain}', '{c.label}', '{t}', {i})" for c in TEST_CONCERNS for i, t in enumerate(c.terms, start=101)
)
TRIAGE = f"""des AS (SELECT disease_context AS design_id, regexp_replace(translate(upper(coalesce(min(guide_sequence), '')), 'U', 'T'), '[^ACGTN]', '', 'g') AS canonical,
    coalesce(min(guide_sequence), '') AS raw_sequence, coalesce(min(nullif(target_gene_symbol, '')), '') AS target, coalesce(min(nullif(backbone_chemistry, '')), '') AS modification,
    coalesce(max(conjugate_delivery), '') AS delivery, 'ring; hot' AS endpoint FROM molecule GROUP BY disease_context),
  feat AS (SELECT *, CASE WHEN length(canonical) >= 8 THEN substr(canonical, 2, 7) ELSE '' END AS seed FROM des),
  inp AS (SELECT design_id, target AS term, 1 AS ord FROM feat UNION ALL SELECT design_id, modification, 2 FROM feat UNION ALL SELECT design_id, delivery, 3 FROM feat
    UNION ALL SELECT design_id, 'ring', 4 FROM feat UNION ALL SELECT design_id, 'hot', 5 FROM feat UNION ALL SELECT design_id, seed, 6 FROM feat),
  inr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY design_id ORDER BY ord) AS k FROM inp WHERE length(term) >= 2) WHERE k <= 5),
  own AS (SELECT * FROM (VALUES {_OWN}) v(concern_id, domain, concern, term, ord)),
  con AS (SELECT DISTINCT concern_id, domain, concern FROM own),
  trm AS (SELECT design_id, concern_id, term FROM inr JOIN con ON true UNION ALL SELECT design_id, concern_id, term FROM feat JOIN own ON true
    UNION ALL SELECT design_id, 'places', modification FROM feat WHERE modification <> '' UNION ALL SELECT design_id, 'nothing', delivery FROM feat WHERE delivery <> ''),
  cln AS (SELECT design_id, concern_id, trim({_norm("term")}) AS c FROM trm),
  tok AS (SELECT design_id, concern_id, unnest(regexp_extract_all(c, '[a-z0-9'']+')) AS t FROM cln),
  syn AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{s}')" for k, v in SYNONYMS.items() for s in v)}) v(token, s)),
  var AS (SELECT DISTINCT design_id, concern_id, v FROM (SELECT design_id, concern_id, c AS v FROM cln
      UNION ALL SELECT design_id, concern_id, coalesce(syn.s, t) FROM tok LEFT JOIN syn ON syn.token = t WHERE length(t) >= 2 AND t NOT IN ({", ".join(f"'{s}'" for s in STOP)}))
    WHERE length(v) >= 2),
  rel AS (SELECT evidence_domain, evidence_domain || ':' || evidence_id AS record, evidence_grade, pmid, doi, source_title, {_text(triage.RELEASE_FIELDS)} AS txt FROM release_view),
  rsc AS (SELECT d.design_id, con.concern_id, record, evidence_grade, pmid, doi, source_title,
      (SELECT count(*) FROM var WHERE var.design_id = d.design_id AND var.concern_id = con.concern_id AND contains(txt, v))
      + CASE WHEN d.target <> '' AND contains(txt, trim({_norm("d.target")})) THEN 3 ELSE 0 END AS match_score FROM rel JOIN con ON con.domain = rel.evidence_domain JOIN feat d ON true),
  rlm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY design_id, concern_id ORDER BY match_score DESC, CASE evidence_grade WHEN 'A' THEN 3 WHEN 'B' THEN 2 ELSE 1 END DESC, record) AS rank
    FROM rsc WHERE match_score > 0) WHERE rank <= 20),
  cnd AS (SELECT c.id, evidence_domain, confidence_label, {_text(["candidate_signal", "matched_terms", "candidate_modality", "source_location", "s.title", "c.pmid", "c.doi"])} AS txt
    FROM curation_candidate c JOIN source_document s ON s.id = c.source_document_id WHERE coalesce(curator_decision, '') <> 'accept'),
  csc AS (SELECT d.design_id, con.concern_id, id, confidence_label, (SELECT count(*) FROM var WHERE var.design_id = d.design_id AND var.concern_id = con.concern_id AND contains(txt, v)) AS match_score
    FROM cnd JOIN con ON con.domain = cnd.evidence_domain JOIN feat d ON true),
  gap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY design_id, concern_id ORDER BY match_score DESC, CASE confidence_label WHEN 'high_candidate' THEN 3 WHEN 'medium_candidate' THEN 2 ELSE 1 END, id) AS rank
    FROM csc WHERE match_score > 0) WHERE rank <= 20),
  stt AS (SELECT d.design_id, con.concern_id, concern, domain, coalesce(r.n, 0) AS release_records, coalesce(r.ab, 0) AS benchmark_eligible_records, coalesce(g.n, 0) AS candidate_records,
      CASE WHEN r.ab > 0 THEN 'evidence-supported concern' WHEN r.n > 0 THEN 'contextual release evidence' WHEN g.n > 0 THEN 'evidence gap' ELSE 'not assessable from current release' END AS evidence_state
    FROM feat d JOIN con ON true LEFT JOIN (SELECT design_id, concern_id, count(*) AS n, count(*) FILTER (evidence_grade IN ('A', 'B')) AS ab FROM rlm GROUP BY ALL) r ON r.design_id = d.design_id AND r.concern_id = con.concern_id
    LEFT JOIN (SELECT design_id, concern_id, count(*) AS n FROM gap GROUP BY ALL) g ON g.design_id = d.design_id AND g.concern_id = con.concern_id),
  rep AS (SELECT d.*, substr(sha256(concat_ws('|', canonical, target, modification, delivery, endpoint, '', '')), 1, 16) AS report_id,
      (SELECT count(*) FROM stt s WHERE s.design_id = d.design_id AND evidence_state = 'evidence-supported concern') AS supported_concerns,
      (SELECT count(*) FROM stt s WHERE s.design_id = d.design_id AND evidence_state = 'contextual release evidence') AS contextual_concerns,
      (SELECT count(*) FROM stt s WHERE s.design_id = d.design_id AND evidence_state = 'evidence gap') AS gap_concerns,
      (SELECT count(*) FROM stt s WHERE s.design_id = d.design_id AND evidence_state = 'not assessable from current release') AS not_assessable_concerns,
      (SELECT count(DISTINCT record) FROM rlm r WHERE r.design_id = d.design_id AND rank <= 8) AS release_considered,
      (SELECT count(DISTINCT id) FROM gap g WHERE g.design_id = d.design_id AND rank <= 8) AS candidates_considered FROM feat d)"""


@query("term_variants", f"WITH {TRIAGE} SELECT design_id, concern_id, v FROM var")
def _(spark, sf_dir):
    plans = triage.triage_plans(_designs(evidence_tables(spark, sf_dir)), TEST_CONCERNS, SYNONYMS, STOP)
    return plans.select("design_id", "concern_id", F.explode("variants").alias("v"))


@query("match_score", f"WITH {TRIAGE} SELECT design_id, concern_id, match_score, count(*) AS n FROM rlm GROUP BY ALL")
def _(spark, sf_dir):
    return _triage(spark, sf_dir)["release"].groupBy("design_id", "concern_id", "match_score").agg(F.count("*").alias("n"))


@query("concern_matches", f"WITH {TRIAGE} SELECT design_id, concern_id, record, match_score, rank FROM rlm")
def _(spark, sf_dir):
    return _triage(spark, sf_dir)["release"].select("design_id", "concern_id", "record", "match_score", "rank")


@query("concern_candidates", f"WITH {TRIAGE} SELECT design_id, concern_id, id, match_score, rank FROM gap")
def _(spark, sf_dir):
    return _triage(spark, sf_dir)["gaps"].select("design_id", "concern_id", "id", "match_score", "rank")


@query(
    "evidence_state",
    f"""WITH {TRIAGE} SELECT *, row_number() OVER (PARTITION BY design_id ORDER BY CASE evidence_state WHEN 'evidence-supported concern' THEN 3 WHEN 'contextual release evidence' THEN 2
      WHEN 'evidence gap' THEN 1 ELSE 0 END DESC, release_records DESC, concern) AS position FROM stt""",
)
def _(spark, sf_dir):
    return _triage(spark, sf_dir)["matrix"]


@query(
    "safety_triage",
    f"""WITH {TRIAGE} SELECT design_id, report_id, length(canonical) AS length, seed, contains(canonical, 'N') AS ambiguous,
      CASE WHEN length(canonical) >= 7 AND regexp_replace(upper(raw_sequence), '[ACGTUN]', '', 'g') = '' THEN 'valid seed-aware input' ELSE 'sequence input incomplete for seed-aware triage' END AS sequence_status,
      supported_concerns, contextual_concerns, gap_concerns, not_assessable_concerns, release_considered, candidates_considered,
      CASE WHEN supported_concerns >= 3 THEN 'Evidence-dense safety review required.' ELSE 'Use as a source-grounded triage report with complementary sequence assessment.' END AS interpretation FROM rep""",
)
def _(spark, sf_dir):
    return _triage(spark, sf_dir)["report"].drop("target", "modification", "delivery", "endpoint")


@query(
    "matched_release_records",
    f"""WITH {TRIAGE}, u AS (SELECT DISTINCT design_id, record, evidence_grade FROM rlm WHERE rank <= 8)
      SELECT * FROM (SELECT design_id, record, row_number() OVER (PARTITION BY design_id ORDER BY CASE evidence_grade WHEN 'A' THEN 3 WHEN 'B' THEN 2 ELSE 1 END DESC, record) AS position FROM u) WHERE position <= 30""",
)
def _(spark, sf_dir):
    return triage.matched_release_records(_triage(spark, sf_dir)).select("design_id", "record", "position")


_NODE = "regexp_replace(regexp_replace({c}, '[^a-zA-Z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g')"
GRAPH = f"""{TRIAGE}, edg AS (
    SELECT design_id, 'design:query' AS source, 'concern:' || concern_id AS target, 'assesses' AS type FROM stt
    UNION ALL SELECT design_id, 'concern:' || concern_id, 'release:' || {_NODE.format(c="record")}, 'supported_by' FROM rlm WHERE rank <= 3
    UNION ALL SELECT design_id, 'release:' || {_NODE.format(c="record")}, 'source:' || substr({_NODE.format(c="coalesce(nullif(pmid, ''), nullif(doi, ''), nullif(source_title, ''), 'unknown')")}, 1, 80), 'has_source' FROM rlm WHERE rank <= 3
    UNION ALL SELECT design_id, 'concern:' || concern_id, 'candidate:' || id, 'candidate_gap' FROM gap WHERE rank <= 2),
  nod AS (SELECT DISTINCT design_id, target AS id, CASE type WHEN 'assesses' THEN 'safety_concern' WHEN 'supported_by' THEN 'verified_release_record' WHEN 'has_source' THEN 'source_document' ELSE 'candidate_gap' END AS type FROM edg
    UNION ALL SELECT design_id, 'design:query', 'design_query' FROM feat)"""


@query("evidence_graph_nodes", f"WITH {GRAPH} SELECT design_id, id, type FROM nod")
def _(spark, sf_dir):
    return triage.evidence_graph(_triage(spark, sf_dir))[0].select("design_id", "id", "type")


@query("evidence_graph_edges", f"WITH {GRAPH} SELECT design_id, source, target, type FROM edg")
def _(spark, sf_dir):
    return triage.evidence_graph(_triage(spark, sf_dir))[1].drop("label")


@query(
    "prov_edges",
    f"""WITH {GRAPH} SELECT design_id, 'wasDerivedFrom' AS relation, source AS subject, target AS object, type AS role FROM edg WHERE type <> 'assesses'
      UNION ALL SELECT n.design_id, 'wasGeneratedBy', n.id, 'activity:' || r.report_id, '' FROM nod n JOIN rep r ON r.design_id = n.design_id WHERE n.type IN ('design_query', 'safety_concern')""",
)
def _(spark, sf_dir):
    result = _triage(spark, sf_dir)
    return triage.prov_edges(*triage.evidence_graph(result), result["report"])


@query(
    "dossier",
    f"""WITH {GRAPH} SELECT r.design_id, report_id, supported_concerns, (SELECT count(*) FROM nod n WHERE n.design_id = r.design_id) AS nodes, (SELECT count(*) FROM edg e WHERE e.design_id = r.design_id) AS edges,
      (SELECT count(*) FROM nod n WHERE n.design_id = r.design_id AND type = 'verified_release_record') AS verified_release_nodes, (SELECT count(*) FROM nod n WHERE n.design_id = r.design_id AND type = 'source_document') AS source_nodes,
      (SELECT count(*) FROM nod n WHERE n.design_id = r.design_id AND type = 'candidate_gap') AS candidate_gap_nodes FROM rep r""",
)
def _(spark, sf_dir):
    result = _triage(spark, sf_dir)
    sheet = triage.dossier(result["report"], *triage.evidence_graph(result))
    return sheet.select("design_id", "report_id", "supported_concerns", "nodes", "edges", "verified_release_nodes", "source_nodes", "candidate_gap_nodes")


def _blob(cols: str) -> str:
    return "lower(concat_ws(chr(1), " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in cols.split()) + "))"


# Each design is searched whole and with only some of its fields, so that every stage has rows of its own.
SEARCHED_WITH = {
    "whole": ("target", "modification", "endpoint", "sequence"),
    "chemistry": ("target", "modification"),
    "target": ("target", "endpoint"),
    "modification": ("modification",),
    "sequence": ("sequence",),
    "nothing": (),
}
# The tables hold none of the seed words, so each has a spelling that they do hold.
SEARCH_WORDS = SYNONYMS | {"seed": ["seed", "small"], "offtarget": ["offtarget", "asia"], "hybridization": ["hybridization", "brand#1"], "mismatch": ["mismatch", "ring"]}


def _searches(tables):
    designs = _designs(tables)
    asked = [
        designs.select(
            F.concat_ws(" ", "design_id", F.lit(way)).alias("design_id"),
            *[F.col(c) if c in kept else F.lit("").alias(c) for c in ("target", "modification", "endpoint", "sequence")],
        )
        for way, kept in SEARCHED_WITH.items()
    ]
    return reduce(DataFrame.unionByName, asked)


_WAYS = ", ".join("('" + way + "', " + ", ".join(str(c in kept).lower() for c in ("target", "modification", "endpoint", "sequence")) + ")" for way, kept in SEARCHED_WITH.items())
_SEQ = """substr(regexp_replace(translate(upper(coalesce(min(guide_sequence), '')), 'U', 'T'), '[^ACGTN]', '', 'g'), 2, 7)"""


@query(
    "sequence_search",
    f"""WITH m AS (SELECT disease_context, coalesce(min(nullif(target_gene_symbol, '')), '') AS target, coalesce(min(nullif(backbone_chemistry, '')), '') AS modification, {_SEQ} AS seed FROM molecule GROUP BY disease_context),
      d AS (SELECT concat_ws(' ', disease_context, way) AS design_id, CASE WHEN t THEN target ELSE '' END AS target, CASE WHEN mo THEN modification ELSE '' END AS modification,
        CASE WHEN en THEN 'ring; hot' ELSE '' END AS endpoint, sq AND length(seed) = 7 AS seeded FROM m, (VALUES {_WAYS}) w(way, t, mo, en, sq)),
      w AS (SELECT *, CASE WHEN target <> '' THEN [target] ELSE [] END || CASE WHEN modification <> '' THEN [modification] ELSE [] END || CASE WHEN endpoint <> '' THEN [endpoint] ELSE [] END || CASE WHEN seeded THEN ['seed', 'off-target', 'hybridization', 'mismatch'] ELSE [] END AS a FROM d),
      q AS (SELECT *, array_to_string((CASE WHEN len(a) = 0 THEN ['seed', 'off-target', 'hybridization'] ELSE a END)[1:4], ' ') AS text FROM w),
      asks AS (SELECT design_id || chr(1) || '1' AS ask_id, design_id, 1 AS stage, text, lower(target) AS target FROM q UNION ALL SELECT design_id || chr(1) || '2', design_id, 2, target, '' FROM q WHERE target <> ''),
      {_terms_sql("text", "asks", "ask_id", SEARCH_WORDS)},
      need AS (SELECT k, g, unnest(string_split(spellings, '|')) AS s FROM gr8 UNION ALL SELECT ask_id, 1, lower(text) FROM asks WHERE ask_id NOT IN (SELECT k FROM gr8)),
      n AS (SELECT k, max(g) AS groups FROM need GROUP BY k),
      r AS (SELECT evidence_domain, evidence_id, lower(coalesce(target_gene_symbol, '')) AS tgt, {_blob(" ".join(EVIDENCE_FIELDS))} AS b FROM release_view),
      f AS (SELECT need.k, evidence_domain, evidence_id, tgt, count(DISTINCT g) AS found FROM need JOIN r ON contains(b, s) GROUP BY ALL),
      h AS (SELECT design_id, stage, evidence_domain, evidence_id FROM f JOIN n ON n.k = f.k AND found = groups JOIN asks ON ask_id = f.k AND contains(tgt, target)),
      c AS (SELECT c.id, CASE confidence_label WHEN 'high_candidate' THEN 0 WHEN 'medium_candidate' THEN 1 ELSE 2 END AS k, {_blob("candidate_signal matched_terms c.pmid s.title")} AS b
        FROM curation_candidate c JOIN source_document s ON s.id = c.source_document_id),
      g AS (SELECT design_id, id, k FROM q JOIN c ON contains(b, lower(coalesce(nullif(modification, ''), nullif(endpoint, ''), nullif(target, ''), CASE WHEN seeded THEN 'seed' END, text))))
      SELECT * FROM (SELECT design_id, 'release' AS kind, evidence_id AS id, row_number() OVER (PARTITION BY design_id ORDER BY evidence_domain DESC, evidence_id) AS position FROM h
        WHERE stage = 1 OR design_id NOT IN (SELECT design_id FROM h WHERE stage = 1)) WHERE position <= 25
      UNION ALL SELECT * FROM (SELECT design_id, 'candidate', id, row_number() OVER (PARTITION BY design_id ORDER BY k, id) AS position FROM g) WHERE position <= 25""",
)
def _(spark, sf_dir):
    tables = evidence_tables(spark, sf_dir)
    candidates = stats.candidate_rows(tables["curation_candidate"], tables["source_document"])
    return triage.sequence_search(_searches(tables), release.release_view(tables), candidates, synonyms=SEARCH_WORDS, stopwords=STOP)
