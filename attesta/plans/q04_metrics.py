"""Queries: metrics, baselines, windows, splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions.text import percent, title_score
from attesta.operators import joins, metrics, release, windows
from attesta.plans.registry import query
from attesta.sources.adapters import evidence_tables, raw_table

_LAB = """lab AS (SELECT doc_id, CASE quality WHEN 1 THEN 'accept' ELSE 'reject' END AS a,
  CASE toxic WHEN 1 THEN 'reject' ELSE 'accept' END AS b FROM labels)"""


def _decisions(spark, sf_dir):
    return raw_table(spark, sf_dir, "labels").select(
        "doc_id",
        F.when(F.col("quality") == 1, "accept").otherwise("reject").alias("a"),
        F.when(F.col("toxic") == 1, "reject").otherwise("accept").alias("b"),
    )


@query(
    "cohen_kappa",
    f"""WITH {_LAB}, s AS (SELECT count(*) AS n, (count(*) FILTER (a = b))::DOUBLE / count(*) AS po,
        ((count(*) FILTER (a = 'accept'))::DOUBLE / count(*)) * ((count(*) FILTER (b = 'accept'))::DOUBLE / count(*))
        + ((count(*) FILTER (a = 'reject'))::DOUBLE / count(*)) * ((count(*) FILTER (b = 'reject'))::DOUBLE / count(*)) AS pe FROM lab)
      SELECT n, CASE WHEN pe < 1 THEN (po - pe) / (1.0 - pe) END AS kappa FROM s""",
)
def _(spark, sf_dir):
    return metrics.cohen_kappa(_decisions(spark, sf_dir), "a", "b")


@query(
    "raw_agreement",
    f"""WITH {_LAB}, d AS (SELECT d.doc_id, 'accept' AS first, coalesce(lab.a, '') AS second FROM documents d LEFT JOIN lab ON lab.doc_id = d.doc_id)
      SELECT count(*) AS sample_rows, count(*) FILTER (second <> '') AS reviewed_rows, count(*) FILTER (second IN ('accept', 'reject')) AS comparable_rows,
      (count(*) FILTER (second = first))::DOUBLE / nullif(count(*) FILTER (second IN ('accept', 'reject')), 0) AS agreement,
      CASE WHEN count(*) FILTER (second IN ('accept', 'reject')) >= count(*) THEN 'claimable' ELSE 'not_claimable' END AS claim_status FROM d""",
)
def _(spark, sf_dir):
    docs = raw_table(spark, sf_dir, "documents").select("doc_id", F.lit("accept").alias("first"))
    second = _decisions(spark, sf_dir).select("doc_id", F.col("a").alias("second"))
    return metrics.raw_agreement(docs.join(second, "doc_id", "left"), "first", "second")


@query(
    "false_accept_rate",
    f"""WITH {_LAB}, c AS (SELECT (count(*) FILTER (a = 'accept'))::DOUBLE AS n, (count(*) FILTER (a = 'accept' AND b = 'reject'))::DOUBLE AS k FROM lab)
      SELECT n::BIGINT AS accepts, k::BIGINT AS false_accepts, k / n AS rate,
      (k / n + 3.8416 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / 4 / (n * n))) / (1 + 3.8416 / n) AS ci_low,
      (k / n + 3.8416 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / 4 / (n * n))) / (1 + 3.8416 / n) AS ci_high FROM c""",
)
def _(spark, sf_dir):
    rates = metrics.false_accept_rate(_decisions(spark, sf_dir), "a", "b")
    return rates


@query(
    "accuracy",
    f"WITH {_LAB} SELECT lang, (count(*) FILTER (a = b))::DOUBLE / count(*) AS accuracy FROM lab JOIN documents d ON d.doc_id = lab.doc_id GROUP BY lang",
)
def _(spark, sf_dir):
    docs = raw_table(spark, sf_dir, "documents").select("doc_id", "lang")
    return metrics.accuracy(_decisions(spark, sf_dir).join(docs, "doc_id"), "a", "b", ["lang"])


_F1 = """pl AS (SELECT g, label, sum(tp) AS tp, sum(err) AS err FROM (
    SELECT g, truth AS label, CASE WHEN truth = pred THEN 1 ELSE 0 END AS tp, CASE WHEN truth = pred THEN 0 ELSE 1 END AS err FROM x
    UNION ALL SELECT g, pred, 0, 1 FROM x WHERE truth <> pred) GROUP BY g, label),
  f1 AS (SELECT g, CAST(sum(CAST(2.0::DOUBLE * tp / (2 * tp + err) AS DECIMAL(38, 18))) AS DOUBLE) / count(*) AS macro_f1 FROM pl GROUP BY g)"""


@query(
    "macro_f1",
    f"""WITH {_LAB}, x AS (SELECT lang AS g, a AS truth, b AS pred FROM lab JOIN documents d ON d.doc_id = lab.doc_id), {_F1}
      SELECT g AS lang, macro_f1 FROM f1""",
)
def _(spark, sf_dir):
    docs = raw_table(spark, sf_dir, "documents").select("doc_id", "lang")
    return metrics.macro_f1(_decisions(spark, sf_dir).join(docs, "doc_id"), "a", "b", ["lang"])


@query("percent", "SELECT source_type, (count(*) FILTER (coalesce(pmid, '') <> ''))::DOUBLE / greatest(count(*)::DOUBLE, 1.0) * 100.0::DOUBLE AS pct FROM source_document GROUP BY source_type")
def _(spark, sf_dir):
    sources = evidence_tables(spark, sf_dir)["source_document"]
    counts = sources.groupBy("source_type").agg(F.count(F.when(F.coalesce("pmid", F.lit("")) != "", 1)).alias("k"), F.count("*").alias("n"))
    return counts.select("source_type", percent("k", "n").alias("pct"))


_LOOKUP = """sl AS (SELECT b.task_name, b.split_name, b.entity_table, b.entity_id, r.category, r.modality, r.evidence_grade, b.leakage_group,
    coalesce(nullif(trim(r.target_gene_symbol), ''), 'unknown') AS target
  FROM benchmark_split b JOIN release_view r ON r.entity_table = b.entity_table AND r.evidence_id = b.entity_id)"""


def _majority(by: str, name: str) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT task_name, {by} AS grp, category AS label, n, row_number() OVER (PARTITION BY task_name, {by}
      ORDER BY n DESC, first_seen) AS rn FROM (SELECT task_name, {by}, category, count(*) AS n,
        min(entity_table || lpad(CAST(entity_id AS VARCHAR), 20, '0')) AS first_seen FROM sl WHERE split_name = 'train' GROUP BY ALL)) WHERE rn = 1)"""


_BASE = f"""{_LOOKUP}, sla AS (SELECT *, 'all' AS everyone FROM sl), {_majority("modality", "m_mod")}, {_majority("evidence_grade", "m_grade")}, {_majority("target", "m_target")},
  m_all AS (SELECT * FROM (SELECT task_name, category AS label, n, row_number() OVER (PARTITION BY task_name ORDER BY n DESC, first_seen) AS rn
    FROM (SELECT task_name, category, count(*) AS n, min(entity_table || lpad(CAST(entity_id AS VARCHAR), 20, '0')) AS first_seen
      FROM sl WHERE split_name = 'train' GROUP BY ALL)) WHERE rn = 1),
  tr AS (SELECT task_name, count(*) AS train_rows, count(DISTINCT category) AS train_label_count FROM sl WHERE split_name = 'train' GROUP BY task_name),
  pr AS (
    SELECT sl.task_name, split_name, 'train_majority_class' AS model, category AS truth, m_all.label AS pred, true AS seen FROM sl JOIN m_all USING (task_name)
    UNION ALL SELECT sl.task_name, split_name, 'modality_prior_class', category, coalesce(m.label, m_all.label), m.label IS NOT NULL
      FROM sl JOIN m_all USING (task_name) LEFT JOIN m_mod m ON m.task_name = sl.task_name AND m.grp = sl.modality
    UNION ALL SELECT sl.task_name, split_name, 'evidence_grade_prior_class', category, coalesce(m.label, m_all.label), m.label IS NOT NULL
      FROM sl JOIN m_all USING (task_name) LEFT JOIN m_grade m ON m.task_name = sl.task_name AND m.grp = sl.evidence_grade
    UNION ALL SELECT sl.task_name, split_name, 'target_prior_class', category, coalesce(m.label, m_all.label), m.label IS NOT NULL
      FROM sl JOIN m_all USING (task_name) LEFT JOIN m_target m ON m.task_name = sl.task_name AND m.grp = sl.target),
  x AS (SELECT task_name || '~' || split_name || '~' || model AS g, * FROM pr WHERE split_name IN ('validation', 'test')), {_F1}"""


@query(
    "baseline_eval",
    f"""WITH {_BASE} SELECT x.task_name, split_name AS evaluation_split, model AS baseline_model, any_value(train_rows) AS train_rows,
      count(*) AS evaluation_rows, any_value(train_label_count) AS train_label_count, any_value(m_all.label) AS majority_label,
      any_value(m_all.n::DOUBLE / train_rows) AS majority_fraction_train, (count(*) FILTER (truth = pred))::DOUBLE / count(*) AS accuracy,
      any_value(macro_f1) AS macro_f1, (count(*) FILTER (seen))::DOUBLE / count(*) AS coverage
      FROM x JOIN f1 ON f1.g = x.g JOIN tr ON tr.task_name = x.task_name JOIN m_all ON m_all.task_name = x.task_name GROUP BY x.task_name, split_name, model""",
)
def _(spark, sf_dir):
    tables = evidence_tables(spark, sf_dir)
    return metrics.baseline_eval(joins.split_lookup(tables["benchmark_split"], release.release_view(tables)))


@query(
    "majority_label",
    f"WITH {_LOOKUP}, {_majority('modality', 'm')} SELECT task_name, grp AS modality, label AS category, n AS label_rows FROM m",
)
def _(spark, sf_dir):
    tables = evidence_tables(spark, sf_dir)
    rows = joins.split_lookup(tables["benchmark_split"], release.release_view(tables)).filter("split_name = 'train'")
    return windows.majority_label(rows, ["task_name", "modality"], "category", ["entity_table", "entity_id"])


@query(
    "ordinal_group_split",
    f"""WITH {_LOOKUP}, g AS (SELECT task_name, leakage_group, dense_rank() OVER (PARTITION BY task_name ORDER BY leakage_group) AS r FROM sl),
      m AS (SELECT task_name, max(r) AS groups FROM g GROUP BY task_name)
      SELECT sl.task_name, entity_table, entity_id, sl.leakage_group,
        CASE WHEN groups < 2 THEN 'train' WHEN r = 1 THEN 'test' WHEN groups > 2 AND r = 2 THEN 'validation' ELSE 'train' END AS split_name
      FROM sl JOIN (SELECT DISTINCT * FROM g) d USING (task_name, leakage_group) JOIN m USING (task_name)""",
)
def _(spark, sf_dir):
    tables = evidence_tables(spark, sf_dir)
    rows = joins.split_lookup(tables["benchmark_split"], release.release_view(tables))
    return windows.ordinal_group_split(rows.drop("split_name")).select("task_name", "entity_table", "entity_id", "leakage_group", "split_name")


@query(
    "hash_split",
    "SELECT task_name, split_name, count(*) AS n, count(DISTINCT leakage_group) AS leakage_groups FROM benchmark_split GROUP BY task_name, split_name",
)
def _(spark, sf_dir):
    rows = evidence_tables(spark, sf_dir)["benchmark_split"].withColumn("split_name", windows.split_by_hash("leakage_group"))
    return rows.groupBy("task_name", "split_name").agg(F.count("*").alias("n"), F.countDistinct("leakage_group").alias("leakage_groups"))


_SAMPLE = """WITH r AS (SELECT entity_table || ':' || evidence_id AS rid, entity_table || '/' || evidence_grade || '/' || modality AS stratum FROM release_view),
  z AS (SELECT stratum, count(*) AS sz, (SELECT count(*) FROM r) AS total FROM r GROUP BY stratum),
  q AS (SELECT stratum, least(sz, greatest(3, round_even(sz::DOUBLE / total * 250.0, 0)::BIGINT)) AS quota FROM z),
  k AS (SELECT r.*, sha256(stratum || ':' || rid) AS h, row_number() OVER (PARTITION BY stratum ORDER BY sha256(stratum || ':' || rid)) AS rn FROM r),
  c AS (SELECT k.* FROM k JOIN q USING (stratum) WHERE rn <= quota),
  f AS (SELECT rid, stratum, row_number() OVER (ORDER BY sha256('fill:' || rid)) AS rn FROM r WHERE rid NOT IN (SELECT rid FROM c))
  (SELECT rid, stratum FROM c ORDER BY stratum, h LIMIT 250) UNION ALL SELECT rid, stratum FROM f WHERE rn <= 250 - (SELECT count(*) FROM c)"""


@query("stratified_sample", _SAMPLE)
def _(spark, sf_dir):
    view = release.release_view(evidence_tables(spark, sf_dir))
    rows = view.select(
        F.concat_ws(":", "entity_table", F.col("evidence_id").cast("string")).alias("rid"),
        F.concat_ws("/", "entity_table", "evidence_grade", "modality").alias("stratum"),
    )
    return windows.stratified_sample(rows, "stratum", "rid", 250)


_PACKET = """pk AS (SELECT c.id, c.evidence_domain, c.confidence_label, s.publication_year,
    CASE c.confidence_label WHEN 'high_candidate' THEN 300 WHEN 'medium_candidate' THEN 200 WHEN 'low_candidate' THEN 100 ELSE 0 END
      + CASE WHEN coalesce(s.pmcid, '') <> '' THEN 50 ELSE 0 END AS packet_score
  FROM curation_candidate c JOIN source_document s ON s.id = c.source_document_id WHERE c.evidence_domain IN ('toxicity', 'offtarget')),
  rk AS (SELECT *, row_number() OVER (PARTITION BY evidence_domain ORDER BY packet_score DESC, coalesce(publication_year, 0) DESC, id) AS rn FROM pk),
  pass AS (SELECT *, CASE WHEN evidence_domain = 'offtarget' AND rn <= 100 THEN 0 WHEN evidence_domain = 'toxicity' THEN 1 ELSE 2 END AS p FROM rk),
  sel AS (SELECT * FROM pass ORDER BY p, packet_score DESC, coalesce(publication_year, 0) DESC, id LIMIT {target})"""


def _packet_pool(tables):
    source = tables["source_document"].select(F.col("id").alias("source_document_id"), "publication_year", "pmcid")
    return tables["curation_candidate"].join(source, "source_document_id")


@query("quota_select", f"WITH {_PACKET.format(target=700)} SELECT id, evidence_domain, packet_score FROM sel")
def _(spark, sf_dir):
    pool = _packet_pool(evidence_tables(spark, sf_dir))
    return windows.quota_select(pool, target=700, max_offtarget=100).select("id", "evidence_domain", "packet_score")


@query(
    "top_per_domain_dedup",
    """WITH p AS (SELECT c.id AS candidate_id, c.evidence_domain, coalesce(nullif(c.pmid, ''), CAST(c.source_document_id AS VARCHAR)) AS k,
        CASE WHEN contains(lower(s.title), 'thtion') OR contains(lower(s.title), 'attion') THEN 0 ELSE 1 END AS bonus,
        coalesce(s.publication_year, 0) AS y FROM curation_candidate c JOIN source_document s ON s.id = c.source_document_id
        WHERE c.confidence_label = 'high_candidate' AND c.evidence_domain IN ('toxicity', 'offtarget')
          AND (contains(lower(s.title || ' ' || c.candidate_signal), 'sirna') OR contains(lower(s.title || ' ' || c.candidate_signal), 'thtion'))),
      u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY evidence_domain, k ORDER BY bonus, y DESC, candidate_id) AS a FROM p) WHERE a = 1),
      t AS (SELECT *, row_number() OVER (PARTITION BY evidence_domain ORDER BY bonus, y DESC, candidate_id) AS b FROM u)
      SELECT candidate_id, evidence_domain FROM t WHERE b <= 40""",
)
def _(spark, sf_dir):
    tables = evidence_tables(spark, sf_dir)
    source = tables["source_document"].select(F.col("id").alias("source_document_id"), "publication_year", "title")
    pool = (
        tables["curation_candidate"]
        .filter("confidence_label = 'high_candidate' AND evidence_domain IN ('toxicity', 'offtarget')")
        .withColumnRenamed("id", "candidate_id")
        .join(source, "source_document_id")
    )
    return windows.top_per_domain_dedup(pool, 40, ["sirna", "thtion"], ["thtion", "attion"]).select("candidate_id", "evidence_domain")


WEIGHTS = {"thtion": 4, "attion": 3, "ertion": 2, "oument": 1}


def score_sql(text: str) -> str:
    return " + ".join(f"CASE WHEN contains(lower({text}), '{k}') THEN {w} ELSE 0 END" for k, w in WEIGHTS.items())


@query(
    "best_by_score",
    f"""WITH d AS (SELECT doc_id AS ord, source AS pmid, CAST(2015 + doc_id % 10 AS VARCHAR) AS publication_year, {score_sql("text")} AS score FROM documents),
      u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pmid ORDER BY score DESC, ord) AS rn FROM d) WHERE rn = 1)
      SELECT pmid, score, publication_year FROM u ORDER BY score DESC, publication_year DESC, pmid DESC LIMIT 15""",
)
def _(spark, sf_dir):
    docs = raw_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ord"), F.col("source").alias("pmid"), (2015 + F.col("doc_id") % 10).cast("string").alias("publication_year"),
        title_score("text", WEIGHTS).alias("score"),
    )
    return windows.best_by_score(docs, "pmid", "score", 15, "ord").select("pmid", "score", "publication_year")


@query(
    "first_occurrence",
    "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1",
)
def _(spark, sf_dir):
    events = raw_table(spark, sf_dir, "events")
    return windows.first_occurrence(events, "user_id", [F.asc("ts"), F.asc("event_id")]).select("user_id", "event_id", "event_type")


@query(
    "passage_window",
    """SELECT conv_id, turn, concat_ws(' ', lag(text) OVER w, text, lead(text) OVER w) AS window_text FROM conversations
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
)
def _(spark, sf_dir):
    turns = raw_table(spark, sf_dir, "conversations")
    return windows.passage_window(turns, "conv_id", "turn", "text").select("conv_id", "turn", "window_text")
