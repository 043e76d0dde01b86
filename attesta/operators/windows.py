"""First, best and newest rows per key, and samples per stratum.

Every "first n per key" is a `row_number` filter. Spark keeps only the n best rows per key and input
partition before the shuffle, so one hot key does not send all its rows to one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.text import GRADE_RANK, ColumnOrName, as_col, has_text, text_or_empty
from attesta.session import store


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank_col: str | None = None) -> DataFrame:
    """The first n rows per key; `rank_col` keeps the position under that name."""
    name = rank_col or "_rn"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return ranked if rank_col else ranked.drop(name)


def first_occurrence(df: DataFrame, key: str | list[str], order: list[Column]) -> DataFrame:
    """Keep the first row per key."""
    return top_per_group(df, [key] if isinstance(key, str) else key, order, 1)


def latest_accept_audit(audit: DataFrame) -> DataFrame:
    """The newest verified accept per released entity; the higher id wins equal times.

    The two columns that the filter fixes are left out of the sorted rows and written again after.
    """
    fixed = {"validation_status": "curator_verified", "curator_decision": "accept"}
    accepted = audit.filter("validation_status = 'curator_verified' AND curator_decision = 'accept'").drop(*fixed)
    newest = first_occurrence(accepted, ["entity_table", "entity_id"], [F.desc("audited_at"), F.desc("id")])
    return newest.withColumns({c: F.lit(v) for c, v in fixed.items()}).select(*audit.columns)


def latest_status_by_curator(audit: DataFrame, curator_id: str) -> DataFrame:
    """One curator's newest row per entity; the earlier row wins equal times."""
    mine = audit.filter(F.col("curator_id") == curator_id)
    return first_occurrence(mine, ["entity_table", "entity_id"], [F.desc("audited_at"), F.asc("id")]).select(
        "entity_table", "entity_id", "validation_status", "curator_decision", "audited_at"
    )


def split_by_hash(group: ColumnOrName) -> Column:
    """Leakage-safe split of a group key: below 70 train, below 85 validation, else test."""
    from attesta.functions.text import hash_bucket

    bucket = hash_bucket(group)
    return F.when(bucket < 70, "train").when(bucket < 85, "validation").otherwise("test")


def ordinal_group_split(rows: DataFrame, task: str = "task_name", group: str = "leakage_group") -> DataFrame:
    """Per task: first group in order is test, second is validation if there are more than two, the rest train.

    Only the two smallest group keys per task are needed, so groups are first reduced to one row each and
    no window ever spans the fact rows.
    """
    groups = rows.select(task, group).distinct()
    sizes = groups.groupBy(task).agg(F.count("*").alias("_groups"))
    firsts = (
        top_per_group(groups, [task], [F.asc(group)], 2, rank_col="_rank")
        .groupBy(task)
        .agg(
            F.max(F.when(F.col("_rank") == 1, F.col(group))).alias("_first"),
            F.max(F.when(F.col("_rank") == 2, F.col(group))).alias("_second"),
        )
    )
    key = F.col(group)
    split = (
        F.when(F.col("_groups") < 2, "train")
        .when(key == F.col("_first"), "test")
        .when((F.col("_groups") > 2) & (key == F.col("_second")), "validation")
        .otherwise("train")
    )
    # One row per task, kept so that Spark knows its size: the few tasks are hot keys, rows must not be shuffled by them.
    edges = store(sizes.join(firsts, task))
    return rows.join(edges, task).withColumn("split_name", split).drop("_groups", "_first", "_second")


def majority_label(train: DataFrame, by: list[str], label: str, order: list[str]) -> DataFrame:
    """Most frequent label per group with its count; the label seen first in `order` wins ties."""
    counts = train.groupBy(*by, label).agg(
        F.count("*").alias("label_rows"), F.min(F.struct(*order)).alias("_first_seen")
    )
    return top_per_group(counts, by, [F.desc("label_rows"), F.asc("_first_seen")]).drop("_first_seen")


def stratified_sample(df: DataFrame, stratum: str, id_col: str, target: int, minimum: int = 3) -> DataFrame:
    """Deterministic sample of `target` rows, every stratum represented.

    Per stratum the order is sha256 of `stratum:id` and the quota is
    min(size, max(minimum, round_half_even(size / total * target))). A shortfall is filled by sha256 of
    `fill:id` over the rest; a surplus is cut in stratum-key order. Ranks past the quota are never
    needed, so all rankings stop at `target` rows per stratum.
    """
    key, row_id = text_or_empty(stratum), as_col(id_col).cast("string")
    sizes = df.groupBy(F.col(stratum).alias("_s")).agg(F.count("*").alias("_size"))
    total = sizes.agg(F.sum("_size")).scalar()
    quotas = sizes.withColumn(
        "_quota",
        F.least(
            F.col("_size"),
            F.greatest(F.lit(minimum), F.bround(F.col("_size") / total * F.lit(float(target)), 0).cast("bigint")),
        ),
    )
    hashed = df.withColumn("_h", F.sha2(F.concat(key, F.lit(":"), row_id), 256))
    ranked = top_per_group(hashed, [stratum], [F.asc("_h"), F.asc(id_col)], target, rank_col="_rn").join(
        quotas, F.col(stratum).eqNullSafe(F.col("_s"))
    )
    chosen = ranked.filter(F.col("_rn") <= F.col("_quota"))
    # At most `target` rows per stratum are chosen; the running order is by (stratum, hash).
    running = chosen.orderBy(F.asc(stratum), F.asc("_h"), F.asc(id_col)).limit(target)
    picked = running.select(*df.columns)
    chosen_ids = chosen.select(F.col(id_col).alias("_id"))
    shortfall = F.greatest(F.lit(target) - chosen.agg(F.count("*")).scalar(), F.lit(0))
    rest = df.join(chosen_ids, F.col(id_col) == F.col("_id"), "left_anti").withColumn(
        "_f", F.sha2(F.concat(F.lit("fill:"), row_id), 256)
    )
    best_rest = rest.orderBy(F.asc("_f"), F.asc(id_col)).limit(target)
    # `best_rest` holds at most `target` rows, so one small global ranking is enough here.
    filled = (
        best_rest.withColumn("_rn", F.row_number().over(Window.orderBy(F.asc("_f"), F.asc(id_col))))
        .filter(F.col("_rn") <= shortfall)
        .select(*df.columns)
    )
    return picked.unionByName(filled)


# Review ranking of the packet, 300/200/100 by confidence plus 50 for a full-text identifier.
PACKET_CONFIDENCE_SCORE = {"high_candidate": 300, "medium_candidate": 200, "low_candidate": 100}
PACKET_FULL_TEXT_BONUS = 50


def packet_score() -> Column:
    score = F.lit(0)
    for label, points in PACKET_CONFIDENCE_SCORE.items():
        score = F.when(F.col("confidence_label") == label, points).otherwise(score)
    return score + F.when(has_text("pmcid"), PACKET_FULL_TEXT_BONUS).otherwise(0)


def quota_select(df: DataFrame, target: int = 3000, max_offtarget: int = 1000) -> DataFrame:
    """Best off-target rows up to their quota, then toxicity, then the best of the rest, up to `target`."""
    order = [F.desc("packet_score"), F.desc(F.coalesce("publication_year", F.lit(0))), F.asc("id")]
    scored = df.filter(F.col("evidence_domain").isin("toxicity", "offtarget")).withColumn("packet_score", packet_score())
    best = reduce(
        DataFrame.unionByName,
        [scored.filter(F.col("evidence_domain") == d).orderBy(*order).limit(target) for d in ("offtarget", "toxicity")],
    )
    # At most 2 * target rows are left, so the quota arithmetic runs on a bounded set.
    ranked = best.withColumn("_rn", F.row_number().over(Window.partitionBy("evidence_domain").orderBy(*order)))
    offtarget = (F.col("evidence_domain") == "offtarget") & (F.col("_rn") <= min(max_offtarget, target))
    tagged = ranked.withColumn("_first_pass", F.when(offtarget, 0).when(F.col("evidence_domain") == "toxicity", 1).otherwise(2))
    return tagged.orderBy(F.asc("_first_pass"), *order).limit(target).drop("_first_pass", "_rn")


def top_per_domain_dedup(df: DataFrame, n: int, required_terms: list[str], bonus_terms: list[str]) -> DataFrame:
    """Per domain the first n sources: one row per pmid (or source), by title bonus, year, id.

    Only rows whose title or signal holds a required term compete.
    """
    from attesta.functions.text import contains_any

    text = F.concat_ws(" ", text_or_empty("title"), text_or_empty("candidate_signal"))
    order = [
        F.asc(F.when(contains_any("title", bonus_terms), 0).otherwise(1)),
        F.desc(F.coalesce("publication_year", F.lit(0))),
        F.asc("candidate_id"),
    ]
    pool = df.filter(contains_any(text, required_terms)).withColumn(
        "_key", F.coalesce(F.nullif("pmid", F.lit("")), F.col("source_document_id").cast("string"))
    )
    unique = first_occurrence(pool, ["evidence_domain", "_key"], order)
    return top_per_group(unique, ["evidence_domain"], order, n).drop("_key")


def best_by_score(df: DataFrame, key: str, score: str, n: int, arrival: str) -> DataFrame:
    """Best record per key (the earlier one keeps equal scores), then the n best by score, year, key."""
    unique = first_occurrence(df, key, [F.desc(score), F.asc(arrival)])
    return unique.orderBy(F.desc(score), F.desc("publication_year"), F.desc(key)).limit(n)


#: Consecutive passages of a document that are put in order together.
PASSAGES = 64


def passage_window(anchors: DataFrame, doc: str = "page_id", position: str = "position", text: str = "text") -> DataFrame:
    """Previous, own and next passage of a document as one text; positions are consecutive.

    Passages are put in order by (document, stretch of positions), and those at the ends of a stretch are sent to the
    neighbouring one too. So a document with very many passages is spread over all tasks, which a window over the document
    would not do, and nearly every passage is sent once.
    """
    at = F.col(position)
    stretch = F.floor(at / PASSAGES)
    last = F.pmod(at, F.lit(PASSAGES)) == PASSAGES - 1
    own = F.struct(stretch.alias("_in"), F.lit(True).alias("_own"))
    beside = F.struct(F.when(last, stretch + 1).otherwise(stretch - 1).alias("_in"), F.lit(False).alias("_own"))
    at_end = last | (F.pmod(at, F.lit(PASSAGES)) == 0)
    placed = anchors.withColumn("_place", F.explode(F.when(at_end, F.array(own, beside)).otherwise(F.array(own)))).select(*anchors.columns, "_place.*")
    order = Window.partitionBy(doc, "_in").orderBy(position)

    def neighbour(shift: int) -> Column:
        return F.when(F.lag(position, shift).over(order) == at - shift, F.lag(text, shift).over(order))

    near = placed.withColumns({"_before": neighbour(1), "_after": neighbour(-1)}).filter("_own")
    return near.withColumn("window_text", F.concat_ws(" ", "_before", F.col(text), "_after")).select(*anchors.columns, "window_text")


def grade_rank(c: ColumnOrName = "evidence_grade") -> Column:
    from attesta.functions.text import rank_of

    return rank_of(c, GRADE_RANK, 0)
