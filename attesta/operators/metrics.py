"""Agreement, error rates and deterministic baselines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import first_text, strip, text_or_empty

def _label(c: str) -> Column:
    return F.lower(text_or_empty(c))


def _share(condition: Column) -> Column:
    """Share of rows that meet a condition; exact counts, one division."""
    return F.count(F.when(condition, 1)).cast("double") / F.nullif(F.count("*"), F.lit(0)).cast("double")


def cohen_kappa(df: DataFrame, a: str, b: str, labels: tuple[str, ...] = ("accept", "reject")) -> DataFrame:
    """Chance-corrected agreement of two raters; only `labels` count in the chance term."""
    shares = [(_share(_label(a) == x), _share(_label(b) == x)) for x in labels]
    stats = df.agg(
        F.count("*").alias("n"),
        _share(_label(a) == _label(b)).alias("observed"),
        reduce(lambda x, y: x + y, [p * q for p, q in shares]).alias("expected"),
    )
    kappa = F.when(F.col("expected") < 1, (F.col("observed") - F.col("expected")) / (F.lit(1.0) - F.col("expected")))
    return stats.select("n", kappa.alias("kappa"))


def raw_agreement(df: DataFrame, a: str, b: str, labels: tuple[str, ...] = ("accept", "reject")) -> DataFrame:
    """Share of equal decisions among rows both raters decided; claimable only when that is every row."""
    both = _label(a).isin(*labels) & _label(b).isin(*labels)
    stats = df.agg(
        F.count("*").alias("sample_rows"),
        F.count(F.when(text_or_empty(b) != "", 1)).alias("reviewed_rows"),
        F.count(F.when(both, 1)).alias("comparable_rows"),
        F.count(F.when(both & (_label(a) == _label(b)), 1)).alias("_equal"),
    )
    agreement = F.col("_equal").cast("double") / F.nullif(F.col("comparable_rows"), F.lit(0)).cast("double")
    claimable = (F.col("comparable_rows") >= F.col("sample_rows")) & agreement.isNotNull()
    return stats.select(
        "sample_rows", "reviewed_rows", "comparable_rows", agreement.alias("agreement"),
        F.when(claimable, "claimable").otherwise("not_claimable").alias("claim_status"),
    )


def wilson(k: Column, n: Column, z: float) -> tuple[Column, Column]:
    """Lower and upper Wilson score bound of k/n."""
    n = n.cast("double")
    p = k.cast("double") / n
    center = p + F.lit(z * z) / (n * 2)
    spread = F.sqrt(p * (F.lit(1.0) - p) / n + F.lit(z * z / 4) / (n * n)) * F.lit(z)
    scale = F.lit(1.0) + F.lit(z * z) / n
    return (center - spread) / scale, (center + spread) / scale


def false_accept_rate(df: DataFrame, first: str, second: str, z: float = 1.96) -> DataFrame:
    """Rejects by the second decision among the accepts of the first, with the Wilson interval."""
    accepted = _label(first) == "accept"
    counts = df.agg(
        F.count(F.when(accepted, 1)).alias("accepts"),
        F.count(F.when(accepted & (_label(second) == "reject"), 1)).alias("false_accepts"),
    )
    n = F.nullif("accepts", F.lit(0))
    low, high = wilson(F.col("false_accepts"), n, z)
    rate = F.col("false_accepts").cast("double") / n.cast("double")
    return counts.select("accepts", "false_accepts", rate.alias("rate"), low.alias("ci_low"), high.alias("ci_high"))


def accuracy(df: DataFrame, truth: str, pred: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(_share(F.col(truth) == F.col(pred)).alias("accuracy"))


def macro_f1(df: DataFrame, truth: str, pred: str, by: list[str], weight: str | None = None) -> DataFrame:
    """Mean F1 over the labels that occur as truth or prediction; a label never hit scores 0.

    Each row becomes at most two (label, hit) rows, which are summed before the shuffle. `weight` names
    a column of row counts when the input is already a confusion table.
    """
    one, zero = (F.col(weight) if weight else F.lit(1)).cast("bigint"), F.lit(0).cast("bigint")

    def part(label: str, tp: Column, err: Column) -> Column:
        return F.struct(F.col(label).alias("label"), tp.alias("tp"), err.alias("err"))

    parts = F.when(F.col(truth) == F.col(pred), F.array(part(truth, one, zero))).otherwise(
        F.array(part(truth, zero, one), part(pred, zero, one))
    )
    per_label = (
        df.select(*by, F.inline(parts)).groupBy(*by, "label").agg(F.sum("tp").alias("tp"), F.sum("err").alias("err"))
    )
    f1 = F.col("tp") * 2.0 / (F.col("tp") * 2 + F.col("err"))
    # A decimal sum does not depend on the order in which labels arrive.
    return per_label.groupBy(*by).agg(
        (F.sum(f1.cast("decimal(38,18)")).cast("double") / F.count("*").cast("double")).alias("macro_f1")
    )


MAJORITY = "train_majority_class"
PRIORS = {
    "modality_prior_class": "modality",
    "evidence_grade_prior_class": "evidence_grade",
    "target_prior_class": "target_gene_symbol",
}  # fixed values: model name -> grouping column
FIRST_SEEN = ["entity_table", "entity_id"]


def baseline_eval(rows: DataFrame, priors: dict[str, str] = PRIORS, label: str = "category", order: list[str] = FIRST_SEEN) -> DataFrame:
    """Majority and group-prior baselines per task on the validation and test splits.

    `rows` are split rows enriched with the release (`split_lookup`). Every row is exploded once per
    model into (model, group value), so all models train in one aggregation and are evaluated in one
    join; the scores are then read off the small confusion table.
    """
    groups = [F.struct(F.lit(MAJORITY).alias("baseline_model"), F.lit("").alias("_group"))]
    groups += [
        F.struct(F.lit(model).alias("baseline_model"), first_text(strip(text_or_empty(g)), default="unknown").alias("_group"))
        for model, g in priors.items()
    ]
    known = rows.select(
        "task_name", "split_name", first_text(label, default="unknown").alias("_label"), *order, F.inline(F.array(*groups))
    )
    key = ["task_name", "baseline_model", "_group"]
    counts = (
        known.filter("split_name = 'train'")
        .groupBy(*key, "_label")
        .agg(F.count("*").alias("_n"), F.min(F.struct(*order)).alias("_first"))
    )
    trained = counts.groupBy(*key).agg(
        F.min(F.struct((-F.col("_n")).alias("n"), "_first", "_label")).alias("_best"),
        F.sum("_n").alias("train_rows"),
        F.count("*").alias("train_label_count"),
    )
    # Picked by a conditional maximum, not a filter: the training aggregate stays one shared subplan.
    whole = F.struct("train_rows", "train_label_count", "_best")
    overall = (
        trained.groupBy("task_name")
        .agg(F.max(F.when(F.col("baseline_model") == MAJORITY, whole)).alias("_w"))
        .filter("_w IS NOT NULL")
        .select(
            "task_name", "_w.train_rows", "_w.train_label_count", F.col("_w._best._label").alias("majority_label"),
            (-F.col("_w._best.n")).alias("_majority_rows"),
        )
    )
    by = ["task_name", "split_name", "baseline_model"]
    confusion = (
        known.filter(F.col("split_name").isin("validation", "test"))
        # Counted before the join: a group value shared by very many rows meets its prior once.
        .groupBy(*by, "_group", "_label")
        .agg(F.count("*").alias("_n"))
        .join(trained.select(*key, F.col("_best._label").alias("_prior")), key, "left")
        .groupBy(*by, "_label", "_prior")
        .agg(F.sum("_n").alias("_n"))
        .join(overall, "task_name")
        .withColumn("_pred", F.coalesce("_prior", "majority_label"))
    )

    def share(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("_n")).otherwise(0)).cast("double") / F.sum("_n").cast("double")

    constants = ["train_rows", "train_label_count", "majority_label", "_majority_rows"]
    scores = confusion.groupBy(*by, *constants).agg(
        F.sum("_n").alias("evaluation_rows"),
        share(F.col("_label") == F.col("_pred")).alias("accuracy"),
        share(F.col("_prior").isNotNull()).alias("coverage"),
    )
    return scores.join(macro_f1(confusion, "_label", "_pred", by, weight="_n"), by).select(
        "task_name", F.col("split_name").alias("evaluation_split"), "baseline_model", "train_rows", "evaluation_rows",
        "train_label_count", "majority_label",
        (F.col("_majority_rows").cast("double") / F.col("train_rows").cast("double")).alias("majority_fraction_train"),
        "accuracy", "macro_f1", "coverage",
    )
