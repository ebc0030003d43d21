"""Ranking and threshold metrics over a prediction table.

Every function takes the target and score columns and a list ``by``; the empty list
gives pooled metrics, and fold, model or slice columns give one row per group. Rows
are first reduced to one row per distinct score, so a score shared by a third of all
rows becomes a single row, and the cumulative counts run through nested score blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import ratio_or_null, ratio_or_zero
from .prefix import running_totals, value_blocks

GRID = tuple(0.05 + 0.05 * i for i in range(19))  # fixed values .05, .10 .. .95
REVIEW_THRESHOLDS = (0.20, 0.30, 0.40, 0.50, 0.60, 0.70)  # fixed values
FIXED_THRESHOLDS = (0.40, 0.50)  # fixed values
MINIMUM_RECALL = 0.60  # fixed value


def validated(predictions: DataFrame, target: str, score: str) -> DataFrame:
    """The predictions, refusing missing or non-binary targets and scores outside [0, 1].

    The check travels with the target column, so it needs no pass of its own.
    """
    y, p = F.col(target), F.col(score)
    bad = (
        y.isNull() | p.isNull() | F.isnan(p.cast("double")) | (p < 0) | (p > 1) | ~y.isin(0, 1)
    )
    message = F.lit("predictions need a 0/1 target and a score within [0, 1]")
    return predictions.withColumn(
        target, F.when(bad, F.raise_error(message).cast("int")).otherwise(y.cast("int"))
    )


def score_counts(predictions: DataFrame, target: str, score: str, by: list[str]) -> DataFrame:
    """Rows and positives per distinct score of each group."""
    return (
        predictions.groupBy(*by, F.col(score).alias("score"))
        .agg(F.count("*").alias("n"), F.sum(F.col(target)).alias("pos"))
        .withColumn("neg", F.col("n") - F.col("pos"))
    )


def cumulative_counts(counts: DataFrame, by: list[str]) -> DataFrame:
    """Add counts of rows with a strictly higher score (``pos_before``, ``neg_before``)."""
    blocked = counts.withColumns({"low": F.lit(0.0), "high": F.lit(1.0)}).withColumns(
        value_blocks("score", "low", "high")
    )
    return running_totals(
        blocked.drop("low", "high"), by, ["block", "subblock"], ["score"], ["pos", "neg"], descending=True
    )


def ranking_metrics(predictions: DataFrame, target: str, score: str, by: list[str]) -> DataFrame:
    """ROC-AUC (ties count half), average precision and its lift over prevalence.

    Average precision is the step sum of recall gains times precision, at distinct
    scores. Groups with a single class get null metrics.
    """
    ranked = cumulative_counts(score_counts(predictions, target, score, by), by)
    # Products of two counts outgrow a 64-bit integer long before a sum does.
    pos_here, neg_here = F.col("pos").cast("double"), F.col("neg").cast("double")
    flagged_pos = F.col("pos_before") + F.col("pos")
    flagged = flagged_pos + F.col("neg_before") + F.col("neg")
    # Negatives below a positive win; negatives at the same score win half.
    wins = neg_here * F.col("pos_before") + neg_here * pos_here / 2
    total = ranked.groupBy(*by).agg(
        F.sum("n").alias("observations"),
        F.sum("pos").alias("events"),
        F.sum(wins).alias("wins"),
        F.sum(pos_here * flagged_pos / flagged).alias("gain"),
    )
    pos = F.col("events")
    neg = F.col("observations") - pos
    both = (pos > 0) & (neg > 0)
    precision = F.when(both, F.col("gain") / pos)
    return total.select(
        *by, "observations", "events",
        F.round(pos / F.col("observations"), 6).alias("event_rate"),
        F.round(F.when(both, F.col("wins") / (pos.cast("double") * neg)), 6).alias("roc_auc"),
        F.round(precision, 6).alias("pr_auc"),
        F.round(precision / (pos / F.col("observations")), 6).alias("pr_auc_lift"),
        F.when(both, "DEFINED").otherwise("N/A_SINGLE_CLASS").alias("metric_status"),
    )


def confusion_columns(target: str, score: str, threshold: float, suffix: str = "") -> list[Column]:
    """tn, fp, fn, tp aggregates at one threshold."""
    y, flag = F.col(target), F.col(score) >= threshold
    return [
        F.count_if((y == 0) & ~flag).alias("tn" + suffix),
        F.count_if((y == 0) & flag).alias("fp" + suffix),
        F.count_if((y == 1) & ~flag).alias("fn" + suffix),
        F.count_if((y == 1) & flag).alias("tp" + suffix),
    ]


def rate_columns(suffix: str = "") -> dict[str, Column]:
    """Precision, recall, F1 (zero when undefined) and FPR from tn/fp/fn/tp columns."""
    tp, fp, fn, tn = (F.col(c + suffix) for c in ("tp", "fp", "fn", "tn"))
    return {
        "precision" + suffix: ratio_or_zero(tp, tp + fp),
        "recall" + suffix: ratio_or_zero(tp, tp + fn),
        "f1" + suffix: ratio_or_zero(2 * tp, 2 * tp + fp + fn),
        "false_positive_rate" + suffix: ratio_or_null(fp, fp + tn),
    }


def rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column."""
    doubles = [f.name for f in frame.schema.fields if f.dataType.typeName() == "double"]
    return frame.withColumns({c: F.round(c, digits) for c in doubles})


def at_thresholds(
    predictions: DataFrame, target: str, score: str, by: list[str], thresholds=FIXED_THRESHOLDS
) -> DataFrame:
    """One row per group and threshold with the confusion counts and rates.

    All thresholds are counted in a single aggregation and unpivoted afterwards; the
    rows are never multiplied by the grid.
    """
    counts = predictions.groupBy(*by).agg(
        *[c for i, t in enumerate(thresholds) for c in confusion_columns(target, score, t, f"__{i}")]
    )
    per_threshold = F.array(
        *[
            F.struct(
                F.lit(float(t)).alias("threshold"),
                *[F.col(f"{c}__{i}").alias(c) for c in ("tn", "fp", "fn", "tp")],
            )
            for i, t in enumerate(thresholds)
        ]
    )
    return (
        counts.select(*by, F.explode(per_threshold).alias("t"))
        .select(*by, "t.*")
        .withColumns(rate_columns())
    )


def threshold_table(predictions: DataFrame, target: str, score: str, by: list[str]) -> DataFrame:
    """Precision, recall, F1 and FPR at the six review thresholds."""
    table = at_thresholds(predictions, target, score, by, REVIEW_THRESHOLDS)
    return rounded(table.select(*by, "threshold", "precision", "recall", "f1", "false_positive_rate"))


def choose_threshold(predictions: DataFrame, target: str, score: str, by: list[str]) -> DataFrame:
    """Best grid threshold per group.

    Thresholds reaching the minimum recall are preferred; then higher F1, recall and
    precision, then the lower threshold.
    """
    table = at_thresholds(predictions, target, score, by, GRID)
    preference = F.struct(
        F.col("recall") >= MINIMUM_RECALL, F.col("f1"), F.col("recall"), F.col("precision"),
        -F.col("threshold"),
    )
    chosen = table.groupBy(*by).agg(
        F.max_by(F.struct("threshold", "precision", "recall", "f1"), preference).alias("best")
    )
    return rounded(chosen.select(*by, "best.*")).withColumn("threshold", F.round("threshold", 2))


def classification_report(
    predictions: DataFrame, target: str, score: str, by: list[str]
) -> DataFrame:
    """Ranking metrics, Brier score, mean prediction and fixed-threshold metrics per group."""
    ranking = ranking_metrics(predictions, target, score, by)
    y, p = F.col(target), F.col(score)
    basics = predictions.groupBy(*by).agg(
        F.round(F.avg((p - y) * (p - y)), 6).alias("brier"),
        F.round(F.avg(p), 6).alias("mean_prediction"),
        *[c for t in FIXED_THRESHOLDS for c in confusion_columns(target, score, t, f"_at_{round(t * 100)}")],
    )
    for t in FIXED_THRESHOLDS:
        basics = basics.withColumns(rate_columns(f"_at_{round(t * 100)}"))
    if not by:
        one = F.lit(1).alias("k")
        return rounded(ranking.select("*", one).join(basics.select("*", one), "k").drop("k"))
    return rounded(ranking.join(basics, by))


def monthly_target_distribution(labelled: DataFrame, target: str) -> DataFrame:
    """Eligible and positive rows, rate and entities per prediction month."""
    return labelled.groupBy("prediction_month").agg(
        F.count("*").alias("eligible_rows"),
        F.sum(target).alias("positive_rows"),
        F.round(F.avg(target), 6).alias("positive_rate"),
        F.countDistinct("identity_key").alias("projects"),
    )


def month_views(
    predictions: DataFrame, target: str, score: str, views: dict[str, list[str]]
) -> DataFrame:
    """Metrics of the same scores on several month subsets.

    A row is copied only into the views that list its month, so each view is one group
    of a single aggregation.
    """
    names = F.array(
        *[F.when(F.col("prediction_month").isin(*months), F.lit(name)) for name, months in views.items()]
    )
    tagged = predictions.withColumn("view", F.explode(F.filter(names, lambda n: n.isNotNull())))
    return classification_report(tagged, target, score, ["view"])
