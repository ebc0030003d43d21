"""Error slices: bands, support rules, slice tables and model comparison per slice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import ratio_or_null, ratio_or_zero, right_closed_band
from .metrics import confusion_columns, ranking_metrics, rate_columns

# Right-closed band bounds and labels.
PROGRESS_BAND = ([25, 50, 75], ["<=25", "25-50", "50-75", ">75"])
AGE_BAND = ([36, 84, 144], ["<=3y", "3-7y", "7-12y", ">12y"])
SPEND_RATIO_BAND = ([0.25, 0.5, 0.75, 1], ["<=.25", ".25-.50", ".50-.75", ".75-1", ">1"])
EXPENDITURE_BAND = ([100, 500, 1000], ["<=100", "100-500", "500-1000", ">1000"])
GROUPED_SECTOR = "Roads & Highways"

# Slice fields of the audit and robustness tables, and the named slices.
AUDIT_FIELDS = (
    "prediction_month", "progress_range", "roads_group", "sector",
    "ministry", "agency", "age_range", "cost_ratio_range",
)
ROBUSTNESS_FIELDS = (
    "sector", "state", "progress_range", "age_range", "cost_ratio_range", "prediction_month",
)
IMPORTANT_SLICES = {
    "Electricity Generation": ("sector", "Electricity Generation"),
    "Ministry of Power": ("ministry", "Ministry of Power"),
    "Education": ("sector", "Education"),
    "Railways": ("sector", "Railways"),
    "Roads & Highways": ("sector", "Roads & Highways"),
}
NEGLIGIBLE = 0.005  # fixed value
SEVERE = 0.05  # fixed value


def with_slice_fields(predictions: DataFrame, grouped_sector: str = GROUPED_SECTOR) -> DataFrame:
    """Add the banded slice columns."""
    return predictions.withColumns(
        {
            "progress_range": right_closed_band(F.col("progress_current"), *PROGRESS_BAND),
            "roads_group": F.when(F.col("sector") == grouped_sector, grouped_sector).otherwise(
                "Other sectors"
            ),
            "age_range": right_closed_band(F.col("project_age_months"), *AGE_BAND),
            "cost_ratio_range": right_closed_band(F.col("expenditure_to_original_cost"), *SPEND_RATIO_BAND),
        }
    )


def expenditure_band(value: Column) -> Column:
    """Cumulative expenditure band."""
    return right_closed_band(value, *EXPENDITURE_BAND)


def support_status(
    rows: Column, entities: Column, events: Column, minimum_events: int = 20
) -> Column:
    """ADEQUATE with >=50 rows, >=25 entities and enough events and non-events."""
    adequate = (
        (rows >= 50) & (entities >= 25) & (events >= minimum_events) & (rows - events >= minimum_events)
    )
    return F.when(adequate, "ADEQUATE").otherwise("INSUFFICIENT_SAMPLE")


def slice_rows(frame: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Long form: each row once per slice field, missing values kept as 'nan'."""
    pairs = F.array(
        *[
            F.struct(
                F.lit(f).alias("slice_feature"),
                F.coalesce(F.col(f).cast("string"), F.lit("nan")).alias("slice_value"),
            )
            for f in fields
        ]
    )
    return frame.withColumn("s", F.explode(pairs)).withColumns(
        {"slice_feature": F.col("s.slice_feature"), "slice_value": F.col("s.slice_value")}
    ).drop("s")


def named_slice_rows(frame: DataFrame, slices=IMPORTANT_SLICES) -> DataFrame:
    """Rows of each named slice; a slice without rows keeps one row of nulls."""
    names = F.array(
        *[
            F.struct(
                F.lit(label).alias("important_slice"), F.lit(field).alias("slice_feature"),
                F.lit(value).alias("slice_value"),
                F.coalesce(F.col(field) == value, F.lit(False)).alias("member"),
            )
            for label, (field, value) in slices.items()
        ]
    )
    members = (
        frame.withColumn("s", F.explode(F.filter(names, lambda s: s["member"])))
        .withColumns({c: F.col(f"s.{c}") for c in ("important_slice", "slice_feature", "slice_value")})
        .drop("s")
    )
    spark = frame.sparkSession
    wanted = spark.createDataFrame(
        [(label, field, value) for label, (field, value) in slices.items()],
        "important_slice string, slice_feature string, slice_value string",
    )
    # A slice without members is one row of nulls; the members themselves are not shuffled.
    present = members.select("important_slice").distinct()
    missing = wanted.join(present, "important_slice", "left_anti")
    return members.unionByName(missing, allowMissingColumns=True)


def _entity_level(rows: DataFrame, keys: list[str], target: str, score: str, threshold: float) -> DataFrame:
    """Counts per slice and entity, so a hot slice is pre-aggregated before entity counts."""
    return rows.groupBy(*keys, "identity_key").agg(
        F.count("*").alias("n"), *confusion_columns(target, score, threshold)
    )


def robustness_slices(
    predictions: DataFrame, target: str, score: str, threshold: float,
    fields: tuple[str, ...] = ROBUSTNESS_FIELDS,
) -> DataFrame:
    """Per slice: confusion counts, FPR, FNR, error rate and entity exposure."""
    keys = ["slice_feature", "slice_value"]
    rows = slice_rows(with_slice_fields(predictions), fields)
    errors = F.col("fp") + F.col("fn")
    counted = _entity_level(rows, keys, target, score, threshold).groupBy(*keys).agg(
        F.sum("n").alias("rows"),
        F.count("*").alias("unique_projects"),
        (F.sum("tp") + F.sum("fn")).alias("positive_rows"),
        (F.sum("tn") + F.sum("fp")).alias("negative_rows"),
        F.sum("tp").alias("true_positives"),
        F.sum("tn").alias("true_negatives"),
        F.sum("fp").alias("false_positives"),
        F.sum("fn").alias("false_negatives"),
        F.sum(errors).alias("error_count"),
        F.count_if(errors > 0).alias("projects_with_error"),
    )
    return counted.withColumns(
        {
            "false_positive_rate": F.round(ratio_or_null(F.col("false_positives"), F.col("negative_rows")), 6),
            "false_negative_rate": F.round(ratio_or_null(F.col("false_negatives"), F.col("positive_rows")), 6),
            "error_rate": F.round(F.col("error_count") / F.col("rows"), 6),
            "project_error_exposure": F.round(F.col("projects_with_error") / F.col("unique_projects"), 6),
            "sample_status": support_status(
                F.col("rows"), F.col("unique_projects"), F.col("positive_rows"), 30
            ),
        }
    )


def audit_slices(
    predictions: DataFrame, target: str, score: str, threshold: float = 0.40,
    fields: tuple[str, ...] = AUDIT_FIELDS,
) -> DataFrame:
    """Per slice: event rate, AUC, precision and recall at .40, error counts and support."""
    keys = ["slice_feature", "slice_value"]
    rows = slice_rows(with_slice_fields(predictions), fields)
    tn, fp, fn, tp = (F.sum(c) for c in ("tn", "fp", "fn", "tp"))
    counted = _entity_level(rows, keys, target, score, threshold).groupBy(*keys).agg(
        F.sum("n").alias("rows"),
        F.count("*").alias("projects"),
        (tp + fn).alias("positive_rows"),
        F.round(ratio_or_zero(tp, tp + fp), 6).alias("precision_at_40"),
        F.round(ratio_or_zero(tp, tp + fn), 6).alias("recall_at_40"),
        fp.alias("false_positives"),
        fn.alias("false_negatives"),
        F.round((fp + fn) / F.sum("n"), 6).alias("error_rate"),
    )
    ranking = ranking_metrics(rows, target, score, keys).select(*keys, "event_rate", "roc_auc")
    return (
        counted.join(ranking, keys)
        .withColumn(
            "sample_status", support_status(F.col("rows"), F.col("projects"), F.col("positive_rows"))
        )
        .drop("positive_rows")
    )


def confident_errors(
    predictions: DataFrame, target: str, score: str, by: list[str],
    threshold: float = 0.40, top: int = 10,
) -> DataFrame:
    """The most confident false positives and false negatives of each group (top-k)."""
    y, p = F.col(target), F.col(score)
    wrong = predictions.withColumn(
        "error_type",
        F.when((y == 0) & (p >= threshold), "FALSE_POSITIVE").when(
            (y == 1) & (p < threshold), "FALSE_NEGATIVE"
        ),
    ).where(F.col("error_type").isNotNull())
    ranked = wrong.withColumn(
        "confidence_mistake", F.when(F.col("error_type") == "FALSE_POSITIVE", p).otherwise(1 - p)
    )
    # row_number with a constant bound is cut per task before the shuffle.
    order = Window.partitionBy(*by, "error_type").orderBy(
        F.desc("confidence_mistake"), "prediction_month", "identity_key"
    )
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def largest_error_groups(
    predictions: DataFrame, target: str, score: str, threshold: float,
    fields: tuple[str, ...] = ("sector", "state", "age_range", "progress_range", "expenditure_range"),
    top: int = 5,
) -> DataFrame:
    """The (value, error type) groups with the most errors per field (top-k)."""
    y, flag = F.col(target), F.col(score) >= threshold
    wrong = with_slice_fields(predictions).withColumns(
        {
            "expenditure_range": expenditure_band(F.col("expenditure_current")),
            "error_type": F.when((y == 0) & flag, "false_positive").when((y == 1) & ~flag, "false_negative"),
        }
    ).where(F.col("error_type").isNotNull())
    pairs = F.filter(
        F.array(
            *[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]
        ),
        lambda x: x["value"].isNotNull(),
    )
    counted = (
        wrong.select("error_type", F.explode(pairs).alias("p"))
        .groupBy("p.field", "p.value", "error_type")
        .agg(F.count("*").alias("errors"))
    )
    order = Window.partitionBy("field").orderBy(F.desc("errors"), "value", "error_type")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def error_totals(predictions: DataFrame, target: str, score: str) -> DataFrame:
    """Confusion counts per model and fixed threshold."""
    from .metrics import at_thresholds

    table = at_thresholds(predictions, target, score, ["model"])
    return table.select(
        "model", "threshold",
        (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("rows"),
        F.col("tn").alias("true_negatives"), F.col("fp").alias("false_positives"),
        F.col("fn").alias("false_negatives"), F.col("tp").alias("true_positives"),
    )


def confidence_summary(predictions: DataFrame, target: str, score: str) -> DataFrame:
    """Total errors and the spread of the ten most confident ones, per model and type."""
    top = confident_errors(predictions, target, score, ["model"]).groupBy("model", "error_type").agg(
        F.count("*").alias("top10_count"),
        F.round(F.avg("confidence_mistake"), 6).alias("top10_mean_confidence_mistake"),
        F.round(F.min("confidence_mistake"), 6).alias("top10_min_confidence_mistake"),
        F.round(F.max("confidence_mistake"), 6).alias("top10_max_confidence_mistake"),
    )
    totals = (
        error_totals(predictions, target, score)
        .where(F.col("threshold") == 0.40)
        .select(
            "model",
            F.explode(
                F.array(
                    F.struct(F.lit("FALSE_POSITIVE").alias("error_type"), F.col("false_positives").alias("total_errors_at_40")),
                    F.struct(F.lit("FALSE_NEGATIVE").alias("error_type"), F.col("false_negatives").alias("total_errors_at_40")),
                )
            ).alias("t"),
        )
        .select("model", "t.*")
    )
    return totals.join(top, ["model", "error_type"], "left").withColumn(
        "top10_count", F.coalesce("top10_count", F.lit(0))
    )


def direction(delta: Column, challenger: str, baseline: str) -> Column:
    """Which model wins a paired metric, with the negligible band as a tie."""
    return (
        F.when(delta > NEGLIGIBLE, challenger).when(delta < -NEGLIGIBLE, baseline).otherwise("NEGLIGIBLE")
    )


def _model_metrics(rows: DataFrame, target: str, score: str, keys: list[str]) -> DataFrame:
    """Support, ranking and fixed-threshold metrics per model and slice."""
    grouped = ["model", *keys]
    entity = rows.groupBy(*grouped, "identity_key").agg(
        F.count("*").alias("n"),
        *confusion_columns(target, score, 0.40, "_at_40"),
        *confusion_columns(target, score, 0.50, "_at_50"),
    )
    counts = entity.groupBy(*grouped).agg(
        F.count("*").alias("projects"),
        *[F.sum(c + s).alias(c + s) for s in ("_at_40", "_at_50") for c in ("tn", "fp", "fn", "tp")],
    )
    for suffix in ("_at_40", "_at_50"):
        rates = rate_columns(suffix)
        counts = counts.withColumns({n: F.round(c, 6) for n, c in rates.items() if "false" not in n})
    return counts.join(ranking_metrics(rows, target, score, grouped), grouped)


PAIRED_METRICS = (
    "roc_auc", "pr_auc", "precision_at_40", "recall_at_40", "f1_at_40",
    "precision_at_50", "recall_at_50", "f1_at_50",
    "tn_at_40", "fp_at_40", "fn_at_40", "tp_at_40",
    "tn_at_50", "fp_at_50", "fn_at_50", "tp_at_50",
)


def paired(metrics: DataFrame, keys: list[str], baseline: str, challenger: str, names) -> DataFrame:
    """Baseline and challenger metrics side by side, with AUC deltas and direction."""
    base = metrics.where(F.col("model") == baseline).select(
        *keys, "observations", "projects", "events", "event_rate",
        *[F.col(n).alias(f"baseline_{n}") for n in names],
    )
    other = metrics.where(F.col("model") == challenger).select(
        *keys, *[F.col(n).alias(f"challenger_{n}") for n in names]
    )
    both = base.join(other, keys)
    return both.withColumns(
        {
            "delta_roc_auc": F.round(F.col("challenger_roc_auc") - F.col("baseline_roc_auc"), 6),
            "delta_pr_auc": F.round(F.col("challenger_pr_auc") - F.col("baseline_pr_auc"), 6),
        }
    ).withColumn("pr_direction", direction(F.col("delta_pr_auc"), challenger, baseline))


def unmatched_rows(predictions: DataFrame, target: str, baseline: str, challenger: str) -> DataFrame:
    """Evaluation rows that only one of the two models scored (must be empty)."""
    keys = ["identity_key", "prediction_month", target]
    left = predictions.where(F.col("model") == baseline).select(*keys)
    right = predictions.where(F.col("model") == challenger).select(*keys)
    return left.exceptAll(right).unionAll(right.exceptAll(left))


def slice_comparison(
    predictions: DataFrame, target: str, score: str, baseline: str, challenger: str,
    fields: tuple[str, ...] = AUDIT_FIELDS,
) -> DataFrame:
    """Both models on every supported slice."""
    keys = ["slice_feature", "slice_value"]
    rows = slice_rows(with_slice_fields(predictions), fields)
    metrics = _model_metrics(rows, target, score, keys)
    table = paired(metrics, keys, baseline, challenger, PAIRED_METRICS)
    status = support_status(F.col("observations"), F.col("projects"), F.col("events"))
    return table.withColumn("sample_status", status).where(F.col("sample_status") == "ADEQUATE")


def slice_month_comparison(
    predictions: DataFrame, target: str, score: str, baseline: str, challenger: str,
    slices, months: tuple[str, ...],
) -> DataFrame:
    """Named slices by month; unsupported cells keep their counts and a reason.

    The (slice, month) grid is built from the two parameter lists.
    """
    spark = predictions.sparkSession
    keys = ["important_slice", "evaluation_period"]
    names = F.array(
        *[
            F.struct(F.lit(label).alias("label"), F.coalesce(F.col(field) == value, F.lit(False)).alias("member"))
            for label, (field, value) in slices.items()
        ]
    )
    rows = (
        with_slice_fields(predictions.where(F.col("prediction_month").isin(*months)))
        .withColumn("s", F.explode(F.filter(names, lambda s: s["member"])))
        .withColumns({"important_slice": F.col("s.label"), "evaluation_period": F.col("prediction_month")})
    )
    metrics = _model_metrics(rows, target, score, keys)
    shown = PAIRED_METRICS[:8]
    table = paired(metrics, keys, baseline, challenger, shown)
    grid = spark.createDataFrame(
        [(label, field, value, m) for label, (field, value) in slices.items() for m in months],
        "important_slice string, slice_feature string, slice_value string, evaluation_period string",
    )
    zero = F.lit(0)
    full = grid.join(table, keys, "left").withColumn(
        "sample_status",
        support_status(
            F.coalesce("observations", zero), F.coalesce("projects", zero), F.coalesce("events", zero)
        ),
    )
    adequate = F.col("sample_status") == "ADEQUATE"
    metric_columns = (
        [f"baseline_{n}" for n in shown] + [f"challenger_{n}" for n in shown] + ["delta_roc_auc", "delta_pr_auc"]
    )
    return full.select(
        "important_slice", "slice_feature", "slice_value", "evaluation_period",
        *[F.coalesce(c, zero).alias(c) for c in ("observations", "projects", "events")],
        "event_rate", "sample_status",
        F.when(adequate, "").otherwise("SUPPORT_RULE_NOT_MET").alias("n_a_reason"),
        *[F.when(adequate, F.col(c)).alias(c) for c in metric_columns],
    )


def robustness_verdict(
    comparison: DataFrame, totals: DataFrame, slices, baseline: str, challenger: str
) -> DataFrame:
    """Verdict on supported slices from losses, severe losses and missed events, one row."""
    delta = F.col("delta_pr_auc")
    named = F.lit(False)
    for field, value in slices.values():
        named = named | ((F.col("slice_feature") == field) & (F.col("slice_value") == value))
    evidence = comparison.agg(
        F.count_if(named & (delta < -NEGLIGIBLE)).alias("important_losses"),
        F.count_if(delta < -SEVERE).alias("severe_losses"),
        F.avg((delta >= -NEGLIGIBLE).cast("double")).alias("maintained_share"),
    )
    missed = (
        totals.groupBy("threshold")
        .agg(
            F.sum(F.when(F.col("model") == baseline, F.col("false_negatives"))).alias("base_fn"),
            F.sum(F.when(F.col("model") == challenger, F.col("false_negatives"))).alias("other_fn"),
        )
        .agg(F.min((F.col("other_fn") < F.col("base_fn")).cast("int")).alias("improves"))
    )
    one = F.lit(1).alias("k")
    both = evidence.select("*", one).join(missed.select("*", one), "k")
    improves = F.col("improves") == 1
    return both.select(
        "important_losses", "severe_losses",
        F.round("maintained_share", 6).alias("maintained_share"),
        improves.alias("false_negatives_improve"),
        F.when((F.col("severe_losses") > 0) & (F.col("important_losses") >= 2), "SIGNIFICANT SLICE CONCERNS")
        .when(
            (F.col("important_losses") == 0) & (F.col("maintained_share") >= 0.75) & improves,
            "ROBUST ACROSS SUPPORTED SLICES",
        )
        .otherwise("MIXED SLICE ROBUSTNESS")
        .alias("verdict"),
    )


def win_counts(comparison: DataFrame, baseline: str, challenger: str) -> DataFrame:
    """Wins, losses, ties, severe losses and metric improvements per field and overall."""
    better = {
        f"{m}_improved": F.count_if(F.col(f"challenger_{m}") > F.col(f"baseline_{m}"))
        for m in ("precision_at_40", "recall_at_40")
    }
    return comparison.rollup("slice_feature").agg(
        F.count("*").alias("slices"),
        F.count_if(F.col("pr_direction") == challenger).alias("wins"),
        F.count_if(F.col("pr_direction") == baseline).alias("losses"),
        F.count_if(F.col("pr_direction") == "NEGLIGIBLE").alias("ties"),
        F.count_if(F.col("delta_pr_auc") < -SEVERE).alias("severe_losses"),
        *[c.alias(n) for n, c in better.items()],
    ).withColumn("slice_feature", F.coalesce("slice_feature", F.lit("ALL")))


def temporal_wins(by_month: DataFrame) -> DataFrame:
    """Supported months and wins of each model per named slice."""
    delta, adequate = F.col("delta_pr_auc"), F.col("sample_status") == "ADEQUATE"
    return by_month.groupBy("important_slice").agg(
        F.count_if(adequate).alias("supported_months"),
        F.count_if(adequate & (delta > NEGLIGIBLE)).alias("challenger_wins"),
        F.count_if(adequate & (delta < -NEGLIGIBLE)).alias("baseline_wins"),
        F.min(F.when(adequate, delta)).alias("smallest_delta"),
        F.max(F.when(adequate, delta)).alias("largest_delta"),
    )


def high_progress_review(
    predictions: DataFrame, target: str, score: str, threshold: float, sector: str
) -> DataFrame:
    """Rows above 75% progress: exposure, error rate and one sector's share of both."""
    high = F.coalesce(F.col("progress_current") > 75, F.lit(False))
    y, flag = F.col(target), F.col(score) >= threshold
    wrong = ((y == 0) & flag) | ((y == 1) & ~flag)
    in_sector = F.coalesce(F.col("sector") == sector, F.lit(False))
    per_entity = predictions.where(high).groupBy("identity_key").agg(
        F.count("*").alias("n"),
        F.sum(target).alias("pos"),
        F.count_if(wrong).alias("err"),
        F.count_if(in_sector).alias("sec"),
        F.count_if(in_sector & wrong).alias("sec_err"),
    )
    return per_entity.agg(
        F.sum("n").alias("rows"),
        F.count("*").alias("projects"),
        F.count_if(F.col("err") > 0).alias("projects_with_error"),
        F.round(F.sum("pos") / F.sum("n"), 6).alias("positive_rate"),
        F.round(F.sum("err") / F.sum("n"), 6).alias("error_rate"),
        F.round(F.sum("sec") / F.sum("n"), 6).alias("sector_share_of_rows"),
        F.round(ratio_or_null(F.sum("sec_err"), F.sum("err")), 6).alias("sector_share_of_errors"),
    )
