"""Review workload of a model at fixed thresholds: intervention policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .metrics import FIXED_THRESHOLDS, confusion_columns
from .slices import IMPORTANT_SLICES, named_slice_rows, support_status, with_slice_fields

# Relative cost of a missed event and of a false alert per scenario.
COST_SCENARIOS = {"A_EQUAL_COST": (1, 1), "B_FN_DOUBLE": (2, 1), "C_FN_FIVEFOLD": (5, 1)}

POLICY_METRICS = (
    "observations_evaluated", "unique_projects_evaluated", "flagged_review_actions",
    "flagged_percent", "true_errors_captured", "false_interventions",
    "error_observations_missed", "true_negatives", "intervention_precision",
    "intervention_recall", "f1", "intervention_burden", "error_capture_rate",
    "false_interventions_per_true_error_captured", "review_workload_ratio",
)
FOLD_METRICS = (
    "flagged_review_actions", "flagged_percent", "true_errors_captured", "false_interventions",
    "error_observations_missed", "intervention_precision", "intervention_recall", "f1",
    "intervention_burden", "review_workload_ratio",
)


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom)


def intervention_metrics(
    predictions: DataFrame, target: str, score: str, by: list[str]
) -> DataFrame:
    """Workload, precision, recall and statuses per group and fixed threshold.

    Rows are reduced per entity first and both thresholds are counted together.
    Distinct flagged entities are reported only inside a single month.
    """
    indexes = range(len(FIXED_THRESHOLDS))
    entity = predictions.groupBy(*by, "identity_key").agg(
        F.count("*").alias("n"),
        F.min("prediction_month").alias("first_month"),
        F.max("prediction_month").alias("last_month"),
        *[c for i in indexes for c in confusion_columns(target, score, FIXED_THRESHOLDS[i], f"__{i}")],
    )
    totals = entity.groupBy(*by).agg(
        F.sum("n").alias("observations"),
        F.count("*").alias("projects"),
        (F.min("first_month") == F.max("last_month")).alias("one_month"),
        *[F.sum(f"{c}__{i}").alias(f"{c}__{i}") for i in indexes for c in ("tn", "fp", "fn", "tp")],
        *[F.count_if(F.col(f"tp__{i}") + F.col(f"fp__{i}") > 0).alias(f"flagged_projects__{i}") for i in indexes],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(float(FIXED_THRESHOLDS[i])).alias("threshold"),
                *[F.col(f"{c}__{i}").alias(c) for c in ("tn", "fp", "fn", "tp")],
                F.col(f"flagged_projects__{i}").alias("flagged_projects"),
            )
            for i in indexes
        ]
    )
    c = F.col
    flagged, events = c("tp") + c("fp"), c("tp") + c("fn")
    f1 = F.when(c("tp") > 0, 2 * c("tp") / (2 * c("tp") + c("fp") + c("fn")))
    burden = F.round(_ratio(flagged, c("observations")), 8)
    recall = F.round(_ratio(c("tp"), events), 8)
    return (
        totals.select(*by, "observations", "projects", "one_month", F.explode(rows).alias("t"))
        .select(*by, "observations", "projects", "one_month", "t.*")
        .select(
            *by, "threshold",
            c("observations").alias("observations_evaluated"),
            c("projects").alias("unique_projects_evaluated"),
            flagged.alias("flagged_review_actions"),
            burden.alias("flagged_percent"),
            F.when(c("one_month"), c("flagged_projects")).alias("unique_projects_flagged"),
            F.when(c("one_month"), "ONE_MONTH_UNIQUE")
            .otherwise("NOT_AGGREGATED_ACROSS_MONTHS")
            .alias("project_flagging_scope"),
            c("tp").alias("true_errors_captured"),
            c("fp").alias("false_interventions"),
            c("fn").alias("error_observations_missed"),
            c("tn").alias("true_negatives"),
            F.round(_ratio(c("tp"), flagged), 8).alias("intervention_precision"),
            F.when(flagged > 0, "DEFINED").otherwise("N/A_NO_FLAGGED_OBSERVATIONS").alias("precision_status"),
            recall.alias("intervention_recall"),
            F.when(events > 0, "DEFINED").otherwise("N/A_NO_ERROR_OBSERVATIONS").alias("recall_status"),
            F.round(f1, 8).alias("f1"),
            F.when(f1.isNotNull(), "DEFINED")
            .otherwise("N/A_UNDEFINED_PRECISION_OR_RECALL")
            .alias("f1_status"),
            burden.alias("intervention_burden"),
            recall.alias("error_capture_rate"),
            F.round(_ratio(c("fp"), c("tp")), 8).alias("false_interventions_per_true_error_captured"),
            F.round(_ratio(flagged, events), 8).alias("review_workload_ratio"),
        )
    )


def overall_policies(predictions: DataFrame, target: str, score: str) -> DataFrame:
    """Pooled policy of each model at each threshold."""
    return intervention_metrics(predictions, target, score, ["model"])


def fold_policies(predictions: DataFrame, target: str, score: str) -> DataFrame:
    """Policies per model, fold and month, refusing duplicate entities inside a month."""
    keys = ["model", "fold", "prediction_month"]
    table = intervention_metrics(predictions, target, score, keys)
    message = F.lit("a monthly fold contains duplicate entity observations")
    unique = F.col("observations_evaluated") == F.col("unique_projects_evaluated")
    return table.withColumn(
        "observations_evaluated",
        F.when(unique, F.col("observations_evaluated")).otherwise(F.raise_error(message).cast("long")),
    )


def fold_policy_summary(folds: DataFrame) -> DataFrame:
    """Mean and population deviation over folds per model and threshold."""
    return folds.groupBy("model", "threshold").agg(
        F.count("*").alias("folds"),
        *[
            c
            for m in FOLD_METRICS
            for c in (
                F.round(F.avg(m), 6).alias(f"mean_{m}"),
                F.round(F.stddev_pop(m), 6).alias(f"sd_{m}"),
            )
        ],
    )


def policy_comparison(overall: DataFrame, baseline: str, challenger: str) -> DataFrame:
    """Both models side by side per threshold, with deltas and the marginal false alerts."""

    def of(model: str, metric: str) -> Column:
        return F.max(F.when(F.col("model") == model, F.col(metric)))

    wide = overall.groupBy("threshold").agg(
        *[
            c
            for m in POLICY_METRICS
            for c in (of(baseline, m).alias(f"baseline_{m}"), of(challenger, m).alias(f"challenger_{m}"))
        ]
    )
    deltas = {f"delta_{m}": F.col(f"challenger_{m}") - F.col(f"baseline_{m}") for m in POLICY_METRICS}
    rounded = {
        n: (F.round(c, 6) if not n.endswith(_COUNTS) else c) for n, c in deltas.items()
    }
    extra_true = F.col("delta_true_errors_captured")
    return wide.withColumns(rounded).withColumn(
        "additional_false_interventions_per_additional_true_error",
        F.round(F.when(extra_true != 0, F.col("delta_false_interventions") / extra_true), 6),
    )


_COUNTS = (
    "observations_evaluated", "unique_projects_evaluated", "flagged_review_actions",
    "true_errors_captured", "false_interventions", "error_observations_missed", "true_negatives",
)


def slice_policies(
    predictions: DataFrame, target: str, score: str, baseline: str, slices=IMPORTANT_SLICES
) -> DataFrame:
    """Policies on named slices; metrics are null where the baseline support is too small."""
    members = named_slice_rows(with_slice_fields(predictions), slices)
    keys = ["important_slice", "slice_feature", "slice_value"]
    y = F.col(target)
    support = members.groupBy(*keys).agg(
        support_status(
            F.count_if(F.col("model") == baseline),
            F.countDistinct(F.when(F.col("model") == baseline, F.col("identity_key"))),
            F.count_if((F.col("model") == baseline) & (y == 1)),
        ).alias("sample_status")
    )
    table = intervention_metrics(
        members.where(F.col("model").isNotNull()), target, score, [*keys, "model"]
    )
    adequate = F.col("sample_status") == "ADEQUATE"
    values = [c for c in table.columns if c not in (*keys, "model", "threshold")]
    return support.join(table, keys, "left").select(
        *keys, "model", "threshold", "sample_status",
        F.when(adequate, "").otherwise("SUPPORT_RULE_NOT_MET").alias("n_a_reason"),
        *[F.when(adequate, F.col(v)).alias(v) for v in values],
    )


def cost_scenarios(overall: DataFrame, baseline: str, challenger: str) -> DataFrame:
    """Relative cost of missed events and false alerts in each scenario and threshold."""
    scenarios = F.array(
        *[
            F.struct(
                F.lit(name).alias("scenario"), F.lit(fn).cast("long").alias("fn_cost"),
                F.lit(fp).cast("long").alias("fp_cost"),
            )
            for name, (fn, fp) in COST_SCENARIOS.items()
        ]
    )
    priced = overall.select(
        "model", "threshold", "error_observations_missed", "false_interventions",
        F.explode(scenarios).alias("s"),
    ).withColumn(
        "cost",
        F.col("s.fn_cost") * F.col("error_observations_missed")
        + F.col("s.fp_cost") * F.col("false_interventions"),
    )
    return (
        priced.groupBy(
            F.col("s.scenario").alias("scenario"),
            F.col("s.fn_cost").alias("false_negative_relative_cost"),
            F.col("s.fp_cost").alias("false_positive_relative_cost"),
            "threshold",
        )
        .agg(
            F.max(F.when(F.col("model") == baseline, F.col("cost"))).alias("baseline_total_simulated_cost"),
            F.max(F.when(F.col("model") == challenger, F.col("cost"))).alias("challenger_total_simulated_cost"),
        )
        .withColumn(
            "delta_challenger_minus_baseline",
            F.col("challenger_total_simulated_cost") - F.col("baseline_total_simulated_cost"),
        )
    )


def operational_verdict(comparison: DataFrame) -> DataFrame:
    """PROMISING, MIXED or WEAK from the captured events, false alerts and burden, one row."""
    captures = F.col("delta_true_errors_captured")
    false = F.col("delta_false_interventions")
    burden = F.col("delta_flagged_percent")

    def every(test: Column) -> Column:
        return F.min(test.cast("int")) == 1

    def some(test: Column) -> Column:
        return F.max(test.cast("int")) == 1

    evidence = comparison.agg(
        every(captures > 0).alias("captures_more"),
        every(false > 0).alias("more_false"),
        every(false <= 0).alias("no_more_false"),
        some(burden >= 0.10).alias("heavier_burden"),
    )
    c = F.col
    return evidence.select(
        "captures_more", "more_false", "no_more_false", "heavier_burden",
        F.when(c("captures_more") & c("more_false") & c("heavier_burden"), "OPERATIONALLY MIXED")
        .when(c("captures_more") & c("no_more_false"), "OPERATIONALLY PROMISING")
        .otherwise("OPERATIONALLY WEAK")
        .alias("verdict"),
    )
