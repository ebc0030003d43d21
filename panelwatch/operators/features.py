"""Point-in-time features: a row for month T uses rows of months <= T only.

Two different tools are used on purpose. A RANGE frame reads the value *exactly* k
months back and gives null when that month is absent; ``lag`` reads the previous
*observation*, however old. All windows partition by identity and order by month, so
the whole feature set costs one shuffle and one sort, and a partition holds at most
one row per calendar month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec, functions as F

from ..functions.months import parse_month_date
from ..functions.numbers import safe_ratio
from ..sources.panel import checked_unique, traceable

COST_TOLERANCE = 0.01

# Name, category, source fields, status.
FEATURES = (
    ("state", "static", "state", "CONDITIONAL"),
    ("sector", "static", "sector", "SAFE"),
    ("ministry", "static", "ministry", "CONDITIONAL"),
    ("agency", "static", "agency", "CONDITIONAL"),
    ("project_age_months", "static", "start_date,date_of_approval,report_month", "CONDITIONAL"),
    ("progress_current", "current", "physical_progress", "SAFE"),
    ("expenditure_current", "current", "expenditure", "SAFE"),
    ("original_cost_current", "current", "original_cost", "SAFE"),
    ("revised_cost_current", "current", "revised_cost", "CONDITIONAL"),
    ("effective_target_months_from_cutoff", "current", "original_doc,revised_doc,report_month", "CONDITIONAL"),
    ("progress_change_1m", "historical", "physical_progress,report_month", "SAFE"),
    ("progress_change_3m", "historical", "physical_progress,report_month", "SAFE"),
    ("progress_velocity_3m", "historical", "physical_progress,report_month", "SAFE"),
    ("progress_acceleration_3m", "historical", "physical_progress,report_month", "SAFE"),
    ("expenditure_change_1m", "historical", "expenditure,report_month", "SAFE"),
    ("expenditure_change_3m", "historical", "expenditure,report_month", "SAFE"),
    ("expenditure_velocity_3m", "historical", "expenditure,report_month", "SAFE"),
    ("cost_revision_count_to_date", "historical", "original_cost,revised_cost", "SAFE"),
    ("last_cost_revision_pct", "historical", "original_cost,revised_cost", "CONDITIONAL"),
    ("months_since_cost_revision", "recency", "original_cost,revised_cost,report_month", "SAFE"),
    ("schedule_revision_count_to_date", "historical", "original_doc,revised_doc", "SAFE"),
    ("months_since_schedule_revision", "recency", "original_doc,revised_doc,report_month", "SAFE"),
    ("months_since_material_progress_change", "recency", "physical_progress,report_month", "SAFE"),
    ("expenditure_to_original_cost", "ratio", "expenditure,original_cost", "SAFE"),
    ("expenditure_to_revised_cost", "ratio", "expenditure,revised_cost", "CONDITIONAL"),
    ("cost_revision_pct_current", "ratio", "original_cost,revised_cost", "CONDITIONAL"),
    ("months_observed", "recency", "identity_key,report_month", "SAFE"),
    ("months_since_first_observation", "recency", "identity_key,report_month", "SAFE"),
    ("revised_cost_missing", "missingness", "revised_cost", "SAFE"),
    ("progress_missing", "missingness", "physical_progress", "SAFE"),
    ("future_revised_cost", "rejected", "future revised_cost", "UNSAFE"),
    ("future_revised_completion", "rejected", "future revised_doc", "UNSAFE"),
    ("full_history_revision_count", "rejected", "all project months", "UNSAFE"),
    ("last_observed_value", "rejected", "all project months", "UNSAFE"),
)
USABLE = tuple(name for name, _, _, status in FEATURES if status != "UNSAFE")
CATEGORICAL = ("sector", "state", "ministry", "agency")
KEYS = ("project_code", "identity_key", "prediction_month")


def feature_inventory(spark: SparkSession) -> DataFrame:
    """Catalogue of features with category, sources, availability and status."""
    rows = [
        (name, category, sources, status != "UNSAFE", status == "UNSAFE", status)
        for name, category, sources, status in FEATURES
    ]
    return spark.createDataFrame(
        rows,
        "feature_name string, category string, source_fields string, "
        "available_at_cutoff boolean, uses_future_information boolean, status string",
    )


def _timeline() -> WindowSpec:
    return Window.partitionBy("identity_key").orderBy("month_number")


def exact_lag(value: Column, months: int) -> Column:
    """Value exactly ``months`` ago, null when that month has no row."""
    return F.max(value).over(_timeline().rangeBetween(-months, -months))


def cost_differs(current: Column, previous: Column) -> Column:
    """Both costs known and further apart than the tolerance."""
    return F.coalesce(F.abs(current - previous) > COST_TOLERANCE, F.lit(False))


def exact_lags(panel: DataFrame) -> DataFrame:
    """Progress, expenditure and effective cost exactly 1, 2 and 3 months ago."""
    measures = ("physical_progress", "expenditure", "effective_cost")
    lags = {f"{m}_lag{k}": exact_lag(F.col(m), k) for m in measures for k in (1, 2, 3)}
    return checked_unique(traceable(panel)).withColumns(lags)


def build_features(panel: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Key columns and the 30 usable features, one row per traceable entity-month.

    ``keep`` names further panel columns to carry along, such as label columns already
    computed over the same windows.
    """
    timeline = _timeline()
    so_far = timeline.rowsBetween(Window.unboundedPreceding, 0)
    month = F.col("month_number")
    progress, spend, cost = F.col("physical_progress"), F.col("expenditure"), F.col("effective_cost")

    lagged = checked_unique(traceable(panel)).withColumns(
        {
            "progress_lag1": exact_lag(progress, 1),
            "progress_lag2": exact_lag(progress, 2),
            "progress_lag3": exact_lag(progress, 3),
            "spend_lag1": exact_lag(spend, 1),
            "spend_lag3": exact_lag(spend, 3),
            "cost_before": F.lag("effective_cost").over(timeline),
            "end_before": F.lag("effective_end").over(timeline),
            "months_observed": F.row_number().over(timeline),
            "first_month": F.first("month_number").over(so_far),
        }
    )
    flagged = lagged.withColumns(
        {
            "progress_change_1m": progress - F.col("progress_lag1"),
            "progress_change_3m": progress - F.col("progress_lag3"),
            "expenditure_change_1m": spend - F.col("spend_lag1"),
            "expenditure_change_3m": spend - F.col("spend_lag3"),
            "cost_changed": cost_differs(cost, F.col("cost_before")),
            "end_changed": F.coalesce(F.col("effective_end") != F.col("end_before"), F.lit(False)),
        }
    ).withColumn(
        "progress_moved", F.coalesce(F.abs("progress_change_1m") >= 1, F.lit(False))
    )

    def months_since(flag: str) -> Column:
        return month - F.last(F.when(F.col(flag), month), ignorenulls=True).over(so_far)

    def running_count(flag: str) -> Column:
        return F.sum(F.col(flag).cast("int")).over(so_far)

    # A previous cost of zero has no percentage; the count still records the change.
    revision_pct = F.when(
        F.col("cost_changed") & (F.col("cost_before") != 0), cost / F.col("cost_before") - 1
    )
    started = F.coalesce("start_date", "date_of_approval")
    known_cost = F.col("original_cost") > 0
    return flagged.withColumns(
        {
            "project_age_months": month - parse_month_date(started),
            "progress_current": progress,
            "expenditure_current": spend,
            "original_cost_current": F.col("original_cost"),
            "revised_cost_current": F.col("revised_cost"),
            "effective_target_months_from_cutoff": F.col("effective_end") - month,
            "progress_velocity_3m": F.col("progress_change_3m") / 3,
            "progress_acceleration_3m": F.col("progress_change_1m")
            - (F.col("progress_lag1") - F.col("progress_lag2")),
            "expenditure_velocity_3m": F.col("expenditure_change_3m") / 3,
            "cost_revision_count_to_date": running_count("cost_changed"),
            "last_cost_revision_pct": F.last(revision_pct, ignorenulls=True).over(so_far),
            "months_since_cost_revision": months_since("cost_changed"),
            "schedule_revision_count_to_date": running_count("end_changed"),
            "months_since_schedule_revision": months_since("end_changed"),
            "months_since_material_progress_change": months_since("progress_moved"),
            "expenditure_to_original_cost": safe_ratio(spend, F.col("original_cost")),
            "expenditure_to_revised_cost": safe_ratio(spend, F.col("revised_cost")),
            "cost_revision_pct_current": F.when(known_cost, cost / F.col("original_cost") - 1),
            "months_since_first_observation": month - F.col("first_month"),
            "revised_cost_missing": F.col("revised_cost").isNull().cast("int"),
            "progress_missing": progress.isNull().cast("int"),
        }
    ).select(
        "project_code", "identity_key", F.col("report_month").alias("prediction_month"), *USABLE, *keep
    )


def unique_keys(frame: DataFrame, *keys: str) -> DataFrame:
    """The frame, refusing key combinations that occur more than once.

    Rows are regrouped by key in the same shuffle a join on those keys needs.
    """
    value_columns = [c for c in frame.columns if c not in keys]
    message = F.concat_ws(" ", F.lit("duplicate key:"), *[F.col(k).cast("string") for k in keys])
    grouped = frame.groupBy(*keys).agg(
        F.count("*").alias("key_rows"), F.first(F.struct(*value_columns)).alias("row")
    )
    return grouped.select(
        *keys,
        *[
            F.when(F.col("key_rows") == 1, F.col(f"row.{c}"))
            .otherwise(F.raise_error(message).cast(frame.schema[c].dataType))
            .alias(c)
            for c in value_columns
        ],
    )


def join_labels(features: DataFrame, labels: DataFrame, target: str) -> DataFrame:
    """Stored features joined one-to-one with stored labels; UNKNOWN rows are absent."""
    keyed = labels.select("identity_key", "prediction_month", F.col("label").alias(target))
    return features.join(
        unique_keys(keyed, "identity_key", "prediction_month"), ["identity_key", "prediction_month"]
    )


def feature_quality(features: DataFrame) -> DataFrame:
    """Missing % and constant flag of each feature, from one aggregation row.

    A feature is constant when it has at most one distinct value, that is when its
    smallest and largest values agree.
    """
    stats = features.agg(
        F.count("*").alias("n"),
        *[F.count(c).alias(f"{c}__known") for c in USABLE],
        *[F.min(c).alias(f"{c}__low") for c in USABLE],
        *[F.max(c).alias(f"{c}__high") for c in USABLE],
    )
    per_feature = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature_name"),
                F.round((F.col("n") - F.col(f"{c}__known")) * 100 / F.nullif("n", F.lit(0)), 6).alias(
                    "missing_pct"
                ),
                F.coalesce(F.col(f"{c}__low") == F.col(f"{c}__high"), F.lit(True)).alias("is_constant"),
            )
            for c in USABLE
        ]
    )
    return stats.select(F.explode(per_feature).alias("f")).select("f.*")


def feature_quality_summary(panel: DataFrame, features: DataFrame) -> DataFrame:
    """Feature rows, distinct entities and rows excluded for lack of an identity."""
    source = panel.agg(
        F.count("*").alias("source_rows"),
        F.count_if("traceable").alias("feature_rows"),
    )
    entities = features.agg(F.countDistinct("identity_key").alias("projects"))
    long = F.array(
        F.struct(F.lit("source_rows").alias("statistic"), F.col("source_rows").alias("value")),
        F.struct(F.lit("feature_rows").alias("statistic"), F.col("feature_rows").alias("value")),
        F.struct(
            F.lit("excluded_rows").alias("statistic"),
            (F.col("source_rows") - F.col("feature_rows")).alias("value"),
        ),
    )
    return (
        source.select(F.explode(long).alias("s")).select("s.statistic", "s.value")
        .unionByName(entities.select(F.lit("projects").alias("statistic"), F.col("projects").alias("value")))
    )


def with_rejected(panel: DataFrame) -> DataFrame:
    """All features of the catalogue, the rejected ones included, which look past the month.

    They exist to be refused: next month's revised cost and completion, changes counted over the
    whole history, and the last cost ever observed.
    """
    timeline = _timeline()
    whole = Window.partitionBy("identity_key")
    cost_changed = cost_differs(F.col("effective_cost"), F.lag("effective_cost").over(timeline))
    rejected = {
        "future_revised_cost": F.lead("revised_cost").over(timeline),
        "future_revised_completion": F.lead("effective_end").over(timeline),
        "full_history_revision_count": F.sum(F.col("cost_changed").cast("int")).over(whole),
        "last_observed_value": F.max_by("effective_cost", "month_number").over(whole),
    }
    extended = traceable(panel).withColumn("cost_changed", cost_changed).withColumns(rejected).drop("cost_changed")
    return build_features(extended, tuple(rejected))


def features_that_look_ahead(panel: DataFrame, cutoff_month: str, build=with_rejected) -> DataFrame:
    """Per feature, the rows up to the cutoff and how many of them change when later rows are removed.

    A point-in-time feature changes nowhere. Rows that only one of the two builds has count as changed.
    """
    known = [name for name, _, _, _ in FEATURES]
    full = build(panel).where(F.col("prediction_month") <= cutoff_month)
    cut = build(panel.where(F.col("report_month") <= cutoff_month))
    keys = ["identity_key", "prediction_month"]
    left, right = (
        f.select(*keys, F.struct(*known).alias(side)) for f, side in ((full, "full"), (cut, "cut"))
    )
    changed = {c: F.count_if(~F.col(f"full.{c}").eqNullSafe(F.col(f"cut.{c}"))) for c in known}
    row = left.join(right, keys, "full").agg(F.count("*").alias("n"), *[v.alias(c) for c, v in changed.items()])
    each = F.array(
        *[F.struct(F.lit(c).alias("feature_name"), F.col("n").alias("compared_rows"), F.col(c).alias("changed_rows")) for c in known]
    )
    return row.select(F.explode(each).alias("f")).select("f.*")


def leaking_rows(panel: DataFrame, cutoff_month: str) -> DataFrame:
    """Feature rows up to the cutoff that change when later rows are removed.

    Empty when the features are point-in-time.
    """
    full = build_features(panel).where(F.col("prediction_month") <= cutoff_month)
    truncated = build_features(panel.where(F.col("report_month") <= cutoff_month))
    return full.exceptAll(truncated).unionAll(truncated.exceptAll(full))
