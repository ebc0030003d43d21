"""Point-in-time features of an arriving month, from a state table instead of the whole history.

The state has one row per entity with what the features of a later month can still need: first
month and number of months seen, values of the last observation, the measures of the last three
calendar months, running counts, and the months of the last changes. Folding one month joins its
rows to the state once; the work grows with the entities, not with the months behind them.

Folded months must rise. The state carries the month it stands at, and a row whose state is not
earlier than the batch makes the job fail, as does a row of another month inside the batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.months import month_number, parse_month_date
from ..functions.numbers import safe_ratio
from ..session import complete_folders
from ..sources.panel import checked_unique, traceable
from .features import CATEGORICAL, COST_TOLERANCE, KEYS, USABLE, cost_differs

#: Calendar months whose measures the next feature row can look back to.
LOOKBACK = 3
STATE = {
    "identity_key": "string", "as_of": "int", "first_month": "int", "months_observed": "long",
    "cost_before": "double", "end_before": "int", "recent_progress": "array<double>", "recent_spend": "array<double>",
    "cost_changes": "long", "last_cost_pct": "double", "last_cost_month": "int", "end_changes": "long",
    "last_end_month": "int", "last_moved_month": "int",
}
#: Panel columns that folding reads.
PANEL = (
    "project_code", "identity_key", "report_month", "month_number", "traceable", "physical_progress", "expenditure",
    "original_cost", "revised_cost", "effective_cost", "effective_end", "start_date", "date_of_approval", *CATEGORICAL,
)
_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in STATE.items())


def empty_state(spark: SparkSession) -> DataFrame:
    """The state before the first month."""
    return spark.createDataFrame([], _SCHEMA)


def _refuse(message: str, kind: str) -> Column:
    return F.raise_error(F.lit(message)).cast(kind)


def _shifted(now: Column, old: Column, gap: Column) -> Column:
    """Measures of the month itself and of the two before it, null where there is no row."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(LOOKBACK - 1)),
        lambda i: F.when(i == 0, now).when(i >= gap, F.get(old, i - gap)),
    )


def fold(state: DataFrame, batch: DataFrame, report_month: str) -> tuple[DataFrame, DataFrame]:
    """(features of the batch's rows, state after the batch) for the rows of one month.

    ``batch`` holds panel rows of ``report_month`` only. Both results are plans over the same
    join; write the state before the next month is folded into it.
    """
    number = month_number(F.lit(report_month))
    rows = checked_unique(traceable(batch)).withColumn(
        "report_month",
        F.when(F.col("report_month") == report_month, F.col("report_month")).otherwise(
            _refuse(f"a row of another month in the batch of {report_month}", "string")
        ),
    )
    seen = state.withColumns(
        {
            "as_of": F.when(F.col("as_of") < number, F.col("as_of")).otherwise(
                _refuse(f"the state is not earlier than {report_month}", "int")
            )
        }
    ).select(*[F.col(c).alias(f"old_{c}") for c in STATE])
    both = rows.withColumn("here", F.lit(True)).join(seen, F.col("identity_key") == F.col("old_identity_key"), "full")
    here = F.col("here").isNotNull()
    progress, spend, cost = F.col("physical_progress"), F.col("expenditure"), F.col("effective_cost")
    gap = (number - F.col("old_as_of")).cast("int")

    def lag(measure: str, k: int) -> Column:
        return F.when(gap <= k, F.get(f"old_recent_{measure}", k - gap))

    flagged = both.withColumns(
        {
            "progress_lag1": lag("progress", 1), "progress_lag2": lag("progress", 2), "progress_lag3": lag("progress", 3),
            "spend_lag1": lag("spend", 1), "spend_lag3": lag("spend", 3),
            "cost_changed": here & cost_differs(cost, F.col("old_cost_before")),
            "end_changed": here & F.coalesce(F.col("effective_end") != F.col("old_end_before"), F.lit(False)),
        }
    ).withColumn("progress_moved", here & F.coalesce(F.abs(progress - F.col("progress_lag1")) >= 1, F.lit(False)))

    def count(flag: str, old: str) -> Column:
        return F.coalesce(old, F.lit(0)) + F.col(flag).cast("long")

    def latest(flag: str, old: str) -> Column:
        return F.when(F.col(flag), number).otherwise(F.col(old)).cast("int")

    percent = F.when(F.col("cost_changed") & (F.col("old_cost_before") != 0), cost / F.col("old_cost_before") - 1)
    folded = flagged.withColumns(
        {
            "n_seen": F.coalesce("old_months_observed", F.lit(0)) + here.cast("long"),
            "first_seen": F.coalesce("old_first_month", number).cast("int"),
            "n_cost": count("cost_changed", "old_cost_changes"), "n_end": count("end_changed", "old_end_changes"),
            "cost_pct": F.coalesce(percent, "old_last_cost_pct"),
            "cost_at": latest("cost_changed", "old_last_cost_month"), "end_at": latest("end_changed", "old_last_end_month"),
            "moved_at": latest("progress_moved", "old_last_moved_month"),
        }
    )
    after = folded.select(
        F.coalesce("identity_key", "old_identity_key").alias("identity_key"),
        # through the guarded columns, so that refused rows reach neither result
        F.coalesce(month_number(F.col("report_month")), F.col("old_as_of") + gap).cast("int").alias("as_of"),
        F.col("first_seen").alias("first_month"), F.col("n_seen").alias("months_observed"),
        F.when(here, cost).otherwise(F.col("old_cost_before")).alias("cost_before"),
        F.when(here, F.col("effective_end")).otherwise(F.col("old_end_before")).cast("int").alias("end_before"),
        _shifted(F.when(here, progress), F.col("old_recent_progress"), gap).alias("recent_progress"),
        _shifted(F.when(here, spend), F.col("old_recent_spend"), gap).alias("recent_spend"),
        F.col("n_cost").alias("cost_changes"), F.col("cost_pct").alias("last_cost_pct"), F.col("cost_at").alias("last_cost_month"),
        F.col("n_end").alias("end_changes"), F.col("end_at").alias("last_end_month"), F.col("moved_at").alias("last_moved_month"),
    )
    change_1m, change_3m = progress - F.col("progress_lag1"), progress - F.col("progress_lag3")
    spend_3m = spend - F.col("spend_lag3")
    features = folded.where(here).withColumns(
        {
            "project_age_months": number - parse_month_date(F.coalesce("start_date", "date_of_approval")),
            "progress_current": progress,
            "expenditure_current": spend,
            "original_cost_current": F.col("original_cost"),
            "revised_cost_current": F.col("revised_cost"),
            "effective_target_months_from_cutoff": F.col("effective_end") - number,
            "progress_change_1m": change_1m,
            "progress_change_3m": change_3m,
            "progress_velocity_3m": change_3m / 3,
            "progress_acceleration_3m": change_1m - (F.col("progress_lag1") - F.col("progress_lag2")),
            "expenditure_change_1m": spend - F.col("spend_lag1"),
            "expenditure_change_3m": spend_3m,
            "expenditure_velocity_3m": spend_3m / 3,
            "cost_revision_count_to_date": F.col("n_cost"),
            "last_cost_revision_pct": F.col("cost_pct"),
            "months_since_cost_revision": number - F.col("cost_at"),
            "schedule_revision_count_to_date": F.col("n_end"),
            "months_since_schedule_revision": number - F.col("end_at"),
            "months_since_material_progress_change": number - F.col("moved_at"),
            "expenditure_to_original_cost": safe_ratio(spend, F.col("original_cost")),
            "expenditure_to_revised_cost": safe_ratio(spend, F.col("revised_cost")),
            "cost_revision_pct_current": F.when(F.col("original_cost") > 0, cost / F.col("original_cost") - 1),
            "months_observed": F.col("n_seen").cast("int"),
            "months_since_first_observation": number - F.col("first_seen"),
            "revised_cost_missing": F.col("revised_cost").isNull().cast("int"),
            "progress_missing": progress.isNull().cast("int"),
        }
    )
    return features.select(*KEYS[:2], F.col("report_month").alias(KEYS[2]), *USABLE), after


def state_of(panel: DataFrame, report_month: str) -> DataFrame:
    """The state after all rows up to ``report_month``, in one pass over the history.

    This is how a store begins in the middle of a history; from there on months are folded.
    """
    number = month_number(F.lit(report_month))
    timeline = Window.partitionBy("identity_key").orderBy("month_number")
    rows = checked_unique(traceable(panel.where(F.col("report_month") <= report_month))).withColumns(
        {
            "cost_was": F.lag("effective_cost").over(timeline),
            "end_was": F.lag("effective_end").over(timeline),
            "progress_was": F.max("physical_progress").over(timeline.rangeBetween(-1, -1)),
        }
    )
    cost_changed = F.coalesce(F.abs(F.col("effective_cost") - F.col("cost_was")) > COST_TOLERANCE, F.lit(False))
    end_changed = F.coalesce(F.col("effective_end") != F.col("end_was"), F.lit(False))
    moved = F.coalesce(F.abs(F.col("physical_progress") - F.col("progress_was")) >= 1, F.lit(False))
    percent = F.when(cost_changed & (F.col("cost_was") != 0), F.col("effective_cost") / F.col("cost_was") - 1)
    at = F.col("month_number")
    rows = rows.withColumns({"cost_changed": cost_changed, "end_changed": end_changed, "moved": moved, "percent": percent})

    def recent(measure: str) -> Column:
        return F.array(*[F.max(F.when(at == number - k, F.col(measure))) for k in range(LOOKBACK)])

    return rows.groupBy("identity_key").agg(
        number.cast("int").alias("as_of"), F.min(at).cast("int").alias("first_month"), F.count("*").alias("months_observed"),
        F.max_by("effective_cost", at).alias("cost_before"), F.max_by("effective_end", at).cast("int").alias("end_before"),
        recent("physical_progress").alias("recent_progress"), recent("expenditure").alias("recent_spend"),
        F.count_if("cost_changed").alias("cost_changes"),
        F.max_by("percent", F.when(F.col("percent").isNotNull(), at)).alias("last_cost_pct"),
        F.max(F.when(F.col("cost_changed"), at)).cast("int").alias("last_cost_month"),
        F.count_if("end_changed").alias("end_changes"),
        F.max(F.when(F.col("end_changed"), at)).cast("int").alias("last_end_month"),
        F.max(F.when(F.col("moved"), at)).cast("int").alias("last_moved_month"),
    )


def advance(batch: DataFrame, report_month: str, folder: str) -> DataFrame:
    """Fold one month into a store and return its features, read back.

    The store keeps the state after each month in a folder of its own. A month that is
    delivered again is folded into the state before it and replaces its own results; a month
    with a later one behind it is refused, since the later states would not know of it.
    """
    spark = batch.sparkSession
    months = complete_folders(spark, f"{folder}/state")
    if months and months[-1] > report_month:
        raise ValueError(f"{months[-1]} has been folded already; {report_month} comes too late")
    earlier = [m for m in months if m < report_month]
    state = spark.read.schema(_SCHEMA).parquet(f"{folder}/state/{earlier[-1]}") if earlier else empty_state(spark)
    features, after = fold(state, batch, report_month)
    features.write.mode("overwrite").parquet(f"{folder}/features/{report_month}")
    # The state comes last: a month counts as folded only once its features are there.
    after.write.mode("overwrite").parquet(f"{folder}/state/{report_month}")
    return spark.read.schema(features.schema).parquet(f"{folder}/features/{report_month}")
