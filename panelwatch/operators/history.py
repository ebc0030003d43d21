"""Observation history, maturity of labels and the gate for an incoming batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.months import month_add
from ..functions.text import is_month_date
from ..sources.panel import DATE_FIELDS, ENRICHED_COLUMNS, checked_unique, traceable
from .features import cost_differs
from .labels import label_table

TRACEABLE_ID = r"^[PL]:[^\s]+$"  # fixed value


def build_history(panel: DataFrame) -> DataFrame:
    """Per entity: span, longest run, gaps, revision timing and eligible cutoffs."""
    timeline = Window.partitionBy("identity_key").orderBy("month_number")

    def ahead(h: int) -> Column:
        return (F.count(F.lit(1)).over(timeline.rangeBetween(h, h)) > 0).cast("int")

    end_changed = F.coalesce(
        F.col("effective_end") != F.lag("effective_end").over(timeline), F.lit(False)
    )
    cost_changed = cost_differs(F.col("effective_cost"), F.lag("effective_cost").over(timeline))
    rows = checked_unique(traceable(panel)).withColumns(
        {
            "changed": end_changed | cost_changed,
            "ahead_3m": ahead(3),
            "ahead_6m": ahead(6),
            # Consecutive months share one value of month minus position.
            "island": F.col("month_number") - F.row_number().over(timeline),
        }
    )
    revised = F.when(F.col("changed"), F.col("month_number"))
    per_island = rows.groupBy("identity_key", "island").agg(
        F.count("*").alias("run"),
        F.min("month_number").alias("first_number"),
        F.max("month_number").alias("last_number"),
        F.min("report_month").alias("first_month"),
        F.max("report_month").alias("last_month"),
        F.min(F.when(F.col("project_code").isNotNull(), F.struct("month_number", "project_code"))).alias("code"),
        F.min(
            F.when(F.col("legacy_ocms_code").isNotNull(), F.struct("month_number", "legacy_ocms_code"))
        ).alias("alternate"),
        F.min(revised).alias("first_revision"),
        F.max(revised).alias("last_revision"),
        F.sum("ahead_3m").alias("ahead_3m"),
        F.sum("ahead_6m").alias("ahead_6m"),
    )
    return per_island.groupBy("identity_key").agg(
        F.min("code")["project_code"].alias("project_code"),
        F.min("alternate")["legacy_ocms_code"].alias("alternate_identifier"),
        F.min("first_month").alias("first_observed_month"),
        F.max("last_month").alias("last_observed_month"),
        F.sum("run").alias("number_of_months"),
        F.max("run").alias("consecutive_months"),
        (F.max("last_number") - F.min("first_number") + 1 - F.sum("run")).alias("gaps"),
        (F.min("first_revision") - F.min("first_number")).alias("months_before_first_revision"),
        (F.max("last_revision") - F.min("first_number")).alias("months_before_last_revision"),
        F.sum("ahead_3m").alias("eligible_cutoffs_3m"),
        F.sum("ahead_6m").alias("eligible_cutoffs_6m"),
    )


def depth_summary(history: DataFrame) -> DataFrame:
    """Entities by observation depth, and lookahead totals."""
    months = F.col("number_of_months")
    return history.agg(
        F.count("*").alias("projects"),
        F.count_if(months == 1).alias("exactly_1"),
        F.count_if(months >= 2).alias("two_plus"),
        F.count_if(months >= 3).alias("three_plus"),
        F.count_if(months >= 6).alias("six_plus"),
        F.count_if(months >= 12).alias("twelve_plus"),
        F.count_if(F.col("eligible_cutoffs_3m") > 0).alias("with_3m_lookahead"),
        F.count_if(F.col("eligible_cutoffs_6m") > 0).alias("with_6m_lookahead"),
        F.coalesce(F.sum("eligible_cutoffs_3m"), F.lit(0)).alias("cutoffs_3m"),
        F.coalesce(F.sum("eligible_cutoffs_6m"), F.lit(0)).alias("cutoffs_6m"),
    )


def maturity_availability(
    panel: DataFrame, start_month: str, target: str = "future_schedule_later_3m", horizon: int = 3
) -> DataFrame:
    """Per cutoff month from ``start_month``: endpoint presence and mature label counts."""
    labels = label_table(panel, target)
    per_month = panel.groupBy("report_month").agg(
        F.count("*").alias("rows"),
        F.countDistinct("identity_key").alias("projects"),
        F.count_if("traceable").alias("traceable_rows"),
    )
    cutoffs = per_month.where(F.col("report_month") >= start_month).withColumn(
        "endpoint", month_add(F.col("report_month"), horizon)
    )
    endpoints = per_month.select(
        F.col("report_month").alias("endpoint"), F.col("rows").alias("endpoint_rows")
    )
    keys = traceable(panel).select("identity_key", "report_month").distinct()
    pairs = (
        keys.withColumn("endpoint", month_add(F.col("report_month"), horizon))
        .join(
            keys.select("identity_key", F.col("report_month").alias("endpoint")),
            ["identity_key", "endpoint"],
            "left_semi",
        )
        .groupBy("report_month")
        .agg(F.count("*").alias("pairs"))
    )
    mature = labels.groupBy(F.col("prediction_month").alias("report_month")).agg(
        F.count("*").alias("mature_rows"), F.sum("label").alias("mature_events")
    )
    zero = F.lit(0)
    mature_rows = F.coalesce("mature_rows", zero)
    return (
        cutoffs.join(endpoints, "endpoint", "left")
        .join(pairs, "report_month", "left")
        .join(mature, "report_month", "left")
        .select(
            F.col("report_month").alias("cutoff_month"),
            F.col("rows").alias("cutoff_observations"),
            F.col("projects").alias("cutoff_projects"),
            F.col("traceable_rows").alias("traceable_observations"),
            F.col("endpoint").alias("required_endpoint"),
            F.col("endpoint_rows").isNotNull().alias("endpoint_month_available"),
            F.coalesce("endpoint_rows", zero).alias("endpoint_observations"),
            F.coalesce("pairs", zero).alias("exact_endpoint_project_pairs"),
            mature_rows.alias("mature_label_rows"),
            F.coalesce("mature_events", zero).alias("mature_events"),
            (F.col("rows") - mature_rows).alias("immature_or_unknown_rows"),
            F.when(mature_rows > 0, "MATURE")
            .otherwise("IMMATURE_MISSING_ENDPOINT")
            .alias("maturity_status"),
        )
    )


def holdout_separation(
    development: DataFrame, holdout: DataFrame, development_end: str, holdout_start: str
) -> DataFrame:
    """Boundary and overlap checks between development and holdout rows, one row."""
    keys = ["identity_key", "report_month"]
    overlap = development.select(*keys).intersect(holdout.select(*keys)).agg(
        F.count("*").alias("overlap_rows")
    )
    dev = development.agg(F.max("report_month").alias("development_last"))
    held = holdout.agg(
        F.min("report_month").alias("holdout_first"), F.count("*").alias("holdout_rows")
    )
    one = F.lit(1).alias("k")
    status = (
        F.when(F.col("holdout_rows") == 0, "EMPTY_HOLDOUT")
        .when(F.col("development_last") > development_end, "DEVELOPMENT_BEYOND_BOUNDARY")
        .when(F.col("holdout_first") < holdout_start, "HOLDOUT_BEFORE_BOUNDARY")
        .when(F.col("overlap_rows") > 0, "OBSERVATION_OVERLAP")
        .otherwise("SEPARATED")
    )
    return (
        dev.select("*", one).join(held.select("*", one), "k").join(overlap.select("*", one), "k")
        .select("development_last", "holdout_first", "holdout_rows", "overlap_rows", status.alias("status"))
    )


def require_separation(
    development: DataFrame, holdout: DataFrame, development_end: str, holdout_start: str
) -> None:
    """Raise unless the holdout is non-empty, strictly later and disjoint."""
    status = holdout_separation(development, holdout, development_end, holdout_start).first()["status"]
    if status != "SEPARATED":
        raise ValueError(f"invalid holdout: {status}")


def endpoint_matching(
    existing: DataFrame, incoming: DataFrame, cutoff_month: str,
    target: str = "future_schedule_later_3m",
) -> DataFrame:
    """Match one cutoff month to an incoming month by exact identity, one row.

    Identities that occur more than once in the incoming month are ambiguous and do not
    match. Every count comes from one grouping by identity.
    """
    incoming_counts = incoming.groupBy("identity_key", "traceable").agg(F.count("*").alias("incoming_rows"))
    clean = incoming.join(
        incoming_counts.where(
            F.col("identity_key").isNotNull() & (F.col("incoming_rows") > 1)
        ).select("identity_key"),
        "identity_key", "left_anti",
    )
    cutoff = (
        existing.where(F.col("report_month") == cutoff_month)
        .groupBy("identity_key", "traceable")
        .agg(F.count("*").alias("cutoff_rows"))
    )
    found = clean.where("traceable").select("identity_key", F.lit(1).alias("found")).distinct()
    matched = cutoff.join(found, "identity_key", "left").agg(
        F.sum("cutoff_rows").alias("cutoff_observations"),
        F.countDistinct("identity_key").alias("cutoff_projects"),
        F.count_if(F.col("traceable") & F.col("found").isNotNull()).alias("matched_projects"),
        F.sum(F.when(F.col("found").isNotNull(), F.col("cutoff_rows")).otherwise(0)).alias("matched_observations"),
        F.count_if(F.col("traceable") & F.col("found").isNull()).alias("unmatched_projects"),
        F.sum(F.when(F.col("traceable") & F.col("found").isNull(), F.col("cutoff_rows")).otherwise(0)).alias(
            "unmatched_observations"
        ),
    )
    ambiguous = incoming_counts.agg(
        F.count_if(F.col("identity_key").isNotNull() & (F.col("incoming_rows") > 1)).alias("ambiguous_matches"),
        F.coalesce(F.sum(F.when(F.col("incoming_rows") > 1, F.col("incoming_rows"))), F.lit(0)).alias(
            "duplicate_matches"
        ),
    )
    mature = (
        label_table(existing.unionByName(clean.select(*existing.columns)), target)
        .where(F.col("prediction_month") == cutoff_month)
        .agg(
            F.count("*").alias("mature_observations"),
            F.countDistinct("identity_key").alias("mature_projects"),
            F.coalesce(F.sum("label"), F.lit(0)).alias("mature_events"),
        )
    )
    one = F.lit(1).alias("k")
    return (
        matched.select("*", one).join(ambiguous.select("*", one), "k").join(mature.select("*", one), "k")
        .drop("k")
        .withColumn(
            "maturity_coverage",
            F.round(F.when(F.col("cutoff_observations") > 0, F.col("mature_observations") / F.col("cutoff_observations")), 6),
        )
    )


def id_quality(panel: DataFrame) -> DataFrame:
    """Missing and malformed identities, and identities on more than one row."""
    identity = F.col("identity_key")
    well_formed = identity.rlike(TRACEABLE_ID)
    per_id = panel.groupBy("identity_key").agg(F.count("*").alias("n"))
    repeated = F.coalesce(well_formed, F.lit(False)) & (F.col("n") > 1)
    zero = F.lit(0)
    return per_id.agg(
        F.coalesce(F.sum(F.when(identity.isNull(), F.col("n"))), zero).alias("missing_ids"),
        F.coalesce(F.sum(F.when(~well_formed, F.col("n"))), zero).alias("malformed_ids"),
        F.coalesce(F.sum(F.when(repeated, F.col("n"))), zero).alias("duplicate_project_rows"),
        F.count_if(repeated).alias("duplicate_project_ids"),
    )


def schema_gate(spark: SparkSession, panel: DataFrame) -> DataFrame:
    """Missing and unexpected columns against the stored panel schema, one row."""
    missing = sorted(set(ENRICHED_COLUMNS) - set(panel.columns))
    unexpected = sorted(set(panel.columns) - set(ENRICHED_COLUMNS))
    # A derived row per column keeps the result tied to the given frame's schema.
    return spark.createDataFrame(
        [(not missing and not unexpected, ";".join(missing), ";".join(unexpected), len(panel.columns))],
        "schema_valid boolean, missing_columns string, unexpected_columns string, column_count int",
    )


def period_check(panel: DataFrame, month: str | Column, by: list[str] | None = None) -> DataFrame:
    """Whether the batch, or each one of ``by``, is non-empty and every row is in the expected month."""
    return panel.groupBy(*(by or [])).agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("report_month").isNull() | (F.col("report_month") != month)).alias("other_month_rows"),
        (
            (F.count("*") > 0)
            & (F.count_if(F.col("report_month").isNull() | (F.col("report_month") != month)) == 0)
        ).alias("reporting_period_valid"),
    )


def batch_gate(panel: DataFrame, month: str) -> DataFrame:
    """All checks of an incoming month and its VALID or INVALID verdict, one row.

    The batch is scanned once: rows are grouped by (identity, month) with partial
    aggregation, then reduced to one row.
    """
    missing = sorted(set(ENRICHED_COLUMNS) - set(panel.columns))
    unexpected = sorted(set(panel.columns) - set(ENRICHED_COLUMNS))
    schema_valid = F.lit(not missing and not unexpected)

    def present(name: str) -> Column:
        return F.col(name).cast("string") if name in panel.columns else F.lit(None).cast("string")

    bad_dates = sum(
        (F.count_if(present(c).isNotNull() & ~is_month_date(present(c))) for c in DATE_FIELDS), F.lit(0)
    )

    def invalid(name: str, extra: float | None = None) -> Column:
        text, number = present(name), present(name).try_cast("double")
        outside = number < 0 if extra is None else (number < 0) | (number > extra)
        return F.count_if(outside) + F.count_if(text.isNotNull() & number.isNull())

    per_key = panel.groupBy(present("identity_key").alias("id"), present("report_month").alias("m")).agg(
        F.count("*").alias("n"),
        bad_dates.alias("bad_dates"),
        (invalid("original_cost") + invalid("revised_cost") + invalid("expenditure")).alias("bad_numbers"),
        invalid("physical_progress", 100.0).alias("bad_progress"),
    )
    well_formed = F.coalesce(F.col("id").rlike(TRACEABLE_ID), F.lit(False))
    per_id = per_key.groupBy("id").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("repeated_in_month"),
        F.sum(F.when(F.col("m").isNull() | (F.col("m") != month), F.col("n")).otherwise(0)).alias("other_month"),
        F.sum("bad_dates").alias("bad_dates"),
        F.sum("bad_numbers").alias("bad_numbers"),
        F.sum("bad_progress").alias("bad_progress"),
    )

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0))

    checks = per_id.agg(
        total(F.col("n")).alias("rows"),
        total(F.when(F.col("id").isNull(), F.col("n"))).alias("missing_ids"),
        total(F.when(F.col("id").isNotNull() & ~well_formed, F.col("n"))).alias("malformed_ids"),
        total(F.when(well_formed & (F.col("n") > 1), F.col("n"))).alias("duplicate_project_rows"),
        F.count_if(well_formed & (F.col("n") > 1)).alias("duplicate_project_ids"),
        total(F.when(F.col("id").isNotNull(), F.col("repeated_in_month"))).alias("duplicate_project_month_rows"),
        total(F.col("other_month")).alias("other_month_rows"),
        total(F.col("bad_dates")).alias("malformed_dates"),
        total(F.col("bad_numbers")).alias("invalid_numeric_values"),
        total(F.col("bad_progress")).alias("impossible_progress_values"),
    )
    period_valid = (F.col("rows") > 0) & (F.col("other_month_rows") == 0)
    clean = schema_valid & period_valid
    for name in (
        "duplicate_project_rows", "malformed_ids", "duplicate_project_month_rows",
        "malformed_dates", "invalid_numeric_values", "impossible_progress_values",
    ):
        clean = clean & (F.col(name) == 0)
    return checks.select(
        schema_valid.alias("schema_valid"),
        F.lit(";".join(missing)).alias("missing_columns"),
        F.lit(";".join(unexpected)).alias("unexpected_columns"),
        "missing_ids", "malformed_ids", "duplicate_project_rows", "duplicate_project_ids",
        period_valid.alias("reporting_period_valid"), "duplicate_project_month_rows",
        "malformed_dates", "invalid_numeric_values", "impossible_progress_values",
        F.when(clean, "VALID").otherwise("INVALID").alias("validation_status"),
    )
