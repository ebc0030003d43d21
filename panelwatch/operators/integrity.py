"""Longitudinal anomalies: flagged, never repaired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.months import month_label, month_number
from ..functions.text import clean_text, is_report_date
from ..sources.panel import DATE_FIELDS

DECREASING = ("expenditure", "physical_progress", "original_cost", "revised_cost")
KEPT = "Source value retained unchanged; decrease is not treated as an error."
GAP = "Missing between observed months; not interpreted as completion."
RAW = "Raw source value retained unchanged."


def amount_text(value: Column) -> Column:
    """Two-decimal text, so values of different types share one column."""
    return value.cast("decimal(18,2)").cast("string")


def decreases(panel: DataFrame, key: str = "identity_key") -> DataFrame:
    """Observations lower than the entity's previous observation, for four measures.

    The comparison is with the previous row: when that row has no value, nothing is
    flagged.
    """
    by_entity = Window.partitionBy(key).orderBy("report_month")
    previous = {f"previous_{c}": F.lag(c).over(by_entity) for c in DECREASING}
    flagged = F.filter(
        F.array(
            *[
                F.when(
                    F.col(c) < F.col(f"previous_{c}"),
                    F.struct(
                        F.lit(c).alias("field"),
                        F.col(f"previous_{c}").alias("previous_value"),
                        F.col(c).alias("current_value"),
                    ),
                )
                for c in DECREASING
            ]
        ),
        lambda x: x.isNotNull(),
    )
    return (
        panel.where(F.col(key).isNotNull())
        .withColumns(previous)
        .select("*", F.explode(flagged).alias("change"))
        .select(
            key, "report_month", "source_file", "source_page",
            "change.field", "change.previous_value", "change.current_value",
            F.lit("DECREASE_REQUIRES_REVIEW").alias("flag"),
        )
    )


def reappearances(panel: DataFrame, key: str = "identity_key") -> DataFrame:
    """Entities absent from report months that lie between their first and last row.

    Only a jump between consecutive observations is expanded, and it is matched to the
    published months by equality; no entity-by-month grid is built.
    """
    by_entity = Window.partitionBy(key).orderBy("report_month")
    published = panel.select(F.col("report_month").alias("missing_month")).distinct()
    number = month_number(F.col("report_month"))
    jumps = (
        panel.where(F.col(key).isNotNull())
        .select(key, number.alias("n"), F.lag(number).over(by_entity).alias("before"))
        .where("n - before > 1")
        .select(key, F.explode(F.sequence(F.col("before") + 1, F.col("n") - 1)).alias("m"))
        .withColumn("missing_month", month_label(F.col("m")))
    )
    missing = (
        jumps.join(published, "missing_month")
        .groupBy(key)
        .agg(F.array_join(F.sort_array(F.collect_set("missing_month")), ";").alias("missing_months"))
    )
    last_row = F.struct("report_month", "source_file", "source_page")
    span = (
        panel.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.min("report_month").alias("first_month"),
            F.max(last_row).alias("last"),
        )
    )
    return missing.join(span, key).select(
        key, "first_month", F.col("last.report_month").alias("last_month"), "missing_months",
        F.col("last.source_file").alias("source_file"), F.col("last.source_page").alias("source_page"),
        F.lit("DISAPPEARED_AND_REAPPEARED_REQUIRES_REVIEW").alias("flag"),
    )


def _row_findings(panel: DataFrame, findings: list[Column]) -> DataFrame:
    found = F.filter(F.array(*findings), lambda x: x.isNotNull())
    return panel.select("*", F.explode(found).alias("finding")).select(
        "report_month",
        F.coalesce("project_code", "legacy_ocms_code", F.lit("")).alias("project_id"),
        "finding.anomaly_type", "finding.value", F.lit("").alias("previous_value"),
        "finding.severity", "source_file", "source_page", F.lit(RAW).alias("notes"),
    )


def _finding(test: Column, kind: str, value: Column, severity: str) -> Column:
    return F.when(
        test,
        F.struct(
            F.lit(kind).alias("anomaly_type"), value.alias("value"), F.lit(severity).alias("severity")
        ),
    )


def range_anomalies(panel: DataFrame) -> DataFrame:
    """Negative expenditure and progress outside 0-100."""
    spend, progress = F.col("expenditure"), F.col("physical_progress")
    return _row_findings(
        panel,
        [
            _finding(spend < 0, "NEGATIVE_EXPENDITURE", amount_text(spend), "HIGH"),
            _finding(
                (progress < 0) | (progress > 100), "PROGRESS_OUT_OF_RANGE", amount_text(progress), "HIGH"
            ),
        ],
    )


def malformed_dates(panel: DataFrame) -> DataFrame:
    """Non-blank date fields that are neither MM/YYYY nor a full date."""
    findings = []
    for name in DATE_FIELDS:
        text = clean_text(F.col(name))
        findings.append(
            _finding(
                (text != "") & ~is_report_date(text), f"MALFORMED_DATE_{name.upper()}", text, "REVIEW"
            )
        )
    return _row_findings(panel, findings)


def anomalies(panel: DataFrame) -> DataFrame:
    """All anomaly kinds in one long table, keyed by whichever source identifier exists."""
    keyed = panel.withColumn("project_id", F.coalesce("project_code", "legacy_ocms_code"))
    drops = decreases(keyed, "project_id").select(
        "report_month", "project_id",
        F.concat(F.lit("DECREASE_"), F.upper("field")).alias("anomaly_type"),
        amount_text(F.col("current_value")).alias("value"),
        amount_text(F.col("previous_value")).alias("previous_value"),
        F.lit("REVIEW").alias("severity"), "source_file", "source_page", F.lit(KEPT).alias("notes"),
    )
    gaps = reappearances(keyed, "project_id").select(
        F.col("last_month").alias("report_month"), "project_id",
        F.lit("DISAPPEAR_REAPPEAR").alias("anomaly_type"),
        F.col("missing_months").alias("value"), F.lit("").alias("previous_value"),
        F.lit("REVIEW").alias("severity"), "source_file", "source_page", F.lit(GAP).alias("notes"),
    )
    return (
        drops.unionByName(gaps)
        .unionByName(range_anomalies(panel))
        .unionByName(malformed_dates(panel))
    )


def _as_long(row: DataFrame) -> DataFrame:
    names = row.columns
    pairs = F.array(
        *[F.struct(F.lit(n).alias("statistic"), F.col(n).cast("long").alias("value")) for n in names]
    )
    return row.select(F.explode(pairs).alias("p")).select("p.statistic", "p.value")


def integrity_stats(panel: DataFrame) -> DataFrame:
    """Panel-wide integrity counts in long form (statistic, value)."""
    progress = F.col("physical_progress")
    base = panel.agg(
        F.count("*").alias("total_rows"),
        F.countDistinct("project_code").alias("unique_primary_codes"),
        F.countDistinct("identity_key").alias("unique_safe_tracking_keys"),
        F.count_if(F.col("project_code").isNull()).alias("no_primary_code"),
        F.count_if((progress < 0) | (progress > 100)).alias("out_of_range"),
        F.count_if(F.col("expenditure") < 0).alias("negative_expenditure"),
        (F.count_if(F.col("original_cost") < 0) + F.count_if(F.col("revised_cost") < 0)).alias(
            "negative_cost"
        ),
    )
    depth = (
        panel.where(F.col("identity_key").isNotNull())
        .groupBy("identity_key")
        .agg(F.countDistinct("report_month").alias("months"))
        .agg(
            F.count_if(F.col("months") == 1).alias("one_month"),
            F.count_if(F.col("months") >= 2).alias("two_plus"),
            F.count_if(F.col("months") >= 6).alias("six_plus"),
            F.count_if(F.col("months") >= 12).alias("twelve_plus"),
        )
    )
    duplicates = (
        panel.where(F.col("project_code").isNotNull())
        .groupBy("report_month", "project_code")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicates"))
    )
    drops = decreases(panel).agg(F.count("*").alias("decreases"))
    gaps = reappearances(panel).agg(F.count("*").alias("reappearing"))
    result = _as_long(base)
    for part in (depth, duplicates, drops, gaps):
        result = result.unionByName(_as_long(part))
    return result
