"""Reconciliation of the panel against independent monthly aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import effective_value, money, percent_difference

COST_NOTE = "national cost overview"
REVISED_NOTE = (
    "national cost overview; blank row revisions treated as original cost for comparison only"
)
NO_COST_NOTE = "no same-month cost aggregate"


def difference_status(pct: Column, available: Column) -> Column:
    """Status ladder over the % difference."""
    return (
        F.when(~available, "UNAVAILABLE_TO_VALIDATE")
        .when(pct.isNull(), "WARNING")
        .when(pct <= 1, "PASS")
        .when(pct <= 5, "EXPECTED_DIFFERENCE")
        .when(pct <= 20, "WARNING")
        .otherwise("ERROR")
    )


def monthly_totals(panel: DataFrame) -> DataFrame:
    """Panel totals per month; a total is null when every value is missing."""
    effective = effective_value(F.col("revised_cost"), F.col("original_cost"))
    return panel.groupBy("report_month").agg(
        F.sum(money(F.col("original_cost"))).cast("double").alias("original_cost"),
        F.sum(money(F.col("expenditure"))).cast("double").alias("expenditure"),
        F.sum(money(F.col("revised_cost"))).cast("double").alias("printed_revised_cost"),
        F.sum(money(effective)).cast("double").alias("effective_revised_cost"),
        F.count("*").alias("rows"),
    )


def _count_totals(counts: DataFrame, name: str) -> DataFrame:
    return counts.groupBy("report_month").agg(
        F.sum("project_count").cast("double").alias(name), F.lit(True).alias(f"has_{name}")
    )


def cross_validate(
    panel: DataFrame, costs: DataFrame, states: DataFrame, sectors: DataFrame
) -> DataFrame:
    """Five checks per month in long form, each with its % difference and status.

    Every input is reduced to one row per month before the joins.
    """
    overview = costs.select(
        "report_month",
        F.col("original_cost_crores").cast("double").alias("expected_original"),
        F.col("revised_cost_crores").cast("double").alias("expected_revised"),
        F.col("expenditure_crores").cast("double").alias("expected_expenditure"),
        F.lit(True).alias("has_costs"),
    )
    joined = (
        monthly_totals(panel)
        .join(overview, "report_month", "left")
        .join(_count_totals(states, "state_total"), "report_month", "left")
        .join(_count_totals(sectors, "sector_total"), "report_month", "left")
    )
    has_costs = F.col("has_costs").isNotNull()
    rows = F.col("rows").cast("double")

    def check(metric, actual, expected, available, note) -> Column:
        return F.struct(
            F.lit(metric).alias("metric"), actual.alias("panel_value"),
            expected.alias("aggregate_value"), available.alias("available"), note.alias("note"),
        )

    def cost_note(text: str) -> Column:
        return F.when(has_costs, text).otherwise(NO_COST_NOTE)

    def count_note(available: Column, field: str) -> Column:
        return F.when(
            available, f"sum of {field} aggregate counts; may be non-additive"
        ).otherwise(f"no same-month {field} aggregate")

    revised = F.when(has_costs, F.col("effective_revised_cost")).otherwise(F.col("printed_revised_cost"))
    has_state = F.col("has_state_total").isNotNull()
    has_sector = F.col("has_sector_total").isNotNull()
    checks = F.array(
        check("original_cost", F.col("original_cost"), F.col("expected_original"), has_costs, cost_note(COST_NOTE)),
        check("expenditure", F.col("expenditure"), F.col("expected_expenditure"), has_costs, cost_note(COST_NOTE)),
        check("revised_cost", revised, F.col("expected_revised"), has_costs, cost_note(REVISED_NOTE)),
        check("state_project_count", rows, F.col("state_total"), has_state, count_note(has_state, "state")),
        check("sector_project_count", rows, F.col("sector_total"), has_sector, count_note(has_sector, "sector")),
    )
    pct = percent_difference(F.col("panel_value"), F.col("aggregate_value"))
    return (
        joined.select("report_month", F.explode(checks).alias("c"))
        .select("report_month", "c.*")
        .withColumn("pct_difference", pct)
        .select(
            "report_month", "metric", "panel_value", "aggregate_value",
            F.round("pct_difference", 6).alias("pct_difference"),
            difference_status(F.col("pct_difference"), F.col("available")).alias("status"),
            "note",
        )
    )


def status_counts(checks: DataFrame) -> DataFrame:
    """Checks per status."""
    return checks.groupBy("status").agg(F.count("*").alias("checks"))
