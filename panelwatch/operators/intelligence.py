"""Per-entity intelligence: trajectory, drivers, events, checklist and outlook."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import js_round
from .changes import _number
from .portfolio import cost_growth, cost_signal, latest_pairs, latest_view, schedule_signal, spend_share


def trajectory(snapshots: DataFrame) -> DataFrame:
    """Per month: progress, spend %, planned progress (at most 95), cost %, delay and risk."""
    ahead = Window.partitionBy("project_id").orderBy("month_number").rowsBetween(1, Window.unboundedFollowing)
    remaining = F.count(F.lit(1)).over(ahead)
    return snapshots.select(
        "project_id", "month",
        F.col("physical_progress").alias("physical"),
        js_round(spend_share() * 100).alias("expenditure"),
        F.least(F.lit(95), js_round(F.col("physical_progress") + remaining * 2 + 8)).alias("planned"),
        js_round(cost_growth() * 100).alias("cost_change"),
        F.col("delay_months").alias("schedule_change"),
        "risk_score",
    )


def driver_contributions(snapshots: DataFrame) -> DataFrame:
    """Schedule, cost and progress contributions, ranked per entity.

    Equal values keep the order schedule, cost, progress.
    """
    c = F.col
    cost_pct = js_round(cost_growth() * 100)
    spend = js_round(spend_share() * 100)
    moved = F.coalesce(c("physical_progress") - c("previous_physical_progress"), F.lit(0.0))
    slow = moved <= 1

    def driver(position: int, label: Column, value: Column, magnitude: Column) -> Column:
        return F.struct(
            (-value.cast("double")).alias("order_value"), F.lit(position).alias("position"),
            label.alias("label"), value.cast("double").alias("value"), magnitude.alias("magnitude"),
        )

    delay = c("delay_months")
    drivers = F.array(
        driver(
            1, F.lit("Schedule deterioration"), F.least(F.lit(40), 12 + delay * 2),
            F.concat(F.lit("+"), delay.cast("string"), F.lit(" months")),
        ),
        driver(
            2, F.lit("Cost escalation"), F.least(F.lit(40), F.greatest(F.lit(8), cost_pct)),
            F.concat(F.lit("+"), cost_pct.cast("string"), F.lit("%")),
        ),
        driver(
            3, F.when(slow, "Slow progress").otherwise("Expenditure / progress gap"),
            F.least(F.lit(30.0), F.greatest(F.lit(10.0), spend - c("physical_progress"))),
            F.when(slow, F.concat(_number(moved), F.lit(" pts MoM"))).otherwise(
                F.concat(
                    F.lit("Spend "), spend.cast("string"), F.lit("% · Progress "),
                    _number(c("physical_progress")), F.lit("%"),
                )
            ),
        ),
    )
    return (
        latest_pairs(snapshots)
        .select("project_id", F.posexplode(F.array_sort(drivers)).alias("position", "d"))
        .select(
            "project_id", (F.col("position") + 1).alias("rank"),
            "d.label", F.round("d.value", 2).alias("value"), "d.magnitude",
        )
    )


def project_events(snapshots: DataFrame) -> DataFrame:
    """Conditional events of each entity that has a previous snapshot.

    An entity without any event gets a reassessment event.
    """
    c = F.col
    level_moved = c("risk_level") != c("previous_risk_level")

    def event(test: Column, name: str, title: Column, detail: Column) -> Column:
        return F.when(
            test, F.struct(F.lit(name).alias("event"), title.alias("title"), detail.alias("detail"))
        )

    candidates = F.array(
        event(
            level_moved | (c("risk_score") - c("previous_risk_score") >= 6), "e1",
            F.when(c("risk_level") == "Critical", "Risk elevated to Critical").otherwise("Risk elevated"),
            F.concat(
                F.lit("Moved from "), c("previous_risk_level"), F.lit(" to "), c("risk_level"), F.lit(" ("),
                c("previous_risk_score").cast("string"), F.lit(" → "), c("risk_score").cast("string"), F.lit(")."),
            ),
        ),
        event(
            (c("revised_completion") != c("previous_revised_completion"))
            | (c("delay_months") > c("previous_delay_months")),
            "e2", F.lit("Schedule revised"),
            F.concat(F.lit("Target completion moved to "), c("revised_completion"), F.lit(".")),
        ),
        event(
            c("revised_cost") > c("previous_revised_cost"), "e3", F.lit("Cost revision recorded"),
            F.concat(F.lit("Revised cost increased to ₹"), _number(c("revised_cost")), F.lit(" Cr.")),
        ),
        event(
            c("physical_progress") - c("previous_physical_progress") < 3, "e4",
            F.lit("Progress slowdown detected"), F.lit("Monthly physical progress below recovery plan."),
        ),
    )
    found = F.filter(candidates, lambda e: e.isNotNull())
    fallback = F.array(
        F.struct(
            F.lit("e1").alias("event"), F.lit("Monthly risk reassessment").alias("title"),
            F.concat(F.lit("Updated risk position for "), c("name"), F.lit(".")).alias("detail"),
        )
    )
    return (
        latest_pairs(snapshots)
        .where(c("previous_risk_score").isNotNull())
        .select("project_id", "month", F.explode(F.when(F.size(found) > 0, found).otherwise(fallback)).alias("e"))
        .select("project_id", "month", "e.*")
    )


def attention_checklist(view: DataFrame, items: int = 3) -> DataFrame:
    """The first checklist items that apply to each entity (at most three by definition)."""

    def item(test: Column, name: str, title: str, detail: Column) -> Column:
        return F.when(
            test, F.struct(F.lit(name).alias("item"), F.lit(title).alias("title"), detail.alias("detail"))
        )

    always = F.lit(True)
    candidates = F.array(
        item(always, "a1", "Review primary signal", F.col("primary_signal")),
        item(
            schedule_signal() != "on_plan", "a2", "Review schedule recovery plan",
            F.lit("Validate contractor recovery milestones before next review."),
        ),
        item(
            cost_signal() != "within", "a3", "Investigate cost escalation",
            F.lit("Compare revised quantities against approved estimate."),
        ),
        item(
            always, "a4", "Monitor next reporting period",
            F.lit("Watch for further deterioration before escalation."),
        ),
    )
    kept = F.slice(F.filter(candidates, lambda x: x.isNotNull()), 1, items)
    return (
        view.select("project_id", F.posexplode(kept).alias("position", "x"))
        .select("project_id", (F.col("position") + 1).alias("position"), "x.*")
    )


def outlook(snapshots: DataFrame) -> DataFrame:
    """Improving, Deteriorating or Stable, the next progress target and the signal text."""
    change = F.col("risk_change")
    sign = F.when(change > 0, "+").otherwise("")
    return latest_view(snapshots).select(
        "project_id",
        F.when(change < -2, "Improving").when(change > 2, "Deteriorating").otherwise("Stable").alias("outlook"),
        F.least(F.col("progress") + 8, F.lit(95.0)).alias("target_progress"),
        "primary_signal",
        F.concat(F.lit("Risk change "), sign, change.cast("string"), F.lit(" pts")).alias("change_signal"),
    )


def signal_history(snapshots: DataFrame) -> DataFrame:
    """Risk, cost, schedule and progress of every month of every entity."""
    return trajectory(snapshots).select(
        "project_id", "month", F.col("risk_score").alias("risk"), F.col("cost_change").alias("cost"),
        F.col("schedule_change").alias("schedule"), F.col("physical").alias("progress"),
    )
