"""Risk events, change events and the change feed, from latest against previous snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import js_round
from .portfolio import (
    cost_growth,
    cost_signal,
    latest_pairs,
    latest_view,
    level_rank,
    schedule_signal,
    spend_share,
)

EVENT_TYPES = ("elevated", "cost", "schedule", "progress", "improvement")  # fixed values, by priority
EXPECTED_PROGRESS = 3  # fixed value
FEED_SIZE = 12  # fixed value


def _signed(points: Column, unit: str) -> Column:
    sign = F.when(points > 0, "+").otherwise("")
    return F.concat(sign, points.cast("string"), F.lit(unit))


def _number(value: Column) -> Column:
    """Whole numbers without decimals, others with two."""
    return F.when(
        value == F.floor(value), F.floor(value).cast("string")
    ).otherwise(value.cast("decimal(18,2)").cast("string"))


def _with_deltas(snapshots: DataFrame) -> DataFrame:
    """Entities that have a previous snapshot, with the changes since it."""
    c = F.col
    return (
        latest_pairs(snapshots)
        .where(c("previous_risk_score").isNotNull())
        .withColumns(
            {
                "score_delta": c("risk_score") - c("previous_risk_score"),
                "level_change": level_rank(c("risk_level")) - level_rank(c("previous_risk_level")),
                "cost_delta": c("revised_cost") - c("previous_revised_cost"),
                "cost_pct": js_round(cost_growth() * 100),
                "delay_delta": c("delay_months") - c("previous_delay_months"),
                "progress_delta": c("physical_progress") - c("previous_physical_progress"),
                "end_moved": c("revised_completion") != c("previous_revised_completion"),
            }
        )
    )


def risk_events(snapshots: DataFrame) -> DataFrame:
    """elevated, improved or stable for every entity with a previous snapshot."""
    score, level = F.col("score_delta"), F.col("level_change")
    kind = (
        F.when((level > 0) | (score > 2), "elevated")
        .when((level < 0) | (score < -2), "improved")
        .otherwise("stable")
    )
    return _with_deltas(snapshots).select(
        "project_id", "name", kind.alias("kind"),
        F.col("previous_risk_level").alias("from_level"), F.col("risk_level").alias("to_level"),
        "score_delta", F.col("risk_signal").alias("reason"), F.col("month").alias("date"),
    )


def newly_elevated(snapshots: DataFrame) -> DataFrame:
    """Elevated entities now at High or above, or up by six points or more."""
    return (
        risk_events(snapshots)
        .where(
            (F.col("kind") == "elevated")
            & ((level_rank(F.col("to_level")) >= 2) | (F.col("score_delta") >= 6))
        )
        .select(
            "project_id", "name", _signed(F.col("score_delta"), " pts").alias("change"),
            "from_level", "to_level", "reason",
        )
    )


def _elevated(view_change: Column, trend: Column) -> Column:
    jumped = (F.col("level_change") > 0) | ((F.col("score_delta") > 2) & (F.col("risk_score") >= 65))
    return F.coalesce(jumped, F.lit(False)) | ((trend == "up") & (view_change > 0))


def risk_projects(snapshots: DataFrame) -> DataFrame:
    """Latest view with the previous level, the elevated flags and the attention reason."""
    deltas = _with_deltas(snapshots).select(
        "project_id", "score_delta", "level_change", F.col("previous_risk_level").alias("from_level")
    )
    jumped = (F.col("level_change") > 0) | ((F.col("score_delta") > 2) & (F.col("risk_score") >= 65))
    return (
        latest_view(snapshots)
        .join(deltas, "project_id", "left")
        .withColumns(
            {
                "elevated": F.coalesce(jumped, F.lit(False)),
                "in_elevated_set": _elevated(F.col("risk_change"), F.col("trend")),
                "attention_reason": F.col("primary_signal"),
            }
        )
        .drop("score_delta", "level_change")
    )


def elevated_set(snapshots: DataFrame) -> DataFrame:
    """Entities the monitor lists as elevated."""
    return risk_projects(snapshots).where("in_elevated_set")


def change_events(snapshots: DataFrame) -> DataFrame:
    """Up to five events per entity, with type, title, magnitude and detail."""
    c = F.col
    stagnant = c("progress_delta") <= 0

    def event(test: Column, kind: str, title: Column, magnitude: Column, detail: Column) -> Column:
        return F.when(
            test,
            F.struct(
                F.lit(kind).alias("type"), title.alias("title"),
                magnitude.alias("magnitude"), detail.alias("detail"),
            ),
        )

    events = F.array(
        event(
            (c("level_change") > 0) | (c("score_delta") >= 6), "elevated",
            F.concat(F.lit("Newly elevated to "), c("risk_level")),
            _signed(c("score_delta"), " pts"), c("risk_signal"),
        ),
        event(
            (c("cost_delta") > 50) | ((c("cost_pct") >= 15) & (c("cost_delta") > 0)), "cost",
            F.lit("Cost revision recorded"),
            F.concat(F.lit("+"), c("cost_pct").cast("string"), F.lit("%")),
            F.concat(F.lit("Revised cost moved to ₹"), _number(c("revised_cost")), F.lit(" Cr")),
        ),
        event(
            (c("delay_delta") > 0) | c("end_moved"), "schedule",
            F.lit("Schedule deterioration"),
            F.when(c("delay_delta") > 0, F.concat(F.lit("+"), c("delay_delta").cast("string"), F.lit(" months")))
            .otherwise(c("revised_completion")),
            F.concat(F.lit("Completion revised to "), c("revised_completion")),
        ),
        event(
            c("progress_delta") < EXPECTED_PROGRESS, "progress",
            F.when(stagnant, "Progress stagnation").otherwise("Progress slowdown detected"),
            F.when(stagnant, "0 pts MoM").otherwise(
                F.concat(F.lit("−"), _number(EXPECTED_PROGRESS - c("progress_delta")), F.lit(" pts vs plan"))
            ),
            F.when(stagnant, "No measured physical progress this period").otherwise(
                "Monthly physical progress below plan"
            ),
        ),
        event(
            (c("score_delta") < -2) | (c("level_change") < 0), "improvement",
            F.lit("Notable improvement"),
            F.concat(c("score_delta").cast("string"), F.lit(" pts")),
            F.lit("Risk score declining vs previous month"),
        ),
    )
    return (
        _with_deltas(snapshots)
        .select("project_id", "name", c("month").alias("date"), F.explode(events).alias("e"))
        .where(F.col("e").isNotNull())
        .select("project_id", "name", "date", "e.*")
        .withColumn("priority", type_priority(F.col("type")))
    )


def type_priority(kind: Column) -> Column:
    """0 for elevated up to 4 for improvement."""
    return F.array_position(F.array(*[F.lit(t) for t in EVENT_TYPES]), kind).cast("int") - 1


def change_feed(snapshots: DataFrame, size: int = FEED_SIZE) -> DataFrame:
    """Best event per entity, plus the first event of every type left out, best first (top-k).

    Entities are taken in id order inside a type. The first stage keeps one event per
    entity; only five rows, the first event of each type, are looked at globally.
    """
    events = change_events(snapshots)
    best = events.groupBy("project_id").agg(
        F.min_by(F.struct(*events.columns), "priority").alias("e")
    ).select("e.*")
    present = best.select("type").distinct()
    first_of_type = events.groupBy("type").agg(
        F.min_by(F.struct(*[c for c in events.columns if c != "type"]), "project_id").alias("e")
    ).select("type", "e.*")
    extra = first_of_type.join(present, "type", "left_anti").select(*events.columns)
    return (
        best.select(F.lit(0).alias("added"), *events.columns)
        .unionByName(extra.select(F.lit(1).alias("added"), *events.columns))
        .orderBy("priority", "added", "project_id")
        .limit(size)
        .drop("added")
    )


def change_summaries(snapshots: DataFrame) -> DataFrame:
    """Newly elevated entities, and all cost, schedule and improvement events of the latest month."""
    def labelled(frame: DataFrame, label: str, test: Column) -> DataFrame:
        return frame.agg(F.count_if(test).alias("projects")).withColumn("summary", F.lit(label))

    kind = F.col("type")
    counts = change_events(snapshots).agg(
        F.array(
            F.struct(F.lit("cost escalation signals").alias("summary"), F.count_if(kind == "cost").alias("projects")),
            F.struct(F.lit("schedule deterioration signals").alias("summary"), F.count_if(kind == "schedule").alias("projects")),
            F.struct(F.lit("projects improved").alias("summary"), F.count_if(kind == "improvement").alias("projects")),
        ).alias("rows")
    ).select(F.explode("rows").alias("r")).select("r.summary", "r.projects")
    elevated = labelled(newly_elevated(snapshots), "projects newly elevated", F.lit(True))
    return elevated.select("summary", "projects").unionByName(counts)


def overview_kpis(snapshots: DataFrame) -> DataFrame:
    """Totals, percentages, signal counts and the risk pulse, one row."""
    money = "decimal(18,2)"
    rows = risk_projects(snapshots)
    up = (F.col("risk_change") > 2) | (F.col("level_rank") > F.col("from_rank"))
    newly = F.coalesce(up & ((F.col("level_rank") >= 2) | (F.col("risk_change") >= 6)), F.lit(False))
    at_risk = F.col("risk").isin("High", "Critical")
    totals = rows.withColumns(
        {"level_rank": level_rank(F.col("risk")), "from_rank": level_rank(F.col("from_level"))}
    ).agg(
        F.count("*").alias("total_projects"),
        F.sum(F.col("revised_cost").cast(money)).cast("double").alias("revised_cost"),
        F.sum(F.col("original_cost").cast(money)).cast("double").alias("original_cost"),
        F.sum(F.col("expenditure").cast(money)).cast("double").alias("expenditure"),
        F.count_if(at_risk).alias("at_risk"),
        F.count_if(schedule_signal() != "on_plan").alias("delay_signals"),
        F.count_if(cost_signal() != "within").alias("cost_signals"),
        F.count_if("in_elevated_set").alias("elevated"),
        F.count_if(F.col("trend") == "stable").alias("stable"),
        F.count_if(F.col("trend") == "down").alias("improving"),
        F.count_if(newly).alias("newly_elevated"),
    )
    cost_pct = F.when(
        F.col("original_cost") != 0,
        F.floor((F.col("revised_cost") / F.col("original_cost") - 1) * 100 * 10 + 0.5) / 10,
    ).otherwise(F.lit(0.0))
    spend_pct = F.when(
        F.col("revised_cost") != 0, F.floor(F.col("expenditure") / F.col("revised_cost") * 1000 + 0.5) / 10
    ).otherwise(F.lit(0.0))
    return totals.withColumns({"cost_pct": cost_pct, "spend_pct": spend_pct})


# Portfolio anomaly ids and labels.
PORTFOLIO_ANOMALIES = (
    ("a1", "High expenditure / low progress"),
    ("a2", "Rapid cost escalation"),
    ("a3", "Schedule deterioration"),
    ("a4", "Progress stagnation"),
)


def anomaly_members(snapshots: DataFrame) -> DataFrame:
    """(anomaly, project) pairs; stagnation lists all entities with a progress event.

    Members stay rows, so an anomaly that holds most entities needs no single list.
    """
    view = latest_view(snapshots)
    tests = {
        "a1": (spend_share() > 0.55) & (F.col("progress") < 50),
        "a2": cost_growth() > 0.15,
        "a3": (F.col("delay_months") > 6) & (F.col("risk_change") > 0),
    }
    found = F.filter(
        F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]), lambda x: x.isNotNull()
    )
    members = view.select(F.explode(found).alias("anomaly"), "project_id")
    stagnant = (
        change_events(snapshots).where(F.col("type") == "progress").select("project_id").distinct()
        .join(view.select("project_id"), "project_id", "left_semi")
        .select(F.lit("a4").alias("anomaly"), "project_id")
    )
    return members.unionByName(stagnant)


def portfolio_anomalies(snapshots: DataFrame) -> DataFrame:
    """Count per anomaly, anomalies without members included."""
    members = anomaly_members(snapshots)
    wide = members.agg(
        *[F.count_if(F.col("anomaly") == a).alias(a) for a, _ in PORTFOLIO_ANOMALIES]
    )
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("anomaly"), F.lit(label).alias("label"), F.col(a).alias("projects"))
            for a, label in PORTFOLIO_ANOMALIES
        ]
    )
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def monitor_sections(snapshots: DataFrame, watched: DataFrame) -> DataFrame:
    """Entities per monitor section: all, elevated, review, critical, watchlist."""
    marked = risk_projects(snapshots).join(
        watched.select("project_id", F.lit(True).alias("watched")).distinct(), "project_id", "left"
    )
    review = F.col("risk").isin("High", "Medium") & (F.col("trend") != "down")
    wide = marked.agg(
        F.count("*").alias("all"),
        F.count_if("in_elevated_set").alias("elevated"),
        F.count_if(review).alias("review"),
        F.count_if(F.col("risk") == "Critical").alias("critical"),
        F.count("watched").alias("watchlist"),
    )
    names = ("all", "elevated", "review", "critical", "watchlist")
    rows = F.array(*[F.struct(F.lit(n).alias("section"), F.col(n).alias("projects")) for n in names])
    return wide.select(F.explode(rows).alias("r")).select("r.*")
