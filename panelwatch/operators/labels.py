"""Forward-window labels with an explicit UNKNOWN state.

A label for month T with horizon h exists only when the same entity has a row at
exactly T+h; otherwise the value is null (wide form) or the row is absent (long form).
Nulls are never turned into zeros.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.months import month_label, month_text
from ..sources.panel import checked_unique, traceable
from .features import COST_TOLERANCE, build_features


@dataclass(frozen=True)
class Target:
    name: str
    horizon: int
    kind: str


# Target names, horizons in months and outcome kinds.
TARGETS = (
    Target("future_schedule_later_3m", 3, "schedule_later"),
    Target("future_schedule_later_6m", 6, "schedule_later"),
    Target("future_schedule_revision_3m", 3, "schedule_change"),
    Target("future_overdue_active_3m", 3, "overdue_active"),
    Target("future_cost_increase_3m", 3, "cost_increase"),
    Target("future_cost_increase_6m", 6, "cost_increase"),
    Target("future_cost_increase_5pct_6m", 6, "cost_increase_5pct"),
    Target("future_cost_overrun_onset_10pct_6m", 6, "cost_overrun_onset"),
)
TARGET_NAMES = tuple(t.name for t in TARGETS)
ONSET_RATIO = 1.10


def _ahead(first: int, last: int):
    return Window.partitionBy("identity_key").orderBy("month_number").rangeBetween(first, last)


def _outcome(target: Target) -> Column:
    """Boolean outcome, null where the source rules leave it UNKNOWN."""
    h = target.horizon
    window, endpoint = _ahead(1, h), _ahead(h, h)
    end, cost, original = F.col("effective_end"), F.col("effective_cost"), F.col("original_cost")
    if target.kind in ("schedule_later", "schedule_change"):
        later = F.max(end).over(window) > end
        outcome = later if target.kind == "schedule_later" else later | (F.min(end).over(window) < end)
        known = end.isNotNull() & (F.count(end).over(endpoint) > 0)
    elif target.kind == "overdue_active":
        outcome = end < F.col("month_number") + h
        known = end.isNotNull() & (F.count(F.lit(1)).over(endpoint) > 0)
    elif target.kind in ("cost_increase", "cost_increase_5pct"):
        factor = 1.05 if target.kind == "cost_increase_5pct" else 1.0
        outcome = F.max(cost).over(window) > cost * factor + COST_TOLERANCE
        known = (cost > 0) & (F.count(cost).over(endpoint) > 0)
    else:
        ratio = F.when(original > 0, cost / original)
        outcome = F.coalesce(F.max(ratio).over(window) > ONSET_RATIO, F.lit(False))
        known = (ratio <= ONSET_RATIO) & (F.count(F.lit(1)).over(endpoint) > 0)
    return F.when(known, outcome.cast("int"))


def with_labels(panel: DataFrame, names: tuple[str, ...] = TARGET_NAMES) -> DataFrame:
    """Traceable rows with one nullable 0/1 column per target, in one pass."""
    chosen = {t.name: _outcome(t) for t in TARGETS if t.name in names}
    return checked_unique(traceable(panel)).withColumns(chosen)


def label_table(panel: DataFrame, name: str) -> DataFrame:
    """(identity_key, prediction_month, label) of one target, UNKNOWN rows absent."""
    return with_labels(panel, (name,)).where(F.col(name).isNotNull()).select(
        "identity_key", F.col("report_month").alias("prediction_month"), F.col(name).alias("label")
    )


def supervised_table(panel: DataFrame, name: str) -> DataFrame:
    """Features and one known label per row, built in a single shuffle."""
    return build_features(with_labels(panel, (name,)), keep=(name,)).where(F.col(name).isNotNull())


def endpoint_presence(panel: DataFrame, horizon: int) -> DataFrame:
    """Whether each traceable row has a row exactly ``horizon`` months later."""
    return checked_unique(traceable(panel)).select(
        "identity_key", F.col("report_month").alias("prediction_month"),
        (F.count(F.lit(1)).over(_ahead(horizon, horizon)) > 0).alias("endpoint_observed"),
    )


def label_accounting(panel: DataFrame) -> DataFrame:
    """Eligible, positive, negative and unknown rows per target, untraceable included."""
    labelled = with_labels(panel)
    per_entity = labelled.groupBy("identity_key").agg(
        F.count("*").alias("n"),
        *[F.count(t).alias(f"{t}__known") for t in TARGET_NAMES],
        *[F.sum(t).alias(f"{t}__positive") for t in TARGET_NAMES],
    )
    totals = per_entity.agg(
        F.sum("n").alias("n"),
        *[F.sum(f"{t}__known").alias(f"{t}__known") for t in TARGET_NAMES],
        *[F.coalesce(F.sum(f"{t}__positive"), F.lit(0)).alias(f"{t}__positive") for t in TARGET_NAMES],
        *[F.count_if(F.col(f"{t}__known") > 0).alias(f"{t}__entities") for t in TARGET_NAMES],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(t.name).alias("target_name"),
                F.lit(f"{t.horizon} months").alias("prediction_horizon"),
                F.col(f"{t.name}__known").alias("eligible_rows"),
                F.col(f"{t.name}__positive").alias("positive_rows"),
                (F.col(f"{t.name}__known") - F.col(f"{t.name}__positive")).alias("negative_rows"),
                (F.col("n") - F.col(f"{t.name}__known")).alias("traceable_unknown"),
                F.col(f"{t.name}__entities").alias("projects_covered"),
            )
            for t in TARGETS
        ]
    )
    untraceable = panel.agg(F.count_if(~F.col("traceable")).alias("untraceable"))
    accounted = totals.select(F.explode(rows).alias("r")).select("r.*")
    # One row on the right: a keyed join on a constant, not a product of two tables.
    one = F.lit(1).alias("k")
    return (
        accounted.select("*", one)
        .join(untraceable.select("*", one), "k")
        .select(
            "target_name", "prediction_horizon", "eligible_rows", "positive_rows", "negative_rows",
            (F.col("traceable_unknown") + F.col("untraceable")).alias("unknown_rows"),
            F.round(
                F.when(F.col("eligible_rows") > 0, F.col("positive_rows") / F.col("eligible_rows")), 6
            ).alias("positive_rate"),
            "projects_covered",
        )
    )


def first_later_change(panel: DataFrame, horizon: int, minimum_shift: int = 1) -> DataFrame:
    """Label and first month, within the horizon, whose end moved by the minimum shift.

    The candidate months come from a RANGE frame holding at most ``horizon`` rows, so
    the comparison with the cutoff row needs no range join.
    """
    window, endpoint = _ahead(1, horizon), _ahead(horizon, horizon)
    upcoming = F.collect_list(
        F.when(F.col("effective_end").isNotNull(), F.struct("month_number", "effective_end"))
    ).over(window)
    known = F.col("effective_end").isNotNull() & (F.count("effective_end").over(endpoint) > 0)
    shifted = F.filter(
        F.col("upcoming"),
        lambda x: x["effective_end"] - F.col("effective_end") >= minimum_shift,
    )
    first = F.array_min(F.transform(shifted, lambda x: x["month_number"]))
    return (
        checked_unique(traceable(panel))
        .withColumns({"upcoming": upcoming, "known": known})
        .where("known")
        .select(
            "identity_key", F.col("report_month").alias("prediction_month"),
            first.isNotNull().cast("int").alias("label"),
            F.coalesce(month_label(first), F.lit("")).alias("first_change_month"),
        )
    )


# Validated schedule targets: name, horizon, minimum shift.
SCHEDULE_CANDIDATES = (
    ("future_schedule_later_3m", 3, 1),
    ("future_schedule_later_6m", 6, 1),
    ("future_schedule_overdue", 3, None),
    ("future_schedule_shift_ge_3m", 3, 3),
)


def schedule_candidates(panel: DataFrame, event_month: str) -> DataFrame:
    """Counts of the four schedule targets and how many events fall in one month."""
    parts = []
    for name, horizon, shift in SCHEDULE_CANDIDATES:
        if shift is None:
            labels = label_table(panel, "future_overdue_active_3m").withColumn(
                "first_change_month", F.lit("")
            )
        else:
            labels = first_later_change(panel, horizon, shift)
        parts.append(
            labels.select(
                F.lit(name).alias("target_name"), F.lit(f"{horizon} months").alias("prediction_horizon"),
                F.lit("LOW" if shift is None else "MEDIUM").alias("semantic_confidence"),
                "identity_key", "label", "first_change_month",
            )
        )
    labels = parts[0]
    for part in parts[1:]:
        labels = labels.unionByName(part)
    per_entity = labels.groupBy(
        "target_name", "prediction_horizon", "semantic_confidence", "identity_key"
    ).agg(
        F.count("*").alias("n"),
        F.sum("label").alias("positive"),
        F.count_if((F.col("label") == 1) & (F.col("first_change_month") == event_month)).alias("in_month"),
    )
    counted = per_entity.groupBy("target_name", "prediction_horizon", "semantic_confidence").agg(
        F.sum("n").alias("eligible_rows"),
        F.sum("positive").alias("positive_rows"),
        F.count("*").alias("projects_covered"),
        F.sum("in_month").alias("event_month_concentration"),
    )
    rows = panel.agg(F.count("*").alias("panel_rows"))
    one = F.lit(1).alias("k")
    return (
        counted.select("*", one)
        .join(rows.select("*", one), "k")
        .select(
            "target_name", "prediction_horizon", "eligible_rows", "positive_rows",
            (F.col("eligible_rows") - F.col("positive_rows")).alias("negative_rows"),
            (F.col("panel_rows") - F.col("eligible_rows")).alias("unknown_rows"),
            F.round(F.col("positive_rows") / F.col("eligible_rows"), 6).alias("positive_rate"),
            "projects_covered", "event_month_concentration", "semantic_confidence",
        )
    )


def transition_events(panel: DataFrame, event_month: str) -> DataFrame:
    """Revised-to-revised moves to a later end, first published in one month.

    Compared with the latest prior observation, whatever its age; a first revised value
    is not a transition.
    """
    timeline = Window.partitionBy("identity_key").orderBy("month_number")
    before = {
        "previous_end": F.lag("revised_end").over(timeline),
        "previous_month": F.lag("report_month").over(timeline),
    }
    return (
        checked_unique(traceable(panel))
        .withColumns(before)
        .where((F.col("report_month") == event_month) & (F.col("revised_end") > F.col("previous_end")))
        .select(
            "project_code", "identity_key", "project_name",
            F.col("previous_month").alias("prediction_month"),
            month_text(F.col("previous_end")).alias("cutoff_target"),
            month_text(F.col("revised_end")).alias("future_target"),
            F.lit(event_month).alias("target_change_month"),
            (F.col("revised_end") - F.col("previous_end")).alias("shift_months"),
            F.col("original_doc").alias("original_end_date"),
            F.col("revised_doc").alias("revised_end_date"),
            "source_file", "source_page", "source_section", F.lit(1).alias("label_value"),
        )
    )


def with_timeline_columns(events: DataFrame, panel: DataFrame, months: list[str]) -> DataFrame:
    """Effective end at each named month as one column per month."""
    wide = (
        panel.where(F.col("report_month").isin(*months) & F.col("traceable"))
        .groupBy("identity_key")
        .pivot("report_month", months)
        .agg(F.first(month_text(F.col("effective_end"))))
    )
    named = [
        F.coalesce(F.col(f"`{m}`"), F.lit("")).alias("target_" + m.replace("-", "_")) for m in months
    ]
    joined = events.join(wide, "identity_key", "left")
    return joined.select(*events.columns, *named)


def with_review_columns(events: DataFrame, review: DataFrame, columns: list[str]) -> DataFrame:
    """Carry audit columns of an earlier review over to the events, by identity."""
    return events.join(review.select("identity_key", *columns), "identity_key", "left")
