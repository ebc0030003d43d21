"""Temporal, purged and entity-disjoint splits, and walk-forward folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.months import month_add
from ..functions.text import hash_bucket

# Month ranges of the named splits.
SPLITS = {
    "schedule": {"train": ("2025-07", "2025-12"), "validation": ("2026-01", "2026-02"), "test": ("2026-03", "2026-04")},
    "cost": {"train": ("2025-07", "2025-10"), "validation": ("2025-11", "2025-12"), "test": ("2026-01", "2026-01")},
    "alternative": {"train": ("2025-07", "2025-11"), "validation": ("2025-12", "2026-01"), "test": ("2026-02", "2026-03")},
    "purged": {"train": ("2025-07", "2025-09"), "validation": ("2025-10", "2025-11"), "test": ("2026-03", "2026-04")},
}
DISJOINT_PERIODS = {"train": (None, "2025-12"), "validation": ("2026-01", "2026-02"), "test": ("2026-03", None)}
DISJOINT_BUCKETS = {"train": (0, 5), "validation": (6, 7), "test": (8, 9)}
EVALUATION_MONTHS = ("2025-11", "2025-12", "2026-01", "2026-02", "2026-03", "2026-04")
TRAINING_START = "2025-07"
EMBARGO_MONTHS = 4
HORIZON = 3


def _checked_order(periods: dict[str, tuple]) -> None:
    """Reject ranges that do not move forward in time."""
    if not (periods["train"][1] < periods["validation"][0] <= periods["test"][0]):
        raise ValueError("non-forward temporal split")


def known_target(labelled: DataFrame, target: str) -> DataFrame:
    """The rows, refusing an unknown target while they flow."""
    message = F.lit("target contains unknown values")
    return labelled.withColumn(
        target, F.when(F.col(target).isNull(), F.raise_error(message).cast("int")).otherwise(F.col(target))
    )


def split_part(periods: dict[str, tuple]) -> Column:
    """Name of the part a row's month falls in, null outside all parts."""
    month = F.col("prediction_month")
    part = None
    for name, (start, end) in periods.items():
        inside = (F.lit(True) if start is None else month >= start) & (
            F.lit(True) if end is None else month <= end
        )
        part = F.when(inside, name) if part is None else part.when(inside, name)
    return part


def with_split(labelled: DataFrame, target: str, kind: str) -> DataFrame:
    """Rows of a named split tagged with their part."""
    periods = SPLITS[kind]
    _checked_order(periods)
    return known_target(labelled, target).withColumn("part", split_part(periods)).where(
        F.col("part").isNotNull()
    )


def temporal_split(labelled: DataFrame, target: str, kind: str) -> dict[str, DataFrame]:
    """The parts of a named split as separate frames."""
    tagged = with_split(labelled, target, kind)
    return {p: tagged.where(F.col("part") == p).drop("part") for p in SPLITS[kind]}


def with_disjoint_split(
    labelled: DataFrame, periods: dict[str, tuple] = DISJOINT_PERIODS
) -> DataFrame:
    """Forward windows crossed with hash buckets, so no entity is in two parts.

    The bucket is a pure function of the identity, which is why the parts cannot
    overlap; ``disjoint_overlap`` verifies it.
    """
    bucket = F.col("bucket")
    month = F.col("prediction_month")
    part = None
    for name, (low, high) in DISJOINT_BUCKETS.items():
        start, end = periods[name]
        inside = bucket.between(low, high)
        if start is not None:
            inside = inside & (month >= start)
        if end is not None:
            inside = inside & (month <= end)
        part = F.when(inside, name) if part is None else part.when(inside, name)
    return (
        labelled.withColumn("bucket", hash_bucket(F.col("identity_key")))
        .withColumn("part", part)
        .where(F.col("part").isNotNull())
    )


def disjoint_overlap(tagged: DataFrame) -> DataFrame:
    """Number of entities that occur in more than one part (must be zero)."""
    return (
        tagged.groupBy("identity_key")
        .agg(F.countDistinct("part").alias("parts"))
        .agg(F.count_if(F.col("parts") > 1).alias("overlapping_entities"))
    )


def split_report(tagged: DataFrame, target: str) -> DataFrame:
    """Range, rows, entities, positives, rate and overlap with training per part."""
    per_entity = tagged.groupBy("identity_key").agg(
        *[
            c
            for p in ("train", "validation", "test")
            for c in (
                F.count_if(F.col("part") == p).alias(f"{p}__rows"),
                F.coalesce(F.sum(F.when(F.col("part") == p, F.col(target))), F.lit(0)).alias(f"{p}__pos"),
                F.min(F.when(F.col("part") == p, F.col("prediction_month"))).alias(f"{p}__first"),
                F.max(F.when(F.col("part") == p, F.col("prediction_month"))).alias(f"{p}__last"),
            )
        ]
    )
    in_train = F.col("train__rows") > 0
    totals = per_entity.agg(
        *[
            c
            for p in ("train", "validation", "test")
            for c in (
                F.min(f"{p}__first").alias(f"{p}__first"),
                F.max(f"{p}__last").alias(f"{p}__last"),
                F.sum(f"{p}__rows").alias(f"{p}__rows"),
                F.sum(f"{p}__pos").alias(f"{p}__pos"),
                F.count_if(F.col(f"{p}__rows") > 0).alias(f"{p}__projects"),
                F.count_if((F.col(f"{p}__rows") > 0) & in_train).alias(f"{p}__overlap"),
            )
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(p.upper()).alias("part"),
                F.col(f"{p}__first").alias("period_start"),
                F.col(f"{p}__last").alias("period_end"),
                F.col(f"{p}__rows").alias("rows"),
                F.col(f"{p}__projects").alias("projects"),
                F.col(f"{p}__pos").alias("positive_rows"),
                F.round(F.when(F.col(f"{p}__rows") > 0, F.col(f"{p}__pos") / F.col(f"{p}__rows")), 6).alias(
                    "positive_rate"
                ),
                F.when(F.lit(p == "train"), F.lit(0)).otherwise(F.col(f"{p}__overlap")).cast("long").alias(
                    "projects_overlapping_train"
                ),
            )
            for p in ("train", "validation", "test")
        ]
    )
    return totals.select(F.explode(rows).alias("r")).select("r.*").where("rows > 0")


def fold_bounds(
    evaluation_months=EVALUATION_MONTHS, start: str = TRAINING_START, embargo: int = EMBARGO_MONTHS
) -> list[tuple[str, str, str]]:
    """(training start, training end, evaluation month) of each expanding window."""

    def shifted(label: str, months: int) -> str:
        number = int(label[:4]) * 12 + int(label[5:7]) - 1 + months
        return f"{number // 12}-{number % 12 + 1:02d}"

    return [(start, shifted(m, -embargo), m) for m in evaluation_months]


def maturity_windows(
    labelled: DataFrame, target: str, evaluation_months=EVALUATION_MONTHS, start: str = TRAINING_START
) -> DataFrame:
    """Expanding windows whose training labels end before the evaluation month.

    All windows are counted in one pass: rows are reduced per entity with one
    conditional sum per window, so no row is copied into overlapping windows.
    """
    bounds = fold_bounds(evaluation_months, start)
    month = F.col("prediction_month")

    def in_train(i: int) -> Column:
        return month.between(bounds[i][0], bounds[i][1])

    def in_eval(i: int) -> Column:
        return month == bounds[i][2]

    measures = []
    for i in range(len(bounds)):
        for name, test in (("train", in_train(i)), ("eval", in_eval(i))):
            measures.append(F.count_if(test).alias(f"{name}__{i}"))
            measures.append(F.sum(F.when(test, F.col(target)).otherwise(0)).alias(f"{name}_pos__{i}"))
    per_entity = labelled.groupBy("identity_key").agg(*measures)
    totals = per_entity.agg(
        *[
            c
            for i in range(len(bounds))
            for n in ("train", "eval")
            for c in (
                F.sum(f"{n}__{i}").alias(f"{n}__{i}"),
                F.sum(f"{n}_pos__{i}").alias(f"{n}_pos__{i}"),
                F.count_if(F.col(f"{n}__{i}") > 0).alias(f"{n}_projects__{i}"),
            )
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("window"),
                F.lit(first).alias("training_period_start"),
                F.lit(last).alias("training_period_end"),
                F.lit(evaluated).alias("evaluation_period"),
                F.col(f"train__{i}").alias("train_rows"),
                F.col(f"train_projects__{i}").alias("train_projects"),
                F.col(f"train_pos__{i}").alias("train_positive_rows"),
                F.col(f"eval__{i}").alias("evaluation_rows"),
                F.col(f"eval_projects__{i}").alias("evaluation_projects"),
                F.col(f"eval_pos__{i}").alias("evaluation_positive_rows"),
            )
            for i, (first, last, evaluated) in enumerate(bounds)
        ]
    )
    kept = F.filter(rows, lambda r: (r["train_rows"] > 0) & (r["evaluation_rows"] > 0))
    return (
        totals.select(F.posexplode(kept).alias("position", "w"))
        .select((F.col("position") + 1).alias("fold"), "w.*")
        .drop("window")
        .withColumns(
            {
                "training_label_endpoint": month_add(F.col("training_period_end"), HORIZON),
                "evaluation_label_endpoint": month_add(F.col("evaluation_period"), HORIZON),
                "evaluation_event_rate": F.round(
                    F.col("evaluation_positive_rows") / F.col("evaluation_rows"), 6
                ),
            }
        )
    )


def labelled_months(panel: DataFrame, labelled: DataFrame, target: str) -> DataFrame:
    """Observations, entities, eligible rows, positives and unknown rows per month."""
    source = panel.groupBy(F.col("report_month").alias("month")).agg(
        F.count("*").alias("observations"), F.countDistinct("identity_key").alias("projects")
    )
    eligible = labelled.groupBy(F.col("prediction_month").alias("month")).agg(
        F.count("*").alias("eligible"),
        F.sum(target).alias("positive"),
        F.avg(target).alias("rate"),
    )
    known = F.coalesce("eligible", F.lit(0))
    return source.join(eligible, "month", "left").select(
        "month", "observations", "projects",
        known.alias("label_eligible"),
        F.coalesce("positive", F.lit(0)).alias("positive_count"),
        F.round("rate", 6).alias("event_rate"),
        (F.col("observations") - known).alias("unknown_observations"),
    )


def labelled_scope(labelled: DataFrame, target: str, last_month: str) -> DataFrame:
    """The rows, refusing unknown targets and months past the labelled boundary."""
    missing = {"prediction_month", target} - set(labelled.columns)
    if missing:
        raise ValueError(f"missing prediction columns: {sorted(missing)}")
    checked = known_target(labelled, target)
    message = F.lit("a month past the labelled boundary entered the evaluation")
    return checked.withColumn(
        "prediction_month",
        F.when(F.col("prediction_month") > last_month, F.raise_error(message).cast("string")).otherwise(
            F.col("prediction_month")
        ),
    )
