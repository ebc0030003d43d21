"""Master record of each entity: modal stable attributes and first/last observation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import clean_text

STABLE_FIELDS = ("project_name", "agency", "state", "ministry", "sector")
RESOLUTION_RULE = "most_frequent_nonblank; most_recent_when_tied"


def unpivot_text(frame: DataFrame, keys: list[str], fields: tuple[str, ...]) -> DataFrame:
    """Long form (keys, field, value) of several text columns, blanks dropped."""
    pairs = F.array(
        *[F.struct(F.lit(f).alias("field"), clean_text(F.col(f)).alias("value")) for f in fields]
    )
    return (
        frame.select(*keys, F.explode(F.filter(pairs, lambda p: p["value"] != "")).alias("pair"))
        .select(*keys, "pair.field", "pair.value")
    )


def modal_values(panel: DataFrame, fields: tuple[str, ...] = STABLE_FIELDS) -> DataFrame:
    """Most frequent non-blank value per entity and field.

    Equally frequent values resolve to the most recently observed one; ``variants``
    counts the distinct values and ``observations`` the non-blank rows.
    """
    counted = (
        unpivot_text(panel.where(F.col("identity_key").isNotNull()), ["identity_key", "report_month"], fields)
        .groupBy("identity_key", "field", "value")
        .agg(F.count("*").alias("n"), F.max("report_month").alias("last_month"))
    )
    return counted.groupBy("identity_key", "field").agg(
        F.max_by("value", F.struct("n", "last_month", "value")).alias("chosen"),
        F.count("*").alias("variants"),
        F.sum("n").alias("observations"),
    )


def build_master(panel: DataFrame) -> DataFrame:
    """One row per identity: resolved attributes, identifiers, span and field conflicts."""
    resolved = modal_values(panel).groupBy("identity_key").agg(
        *[F.max(F.when(F.col("field") == f, F.col("chosen"))).alias(f) for f in STABLE_FIELDS],
        F.concat_ws(
            ";",
            *[
                F.max(
                    F.when(
                        (F.col("field") == f) & (F.col("variants") > 1),
                        F.concat(F.lit(f + ":"), F.col("variants").cast("string")),
                    )
                )
                for f in STABLE_FIELDS
            ],
        ).alias("conflicts"),
    )

    def first_filled(name: str):
        text = clean_text(F.col(name))
        return F.min_by(text, F.when(text != "", F.col("report_month"))).alias(name)

    span = (
        panel.where(F.col("identity_key").isNotNull())
        .groupBy("identity_key")
        .agg(
            first_filled("project_code"),
            first_filled("legacy_ocms_code"),
            F.min("report_month").alias("first_month"),
            F.max("report_month").alias("last_month"),
            F.countDistinct("report_month").alias("months_observed"),
        )
    )
    return span.join(resolved, "identity_key", "left").select(
        "identity_key", "project_code", "legacy_ocms_code", *STABLE_FIELDS,
        "first_month", "last_month", "months_observed",
        F.lit(RESOLUTION_RULE).alias("master_resolution_rule"),
        F.when(F.coalesce("conflicts", F.lit("")) == "", "NONE")
        .otherwise(F.col("conflicts"))
        .alias("field_conflicts"),
    )


def longest_history(master: DataFrame, panel: DataFrame, top: int = 10) -> DataFrame:
    """Timelines of the entities observed in the most months (a top-k report)."""
    chosen = (
        master.orderBy(F.desc("months_observed"), "identity_key").limit(top).select("identity_key")
    )
    return panel.join(F.broadcast(chosen), "identity_key", "left_semi").select(
        "identity_key", "report_month", "expenditure", "physical_progress",
        "original_cost", "revised_cost",
    )


def tracking_share(master: DataFrame) -> DataFrame:
    """Entities observed in two or more months, as % of identified entities."""
    entities = F.count("*")
    tracked = F.count_if(F.col("months_observed") >= 2)
    return master.agg(
        entities.alias("entities"),
        tracked.alias("tracked_entities"),
        F.round(F.when(entities > 0, tracked * 100 / entities).otherwise(F.lit(0.0)), 6).alias("tracking_pct"),
    )
