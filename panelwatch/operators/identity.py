"""Identity keys, identifier classification, quality flags and identifier coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lexicon import (
    CODE_TOKEN_IN_TEXT,
    DEFAULT_HANDLER,
    HANDLER_BY_LAYOUT,
    LAYOUT_BY_MONTH,
    LAYOUT_BY_PREFIX,
)
from ..functions.numbers import ratio_or_zero
from ..functions.text import clean_text


def _filled(name: str) -> Column:
    text = clean_text(F.col(name))
    return F.when(text != "", text)


def identity_key() -> Column:
    """'P:' + primary code, else 'L:' + alternate code, else null. Names never identify."""
    return F.coalesce(
        F.concat(F.lit("P:"), _filled("project_code")),
        F.concat(F.lit("L:"), _filled("legacy_ocms_code")),
    )


def identifier_classification() -> Column:
    """Why a row has, or lacks, an identifier."""
    source_text = F.concat_ws(" ", clean_text(F.col("project_name")), clean_text(F.col("agency")))
    return (
        F.when(_filled("project_code").isNotNull(), "PRIMARY_ID_PRESENT")
        .when(_filled("legacy_ocms_code").isNotNull(), "ALTERNATE_ID_AVAILABLE")
        .when(source_text.rlike(CODE_TOKEN_IN_TEXT), "EXTRACTION_FAILURE")
        .when(clean_text(F.col("identifier_status")) == "SOURCE_MISSING_ID", "SOURCE_MISSING_ID")
        .otherwise("UNRESOLVED")
    )


def repeated_keys(panel: DataFrame, *keys: str) -> DataFrame:
    """Key combinations that occur on more than one row, with their row counts.

    Counting is partially aggregated before the shuffle, so a hot key costs one row
    per task. Rows where the last key is null are not candidates.
    """
    return (
        panel.where(F.col(keys[-1]).isNotNull())
        .groupBy(*keys)
        .agg(F.count("*").alias("key_rows"))
        .where("key_rows > 1")
    )


def enrich_panel(panel: DataFrame) -> DataFrame:
    """Add identity_key, identifier_classification and the ';'-joined quality_flags."""
    repeated = repeated_keys(panel, "report_month", "project_code")
    progress = F.col("physical_progress").try_cast("double")
    classification = F.col("identifier_classification")
    flags = F.concat_ws(
        ";",
        F.when(classification != "PRIMARY_ID_PRESENT", classification),
        F.when(clean_text(F.col("extraction_status")) != "SUCCESS", F.lit("PARTIAL_EXTRACTION")),
        F.when(F.col("key_rows").isNotNull(), F.lit("DUPLICATE_PRIMARY_ID_IN_MONTH")),
        F.when((progress < 0) | (progress > 100), F.lit("PROGRESS_OUT_OF_RANGE")),
    )
    return (
        panel.withColumns(
            {
                "identity_key": identity_key(),
                "identifier_classification": identifier_classification(),
            }
        )
        .join(repeated, ["report_month", "project_code"], "left")
        .withColumn("quality_flags", F.when(flags == "", "NONE").otherwise(flags))
        .select(
            *panel.columns, "identity_key", "identifier_classification", "quality_flags"
        )
    )


def with_identity(panel: DataFrame) -> DataFrame:
    """Identity and classification only, for consumers that need no quality flags."""
    return panel.withColumns(
        {
            "identity_key": identity_key(),
            "identifier_classification": identifier_classification(),
        }
    )


def classification_counts(panel: DataFrame) -> DataFrame:
    """Rows per identifier classification."""
    return panel.groupBy("identifier_classification").agg(F.count("*").alias("rows"))


def _coverage_columns() -> list[Column]:
    primary = F.count("project_code")
    alternate = F.count("legacy_ocms_code")
    unresolved = F.count_if(F.col("project_code").isNull() & F.col("legacy_ocms_code").isNull())
    total = F.count("*")
    classed = F.col("identifier_classification")
    return [
        total.alias("rows"),
        primary.alias("primary_rows"),
        alternate.alias("alternate_rows"),
        unresolved.alias("unresolved_rows"),
        F.count_if(classed == "EXTRACTION_FAILURE").alias("parser_failure_rows"),
        F.count_if(classed == "SOURCE_MISSING_ID").alias("source_missing_rows"),
        F.round(ratio_or_zero(primary * 100, total), 6).alias("primary_pct"),
        F.round(ratio_or_zero(alternate * 100, total), 6).alias("alternate_pct"),
        F.round(ratio_or_zero(unresolved * 100, total), 6).alias("unresolved_pct"),
    ]


def identifier_coverage(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Primary, alternate and unresolved counts of two extractions, one row each."""
    before = baseline.agg(*_coverage_columns()).withColumn("extraction", F.lit("before"))
    after = candidate.agg(*_coverage_columns()).withColumn("extraction", F.lit("after"))
    return before.unionByName(after)


def subset_coverage(panel: DataFrame, months: list[str]) -> DataFrame:
    """Identifier coverage on chosen report months."""
    return panel.where(F.col("report_month").isin(*months)).agg(*_coverage_columns())


def report_layout(month: Column, file_name: Column) -> Column:
    """Layout name by inspected report month, else by file-name prefix, else UNKNOWN."""
    layout = None
    for label, name in LAYOUT_BY_MONTH.items():
        test = month == label
        layout = F.when(test, name) if layout is None else layout.when(test, name)
    for prefix, name in LAYOUT_BY_PREFIX.items():
        layout = layout.when(file_name.startswith(prefix), name)
    return layout.otherwise("UNKNOWN")


def extraction_handler(layout: Column) -> Column:
    """Which extraction route serves a layout."""
    handler = None
    for name, route in HANDLER_BY_LAYOUT.items():
        handler = F.when(layout == name, route) if handler is None else handler.when(layout == name, route)
    return handler.otherwise(DEFAULT_HANDLER)


def with_layout(panel: DataFrame) -> DataFrame:
    """Add layout, handler and the type of identifier each row carries."""
    layout = report_layout(F.col("report_month"), F.col("source_file"))
    return panel.withColumn("layout", layout).withColumns(
        {
            "handler": extraction_handler(F.col("layout")),
            "identifier_type": F.when(_filled("project_code").isNotNull(), "PRIMARY")
            .when(_filled("legacy_ocms_code").isNotNull(), "ALTERNATE")
            .otherwise("NONE"),
        }
    )


def coverage_by(panel: DataFrame, *fields: str) -> DataFrame:
    """Rows per combination of fields, nulls kept as their own group."""
    return panel.groupBy(*fields).agg(F.count("*").alias("rows"))


def coverage_by_month(panel: DataFrame) -> DataFrame:
    """Rows and identifier presence per report month."""
    return panel.groupBy("report_month").agg(
        F.count("*").alias("rows"),
        F.count("project_code").alias("primary_rows"),
        F.count("legacy_ocms_code").alias("alternate_rows"),
        F.round(F.count("project_code") * 100 / F.count("*"), 6).alias("primary_pct"),
        F.round(F.count("legacy_ocms_code") * 100 / F.count("*"), 6).alias("alternate_pct"),
    )


def monthly_identity_coverage(panel: DataFrame) -> DataFrame:
    """Rows, distinct primary codes and % of rows with a primary code, per month."""
    return panel.groupBy("report_month").agg(
        F.count("*").alias("rows"),
        F.countDistinct("project_code").alias("unique_primary_projects"),
        F.round(F.count("project_code") * 100 / F.count("*"), 2).alias("primary_id_coverage"),
    )


def duplicate_key_rows(panel: DataFrame) -> DataFrame:
    """Rows that share (month, primary code), and (month, either code)."""
    tracked = panel.withColumn(
        "source_tracking_key", F.coalesce("project_code", "legacy_ocms_code")
    )

    def total(key: str) -> DataFrame:
        return (
            repeated_keys(tracked, "report_month", key)
            .agg(F.coalesce(F.sum("key_rows"), F.lit(0)).alias("duplicate_rows"))
            .withColumn("key_type", F.lit(key))
        )

    return total("project_code").unionByName(total("source_tracking_key"))
