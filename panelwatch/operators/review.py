"""Review queue for rows that carry no source identifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.lexicon import CODE_TOKEN_IN_TEXT
from ..functions.text import clean_text

ADDRESS = ["report_month", "source_file", "sl_no"]


def first_by_address(candidate: DataFrame) -> DataFrame:
    """One row per report address (month, file, serial).

    Duplicated addresses keep the row with the lowest page and then the smallest
    identifiers, so the choice does not depend on file order.
    """
    rank = F.struct(
        "source_page",
        F.coalesce("project_code", F.lit("~")).alias("code_rank"),
        F.coalesce("legacy_ocms_code", F.lit("~")).alias("legacy_rank"),
    )
    return candidate.groupBy(*ADDRESS).agg(
        F.min_by(F.struct("project_code", "legacy_ocms_code"), rank).alias("found")
    ).select(
        *ADDRESS,
        F.col("found.project_code").alias("candidate_project_code"),
        F.col("found.legacy_ocms_code").alias("candidate_legacy_ocms_code"),
    )


def review_queue(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Unidentified baseline rows matched to a second extraction by report address.

    Names are never matched. Each row gets a review status, a failure type and notes.
    """
    missing = baseline.where(F.col("project_code").isNull() & F.col("legacy_ocms_code").isNull())
    code = clean_text(F.col("candidate_project_code"))
    alternate = clean_text(F.col("candidate_legacy_ocms_code"))
    source_text = F.concat_ws(" ", clean_text(F.col("project_name")), clean_text(F.col("agency")))
    token_left = (F.col("identifier_classification") == "EXTRACTION_FAILURE") | source_text.rlike(
        CODE_TOKEN_IN_TEXT
    )
    source_missing = clean_text(F.col("identifier_status")) == "SOURCE_MISSING_ID"

    def choose(code_found, alternate_found, token, absent, otherwise):
        return (
            F.when(code != "", code_found)
            .when(alternate != "", alternate_found)
            .when(token_left, token)
            .when(source_missing, absent)
            .otherwise(otherwise)
        )

    status = choose(
        "IDENTIFIER_FOUND", "IDENTIFIER_FOUND", "PARSER_FAILURE", "VERIFIED_SOURCE_MISSING", "UNRESOLVED"
    )
    # Failure types and notes.
    failure = choose(
        "VERIFIED_PARSER_FAILURE_WRAPPED_OR_BOUNDARY_IDENTIFIER",
        "VERIFIED_PARSER_FAILURE_ALTERNATE_IDENTIFIER",
        "SOURCE_PRIMARY_TOKEN_NOT_RECOVERED",
        "SOURCE_IDENTIFIER_ABSENT",
        "AMBIGUOUS_OR_MALFORMED_SOURCE_LAYOUT",
    )
    notes = choose(
        F.concat(
            F.lit("Validation extraction recovered source primary code "), code,
            F.lit(" at the same report/serial address; the baseline value was blank."),
        ),
        F.concat(
            F.lit("Validation extraction recovered source alternate identifier "), alternate,
            F.lit("; it remains alternate and is not a primary code."),
        ),
        "A numeric parenthetical token remains in extracted source text, "
        "but controlled validation did not safely bind it to this serial row.",
        "The source-table handler marked this row as identifier-absent.",
        "No primary or alternate identifier was recovered in controlled "
        "validation; no identity was inferred from project text.",
    )
    reference = F.concat(
        F.col("source_file"), F.lit(":p"), F.col("source_page").cast("string"), F.lit("; "),
        F.col("source_section"), F.lit("; sl_no="), F.col("sl_no").cast("string"),
    )
    return missing.join(first_by_address(candidate), ADDRESS, "left").select(
        "report_month", "source_file", "source_page", "source_section", "sl_no",
        "project_name", "agency", "state", "legacy_ocms_code",
        F.col("legacy_ocms_code").alias("alternate_id"),
        F.col("project_code").alias("current_project_code"),
        status.alias("review_status"), failure.alias("failure_type"),
        reference.alias("raw_text_reference"), notes.alias("notes"),
    )


def queue_breakdowns(queue: DataFrame) -> DataFrame:
    """Queue counts by status, month, section and failure type, in one pass."""
    pairs = F.array(
        *[
            F.struct(F.lit(f).alias("field"), F.col(f).alias("value"))
            for f in ("review_status", "report_month", "source_section", "failure_type")
        ]
    )
    return (
        queue.select(F.explode(pairs).alias("p"))
        .groupBy(F.col("p.field").alias("field"), F.col("p.value").alias("value"))
        .agg(F.count("*").alias("rows"))
    )


def queue_pages(queue: DataFrame, top: int = 80) -> DataFrame:
    """File pages with the most queued rows (a top-k report)."""
    return (
        queue.groupBy("source_file", "source_page")
        .agg(F.count("*").alias("rows"))
        .orderBy(F.desc("rows"), "source_file", "source_page")
        .limit(top)
    )


def queue_concentration(queue: DataFrame, top: int = 3) -> DataFrame:
    """Months with the most queued rows (a top-k report)."""
    return (
        queue.groupBy("report_month")
        .agg(F.count("*").alias("rows"))
        .orderBy(F.desc("rows"), "report_month")
        .limit(top)
    )
