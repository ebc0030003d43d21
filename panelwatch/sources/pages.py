"""Page-text tables (file, page, text): from documents, and printed from a panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.lexicon import SECTORS, STATES
from .panel import table

PAGE_BANNER = "Table 6: All Ongoing Projects"


def document_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Each document as one page of the file named by its source."""
    return table(spark, folder, "documents").select(
        F.col("source").alias("file"), F.col("doc_id").cast("long").alias("page"), "text"
    )


def html_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Each web page as one page of the file named by its host, one line per tag."""
    return table(spark, folder, "pages").select(
        F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("file"),
        F.col("page_id").cast("long").alias("page"),
        F.regexp_replace("html", r">\s*<", ">\n<").alias("text"),
    )


def printed_state(state: Column) -> Column:
    """A recognised state name for a numbered place."""
    number = F.regexp_extract(state, r"(\d+)$", 1).try_cast("int")
    names = F.array(*[F.lit(s) for s in STATES])
    return F.element_at(names, number % len(STATES) + 1)


def printed_sector(sl_no: Column) -> Column:
    """A recognised sector name for a row number."""
    return F.element_at(F.array(*[F.lit(s) for s in SECTORS]), (sl_no % len(SECTORS) + 1).cast("int"))


def _amount(value: Column) -> Column:
    return value.cast("decimal(18,2)").cast("string")


def report_pages_from_panel(panel: DataFrame) -> DataFrame:
    """Printed project-list pages of every month, at most 20 records to a page.

    A record is a name line with dates and cost, a serial line, a line of four
    parenthesised values and an identifier pair. Odd pages start with a ministry header,
    every fifth entity with a sector header, and each page ends with its total.
    """
    dash = F.lit("-")
    valid_approval = F.when(F.col("date_of_approval") != "N.A.", F.col("date_of_approval"))
    name_line = F.concat_ws(
        " ", "project_name", valid_approval, "original_doc", _amount(F.col("original_cost"))
    )
    serial_line = F.concat_ws(
        " ", (F.col("sl_no") + 1).cast("string"),
        F.concat(F.lit("("), F.col("agency"), F.lit(")")),
        printed_state(F.col("state")),
        _amount(F.col("expenditure")), _amount(F.col("physical_progress")),
    )

    def group(value: Column) -> Column:
        return F.concat(F.lit("("), F.coalesce(value, dash), F.lit(")"))

    values_line = F.concat_ws(
        " ", group(F.col("project_code")), group(F.col("start_date")), group(F.col("revised_doc")),
        group(_amount(F.col("revised_cost"))),
    )
    pair_line = F.concat_ws(
        " ", group(F.col("legacy_ocms_code")), group(F.when(F.col("sl_no") % 4 == 0, F.lit("10550")))
    )
    sector_line = F.when(F.col("sl_no") % 5 == 0, printed_sector(F.col("sl_no")))
    lines = F.array(sector_line, name_line, serial_line, values_line, pair_line)
    entry = F.struct("sl_no", F.filter(lines, lambda x: x.isNotNull()).alias("lines"))
    body = F.flatten(F.transform(F.array_sort("records"), lambda r: r["lines"]))
    banner = F.array(
        F.lit(PAGE_BANNER), F.lit("Sl.No Project Name (Agency) State"),
        F.when(F.col("source_page") % 2 == 1, F.concat(F.lit("Ministry of "), F.col("ministry"))),
    )
    footer = F.array(
        F.concat(F.lit("Total ("), F.size("records").cast("string"), F.lit(")")), F.lit(""),
        F.concat(F.lit("Page "), F.col("source_page").cast("string")),
    )
    text = F.array_join(
        F.concat(F.filter(banner, lambda x: x.isNotNull()), body, footer), "\n"
    )
    return (
        panel.groupBy("report_month", "source_file", "source_page")
        .agg(F.collect_list(entry).alias("records"), F.min_by("ministry", "sl_no").alias("ministry"))
        .select(
            F.col("source_file").alias("file"), F.col("source_page").alias("page"), "report_month",
            text.alias("text"),
        )
    )
