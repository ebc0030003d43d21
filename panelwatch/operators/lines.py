"""Report-page text as ordered lines: boilerplate filter, classes, sections, headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.lexicon import (
    BOILERPLATE,
    COLUMN_HEADER_PARTS,
    COLUMN_HEADER_PATTERN,
    COLUMN_HEADER_STARTS,
    MINISTRY_HEADER,
    MONTH_BANNER,
    ONLY_PARENS_LINE,
    PAGE_NUMBER,
    SECTORS,
    SERIAL_LINE,
    STATES,
    TOTAL_LINE,
)
from ..functions.text import any_of, has_trailing_numbers, strip
from ..session import written
from .prefix import carried_forward

PAGES_PER_BLOCK = 1024
SECTION_TITLE = "All Ongoing Projects"
MARKER_TOLERANCE = 8  # fixed value, page units
HIGHEST_PLAIN_SERIAL = 3000  # fixed value


def page_lines(pages: DataFrame) -> DataFrame:
    """(file, page, position, line), trimmed, in reading order; no shuffle."""
    others = [c for c in pages.columns if c != "text"]
    return pages.select(
        *others, F.posexplode(F.split(F.col("text"), "\n")).alias("position", "raw")
    ).select(*others, "position", strip(F.col("raw")).alias("line"))


def is_skip_line(line: Column, boilerplate: tuple[str, ...] = BOILERPLATE) -> Column:
    """Blank, page number, or banner and footer text."""
    return (line == "") | line.rlike(f"{PAGE_NUMBER}|{any_of(boilerplate)}")


def is_column_header(line: Column) -> Column:
    """A repeated table column header or a fragment of one."""
    return line.rlike(
        f"^(?:{any_of(COLUMN_HEADER_STARTS)})|{any_of(COLUMN_HEADER_PARTS)}|{COLUMN_HEADER_PATTERN}"
    )


def is_month_banner(line: Column) -> Column:
    """A line such as 'MARCH 2026'."""
    return line.rlike(MONTH_BANNER)


def is_data_line(line: Column, boilerplate: tuple[str, ...] = BOILERPLATE) -> Column:
    """Neither boilerplate, column header nor month banner."""
    return ~(is_skip_line(line, boilerplate) | is_column_header(line) | is_month_banner(line))


def data_lines(lines: DataFrame, boilerplate: tuple[str, ...] = BOILERPLATE) -> DataFrame:
    """Lines that carry report data."""
    return lines.where(is_data_line(F.col("line"), boilerplate))


def is_ministry(line: Column) -> Column:
    """A ministry or department header."""
    return line.rlike(MINISTRY_HEADER)


def is_sector(line: Column) -> Column:
    """A stand-alone sector header."""
    return line.isin(*SECTORS)


def serial_number(line: Column) -> Column:
    """Leading number of a serial-like line, else null."""
    return F.when(line.rlike(SERIAL_LINE), F.regexp_extract(line, SERIAL_LINE, 1).try_cast("long"))


def is_serial_candidate(line: Column) -> Column:
    """A serial line: known state and a trailing number, or a low serial and two numbers."""
    rest = F.regexp_extract(line, SERIAL_LINE, 2)
    with_state = rest.rlike(any_of(STATES)) & has_trailing_numbers(rest, 1)
    low_serial = (serial_number(line) <= HIGHEST_PLAIN_SERIAL) & has_trailing_numbers(rest, 2)
    return F.coalesce(line.rlike(SERIAL_LINE) & (with_state | low_serial), F.lit(False))


def line_class(line: Column, boilerplate: tuple[str, ...] = BOILERPLATE) -> Column:
    """boilerplate, ministry, sector, total, serial, parenthetical or text."""
    return (
        F.when(~is_data_line(line, boilerplate), "boilerplate")
        .when(is_ministry(line), "ministry")
        .when(is_sector(line), "sector")
        .when(line.rlike(TOTAL_LINE), "total")
        .when(is_serial_candidate(line), "serial")
        .when(line.rlike(ONLY_PARENS_LINE), "parenthetical")
        .otherwise("text")
    )


def classified(lines: DataFrame, boilerplate: tuple[str, ...] = BOILERPLATE) -> DataFrame:
    """Lines with their class and the page block used for long files."""
    return lines.withColumns(
        {"line_class": line_class(F.col("line"), boilerplate), "block": F.floor(F.col("page") / PAGES_PER_BLOCK)}
    )


def class_counts(lines: DataFrame, boilerplate: tuple[str, ...] = BOILERPLATE) -> DataFrame:
    """Lines per file and class."""
    return classified(lines, boilerplate).groupBy("file", "line_class").agg(F.count("*").alias("lines"))


def section_pages(pages: DataFrame, title: str = SECTION_TITLE, within: int = 300) -> DataFrame:
    """First and last page of each file whose beginning contains the section title."""
    head = F.substring(strip(F.col("text")), 1, within)
    return (
        pages.where(F.contains(head, F.lit(title)))
        .groupBy("file")
        .agg(
            F.min("page").alias("first_page"), F.max("page").alias("last_page"),
            F.count("*").alias("section_pages"),
        )
    )


def with_headers(lines: DataFrame, boilerplate: tuple[str, ...] = BOILERPLATE) -> DataFrame:
    """Data lines with the sector and ministry header in force and the last line class
    other than a parenthetical one.

    Headers carry over page ends. Pages and blocks of pages are summarised first, so a
    file that holds most of the lines is not one task. The lines are classified and written
    once for that.
    """
    rows = written(classified(lines, boilerplate), "classified-lines").where(F.col("line_class") != "boilerplate").withColumns(
        {
            "sector_line": F.when(F.col("line_class") == "sector", F.col("line")),
            "ministry_line": F.when(F.col("line_class") == "ministry", F.col("line")),
            "open_class": F.when(F.col("line_class") != "parenthetical", F.col("line_class")),
        }
    )
    carried = carried_forward(
        rows, ["file"], ["block", "page"], ["position"],
        {"sector": "sector_line", "ministry": "ministry_line", "last_class": "open_class"},
    )
    return carried.drop("sector_line", "ministry_line", "open_class")


def nearest_marker(
    serials: DataFrame, markers: DataFrame, tolerance: float = MARKER_TOLERANCE
) -> DataFrame:
    """As-of join: each serial gets the nearest marker at or above ``top`` + tolerance on
    its page.

    serials: (file, page, top, serial); markers: (file, page, top, label). Both sides
    share one shuffle by page and one sort; no pairs are formed.
    """
    events = serials.select(
        "file", "page", "serial", "top", (F.col("top") + tolerance).alias("at"), F.lit(1).alias("turn"),
        F.lit(None).cast("string").alias("label"),
    ).unionByName(
        markers.select(
            "file", "page", F.lit(None).cast("long").alias("serial"), "top", F.col("top").alias("at"),
            F.lit(0).alias("turn"), "label",
        )
    )
    order = (
        Window.partitionBy("file", "page").orderBy("at", "turn", "top")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        events.withColumn("marker", F.last("label", ignorenulls=True).over(order))
        .where(F.col("turn") == 1)
        .select("file", "page", "serial", "top", F.col("marker").alias("label"))
    )


def continued_pages(
    pages: DataFrame, title: str = SECTION_TITLE, boilerplate: tuple[str, ...] = BOILERPLATE
) -> DataFrame:
    """Section pages per file that start in the middle of a record.

    The first data line among the ten first lines decides; the file's first section page
    cannot continue anything.
    """
    head = F.slice(F.transform(F.split(F.col("text"), "\n"), strip), 1, 10)
    first = F.get(F.filter(head, lambda x: is_data_line(x, boilerplate)), 0)
    starts_clean = (
        is_ministry(first) | is_sector(first) | first.rlike(TOTAL_LINE) | first.rlike(SERIAL_LINE)
    )
    return (
        pages.where(F.contains(F.substring(F.col("text"), 1, 500), F.lit(title)))
        .withColumn("continued", F.coalesce((~starts_clean).cast("int"), F.lit(0)))
        .groupBy("file")
        .agg(
            F.count("*").alias("section_pages"),
            (F.sum("continued") - F.min_by("continued", "page")).alias("continued_pages"),
        )
    )
