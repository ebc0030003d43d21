"""Layout profile of report files: line counts, class, descriptors, risk and compatibility."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lexicon import (
    ALTERNATE_CODE_LINE,
    MONTH_DATE_TOKEN,
    PRIMARY_CODE_LINE,
    SERIAL_LINE,
    STATES,
    TOTAL_LINE,
    TRIPLE_PAREN_LINE,
)
from ..functions.text import any_of
from .lines import (
    HIGHEST_PLAIN_SERIAL,
    SECTION_TITLE,
    continued_pages,
    is_data_line,
    is_ministry,
    is_sector,
    page_lines,
    serial_number,
)

# How far a layout class is from the existing extraction routes.
COMPATIBILITY = {
    "NEW_FORMAT_A": "PARSER_COMPATIBLE",
    "OLD_FORMAT_A": "PARSER_COMPATIBLE",
    "OLD_FORMAT_B": "PARSER_NEEDS_MINOR_ADAPTATION",
    "TRANSITIONAL_FORMAT": "PARSER_NEEDS_MINOR_ADAPTATION",
    "NEW_FORMAT_VARIANT": "PARSER_NEEDS_MINOR_ADAPTATION",
    "NEW_FORMAT_B": "PARSER_NEEDS_NEW_HANDLER",
    "QUARTERLY_FORMAT": "PARSER_NEEDS_NEW_HANDLER",
    "QUARTERLY_NEW": "PARSER_NEEDS_NEW_HANDLER",
}
TRIPLE_RATIO = 0.3  # fixed value


def _line_counts(pages: DataFrame) -> DataFrame:
    """Per file: serial, code, alternate, triple, header, total and agency line counts."""
    line = F.col("line")
    rest = F.regexp_extract(line, SERIAL_LINE, 2)
    header = is_sector(line) | is_ministry(line)
    total = line.rlike(TOTAL_LINE)
    serial = (
        line.rlike(SERIAL_LINE)
        & rest.rlike(any_of(STATES))
        & rest.rlike(r"\d+\.?\d*\s*$")
        & (serial_number(line) <= HIGHEST_PLAIN_SERIAL)
    )
    code, alternate = line.rlike(PRIMARY_CODE_LINE), line.rlike(ALTERNATE_CODE_LINE)
    rows = page_lines(pages).where(is_data_line(line)).withColumns(
        {
            "header": header,
            "total": ~header & total,
            "body": ~header & ~total,
            "serial": F.coalesce(serial, F.lit(False)) & ~header & ~total,
        }
    )
    body, is_row = F.col("body"), F.col("serial")
    return rows.groupBy("file").agg(
        F.count_if(is_row).alias("serial_lines"),
        F.count_if(body & code).alias("code_lines"),
        F.count_if(body & alternate).alias("alternate_lines"),
        F.count_if(body & line.rlike(TRIPLE_PAREN_LINE)).alias("triple_paren_lines"),
        F.count_if("header").alias("header_lines"),
        F.count_if("total").alias("total_lines"),
        F.count_if(is_row & rest.rlike(r"\([A-Za-z]")).alias("agency_on_serial"),
        F.count_if(body & line.rlike(r"^\([A-Za-z].*\)$") & ~code & ~alternate).alias("agency_separate"),
        F.count_if(is_row & rest.rlike(MONTH_DATE_TOKEN)).alias("dates_on_serial"),
    )


def _labels(pages: DataFrame) -> DataFrame:
    """Per file: pages, contents-page labels and the label of its project table."""
    text = F.col("text")
    head = F.substring(text, 1, 500)

    def has(*words: str) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words]).cast("int")

    # The last page that prints a label decides, as in reading order.
    label = F.when(F.contains(head, F.lit("Table 6")), "Table 6").when(
        F.contains(head, F.lit("Table 4")), "Table 4"
    )
    labels = {
        "front_table6": has("Table 6:"),
        "front_table5": has("Table 5:"),
        "front_table4": has("Table 4: All Ongoing", "Table 4:All Ongoing"),
        "front_table3": has("Table 3: All Ongoing", "Table 3:All Ongoing"),
    }
    # A page is its labels from here on: no shuffle carries text.
    read = pages.select(
        "file", "page",
        *[test.alias(name) for name, test in labels.items()],
        F.when(F.contains(head, F.lit(SECTION_TITLE)), label).alias("label"),
    )
    bounds = read.groupBy("file").agg(F.min("page").alias("front"), F.count("*").alias("pages"))
    front = F.col("page") <= F.col("front") + 3
    return read.join(bounds, "file").groupBy("file", "pages").agg(
        *[F.max(F.when(front, F.col(name)).otherwise(0)).alias(name) for name in labels],
        F.coalesce(F.max_by("label", F.when(F.col("label").isNotNull(), F.col("page"))), F.lit("")).alias("table_label"),
    )


def report_type(file: Column) -> Column:
    """QUARTERLY, MONTHLY or UNKNOWN from the file name."""
    quarterly = F.contains(file, F.lit("QPISR")) | F.contains(file, F.lit("QR"))
    monthly = F.contains(file, F.lit("Flash")) | F.contains(file, F.lit("FR"))
    return F.when(quarterly, "QUARTERLY").when(monthly, "MONTHLY").otherwise("UNKNOWN")


def layout_profile(pages: DataFrame, title: str = SECTION_TITLE) -> DataFrame:
    """Line counts and labels per file, over the pages that carry the project list."""
    listed = pages.where(F.contains(F.substring(F.col("text"), 1, 500), F.lit(title)))
    return (
        _labels(pages)
        .join(continued_pages(pages, title), "file")
        .join(_line_counts(listed), "file", "left")
        .na.fill(0)
    )


def layout_class(profile: DataFrame) -> DataFrame:
    """Add the report type and the layout class."""
    c = F.col
    ratio = F.when(c("serial_lines") > 0, c("triple_paren_lines") / F.greatest(c("serial_lines"), F.lit(1))).otherwise(0.0)
    has_alternate = c("alternate_lines") > 0
    numbered = (c("front_table6") == 1) | (c("front_table5") == 1)
    named = (
        F.when(c("report_type") == "QUARTERLY", F.when(has_alternate, "QUARTERLY_NEW").otherwise("QUARTERLY_FORMAT"))
        .when(numbered & has_alternate, "NEW_FORMAT_A")
        .when((c("table_label") == "Table 6") & ~has_alternate & (ratio >= TRIPLE_RATIO), "TRANSITIONAL_FORMAT")
        .when((c("table_label") == "Table 6") & ~has_alternate, "NEW_FORMAT_B")
        .when(
            (c("front_table4") == 1) & ~has_alternate & (c("dates_on_serial") > c("serial_lines") * 0.5),
            "OLD_FORMAT_A",
        )
        .when((c("front_table4") == 1) & ~has_alternate, "OLD_FORMAT_B")
        .when(has_alternate, "NEW_FORMAT_VARIANT")
        .when(c("table_label") == "Table 4", "OLD_FORMAT_A")
        .otherwise("UNKNOWN")
    )
    return profile.withColumn("report_type", report_type(c("file"))).withColumn("layout_class", named)


def layout_descriptors(classed: DataFrame) -> DataFrame:
    """Add agency placement, record pattern, page-break pattern and special patterns."""
    c = F.col
    same, apart = c("agency_on_serial") > 0, c("agency_separate") > 0

    def counted(test: Column, name: str, value: Column) -> Column:
        return F.when(test, F.concat(F.lit(name + "("), value.cast("string"), F.lit(")")))

    specials = F.concat_ws(
        "; ",
        counted(c("section_pages") < 10, "LOW_PAGE_COUNT", c("section_pages")),
        F.when(c("front_table3") == 1, F.lit("TABLE_3_ONGOING")),
        F.when(c("file").startswith("FR"), F.lit("FR_NAMING")),
        counted(c("total_lines") > 0, "TOTAL_LINES", c("total_lines")),
        counted(c("serial_lines") > 2000, "HIGH_PROJECT_COUNT", c("serial_lines")),
        counted((c("serial_lines") > 0) & (c("serial_lines") < 100), "LOW_PROJECT_COUNT", c("serial_lines")),
        F.when(c("serial_lines") == 0, F.lit("ZERO_PROJECTS_DETECTED")),
    )
    return classed.withColumns(
        {
            "agency_layout": F.when(same & apart, "MIXED").when(same, "SAME_LINE")
            .when(apart, "SEPARATE_LINE").otherwise("NONE_DETECTED"),
            "record_pattern": F.when(
                (c("triple_paren_lines") > 0) & (c("alternate_lines") > 0),
                "MULTI_LINE: name_lines -> sl_no_line -> paren_triple -> project_code -> legacy_code",
            )
            .when(
                c("triple_paren_lines") > 0,
                "MULTI_LINE: name_lines -> sl_no_line -> paren_triple -> project_code",
            )
            .when(
                c("dates_on_serial") > 0,
                "MULTI_LINE: name_lines -> sl_no_line(with dates) -> agency/revised_line -> project_code",
            )
            .otherwise("MULTI_LINE: structure unclear"),
            "page_break_pattern": F.when(
                c("continued_pages") > 0,
                F.concat(F.lit("RECORDS_SPLIT ("), c("continued_pages").cast("string"), F.lit(" occurrences)")),
            ).otherwise("CLEAN"),
            "sector_headers": F.when(c("header_lines") > 0, "YES").otherwise("NO"),
            "special_patterns": F.when(specials == "", "NONE").otherwise(specials),
        }
    )


def layout_risk(described: DataFrame) -> DataFrame:
    """Add the risk level, by number of risk conditions, and the compatibility."""
    c = F.col
    conditions = [
        c("layout_class") == "UNKNOWN",
        c("serial_lines") == 0,
        c("continued_pages") > 5,
        c("report_type") == "QUARTERLY",
        c("agency_layout") == "NONE_DETECTED",
        (c("serial_lines") > 0) & (c("code_lines") / F.greatest(c("serial_lines"), F.lit(1)) < 0.5),
    ]
    risks = reduce(lambda a, b: a + b, [x.cast("int") for x in conditions])
    table = F.create_map(*[F.lit(x) for pair in COMPATIBILITY.items() for x in pair])
    return described.withColumn("risk_conditions", risks).withColumns(
        {
            "risk_level": F.when(c("risk_conditions") >= 2, "HIGH")
            .when(c("risk_conditions") == 1, "MEDIUM").otherwise("LOW"),
            "compatibility": F.coalesce(F.try_element_at(table, c("layout_class")), F.lit("UNKNOWN")),
        }
    )


def audit_layouts(pages: DataFrame) -> DataFrame:
    """Full layout audit, one row per file."""
    return layout_risk(layout_descriptors(layout_class(layout_profile(pages))))


def layout_groups(audited: DataFrame) -> DataFrame:
    """Files and serial lines per layout class, compatibility and risk level."""
    pairs = F.array(
        *[
            F.struct(F.lit(f).alias("grouping"), F.col(f).alias("value"))
            for f in ("layout_class", "compatibility", "risk_level")
        ]
    )
    return (
        audited.select("serial_lines", "file", F.explode(pairs).alias("p"))
        .groupBy("p.grouping", "p.value")
        .agg(
            F.count("*").alias("files"),
            F.sum("serial_lines").alias("serial_lines"),
            F.min("file").alias("first_file"),
            F.max("file").alias("last_file"),
        )
    )
