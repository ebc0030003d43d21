"""Project records from classified report lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType

from ..functions.lexicon import (
    ALTERNATE_CODE_LINE,
    BOILERPLATE,
    MONTH_DATE_TOKEN,
    PAREN_GROUP,
    POLLUTED_NAME,
    PRIMARY_CODE_LINE,
    SERIAL_LINE,
    TOTAL_LINE,
)
from ..functions.months import normalise_flexible_month
from ..functions.text import (
    collapse_whitespace,
    extract_month_dates,
    longest_match,
    parse_numeric,
    strip,
    trailing_numbers,
    without_trailing_numbers,
)
from ..session import discard, written
from .lines import classified, serial_number, with_headers
from .prefix import null_safe_join, running_totals

PRIMARY = r"^\d{5,7}$"
ALTERNATE = r"^[NO]\d{7,9}$"
LEADING_PAREN = r"^\(([^)]+)\)\s*(.*)$"
PLACEHOLDERS = ("-", "", "NA", "N/A")  # fixed values
SMALLEST_JUMP = 200  # fixed value
OLDER_LAYOUTS = ("OLD_FORMAT_A", "OLD_FORMAT_B")  # fixed values


def _serial_walks():
    """(last accepted serial, verdicts) of a block's serials behind the serial accepted last, -1 if there is none.

    A serial is accepted if it is close enough to the last accepted one; the first always is.
    Functions made here reach the executors by value, with no need for this package there.
    """

    def walk(serials: list[int], last: int) -> tuple[int, list[bool]]:
        verdicts = []
        for serial in serials:
            near = last < 0 or abs(serial - last) <= max(SMALLEST_JUMP, last * 0.5)
            verdicts.append(near)
            if near:
                last = serial
        return last, verdicts

    def last_accepted(serials: pd.Series, start: pd.Series) -> pd.Series:
        return pd.Series([walk(s.tolist(), int(last))[0] for s, last in zip(serials, start)], dtype="int64")

    def accepted(serials: pd.Series, start: pd.Series) -> pd.Series:
        return pd.Series([walk(s.tolist(), int(last))[1] for s, last in zip(serials, start)], dtype="object")

    return F.pandas_udf(last_accepted, LongType()), F.pandas_udf(accepted, ArrayType(BooleanType()))


def accepted_serials(lines: DataFrame) -> DataFrame:
    """(file, page, position, serial) of the serial lines that are in sequence."""
    return judged_serials(lines).where("accepted").drop("accepted")


def judged_serials(lines: DataFrame) -> DataFrame:
    """(file, page, position, serial, accepted) of the serial lines.

    A serial is judged against the last serial accepted before it. The serials of a block of
    pages are one row and are read in order by one task, from a first guess of the serial accepted
    last before the block. Then each block takes what the blocks before it ended with, and those
    for which that is new are read again, until nothing changes. A block depends on earlier
    blocks only, so each pass settles at least one more block of a file: the loop ends, and what
    it ends with is what reading the lines in order gives. A walk forgets its start at the first
    serial that both starts accept, so a few passes do. Only the serial lines take part.
    """
    serial = F.struct("page", "position", serial_number(F.col("line")).alias("serial"))
    at = F.sort_array(F.collect_list("at"))
    blocks = written(
        lines.where(F.col("line_class") == "serial")
        .select("file", "block", serial.alias("at"))
        # a number too long for a serial is in no sequence
        .where(F.col("at.serial").isNotNull())
        .groupBy("file", "block").agg(at.alias("at"))
        .select("file", "block", "at", F.col("at.serial").alias("serials")),
        "serial-blocks",
    )
    last_accepted, verdicts = _serial_walks()
    none = F.lit(-1).cast("long")
    ends = written(
        blocks.select("file", "block", none.alias("start")).withColumn("end", none).withColumn("changed", F.lit(True)),
        "serial-ends",
    )
    before = Window.partitionBy("file").orderBy("block")
    key = [F.col(f"b.{c}").eqNullSafe(F.col(f"e.{c}")) for c in ("file", "block")]
    while ends.where("changed").take(1):
        todo = blocks.select("file", "block", "serials").alias("b").join(ends.where("changed").alias("e"), key)
        read = todo.select("b.file", "b.block", "e.start", last_accepted("b.serials", "e.start").alias("end"))
        known = ends.where(~F.col("changed")).select("file", "block", "start", "end").unionByName(read)
        given = F.coalesce(F.lag("end").over(before), none)
        following = written(
            known.withColumn("given", given).select(
                "file", "block", F.col("given").alias("start"), "end", (F.col("given") != F.col("start")).alias("changed")
            ),
            "serial-ends",
        )
        discard(ends)
        ends = following
    judged = blocks.alias("b").join(ends.alias("e"), key).select(
        "b.file", F.explode(F.arrays_zip("b.at", verdicts("b.serials", "e.start").alias("accepted"))).alias("line")
    )
    return judged.select("file", "line.at.*", "line.accepted")


def segmented(
    lines: DataFrame, check_continuity: bool = True, boilerplate: tuple[str, ...] = BOILERPLATE
) -> DataFrame:
    """Lines of each record: its name lines, serial line and parenthetical lines.

    A record is numbered by counting serial lines in file order. Text before a serial
    belongs to it unless a printed total lies between, and parenthetical lines belong to
    the serial they directly follow.
    """
    # Read several times below: written once, so the text is classified only once.
    rows = written(with_headers(lines, boilerplate), "report-lines")
    rows = rows.withColumn("serial", F.when(F.col("line_class") == "serial", serial_number(F.col("line"))))
    if check_continuity:
        # The refused ones are few, so the lines need not be moved to be joined with them.
        places = ["file", "page", "position"]
        refused = judged_serials(rows).where(~F.col("accepted")).select(*places, F.lit(True).alias("refused"))
        rows = null_safe_join(rows, written(refused, "refused-serials"), places)
        stays = F.col("refused").isNull() & F.col("serial").isNotNull()
        rows = rows.withColumns(
            {
                "serial": F.when(stays, F.col("serial")),
                "line_class": F.when((F.col("line_class") == "serial") & ~stays, "text").otherwise(F.col("line_class")),
            }
        ).drop("refused")
    follows = (F.col("line_class") == "parenthetical") & (F.col("last_class") == "serial")
    part = (
        F.when(F.col("line_class") == "serial", "serial")
        .when(follows, "values")
        .when(F.col("line_class").isin("text", "parenthetical"), "name")
    )
    marked = rows.withColumns(
        {
            "part": part,
            "is_serial": (F.col("line_class") == "serial").cast("int"),
            "is_total": (F.col("line_class") == "total").cast("int"),
        }
    )
    counted = running_totals(
        marked, ["file"], ["block", "page"], ["position"], ["is_serial", "is_total"]
    )
    record = F.when(F.col("part") == "values", F.col("is_serial_before")).otherwise(
        F.col("is_serial_before") + 1
    )
    return (
        counted.where(F.col("part").isNotNull())
        .withColumns({"record": record, "totals": F.col("is_total_before")})
        .drop("is_serial", "is_total", "is_serial_before", "is_total_before", "last_class")
    )


def _paren_groups(line: Column) -> Column:
    groups = F.regexp_extract_all(line, F.lit(PAREN_GROUP), F.lit(1))
    return F.transform(groups, strip)


def identifier_pair(groups: Column) -> Column:
    """Two groups led by an alternate id or a placeholder: never a primary code."""
    first = F.get(groups, 0)
    return (F.size(groups) == 2) & (first.isin(*PLACEHOLDERS) | first.rlike(ALTERNATE))


def _after_agency(text: Column) -> Column:
    """Text behind a leading parenthesised agency, or all of it."""
    return F.when(text.rlike(LEADING_PAREN), F.regexp_extract(text, LEADING_PAREN, 2)).otherwise(text)


def printed_place(text: Column) -> Column:
    """The state of a serial line: the known state, a list of states as printed, or the text.

    A list that goes on below ends with a comma.
    """
    known = longest_match(text)
    listed = F.btrim(strip(text), F.lit("()"))
    is_list = F.contains(listed, F.lit(",")) & ~F.rtrim(listed).endswith(")")
    return F.when(
        known.isNotNull() & is_list, F.when(listed.endswith(","), listed).otherwise(F.concat(listed, F.lit(",")))
    ).otherwise(F.coalesce(known, strip(text)))


def record_fields(lines: DataFrame, dates_on_serial: bool = False) -> DataFrame:
    """One row per record with its fields, identifiers and statuses.

    Each line yields its own tokens first; a record then takes them in reading order.
    Codes of 5-7 digits are primary, an N or O with 7-9 digits is alternate, and the
    second value of an identifier pair is neither. A single number on the serial line is
    the progress. Dates in the value line are start and revised completion; in the older layout
    (``dates_on_serial``) the start is the first date of the serial line.
    """
    part = F.col("part")
    on_name, on_serial, on_values = part == "name", part == "serial", part == "values"
    # What each line holds is worked out once, then picked from below.
    body = F.when(on_serial, F.regexp_extract("line", SERIAL_LINE, 2)).otherwise(F.col("line"))
    read = (
        lines.withColumn("body", F.when(~on_values, body))
        .withColumns(
            {
                "numbers": trailing_numbers(F.col("body")),
                "bare": without_trailing_numbers(F.col("body")),
                "dates": F.when(on_name, extract_month_dates(F.col("body"))),
                "serial_dates": F.when(on_serial & F.lit(dates_on_serial), extract_month_dates(F.col("body"))),
                "groups": F.when(on_values, _paren_groups(F.col("line"))),
            }
        )
        .withColumns(
            {
                "pair": F.coalesce(identifier_pair(F.col("groups")), F.lit(False)),
                "value_dates": F.filter("groups", lambda g: g.rlike(f"^{MONTH_DATE_TOKEN}$")),
                "alternates": F.filter("groups", lambda g: g.rlike(ALTERNATE)),
                "primaries": F.filter("groups", lambda g: g.rlike(PRIMARY)),
                "agency_text": F.when(
                    F.col("bare").startswith("("), strip(F.regexp_extract("bare", LEADING_PAREN, 1))
                ),
            }
        )
    )
    numbers, groups, values = F.col("numbers"), F.col("groups"), on_values & ~F.col("pair")
    costs = F.filter(
        F.transform(
            F.filter(groups, lambda g: ~g.rlike(f"{PRIMARY}|{ALTERNATE}|^{MONTH_DATE_TOKEN}$")), parse_numeric
        ),
        lambda n: n.isNotNull(),
    )
    name_text = _after_agency(strip(F.regexp_replace("bare", MONTH_DATE_TOKEN, "")))
    undated = F.regexp_replace("bare", MONTH_DATE_TOKEN, "") if dates_on_serial else F.col("bare")
    place = _after_agency(strip(undated))
    agency = F.when(F.col("agency_text") != "", F.col("agency_text"))
    tokens = read.select(
        "file", "record", "totals", "page", "position", "serial", "sector", "ministry",
        F.struct("page", "position").alias("at"),
        F.when(on_name, name_text).alias("name_part"),
        F.when(F.size("dates") > 0, F.col("dates")).alias("name_dates"),
        F.when(on_name & (F.size(numbers) > 0), F.element_at(numbers, -1)).alias("name_cost"),
        F.when(on_name, agency).alias("name_agency"),
        F.when(on_serial, agency).alias("serial_agency"),
        F.when(on_serial, printed_place(place)).alias("state"),
        F.when(on_serial & (F.size(numbers) >= 2), F.element_at(numbers, -2)).alias("expenditure"),
        F.when(on_serial & (F.size(numbers) >= 1), F.element_at(numbers, -1)).alias("progress"),
        F.when(values, F.get("primaries", 0)).alias("code"),
        F.when(F.size("alternates") > 0, F.element_at("alternates", -1)).alias("legacy"),
        (
            F.get("serial_dates", 0) if dates_on_serial else F.when(values, F.get("value_dates", 0))
        ).alias("start_date"),
        F.when(values, F.get("value_dates", 0 if dates_on_serial else 1)).alias("revised_doc"),
        F.when(
            values & (F.size(groups) >= 3) & (F.size("value_dates") > 0), F.get(costs, F.size(costs) - 1)
        ).alias("revised_cost"),
    )

    # Text that leads to no serial line is no record. It is left out before grouping: it
    # may be most of a file, and a join can split such a key where a grouping cannot.
    keys = ["file", "record", "totals"]
    with_serial = lines.where(on_serial).select(*keys)
    tokens = tokens.join(with_serial, keys, "left_semi")

    def first(name: str) -> Column:
        return F.min_by(F.col(name), F.when(F.col(name).isNotNull(), F.col("at")))

    def last(name: str) -> Column:
        return F.max_by(F.col(name), F.when(F.col(name).isNotNull(), F.col("at")))

    parts = F.array_sort(
        F.collect_list(F.when(F.col("name_part") != "", F.struct("page", "position", "name_part")))
    )
    dates = F.array_sort(
        F.collect_list(F.when(F.col("name_dates").isNotNull(), F.struct("page", "position", "name_dates")))
    )
    records = (
        tokens.groupBy("file", "record", "totals")
        .agg(
            F.max("serial").alias("sl_no"),
            F.max(F.when(F.col("serial").isNotNull(), F.col("page"))).alias("source_page"),
            F.max(F.when(F.col("serial").isNotNull(), F.col("sector"))).alias("sector"),
            F.max(F.when(F.col("serial").isNotNull(), F.col("ministry"))).alias("ministry"),
            F.array_join(F.transform(parts, lambda p: p["name_part"]), " ").alias("name"),
            F.flatten(F.transform(dates, lambda d: d["name_dates"])).alias("dates"),
            last("name_cost").alias("original_cost"),
            F.coalesce(first("name_agency"), first("serial_agency")).alias("agency"),
            first("state").alias("state"),
            first("expenditure").alias("expenditure"),
            first("progress").alias("physical_progress"),
            first("code").alias("project_code"),
            last("legacy").alias("legacy_ocms_code"),
            last("start_date").alias("start_date"),
            last("revised_doc").alias("revised_doc"),
            last("revised_cost").alias("revised_cost"),
        )
        .where(F.col("sl_no").isNotNull())
    )
    name = collapse_whitespace(F.col("name"))
    return records.select(
        "file", "sl_no", "project_code", "legacy_ocms_code",
        F.when(F.col("project_code").isNotNull(), "PRIMARY_IDENTIFIER")
        .when(F.col("legacy_ocms_code").isNotNull(), "ALTERNATE_IDENTIFIER")
        .otherwise("UNKNOWN")
        .alias("identifier_status"),
        F.when(name != "", name).alias("project_name"),
        collapse_whitespace(F.col("agency")).alias("agency"),
        "ministry", "sector", "state",
        F.get("dates", 0).alias("date_of_approval"), "start_date",
        F.get("dates", 1).alias("original_doc"), "revised_doc",
        "original_cost", "revised_cost", "expenditure", "physical_progress", "source_page",
        F.when(F.col("project_code").isNotNull(), "SUCCESS").otherwise("PARTIAL").alias("extraction_status"),
    )


def extract_records(
    lines: DataFrame,
    check_continuity: bool = True,
    layout: str | None = None,
    boilerplate: tuple[str, ...] = BOILERPLATE,
) -> DataFrame:
    """Project records of report pages of one layout; the older layouts print the start on the serial line."""
    # Read twice by the fields, for their tokens and for their serial lines.
    segments = written(segmented(lines, check_continuity, boilerplate), "segments")
    return record_fields(segments, layout in OLDER_LAYOUTS)


def printed_dates(cell: Column) -> Column:
    """(original, revised) months of a multi-line cell; braced anticipated dates are left out."""
    lines = F.filter(F.transform(F.split(cell, "\n"), strip), lambda x: ~x.startswith("{"))
    dated = F.filter(
        F.transform(
            lines,
            lambda x: F.struct(x.startswith("(").alias("revised"), normalise_flexible_month(x).alias("month")),
        ),
        lambda x: x["month"].isNotNull(),
    )
    plain = F.filter(dated, lambda x: ~x["revised"])
    bracketed = F.filter(dated, lambda x: x["revised"])
    return F.struct(
        F.get(plain, 0)["month"].alias("original"),
        F.get(bracketed, F.size(bracketed) - 1)["month"].alias("revised"),
    )


def printed_costs(cell: Column) -> Column:
    """(original, revised) amounts of a multi-line cell; braced anticipated costs are left out."""
    lines = F.filter(F.transform(F.split(cell, "\n"), strip), lambda x: ~x.startswith("{"))
    priced = F.filter(
        F.transform(
            lines,
            lambda x: F.struct(
                x.startswith("(").alias("revised"),
                parse_numeric(F.regexp_replace(x, r"^[() ]+|[() ]+$", "")).alias("amount"),
            ),
        ),
        lambda x: x["amount"].isNotNull(),
    )
    plain = F.filter(priced, lambda x: ~x["revised"])
    bracketed = F.filter(priced, lambda x: x["revised"])
    return F.struct(
        F.get(plain, 0)["amount"].alias("original"),
        F.get(bracketed, F.size(bracketed) - 1)["amount"].alias("revised"),
    )


CELL_CODE = r"^\((?:[NO]\d{7,9}|\d{6,9})\)$"
ONE_PAREN = r"^\(([^)]+)\)$"


def project_cell(cell: Column) -> Column:
    """(name, agency, alternate_id) of a multi-line project cell.

    The last code line is the identifier; a parenthesised line right before it is the
    agency; everything else is the name.
    """
    lines = F.filter(F.transform(F.split(cell, "\n"), strip), lambda x: x != "")
    positions = F.transform(lines, lambda x, i: F.when(x.rlike(CELL_CODE), i))
    code_at = F.array_max(positions)
    before = F.get(lines, code_at - 1)
    content = strip(F.regexp_extract(before, ONE_PAREN, 1))
    is_agency = (
        (code_at > 0) & before.rlike(ONE_PAREN) & ~content.isin("-", "N.A.", "N/A")
    )
    agency_at = F.when(F.coalesce(is_agency, F.lit(False)), code_at - 1)
    name = F.filter(
        lines,
        lambda x, i: (i != F.coalesce(code_at, F.lit(-1))) & (i != F.coalesce(agency_at, F.lit(-1))),
    )
    return F.struct(
        F.array_join(name, " ").alias("name"),
        F.when(agency_at.isNotNull(), content).otherwise("").alias("agency"),
        F.when(code_at.isNotNull(), strip(F.regexp_extract(F.get(lines, code_at), ONE_PAREN, 1)))
        .otherwise("")
        .alias("alternate_id"),
    )


def printed_totals(lines: DataFrame, boilerplate: tuple[str, ...] = BOILERPLATE) -> DataFrame:
    """Sum of the printed totals, records and highest serial of each file.

    The totals reconcile when all three agree.
    """
    rows = classified(lines, boilerplate)
    total = F.regexp_extract("line", TOTAL_LINE, 1).try_cast("long")
    is_total, is_serial = F.col("line_class") == "total", F.col("line_class") == "serial"
    table = rows.groupBy("file").agg(
        F.count_if(is_total).alias("total_lines"),
        F.coalesce(F.sum(F.when(is_total, total)), F.lit(0)).alias("printed_total"),
        F.count_if(is_serial).alias("records"),
        F.max(F.when(is_serial, serial_number(F.col("line")))).alias("highest_serial"),
    )
    agree = (F.col("printed_total") == F.col("records")) & (F.col("records") == F.col("highest_serial"))
    return table.withColumn("reconciled", F.coalesce(agree, F.lit(False)))


def serial_completeness(records: DataFrame) -> DataFrame:
    """Whether the serials of each file run from 1 to n without gaps or repeats."""
    per_serial = records.groupBy("file", "sl_no").agg(F.count("*").alias("n"))
    table = per_serial.groupBy("file").agg(
        F.sum("n").alias("records"),
        F.count("*").alias("distinct_serials"),
        F.min("sl_no").alias("lowest_serial"),
        F.max("sl_no").alias("highest_serial"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("repeated_serials"),
    )
    return table.withColumns(
        {
            "missing_serials": F.col("highest_serial") - F.col("distinct_serials"),
            "complete": (F.col("lowest_serial") == 1)
            & (F.col("highest_serial") == F.col("records"))
            & (F.col("repeated_serials") == 0),
        }
    )


def pollution_scan(records: DataFrame, name: str = "project_name") -> DataFrame:
    """Records per file whose name starts with a leaked code, date or parenthesis."""
    text = strip(F.coalesce(F.col(name), F.lit("")))
    polluted = text.rlike(POLLUTED_NAME) | (
        text.startswith("(") & F.contains(F.substring(text, 1, 30), F.lit(")"))
    )
    return records.groupBy("file").agg(
        F.count("*").alias("records"), F.count_if(polluted).alias("polluted_names")
    )


def extraction_summary(panel: DataFrame) -> DataFrame:
    """Records, field presence and extraction status per report month."""
    present = {
        "codes": "project_code", "states": "state", "agencies": "agency",
        "original_costs": "original_cost", "expenditures": "expenditure", "progress": "physical_progress",
    }
    return panel.groupBy("report_month").agg(
        F.count("*").alias("records"),
        *[F.count(c).alias(f"{n}_present") for n, c in present.items()],
        F.count_if(F.col("extraction_status") == "SUCCESS").alias("success_rows"),
        F.count_if(F.col("extraction_status") == "PARTIAL").alias("partial_rows"),
    )


def field_missingness(panel: DataFrame) -> DataFrame:
    """Null rows and null % of every column, from one aggregation row."""
    columns = panel.columns
    row = panel.agg(F.count("*").alias("n__all"), *[F.count(c).alias(c) for c in columns])
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"), (F.col("n__all") - F.col(c)).alias("null_rows"),
                F.round((F.col("n__all") - F.col(c)) * 100 / F.nullif("n__all", F.lit(0)), 6).alias("null_pct"),
            )
            for c in columns
        ]
    )
    return row.select(F.explode(rows).alias("r")).select("r.*")


def is_primary_code_line(line: Column) -> Column:
    """A line that is only a primary code."""
    return line.rlike(PRIMARY_CODE_LINE)


def is_alternate_code_line(line: Column) -> Column:
    """A line that is only an alternate code."""
    return line.rlike(ALTERNATE_CODE_LINE)
