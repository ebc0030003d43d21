"""Report-page text: lines, headers, records, cells and layout audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as lex
from ..functions.months import month_text
from ..operators import layout, lines, records
from ..sources import pages
from ..sources.panel import customer_month, supplier_month, table
from .registry import query
from .sqltext import CUSTOMER, SECTOR_LIST, STATE_LIST, SUPPLIER, month_text as sql_month_text, quoted, with_

_STRIP = "chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160)"


def _strip(value: str) -> str:
    return f"trim({value}, {_STRIP})"


def _split(source: str) -> str:
    return f"""lines AS (SELECT file, page, CAST(i AS INTEGER) AS position, {_strip('raw')} AS line FROM (
      SELECT file, page, unnest(range(len(parts))) AS i, unnest(parts) AS raw FROM (SELECT *, string_split(text, chr(10)) AS parts FROM {source})))"""


_DOCUMENTS = "document_pages AS (SELECT source AS file, CAST(doc_id AS BIGINT) AS page, text FROM documents)"
_HTML = """html_pages AS (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS file, CAST(page_id AS BIGINT) AS page,
  regexp_replace(html, '>\\s*<', '>' || chr(10) || '<', 'g') AS text FROM pages)"""


def _money(value: str) -> str:
    return f"CAST(CAST({value} AS DECIMAL(18,2)) AS VARCHAR)"


def _group(value: str) -> str:
    return f"'(' || coalesce({value}, '-') || ')'"


_STATE = f"{STATE_LIST}[CAST(regexp_extract(state, '(\\d+)$', 1) AS INTEGER) % {len(lex.STATES)} + 1]"
_SECTOR = f"{SECTOR_LIST}[sl_no % {len(lex.SECTORS)} + 1]"


def _report_pages(panel: str) -> str:
    return f"""blocks AS (SELECT source_file AS file, source_page AS page, sl_no, ministry, concat_ws(chr(10),
      CASE WHEN sl_no % 5 = 0 THEN {_SECTOR} END,
      concat_ws(' ', project_name, CASE WHEN date_of_approval <> 'N.A.' THEN date_of_approval END, original_doc, {_money('original_cost')}),
      concat_ws(' ', CAST(sl_no + 1 AS VARCHAR), '(' || agency || ')', {_STATE}, {_money('expenditure')}, {_money('physical_progress')}),
      concat_ws(' ', {_group('project_code')}, {_group('start_date')}, {_group('revised_doc')}, {_group(_money('revised_cost'))}),
      concat_ws(' ', {_group('legacy_ocms_code')}, {_group("CASE WHEN sl_no % 4 = 0 THEN '10550' END")})) AS block FROM {panel}),
    report_pages AS (SELECT file, page, concat_ws(chr(10), 'Table 6: All Ongoing Projects', 'Sl.No Project Name (Agency) State',
      CASE WHEN page % 2 = 1 THEN 'Ministry of ' || arg_min(ministry, sl_no) END, string_agg(block, chr(10) ORDER BY sl_no),
      'Total (' || count(*) || ')', '', 'Page ' || page) AS text FROM blocks GROUP BY file, page)"""


def _any(tests) -> str:
    return "(" + " OR ".join(tests) + ")"


_SKIP = _any(["line = ''", f"regexp_matches(line, '{lex.PAGE_NUMBER}')"] + [f"contains(line, {quoted(x)})" for x in lex.BOILERPLATE])
_HEADER = _any(
    [f"starts_with(line, {quoted(x)})" for x in lex.COLUMN_HEADER_STARTS]
    + [f"contains(line, {quoted(x)})" for x in lex.COLUMN_HEADER_PARTS]
    + [f"regexp_matches(line, '{lex.COLUMN_HEADER_PATTERN}')"]
)
_BANNER = f"regexp_matches(line, '{lex.MONTH_BANNER}')"
_BOILER = f"({_SKIP} OR {_HEADER} OR {_BANNER})"
_MINISTRY = f"regexp_matches(line, '{lex.MINISTRY_HEADER}')"
_IS_SECTOR = f"line IN ({', '.join(quoted(x) for x in lex.SECTORS)})"
_TOTAL = f"regexp_matches(line, '{lex.TOTAL_LINE}')"
_HAS_STATE = _any([f"contains(rest, {quoted(x)})" for x in lex.STATES])
_NUM = "regexp_matches(replace({t}, ',', ''), '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$')"
_SERIAL = f"""(is_serial_shape AND (({_HAS_STATE} AND {_NUM.format(t='toks[-1]')})
   OR (serial <= 3000 AND len(toks) >= 2 AND {_NUM.format(t='toks[-1]')} AND {_NUM.format(t='toks[-2]')})))"""
_CLASSED = f"""shaped AS (SELECT *, regexp_matches(line, '{lex.SERIAL_LINE}') AS is_serial_shape,
    TRY_CAST(regexp_extract(line, '{lex.SERIAL_LINE}', 1) AS BIGINT) AS serial, regexp_extract(line, '{lex.SERIAL_LINE}', 2) AS rest,
    string_split_regex({_strip(f"regexp_extract(line, '{lex.SERIAL_LINE}', 2)")}, '\\s+') AS toks FROM lines),
classed AS (SELECT *, CASE WHEN {_BOILER} THEN 'boilerplate' WHEN {_MINISTRY} THEN 'ministry' WHEN {_IS_SECTOR} THEN 'sector' WHEN {_TOTAL} THEN 'total'
    WHEN coalesce({_SERIAL}, false) THEN 'serial' WHEN regexp_matches(line, '{lex.ONLY_PARENS_LINE}') THEN 'parenthetical' ELSE 'text' END AS line_class FROM shaped)"""


def _supplier_pages(spark, folder):
    return pages.report_pages_from_panel(supplier_month(spark, folder)).drop("report_month")


def _supplier_lines(spark, folder):
    return lines.page_lines(_supplier_pages(spark, folder))


_PAGES = (SUPPLIER, _report_pages("panel"), _split("report_pages"))


@query("page_lines", with_("SELECT * FROM lines", _DOCUMENTS, _split("document_pages")))
def page_lines(spark, folder):
    return lines.page_lines(pages.document_pages(spark, folder))


@query(
    "boilerplate_filter",
    with_(f"SELECT file, page, count(*) AS data_lines FROM lines WHERE NOT {_BOILER} GROUP BY 1, 2", *_PAGES),
)
def boilerplate_filter(spark, folder):
    return lines.data_lines(_supplier_lines(spark, folder)).groupBy("file", "page").agg(F.count("*").alias("data_lines"))


_COUNT_CLASSES = "SELECT file, line_class, count(*) AS lines FROM classed GROUP BY 1, 2"


@query("line_classes", with_(_COUNT_CLASSES, *_PAGES, _CLASSED))
def line_classes(spark, folder):
    return lines.class_counts(_supplier_lines(spark, folder))


@query("line_classes_documents", with_(_COUNT_CLASSES, _DOCUMENTS, _split("document_pages"), _CLASSED))
def line_classes_documents(spark, folder):
    return lines.class_counts(lines.page_lines(pages.document_pages(spark, folder)))


@query("line_classes_html", with_(_COUNT_CLASSES, _HTML, _split("html_pages"), _CLASSED))
def line_classes_html(spark, folder):
    return lines.class_counts(lines.page_lines(pages.html_pages(spark, folder)))


@query(
    "section_page_ranges",
    with_(
        f"""SELECT file, min(page) AS first_page, max(page) AS last_page, count(*) AS section_pages FROM report_pages
        WHERE contains(substr({_strip('text')}, 1, 300), 'All Ongoing Projects') GROUP BY 1""",
        SUPPLIER, _report_pages("panel"),
    ),
)
def section_page_ranges(spark, folder):
    return lines.section_pages(_supplier_pages(spark, folder))


@query(
    "header_carry_forward",
    with_(
        """SELECT file, page, position, line_class, sector, ministry FROM (SELECT *,
             last_value(CASE WHEN line_class = 'sector' THEN line END IGNORE NULLS) OVER w AS sector,
             last_value(CASE WHEN line_class = 'ministry' THEN line END IGNORE NULLS) OVER w AS ministry
           FROM classed WHERE line_class <> 'boilerplate'
           WINDOW w AS (PARTITION BY file ORDER BY page, position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
        *_PAGES, _CLASSED,
    ),
)
def header_carry_forward(spark, folder):
    return lines.with_headers(_supplier_lines(spark, folder)).select(
        "file", "page", "position", "line_class", "sector", "ministry"
    )


@query(
    "header_carry_forward_documents",
    with_(
        """SELECT file, page, position, last_class FROM (SELECT *,
             last_value(CASE WHEN line_class <> 'parenthetical' THEN line_class END IGNORE NULLS) OVER w AS last_class
           FROM classed WHERE line_class <> 'boilerplate'
           WINDOW w AS (PARTITION BY file ORDER BY page, position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
        _DOCUMENTS, _split("document_pages"), _CLASSED,
    ),
)
def header_carry_forward_documents(spark, folder):
    rows = lines.with_headers(lines.page_lines(pages.document_pages(spark, folder)))
    return rows.select("file", "page", "position", "last_class")


_EXPECTED = f"""page_ministry AS (SELECT source_file, source_page, CASE WHEN source_page % 2 = 1 THEN 'Ministry of ' || arg_min(ministry, sl_no) END AS m
  FROM panel GROUP BY 1, 2),
page_carry AS (SELECT *, last_value(m IGNORE NULLS) OVER (PARTITION BY source_file ORDER BY source_page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried
  FROM page_ministry),
record_rows AS (SELECT p.*, carried, last_value(CASE WHEN sl_no % 5 = 0 THEN {_SECTOR} END IGNORE NULLS)
    OVER (PARTITION BY source_file ORDER BY sl_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS printed_sector
  FROM panel p JOIN page_carry USING (source_file, source_page)),
expected AS (
  SELECT source_file AS file, CAST(sl_no + 1 AS BIGINT) AS sl_no, project_code, legacy_ocms_code,
    CASE WHEN project_code IS NOT NULL THEN 'PRIMARY_IDENTIFIER' WHEN legacy_ocms_code IS NOT NULL THEN 'ALTERNATE_IDENTIFIER' ELSE 'UNKNOWN' END AS identifier_status,
    project_name, agency, carried AS ministry, printed_sector AS sector, {_STATE} AS state,
    CASE WHEN date_of_approval <> 'N.A.' THEN date_of_approval ELSE original_doc END AS date_of_approval,
    coalesce(start_date, revised_doc) AS start_date,
    CASE WHEN date_of_approval <> 'N.A.' THEN original_doc END AS original_doc,
    CASE WHEN start_date IS NOT NULL THEN revised_doc END AS revised_doc,
    round(original_cost, 2) AS original_cost,
    CASE WHEN start_date IS NOT NULL OR revised_doc IS NOT NULL THEN round(revised_cost, 2) END AS revised_cost,
    CASE WHEN physical_progress IS NOT NULL THEN round(expenditure, 2) END AS expenditure,
    coalesce(physical_progress, round(expenditure, 2)) AS physical_progress,
    source_page, CASE WHEN project_code IS NOT NULL THEN 'SUCCESS' ELSE 'PARTIAL' END AS extraction_status
  FROM record_rows)"""


@query("extracted_records", with_("SELECT * FROM expected", SUPPLIER, _EXPECTED))
def extracted_records(spark, folder):
    return records.extract_records(_supplier_lines(spark, folder))


@query(
    "record_segmentation",
    with_(
        "SELECT file, sl_no + 1 AS serial, 2::BIGINT AS value_lines, 1::BIGINT AS name_lines FROM (SELECT source_file AS file, sl_no::BIGINT AS sl_no FROM panel)",
        SUPPLIER,
    ),
)
def record_segmentation(spark, folder):
    segments = records.segmented(_supplier_lines(spark, folder), check_continuity=False)
    part = F.col("part")
    grouped = segments.groupBy("file", "record", "totals").agg(
        F.max("serial").alias("serial"), F.count_if(part == "values").alias("value_lines"),
        F.count_if(part == "name").alias("name_lines"),
    )
    return grouped.where(F.col("serial").isNotNull()).select("file", "serial", "value_lines", "name_lines")


_CELL_ORDERS = """o AS (SELECT *, CAST(year(o_orderdate) * 12 + month(o_orderdate) + 300 AS INTEGER) AS m,
  CAST(o_totalprice::DECIMAL(18,2) AS VARCHAR) AS cents, o_orderkey % 4 AS form FROM orders)"""


def _cell_orders(spark, folder):
    rows = table(spark, folder, "orders")
    return rows.withColumns(
        {
            "m": (F.year("o_orderdate") * 12 + F.month("o_orderdate") + 300),
            "cents": F.col("o_totalprice").cast("decimal(18,2)").cast("string"),
            "form": F.col("o_orderkey") % 4,
        }
    )


@query(
    "printed_dates_and_costs",
    with_(
        f"""SELECT o_orderkey, {sql_month_text('m')} AS original_date, CASE WHEN form = 0 THEN {sql_month_text('(m + 12)')} END AS revised_date,
          CAST(cents AS DOUBLE) AS original_cost, CASE WHEN form = 0 THEN CAST(cents AS DOUBLE) WHEN form = 2 THEN 5.5 END AS revised_cost FROM o""",
        _CELL_ORDERS,
    ),
)
def printed_dates_and_costs(spark, folder):
    rows = _cell_orders(spark, folder)
    m, cents, form = F.col("m"), F.col("cents"), F.col("form")
    date_cell = F.concat_ws(
        "\n", F.regexp_replace(month_text(m), "^0", ""),
        F.when(form == 0, F.concat(F.lit("("), month_text(m + 12), F.lit(")"))).otherwise("(N.A.)"),
        F.concat(F.lit("{"), month_text(m + 24), F.lit("}")),
    )
    cost_cell = F.concat_ws(
        "\n", cents,
        F.when(form == 0, F.concat(F.lit("("), cents, F.lit(")"))).when(form == 2, "(5.5)").otherwise("(N.A.)"),
        F.concat(F.lit("{"), cents, F.lit("}")),
    )
    dates, costs = records.printed_dates(date_cell), records.printed_costs(cost_cell)
    return rows.select(
        "o_orderkey", dates["original"].alias("original_date"), dates["revised"].alias("revised_date"),
        costs["original"].alias("original_cost"), costs["revised"].alias("revised_cost"),
    )


@query(
    "project_cells",
    with_(
        """SELECT o_orderkey, 'LONG ' || o_orderpriority || ' NAME (PHASE II)' || CASE WHEN form = 2 THEN ' (-)' WHEN form = 3 THEN ' (NHAI)' ELSE '' END AS name,
          CASE WHEN form IN (0, 1) THEN 'AGENCY ' || o_orderstatus ELSE '' END AS agency,
          CASE WHEN form = 0 THEN 'N' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') WHEN form IN (1, 2) THEN CAST(o_orderkey + 1000000 AS VARCHAR) ELSE '' END AS alternate_id
        FROM o""",
        _CELL_ORDERS,
    ),
)
def project_cells(spark, folder):
    rows = _cell_orders(spark, folder)
    form, key = F.col("form"), F.col("o_orderkey").cast("string")
    code = F.when(form == 0, F.concat(F.lit("(N"), F.lpad(key, 8, "0"), F.lit(")"))).when(
        form.isin(1, 2), F.concat(F.lit("("), (F.col("o_orderkey") + 1000000).cast("string"), F.lit(")"))
    )
    agency = F.when(form.isin(0, 1), F.concat(F.lit("(AGENCY "), "o_orderstatus", F.lit(")"))).when(form == 2, "(-)").otherwise("(NHAI)")
    cell = F.concat_ws(
        "\n", F.concat(F.lit("LONG "), "o_orderpriority"), F.lit("  NAME (PHASE II) "), agency, code
    )
    parts = records.project_cell(cell)
    return rows.select("o_orderkey", parts["name"].alias("name"), parts["agency"].alias("agency"), parts["alternate_id"].alias("alternate_id"))


@query(
    "nearest_marker",
    with_(
        """, marks AS (SELECT file, page, position * 6 AS top, line AS label FROM classed WHERE line_class IN ('sector', 'ministry')),
        serials AS (SELECT file, page, position * 6 AS top, serial FROM classed WHERE line_class = 'serial')
        SELECT s.file, s.page, s.serial, s.top, arg_max(m.label, m.top) AS label FROM serials s
        LEFT JOIN marks m ON m.file = s.file AND m.page = s.page AND m.top <= s.top + 8 GROUP BY 1, 2, 3, 4""",
        *_PAGES, _CLASSED,
    ),
)
def nearest_marker(spark, folder):
    rows = lines.classified(_supplier_lines(spark, folder)).withColumn("top", F.col("position") * 6)
    serials = rows.where(F.col("line_class") == "serial").select(
        "file", "page", "top", lines.serial_number(F.col("line")).alias("serial")
    )
    markers = rows.where(F.col("line_class").isin("sector", "ministry")).select(
        "file", "page", "top", F.col("line").alias("label")
    )
    return lines.nearest_marker(serials, markers).select("file", "page", "serial", "top", "label")


_CONTINUED = f"""starts AS (SELECT file, page, arg_min(line, position) AS line FROM lines WHERE position < 10 AND NOT {_BOILER} GROUP BY 1, 2),
continued AS (SELECT file, count(*) AS section_pages, CAST(sum(c) - arg_min(c, page) AS BIGINT) AS continued_pages FROM (
  SELECT file, page, CAST(coalesce(NOT ({_MINISTRY} OR {_IS_SECTOR} OR {_TOTAL} OR regexp_matches(line, '{lex.SERIAL_LINE}')), false) AS INTEGER) AS c
  FROM report_pages LEFT JOIN starts USING (file, page)) GROUP BY 1)"""


@query("page_break_continuation", with_("SELECT * FROM continued", *_PAGES, _CONTINUED))
def page_break_continuation(spark, folder):
    return lines.continued_pages(_supplier_pages(spark, folder))


_LAYOUT = f"""body AS (SELECT *, ({_IS_SECTOR} OR {_MINISTRY}) AS header, NOT ({_IS_SECTOR} OR {_MINISTRY}) AND {_TOTAL} AS total FROM shaped WHERE NOT {_BOILER}),
flagged AS (SELECT *, NOT header AND NOT total AND is_serial_shape AND {_HAS_STATE} AND regexp_matches(rest, '\\d+\\.?\\d*\\s*$') AND serial <= 3000 AS is_row,
   regexp_matches(line, '{lex.PRIMARY_CODE_LINE}') AS code, regexp_matches(line, '{lex.ALTERNATE_CODE_LINE}') AS alt FROM body),
counted AS (SELECT file, count(*) FILTER (WHERE is_row) AS serial_lines, count(*) FILTER (WHERE NOT header AND NOT total AND code) AS code_lines,
   count(*) FILTER (WHERE NOT header AND NOT total AND alt) AS alternate_lines,
   count(*) FILTER (WHERE NOT header AND NOT total AND regexp_matches(line, '{lex.TRIPLE_PAREN_LINE}')) AS triple_paren_lines,
   count(*) FILTER (WHERE header) AS header_lines, count(*) FILTER (WHERE total) AS total_lines,
   count(*) FILTER (WHERE is_row AND regexp_matches(rest, '\\([A-Za-z]')) AS agency_on_serial,
   count(*) FILTER (WHERE NOT header AND NOT total AND regexp_matches(line, '^\\([A-Za-z].*\\)$') AND NOT code AND NOT alt) AS agency_separate,
   count(*) FILTER (WHERE is_row AND regexp_matches(rest, '{lex.MONTH_DATE_TOKEN}')) AS dates_on_serial FROM flagged GROUP BY 1),
audit AS (SELECT file, page_count AS pages, serial_lines, code_lines, alternate_lines, triple_paren_lines, header_lines, total_lines, agency_on_serial, agency_separate,
   dates_on_serial, section_pages, continued_pages, 'Table 6' AS table_label, 1 AS front_table6,
   CASE WHEN alternate_lines > 0 THEN 'NEW_FORMAT_A' WHEN triple_paren_lines::DOUBLE / greatest(serial_lines, 1) >= 0.3 THEN 'TRANSITIONAL_FORMAT' ELSE 'NEW_FORMAT_B' END AS layout_class
   FROM counted JOIN continued USING (file) JOIN (SELECT file, count(*) AS page_count FROM report_pages GROUP BY 1) USING (file)),
audited AS (SELECT *, CASE WHEN agency_on_serial > 0 AND agency_separate > 0 THEN 'MIXED' WHEN agency_on_serial > 0 THEN 'SAME_LINE' WHEN agency_separate > 0 THEN 'SEPARATE_LINE' ELSE 'NONE_DETECTED' END AS agency_layout,
   concat_ws('; ', CASE WHEN section_pages < 10 THEN 'LOW_PAGE_COUNT(' || section_pages || ')' END, CASE WHEN total_lines > 0 THEN 'TOTAL_LINES(' || total_lines || ')' END,
     CASE WHEN serial_lines > 2000 THEN 'HIGH_PROJECT_COUNT(' || serial_lines || ')' WHEN serial_lines > 0 AND serial_lines < 100 THEN 'LOW_PROJECT_COUNT(' || serial_lines || ')'
          WHEN serial_lines = 0 THEN 'ZERO_PROJECTS_DETECTED' END) AS special_patterns,
   CASE WHEN continued_pages > 0 THEN 'RECORDS_SPLIT (' || continued_pages || ' occurrences)' ELSE 'CLEAN' END AS page_break_pattern FROM audit),
risked AS (SELECT *, CAST(serial_lines = 0 AS INTEGER) + CAST(continued_pages > 5 AS INTEGER) + CAST(agency_layout = 'NONE_DETECTED' AS INTEGER)
   + CAST(serial_lines > 0 AND code_lines::DOUBLE / greatest(serial_lines, 1) < 0.5 AS INTEGER) AS risk_conditions FROM audited),
levelled AS (SELECT *, CASE WHEN risk_conditions >= 2 THEN 'HIGH' WHEN risk_conditions = 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
   CASE layout_class WHEN 'NEW_FORMAT_A' THEN 'PARSER_COMPATIBLE' WHEN 'TRANSITIONAL_FORMAT' THEN 'PARSER_NEEDS_MINOR_ADAPTATION' ELSE 'PARSER_NEEDS_NEW_HANDLER' END AS compatibility FROM risked)"""
_AUDIT = (*_PAGES, _CLASSED, _CONTINUED, _LAYOUT)
_COUNTS = (
    "file", "pages", "section_pages", "continued_pages", "serial_lines", "code_lines", "alternate_lines", "triple_paren_lines",
    "header_lines", "total_lines", "agency_on_serial", "agency_separate", "dates_on_serial", "table_label",
)


@query("layout_profile", with_(f"SELECT {', '.join(_COUNTS)} FROM levelled", *_AUDIT))
def layout_profile(spark, folder):
    return layout.layout_profile(_supplier_pages(spark, folder)).select(*_COUNTS)


_AUDIT_COLUMNS = ("file", "layout_class", "agency_layout", "special_patterns", "page_break_pattern", "risk_conditions", "risk_level", "compatibility")


@query("layout_audit", with_(f"SELECT {', '.join(_AUDIT_COLUMNS)} FROM levelled", *_AUDIT))
def layout_audit(spark, folder):
    return layout.audit_layouts(_supplier_pages(spark, folder)).select(*_AUDIT_COLUMNS)


@query(
    "layout_groups",
    with_(
        " UNION ALL ".join(
            f"SELECT '{g}' AS grouping, {g} AS value, count(*) AS files, CAST(sum(serial_lines) AS BIGINT) AS serial_lines, min(file) AS first_file, max(file) AS last_file FROM levelled GROUP BY 2"
            for g in ("layout_class", "compatibility", "risk_level")
        ),
        *_AUDIT,
    ),
)
def layout_groups(spark, folder):
    return layout.layout_groups(layout.audit_layouts(_supplier_pages(spark, folder)))


@query(
    "printed_total_reconciliation",
    with_(
        """SELECT file, (SELECT count(*) FROM report_pages r WHERE r.file = b.file) AS total_lines, count(*) AS printed_total, count(*) AS records,
          max(sl_no)::BIGINT + 1 AS highest_serial, count(*) = max(sl_no) + 1 AS reconciled FROM blocks b GROUP BY 1""",
        SUPPLIER, _report_pages("panel"),
    ),
)
def printed_total_reconciliation(spark, folder):
    return records.printed_totals(_supplier_lines(spark, folder))


_FALSE = "297000 + 10 * sl_no + 100000 * (i % 2)"


@query(
    "serial_continuity",
    with_(
        f""", printed AS (SELECT source_file AS file, sl_no, i, CASE WHEN i < k THEN {_FALSE} ELSE sl_no + 1 END AS serial
             FROM (SELECT *, unnest(range(0, k + 1)) AS i FROM (SELECT source_file, sl_no::BIGINT AS sl_no, CASE WHEN sl_no % 13 = 3 THEN 4 WHEN sl_no % 7 = 2 THEN 2 ELSE 0 END AS k FROM panel))),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY sl_no, i) AS n FROM printed),
        walk AS (SELECT file, n, serial AS last, true AS accepted FROM numbered WHERE n = 1
          UNION ALL SELECT s.file, s.n, CASE WHEN abs(s.serial - w.last) <= greatest(200, w.last * 0.5) THEN s.serial ELSE w.last END,
            abs(s.serial - w.last) <= greatest(200, w.last * 0.5) FROM walk w JOIN numbered s ON s.file = w.file AND s.n = w.n + 1)
        SELECT w.file, s.serial FROM walk w JOIN numbered s USING (file, n) WHERE w.accepted""",
        SUPPLIER,
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def serial_continuity(spark, folder):
    """Serials kept where two or four false ones stand before a true one."""
    number = F.col("sl_no").cast("long")
    extra = F.when(number % 13 == 3, 4).when(number % 7 == 2, 2).otherwise(0)
    printed = supplier_month(spark, folder).select(
        F.col("source_file").alias("file"), number.alias("page"), F.posexplode(F.sequence(F.lit(0), extra)).alias("position", "i"), extra.alias("k")
    )
    false = F.lit(297000) + F.col("page") * 10 + (F.col("i") % 2) * 100000
    serial = F.when(F.col("i") < F.col("k"), false).otherwise(F.col("page") + 1)
    return records.accepted_serials(
        lines.classified(printed.withColumn("line", F.concat(serial.cast("string"), F.lit(" Bihar 10.5 60"))))
    ).select("file", "serial")


@query(
    "serial_completeness",
    with_(
        """, s AS (SELECT source_file AS file, sl_no::BIGINT + 1 AS sl_no FROM panel UNION ALL SELECT source_file, sl_no::BIGINT + 1 FROM panel WHERE sl_no % 31 = 5)
        SELECT file, count(*) AS records, count(DISTINCT sl_no) AS distinct_serials, min(sl_no) AS lowest_serial, max(sl_no) AS highest_serial,
          count(*) - count(DISTINCT sl_no) AS repeated_serials, max(sl_no) - count(DISTINCT sl_no) AS missing_serials,
          min(sl_no) = 1 AND max(sl_no) = count(*) AND count(*) = count(DISTINCT sl_no) AS complete FROM s GROUP BY 1""",
        SUPPLIER,
    ),
)
def serial_completeness(spark, folder):
    rows = supplier_month(spark, folder).select(F.col("source_file").alias("file"), (F.col("sl_no").cast("long") + 1).alias("sl_no"))
    return records.serial_completeness(rows.unionByName(rows.where((F.col("sl_no") - 1) % 31 == 5)))


@query(
    "pollution_scan",
    with_(
        f"""SELECT file, count(*) AS records, count(*) FILTER (WHERE regexp_matches(trim(n), '{lex.POLLUTED_NAME}')
             OR (starts_with(trim(n), '(') AND contains(substr(trim(n), 1, 30), ')'))) AS polluted_names
        FROM (SELECT source_file AS file, CASE sl_no % 6 WHEN 1 THEN '(' || project_code || ') ' || project_name WHEN 2 THEN '(-) x' WHEN 3 THEN '(Land Work) y' WHEN 4 THEN '(any text' ELSE project_name END AS n
              FROM panel) GROUP BY 1""",
        CUSTOMER,
    ),
)
def pollution_scan(spark, folder):
    kind = F.col("sl_no") % 6
    name = (
        F.when(kind == 1, F.concat(F.lit("("), "project_code", F.lit(") "), "project_name")).when(kind == 2, "(-) x")
        .when(kind == 3, "(Land Work) y").when(kind == 4, "(any text").otherwise(F.col("project_name"))
    )
    rows = customer_month(spark, folder).select(F.col("source_file").alias("file"), name.alias("project_name"))
    return records.pollution_scan(rows)


@query(
    "extraction_summary",
    with_(
        """SELECT report_month, count(*) AS records, count(project_code) AS codes_present, count(state) AS states_present, count(agency) AS agencies_present,
          count(original_cost) AS original_costs_present, count(expenditure) AS expenditures_present, count(physical_progress) AS progress_present,
          count(*) FILTER (WHERE extraction_status = 'SUCCESS') AS success_rows, count(*) FILTER (WHERE extraction_status = 'PARTIAL') AS partial_rows FROM panel GROUP BY 1""",
        SUPPLIER,
    ),
)
def extraction_summary(spark, folder):
    return records.extraction_summary(supplier_month(spark, folder))


_COLUMNS = ("project_code", "legacy_ocms_code", "start_date", "revised_doc", "revised_cost", "physical_progress", "state")


@query(
    "field_missingness",
    with_(
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_rows, round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 6) AS null_pct FROM panel"
            for c in _COLUMNS
        ),
        CUSTOMER,
    ),
)
def field_missingness(spark, folder):
    return records.field_missingness(customer_month(spark, folder).select(*_COLUMNS))
