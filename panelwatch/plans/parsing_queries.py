"""Scalar parsing, months, dictionaries, hashing and formatting over the order table.

Each query prints dirty text from the orders and parses it back; the SQL does the same
with its own expressions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import months, numbers, text
from ..functions.lexicon import FLEXIBLE_MONTH, MONTH_NAMES, STATE_LABELS, STATES
from ..sources.panel import table
from .registry import query
from .sqltext import js, month_label, month_text, parse_month, quoted, rnd, sql_list, with_

_M = "CAST(year(o_orderdate) * 12 + month(o_orderdate) + 300 AS INTEGER)"
_NAMES = sql_list(MONTH_NAMES)


def _orders(spark, folder):
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").withColumns(
        {
            "m": months.month_number_of(F.col("o_orderdate")) + 300,
            "whole": F.floor("o_totalprice").cast("long"),
            "cents": F.col("o_totalprice").cast("decimal(18,2)").cast("string"),
            "form": (key % 8).cast("int"),
        }
    )


_ORDERS = f"""o AS (SELECT *, {_M} AS m, CAST(floor(o_totalprice) AS BIGINT) AS whole,
  CAST(o_totalprice::DECIMAL(18,2) AS VARCHAR) AS cents, CAST(o_orderkey % 8 AS INTEGER) AS form FROM orders)"""


def _choose(values: list) -> F:
    """One text form per remainder of the order key."""
    picked = None
    for i, value in enumerate(values):
        value = F.lit(value) if isinstance(value, str) else value
        picked = F.when(F.col("form") == i, value) if picked is None else picked.when(F.col("form") == i, value)
    return picked


def _sql_choose(values: list[str]) -> str:
    return "CASE form " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _grouped(number):
    thousands = F.floor(number / 1000).cast("long")
    return F.concat(thousands.cast("string"), F.lit(","), F.lpad((number % 1000).cast("string"), 3, "0"))


_GROUPED = "(CAST(whole // 1000 AS VARCHAR) || ',' || lpad(CAST(whole % 1000 AS VARCHAR), 3, '0'))"

_PATHS = _sql_choose(
    [
        f"'raw/' || {month_label('m')} || '/State.csv'",
        f"'raw/' || replace({month_label('m')}, '-', '_') || '/State.csv'",
        f"'raw/' || replace({month_label('m')}, '-', '/') || '/State.csv'",
        f"'raw/Report_' || {_NAMES}[month(o_orderdate)] || '_' || CAST(year(o_orderdate) + 25 AS VARCHAR) || '.csv'",
        f"'raw/report' || lower({_NAMES}[month(o_orderdate)]) || CAST(year(o_orderdate) + 25 AS VARCHAR) || '.csv'",
        "'raw/undated/State.csv'",
        "'raw/2020-13/State.csv'",
        f"'raw/' || {month_label('m')} || '/April 2019.csv'",
    ]
)
_NAMED = "(?i)(" + "|".join(MONTH_NAMES) + ")[\\s_]*(\\d{4})"


def _named_sql(value: str) -> str:
    return (
        f"(CASE WHEN regexp_extract({value}, '{_NAMED}', 1) <> '' THEN regexp_extract({value}, '{_NAMED}', 2) || '-' || "
        f"lpad(CAST(list_position({sql_list(m.lower() for m in MONTH_NAMES)}, lower(regexp_extract({value}, '{_NAMED}', 1))) AS VARCHAR), 2, '0') END)"
    )


def _month_name():
    return F.element_at(F.array(*[F.lit(x) for x in MONTH_NAMES]), F.month("o_orderdate"))


def _paths():
    label = months.month_label(F.col("m"))
    year = (F.year("o_orderdate") + 25).cast("string")
    return _choose(
        [
            F.concat(F.lit("raw/"), label, F.lit("/State.csv")),
            F.concat(F.lit("raw/"), F.translate(label, "-", "_"), F.lit("/State.csv")),
            F.concat(F.lit("raw/"), F.translate(label, "-", "/"), F.lit("/State.csv")),
            F.concat(F.lit("raw/Report_"), _month_name(), F.lit("_"), year, F.lit(".csv")),
            F.concat(F.lit("raw/report"), F.lower(_month_name()), year, F.lit(".csv")),
            "raw/undated/State.csv",
            "raw/2020-13/State.csv",
            F.concat(F.lit("raw/"), label, F.lit("/April 2019.csv")),
        ]
    )


@query(
    "month_from_path",
    with_(
        f"""SELECT o_orderkey, path, coalesce(
            CASE WHEN regexp_extract(path, '(20\\d{{2}})[-_/](0[1-9]|1[0-2])', 1) <> ''
                 THEN regexp_extract(path, '(20\\d{{2}})[-_/](0[1-9]|1[0-2])', 1) || '-' || regexp_extract(path, '(20\\d{{2}})[-_/](0[1-9]|1[0-2])', 2) END,
            {_named_sql('path')}) AS report_month
        FROM (SELECT *, {_PATHS} AS path FROM o)""",
        _ORDERS,
    ),
)
def month_from_path(spark, folder):
    rows = _orders(spark, folder).withColumn("path", _paths())
    return rows.select("o_orderkey", "path", months.month_from_path(F.col("path")).alias("report_month"))


@query(
    "month_from_text",
    with_(f"SELECT o_orderkey, {_named_sql('path')} AS report_month FROM (SELECT *, {_PATHS} AS path FROM o)", _ORDERS),
)
def month_from_text(spark, folder):
    rows = _orders(spark, folder).withColumn("path", _paths())
    return rows.select("o_orderkey", months.month_from_text(F.col("path")).alias("report_month"))


_NUMBER = "^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$"


def _number_sql(value: str) -> str:
    return f"(CASE WHEN regexp_matches({value}, '{_NUMBER}') THEN TRY_CAST({value} AS DOUBLE) END)"


def _numeric_sql(value: str) -> str:
    bare = f"replace(replace(trim({value}), ',', ''), ' ', '')"
    return f"(CASE WHEN trim({value}) NOT IN ('', '-', 'NA', 'N/A', 'na', 'n/a', '--') THEN {_number_sql(bare)} END)"


_CURRENCY = _sql_choose(
    ["'₹ ' || " + _GROUPED, "'Rs. ' || " + _GROUPED, "cents", "''", "'n/a'", "' ₹' || cents || ' '", "'-'", "NULL"]
)


@query(
    "parse_currency",
    with_(
        f"""SELECT o_orderkey, raw, {_number_sql("regexp_replace(raw, '[₹Rs.,\\s]+', '', 'g')")} AS parsed,
            {_number_sql("regexp_replace(raw, '₹|Rs\\.?|[,\\s]+', '', 'g')")} AS parsed_with_decimals
            FROM (SELECT *, {_CURRENCY} AS raw FROM o)""",
        _ORDERS,
    ),
)
def parse_currency(spark, folder):
    raw = _choose(
        [
            F.concat(F.lit("₹ "), _grouped(F.col("whole"))), F.concat(F.lit("Rs. "), _grouped(F.col("whole"))),
            F.col("cents"), "", "n/a", F.concat(F.lit(" ₹"), F.col("cents"), F.lit(" ")), "-", F.lit(None).cast("string"),
        ]
    )
    rows = _orders(spark, folder).withColumn("raw", raw)
    return rows.select(
        "o_orderkey", "raw", text.parse_currency(F.col("raw")).alias("parsed"),
        text.parse_currency(F.col("raw"), keep_decimals=True).alias("parsed_with_decimals"),
    )


_NUMERIC = _sql_choose(["cents", _GROUPED, "' ' || cents || ' '", "'-'", "'--'", "'N/A'", "'12x'", "replace(cents, '.', ' .')"])


@query(
    "parse_numeric",
    with_(f"SELECT o_orderkey, raw, {_numeric_sql('raw')} AS parsed FROM (SELECT *, {_NUMERIC} AS raw FROM o)", _ORDERS),
)
def parse_numeric(spark, folder):
    raw = _choose(
        [
            F.col("cents"), _grouped(F.col("whole")), F.concat(F.lit(" "), F.col("cents"), F.lit(" ")),
            "-", "--", "N/A", "12x", F.replace(F.col("cents"), F.lit("."), F.lit(" .")),
        ]
    )
    rows = _orders(spark, folder).withColumn("raw", raw)
    return rows.select("o_orderkey", "raw", text.parse_numeric(F.col("raw")).alias("parsed"))


_PAREN = _sql_choose(
    [
        "cents || ' (' || " + _GROUPED + " || ')'", "cents", "' ' || cents || '(' || cents || ') '", "cents || ' (NA)'",
        "'(' || cents || ')'", "''", "'-'", _GROUPED,
    ]
)
_PAIR = "^([\\d,.]+)\\s*\\(([\\d,.]+)\\)$"


@query(
    "parse_paren_costs",
    with_(
        f"""SELECT o_orderkey, raw,
          CASE WHEN regexp_matches(trim(raw), '{_PAIR}') THEN {_numeric_sql(f"regexp_extract(trim(raw), '{_PAIR}', 1)")}
               ELSE {_numeric_sql('raw')} END AS original,
          CASE WHEN regexp_matches(trim(raw), '{_PAIR}') THEN {_numeric_sql(f"regexp_extract(trim(raw), '{_PAIR}', 2)")} END AS revised
        FROM (SELECT *, {_PAREN} AS raw FROM o)""",
        _ORDERS,
    ),
)
def parse_paren_costs(spark, folder):
    cents, grouped = F.col("cents"), _grouped(F.col("whole"))
    raw = _choose(
        [
            F.concat(cents, F.lit(" ("), grouped, F.lit(")")), cents,
            F.concat(F.lit(" "), cents, F.lit("("), cents, F.lit(") ")), F.concat(cents, F.lit(" (NA)")),
            F.concat(F.lit("("), cents, F.lit(")")), "", "-", grouped,
        ]
    )
    rows = _orders(spark, folder).withColumn("raw", raw)
    costs = text.parse_paren_costs(F.col("raw"))
    return rows.select(
        "o_orderkey", "raw", costs["original"].alias("original"), costs["revised"].alias("revised")
    )


_DATE = _sql_choose(
    [
        month_text("m"), f"ltrim({month_text('m')}, '0')", f"replace({month_text('m')}, '/', '-')", "'13/2024'", "'N.A.'",
        f"'01/' || {month_text('m')}", "''", month_label("m"),
    ]
)


def _date_forms():
    label = months.month_text(F.col("m"))
    return _choose(
        [
            label, F.regexp_replace(label, "^0+", ""), F.translate(label, "/", "-"), "13/2024", "N.A.",
            F.concat(F.lit("01/"), label), "", months.month_label(F.col("m")),
        ]
    )


@query(
    "parse_month_date",
    with_(f"SELECT o_orderkey, raw, {parse_month('raw')} AS month_number FROM (SELECT *, {_DATE} AS raw FROM o)", _ORDERS),
)
def parse_month_date(spark, folder):
    rows = _orders(spark, folder).withColumn("raw", _date_forms())
    return rows.select("o_orderkey", "raw", months.parse_month_date(F.col("raw")).alias("month_number"))


@query(
    "report_date_validity",
    with_(
        f"""SELECT o_orderkey, raw,
          regexp_matches(raw, '^(0[1-9]|1[0-2])/\\d{{4}}$|^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}$') AS is_report_date,
          regexp_matches(raw, '^(0?[1-9]|1[0-2])/\\d{{4}}$') AS is_month_date
        FROM (SELECT *, {_DATE} AS raw FROM o)""",
        _ORDERS,
    ),
)
def report_date_validity(spark, folder):
    rows = _orders(spark, folder).withColumn("raw", _date_forms())
    return rows.select(
        "o_orderkey", "raw", text.is_report_date(F.col("raw")).alias("is_report_date"),
        text.is_month_date(F.col("raw")).alias("is_month_date"),
    )


_FLEX = _sql_choose(
    [
        f"ltrim({month_text('m')}, '0')", f"replace({month_text('m')}, '/', '-')",
        f"'(' || substr({_NAMES}[month(o_orderdate)], 1, 3) || '-' || CAST(year(o_orderdate) + 25 AS VARCHAR) || ')'",
        f"'{{' || {month_text('m')} || '}}'", "'N.A.'",
        f"{_NAMES}[month(o_orderdate)] || ' ' || CAST(year(o_orderdate) + 25 AS VARCHAR)", "''",
        f"'upto ' || {month_text('m')} || ' or later'",
    ]
)
_FLEX_PATTERN = FLEXIBLE_MONTH
_ABBREVIATIONS = sql_list(m[:3].lower() for m in MONTH_NAMES)


@query(
    "normalise_flexible_month",
    with_(
        f"""SELECT o_orderkey, raw,
          CASE WHEN regexp_extract(c, '{_FLEX_PATTERN}', 1) <> ''
               THEN lpad(regexp_extract(c, '{_FLEX_PATTERN}', 1), 2, '0') || '/' || regexp_extract(c, '{_FLEX_PATTERN}', 2)
               WHEN regexp_extract(c, '{_FLEX_PATTERN}', 3) <> ''
               THEN lpad(CAST(list_position({_ABBREVIATIONS}, lower(regexp_extract(c, '{_FLEX_PATTERN}', 3))) AS VARCHAR), 2, '0')
                    || '/' || regexp_extract(c, '{_FLEX_PATTERN}', 4) END AS normalised
        FROM (SELECT *, replace(replace(raw, '{{', ''), '}}', '') AS c FROM (SELECT *, {_FLEX} AS raw FROM o))""",
        _ORDERS,
    ),
)
def normalise_flexible_month(spark, folder):
    label, year = months.month_text(F.col("m")), (F.year("o_orderdate") + 25).cast("string")
    raw = _choose(
        [
            F.regexp_replace(label, "^0+", ""), F.translate(label, "/", "-"),
            F.concat(F.lit("("), F.substring(_month_name(), 1, 3), F.lit("-"), year, F.lit(")")),
            F.concat(F.lit("{"), label, F.lit("}")), "N.A.", F.concat(_month_name(), F.lit(" "), year), "",
            F.concat(F.lit("upto "), label, F.lit(" or later")),
        ]
    )
    rows = _orders(spark, folder).withColumn("raw", raw)
    return rows.select("o_orderkey", "raw", months.normalise_flexible_month(F.col("raw")).alias("normalised"))


@query(
    "month_arithmetic",
    with_(
        f"""SELECT o_orderkey, label, m AS month_number, {month_label('(m + 3)')} AS plus_three, {month_label('(m - 14)')} AS minus_fourteen,
            m - (year(DATE '2020-01-01') * 12 + 1) AS months_from_date
            FROM (SELECT *, {month_label('m')} AS label FROM o)""",
        _ORDERS,
    ),
)
def month_arithmetic(spark, folder):
    rows = _orders(spark, folder).withColumn("label", months.month_label(F.col("m")))
    label = F.col("label")
    return rows.select(
        "o_orderkey", "label", months.month_number(label).alias("month_number"),
        months.month_add(label, 3).alias("plus_three"), months.month_add(label, -14).alias("minus_fourteen"),
        months.months_between(months.month_number(label), months.parse_month_date(F.lit("01/2020"))).alias("months_from_date"),
    )


@query(
    "effective_value",
    with_(
        "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS effective FROM o",
        _ORDERS,
    ),
)
def effective_value(spark, folder):
    revised = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") * 2)
    return _orders(spark, folder).select("o_orderkey", numbers.effective_value(revised, F.col("o_totalprice")).alias("effective"))


@query(
    "clean_text",
    with_(
        """SELECT o_orderkey, trim(coalesce(raw, '')) AS cleaned, trim(regexp_replace(coalesce(raw, ''), '\\s+', ' ', 'g')) AS collapsed
        FROM (SELECT *, CASE form WHEN 0 THEN NULL WHEN 1 THEN '   ' ELSE '  ' || o_orderpriority || '   x ' || o_orderstatus || ' ' END AS raw FROM o)""",
        _ORDERS,
    ),
)
def clean_text(spark, folder):
    raw = F.when(F.col("form") == 0, F.lit(None)).when(F.col("form") == 1, "   ").otherwise(
        F.concat(F.lit("  "), "o_orderpriority", F.lit("   x "), "o_orderstatus", F.lit(" "))
    )
    rows = _orders(spark, folder).withColumn("raw", raw)
    return rows.select(
        "o_orderkey", text.clean_text(F.col("raw")).alias("cleaned"),
        text.collapse_whitespace(F.coalesce("raw", F.lit(""))).alias("collapsed"),
    )


_ORDERED_STATES = sorted(STATES, key=lambda w: (-len(w), w))
_LONGEST = "CASE " + " ".join(f"WHEN contains(line, {quoted(s)}) THEN {quoted(s)}" for s in _ORDERED_STATES) + " END"
_STATE_LINE = f"""CASE form WHEN 0 THEN 'Project in nowhere 12.5' WHEN 1 THEN 'Andhra Pradesh, Arunachal Pradesh 4 5'
  ELSE CAST(o_orderkey AS VARCHAR) || ' (' || o_orderpriority || ') ' || {sql_list(STATES)}[o_custkey % {len(STATES)} + 1] || ' ' || cents || ' 87.2' END"""


def _state_lines():
    place = F.element_at(F.array(*[F.lit(s) for s in STATES]), (F.col("o_custkey") % len(STATES) + 1).cast("int"))
    return F.when(F.col("form") == 0, "Project in nowhere 12.5").when(
        F.col("form") == 1, "Andhra Pradesh, Arunachal Pradesh 4 5"
    ).otherwise(
        F.concat(F.col("o_orderkey").cast("string"), F.lit(" ("), "o_orderpriority", F.lit(") "), place, F.lit(" "), "cents", F.lit(" 87.2"))
    )


@query("longest_state_match", with_(f"SELECT o_orderkey, {_LONGEST} AS state FROM (SELECT *, {_STATE_LINE} AS line FROM o)", _ORDERS))
def longest_state_match(spark, folder):
    rows = _orders(spark, folder).withColumn("line", _state_lines())
    return rows.select("o_orderkey", text.longest_match(F.col("line")).alias("state"))


_LABELS = STATE_LABELS
_PRINTED = f"CASE form WHEN 0 THEN 'UNKNOWN PLACE' ELSE {sql_list(_LABELS)}[o_custkey % {len(_LABELS)} + 1] END"


@query(
    "canonical_state",
    with_(
        f"""SELECT o_orderkey, printed, {sql_list(_LABELS.values())}[list_position({sql_list(_LABELS)}, printed)] AS state
        FROM (SELECT *, {_PRINTED} AS printed FROM o)""",
        _ORDERS,
    ),
)
def canonical_state(spark, folder):
    labels = F.array(*[F.lit(x) for x in _LABELS])
    printed = F.when(F.col("form") == 0, "UNKNOWN PLACE").otherwise(
        F.element_at(labels, (F.col("o_custkey") % len(_LABELS) + 1).cast("int"))
    )
    rows = _orders(spark, folder).withColumn("printed", printed)
    return rows.select("o_orderkey", "printed", text.canonical_state(F.col("printed")).alias("state"))


@query(
    "extract_month_dates",
    with_(
        f"""SELECT o_orderkey, len(d) AS dates, coalesce(array_to_string(d, ';'), '') AS found
        FROM (SELECT *, regexp_extract_all('Work ' || {month_text('m')} || ' to ' || {month_text('(m + 36)')} || ' ' || cents || CASE WHEN form = 0 THEN ' 1/2024' ELSE ' 13/2024' END, '(\\d{{2}}/\\d{{4}})', 1) AS d FROM o)""",
        _ORDERS,
    ),
)
def extract_month_dates(spark, folder):
    m = F.col("m")
    line = F.concat(
        F.lit("Work "), months.month_text(m), F.lit(" to "), months.month_text(m + 36), F.lit(" "), "cents",
        F.when(F.col("form") == 0, " 1/2024").otherwise(" 13/2024"),
    )
    found = text.extract_month_dates(line)
    return _orders(spark, folder).select(
        "o_orderkey", F.size(found).cast("long").alias("dates"), F.array_join(found, ";").alias("found")
    )


@query(
    "trailing_numbers",
    with_(
        """SELECT o_orderkey, CAST(CASE WHEN form = 0 THEN 1 WHEN form = 1 THEN 2 ELSE 2 END AS INTEGER) AS numbers,
          CASE WHEN form = 0 THEN NULL WHEN form = 1 THEN 4.0 ELSE CAST(cents AS DOUBLE) END AS next_to_last,
          CASE WHEN form = 0 THEN 12.5 WHEN form = 1 THEN 5.0 ELSE 87.2 END AS last
        FROM o""",
        _ORDERS,
    ),
)
def trailing_numbers(spark, folder):
    rows = _orders(spark, folder).withColumn("line", _state_lines())
    found = text.trailing_numbers(F.col("line"))
    return rows.select(
        "o_orderkey", F.size(found).alias("numbers"),
        F.when(F.size(found) >= 2, F.element_at(found, -2)).alias("next_to_last"),
        F.when(F.size(found) >= 1, F.element_at(found, -1)).alias("last"),
    )


_HOSTS = ("thther.example.org", "m.ththth.example.net", "therin.example.net", "ththin.example.com")


@query(
    "official_source",
    f"""SELECT page_id, url, starts_with(lower(url), 'https://')
          AND lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) IN ({', '.join(quoted(h) for h in _HOSTS)}) AS is_official
        FROM pages""",
)
def official_source(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", "url", text.is_official_source(F.col("url"), _HOSTS).alias("is_official")
    )


@query(
    "hash_bucket",
    """SELECT c_custkey, CAST(CASE WHEN s5 % 2 = parity THEN s5 ELSE s5 + 5 END AS INTEGER) AS bucket FROM (
         SELECT c_custkey, list_sum(list_transform(string_split(sha256(c_name), ''), lambda c: strpos('0123456789abcdef', c) - 1)) % 5 AS s5,
                (strpos('0123456789abcdef', right(sha256(c_name), 1)) - 1) % 2 AS parity FROM customer)""",
)
def hash_bucket(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", text.hash_bucket(F.col("c_name")).alias("bucket"))


@query(
    "search_text",
    """SELECT c_custkey, contains(lower(c_name || ' ' || c_mktsegment), 'build') AS found FROM customer""",
)
def search_text(spark, folder):
    words = text.search_text(F.col("c_name"), F.col("c_mktsegment"))
    return table(spark, folder, "customer").select("c_custkey", F.contains(words, F.lit("build")).alias("found"))


@query(
    "format_crore",
    with_(
        """SELECT o_orderkey, CASE WHEN v / 100000 >= 1 THEN '₹' || printf('%.2f', v / 100000) || 'L Cr'
            ELSE '₹' || printf('%.2f', v / 1000) || 'k Cr' END AS label
        FROM (SELECT o_orderkey, CAST(whole // 1000 * 1000 AS DOUBLE) AS v FROM o)""",
        _ORDERS,
    ),
)
def format_crore(spark, folder):
    value = (F.floor(F.col("whole") / 1000) * 1000).cast("double")
    return _orders(spark, folder).select("o_orderkey", numbers.format_crore(value).alias("label"))


@query(
    "half_up_rounding",
    with_(
        f"""SELECT o_orderkey, {js('(form - 4) + 0.5')} AS half_up, {rnd(f"CAST(floor(o_totalprice / 7 * 10 + 0.5) AS DOUBLE) / 10", 1)} AS one_digit FROM o""",
        _ORDERS,
    ),
)
def half_up_rounding(spark, folder):
    return _orders(spark, folder).select(
        "o_orderkey", numbers.js_round((F.col("form") - 4) + F.lit(0.5)).alias("half_up"),
        numbers.js_round_to(F.col("o_totalprice") / 7, 1).alias("one_digit"),
    )
