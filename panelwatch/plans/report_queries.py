"""Report files, routing, sinks, profiles and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lexicon import SEMANTIC_FAMILIES
from ..operators import identity as ident, profile
from ..sources import reports
from ..sources.panel import customer_month, supplier_month, table, typed_panel
from .registry import query
from .sqltext import CUSTOMER, SUPPLIER, with_

_TABLES = (
    "benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels",
    "lineitem", "nation", "orders", "pages", "part", "region", "supplier",
)


@query(
    "discover_files",
    "SELECT t || '.parquet' AS file_name, t AS dataset_type, NULL::VARCHAR AS report_month FROM (VALUES "
    + ", ".join(f"('{t}')" for t in _TABLES) + ") v(t)",
)
def discover_files(spark, folder):
    found = reports.discover_files(spark, folder, "*.parquet")
    # The folder's own name may look like a month; only the file name is dated here.
    return found.select(
        "file_name", "dataset_type", reports.month_from_path(F.col("file_name")).alias("report_month")
    )


@query("file_manifest")
def file_manifest(spark, folder):
    return reports.file_manifest(spark, folder, "*.parquet")


@query("file_manifest_summary")
def file_manifest_summary(spark, folder):
    return reports.manifest_summary(reports.file_manifest(spark, folder, "*.parquet"), len(_TABLES))


def _files(spark, folder):
    return reports.report_files_from_panel(supplier_month(spark, folder))


def _text(value: str) -> str:
    return f"CAST({value} AS VARCHAR)"


_TOTALS = """count(*) AS n, sum(original_cost::DECIMAL(18,2)) AS original,
  sum(coalesce(revised_cost, original_cost)::DECIMAL(18,2)) AS revised, sum(expenditure::DECIMAL(18,2)) AS spent"""
_RANGE = """CASE WHEN physical_progress >= 100 THEN '100' ELSE CAST(CAST(floor(physical_progress / 10) * 10 AS INTEGER) AS VARCHAR)
  || '-' || CAST(CAST(floor(physical_progress / 10) * 10 AS INTEGER) + 10 AS VARCHAR) END"""


def _rupees(value: str) -> str:
    whole = f"CAST(floor(CAST({value} AS DOUBLE)) AS BIGINT)"
    return f"('₹ ' || CAST({whole} // 1000 AS VARCHAR) || ',' || lpad(CAST({whole} % 1000 AS VARCHAR), 3, '0'))"


def _keyed(dataset: str, title: str, key: str) -> str:
    return f"""SELECT report_month, '{dataset}' AS dataset_type, '{title}' AS title, {key} AS k, {_TOTALS} FROM panel
      WHERE {key} IS NOT NULL GROUP BY report_month, {key}"""


_ROWS = f"""totals AS (
  {_keyed('State-Wise-Report', 'State Wise Details', 'state')}
  UNION ALL {_keyed('Sector-Wise-Report', 'Sector Wise Details', 'sector')}
  UNION ALL {_keyed('Physical-Progress-Report', 'Physical Progress', _RANGE)}
  UNION ALL SELECT report_month, 'Cost-Wise-Report', 'Cost Wise Details', '', {_TOTALS} FROM panel GROUP BY report_month),
file_rows AS (
  SELECT 'raw/' || CASE WHEN dataset_type = 'State-Wise-Report' AND substr(report_month, 6, 2) = '12'
              THEN 'undated' || substr(report_month, 3, 2) ELSE report_month END || '/' ||
         CASE WHEN dataset_type = 'Sector-Wise-Report' AND substr(report_month, 6, 2) = '06' THEN 'Agency-Wise-Report'
              ELSE dataset_type END || '.csv' AS path,
    CASE WHEN dataset_type = 'Sector-Wise-Report' AND substr(report_month, 6, 2) = '06' THEN 'Agency-Wise-Report'
              ELSE dataset_type END AS dataset_type,
    CASE WHEN dataset_type = 'State-Wise-Report' AND substr(report_month, 6, 2) = '12' THEN NULL ELSE report_month END AS report_month,
    title, CAST(row_number() OVER (PARTITION BY report_month, dataset_type ORDER BY k) - 1 AS INTEGER) AS row_number,
    CASE WHEN k = '' THEN ['', {_rupees('original')}, {_rupees('revised')}, {_rupees('abs(spent)')}]
         ELSE [{_text('n')}, k, {_text('n')}, {_text('original')} || ' (' || {_text('revised')} || ')', {_text('spent')}] END AS fields,
    k, n, original, revised, spent
  FROM totals)"""


@query(
    "titled_csv_rows",
    with_(
        """SELECT path, dataset_type, report_month, title, row_number, len(fields) AS width, array_to_string(fields, '|') AS content
        FROM file_rows""",
        SUPPLIER, _ROWS,
    ),
)
def titled_csv_rows(spark, folder):
    return reports.read_titled_csv(_files(spark, folder), refuse_numeric_title=True).select(
        "path", "dataset_type", "report_month", "title", "row_number",
        F.size("fields").cast("long").alias("width"), F.array_join("fields", "|").alias("content"),
    )


@query(
    "cost_overview_monthly",
    with_(
        """SELECT report_month, floor(original::DOUBLE) AS original_cost_crores, floor(revised::DOUBLE) AS revised_cost_crores,
           floor(abs(spent)::DOUBLE) AS expenditure_crores, 'Cost-Wise-Report.csv' AS source_file, 'aggregate_csv' AS source_type
        FROM file_rows WHERE dataset_type = 'Cost-Wise-Report'""",
        SUPPLIER, _ROWS,
    ),
)
def cost_overview_monthly(spark, folder):
    return reports.process_reports(_files(spark, folder))["cost_overview_monthly"]


def _typed_sql(dataset: str, key: str) -> str:
    return with_(
        f"""SELECT report_month, k AS {key}, n::DOUBLE AS project_count, original::DOUBLE AS original_cost_crores,
           revised::DOUBLE AS revised_cost_crores, spent::DOUBLE AS expenditure_crores,
           '{dataset}.csv' AS source_file, 'aggregate_csv' AS source_type
        FROM file_rows WHERE dataset_type = '{dataset}' AND report_month IS NOT NULL""",
        SUPPLIER, _ROWS,
    )


@query("progress_range_monthly", _typed_sql("Physical-Progress-Report", "progress_range"))
def progress_range_monthly(spark, folder):
    return reports.process_reports(_files(spark, folder))["physical_progress_monthly"]


@query("sector_monthly", _typed_sql("Sector-Wise-Report", "sector"))
def sector_monthly(spark, folder):
    return reports.process_reports(_files(spark, folder))["sector_monthly"]


@query("state_monthly", _typed_sql("State-Wise-Report", "state"))
def state_monthly(spark, folder):
    return reports.process_reports(_files(spark, folder))["state_monthly"]


_ROUTES = """CASE WHEN dataset_type = 'Agency-Wise-Report' THEN 'SKIPPED_UNKNOWN_TYPE'
  WHEN report_month IS NULL THEN 'SKIPPED_NO_MONTH' ELSE 'PROCESSED' END"""


@query(
    "report_routing",
    with_(
        f"""SELECT DISTINCT path, dataset_type, report_month,
          CASE dataset_type WHEN 'Cost-Wise-Report' THEN 'cost_overview_monthly' WHEN 'Physical-Progress-Report' THEN 'physical_progress_monthly'
               WHEN 'Sector-Wise-Report' THEN 'sector_monthly' WHEN 'State-Wise-Report' THEN 'state_monthly' END AS output_table,
          {_ROUTES} AS routing FROM file_rows""",
        SUPPLIER, _ROWS,
    ),
)
def report_routing(spark, folder):
    return reports.routing(_files(spark, folder))


@query(
    "report_routing_counts",
    with_(f"SELECT routing, count(*) AS files FROM (SELECT DISTINCT path, {_ROUTES} AS routing FROM file_rows) GROUP BY 1", SUPPLIER, _ROWS),
)
def report_routing_counts(spark, folder):
    return reports.routing_counts(_files(spark, folder))


@query(
    "monthly_union",
    with_(
        """SELECT dataset_type, report_month, count(*) AS rows, CAST(sum(n) AS DOUBLE) AS projects FROM file_rows
        WHERE dataset_type IN ('State-Wise-Report', 'Sector-Wise-Report', 'Physical-Progress-Report') AND report_month IS NOT NULL
        GROUP BY 1, 2""",
        SUPPLIER, _ROWS,
    ),
)
def monthly_union(spark, folder):
    tables = reports.process_reports(_files(spark, folder))
    parts = None
    for name, key in (("state_monthly", "state"), ("sector_monthly", "sector"), ("physical_progress_monthly", "progress_range")):
        part = tables[name].select(
            F.regexp_replace("source_file", r"\.csv$", "").alias("dataset_type"), "report_month",
            F.col(key).alias("k"), "project_count",
        )
        parts = part if parts is None else parts.unionByName(part)
    return (
        parts.groupBy("dataset_type", "report_month")
        .agg(F.count("*").alias("rows"), F.sum("project_count").alias("projects"))
        .orderBy("report_month")
    )


@query(
    "typed_panel_load",
    with_(
        """SELECT sl_no::VARCHAR AS sl_no, report_month, month_number, original_end, revised_end, effective_end, effective_cost,
           original_cost, revised_cost, expenditure, physical_progress, traceable FROM typed""",
        CUSTOMER,
    ),
)
def typed_panel_load(spark, folder):
    rows = ident.with_identity(customer_month(spark, folder))
    as_text = rows.select([F.col(c).cast("string").alias(c) for c in rows.columns])
    return typed_panel(as_text).select(
        "sl_no", "report_month", "month_number", "original_end", "revised_end", "effective_end", "effective_cost",
        "original_cost", "revised_cost", "expenditure", "physical_progress", "traceable",
    )


@query(
    "period_routing",
    with_(
        """SELECT CASE WHEN substr(report_month, 6, 2) IN ('03', '06', '09', '12') AND report_month < '2025-07' THEN 'quarterly' ELSE 'monthly' END AS period,
           count(*) AS rows, min(report_month) AS first_month, max(report_month) AS last_month FROM panel GROUP BY 1""",
        CUSTOMER,
    ),
)
def period_routing(spark, folder):
    rows = customer_month(spark, folder)
    quarter = F.substring("report_month", 6, 2).isin("03", "06", "09", "12")
    named = rows.withColumn(
        "source_file", F.when(quarter, F.concat(F.lit("QPISR_"), "source_file")).otherwise(F.col("source_file"))
    )
    tagged = reports.with_period(named, ident.report_layout(F.col("report_month"), F.col("source_file")))
    return tagged.groupBy("period").agg(
        F.count("*").alias("rows"), F.min("report_month").alias("first_month"), F.max("report_month").alias("last_month")
    )


@query(
    "fixed_precision_output",
    with_(
        """SELECT sl_no, report_month, printf('%.6f', expenditure) AS expenditure, printf('%.6f', original_cost) AS original_cost,
           CASE WHEN revised_cost IS NOT NULL THEN printf('%.6f', revised_cost) END AS revised_cost FROM panel""",
        CUSTOMER,
    ),
)
def fixed_precision_output(spark, folder):
    rows = customer_month(spark, folder).select("sl_no", "report_month", "expenditure", "original_cost", "revised_cost")
    return reports.fixed_precision(rows)


# --- profiles --------------------------------------------------------------------------

_CELLS = """file_cells AS (
  SELECT path, dataset_type, report_month, title, row_number, unnest(range(len(fields))) AS column_index, unnest(fields) AS value
  FROM file_rows)"""
_CLASS = """CASE WHEN contains(trim(value), '₹') THEN 'currency'
  WHEN regexp_matches(trim(value), '^[\\d,]+\\.?\\d*\\s*\\([\\d,]+\\.?\\d*\\)$') THEN 'paren'
  WHEN regexp_matches(trim(value), '^\\d+-\\d+$') THEN 'range'
  WHEN regexp_matches(replace(replace(trim(value), ',', ''), ' ', ''), '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') THEN 'number'
  ELSE 'other' END"""
_DTYPE = """CASE WHEN n = 0 THEN 'unknown' WHEN cur > n * 0.5 THEN 'currency' WHEN par > n * 0.5 THEN 'numeric_parenthetical'
  WHEN ran > n * 0.3 THEN 'progress_range' WHEN num + par > n * 0.7 THEN 'numeric' WHEN num = 0 AND par = 0 THEN 'text' ELSE 'mixed' END"""
_KEYS = "path, dataset_type, report_month, title"
_PROFILE = f"""marked AS (SELECT *, {_CLASS} AS class, trim(value) <> '' AS filled FROM file_cells),
firsts AS (SELECT {_KEYS}, column_index, value, min(row_number) AS first_row FROM marked WHERE filled GROUP BY ALL),
samples AS (SELECT {_KEYS}, column_index, string_agg(value, ' | ' ORDER BY first_row, value) AS samples FROM (
   SELECT *, row_number() OVER (PARTITION BY path, column_index ORDER BY first_row, value) AS r FROM firsts) WHERE r <= 5 GROUP BY ALL),
stats AS (SELECT {_KEYS}, column_index, count(*) FILTER (WHERE filled) AS n, count(*) AS all_rows,
   count(DISTINCT CASE WHEN filled THEN value END) AS unique_count,
   count(*) FILTER (WHERE filled AND class = 'currency') AS cur, count(*) FILTER (WHERE filled AND class = 'paren') AS par,
   count(*) FILTER (WHERE filled AND class = 'range') AS ran, count(*) FILTER (WHERE filled AND class = 'number') AS num
   FROM marked GROUP BY ALL),
profiles AS (SELECT s.path, s.dataset_type, s.report_month, s.title, CAST(s.column_index AS INTEGER) AS column_index,
   n AS non_null_count, all_rows - n AS null_count, unique_count, {_DTYPE} AS inferred_dtype, coalesce(samples, '') AS samples
   FROM stats s LEFT JOIN samples p ON s.path = p.path AND s.column_index = p.column_index)"""
_BASE = (SUPPLIER, _ROWS, _CELLS, _PROFILE)


def _title_rows(spark, folder):
    return reports.read_titled_csv(_files(spark, folder), refuse_numeric_title=True)


@query("column_profile", with_("SELECT * FROM profiles", *_BASE))
def column_profile(spark, folder):
    return profile.file_columns(_title_rows(spark, folder))


@query(
    "dtype_inference",
    with_("SELECT dataset_type, column_index, inferred_dtype, count(*) AS files FROM profiles GROUP BY 1, 2, 3", *_BASE),
)
def dtype_inference(spark, folder):
    return profile.file_columns(_title_rows(spark, folder)).groupBy("dataset_type", "column_index", "inferred_dtype").agg(
        F.count("*").alias("files")
    )


_FIRST_50 = f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY path, column_index ORDER BY row_number) AS r FROM marked WHERE filled),
joined_samples AS (SELECT path, column_index, string_agg(value, ' ' ORDER BY r) AS sample FROM numbered WHERE r <= 50 GROUP BY 1, 2),
value_tagged AS (SELECT path, CAST(column_index AS INTEGER) AS column_index, list_filter([{', '.join(
    f"CASE WHEN regexp_matches(sample, '(?i){pattern}') THEN '{tag}' END" for tag, pattern in SEMANTIC_FAMILIES.items())}],
    lambda t: t IS NOT NULL) AS tags FROM joined_samples)"""


@query(
    "value_tags",
    with_(
        "SELECT path, column_index, array_to_string(tags, ';') AS tags FROM value_tagged",
        *_BASE, _FIRST_50,
    ),
)
def value_tags(spark, folder):
    return profile.value_tags(profile.cells(_title_rows(spark, folder)), profile.COLUMN_KEYS).select(
        "path", "column_index", F.array_join("value_tags", ";").alias("tags")
    )


_POSITION = """list_filter([
  CASE WHEN (contains(lower(dataset_type), 'state') OR contains(lower(title), 'state')) AND column_index = 1 AND inferred_dtype = 'text' THEN 'state' END,
  CASE WHEN (contains(lower(dataset_type), 'sector') OR contains(lower(title), 'sector')) AND column_index = 1 AND inferred_dtype = 'text' THEN 'sector' END,
  CASE WHEN (contains(lower(dataset_type), 'cost') OR contains(lower(title), 'cost')) AND inferred_dtype IN ('currency', 'numeric', 'numeric_parenthetical') THEN 'cost' END,
  CASE WHEN (contains(lower(dataset_type), 'physical') OR contains(lower(dataset_type), 'progress') OR contains(lower(title), 'progress')) AND inferred_dtype = 'progress_range' THEN 'physical_progress' END,
  CASE WHEN column_index = 2 AND inferred_dtype = 'numeric' THEN 'project_count' END,
  CASE WHEN column_index = 3 AND inferred_dtype = 'numeric_parenthetical' THEN 'cost' END,
  CASE WHEN column_index = 3 AND inferred_dtype = 'numeric_parenthetical' THEN 'original_and_revised_cost' END,
  CASE WHEN column_index = 4 AND inferred_dtype = 'numeric' THEN 'expenditure' END], lambda t: t IS NOT NULL)"""
_TAGGED = f"""tagged AS (SELECT p.*, list_sort(list_distinct(list_concat(coalesce(v.tags, []), {_POSITION}))) AS semantic_tags
  FROM profiles p LEFT JOIN value_tagged v USING (path, column_index))"""


@query(
    "semantic_tags",
    with_(
        "SELECT path, column_index, inferred_dtype, array_to_string(semantic_tags, ';') AS tags FROM tagged",
        *_BASE, _FIRST_50, _TAGGED,
    ),
)
def semantic_tags(spark, folder):
    return profile.tagged_columns(_title_rows(spark, folder)).select(
        "path", "column_index", "inferred_dtype", F.array_join("semantic_tags", ";").alias("tags")
    )


_PLACES = """places_of_tags AS (SELECT tag, dataset_type, column_index, count(*) AS occurrences, min(report_month) AS first_month,
   row_number() OVER (PARTITION BY tag ORDER BY dataset_type, column_index) AS r
   FROM (SELECT unnest(semantic_tags) AS tag, dataset_type, column_index, report_month FROM tagged) GROUP BY 1, 2, 3)"""


@query(
    "tag_locations",
    with_(
        """SELECT tag, CAST(sum(occurrences) AS BIGINT) AS occurrences,
            string_agg(dataset_type || '[' || coalesce(first_month, 'None') || '].col_' || column_index, '; ' ORDER BY r) FILTER (WHERE r <= 10) AS examples,
            CAST(sum(occurrences) - count(*) FILTER (WHERE r <= 10) AS BIGINT) AS more_occurrences
        FROM places_of_tags GROUP BY 1""",
        *_BASE, _FIRST_50, _TAGGED, _PLACES,
    ),
)
def tag_locations(spark, folder):
    return profile.tag_locations(profile.tagged_columns(_title_rows(spark, folder)))


_LISTED = """all_rows AS (SELECT path, dataset_type, report_month, title, row_number, fields FROM file_rows
  UNION ALL SELECT 'raw/' || report_month || '/Project-List.csv', 'Project-List', report_month, 'Listing', CAST(sl_no AS INTEGER),
    [CAST(sl_no AS VARCHAR), 'UID ' || coalesce(project_code, legacy_ocms_code, ''), project_name, state] FROM panel)"""


@query(
    "id_column_candidates",
    with_(
        "SELECT path, dataset_type, report_month, column_index FROM tagged WHERE list_contains(semantic_tags, 'project_id')",
        SUPPLIER, _ROWS, _LISTED, _CELLS.replace("FROM file_rows", "FROM all_rows"), _PROFILE, _FIRST_50, _TAGGED,
    ),
)
def id_column_candidates(spark, folder):
    """Identifier columns among the report files and monthly lists of entities."""
    code = F.concat(F.lit("UID "), F.coalesce("project_code", "legacy_ocms_code", F.lit("")))
    listed = supplier_month(spark, folder).select(
        F.concat(F.lit("raw/"), "report_month", F.lit("/Project-List.csv")).alias("path"), F.lit("Project-List.csv").alias("file_name"),
        F.lit("Project-List").alias("dataset_type"), "report_month", F.lit("Listing").alias("title"),
        F.col("sl_no").cast("int").alias("row_number"), F.array(F.col("sl_no").cast("string"), code, "project_name", "state").alias("fields"),
    )
    return profile.id_candidates(profile.tagged_columns(_title_rows(spark, folder).unionByName(listed)))


@query(
    "file_shape",
    with_(
        f"""SELECT {_KEYS}, count(*) AS row_count, CAST(max(len(fields)) AS INTEGER) AS column_count,
           count(*) - count(DISTINCT array_to_string(fields, '|')) AS duplicate_rows FROM file_rows GROUP BY ALL""",
        SUPPLIER, _ROWS,
    ),
)
def file_shape(spark, folder):
    return profile.file_shape(_title_rows(spark, folder))


@query(
    "duplicate_rows",
    """SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders)) AS BIGINT)
       AS duplicate_rows FROM orders""",
)
def duplicate_rows(spark, folder):
    rows = table(spark, folder, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    return profile.duplicate_rows(rows, ignore=("o_totalprice",))


@query(
    "granularity",
    with_(
        f""", ranges AS (SELECT path, max(CAST(inferred_dtype = 'progress_range' AS INTEGER)) AS has_ranges FROM profiles GROUP BY 1),
        shape AS (SELECT {_KEYS}, count(*) AS row_count, CAST(max(len(fields)) AS INTEGER) AS column_count FROM file_rows GROUP BY ALL)
        SELECT s.path, dataset_type, report_month, title, row_count, column_count,
          CASE WHEN contains(lower(dataset_type), 'state') OR contains(lower(title), 'state') THEN 'State-wise aggregation (rows represent states, not individual projects)'
               WHEN contains(lower(dataset_type), 'sector') OR contains(lower(title), 'sector') THEN 'Sector-wise aggregation (rows represent sectors, not individual projects)'
               WHEN contains(lower(dataset_type), 'cost') AND row_count <= 3 THEN 'Cost-wise summary with very few rows — likely national-level aggregate'
               WHEN (contains(lower(dataset_type), 'physical') OR contains(lower(title), 'progress')) AND has_ranges = 1
                    THEN 'Physical-progress report with progress-range buckets (aggregate histogram)'
               WHEN row_count < 50 AND column_count >= 3 THEN 'Low row count (' || row_count || ') with structured columns suggests aggregation'
               WHEN row_count > 500 THEN 'High row count (' || row_count || ') suggests project-level data'
               ELSE 'Could not confidently determine granularity' END AS reason,
          CASE WHEN row_count < 50 AND column_count >= 3 THEN true WHEN row_count > 500 THEN false END AS is_aggregate
        FROM shape s LEFT JOIN ranges r USING (path)""",
        *_BASE,
    ),
)
def granularity(spark, folder):
    return profile.granularity(_title_rows(spark, folder))


@query(
    "schema_comparison",
    with_(
        """, shape AS (SELECT path, dataset_type, report_month, count(*) AS row_count, max(len(fields)) AS width FROM file_rows GROUP BY ALL),
        per AS (SELECT dataset_type, count(DISTINCT coalesce(report_month, 'unknown')) AS months, count(DISTINCT width) AS widths,
                min(row_count) AS min_rows, max(row_count) AS max_rows FROM shape GROUP BY 1),
        vary AS (SELECT dataset_type, count(*) FILTER (WHERE d > 1) AS columns_with_varying_dtype FROM (
                SELECT dataset_type, column_index, count(DISTINCT inferred_dtype) AS d FROM profiles GROUP BY 1, 2) GROUP BY 1)
        SELECT dataset_type, months, widths > 1 AS column_count_varies, columns_with_varying_dtype,
               widths <= 1 AND columns_with_varying_dtype = 0 AS consistent_columns, min_rows, max_rows,
               (max_rows - min_rows)::DOUBLE / max_rows > 0.3 AS row_count_swings
        FROM per JOIN vary USING (dataset_type)""",
        *_BASE,
    ),
)
def schema_comparison(spark, folder):
    return profile.schema_comparison(_title_rows(spark, folder))


_NUMERIC_COLUMNS = ("original_cost", "revised_cost", "expenditure", "physical_progress")


@query(
    "numeric_summary",
    with_(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS column_name, round(min({c}), 2) AS min_value, round(max({c}), 2) AS max_value,
              round(CAST(sum({c}::DECIMAL(18,2)) AS DOUBLE) / count({c}), 4) AS mean_value, count(*) - count({c}) AS nulls,
              round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 6) AS null_pct FROM panel"""
            for c in _NUMERIC_COLUMNS
        ),
        SUPPLIER,
    ),
)
def numeric_summary(spark, folder):
    return profile.numeric_summary(supplier_month(spark, folder), list(_NUMERIC_COLUMNS))


@query(
    "dataset_summary",
    with_(
        """, t AS (SELECT report_month, state, sector, agency FROM panel)
        SELECT report_month, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, 4 AS column_count
        FROM (SELECT *, count(*) AS n FROM t GROUP BY ALL) GROUP BY 1""",
        CUSTOMER,
    ),
)
def dataset_summary(spark, folder):
    rows = customer_month(spark, folder).select("report_month", "state", "sector", "agency")
    return profile.dataset_summary(rows, "report_month")


@query(
    "unpivoted_profile",
    """SELECT column_name, count(*) AS non_null_count, count(DISTINCT value) AS unique_count, CASE column_name WHEN 'c_acctbal' THEN 'numeric'
        WHEN 'c_nationkey' THEN 'numeric' ELSE 'text' END AS inferred_dtype FROM (
         SELECT unnest(['c_name', 'c_mktsegment', 'c_nationkey', 'c_acctbal']) AS column_name,
                unnest([c_name, c_mktsegment, c_nationkey::VARCHAR, (c_acctbal::DECIMAL(18,2))::VARCHAR]) AS value FROM customer)
       GROUP BY 1""",
)
def unpivoted_profile(spark, folder):
    rows = table(spark, folder, "customer").select(
        "c_custkey", "c_name", "c_mktsegment", "c_nationkey", F.col("c_acctbal").cast("decimal(18,2)").alias("c_acctbal")
    )
    long = profile.unpivoted(rows, "c_custkey").where(F.col("column_name") != "c_custkey")
    return profile.column_profile(long, ["column_name"]).drop("samples")


_WIDE = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
_WIDE_SQL = [c if c != "o_totalprice" else "o_totalprice::DECIMAL(18,2)" for c in _WIDE]


@query(
    "table_profile",
    f"""WITH wide AS (SELECT o_orderkey AS row_number, unnest([{', '.join(f"'{c}'" for c in _WIDE)}]) AS column_name,
          unnest([{', '.join(f'CAST({c} AS VARCHAR)' for c in _WIDE_SQL)}]) AS value FROM orders),
        filled AS (SELECT *, {_CLASS} AS class FROM wide WHERE trim(value) <> ''),
        firsts AS (SELECT column_name, value, min(row_number) AS first_row FROM filled GROUP BY 1, 2),
        shown AS (SELECT column_name, string_agg(value, ' | ' ORDER BY first_row, value) AS samples FROM (
          SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY first_row, value) AS r FROM firsts) WHERE r <= 5 GROUP BY 1),
        counted AS (SELECT column_name, count(*) AS n, count(DISTINCT value) AS unique_count,
          count(*) FILTER (WHERE class = 'currency') AS cur, count(*) FILTER (WHERE class = 'paren') AS par,
          count(*) FILTER (WHERE class = 'range') AS ran, count(*) FILTER (WHERE class = 'number') AS num FROM filled GROUP BY 1)
        SELECT column_name, n AS non_null_count, unique_count, {_DTYPE} AS inferred_dtype, samples FROM counted JOIN shown USING (column_name)""",
)
def table_profile(spark, folder):
    """Profile of a wide table; its dense key columns are counted in bitmaps."""
    rows = table(spark, folder, "orders").select(
        *[F.col(c).cast("decimal(18,2)").alias(c) if c == "o_totalprice" else F.col(c) for c in _WIDE]
    )
    return profile.table_profile(profile.unpivoted(rows, "o_orderkey"), ["column_name"])
