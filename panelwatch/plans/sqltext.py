"""Shared SQL fragments of the equivalent queries (DuckDB dialect)."""

from __future__ import annotations

from ..functions.lexicon import STATES, SECTORS


def with_(body: str, *ctes: str) -> str:
    """A query over named sub-queries; a body starting with ',' adds sub-queries of its own."""
    return f"WITH {', '.join(ctes)}{'' if body.lstrip().startswith(',') else ' '}{body}"


def rnd(expression: str, digits: int = 6) -> str:
    """Rounded value without a negative zero."""
    return f"(CASE WHEN round({expression}, {digits}) = 0 THEN 0.0 ELSE round({expression}, {digits}) END)"


def ratio(top: str, bottom: str) -> str:
    """Ratio, null for a zero or missing denominator."""
    return f"(CASE WHEN ({bottom}) <> 0 THEN ({top})::DOUBLE / ({bottom}) END)"


def ratio0(top: str, bottom: str) -> str:
    """Ratio, zero for a zero denominator."""
    return f"(CASE WHEN ({bottom}) <> 0 THEN ({top})::DOUBLE / ({bottom}) ELSE 0.0 END)"


def js(expression: str) -> str:
    """Round half toward positive infinity."""
    return f"CAST(floor(({expression}) + 0.5) AS BIGINT)"


def month_label(m: str) -> str:
    year = f"(({m} - 1) // 12)"
    return f"(CAST({year} AS VARCHAR) || '-' || lpad(CAST({m} - 12 * {year} AS VARCHAR), 2, '0'))"


def month_text(m: str) -> str:
    year = f"(({m} - 1) // 12)"
    return f"(lpad(CAST({m} - 12 * {year} AS VARCHAR), 2, '0') || '/' || CAST({year} AS VARCHAR))"


def month_number(label: str) -> str:
    return f"(CAST(substr({label}, 1, 4) AS INTEGER) * 12 + CAST(substr({label}, 6, 2) AS INTEGER))"


def parse_month(text: str) -> str:
    pattern = "^(1[0-2]|0?[1-9])/(\\d{4})$"
    return (
        f"(CASE WHEN regexp_matches({text}, '{pattern}') THEN "
        f"CAST(regexp_extract({text}, '{pattern}', 2) AS INTEGER) * 12 "
        f"+ CAST(regexp_extract({text}, '{pattern}', 1) AS INTEGER) END)"
    )


def clean(column: str) -> str:
    return f"trim(coalesce({column}, ''))"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(words) -> str:
    return "[" + ", ".join(quoted(w) for w in words) + "]"


STATE_LIST = sql_list(STATES)
SECTOR_LIST = sql_list(SECTORS)

SUPPLIER_FACTS = """facts AS (
  SELECT l_suppkey AS entity,
         CAST(year(l_shipdate) * 12 + month(l_shipdate) + 300 AS INTEGER) AS month_number,
         sum(l_extendedprice::DECIMAL(18,2)) AS amount,
         sum(CASE WHEN l_returnflag = 'R' THEN -(l_extendedprice::DECIMAL(18,2))
                  ELSE l_extendedprice::DECIMAL(18,2) END) AS signed_amount,
         CAST(floor(sum(l_quantity) / 10) AS INTEGER) AS units,
         CASE WHEN count(*) > 1
              THEN round(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) * 100 / count(*), 2) END AS progress,
         """ + SECTOR_LIST + """[max(p_size) % """ + str(len(SECTORS)) + """ + 1] AS sector,
         'Brand#' || CAST(max(CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER)) AS VARCHAR) AS agency
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
  GROUP BY 1, 2),
places AS (
  SELECT s_suppkey AS entity, s_name AS entity_name, n_name AS state, r_name AS ministry
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

CUSTOMER_FACTS = """facts AS (
  SELECT o_custkey AS entity,
         CAST(year(o_orderdate) * 12 + month(o_orderdate) + 300 AS INTEGER) AS month_number,
         sum(o_totalprice::DECIMAL(18,2)) AS amount,
         sum(CASE WHEN o_orderstatus = 'P' THEN -(o_totalprice::DECIMAL(18,2))
                  ELSE o_totalprice::DECIMAL(18,2) END) AS signed_amount,
         CAST(floor(sum(o_totalprice::DECIMAL(18,2))::DOUBLE / 10000) AS INTEGER) AS units,
         round(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) * 100 / count(*), 2) AS progress,
         'Priority-' || CAST(max(CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) AS VARCHAR) AS agency
  FROM orders GROUP BY 1, 2),
places AS (
  SELECT c_custkey AS entity, c_name AS entity_name, n_name AS state, r_name AS ministry,
         c_mktsegment AS sector
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _panel(facts: str, prefix: str) -> str:
    return f"""{facts},
windowed AS (
  SELECT *, first_value(month_number) OVER w AS first_month, first_value(amount) OVER w AS first_amount,
         max(amount) OVER w AS peak_amount, sum(signed_amount) OVER w AS spent, max(units) OVER w AS peak_units
  FROM facts
  WINDOW w AS (PARTITION BY entity ORDER BY month_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
panel AS (
  SELECT {month_label('month_number')} AS report_month,
         CAST(entity AS BIGINT) AS sl_no,
         CASE WHEN entity % 10 <> 0 THEN CAST(entity + 100000 AS VARCHAR) END AS project_code,
         CASE WHEN entity % 20 = 0 THEN 'N' || lpad(CAST(entity AS VARCHAR), 8, '0') END AS legacy_ocms_code,
         CASE WHEN entity % 10 <> 0 THEN 'PRIMARY_IDENTIFIER' WHEN entity % 20 = 0 THEN 'ALTERNATE_IDENTIFIER'
              WHEN entity % 40 = 10 THEN 'SOURCE_MISSING_ID' ELSE 'UNKNOWN' END AS identifier_status,
         entity_name || CASE WHEN entity % 100 = 70 THEN ' (' || CAST(entity + 600000 AS VARCHAR) || ')' ELSE '' END
           AS project_name,
         agency, ministry, sector, state,
         CASE WHEN entity % 13 = 5 THEN 'N.A.' ELSE {month_text('(first_month - 12)')} END AS date_of_approval,
         CASE WHEN entity % 3 <> 0 THEN {month_text('(first_month - 6)')} END AS start_date,
         {month_text('(first_month + 36)')} AS original_doc,
         CASE WHEN peak_units > 36 THEN {month_text('(first_month + peak_units)')} END AS revised_doc,
         CAST(first_amount AS DOUBLE) AS original_cost,
         CASE WHEN peak_amount > first_amount THEN CAST(peak_amount AS DOUBLE) END AS revised_cost,
         CAST(spent AS DOUBLE) AS expenditure,
         CAST(progress AS DOUBLE) AS physical_progress,
         '{prefix}' || {month_label('month_number')} || '.txt' AS source_file,
         CAST(entity // 20 + 1 AS INTEGER) AS source_page,
         'Table ' || CAST(entity % 3 + 5 AS VARCHAR) AS source_section,
         CASE WHEN entity % 10 <> 0 AND entity % 17 <> 0 THEN 'SUCCESS' ELSE 'PARTIAL' END AS extraction_status
  FROM windowed JOIN places USING (entity)),
enriched AS (
  SELECT *,
         CASE WHEN project_code IS NOT NULL THEN 'P:' || project_code
              WHEN legacy_ocms_code IS NOT NULL THEN 'L:' || legacy_ocms_code END AS identity_key,
         CASE WHEN project_code IS NOT NULL THEN 'PRIMARY_ID_PRESENT'
              WHEN legacy_ocms_code IS NOT NULL THEN 'ALTERNATE_ID_AVAILABLE'
              WHEN regexp_matches(project_name || ' ' || coalesce(agency, ''), '\\(\\d{{5,7}}\\)') THEN 'EXTRACTION_FAILURE'
              WHEN identifier_status = 'SOURCE_MISSING_ID' THEN 'SOURCE_MISSING_ID'
              ELSE 'UNRESOLVED' END AS identifier_classification
  FROM panel),
typed AS (
  SELECT *, coalesce(revised_end, original_end) AS effective_end,
         coalesce(revised_cost, original_cost) AS effective_cost,
         identity_key IS NOT NULL AS traceable
  FROM (SELECT *, {month_number('report_month')} AS month_number,
               {parse_month('original_doc')} AS original_end, {parse_month('revised_doc')} AS revised_end
        FROM enriched))"""


SUPPLIER = _panel(SUPPLIER_FACTS, "supplier_")
CUSTOMER = _panel(CUSTOMER_FACTS, "customer_")


def lag_exact(value: str, k: int) -> str:
    return (
        f"max({value}) OVER (PARTITION BY identity_key ORDER BY month_number "
        f"RANGE BETWEEN {k} PRECEDING AND {k} PRECEDING)"
    )


_SO_FAR = "PARTITION BY identity_key ORDER BY month_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"

FEATURES = f"""f1 AS (
  SELECT *,
    {lag_exact('physical_progress', 1)} AS p1, {lag_exact('physical_progress', 2)} AS p2,
    {lag_exact('physical_progress', 3)} AS p3, {lag_exact('expenditure', 1)} AS e1, {lag_exact('expenditure', 3)} AS e3,
    lag(effective_cost) OVER (PARTITION BY identity_key ORDER BY month_number) AS cost_before,
    lag(effective_end) OVER (PARTITION BY identity_key ORDER BY month_number) AS end_before,
    row_number() OVER (PARTITION BY identity_key ORDER BY month_number) AS months_observed,
    first_value(month_number) OVER ({_SO_FAR}) AS first_month
  FROM typed WHERE traceable),
f2 AS (
  SELECT *, physical_progress - p1 AS progress_change_1m, physical_progress - p3 AS progress_change_3m,
    expenditure - e1 AS expenditure_change_1m, expenditure - e3 AS expenditure_change_3m,
    coalesce(abs(effective_cost - cost_before) > 0.01, false) AS cost_changed,
    coalesce(effective_end <> end_before, false) AS end_changed,
    coalesce(abs(physical_progress - p1) >= 1, false) AS progress_moved
  FROM f1),
features AS (
  SELECT project_code, identity_key, report_month AS prediction_month, state, sector, ministry, agency,
    month_number - {parse_month('coalesce(start_date, date_of_approval)')} AS project_age_months,
    physical_progress AS progress_current, expenditure AS expenditure_current,
    original_cost AS original_cost_current, revised_cost AS revised_cost_current,
    effective_end - month_number AS effective_target_months_from_cutoff,
    progress_change_1m, progress_change_3m, progress_change_3m / 3 AS progress_velocity_3m,
    progress_change_1m - (p1 - p2) AS progress_acceleration_3m,
    expenditure_change_1m, expenditure_change_3m, expenditure_change_3m / 3 AS expenditure_velocity_3m,
    CAST(sum(cost_changed::INT) OVER ({_SO_FAR}) AS BIGINT) AS cost_revision_count_to_date,
    last_value(CASE WHEN cost_changed AND cost_before <> 0 THEN effective_cost / cost_before - 1 END IGNORE NULLS)
      OVER ({_SO_FAR}) AS last_cost_revision_pct,
    month_number - last_value(CASE WHEN cost_changed THEN month_number END IGNORE NULLS) OVER ({_SO_FAR})
      AS months_since_cost_revision,
    CAST(sum(end_changed::INT) OVER ({_SO_FAR}) AS BIGINT) AS schedule_revision_count_to_date,
    month_number - last_value(CASE WHEN end_changed THEN month_number END IGNORE NULLS) OVER ({_SO_FAR})
      AS months_since_schedule_revision,
    month_number - last_value(CASE WHEN progress_moved THEN month_number END IGNORE NULLS) OVER ({_SO_FAR})
      AS months_since_material_progress_change,
    CASE WHEN original_cost > 0 THEN expenditure / original_cost END AS expenditure_to_original_cost,
    CASE WHEN revised_cost > 0 THEN expenditure / revised_cost END AS expenditure_to_revised_cost,
    CASE WHEN original_cost > 0 THEN effective_cost / original_cost - 1 END AS cost_revision_pct_current,
    CAST(months_observed AS INTEGER) AS months_observed,
    month_number - first_month AS months_since_first_observation,
    CAST(revised_cost IS NULL AS INTEGER) AS revised_cost_missing,
    CAST(physical_progress IS NULL AS INTEGER) AS progress_missing,
    month_number, sl_no
  FROM f2)"""


def _ahead(expression: str, first: int, last: int) -> str:
    return (
        f"{expression} OVER (PARTITION BY identity_key ORDER BY month_number "
        f"RANGE BETWEEN {first} FOLLOWING AND {last} FOLLOWING)"
    )


def _schedule(h: int, test: str) -> str:
    return (
        f"CASE WHEN effective_end IS NOT NULL AND {_ahead('count(effective_end)', h, h)} > 0 THEN CAST({test} AS INTEGER) END"
    )


def _cost(h: int, factor: float) -> str:
    return (
        f"CASE WHEN effective_cost > 0 AND {_ahead('count(effective_cost)', h, h)} > 0 "
        f"THEN CAST({_ahead('max(effective_cost)', 1, h)} > effective_cost * CAST({factor} AS DOUBLE) + CAST(0.01 AS DOUBLE) AS INTEGER) END"
    )


_RATIO = "(CASE WHEN original_cost > 0 THEN effective_cost / original_cost END)"
LABEL_SQL = {
    "future_schedule_later_3m": _schedule(3, f"{_ahead('max(effective_end)', 1, 3)} > effective_end"),
    "future_schedule_later_6m": _schedule(6, f"{_ahead('max(effective_end)', 1, 6)} > effective_end"),
    "future_schedule_revision_3m": _schedule(
        3,
        f"({_ahead('max(effective_end)', 1, 3)} > effective_end OR {_ahead('min(effective_end)', 1, 3)} < effective_end)",
    ),
    "future_overdue_active_3m": (
        f"CASE WHEN effective_end IS NOT NULL AND {_ahead('count(*)', 3, 3)} > 0 "
        "THEN CAST(effective_end < month_number + 3 AS INTEGER) END"
    ),
    "future_cost_increase_3m": _cost(3, 1.0),
    "future_cost_increase_6m": _cost(6, 1.0),
    "future_cost_increase_5pct_6m": _cost(6, 1.05),
    "future_cost_overrun_onset_10pct_6m": (
        f"CASE WHEN {_RATIO} <= CAST(1.10 AS DOUBLE) AND {_ahead('count(*)', 6, 6)} > 0 THEN "
        f"CAST(coalesce({_ahead(f'max({_RATIO})', 1, 6)} > CAST(1.10 AS DOUBLE), false) AS INTEGER) END"
    ),
}
LABELS = (
    "labelled AS (SELECT *, "
    + ", ".join(f"{sql} AS {name}" for name, sql in LABEL_SQL.items())
    + " FROM typed WHERE traceable)"
)

SUPERVISED = """supervised AS (
  SELECT f.*, l.future_schedule_later_3m
  FROM features f JOIN labelled l ON f.identity_key = l.identity_key AND f.prediction_month = l.report_month
  WHERE l.future_schedule_later_3m IS NOT NULL)"""

_ENTITY = "CAST(regexp_replace(identity_key, '[^0-9]', '', 'g') AS BIGINT)"

PREDICTIONS = f"""scored AS (
  SELECT *, CAST(substr(prediction_month, 1, 4) AS INTEGER) - 2019 AS fold,
         (({_ENTITY} * 7919 + month_number::BIGINT * 104729) % 10007)::DOUBLE / 10007 AS u1,
         (({_ENTITY} * 6271 + month_number::BIGINT * 15485863) % 10009)::DOUBLE / 10009 AS u2
  FROM supervised),
predictions AS (
  SELECT *, 'BASELINE' AS model,
         round(u1 * CAST(0.65 AS DOUBLE) + future_schedule_later_3m * CAST(0.30 AS DOUBLE), 3) AS probability FROM scored
  UNION ALL
  SELECT *, 'CHALLENGER' AS model,
         round(u2 * CAST(0.55 AS DOUBLE) + future_schedule_later_3m * CAST(0.40 AS DOUBLE), 4) AS probability FROM scored)"""

PRED = (SUPPLIER, FEATURES, LABELS, SUPERVISED, PREDICTIONS)
Y = "future_schedule_later_3m"
