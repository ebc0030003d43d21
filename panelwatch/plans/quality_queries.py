"""Identity, master data, anomalies, review queue and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import identity as ident, integrity, master, reconcile, review
from ..operators.features import unique_keys
from ..sources.panel import customer_month, supplier_month
from .inputs import customer_panel, supplier_panel
from .registry import query
from .sqltext import CUSTOMER, SUPPLIER, with_


def _enriched(spark, folder):
    return ident.with_identity(customer_month(spark, folder))


@query(
    "identity_key",
    with_("SELECT sl_no, report_month, identity_key, identifier_classification FROM enriched", CUSTOMER),
)
def identity_key(spark, folder):
    return _enriched(spark, folder).select("sl_no", "report_month", "identity_key", "identifier_classification")


@query(
    "quality_flags",
    with_(
        """, twice AS (
             SELECT * FROM enriched UNION ALL SELECT * FROM enriched WHERE sl_no % 97 = 1),
           flagged AS (
             SELECT *, count(*) OVER (PARTITION BY report_month, project_code) > 1 AND project_code IS NOT NULL AS repeated
             FROM twice)
           SELECT sl_no, report_month, identity_key,
             CASE WHEN f = '' THEN 'NONE' ELSE f END AS quality_flags
           FROM (SELECT *, concat_ws(';',
               CASE WHEN identifier_classification <> 'PRIMARY_ID_PRESENT' THEN identifier_classification END,
               CASE WHEN extraction_status <> 'SUCCESS' THEN 'PARTIAL_EXTRACTION' END,
               CASE WHEN repeated THEN 'DUPLICATE_PRIMARY_ID_IN_MONTH' END,
               CASE WHEN physical_progress < 0 OR physical_progress > 100 THEN 'PROGRESS_OUT_OF_RANGE' END) AS f
             FROM flagged)""",
        CUSTOMER,
    ),
)
def quality_flags(spark, folder):
    rows = customer_month(spark, folder)
    twice = rows.unionByName(rows.where(F.col("sl_no") % 97 == 1))
    return ident.enrich_panel(twice).select("sl_no", "report_month", "identity_key", "quality_flags")


@query(
    "identifier_classification_counts",
    with_("SELECT identifier_classification, count(*) AS rows FROM enriched GROUP BY 1", SUPPLIER),
)
def identifier_classification_counts(spark, folder):
    return ident.classification_counts(ident.with_identity(supplier_month(spark, folder)))


_MODAL = """long AS (
  SELECT identity_key, report_month, unnest(['project_name', 'agency', 'state', 'ministry', 'sector']) AS field,
         unnest([project_name, agency, state, ministry, sector]) AS value
  FROM enriched WHERE identity_key IS NOT NULL),
counted AS (SELECT identity_key, field, value, count(*) AS n, max(report_month) AS last_month
            FROM long WHERE trim(coalesce(value, '')) <> '' GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY identity_key, field ORDER BY n DESC, last_month DESC, value DESC) AS r,
           count(*) OVER (PARTITION BY identity_key, field) AS variants,
           sum(n) OVER (PARTITION BY identity_key, field) AS observations FROM counted),
modal AS (SELECT identity_key, field, value AS chosen, variants, CAST(observations AS BIGINT) AS observations FROM ranked WHERE r = 1)"""


@query("modal_values", with_("SELECT * FROM modal", SUPPLIER, _MODAL))
def modal_values(spark, folder):
    return master.modal_values(ident.with_identity(supplier_month(spark, folder)))


def _chosen(field: str) -> str:
    return f"max(CASE WHEN field = '{field}' THEN chosen END) AS {field}"


_MASTER = f"""resolved AS (
  SELECT identity_key, {', '.join(_chosen(f) for f in master.STABLE_FIELDS)},
    concat_ws(';', {', '.join(f"max(CASE WHEN field = '{f}' AND variants > 1 THEN '{f}:' || variants END)" for f in master.STABLE_FIELDS)}) AS conflicts
  FROM modal GROUP BY 1),
master AS (
  SELECT e.identity_key, arg_min(project_code, report_month) AS project_code,
    arg_min(legacy_ocms_code, report_month) AS legacy_ocms_code,
    {', '.join(f'any_value(r.{f}) AS {f}' for f in master.STABLE_FIELDS)},
    min(report_month) AS first_month, max(report_month) AS last_month, count(DISTINCT report_month) AS months_observed,
    'most_frequent_nonblank; most_recent_when_tied' AS master_resolution_rule,
    any_value(CASE WHEN conflicts = '' THEN 'NONE' ELSE conflicts END) AS field_conflicts
  FROM enriched e JOIN resolved r USING (identity_key) GROUP BY e.identity_key)"""


@query("project_master", with_("SELECT * FROM master", SUPPLIER, _MODAL, _MASTER))
def project_master(spark, folder):
    return master.build_master(ident.with_identity(supplier_month(spark, folder)))


@query("project_master_sparse", with_("SELECT * FROM master", CUSTOMER, _MODAL, _MASTER))
def project_master_sparse(spark, folder):
    return master.build_master(_enriched(spark, folder))


@query(
    "longest_history_sample",
    with_(
        """, top AS (SELECT identity_key FROM master ORDER BY months_observed DESC, identity_key LIMIT 10)
        SELECT identity_key, report_month, expenditure, physical_progress, original_cost, revised_cost
        FROM enriched WHERE identity_key IN (SELECT identity_key FROM top)""",
        CUSTOMER, _MODAL, _MASTER,
    ),
)
def longest_history_sample(spark, folder):
    rows = _enriched(spark, folder)
    return master.longest_history(master.build_master(rows), rows)


@query(
    "tracking_share",
    with_(
        """SELECT count(*) AS entities, count(*) FILTER (WHERE months_observed >= 2) AS tracked_entities,
           round(count(*) FILTER (WHERE months_observed >= 2) * 100.0::DOUBLE / count(*), 6) AS tracking_pct FROM master""",
        CUSTOMER, _MODAL, _MASTER,
    ),
)
def tracking_share(spark, folder):
    return master.tracking_share(master.build_master(_enriched(spark, folder)))


def _decrease_sql(key: str, source: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT {key}, report_month, '{c}' AS field, previous AS previous_value, {c} AS current_value
        FROM (SELECT *, lag({c}) OVER (PARTITION BY {key} ORDER BY report_month) AS previous FROM {source} WHERE {key} IS NOT NULL)
        WHERE {c} < previous"""
        for c in integrity.DECREASING
    )


@query("decreases", with_(_decrease_sql("identity_key", "enriched"), CUSTOMER))
def decreases(spark, folder):
    return integrity.decreases(_enriched(spark, folder)).select(
        "identity_key", "report_month", "field", "previous_value", "current_value"
    )


def _gap_cte(key: str) -> str:
    return f"""calendar AS (SELECT DISTINCT report_month AS m FROM enriched),
    span AS (SELECT {key}, min(report_month) AS first_month, max(report_month) AS last_month FROM enriched
             WHERE {key} IS NOT NULL GROUP BY 1),
    gaps AS (SELECT s.{key}, first_month, last_month, string_agg(m, ';' ORDER BY m) AS missing_months
      FROM span s JOIN calendar c ON m > first_month AND m < last_month
      WHERE NOT EXISTS (SELECT 1 FROM enriched e WHERE e.{key} = s.{key} AND e.report_month = m)
      GROUP BY 1, 2, 3)"""


@query("reappearances", with_("SELECT * FROM gaps", CUSTOMER, _gap_cte("identity_key")))
def reappearances(spark, folder):
    return integrity.reappearances(_enriched(spark, folder)).select(
        "identity_key", "first_month", "last_month", "missing_months"
    )


def _money_text(value: str) -> str:
    return f"CAST(CAST({value} AS DECIMAL(18,2)) AS VARCHAR)"


_FIND = "report_month, coalesce(project_code, legacy_ocms_code, '') AS project_id"
_RANGE = f"""SELECT {_FIND}, 'NEGATIVE_EXPENDITURE' AS anomaly_type, {_money_text('expenditure')} AS value,
    '' AS previous_value, 'HIGH' AS severity, source_file, source_page FROM enriched WHERE expenditure < 0
  UNION ALL SELECT {_FIND}, 'PROGRESS_OUT_OF_RANGE', {_money_text('physical_progress')}, '', 'HIGH', source_file, source_page
    FROM enriched WHERE physical_progress < 0 OR physical_progress > 100"""
_DATES = " UNION ALL ".join(
    f"""SELECT {_FIND}, 'MALFORMED_DATE_{c.upper()}' AS anomaly_type, trim({c}) AS value, '' AS previous_value,
        'REVIEW' AS severity, source_file, source_page FROM enriched
        WHERE trim(coalesce({c}, '')) <> '' AND NOT regexp_matches(trim({c}), '^(0[1-9]|1[0-2])/\\d{{4}}$|^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}$')"""
    for c in ("date_of_approval", "start_date", "original_doc", "revised_doc")
)
_ANOMALY_COLUMNS = [
    "report_month", "project_id", "anomaly_type", "value", "previous_value", "severity", "source_file", "source_page",
]


@query("range_anomalies", with_(_RANGE, CUSTOMER))
def range_anomalies(spark, folder):
    return integrity.range_anomalies(_enriched(spark, folder)).select(*_ANOMALY_COLUMNS)


@query("malformed_dates", with_(_DATES, CUSTOMER))
def malformed_dates(spark, folder):
    return integrity.malformed_dates(_enriched(spark, folder)).select(*_ANOMALY_COLUMNS)


_KEYED = """keyed AS (SELECT *, coalesce(project_code, legacy_ocms_code) AS project_key FROM panel)"""
_ALL_ANOMALIES = f"""{_gap_cte('project_key').replace('FROM enriched', 'FROM keyed')},
drops AS ({_decrease_sql('project_key', 'keyed')})
SELECT d.report_month, d.project_key AS project_id, 'DECREASE_' || upper(field) AS anomaly_type,
   {_money_text('current_value')} AS value, {_money_text('previous_value')} AS previous_value, 'REVIEW' AS severity,
   k.source_file, k.source_page FROM drops d JOIN keyed k USING (project_key, report_month)
UNION ALL
SELECT last_month, g.project_key, 'DISAPPEAR_REAPPEAR', missing_months, '', 'REVIEW', k.source_file, k.source_page
FROM gaps g JOIN keyed k ON k.project_key = g.project_key AND k.report_month = g.last_month
UNION ALL {_RANGE} UNION ALL {_DATES}"""


@query("anomaly_union", with_(f", {_ALL_ANOMALIES}", CUSTOMER, _KEYED))
def anomaly_union(spark, folder):
    return integrity.anomalies(_enriched(spark, folder)).select(*_ANOMALY_COLUMNS)


@query(
    "integrity_stats",
    with_(
        f""", per AS (SELECT identity_key, count(DISTINCT report_month) AS n FROM enriched WHERE identity_key IS NOT NULL GROUP BY 1),
        drops AS ({_decrease_sql('identity_key', 'enriched')}), {_gap_cte('identity_key')}
        SELECT 'total_rows' AS statistic, count(*) AS value FROM enriched
        UNION ALL SELECT 'unique_primary_codes', count(DISTINCT project_code) FROM enriched
        UNION ALL SELECT 'unique_safe_tracking_keys', count(DISTINCT identity_key) FROM enriched
        UNION ALL SELECT 'no_primary_code', count(*) FROM enriched WHERE project_code IS NULL
        UNION ALL SELECT 'out_of_range', count(*) FROM enriched WHERE physical_progress < 0 OR physical_progress > 100
        UNION ALL SELECT 'negative_expenditure', count(*) FROM enriched WHERE expenditure < 0
        UNION ALL SELECT 'negative_cost', count(*) FROM enriched WHERE original_cost < 0 OR revised_cost < 0
        UNION ALL SELECT 'one_month', count(*) FROM per WHERE n = 1
        UNION ALL SELECT 'two_plus', count(*) FROM per WHERE n >= 2
        UNION ALL SELECT 'six_plus', count(*) FROM per WHERE n >= 6
        UNION ALL SELECT 'twelve_plus', count(*) FROM per WHERE n >= 12
        UNION ALL SELECT 'duplicates', count(*) FROM (SELECT *, count(*) OVER (PARTITION BY report_month, project_code) AS c
                  FROM enriched WHERE project_code IS NOT NULL) WHERE c > 1
        UNION ALL SELECT 'decreases', count(*) FROM drops
        UNION ALL SELECT 'reappearing', count(*) FROM gaps""",
        CUSTOMER,
    ),
)
def integrity_stats(spark, folder):
    return integrity.integrity_stats(_enriched(spark, folder))


@query(
    "monthly_identity_coverage",
    with_(
        """SELECT report_month, count(*) AS rows, count(DISTINCT project_code) AS unique_primary_projects,
           round(count(project_code) * 100 / count(*), 2) AS primary_id_coverage FROM enriched GROUP BY 1""",
        CUSTOMER,
    ),
)
def monthly_identity_coverage(spark, folder):
    return ident.monthly_identity_coverage(_enriched(spark, folder))


def _candidate(rows):
    """A second extraction that recovers some identifiers the first one missed."""
    code = F.when(F.col("sl_no") % 60 == 10, (F.col("sl_no") + 100000).cast("string"))
    legacy = F.when(
        F.col("sl_no") % 60 == 30, F.concat(F.lit("N"), F.lpad(F.col("sl_no").cast("string"), 8, "0"))
    )
    return rows.withColumns(
        {
            "project_code": F.coalesce("project_code", code),
            "legacy_ocms_code": F.coalesce("legacy_ocms_code", legacy),
        }
    )


_CANDIDATE = """candidate AS (
  SELECT * REPLACE (
    coalesce(project_code, CASE WHEN sl_no % 60 = 10 THEN CAST(sl_no + 100000 AS VARCHAR) END) AS project_code,
    coalesce(legacy_ocms_code, CASE WHEN sl_no % 60 = 30 THEN 'N' || lpad(CAST(sl_no AS VARCHAR), 8, '0') END) AS legacy_ocms_code)
  FROM enriched)"""


def _coverage_sql(source: str, label: str) -> str:
    unresolved = "count(*) FILTER (WHERE project_code IS NULL AND legacy_ocms_code IS NULL)"
    return f"""SELECT count(*) AS rows, count(project_code) AS primary_rows, count(legacy_ocms_code) AS alternate_rows,
      {unresolved} AS unresolved_rows,
      count(*) FILTER (WHERE identifier_classification = 'EXTRACTION_FAILURE') AS parser_failure_rows,
      count(*) FILTER (WHERE identifier_classification = 'SOURCE_MISSING_ID') AS source_missing_rows,
      round(count(project_code) * 100.0::DOUBLE / count(*), 6) AS primary_pct,
      round(count(legacy_ocms_code) * 100.0::DOUBLE / count(*), 6) AS alternate_pct,
      round({unresolved} * 100.0::DOUBLE / count(*), 6) AS unresolved_pct{label} FROM {source}"""


@query(
    "identifier_coverage",
    with_(
        _coverage_sql("enriched", ", 'before' AS extraction") + " UNION ALL " + _coverage_sql("candidate", ", 'after'"),
        CUSTOMER, _CANDIDATE,
    ),
)
def identifier_coverage(spark, folder):
    rows = _enriched(spark, folder)
    return ident.identifier_coverage(rows, _candidate(rows))


@query(
    "subset_coverage",
    with_(_coverage_sql("(SELECT * FROM enriched WHERE report_month IN ('2025-07', '2026-03'))", ""), CUSTOMER),
)
def subset_coverage(spark, folder):
    return ident.subset_coverage(_enriched(spark, folder), ["2025-07", "2026-03"])


@query(
    "coverage_by_month",
    with_(
        """SELECT report_month, count(*) AS rows, count(project_code) AS primary_rows, count(legacy_ocms_code) AS alternate_rows,
           round(count(project_code) * 100.0::DOUBLE / count(*), 6) AS primary_pct,
           round(count(legacy_ocms_code) * 100.0::DOUBLE / count(*), 6) AS alternate_pct FROM enriched GROUP BY 1""",
        SUPPLIER,
    ),
)
def coverage_by_month(spark, folder):
    return ident.coverage_by_month(ident.with_identity(supplier_month(spark, folder)))


def _layout_sql() -> str:
    from ..functions.lexicon import DEFAULT_HANDLER, HANDLER_BY_LAYOUT, LAYOUT_BY_MONTH, LAYOUT_BY_PREFIX

    months = " ".join(f"WHEN report_month = '{m}' THEN '{v}'" for m, v in LAYOUT_BY_MONTH.items())
    prefixes = " ".join(f"WHEN starts_with(source_file, '{p}') THEN '{v}'" for p, v in LAYOUT_BY_PREFIX.items())
    handlers = " ".join(f"WHEN layout = '{k}' THEN '{v}'" for k, v in HANDLER_BY_LAYOUT.items())
    return f"""laid AS (SELECT *, CASE {handlers} ELSE '{DEFAULT_HANDLER}' END AS handler,
        CASE WHEN project_code IS NOT NULL THEN 'PRIMARY' WHEN legacy_ocms_code IS NOT NULL THEN 'ALTERNATE' ELSE 'NONE' END AS identifier_type
      FROM (SELECT *, CASE {months} {prefixes} ELSE 'UNKNOWN' END AS layout FROM enriched))"""


_LAYOUT = _layout_sql()


@query(
    "coverage_by_layout",
    with_("SELECT layout, handler, identifier_type, count(*) AS rows FROM laid GROUP BY 1, 2, 3", CUSTOMER, _LAYOUT),
)
def coverage_by_layout(spark, folder):
    return ident.coverage_by(ident.with_layout(_enriched(spark, folder)), "layout", "handler", "identifier_type")


@query(
    "layout_routing",
    with_("SELECT DISTINCT report_month, source_file, layout, handler FROM laid", SUPPLIER, _LAYOUT),
)
def layout_routing(spark, folder):
    rows = ident.with_layout(ident.with_identity(supplier_month(spark, folder)))
    return rows.select("report_month", "source_file", "layout", "handler").distinct()


_TWICE = """twice AS (SELECT * FROM enriched UNION ALL SELECT * FROM enriched WHERE sl_no % 97 = 1 OR sl_no % 97 = 20)"""


@query(
    "duplicate_key_months",
    with_(
        " UNION ALL ".join(
            f"""SELECT '{k}' AS key_type, CAST(coalesce(sum(n), 0) AS BIGINT) AS duplicate_rows FROM (
              SELECT report_month, {e} AS k, count(*) AS n FROM twice WHERE {e} IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1)"""
            for k, e in (
                ("project_code", "project_code"),
                ("source_tracking_key", "coalesce(project_code, legacy_ocms_code)"),
            )
        ),
        CUSTOMER, _TWICE,
    ),
)
def duplicate_key_months(spark, folder):
    rows = _enriched(spark, folder)
    return ident.duplicate_key_rows(rows.unionByName(rows.where((F.col("sl_no") % 97).isin(1, 20))))


@query(
    "address_dedupe",
    with_(
        """SELECT report_month, source_file, sl_no, project_code AS candidate_project_code,
           legacy_ocms_code AS candidate_legacy_ocms_code FROM enriched""",
        CUSTOMER,
    ),
)
def address_dedupe(spark, folder):
    rows = _enriched(spark, folder)
    later = rows.where(F.col("sl_no") % 97 == 1).withColumns(
        {"source_page": F.col("source_page") + 1000, "project_code": F.lit(None).cast("string")}
    )
    return review.first_by_address(rows.unionByName(later))


def _case(*values: str) -> str:
    tests = (
        "c.project_code IS NOT NULL", "c.legacy_ocms_code IS NOT NULL",
        "b.identifier_classification = 'EXTRACTION_FAILURE'", "b.identifier_status = 'SOURCE_MISSING_ID'",
    )
    whens = " ".join(f"WHEN {t} THEN '{v}'" for t, v in zip(tests, values))
    return f"CASE {whens} ELSE '{values[4]}' END"


_QUEUE = f"""queue AS (
  SELECT b.report_month, b.source_file, b.source_page, b.source_section, b.sl_no, b.project_name, b.agency, b.state,
    b.project_code AS current_project_code,
    {_case('IDENTIFIER_FOUND', 'IDENTIFIER_FOUND', 'PARSER_FAILURE', 'VERIFIED_SOURCE_MISSING', 'UNRESOLVED')} AS review_status,
    {_case('VERIFIED_PARSER_FAILURE_WRAPPED_OR_BOUNDARY_IDENTIFIER', 'VERIFIED_PARSER_FAILURE_ALTERNATE_IDENTIFIER',
           'SOURCE_PRIMARY_TOKEN_NOT_RECOVERED', 'SOURCE_IDENTIFIER_ABSENT', 'AMBIGUOUS_OR_MALFORMED_SOURCE_LAYOUT')} AS failure_type,
    b.source_file || ':p' || b.source_page || '; ' || b.source_section || '; sl_no=' || b.sl_no AS raw_text_reference
  FROM enriched b LEFT JOIN candidate c USING (report_month, source_file, sl_no)
  WHERE b.project_code IS NULL AND b.legacy_ocms_code IS NULL)"""


def _queue(spark, folder):
    rows = _enriched(spark, folder)
    return review.review_queue(rows, _candidate(rows))


@query("review_queue", with_("SELECT * FROM queue", CUSTOMER, _CANDIDATE, _QUEUE))
def review_queue(spark, folder):
    return _queue(spark, folder).drop("notes", "alternate_id", "legacy_ocms_code")


@query(
    "review_queue_breakdowns",
    with_(
        " UNION ALL ".join(
            f"SELECT '{f}' AS field, {f} AS value, count(*) AS rows FROM queue GROUP BY 1, 2"
            for f in ("review_status", "report_month", "source_section", "failure_type")
        ),
        CUSTOMER, _CANDIDATE, _QUEUE,
    ),
)
def review_queue_breakdowns(spark, folder):
    return review.queue_breakdowns(_queue(spark, folder))


@query(
    "review_queue_pages",
    with_(
        """SELECT source_file, source_page, count(*) AS rows FROM queue GROUP BY 1, 2
           ORDER BY rows DESC, source_file, source_page LIMIT 80""",
        CUSTOMER, _CANDIDATE, _QUEUE,
    ),
)
def review_queue_pages(spark, folder):
    return review.queue_pages(_queue(spark, folder))


@query(
    "review_queue_concentration",
    with_(
        "SELECT report_month, count(*) AS rows FROM queue GROUP BY 1 ORDER BY rows DESC, report_month LIMIT 3",
        CUSTOMER, _CANDIDATE, _QUEUE,
    ),
)
def review_queue_concentration(spark, folder):
    return review.queue_concentration(_queue(spark, folder))


def _references(rows):
    """Monthly aggregates that differ from the panel by a month-dependent share.

    Every fifth month has no cost overview and every fourth no state counts.
    """
    share = 1 - (F.col("month_number") % 25) / 100
    monthly = rows.groupBy("report_month", "month_number").agg(
        F.sum(F.col("original_cost").cast("decimal(18,2)")).cast("double").alias("o"),
        F.sum(F.coalesce("revised_cost", "original_cost").cast("decimal(18,2)")).cast("double").alias("r"),
        F.sum(F.col("expenditure").cast("decimal(18,2)")).cast("double").alias("e"),
    )
    costs = monthly.where(F.col("month_number") % 5 != 0).select(
        "report_month", F.floor(F.col("o") * share).cast("double").alias("original_cost_crores"),
        F.floor(F.col("r") * share).cast("double").alias("revised_cost_crores"),
        F.floor(F.col("e") * share).cast("double").alias("expenditure_crores"),
    )
    states = rows.where((F.col("month_number") % 4 != 0) & (F.col("sl_no") % 50 != 0)).groupBy(
        "report_month", "state"
    ).agg(F.count("*").alias("project_count"))
    sectors = rows.where(F.col("sl_no") % 8 != 0).groupBy("report_month", "sector").agg(
        F.count("*").alias("project_count")
    )
    return costs, states, sectors


_SHARE = "(1 - (month_number % 25)::DOUBLE / 100)"
_CHECKS = f"""monthly AS (
  SELECT report_month, month_number, CAST(sum(original_cost::DECIMAL(18,2)) AS DOUBLE) AS o,
    CAST(sum(expenditure::DECIMAL(18,2)) AS DOUBLE) AS e, CAST(sum(revised_cost::DECIMAL(18,2)) AS DOUBLE) AS printed,
    CAST(sum(coalesce(revised_cost, original_cost)::DECIMAL(18,2)) AS DOUBLE) AS r, count(*) AS n,
    month_number % 5 <> 0 AS has_cost, month_number % 4 <> 0 AS has_state,
    count(*) FILTER (WHERE sl_no % 50 <> 0) AS state_n, count(*) FILTER (WHERE sl_no % 8 <> 0) AS sector_n
  FROM typed GROUP BY 1, 2),
checks AS (
  SELECT report_month, 'original_cost' AS metric, o AS panel_value,
      CASE WHEN has_cost THEN CAST(floor(o * {_SHARE}) AS DOUBLE) END AS aggregate_value, has_cost AS available,
      CASE WHEN has_cost THEN '{reconcile.COST_NOTE}' ELSE '{reconcile.NO_COST_NOTE}' END AS note FROM monthly
  UNION ALL SELECT report_month, 'expenditure', e, CASE WHEN has_cost THEN CAST(floor(e * {_SHARE}) AS DOUBLE) END, has_cost,
      CASE WHEN has_cost THEN '{reconcile.COST_NOTE}' ELSE '{reconcile.NO_COST_NOTE}' END FROM monthly
  UNION ALL SELECT report_month, 'revised_cost', CASE WHEN has_cost THEN r ELSE printed END,
      CASE WHEN has_cost THEN CAST(floor(r * {_SHARE}) AS DOUBLE) END, has_cost,
      CASE WHEN has_cost THEN '{reconcile.REVISED_NOTE}' ELSE '{reconcile.NO_COST_NOTE}' END FROM monthly
  UNION ALL SELECT report_month, 'state_project_count', n, CASE WHEN has_state THEN state_n END, has_state,
      CASE WHEN has_state THEN 'sum of state aggregate counts; may be non-additive' ELSE 'no same-month state aggregate' END FROM monthly
  UNION ALL SELECT report_month, 'sector_project_count', n, sector_n, true, 'sum of sector aggregate counts; may be non-additive' FROM monthly),
compared AS (
  SELECT *, CASE WHEN aggregate_value = 0 THEN CASE WHEN panel_value = 0 THEN 0.0 END
       ELSE abs(panel_value - aggregate_value) / abs(aggregate_value) * 100 END AS pct FROM checks),
validated AS (
  SELECT report_month, metric, panel_value, aggregate_value, round(pct, 6) AS pct_difference,
    CASE WHEN NOT available THEN 'UNAVAILABLE_TO_VALIDATE' WHEN pct IS NULL THEN 'WARNING' WHEN round(pct, 6) <= 1 THEN 'PASS'
         WHEN round(pct, 6) <= 5 THEN 'EXPECTED_DIFFERENCE' WHEN round(pct, 6) <= 20 THEN 'WARNING' ELSE 'ERROR' END AS status, note
  FROM compared)"""


def _validated(spark, folder):
    rows = supplier_panel(spark, folder)
    return reconcile.cross_validate(rows, *_references(rows))


@query("cross_validation", with_("SELECT * FROM validated", SUPPLIER, _CHECKS))
def cross_validation(spark, folder):
    return _validated(spark, folder)


@query(
    "cross_validation_status",
    with_("SELECT status, count(*) AS checks FROM validated GROUP BY 1", SUPPLIER, _CHECKS),
)
def cross_validation_status(spark, folder):
    return reconcile.status_counts(_validated(spark, folder))


@query(
    "national_totals",
    with_(
        """SELECT report_month, CAST(sum(original_cost::DECIMAL(18,2)) AS DOUBLE) AS original_cost,
          CAST(sum(expenditure::DECIMAL(18,2)) AS DOUBLE) AS expenditure,
          CAST(sum(revised_cost::DECIMAL(18,2)) AS DOUBLE) AS printed_revised_cost,
          CAST(sum(coalesce(revised_cost, original_cost)::DECIMAL(18,2)) AS DOUBLE) AS effective_revised_cost, count(*) AS rows
        FROM typed GROUP BY 1""",
        CUSTOMER,
    ),
)
def national_totals(spark, folder):
    return reconcile.monthly_totals(customer_panel(spark, folder))


@query(
    "unique_entity_months",
    with_("SELECT sl_no, report_month, physical_progress FROM typed", SUPPLIER),
)
def unique_entity_months(spark, folder):
    rows = supplier_panel(spark, folder).select("sl_no", "report_month", "physical_progress")
    return unique_keys(rows, "sl_no", "report_month")
