"""Point-in-time features and forward labels."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import feature_state, features as ops, history, labels as label_ops, splits
from ..operators.identity import enrich_panel
from ..session import written
from ..sources.panel import DATE_FIELDS, ENRICHED_COLUMNS, customer_month, traceable
from .inputs import TARGET, customer_panel, supervised, supplier_panel
from .registry import query
from .sqltext import CUSTOMER, FEATURES, LABELS, SUPERVISED, SUPPLIER, lag_exact, month_label, month_text, ratio, rnd, sql_list, with_

_DOUBLES = {
    "progress_current", "expenditure_current", "original_cost_current", "revised_cost_current",
    "progress_change_1m", "progress_change_3m", "progress_velocity_3m", "progress_acceleration_3m",
    "expenditure_change_1m", "expenditure_change_3m", "expenditure_velocity_3m", "last_cost_revision_pct",
    "expenditure_to_original_cost", "expenditure_to_revised_cost", "cost_revision_pct_current",
}


def _rounded_features(frame, *extra: str):
    columns = [F.round(c, 4).alias(c) if c in _DOUBLES else F.col(c) for c in (*ops.KEYS, *ops.USABLE)]
    return frame.select(*columns, *extra)


_FEATURE_SQL = ", ".join(
    f"{rnd(c, 4)} AS {c}" if c in _DOUBLES else c for c in (*ops.KEYS, *ops.USABLE)
)


@query("panel_features", with_(f"SELECT {_FEATURE_SQL} FROM features", SUPPLIER, FEATURES))
def panel_features(spark, folder):
    return _rounded_features(ops.build_features(supplier_panel(spark, folder)))


@query("panel_features_sparse", with_(f"SELECT {_FEATURE_SQL} FROM features", CUSTOMER, FEATURES))
def panel_features_sparse(spark, folder):
    return _rounded_features(ops.build_features(customer_panel(spark, folder)))


_LAGS = [(m, k) for m in ("physical_progress", "expenditure", "effective_cost") for k in (1, 2, 3)]


@query(
    "exact_lags",
    with_(
        "SELECT identity_key, report_month, "
        + ", ".join(f"{lag_exact(m, k)} AS {m}_lag{k}" for m, k in _LAGS)
        + " FROM typed WHERE traceable",
        CUSTOMER,
    ),
)
def exact_lags(spark, folder):
    return ops.exact_lags(customer_panel(spark, folder)).select(
        "identity_key", "report_month", *[f"{m}_lag{k}" for m, k in _LAGS]
    )


@query(
    "feature_quality",
    with_(
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature_name, round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 6) AS missing_pct, "
            f"count(DISTINCT {c}) <= 1 AS is_constant, "
            f"'{status}' AS status, '{category}' AS category FROM features"
            for c, category, _, status in ops.FEATURES if status != "UNSAFE"
        ),
        SUPPLIER, FEATURES,
    ),
)
def feature_quality(spark, folder):
    quality = ops.feature_quality(ops.build_features(supplier_panel(spark, folder)))
    inventory = ops.feature_inventory(spark).select("feature_name", "category", "status")
    return quality.join(F.broadcast(inventory), "feature_name")


@query(
    "feature_row_accounting",
    with_(
        """SELECT 'source_rows' AS statistic, count(*) AS value FROM typed
        UNION ALL SELECT 'feature_rows', count(*) FROM typed WHERE traceable
        UNION ALL SELECT 'excluded_rows', count(*) FROM typed WHERE NOT traceable
        UNION ALL SELECT 'projects', count(DISTINCT identity_key) FROM typed WHERE traceable""",
        CUSTOMER,
    ),
)
def feature_row_accounting(spark, folder):
    panel = customer_panel(spark, folder)
    features = traceable(panel).select("identity_key")
    return ops.feature_quality_summary(panel, features)


@query(
    "supervised_schedule",
    with_(f"SELECT {_FEATURE_SQL}, {TARGET} FROM supervised", SUPPLIER, FEATURES, LABELS, SUPERVISED),
)
def supervised_schedule(spark, folder):
    return _rounded_features(supervised(spark, folder), TARGET)


@query(
    "stored_label_join",
    with_(
        """SELECT f.identity_key, f.prediction_month, f.months_observed, f.cost_revision_count_to_date,
                  l.future_cost_increase_5pct_6m
           FROM features f JOIN labelled l ON f.identity_key = l.identity_key AND f.prediction_month = l.report_month
           WHERE l.future_cost_increase_5pct_6m IS NOT NULL""",
        CUSTOMER, FEATURES, LABELS,
    ),
)
def stored_label_join(spark, folder):
    panel = customer_panel(spark, folder)
    name = "future_cost_increase_5pct_6m"
    joined = ops.join_labels(ops.build_features(panel), label_ops.label_table(panel, name), name)
    return joined.select(
        "identity_key", "prediction_month", "months_observed", "cost_revision_count_to_date", name
    )


_CUTOFF = "2024-06"


def _rejected_sql(typed: str, prefix: str) -> str:
    """The rejected features over one panel, keyed like its features."""
    timeline = "PARTITION BY identity_key ORDER BY month_number"
    return f"""{prefix}_changes AS (SELECT *, coalesce(abs(effective_cost - lag(effective_cost) OVER ({timeline})) > 0.01, false) AS changed
      FROM {typed} WHERE traceable),
    {prefix}_rejected AS (SELECT identity_key, report_month AS prediction_month, lead(revised_cost) OVER ({timeline}) AS future_revised_cost,
      lead(effective_end) OVER ({timeline}) AS future_revised_completion,
      sum(changed::INT) OVER (PARTITION BY identity_key) AS full_history_revision_count,
      last_value(effective_cost) OVER ({timeline} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_observed_value
      FROM {prefix}_changes)"""


_NAMES = [name for name, *_ in ops.FEATURES]
_CUT_FEATURES = re.sub(r"\b(typed|f1|f2|features)\b", r"\1_cut", FEATURES)
_PROOF = (
    f"""typed_cut AS (SELECT * FROM typed WHERE report_month <= '{_CUTOFF}')""",
    _CUT_FEATURES, _rejected_sql("typed", "whole"), _rejected_sql("typed_cut", "cut"),
    f"""whole_rows AS (SELECT * FROM features JOIN whole_rejected USING (identity_key, prediction_month) WHERE prediction_month <= '{_CUTOFF}'),
    cut_rows AS (SELECT * FROM features_cut JOIN cut_rejected USING (identity_key, prediction_month))""",
)


@query(
    "point_in_time_proof",
    with_(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS feature_name, count(*) AS compared_rows, count(*) FILTER (WHERE a.{c} IS DISTINCT FROM b.{c}) AS changed_rows
            FROM whole_rows a FULL JOIN cut_rows b ON a.identity_key = b.identity_key AND a.prediction_month = b.prediction_month"""
            for c in _NAMES
        ),
        CUSTOMER, FEATURES, *_PROOF,
    ),
)
def point_in_time_proof(spark, folder):
    """Every feature of the catalogue: usable ones change nowhere, rejected ones do."""
    return ops.features_that_look_ahead(written(customer_panel(spark, folder), "panel"), _CUTOFF)


_ARRIVING = 6
_LAST_MONTHS = f"(SELECT DISTINCT report_month FROM typed ORDER BY 1 DESC LIMIT {_ARRIVING})"


@query(
    "arriving_month_features",
    with_(f"SELECT {_FEATURE_SQL} FROM features WHERE prediction_month IN {_LAST_MONTHS}", CUSTOMER, FEATURES),
)
def arriving_month_features(spark, folder):
    """Features of the last months, folded one by one into the state that all earlier months left."""
    panel = written(customer_panel(spark, folder).select(*feature_state.PANEL), "panel")
    latest = panel.select("report_month").distinct().orderBy(F.desc("report_month")).limit(_ARRIVING + 1).collect()
    before, *arriving = sorted(r[0] for r in latest)
    recent = written(panel.where(F.col("report_month") > before), "arriving")
    state, parts = written(feature_state.state_of(panel, before), "feature-state"), []
    for month in arriving:
        found, after = feature_state.fold(state, recent.where(F.col("report_month") == month), month)
        state = written(after, "feature-state")
        parts.append(_rounded_features(found))
    return reduce(DataFrame.unionByName, parts)


_LABEL_COLUMNS = ", ".join(label_ops.TARGET_NAMES)


@query(
    "forward_labels",
    with_(f"SELECT identity_key, report_month AS prediction_month, {_LABEL_COLUMNS} FROM labelled", SUPPLIER, LABELS),
)
def forward_labels(spark, folder):
    return label_ops.with_labels(supplier_panel(spark, folder)).select(
        "identity_key", F.col("report_month").alias("prediction_month"), *label_ops.TARGET_NAMES
    )


@query(
    "forward_labels_sparse",
    with_(f"SELECT identity_key, report_month AS prediction_month, {_LABEL_COLUMNS} FROM labelled", CUSTOMER, LABELS),
)
def forward_labels_sparse(spark, folder):
    return label_ops.with_labels(customer_panel(spark, folder)).select(
        "identity_key", F.col("report_month").alias("prediction_month"), *label_ops.TARGET_NAMES
    )


@query(
    "endpoint_presence",
    with_(
        """SELECT identity_key, report_month AS prediction_month,
                  EXISTS (SELECT 1 FROM typed b WHERE b.identity_key = a.identity_key
                          AND b.month_number = a.month_number + 3) AS endpoint_observed
           FROM typed a WHERE traceable""",
        CUSTOMER,
    ),
)
def endpoint_presence(spark, folder):
    return label_ops.endpoint_presence(customer_panel(spark, folder), 3)


def _accounting_sql() -> str:
    parts = [
        f"""SELECT '{t.name}' AS target_name, '{t.horizon} months' AS prediction_horizon,
            count({t.name}) AS eligible_rows, CAST(coalesce(sum({t.name}), 0) AS BIGINT) AS positive_rows,
            CAST(count({t.name}) - coalesce(sum({t.name}), 0) AS BIGINT) AS negative_rows,
            count(*) - count({t.name}) + (SELECT count(*) FROM typed WHERE NOT traceable) AS unknown_rows,
            round({ratio(f'sum({t.name})', f'count({t.name})')}, 6) AS positive_rate,
            count(DISTINCT CASE WHEN {t.name} IS NOT NULL THEN identity_key END) AS projects_covered
        FROM labelled"""
        for t in label_ops.TARGETS
    ]
    return with_(" UNION ALL ".join(parts), SUPPLIER, LABELS)


@query("label_accounting", _accounting_sql())
def label_accounting(spark, folder):
    return label_ops.label_accounting(supplier_panel(spark, folder))


def _first_change(horizon: int, shift: int) -> str:
    return f"""SELECT a.identity_key, a.report_month AS prediction_month,
        CAST(min(CASE WHEN b.effective_end - a.effective_end >= {shift} THEN b.month_number END) IS NOT NULL AS INTEGER) AS label,
        coalesce(min(CASE WHEN b.effective_end - a.effective_end >= {shift} THEN b.report_month END), '') AS first_change_month
      FROM typed a
      JOIN typed e ON e.identity_key = a.identity_key AND e.month_number = a.month_number + {horizon}
      LEFT JOIN typed b ON b.identity_key = a.identity_key
           AND b.month_number BETWEEN a.month_number + 1 AND a.month_number + {horizon}
      WHERE a.traceable AND a.effective_end IS NOT NULL AND e.effective_end IS NOT NULL
      GROUP BY a.identity_key, a.report_month, a.month_number"""


@query("first_later_change", with_(_first_change(6, 1), SUPPLIER))
def first_later_change(spark, folder):
    return label_ops.first_later_change(supplier_panel(spark, folder), 6, 1)


def _candidates_sql(month: str) -> str:
    parts = []
    for name, horizon, shift in label_ops.SCHEDULE_CANDIDATES:
        if shift is None:
            source = (
                "SELECT identity_key, future_overdue_active_3m AS label, '' AS first_change_month "
                "FROM labelled WHERE future_overdue_active_3m IS NOT NULL"
            )
        else:
            source = _first_change(horizon, shift)
        parts.append(
            f"""SELECT '{name}' AS target_name, '{horizon} months' AS prediction_horizon, count(*) AS eligible_rows,
                CAST(sum(label) AS BIGINT) AS positive_rows, CAST(count(*) - sum(label) AS BIGINT) AS negative_rows,
                (SELECT count(*) FROM typed) - count(*) AS unknown_rows,
                round(sum(label)::DOUBLE / count(*), 6) AS positive_rate,
                count(DISTINCT identity_key) AS projects_covered,
                count(*) FILTER (WHERE label = 1 AND first_change_month = '{month}') AS event_month_concentration,
                '{'LOW' if shift is None else 'MEDIUM'}' AS semantic_confidence
              FROM ({source})"""
        )
    return with_(" UNION ALL ".join(parts), SUPPLIER, LABELS)


@query("schedule_candidates", _candidates_sql("2022-03"))
def schedule_candidates(spark, folder):
    return label_ops.schedule_candidates(supplier_panel(spark, folder), "2022-03")


_MONTHS = ["2025-08", "2025-09", "2025-10", "2025-11", "2025-12"]
_EVENTS = f"""events AS (
  SELECT * FROM (
    SELECT *, lag(revised_end) OVER w AS previous_end, lag(report_month) OVER w AS previous_month
    FROM typed WHERE traceable WINDOW w AS (PARTITION BY identity_key ORDER BY month_number))
  WHERE report_month = '2025-11' AND revised_end > previous_end)"""
_EVENT_COLUMNS = f"""project_code, e.identity_key, project_name, previous_month AS prediction_month,
  {month_text('previous_end')} AS cutoff_target, {month_text('revised_end')} AS future_target,
  '2025-11' AS target_change_month, revised_end - previous_end AS shift_months,
  original_doc AS original_end_date, revised_doc AS revised_end_date, source_file, source_page, source_section,
  1 AS label_value"""


@query("transition_events", with_(f"SELECT {_EVENT_COLUMNS} FROM events e", CUSTOMER, _EVENTS))
def transition_events(spark, folder):
    return label_ops.transition_events(customer_panel(spark, folder), "2025-11")


def _at(month: str) -> str:
    return (
        f"coalesce((SELECT {month_text('t.effective_end')} FROM typed t WHERE t.identity_key = e.identity_key "
        f"AND t.report_month = '{month}'), '') AS target_{month.replace('-', '_')}"
    )


@query(
    "transition_timeline",
    with_(f"SELECT {_EVENT_COLUMNS}, {', '.join(_at(m) for m in _MONTHS)} FROM events e", CUSTOMER, _EVENTS),
)
def transition_timeline(spark, folder):
    panel = customer_panel(spark, folder)
    events = label_ops.transition_events(panel, "2025-11")
    return label_ops.with_timeline_columns(events, panel, _MONTHS)


@query(
    "review_carry_over",
    with_(
        """, review AS (
             SELECT identity_key, count(*) AS earlier_rows, max(source_section) AS reviewed_section
             FROM typed WHERE traceable AND report_month < '2023-01' AND sl_no % 2 = 0 GROUP BY identity_key)
           SELECT e.identity_key, revised_end - previous_end AS shift_months, earlier_rows, reviewed_section
           FROM events e LEFT JOIN review USING (identity_key)""",
        CUSTOMER, _EVENTS,
    ),
)
def review_carry_over(spark, folder):
    panel = customer_panel(spark, folder)
    review = (
        traceable(panel)
        .where((F.col("report_month") < "2023-01") & (F.col("sl_no") % 2 == 0))
        .groupBy("identity_key")
        .agg(F.count("*").alias("earlier_rows"), F.max("source_section").alias("reviewed_section"))
    )
    events = label_ops.transition_events(panel, "2025-11").select("identity_key", "shift_months")
    return label_ops.with_review_columns(events, review, ["earlier_rows", "reviewed_section"])


_HISTORY = f"""h1 AS (
  SELECT *, month_number - row_number() OVER w AS island,
    coalesce(effective_end <> lag(effective_end) OVER w, false)
      OR coalesce(abs(effective_cost - lag(effective_cost) OVER w) > 0.01, false) AS changed,
    EXISTS (SELECT 1 FROM typed b WHERE b.identity_key = a.identity_key AND b.month_number = a.month_number + 3) AS a3,
    EXISTS (SELECT 1 FROM typed b WHERE b.identity_key = a.identity_key AND b.month_number = a.month_number + 6) AS a6
  FROM typed a WHERE traceable WINDOW w AS (PARTITION BY identity_key ORDER BY month_number)),
runs AS (SELECT identity_key, max(n) AS longest FROM
  (SELECT identity_key, island, count(*) AS n FROM h1 GROUP BY 1, 2) GROUP BY 1),
history AS (
  SELECT identity_key, arg_min(project_code, month_number) AS project_code,
    arg_min(legacy_ocms_code, month_number) AS alternate_identifier,
    min(report_month) AS first_observed_month, max(report_month) AS last_observed_month,
    count(*) AS number_of_months, any_value(longest) AS consecutive_months,
    max(month_number) - min(month_number) + 1 - count(*) AS gaps,
    min(CASE WHEN changed THEN month_number END) - min(month_number) AS months_before_first_revision,
    max(CASE WHEN changed THEN month_number END) - min(month_number) AS months_before_last_revision,
    count(*) FILTER (WHERE a3) AS eligible_cutoffs_3m, count(*) FILTER (WHERE a6) AS eligible_cutoffs_6m
  FROM h1 JOIN runs USING (identity_key) GROUP BY identity_key)"""


@query("history_profile", with_("SELECT * FROM history", CUSTOMER, _HISTORY))
def history_profile(spark, folder):
    return history.build_history(customer_panel(spark, folder))


@query(
    "depth_summary",
    with_(
        """SELECT count(*) AS projects, count(*) FILTER (WHERE number_of_months = 1) AS exactly_1,
            count(*) FILTER (WHERE number_of_months >= 2) AS two_plus, count(*) FILTER (WHERE number_of_months >= 3) AS three_plus,
            count(*) FILTER (WHERE number_of_months >= 6) AS six_plus, count(*) FILTER (WHERE number_of_months >= 12) AS twelve_plus,
            count(*) FILTER (WHERE eligible_cutoffs_3m > 0) AS with_3m_lookahead,
            count(*) FILTER (WHERE eligible_cutoffs_6m > 0) AS with_6m_lookahead,
            CAST(sum(eligible_cutoffs_3m) AS BIGINT) AS cutoffs_3m, CAST(sum(eligible_cutoffs_6m) AS BIGINT) AS cutoffs_6m
           FROM history""",
        CUSTOMER, _HISTORY,
    ),
)
def depth_summary(spark, folder):
    return history.depth_summary(history.build_history(customer_panel(spark, folder)))


@query(
    "maturity_availability",
    with_(
        f""", m AS (SELECT report_month, count(*) AS n, count(DISTINCT identity_key) AS p,
                    count(*) FILTER (WHERE traceable) AS tr FROM typed GROUP BY 1),
             pairs AS (SELECT a.report_month, count(DISTINCT a.identity_key) AS pairs FROM typed a JOIN typed b
                    ON a.identity_key = b.identity_key AND b.month_number = a.month_number + 3 GROUP BY 1),
             mature AS (SELECT report_month, count({TARGET}) AS rows, CAST(sum({TARGET}) AS BIGINT) AS events
                    FROM labelled GROUP BY 1)
           SELECT c.report_month AS cutoff_month, c.n AS cutoff_observations, c.p AS cutoff_projects,
                  c.tr AS traceable_observations, {month_label("(CAST(substr(c.report_month,1,4) AS INTEGER)*12 + CAST(substr(c.report_month,6,2) AS INTEGER) + 3)")} AS required_endpoint,
                  e.n IS NOT NULL AS endpoint_month_available, coalesce(e.n, 0) AS endpoint_observations,
                  coalesce(pairs, 0) AS exact_endpoint_project_pairs, coalesce(mature.rows, 0) AS mature_label_rows,
                  coalesce(mature.events, 0) AS mature_events, c.n - coalesce(mature.rows, 0) AS immature_or_unknown_rows,
                  CASE WHEN coalesce(mature.rows, 0) > 0 THEN 'MATURE' ELSE 'IMMATURE_MISSING_ENDPOINT' END AS maturity_status
           FROM m c
           LEFT JOIN m e ON e.report_month = {month_label("(CAST(substr(c.report_month,1,4) AS INTEGER)*12 + CAST(substr(c.report_month,6,2) AS INTEGER) + 3)")}
           LEFT JOIN pairs ON pairs.report_month = c.report_month
           LEFT JOIN mature ON mature.report_month = c.report_month
           WHERE c.report_month >= '2025-05'""",
        CUSTOMER, LABELS,
    ),
)
def maturity_availability(spark, folder):
    return history.maturity_availability(customer_panel(spark, folder), "2025-05")


@query(
    "holdout_separation",
    with_(
        """SELECT (SELECT max(report_month) FROM typed WHERE traceable AND report_month <= '2026-04') AS development_last,
                  min(report_month) AS holdout_first, count(*) AS holdout_rows, 0::BIGINT AS overlap_rows,
                  'SEPARATED' AS status
           FROM typed WHERE traceable AND report_month >= '2026-05'""",
        CUSTOMER,
    ),
)
def holdout_separation(spark, folder):
    rows = traceable(customer_panel(spark, folder))
    development = rows.where(F.col("report_month") <= "2026-04")
    holdout = rows.where(F.col("report_month") >= "2026-05")
    return history.holdout_separation(development, holdout, "2026-04", "2026-05")


@query(
    "endpoint_matching",
    with_(
        f""", incoming AS (
              SELECT * FROM typed WHERE report_month = '2026-07'
              UNION ALL SELECT * FROM typed WHERE report_month = '2026-07' AND sl_no % 7 = 3),
            dup AS (SELECT identity_key, count(*) AS n FROM incoming GROUP BY 1 HAVING count(*) > 1),
            clean AS (SELECT * FROM incoming i WHERE NOT EXISTS (SELECT 1 FROM dup d WHERE d.identity_key = i.identity_key)),
            ids AS (SELECT DISTINCT identity_key FROM clean WHERE traceable),
            cut AS (SELECT t.*, ids.identity_key IS NOT NULL AS found FROM typed t LEFT JOIN ids USING (identity_key)
                    WHERE report_month = '2026-04'),
            base AS (SELECT * FROM typed WHERE report_month < '2026-07' UNION ALL SELECT * FROM clean),
            lab AS (SELECT a.identity_key, (SELECT max(b.effective_end) FROM base b WHERE b.identity_key = a.identity_key
                        AND b.month_number BETWEEN a.month_number + 1 AND a.month_number + 3) > a.effective_end AS later
                    FROM base a JOIN base e ON e.identity_key = a.identity_key AND e.month_number = a.month_number + 3
                    WHERE a.traceable AND a.report_month = '2026-04'
                      AND a.effective_end IS NOT NULL AND e.effective_end IS NOT NULL)
           SELECT CAST(count(*) AS BIGINT) AS cutoff_observations, count(DISTINCT identity_key) AS cutoff_projects,
             count(DISTINCT CASE WHEN traceable AND found THEN identity_key END) AS matched_projects,
             count(*) FILTER (WHERE found) AS matched_observations,
             count(DISTINCT CASE WHEN traceable AND NOT found THEN identity_key END) AS unmatched_projects,
             count(*) FILTER (WHERE traceable AND NOT found) AS unmatched_observations,
             (SELECT count(*) FROM dup WHERE identity_key IS NOT NULL) AS ambiguous_matches,
             (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM dup) AS duplicate_matches,
             (SELECT count(*) FROM lab) AS mature_observations, (SELECT count(DISTINCT identity_key) FROM lab) AS mature_projects,
             (SELECT count(*) FROM lab WHERE later) AS mature_events,
             round((SELECT count(*) FROM lab)::DOUBLE / count(*), 6) AS maturity_coverage
           FROM cut""",
        CUSTOMER,
    ),
)
def endpoint_matching(spark, folder):
    panel = customer_panel(spark, folder)
    existing = panel.where(F.col("report_month") < "2026-07")
    august = panel.where(F.col("report_month") == "2026-07")
    incoming = august.unionByName(august.where(F.col("sl_no") % 7 == 3))
    return history.endpoint_matching(existing, incoming, "2026-04")


@query(
    "id_quality",
    with_(
        """, ids AS (SELECT CASE WHEN sl_no % 50 = 7 THEN 'Q:' || sl_no ELSE identity_key END AS identity_key FROM typed),
        per AS (SELECT identity_key, count(*) AS n, regexp_matches(identity_key, '^[PL]:[^\\s]+$') AS ok FROM ids GROUP BY 1)
        SELECT CAST(coalesce(sum(n) FILTER (WHERE identity_key IS NULL), 0) AS BIGINT) AS missing_ids,
               CAST(coalesce(sum(n) FILTER (WHERE NOT ok), 0) AS BIGINT) AS malformed_ids,
               CAST(coalesce(sum(n) FILTER (WHERE ok AND n > 1), 0) AS BIGINT) AS duplicate_project_rows,
               count(*) FILTER (WHERE ok AND n > 1) AS duplicate_project_ids FROM per""",
        CUSTOMER,
    ),
)
def id_quality(spark, folder):
    """Missing, malformed and repeated identities over every row of the panel."""
    bad = F.concat(F.lit("Q:"), F.col("sl_no").cast("string"))
    return history.id_quality(
        customer_panel(spark, folder).select(F.when(F.col("sl_no") % 50 == 7, bad).otherwise(F.col("identity_key")).alias("identity_key"))
    )


@query(
    "reporting_period_check",
    with_(
        """, batches AS (SELECT report_month, unnest([report_month,
               strftime(CAST(report_month || '-01' AS DATE) + INTERVAL 1 MONTH, '%Y-%m')]) AS expected FROM typed)
           SELECT report_month AS batch, expected, count(*) AS rows, count(*) FILTER (WHERE report_month <> expected) AS other_month_rows,
                  count(*) FILTER (WHERE report_month <> expected) = 0 AS reporting_period_valid
           FROM batches GROUP BY 1, 2""",
        CUSTOMER,
    ),
)
def reporting_period_check(spark, folder):
    """Each month of the panel as a batch of its own, checked against itself and against the next month."""
    following = F.date_format(F.add_months(F.to_date(F.concat("report_month", F.lit("-01"))), 1), "yyyy-MM")
    rows = customer_panel(spark, folder).select("report_month", F.col("report_month").alias("batch"), F.explode(F.array("report_month", following)).alias("expected"))
    return history.period_check(rows, F.col("expected"), ["batch", "expected"])


_GATE_MONTH = "2026-05"
_GIVEN = sql_list([c for c in ENRICHED_COLUMNS if c not in ("source_page", "source_section")] + ["source_line"])
_GATE_ROWS = f"""gate_rows AS (
  SELECT 'one month' AS batch, {sql_list(ENRICHED_COLUMNS)} AS given, report_month, identity_key, date_of_approval, start_date, original_doc, revised_doc,
    CAST(original_cost AS VARCHAR) AS original_cost, CAST(revised_cost AS VARCHAR) AS revised_cost,
    CAST(expenditure AS VARCHAR) AS expenditure, CAST(physical_progress AS VARCHAR) AS physical_progress
  FROM typed WHERE report_month = '{_GATE_MONTH}'
  UNION ALL SELECT 'damaged history', {_GIVEN}, report_month, CASE WHEN sl_no % 50 = 7 THEN 'Q ' || sl_no ELSE identity_key END, date_of_approval,
    CASE WHEN sl_no % 9 = 4 THEN '2020-01' ELSE start_date END, original_doc, revised_doc,
    CASE WHEN sl_no % 8 = 5 THEN 'about ten' ELSE CAST(original_cost AS VARCHAR) END, CAST(revised_cost AS VARCHAR),
    CAST(expenditure AS VARCHAR), CASE WHEN sl_no % 12 = 1 THEN '100.5' WHEN sl_no % 12 = 2 THEN '-1' ELSE CAST(physical_progress AS VARCHAR) END
  FROM (SELECT * FROM typed UNION ALL SELECT * FROM typed WHERE sl_no % 7 = 3)),
gate_keys AS (SELECT batch, identity_key, report_month, count(*) AS n FROM gate_rows GROUP BY 1, 2, 3),
gate_ids AS (SELECT batch, identity_key, sum(n) AS n, sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS repeated,
  coalesce(regexp_matches(identity_key, '^[PL]:[^\\s]+$'), false) AS ok FROM gate_keys GROUP BY 1, 2),
gate_id_counts AS (SELECT batch, sum(CASE WHEN identity_key IS NULL THEN n ELSE 0 END) AS missing_ids,
  sum(CASE WHEN identity_key IS NOT NULL AND NOT ok THEN n ELSE 0 END) AS malformed_ids,
  sum(CASE WHEN ok AND n > 1 THEN n ELSE 0 END) AS duplicate_project_rows, count(*) FILTER (WHERE ok AND n > 1) AS duplicate_project_ids,
  sum(CASE WHEN identity_key IS NOT NULL THEN repeated ELSE 0 END) AS duplicate_project_month_rows FROM gate_ids GROUP BY 1),
gate_values AS (SELECT batch, first(given) AS given, count(*) > 0 AND count(*) FILTER (WHERE report_month IS DISTINCT FROM '{_GATE_MONTH}') = 0 AS period_ok,
  {' + '.join(f"count(*) FILTER (WHERE {c} IS NOT NULL AND NOT regexp_matches({c}, '^(0[1-9]|1[0-2])/[0-9]{{4}}$'))" for c in DATE_FIELDS)} AS malformed_dates,
  {' + '.join(f"count(*) FILTER (WHERE TRY_CAST({c} AS DOUBLE) < 0 OR ({c} IS NOT NULL AND TRY_CAST({c} AS DOUBLE) IS NULL))" for c in ('original_cost', 'revised_cost', 'expenditure'))} AS invalid_numeric_values,
  count(*) FILTER (WHERE TRY_CAST(physical_progress AS DOUBLE) NOT BETWEEN 0 AND 100 OR (physical_progress IS NOT NULL AND TRY_CAST(physical_progress AS DOUBLE) IS NULL))
    AS impossible_progress_values FROM gate_rows GROUP BY 1),
gate AS (SELECT batch, array_to_string(list_sort(list_filter({sql_list(ENRICHED_COLUMNS)}, lambda x: NOT list_contains(given, x))), ';') AS missing_columns,
  array_to_string(list_sort(list_filter(given, lambda x: NOT list_contains({sql_list(ENRICHED_COLUMNS)}, x))), ';') AS unexpected_columns,
  CAST(missing_ids AS BIGINT) AS missing_ids, CAST(malformed_ids AS BIGINT) AS malformed_ids, CAST(duplicate_project_rows AS BIGINT) AS duplicate_project_rows,
  duplicate_project_ids, period_ok AS reporting_period_valid, CAST(duplicate_project_month_rows AS BIGINT) AS duplicate_project_month_rows,
  malformed_dates, invalid_numeric_values, impossible_progress_values FROM gate_values JOIN gate_id_counts USING (batch))"""


@query(
    "incoming_batch_gate",
    with_(
        """SELECT missing_columns = '' AND unexpected_columns = '' AS schema_valid, *,
          CASE WHEN missing_columns = '' AND unexpected_columns = '' AND reporting_period_valid AND malformed_ids + duplicate_project_rows
            + duplicate_project_month_rows + malformed_dates + invalid_numeric_values + impossible_progress_values = 0 THEN 'VALID' ELSE 'INVALID' END
            AS validation_status
        FROM gate""",
        CUSTOMER, _GATE_ROWS,
    ),
)
def incoming_batch_gate(spark, folder):
    """One month as it is, and the whole history with faults of every kind, delivered as that month."""
    rows = written(enrich_panel(customer_month(spark, folder)), "enriched")
    number = F.col("sl_no")
    damaged = rows.unionByName(rows.where(number % 7 == 3)).withColumns(
        {
            "identity_key": F.when(number % 50 == 7, F.concat(F.lit("Q "), number.cast("string"))).otherwise(F.col("identity_key")),
            "start_date": F.when(number % 9 == 4, "2020-01").otherwise(F.col("start_date")),
            "original_cost": F.when(number % 8 == 5, "about ten").otherwise(F.col("original_cost").cast("string")),
            "physical_progress": F.when(number % 12 == 1, "100.5").when(number % 12 == 2, "-1").otherwise(F.col("physical_progress").cast("string")),
            "source_line": F.lit(1),
        }
    ).drop("source_page", "source_section")
    batches = {"one month": rows.where(F.col("report_month") == _GATE_MONTH), "damaged history": damaged}
    gated = [history.batch_gate(batch, _GATE_MONTH).withColumn("batch", F.lit(name)) for name, batch in batches.items()]
    return gated[0].unionByName(gated[1])


_SPLIT = f"""parts AS (
  SELECT *, CASE WHEN prediction_month BETWEEN '2025-07' AND '2025-12' THEN 'train'
                 WHEN prediction_month BETWEEN '2026-01' AND '2026-02' THEN 'validation'
                 WHEN prediction_month BETWEEN '2026-03' AND '2026-04' THEN 'test' END AS part
  FROM supervised)"""


def _report_sql(parts: str) -> str:
    return f"""SELECT upper(part) AS part, min(prediction_month) AS period_start, max(prediction_month) AS period_end,
      count(*) AS rows, count(DISTINCT identity_key) AS projects, CAST(sum({TARGET}) AS BIGINT) AS positive_rows,
      round(avg({TARGET}), 6) AS positive_rate,
      CASE WHEN part = 'train' THEN 0 ELSE count(DISTINCT CASE WHEN identity_key IN
        (SELECT identity_key FROM {parts} WHERE part = 'train') THEN identity_key END) END AS projects_overlapping_train
    FROM {parts} WHERE part IS NOT NULL GROUP BY part"""


_SUP = (SUPPLIER, FEATURES, LABELS, SUPERVISED)


@query("temporal_split_report", with_(_report_sql("parts"), *_SUP, _SPLIT))
def temporal_split_report(spark, folder):
    return splits.split_report(splits.with_split(supervised(spark, folder), TARGET, "schedule"), TARGET)


def _named_split(kind: str) -> str:
    whens = " ".join(
        f"WHEN prediction_month BETWEEN '{a}' AND '{b}' THEN '{p}'" for p, (a, b) in splits.SPLITS[kind].items()
    )
    return with_(
        f"""SELECT part, prediction_month, count(*) AS rows, CAST(sum({TARGET}) AS BIGINT) AS positives
        FROM (SELECT *, CASE {whens} END AS part FROM supervised) WHERE part IS NOT NULL GROUP BY 1, 2""",
        *_SUP,
    )


def _split_rows(spark, folder, kind):
    return splits.with_split(supervised(spark, folder), TARGET, kind).groupBy("part", "prediction_month").agg(
        F.count("*").alias("rows"), F.sum(TARGET).alias("positives")
    )


@query("alternative_split", _named_split("alternative"))
def alternative_split(spark, folder):
    return _split_rows(spark, folder, "alternative")


@query("purged_split", _named_split("purged"))
def purged_split(spark, folder):
    return _split_rows(spark, folder, "purged")


_BUCKET = """buckets AS (
  SELECT *, CASE WHEN s5 % 2 = parity THEN s5 ELSE s5 + 5 END AS bucket FROM (
    SELECT *, list_sum(list_transform(string_split(sha256(identity_key), ''), lambda c: strpos('0123456789abcdef', c) - 1)) % 5 AS s5,
           (strpos('0123456789abcdef', right(sha256(identity_key), 1)) - 1) % 2 AS parity
    FROM supervised))"""
_DISJOINT = """disjoint AS (
  SELECT *, CASE WHEN bucket <= 5 AND prediction_month <= '2025-12' THEN 'train'
                 WHEN bucket IN (6, 7) AND prediction_month BETWEEN '2026-01' AND '2026-02' THEN 'validation'
                 WHEN bucket >= 8 AND prediction_month >= '2026-03' THEN 'test' END AS part
  FROM buckets)"""


@query("entity_disjoint_split", with_(_report_sql("disjoint"), *_SUP, _BUCKET, _DISJOINT))
def entity_disjoint_split(spark, folder):
    return splits.split_report(splits.with_disjoint_split(supervised(spark, folder)), TARGET)


@query(
    "entity_disjoint_overlap",
    with_(
        """SELECT count(*) AS overlapping_entities FROM (SELECT identity_key FROM disjoint WHERE part IS NOT NULL
           GROUP BY 1 HAVING count(DISTINCT part) > 1)""",
        *_SUP, _BUCKET, _DISJOINT,
    ),
)
def entity_disjoint_overlap(spark, folder):
    return splits.disjoint_overlap(splits.with_disjoint_split(supervised(spark, folder)))


def _windows_sql() -> str:
    parts = []
    for i, (a, b, e) in enumerate(splits.fold_bounds()):
        train, evaluated = f"prediction_month BETWEEN '{a}' AND '{b}'", f"prediction_month = '{e}'"
        parts.append(
            f"""SELECT {i} AS w, '{a}' AS training_period_start, '{b}' AS training_period_end, '{e}' AS evaluation_period,
            count(*) FILTER (WHERE {train}) AS train_rows,
            count(DISTINCT identity_key) FILTER (WHERE {train}) AS train_projects,
            CAST(sum({TARGET}) FILTER (WHERE {train}) AS BIGINT) AS train_positive_rows,
            count(*) FILTER (WHERE {evaluated}) AS evaluation_rows,
            count(DISTINCT identity_key) FILTER (WHERE {evaluated}) AS evaluation_projects,
            CAST(sum({TARGET}) FILTER (WHERE {evaluated}) AS BIGINT) AS evaluation_positive_rows
            FROM supervised"""
        )
    number = "(CAST(substr({c},1,4) AS INTEGER)*12 + CAST(substr({c},6,2) AS INTEGER) + 3)"
    return with_(
        f""", w AS ({' UNION ALL '.join(parts)})
        SELECT CAST(row_number() OVER (ORDER BY w) AS INTEGER) AS fold, * EXCLUDE (w),
          {month_label(number.format(c='training_period_end'))} AS training_label_endpoint,
          {month_label(number.format(c='evaluation_period'))} AS evaluation_label_endpoint,
          round(evaluation_positive_rows::DOUBLE / evaluation_rows, 6) AS evaluation_event_rate
        FROM w WHERE train_rows > 0 AND evaluation_rows > 0""",
        *_SUP,
    )


@query("maturity_windows", _windows_sql())
def maturity_windows(spark, folder):
    return splits.maturity_windows(supervised(spark, folder), TARGET)


@query(
    "labelled_months",
    with_(
        f"""SELECT o.report_month AS month, observations, projects, coalesce(n, 0) AS label_eligible,
             coalesce(pos, 0) AS positive_count, round(rate, 6) AS event_rate, observations - coalesce(n, 0) AS unknown_observations
        FROM (SELECT report_month, count(*) AS observations, count(DISTINCT identity_key) AS projects FROM typed GROUP BY 1) o
        LEFT JOIN (SELECT report_month, count({TARGET}) AS n, CAST(sum({TARGET}) AS BIGINT) AS pos, avg({TARGET}) AS rate
                   FROM labelled WHERE {TARGET} IS NOT NULL GROUP BY 1) l USING (report_month)""",
        CUSTOMER, LABELS,
    ),
)
def labelled_months(spark, folder):
    panel = customer_panel(spark, folder)
    labels = label_ops.label_table(panel, TARGET).withColumnRenamed("label", TARGET)
    return splits.labelled_months(panel, labels, TARGET)


@query(
    "labelled_scope",
    with_(f"SELECT prediction_month, count(*) AS rows, CAST(sum({TARGET}) AS BIGINT) AS positives FROM supervised WHERE prediction_month <= '2026-04' GROUP BY 1", *_SUP),
)
def labelled_scope(spark, folder):
    rows = supervised(spark, folder).where(F.col("prediction_month") <= "2026-04")
    return splits.labelled_scope(rows, TARGET, "2026-04").groupBy("prediction_month").agg(
        F.count("*").alias("rows"), F.sum(TARGET).alias("positives")
    )


@query(
    "label_positives_by_month",
    with_(
        f"""SELECT prediction_month, count(*) AS eligible_rows, CAST(sum({TARGET}) AS BIGINT) AS positive_rows,
            round(avg({TARGET}), 6) AS positive_rate, count(DISTINCT identity_key) AS projects
            FROM supervised GROUP BY 1""",
        *_SUP,
    ),
)
def label_positives_by_month(spark, folder):
    from ..operators.metrics import monthly_target_distribution

    return monthly_target_distribution(supervised(spark, folder), TARGET)
