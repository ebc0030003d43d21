"""Portfolio, risk and change-feed queries over the latest snapshots."""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, functions as F

from ..operators import changes, intelligence, portfolio, search_index
from ..session import run_folder, written
from .inputs import supplier_snapshots
from .registry import query
from .sqltext import SUPPLIER, js, month_text, with_

_DELAY = "greatest(effective_end - original_end, 0)"
_GROWTH = "(CASE WHEN original_cost > 0 THEN effective_cost / original_cost - 1 ELSE 0.0 END)"
_SNAPSHOTS = f"""snap0 AS (
  SELECT *, CAST({_DELAY} AS INTEGER) AS delay_months, (100 - physical_progress) * CAST(0.35 AS DOUBLE) AS unfinished,
    least({_GROWTH} * 40, 40.0::DOUBLE) AS cost_points, least({_DELAY} * CAST(2.5 AS DOUBLE), 40.0::DOUBLE) AS delay_points
  FROM typed WHERE traceable AND physical_progress IS NOT NULL),
snap1 AS (SELECT *, CAST(least({js('unfinished + cost_points + delay_points')}, 100) AS INTEGER) AS risk_score FROM snap0),
snapshots AS (
  SELECT identity_key AS project_id, project_name AS name, coalesce(project_code, legacy_ocms_code) AS code, ministry, agency, sector, state,
    month_number, report_month AS month, physical_progress, expenditure, original_cost, effective_cost AS revised_cost,
    {month_text('original_end')} AS original_completion, {month_text('effective_end')} AS revised_completion, delay_months, risk_score,
    CASE WHEN risk_score >= 85 THEN 'Critical' WHEN risk_score >= 65 THEN 'High' WHEN risk_score >= 40 THEN 'Medium' ELSE 'Low' END AS risk_level,
    CASE WHEN cost_points >= unfinished AND cost_points >= delay_points THEN 'Cost escalation' WHEN delay_points >= unfinished THEN 'Schedule delay'
         WHEN sl_no % 3 = 0 THEN 'Land acquisition pending' ELSE 'Slow physical progress' END AS risk_signal
  FROM snap1)"""
_RANK = "list_position(['Low', 'Medium', 'High', 'Critical'], {x})"
_PAIRS = f"""pairs AS (
  SELECT * FROM (SELECT *, {', '.join(f'lag({c}) OVER w AS previous_{c}' for c in portfolio.PAIRED)},
    row_number() OVER (PARTITION BY project_id ORDER BY month_number DESC) AS newest
  FROM snapshots WINDOW w AS (PARTITION BY project_id ORDER BY month_number)) WHERE newest = 1),
latest AS (
  SELECT *, CASE WHEN risk_change > 2 THEN 'up' WHEN risk_change < -2 THEN 'down' ELSE 'stable' END AS trend FROM (
   SELECT project_id, name, code, ministry, agency, sector, state, physical_progress AS progress, expenditure, original_cost, revised_cost, delay_months,
    risk_level AS risk, risk_score, coalesce(risk_score - previous_risk_score, 0) AS risk_change, risk_signal AS primary_signal, month AS last_updated
   FROM pairs))"""
_BASE = (SUPPLIER, _SNAPSHOTS, _PAIRS)
_G = "(CASE WHEN original_cost > 0 THEN revised_cost / original_cost - 1 END)"
_COST_SIGNAL = f"CASE WHEN {_G} > 0.15::DOUBLE THEN 'escalated' WHEN {_G} > 0.05::DOUBLE THEN 'watch' ELSE 'within' END"
_SCHEDULE_SIGNAL = "CASE WHEN delay_months > 6 THEN 'delayed' WHEN delay_months > 2 THEN 'watch' ELSE 'on_plan' END"
_SHARE = "(CASE WHEN revised_cost <> 0 THEN expenditure / revised_cost END)"
_PRIORITY = js(
    f"""risk_score * CAST(0.35 AS DOUBLE) + greatest(risk_change, 0) * CAST(1.6 AS DOUBLE)
    + (CASE WHEN greatest({_G}, 0.0::DOUBLE) > 0.15::DOUBLE THEN 18 WHEN greatest({_G}, 0.0::DOUBLE) > 0.05::DOUBLE THEN 8 ELSE 0 END)
    + least(delay_months * CAST(1.8 AS DOUBLE), 22.0::DOUBLE) + greatest((55 - progress) * CAST(0.25 AS DOUBLE), 0.0::DOUBLE)
    + (CASE risk WHEN 'Critical' THEN 28 WHEN 'High' THEN 18 WHEN 'Medium' THEN 8 ELSE 0 END)"""
)


def _latest(spark, folder):
    return portfolio.latest_view(supplier_snapshots(spark, folder))


@query(
    "snapshot_series",
    with_("SELECT project_id, month, delay_months, risk_score, risk_level, risk_signal, original_completion, revised_completion FROM snapshots", SUPPLIER, _SNAPSHOTS),
)
def snapshot_series(spark, folder):
    return supplier_snapshots(spark, folder).select(
        "project_id", "month", "delay_months", "risk_score", "risk_level", "risk_signal", "original_completion", "revised_completion"
    )


@query(
    "latest_and_previous",
    with_(f"SELECT project_id, month, risk_score, risk_level, {', '.join(f'previous_{c}' for c in portfolio.PAIRED)} FROM pairs", *_BASE),
)
def latest_and_previous(spark, folder):
    return portfolio.latest_pairs(supplier_snapshots(spark, folder)).select(
        "project_id", "month", "risk_score", "risk_level", *[f"previous_{c}" for c in portfolio.PAIRED]
    )


@query("latest_view", with_("SELECT * FROM latest", *_BASE))
def latest_view(spark, folder):
    return _latest(spark, folder)


@query(
    "portfolio_signals",
    with_(
        f"""SELECT project_id, {_COST_SIGNAL} AS cost_signal, {_SCHEDULE_SIGNAL} AS schedule_signal,
          CASE WHEN {js(f'{_G} * 100')} > 10 THEN '+' || {js(f'{_G} * 100')} || '%' ELSE 'Within plan' END AS cost_signal_label,
          CASE WHEN delay_months <> 0 THEN delay_months || ' mo.' ELSE 'On plan' END AS schedule_signal_label, {_PRIORITY} AS attention_priority,
          CASE WHEN contains(lower(primary_signal), 'cost') THEN 'Cost' WHEN contains(lower(primary_signal), 'schedule') OR contains(lower(primary_signal), 'delay') THEN 'Schedule'
               WHEN contains(lower(primary_signal), 'progress') THEN 'Progress' WHEN contains(lower(primary_signal), 'land') THEN 'Delivery' ELSE 'Baseline' END AS primary_signal_kind
        FROM latest""",
        *_BASE,
    ),
)
def portfolio_signals(spark, folder):
    return portfolio.with_signals(_latest(spark, folder)).select(
        "project_id", "cost_signal", "schedule_signal", "cost_signal_label", "schedule_signal_label",
        "attention_priority", "primary_signal_kind",
    )


@query(
    "attention_ranking",
    with_(f"SELECT project_id, risk, {_PRIORITY} AS attention_priority FROM latest ORDER BY 3 DESC, 1 LIMIT 4", *_BASE),
)
def attention_ranking(spark, folder):
    return portfolio.ranked_by_attention(_latest(spark, folder), 4).select("project_id", "risk", "attention_priority")


_TEXT = "lower(concat_ws(' ', name, code, agency, ministry, sector, state))"


@query(
    "search_top",
    with_(f"SELECT project_id, code, name FROM latest WHERE contains({_TEXT}, 'asia') ORDER BY code, project_id LIMIT 8", *_BASE),
)
def search_top(spark, folder):
    return portfolio.search_top(_latest(spark, folder), " ASIA ").select("project_id", "code", "name")


_SEARCHES = ("ASIA", "su", "9", "#00000001", " brand#2", "no such entity")


@query(
    "indexed_search",
    with_(
        " UNION ALL ".join(
            f"SELECT '{q}' AS query, project_id, code, name FROM latest WHERE contains({_TEXT}, '{q.strip().lower()}')" for q in _SEARCHES
        ),
        *_BASE,
    ),
)
def indexed_search(spark, folder):
    """Every match of several searches, from one index of the snapshot."""
    view = written(_latest(spark, folder), "latest")
    index = f"{run_folder(spark)}/search-{uuid4().hex}"
    search_index.write_index(view, index)
    found = [
        search_index.indexed_search(view, index, q).select(F.lit(q).alias("query"), "project_id", "code", "name") for q in _SEARCHES
    ]
    return reduce(DataFrame.unionByName, found)


@query(
    "portfolio_filter",
    with_(
        f"""SELECT project_id, progress, risk, trend FROM latest WHERE contains({_TEXT}, 'supplier') AND ministry = 'ASIA' AND progress BETWEEN 40 AND 70
        AND {_COST_SIGNAL} = 'escalated' AND trend <> 'x'""",
        *_BASE,
    ),
)
def portfolio_filter(spark, folder):
    return portfolio.portfolio_filter(
        _latest(spark, folder), query="supplier", ministry="ASIA", progress="40–70%", cost="escalated"
    ).select("project_id", "progress", "risk", "trend")


@query(
    "lookup_by_code",
    with_("SELECT project_id, code FROM latest WHERE code = '100007'", *_BASE),
)
def lookup_by_code(spark, folder):
    return portfolio.by_code(_latest(spark, folder), "100007").select("project_id", "code")


@query("attention_projects", with_("SELECT project_id, risk, risk_score FROM latest WHERE risk IN ('High', 'Critical')", *_BASE))
def attention_projects(spark, folder):
    return portfolio.attention_projects(_latest(spark, folder)).select("project_id", "risk", "risk_score")


_RL, _PL = _RANK.format(x="risk_level"), _RANK.format(x="previous_risk_level")
_DELTAS = f"""deltas AS (SELECT *, risk_score - previous_risk_score AS score_delta, {_RL} - {_PL} AS level_change,
   revised_cost - previous_revised_cost AS cost_delta, {js(f'{_G} * 100')} AS cost_pct, delay_months - previous_delay_months AS delay_delta,
   physical_progress - previous_physical_progress AS progress_delta, revised_completion <> previous_revised_completion AS end_moved
  FROM pairs WHERE previous_risk_score IS NOT NULL),
risk_events AS (SELECT project_id, name, CASE WHEN level_change > 0 OR score_delta > 2 THEN 'elevated' WHEN level_change < 0 OR score_delta < -2 THEN 'improved' ELSE 'stable' END AS kind,
   previous_risk_level AS from_level, risk_level AS to_level, score_delta, risk_signal AS reason, month AS date FROM deltas)"""
_BASE2 = (*_BASE, _DELTAS)


@query("risk_events", with_("SELECT * FROM risk_events", *_BASE2))
def risk_events(spark, folder):
    return changes.risk_events(supplier_snapshots(spark, folder))


_NEWLY = f"kind = 'elevated' AND ({_RANK.format(x='to_level')} >= 3 OR score_delta >= 6)"
_SIGNED = "(CASE WHEN score_delta > 0 THEN '+' ELSE '' END || score_delta || ' pts')"


@query(
    "newly_elevated",
    with_(f"SELECT project_id, name, {_SIGNED} AS change, from_level, to_level, reason FROM risk_events WHERE {_NEWLY}", *_BASE2),
)
def newly_elevated(spark, folder):
    return changes.newly_elevated(supplier_snapshots(spark, folder))


_RISKY = """risky AS (SELECT l.*, d.previous_risk_level AS from_level,
   coalesce(level_change > 0 OR (score_delta > 2 AND l.risk_score >= 65), false) AS elevated,
   coalesce(level_change > 0 OR (score_delta > 2 AND l.risk_score >= 65), false) OR (trend = 'up' AND risk_change > 0) AS in_elevated_set,
   l.primary_signal AS attention_reason FROM latest l LEFT JOIN deltas d USING (project_id))"""
_BASE3 = (*_BASE2, _RISKY)


@query("risk_projects", with_("SELECT * FROM risky", *_BASE3))
def risk_projects(spark, folder):
    return changes.risk_projects(supplier_snapshots(spark, folder))


@query("elevated_set", with_("SELECT project_id, risk_score FROM risky WHERE in_elevated_set", *_BASE3))
def elevated_set(spark, folder):
    return changes.elevated_set(supplier_snapshots(spark, folder)).select("project_id", "risk_score")


def _num(value: str) -> str:
    return f"(CASE WHEN {value} = floor({value}) THEN CAST(CAST(floor({value}) AS BIGINT) AS VARCHAR) ELSE CAST(CAST({value} AS DECIMAL(18,2)) AS VARCHAR) END)"


_EVENTS = f"""events_all AS (
  SELECT project_id, name, month AS date, 'elevated' AS type, 'Newly elevated to ' || risk_level AS title, {_SIGNED} AS magnitude, risk_signal AS detail, 0 AS priority
    FROM deltas WHERE level_change > 0 OR score_delta >= 6
  UNION ALL SELECT project_id, name, month, 'cost', 'Cost revision recorded', '+' || cost_pct || '%', 'Revised cost moved to ₹' || {_num('revised_cost')} || ' Cr', 1
    FROM deltas WHERE cost_delta > 50 OR (cost_pct >= 15 AND cost_delta > 0)
  UNION ALL SELECT project_id, name, month, 'schedule', 'Schedule deterioration', CASE WHEN delay_delta > 0 THEN '+' || delay_delta || ' months' ELSE revised_completion END,
      'Completion revised to ' || revised_completion, 2 FROM deltas WHERE delay_delta > 0 OR end_moved
  UNION ALL SELECT project_id, name, month, 'progress', CASE WHEN progress_delta <= 0 THEN 'Progress stagnation' ELSE 'Progress slowdown detected' END,
      CASE WHEN progress_delta <= 0 THEN '0 pts MoM' ELSE '−' || {_num('(3 - progress_delta)')} || ' pts vs plan' END,
      CASE WHEN progress_delta <= 0 THEN 'No measured physical progress this period' ELSE 'Monthly physical progress below plan' END, 3 FROM deltas WHERE progress_delta < 3
  UNION ALL SELECT project_id, name, month, 'improvement', 'Notable improvement', score_delta || ' pts', 'Risk score declining vs previous month', 4
    FROM deltas WHERE score_delta < -2 OR level_change < 0),
best_events AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY priority) AS r FROM events_all) WHERE r = 1),
extra_events AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY project_id) AS r FROM events_all) WHERE r = 1
   AND type NOT IN (SELECT type FROM best_events)),
feed AS (SELECT * EXCLUDE (added) FROM (SELECT *, 0 AS added FROM best_events UNION ALL SELECT *, 1 FROM extra_events) ORDER BY priority, added, project_id LIMIT 12)"""
_BASE4 = (*_BASE3, _EVENTS)


@query("change_events", with_("SELECT * FROM events_all", *_BASE4))
def change_events(spark, folder):
    return changes.change_events(supplier_snapshots(spark, folder))


@query("change_feed", with_("SELECT * FROM feed", *_BASE4))
def change_feed(spark, folder):
    return changes.change_feed(supplier_snapshots(spark, folder))


@query(
    "change_summaries",
    with_(
        f"""SELECT 'projects newly elevated' AS summary, count(*) AS projects FROM risk_events WHERE {_NEWLY}
        UNION ALL SELECT 'cost escalation signals', count(*) FROM events_all WHERE type = 'cost'
        UNION ALL SELECT 'schedule deterioration signals', count(*) FROM events_all WHERE type = 'schedule'
        UNION ALL SELECT 'projects improved', count(*) FROM events_all WHERE type = 'improvement'""",
        *_BASE4,
    ),
)
def change_summaries(spark, folder):
    return changes.change_summaries(supplier_snapshots(spark, folder))


@query(
    "risk_counts",
    with_(
        " UNION ALL ".join(
            f"SELECT '{x}' AS risk, count(*) FILTER (WHERE risk = '{x}') AS projects, {js(f'count(*) FILTER (WHERE risk = {chr(39)}{x}{chr(39)})::DOUBLE / count(*) * 100')} AS share_pct FROM latest"
            for x in portfolio.LEVELS
        ),
        *_BASE,
    ),
)
def risk_counts(spark, folder):
    return portfolio.risk_counts(_latest(spark, folder))


_STATE = f"""state_risk AS (SELECT state, ['Low', 'Medium', 'High', 'Critical'][max({_RANK.format(x='risk')})] AS level, count(*) AS projects,
   count(*) FILTER (WHERE risk IN ('High', 'Critical')) AS high_risk, {js('avg(risk_score)')} AS risk_index, {js('avg(risk_change)')} AS change_vs_previous,
   {js('avg(progress)')} AS average_progress FROM latest GROUP BY 1)"""


@query("state_risk", with_("SELECT * FROM state_risk", *_BASE, _STATE))
def state_risk(spark, folder):
    return portfolio.state_risk(_latest(spark, folder))


@query(
    "risk_landscape",
    with_(
        "SELECT state, level, risk_index AS x, change_vs_previous AS y, projects AS z, state IN ('NATION_1', 'NATION_7') AS labeled FROM state_risk",
        *_BASE, _STATE,
    ),
)
def risk_landscape(spark, folder):
    return portfolio.risk_landscape(_latest(spark, folder), ["NATION_1", "NATION_7"])


@query(
    "national_trend",
    with_(
        """SELECT month, floor((CAST(sum(revised_cost::DECIMAL(18,2)) AS DOUBLE) / CAST(sum(original_cost::DECIMAL(18,2)) AS DOUBLE) - 1) * 100 * 10 + 0.5) / 10 AS escalation,
          count(*) FILTER (WHERE delay_months > 2) AS delay FROM snapshots GROUP BY 1 ORDER BY 1 DESC LIMIT 6""",
        SUPPLIER, _SNAPSHOTS,
    ),
)
def national_trend(spark, folder):
    return portfolio.national_trend(supplier_snapshots(spark, folder))


@query(
    "overview_kpis",
    with_(
        f"""SELECT *, floor((revised_cost / original_cost - 1) * 100 * 10 + 0.5) / 10 AS cost_pct, floor(expenditure / revised_cost * 1000 + 0.5) / 10 AS spend_pct FROM (
          SELECT count(*) AS total_projects, CAST(sum(revised_cost::DECIMAL(18,2)) AS DOUBLE) AS revised_cost, CAST(sum(original_cost::DECIMAL(18,2)) AS DOUBLE) AS original_cost,
            CAST(sum(expenditure::DECIMAL(18,2)) AS DOUBLE) AS expenditure, count(*) FILTER (WHERE risk IN ('High', 'Critical')) AS at_risk,
            count(*) FILTER (WHERE {_SCHEDULE_SIGNAL} <> 'on_plan') AS delay_signals, count(*) FILTER (WHERE {_COST_SIGNAL} <> 'within') AS cost_signals,
            count(*) FILTER (WHERE in_elevated_set) AS elevated, count(*) FILTER (WHERE trend = 'stable') AS stable, count(*) FILTER (WHERE trend = 'down') AS improving,
            (SELECT count(*) FROM risk_events WHERE {_NEWLY}) AS newly_elevated FROM risky)""",
        *_BASE3,
    ),
)
def overview_kpis(spark, folder):
    return changes.overview_kpis(supplier_snapshots(spark, folder))


_SECTORS = f"""sectors AS (SELECT sector AS name, {js('avg(progress)')} AS progress, {js('avg(risk_score)')} AS risk, floor(avg(delay_months) * 10 + 0.5) / 10 AS delay FROM latest GROUP BY 1)"""


@query("sector_performance", with_(f"SELECT *, {js('(progress + (100 - risk)) / 2')} AS health FROM sectors", *_BASE, _SECTORS))
def sector_performance(spark, folder):
    return portfolio.sector_performance(_latest(spark, folder))


@query("risk_concentration", with_("SELECT name, risk AS value FROM sectors", *_BASE, _SECTORS))
def risk_concentration(spark, folder):
    return portfolio.risk_concentration(_latest(spark, folder))


_CB = f"CASE WHEN {_G} * 100 < 5 THEN 0 WHEN {_G} * 100 < 10 THEN 1 WHEN {_G} * 100 < 20 THEN 2 WHEN {_G} * 100 < 40 THEN 3 ELSE 4 END"
_DB = "CASE WHEN delay_months <= 0 THEN 0 WHEN delay_months < 3 THEN 1 WHEN delay_months < 6 THEN 2 WHEN delay_months < 12 THEN 3 ELSE 4 END"


def _histogram(bucket: str, labels) -> str:
    return with_(
        " UNION ALL ".join(
            f"SELECT {i + 1} AS position, '{x}' AS label, count(*) FILTER (WHERE {bucket} = {i}) AS projects FROM latest"
            for i, (x, _) in enumerate(labels)
        ),
        *_BASE,
    )


@query("cost_histogram", _histogram(_CB, portfolio.COST_BUCKETS))
def cost_histogram(spark, folder):
    return portfolio.cost_histogram(_latest(spark, folder))


@query("delay_histogram", _histogram(_DB, portfolio.DELAY_BUCKETS))
def delay_histogram(spark, folder):
    return portfolio.delay_histogram(_latest(spark, folder))


@query(
    "health_components",
    with_(
        f"""SELECT {js(f"count(*) FILTER (WHERE {_SCHEDULE_SIGNAL} = 'on_plan')::DOUBLE / count(*) * 100")} AS schedule_health,
          {js(f"count(*) FILTER (WHERE {_COST_SIGNAL} = 'within')::DOUBLE / count(*) * 100")} AS cost_health, {js('avg(progress)')} AS progress_health,
          least(100, {js(f'avg(least(100.0::DOUBLE, progress / greatest(1.0::DOUBLE, {_SHARE} * 100) * 100))')}) AS expenditure_efficiency FROM latest""",
        *_BASE,
    ),
)
def health_components(spark, folder):
    return portfolio.health_components(_latest(spark, folder))


_ANOMALIES = f"""members AS (
  SELECT 'a1' AS anomaly, project_id FROM latest WHERE {_SHARE} > 0.55::DOUBLE AND progress < 50
  UNION ALL SELECT 'a2', project_id FROM latest WHERE {_G} > 0.15::DOUBLE
  UNION ALL SELECT 'a3', project_id FROM latest WHERE delay_months > 6 AND risk_change > 0
  UNION ALL SELECT DISTINCT 'a4', project_id FROM events_all WHERE type = 'progress')"""


@query("anomaly_members", with_("SELECT * FROM members", *_BASE4, _ANOMALIES))
def anomaly_members(spark, folder):
    return changes.anomaly_members(supplier_snapshots(spark, folder))


@query(
    "portfolio_anomalies",
    with_(
        " UNION ALL ".join(
            f"SELECT '{a}' AS anomaly, '{label}' AS label, count(*) FILTER (WHERE anomaly = '{a}') AS projects FROM members"
            for a, label in changes.PORTFOLIO_ANOMALIES
        ),
        *_BASE4, _ANOMALIES,
    ),
)
def portfolio_anomalies(spark, folder):
    return changes.portfolio_anomalies(supplier_snapshots(spark, folder))


@query(
    "matrix_points",
    with_(
        f"SELECT project_id, sector, {js(f'{_SHARE} * 100')} AS spend, progress, {js(f'{_G} * 100')} AS cost_escalation, delay_months AS delay, risk_score, risk_change AS change FROM latest",
        *_BASE,
    ),
)
def matrix_points(spark, folder):
    return portfolio.matrix_points(_latest(spark, folder))


@query(
    "quadrant_counts",
    with_(
        f"""SELECT count(*) FILTER (WHERE {js(f'{_SHARE} * 100')} > 65 AND progress < 60) AS high_spend_low_progress,
        count(*) FILTER (WHERE {js(f'{_SHARE} * 100')} <= 65 AND progress >= 60) AS low_spend_high_progress FROM latest""",
        *_BASE,
    ),
)
def quadrant_counts(spark, folder):
    return portfolio.quadrant_counts(_latest(spark, folder))


@query(
    "cross_filter",
    with_("SELECT project_id, sector, risk FROM latest WHERE project_id IN (SELECT project_id FROM members WHERE anomaly = 'a1')", *_BASE4, _ANOMALIES),
)
def cross_filter(spark, folder):
    rows = supplier_snapshots(spark, folder)
    chosen = changes.anomaly_members(rows).where(F.col("anomaly") == "a1")
    return portfolio.cross_filter(portfolio.latest_view(rows), chosen).select("project_id", "sector", "risk")




def _watched(spark, folder):
    rows = supplier_snapshots(spark, folder)
    number = F.regexp_replace("project_id", "[^0-9]", "").cast("long")
    return rows.where(number % 9 == 4).select("project_id").distinct()


_WATCHED = "watched AS (SELECT DISTINCT project_id FROM snapshots WHERE CAST(regexp_replace(project_id, '[^0-9]', '', 'g') AS BIGINT) % 9 = 4)"


@query("watchlist", with_("SELECT project_id, risk, risk_score FROM latest WHERE project_id IN (SELECT project_id FROM watched)", *_BASE, _WATCHED))
def watchlist(spark, folder):
    return portfolio.watchlist(_latest(spark, folder), _watched(spark, folder)).select("project_id", "risk", "risk_score")


@query(
    "monitor_sections",
    with_(
        """SELECT 'all' AS section, count(*) AS projects FROM risky
        UNION ALL SELECT 'elevated', count(*) FROM risky WHERE in_elevated_set
        UNION ALL SELECT 'review', count(*) FROM risky WHERE risk IN ('High', 'Medium') AND trend <> 'down'
        UNION ALL SELECT 'critical', count(*) FROM risky WHERE risk = 'Critical'
        UNION ALL SELECT 'watchlist', count(*) FROM risky WHERE project_id IN (SELECT project_id FROM watched)""",
        *_BASE3, _WATCHED,
    ),
)
def monitor_sections(spark, folder):
    return changes.monitor_sections(supplier_snapshots(spark, folder), _watched(spark, folder))


_TRAJECTORY = f"""trajectory AS (SELECT project_id, month, physical_progress AS physical, {js(f'{_SHARE} * 100')} AS expenditure,
   least(95, {js('physical_progress + (count(*) OVER (PARTITION BY project_id) - row_number() OVER (PARTITION BY project_id ORDER BY month_number)) * 2 + 8')}) AS planned,
   {js(f'{_G} * 100')} AS cost_change, delay_months AS schedule_change, risk_score FROM snapshots)"""


@query("trajectory", with_("SELECT * FROM trajectory", SUPPLIER, _SNAPSHOTS, _TRAJECTORY))
def trajectory(spark, folder):
    return intelligence.trajectory(supplier_snapshots(spark, folder))


@query(
    "signal_history",
    with_("SELECT project_id, month, risk_score AS risk, cost_change AS cost, schedule_change AS schedule, physical AS progress FROM trajectory", SUPPLIER, _SNAPSHOTS, _TRAJECTORY),
)
def signal_history(spark, folder):
    return intelligence.signal_history(supplier_snapshots(spark, folder))


_MOVED = "coalesce(physical_progress - previous_physical_progress, 0.0)"
_DRIVERS = f"""drivers AS (
  SELECT project_id, 1 AS p, 'Schedule deterioration' AS label, least(40, 12 + delay_months * 2)::DOUBLE AS value, '+' || delay_months || ' months' AS magnitude FROM pairs
  UNION ALL SELECT project_id, 2, 'Cost escalation', least(40, greatest(8, {js(f'{_G} * 100')}))::DOUBLE, '+' || {js(f'{_G} * 100')} || '%' FROM pairs
  UNION ALL SELECT project_id, 3, CASE WHEN {_MOVED} <= 1 THEN 'Slow progress' ELSE 'Expenditure / progress gap' END,
     least(30.0::DOUBLE, greatest(10.0::DOUBLE, {js(f'{_SHARE} * 100')} - physical_progress)),
     CASE WHEN {_MOVED} <= 1 THEN {_num(_MOVED)} || ' pts MoM' ELSE 'Spend ' || {js(f'{_SHARE} * 100')} || '% · Progress ' || {_num('physical_progress')} || '%' END FROM pairs)"""


@query(
    "driver_contributions",
    with_(
        "SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY value DESC, p) AS INTEGER) AS rank, label, round(value, 2) AS value, magnitude FROM drivers",
        *_BASE, _DRIVERS,
    ),
)
def driver_contributions(spark, folder):
    return intelligence.driver_contributions(supplier_snapshots(spark, folder))


_PROJECT_EVENTS = f"""e AS (
  SELECT project_id, month, name, 'e1' AS event, CASE WHEN risk_level = 'Critical' THEN 'Risk elevated to Critical' ELSE 'Risk elevated' END AS title,
    'Moved from ' || previous_risk_level || ' to ' || risk_level || ' (' || previous_risk_score || ' → ' || risk_score || ').' AS detail
    FROM deltas WHERE risk_level <> previous_risk_level OR score_delta >= 6
  UNION ALL SELECT project_id, month, name, 'e2', 'Schedule revised', 'Target completion moved to ' || revised_completion || '.' FROM deltas WHERE end_moved OR delay_delta > 0
  UNION ALL SELECT project_id, month, name, 'e3', 'Cost revision recorded', 'Revised cost increased to ₹' || {_num('revised_cost')} || ' Cr.' FROM deltas WHERE cost_delta > 0
  UNION ALL SELECT project_id, month, name, 'e4', 'Progress slowdown detected', 'Monthly physical progress below recovery plan.' FROM deltas WHERE progress_delta < 3)
SELECT project_id, month, event, title, detail FROM e
UNION ALL SELECT project_id, month, 'e1', 'Monthly risk reassessment', 'Updated risk position for ' || name || '.' FROM deltas WHERE project_id NOT IN (SELECT project_id FROM e)"""


@query("project_events", with_(f", {_PROJECT_EVENTS}", *_BASE2))
def project_events(spark, folder):
    return intelligence.project_events(supplier_snapshots(spark, folder))


@query(
    "attention_checklist",
    with_(
        f""", c AS (
          SELECT project_id, 1 AS k, 'a1' AS item, 'Review primary signal' AS title, primary_signal AS detail FROM latest
          UNION ALL SELECT project_id, 2, 'a2', 'Review schedule recovery plan', 'Validate contractor recovery milestones before next review.' FROM latest WHERE {_SCHEDULE_SIGNAL} <> 'on_plan'
          UNION ALL SELECT project_id, 3, 'a3', 'Investigate cost escalation', 'Compare revised quantities against approved estimate.' FROM latest WHERE {_COST_SIGNAL} <> 'within'
          UNION ALL SELECT project_id, 4, 'a4', 'Monitor next reporting period', 'Watch for further deterioration before escalation.' FROM latest)
        SELECT project_id, position, item, title, detail FROM (SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY k) AS INTEGER) AS position FROM c) WHERE position <= 3""",
        *_BASE,
    ),
)
def attention_checklist(spark, folder):
    return intelligence.attention_checklist(_latest(spark, folder))


@query(
    "outlook",
    with_(
        """SELECT project_id, CASE WHEN risk_change < -2 THEN 'Improving' WHEN risk_change > 2 THEN 'Deteriorating' ELSE 'Stable' END AS outlook,
          least(progress + 8, 95.0::DOUBLE) AS target_progress, primary_signal,
          'Risk change ' || CASE WHEN risk_change > 0 THEN '+' ELSE '' END || risk_change || ' pts' AS change_signal FROM latest""",
        *_BASE,
    ),
)
def outlook(spark, folder):
    return intelligence.outlook(supplier_snapshots(spark, folder))


_SCOPE = "Scope: All · ASIA · All · All"


@query(
    "scoped_report_lines",
    with_(
        f""", r AS (SELECT * FROM latest WHERE ministry = 'ASIA' AND risk IN ('High', 'Critical', 'Medium', 'Low') AND risk IN ('High', 'Critical'))
        SELECT 0 AS section, CAST(i AS VARCHAR) AS sort_key, line FROM (SELECT unnest(range(5)) AS i,
            unnest(['High-Risk Projects', 'Period: 2026-11', '{_SCOPE}', 'Records: ' || (SELECT count(*) FROM r), '']) AS line)
        UNION ALL SELECT 1, code, concat_ws(chr(9), code, name, state, risk, risk_score::VARCHAR, primary_signal) FROM r""",
        *_BASE,
    ),
)
def scoped_report_lines(spark, folder):
    return portfolio.report_lines(
        _latest(spark, folder), "High-Risk Projects", "2026-11", high_risk_only=True, ministry="ASIA"
    )
