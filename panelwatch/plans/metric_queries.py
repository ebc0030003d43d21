"""Metrics, calibration, slices, drift, model comparison and policies.

All run on the prediction table whose scores are arithmetic hashes, so each has an exact
SQL counterpart.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibration, compare, drift, metrics, policy, slices
from ..operators.digests import LEAF
from ..operators.features import build_features
from ..operators.modelling import ALL_FEATURES, DRIFTING, STABLE, conditional_review as review_conditional, split_features
from ..operators.splits import with_disjoint_split
from ..session import written
from .inputs import BASELINE, CHALLENGER, DISJOINT, TARGET as Y, baseline_predictions, predictions, stored_predictions, supervised, supplier_panel
from .registry import query
from .sqltext import FEATURES, LABELS, PRED, SUPERVISED, SUPPLIER, ratio, ratio0, rnd, with_

P = "probability"


#: Features that slices are made of.
_SLICE_COLUMNS = ("sector", "state", "ministry", "agency", "progress_current", "project_age_months", "expenditure_to_original_cost")


def _test_part(rows):
    """Rows of the entities and months that an entity-disjoint evaluation tests on."""
    return with_disjoint_split(rows, DISJOINT).where(F.col("part") == "test")


def _confusion(threshold: float, model: str = "") -> str:
    t = f"CAST({threshold!r} AS DOUBLE)"
    return (
        f"count(*) FILTER (WHERE {Y} = 0 AND {P} < {t}{model}) AS tn, count(*) FILTER (WHERE {Y} = 0 AND {P} >= {t}{model}) AS fp, "
        f"count(*) FILTER (WHERE {Y} = 1 AND {P} < {t}{model}) AS fn, count(*) FILTER (WHERE {Y} = 1 AND {P} >= {t}{model}) AS tp"
    )


_RATES = {
    "precision": ratio0("tp", "tp + fp"),
    "recall": ratio0("tp", "tp + fn"),
    "f1": ratio0("2 * tp", "2 * tp + fp + fn"),
    "false_positive_rate": ratio("fp", "fp + tn"),
}


def _thresholds(by: str, values, source: str = "predictions") -> str:
    keys = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return " UNION ALL ".join(
        f"SELECT {keys}CAST({t!r} AS DOUBLE) AS threshold, {_confusion(t)} FROM {source}{group}" for t in values
    )


@query(
    "fixed_threshold_metrics",
    with_(
        f", t AS ({_thresholds('model, fold', metrics.FIXED_THRESHOLDS)}) SELECT model, fold, threshold, tn, fp, fn, tp, "
        + ", ".join(f"round({e}, 6) AS {n}" for n, e in _RATES.items()) + " FROM t",
        *PRED,
    ),
)
def fixed_threshold_metrics(spark, folder):
    return metrics.rounded(metrics.at_thresholds(predictions(spark, folder), Y, P, ["model", "fold"]))


@query(
    "threshold_table",
    with_(
        f", t AS ({_thresholds('model', metrics.REVIEW_THRESHOLDS)}) SELECT model, threshold, "
        + ", ".join(f"round({e}, 6) AS {n}" for n, e in _RATES.items()) + " FROM t",
        *PRED,
    ),
)
def threshold_table(spark, folder):
    return metrics.threshold_table(predictions(spark, folder), Y, P, ["model"])


@query(
    "threshold_choice",
    with_(
        f", t AS ({_thresholds('model', metrics.GRID)}), r AS (SELECT model, threshold, "
        + ", ".join(f"{e} AS {n}" for n, e in _RATES.items())
        + """ FROM t), ranked AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY (recall >= 0.6) DESC, f1 DESC, recall DESC,
            precision DESC, threshold) AS k FROM r)
        SELECT model, round(threshold, 2) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1
        FROM ranked WHERE k = 1""",
        *PRED,
    ),
)
def threshold_choice(spark, folder):
    return metrics.choose_threshold(predictions(spark, folder), Y, P, ["model"])


def _ranking(by: str, source: str) -> str:
    """ROC-AUC by rank sums and average precision by a cumulative window."""
    over = f"PARTITION BY {by} " if by else ""
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""(
      SELECT {keys}CAST(sum(n) AS BIGINT) AS observations, CAST(sum(pos) AS BIGINT) AS events,
        CASE WHEN sum(pos) > 0 AND sum(n - pos) > 0
             THEN sum((n - pos) * above_pos + (n - pos) * pos / 2.0::DOUBLE) / (sum(pos) * sum(n - pos)) END AS roc_auc,
        CASE WHEN sum(pos) > 0 AND sum(n - pos) > 0
             THEN sum(pos * (above_pos + pos)::DOUBLE / (above_n + n)) / sum(pos) END AS pr_auc
      FROM (SELECT *, coalesce(sum(pos) OVER w, 0) AS above_pos, coalesce(sum(n) OVER w, 0) AS above_n
            FROM (SELECT {keys}{P}, count(*) AS n, sum({Y}) AS pos FROM {source} GROUP BY {keys}{P})
            WINDOW w AS ({over}ORDER BY {P} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      {group})"""


def _ranking_columns() -> str:
    return """observations, events, round(events::DOUBLE / observations, 6) AS event_rate, round(roc_auc, 6) AS roc_auc,
      round(pr_auc, 6) AS pr_auc, round(pr_auc / (events::DOUBLE / observations), 6) AS pr_auc_lift,
      CASE WHEN roc_auc IS NOT NULL THEN 'DEFINED' ELSE 'N/A_SINGLE_CLASS' END AS metric_status"""


@query("ranking_metrics", with_(f"SELECT model, fold, {_ranking_columns()} FROM {_ranking('model, fold', 'predictions')}", *PRED))
def ranking_metrics(spark, folder):
    return metrics.ranking_metrics(predictions(spark, folder), Y, P, ["model", "fold"])


@query("ranking_metrics_pooled", with_(f"SELECT {_ranking_columns()} FROM {_ranking('', 'predictions')}", *PRED))
def ranking_metrics_pooled(spark, folder):
    return metrics.ranking_metrics(metrics.validated(predictions(spark, folder), Y, P), Y, P, [])


_REPORT_RATES = ", ".join(
    f"round({e.replace('tp', f'tp_at_{s}').replace('fp', f'fp_at_{s}').replace('fn', f'fn_at_{s}').replace('tn', f'tn_at_{s}')}, 6) AS {n}_at_{s}"
    for s in (40, 50) for n, e in _RATES.items()
)


def _confusion_at(s: int) -> str:
    text = _confusion(s / 100)
    for c in ("tn", "fp", "fn", "tp"):
        text = text.replace(f"AS {c}", f"AS {c}_at_{s}")
    return text


def _report(by: str, source: str = "predictions") -> str:
    return f"""SELECT {by}, {_ranking_columns()}, brier, mean_prediction,
        tn_at_40, fp_at_40, fn_at_40, tp_at_40, tn_at_50, fp_at_50, fn_at_50, tp_at_50, {_REPORT_RATES}
      FROM {_ranking(by, source)} JOIN (
        SELECT {by}, round(avg(({P} - {Y}) * ({P} - {Y})), 6) AS brier, round(avg({P}), 6) AS mean_prediction,
          {_confusion_at(40)}, {_confusion_at(50)} FROM {source} GROUP BY {by}) USING ({by})"""


@query("classification_report", with_(_report("model, fold"), *PRED))
def classification_report(spark, folder):
    return metrics.classification_report(predictions(spark, folder), Y, P, ["model", "fold"])


_VIEWS = {"March 2025": ["2025-03"], "April 2025": ["2025-04"], "March-April": ["2025-03", "2025-04"]}


@query(
    "month_sensitivity",
    with_(
        ", viewed AS ("
        + " UNION ALL ".join(
            f"SELECT '{v}' AS view, * FROM predictions WHERE model = 'BASELINE' AND prediction_month IN ({', '.join(repr(m) for m in ms)})"
            for v, ms in _VIEWS.items()
        )
        + f") {_report('view', 'viewed')}",
        *PRED,
    ),
)
def month_sensitivity(spark, folder):
    return metrics.month_views(baseline_predictions(spark, folder), Y, P, _VIEWS)


_BIN = "CASE " + " ".join(f"WHEN {P} <= CAST({e!r} AS DOUBLE) THEN {i}" for i, e in enumerate(calibration.BIN_EDGES[1:], 1)) + " END"
_BINS = f"""bins AS (SELECT model, b.i AS bin_index, count(p.bin) AS observations, avg({P}) AS mean_score, avg({Y}) AS rate
  FROM (SELECT DISTINCT model FROM predictions) m CROSS JOIN (SELECT unnest(range(1, 11)) AS i) b
  LEFT JOIN (SELECT *, {_BIN} AS bin FROM predictions) p USING (model) GROUP BY 1, 2)""".replace(
    "LEFT JOIN (SELECT *", "LEFT JOIN (SELECT *"
).replace("p USING (model)", "p ON p.model = m.model AND p.bin = b.i").replace("SELECT model, b.i", "SELECT m.model, b.i")


@query(
    "reliability_bins",
    with_(
        f"""SELECT model, CAST(bin_index AS INTEGER) AS bin_index, observations, round(mean_score, 6) AS mean_predicted_score,
          round(rate, 6) AS observed_event_rate, {rnd('mean_score - rate')} AS calibration_gap,
          round(abs(mean_score - rate), 6) AS absolute_calibration_gap,
          CASE WHEN observations > 0 THEN 'SUPPORTED' ELSE 'EMPTY' END AS bin_status FROM bins""",
        *PRED, _BINS,
    ).replace(f"{rnd('mean_score - rate')} AS", f"(CASE WHEN mean_score IS NOT NULL THEN {rnd('mean_score - rate')} END) AS"),
)
def reliability_bins(spark, folder):
    table = calibration.reliability_bins(predictions(spark, folder), Y, P, ["model"])
    return metrics.rounded(table.drop("score_bin", "lower_bound", "upper_bound"))


@query(
    "five_bin_reliability",
    with_(
        f"""SELECT model, CAST(b AS INTEGER) AS bin_index, count(*) AS observations, round(avg({P}), 6) AS mean_predicted_score, round(avg({Y}), 6) AS observed_event_rate
        FROM (SELECT *, CASE WHEN {P} <= 0.2::DOUBLE THEN 1 WHEN {P} <= 0.4::DOUBLE THEN 2 WHEN {P} <= 0.6::DOUBLE THEN 3 WHEN {P} <= 0.8::DOUBLE THEN 4 ELSE 5 END AS b
              FROM predictions) GROUP BY 1, 2""",
        *PRED,
    ),
)
def five_bin_reliability(spark, folder):
    return calibration.five_bin_reliability(predictions(spark, folder), Y, P, ["model"])


_ECE = """ece AS (SELECT model, sum(observations * coalesce(abs(mean_score - rate), 0)) / sum(observations) AS ece FROM bins GROUP BY 1)"""


@query("expected_calibration_error", with_("SELECT model, round(ece, 6) AS ece_10_equal_width FROM ece", *PRED, _BINS, _ECE))
def expected_calibration_error(spark, folder):
    return metrics.rounded(calibration.expected_calibration_error(predictions(spark, folder), Y, P, ["model"]))


def _brier(by: str) -> str:
    return f"""SELECT {by}, avg(({P} - {Y}) * ({P} - {Y})) AS b, avg({Y}) * (1 - avg({Y})) AS pb FROM predictions GROUP BY {by}"""


@query(
    "brier_metrics",
    with_(
        f"SELECT model, fold, round(b, 6) AS brier_score, round(pb, 6) AS prevalence_only_brier, {rnd('1 - b / pb')} AS brier_skill FROM ({_brier('model, fold')}) WHERE pb > 0 "
        f"UNION ALL SELECT model, fold, round(b, 6), round(pb, 6), NULL FROM ({_brier('model, fold')}) WHERE pb = 0",
        *PRED,
    ),
)
def brier_metrics(spark, folder):
    return metrics.rounded(calibration.brier_metrics(predictions(spark, folder), Y, P, ["model", "fold"]))


def _distribution(by: str) -> str:
    quantiles = ", ".join(
        f"round(quantile_cont({P}, {q}), 6) AS score_q{round(q * 100):02d}" for q in calibration.QUANTILES
    )
    return f"""SELECT {by}, count(*) AS observations, CAST(sum({Y}) AS BIGINT) AS events, round(avg({Y}), 6) AS event_rate,
      min({P}) AS minimum_score, max({P}) AS maximum_score, round(avg({P}), 6) AS mean_predicted_score,
      round(stddev_pop({P}), 6) AS score_standard_deviation, round(quantile_cont({P}, 0.5), 6) AS median_score, {quantiles}
    FROM predictions GROUP BY {by}"""


@query("score_distribution", with_(_distribution("model"), *PRED))
def score_distribution(spark, folder):
    return metrics.rounded(calibration.score_distribution(predictions(spark, folder), Y, P, ["model"]))


_DISJOINT_SQL = """, buckets AS (SELECT *, CASE WHEN s5 % 2 = parity THEN s5 ELSE s5 + 5 END AS bucket FROM (
     SELECT *, list_sum(list_transform(string_split(sha256(identity_key), ''), lambda c: strpos('0123456789abcdef', c) - 1)) % 5 AS s5,
        (strpos('0123456789abcdef', right(sha256(identity_key), 1)) - 1) % 2 AS parity FROM predictions)),
   held AS (SELECT * FROM buckets WHERE bucket BETWEEN 8 AND 9 AND prediction_month >= '2024-07')"""


def _summary_sql(by: str, where: str, lead: str = "") -> str:
    """Calibration summary of some of the predictions, per group."""
    source = "chosen"
    bins = _BINS.replace("model", by).replace("FROM predictions", f"FROM {source}")
    ece = _ECE.replace("model", by)
    return with_(
        f"""{lead}, {source} AS ({where}), {bins}, {ece}
        SELECT d.*, round(b, 6) AS brier_score, round(pb, 6) AS prevalence_only_brier, {rnd('1 - b / pb')} AS brier_skill,
          round(ece, 6) AS ece_10_equal_width, {rnd('mp - er')} AS mean_minus_event_rate
        FROM ({_distribution(by)}) d JOIN ({_brier(by)}) USING ({by}) JOIN ece USING ({by})
        JOIN (SELECT {by}, avg({P}) AS mp, avg({Y}) AS er FROM predictions GROUP BY 1) USING ({by})""".replace("FROM predictions", f"FROM {source}"),
        *PRED,
    ).replace("__ALL__", "predictions")


@query(
    "calibration_summary",
    with_(
        f"""SELECT d.*, round(b, 6) AS brier_score, round(pb, 6) AS prevalence_only_brier, {rnd('1 - b / pb')} AS brier_skill,
           round(ece, 6) AS ece_10_equal_width, {rnd('mp - er')} AS mean_minus_event_rate
        FROM ({_distribution('model')}) d JOIN ({_brier('model')}) USING (model) JOIN ece USING (model)
        JOIN (SELECT model, avg({P}) AS mp, avg({Y}) AS er FROM predictions GROUP BY 1) USING (model)""",
        *PRED, _BINS, _ECE,
    ),
)
def calibration_summary(spark, folder):
    return metrics.rounded(
        calibration.calibration_summary(stored_predictions(spark, folder), Y, P, ["model"], diagnostic=False)
    )


@query("calibration_intercept_slope")
def calibration_intercept_slope(spark, folder):
    return metrics.rounded(calibration.calibration_intercept_slope(stored_predictions(spark, folder), Y, P, ["model"]))


@query("fold_calibration", _summary_sql("fold", f"SELECT * FROM __ALL__ WHERE model = '{BASELINE}'"))
def fold_calibration(spark, folder):
    rows = stored_predictions(spark, folder).where(F.col("model") == BASELINE)
    return metrics.rounded(calibration.calibration_summary(rows, Y, P, ["fold"], diagnostic=False))


_FOLD_METRICS = f"""fold_metrics AS (SELECT fold, round(avg({Y}), 6) AS event_rate, round(avg({P}), 6) AS mean_predicted_score,
   round(avg(({P} - {Y}) * ({P} - {Y})), 6) AS brier_score FROM predictions WHERE model = 'BASELINE' GROUP BY 1)"""


@query(
    "fold_metric_summary",
    with_(
        " UNION ALL ".join(
            f"""SELECT '{m}' AS metric, count({m}) AS supported_folds, round(avg({m}), 6) AS mean, round(stddev_pop({m}), 6) AS standard_deviation,
            min({m}) AS minimum, max({m}) AS maximum FROM fold_metrics"""
            for m in ("event_rate", "mean_predicted_score", "brier_score")
        ),
        *PRED, _FOLD_METRICS,
    ),
)
def fold_metric_summary(spark, folder):
    folds = baseline_predictions(spark, folder).groupBy("fold").agg(
        F.round(F.avg(Y), 6).alias("event_rate"), F.round(F.avg(P), 6).alias("mean_predicted_score"),
        F.round(F.avg((F.col(P) - F.col(Y)) * (F.col(P) - F.col(Y))), 6).alias("brier_score"),
    )
    return metrics.rounded(calibration.metric_summary(folds))


def _in_slice(field: str, value: str) -> str:
    return f"{field} = '{value}'"


_NAMED = " UNION ALL ".join(
    f"SELECT '{label}' AS important_slice, '{f}' AS slice_feature, '{v}' AS slice_value, p.* FROM predictions p WHERE {_in_slice('p.' + f, v)}"
    for label, (f, v) in slices.IMPORTANT_SLICES.items()
)
_WANTED = "wanted(important_slice, slice_feature, slice_value) AS (VALUES " + ", ".join(
    f"('{label}', '{f}', '{v}')" for label, (f, v) in slices.IMPORTANT_SLICES.items()
) + ")"
_SLICED = f"""named AS ({_NAMED}), {_WANTED}"""
_ADEQUATE = "(n >= 50 AND e >= 25 AND pos >= 20 AND n - pos >= 20)"


@query(
    "slice_calibration",
    with_(
        f""", s AS (SELECT w.*, count(identity_key) AS n, count(DISTINCT identity_key) AS e, count(*) FILTER (WHERE {Y} = 1) AS pos,
             count(*) FILTER (WHERE {Y} = 0) AS neg, avg({Y}) AS er, avg({P}) AS mp, avg(({P} - {Y}) * ({P} - {Y})) AS b
           FROM wanted w LEFT JOIN (SELECT * FROM named WHERE model = 'BASELINE') USING (important_slice, slice_feature, slice_value) GROUP BY ALL),
        sb AS (SELECT important_slice, sum(k * abs(mp - er)) / sum(k) AS ece FROM (
             SELECT important_slice, {_BIN} AS bin, count(*) AS k, avg({P}) AS mp, avg({Y}) AS er FROM named WHERE model = 'BASELINE' GROUP BY 1, 2) GROUP BY 1)
        SELECT s.important_slice, slice_feature, slice_value, n AS observations, e AS projects, pos AS events, neg AS non_events,
          CASE WHEN {_ADEQUATE} THEN 'ADEQUATE' ELSE 'INSUFFICIENT_SAMPLE' END AS sample_status,
          CASE WHEN {_ADEQUATE} THEN '' ELSE 'SUPPORT_RULE_NOT_MET' END AS n_a_reason,
          CASE WHEN {_ADEQUATE} THEN round(er, 6) END AS event_rate, CASE WHEN {_ADEQUATE} THEN round(mp, 6) END AS mean_predicted_score,
          CASE WHEN {_ADEQUATE} THEN round(b, 6) END AS brier_score, CASE WHEN {_ADEQUATE} THEN round(er * (1 - er), 6) END AS prevalence_only_brier,
          CASE WHEN {_ADEQUATE} THEN {rnd('1 - b / (er * (1 - er))')} END AS brier_skill, CASE WHEN {_ADEQUATE} THEN round(ece, 6) END AS ece_10_equal_width,
          CASE WHEN {_ADEQUATE} THEN {rnd('mp - er')} END AS mean_minus_event_rate
        FROM s LEFT JOIN sb USING (important_slice)""",
        *PRED, _SLICED,
    ),
)
def slice_calibration(spark, folder):
    return metrics.rounded(calibration.slice_calibration(stored_predictions(spark, folder).where(F.col("model") == BASELINE), Y, P))


@query("entity_disjoint_calibration", _summary_sql("model", f"SELECT * FROM held WHERE model = '{BASELINE}'", _DISJOINT_SQL.replace("FROM predictions", "FROM __ALL__")))
def entity_disjoint_calibration(spark, folder):
    rows = _test_part(baseline_predictions(spark, folder)).select("model", Y, P)
    tagged = written(rows, "predictions")
    return metrics.rounded(calibration.calibration_summary(tagged, Y, P, ["model"], diagnostic=False))


@query("calibration_verdict")
def calibration_verdict(spark, folder):
    rows = stored_predictions(spark, folder, BASELINE, _SLICE_COLUMNS)
    disjoint = _test_part(rows)
    return calibration.calibration_verdict(
        calibration.calibration_summary(rows, Y, P, []),
        calibration.calibration_summary(rows, Y, P, ["fold"], diagnostic=False),
        calibration.calibration_summary(disjoint, Y, P, [], diagnostic=False),
        calibration.reliability_bins(rows, Y, P, []),
        calibration.slice_calibration(rows, Y, P),
    )


# --- slices ----------------------------------------------------------------------------

def _band(value: str, spec) -> str:
    bounds, labels = spec
    whens = " ".join(f"WHEN {value} <= CAST({b} AS DOUBLE) THEN '{x}'" for b, x in zip(bounds, labels))
    return f"CASE {whens} WHEN {value} IS NOT NULL THEN '{labels[-1]}' END"


_BANDED = f"""banded AS (SELECT *, {_band('progress_current', slices.PROGRESS_BAND)} AS progress_range,
  CASE WHEN sector = 'Roads & Highways' THEN 'Roads & Highways' ELSE 'Other sectors' END AS roads_group,
  {_band('project_age_months', slices.AGE_BAND)} AS age_range,
  {_band('expenditure_to_original_cost', slices.SPEND_RATIO_BAND)} AS cost_ratio_range FROM predictions)"""


def _long(fields, source: str = "banded") -> str:
    return f"""long AS (SELECT unnest([{', '.join(f"'{f}'" for f in fields)}]) AS slice_feature,
      unnest([{', '.join(f"coalesce({f}, 'nan')" for f in fields)}]) AS slice_value, * FROM {source})"""


@query(
    "slice_bands",
    with_(
        "SELECT progress_range, roads_group, age_range, cost_ratio_range, count(*) AS rows FROM banded GROUP BY ALL",
        *PRED, _BANDED,
    ),
)
def slice_bands(spark, folder):
    return slices.with_slice_fields(predictions(spark, folder)).groupBy(
        "progress_range", "roads_group", "age_range", "cost_ratio_range"
    ).agg(F.count("*").alias("rows"))


@query(
    "expenditure_bands",
    with_(
        f"SELECT {_band('expenditure_current / 1000', slices.EXPENDITURE_BAND)} AS band, count(*) AS rows FROM predictions GROUP BY 1", *PRED
    ),
)
def expenditure_bands(spark, folder):
    band = slices.expenditure_band(F.col("expenditure_current") / 1000)
    return predictions(spark, folder).groupBy(band.alias("band")).agg(F.count("*").alias("rows"))


@query(
    "robustness_slices",
    with_(
        f"""SELECT slice_feature, slice_value, count(*) AS rows, count(DISTINCT identity_key) AS unique_projects,
          tp + fn AS positive_rows, tn + fp AS negative_rows, tp AS true_positives, tn AS true_negatives, fp AS false_positives, fn AS false_negatives,
          fp + fn AS error_count, pe AS projects_with_error, round({ratio('fp', 'tn + fp')}, 6) AS false_positive_rate,
          round({ratio('fn', 'tp + fn')}, 6) AS false_negative_rate, round((fp + fn)::DOUBLE / count(*), 6) AS error_rate,
          round(pe::DOUBLE / count(DISTINCT identity_key), 6) AS project_error_exposure,
          CASE WHEN count(*) >= 50 AND count(DISTINCT identity_key) >= 25 AND tp + fn >= 30 AND tn + fp >= 30 THEN 'ADEQUATE' ELSE 'INSUFFICIENT_SAMPLE' END AS sample_status
        FROM (SELECT *, count(*) FILTER (WHERE {Y} = 1 AND {P} >= 0.35) OVER w AS tp, count(*) FILTER (WHERE {Y} = 1 AND {P} < 0.35) OVER w AS fn,
              count(*) FILTER (WHERE {Y} = 0 AND {P} >= 0.35) OVER w AS fp, count(*) FILTER (WHERE {Y} = 0 AND {P} < 0.35) OVER w AS tn,
              count(DISTINCT CASE WHEN ({P} >= 0.35) <> ({Y} = 1) THEN identity_key END) OVER w AS pe
              FROM long WINDOW w AS (PARTITION BY slice_feature, slice_value)) GROUP BY ALL""".replace(
            "GROUP BY ALL", "GROUP BY slice_feature, slice_value, tp, fn, fp, tn, pe"
        ).replace("0.35", "CAST(0.35 AS DOUBLE)"),
        *PRED, _BANDED.replace("FROM predictions", "FROM predictions WHERE model = 'BASELINE'"), _long(slices.ROBUSTNESS_FIELDS),
    ),
)
def robustness_slices(spark, folder):
    return slices.robustness_slices(baseline_predictions(spark, folder), Y, P, 0.35)


@query(
    "audit_slices",
    with_(
        f""", c AS (SELECT slice_feature, slice_value, count(*) AS n, count(DISTINCT identity_key) AS e, {_confusion(0.40)}, avg({Y}) AS er
              FROM long GROUP BY 1, 2)
        SELECT slice_feature, slice_value, n AS rows, e AS projects, round(er, 6) AS event_rate, round(roc_auc, 6) AS roc_auc,
          round({ratio0('tp', 'tp + fp')}, 6) AS precision_at_40, round({ratio0('tp', 'tp + fn')}, 6) AS recall_at_40,
          fp AS false_positives, fn AS false_negatives, round((fp + fn)::DOUBLE / n, 6) AS error_rate,
          CASE WHEN n >= 50 AND e >= 25 AND tp + fn >= 20 AND n - tp - fn >= 20 THEN 'ADEQUATE' ELSE 'INSUFFICIENT_SAMPLE' END AS sample_status
        FROM c JOIN {_ranking('slice_feature, slice_value', 'long')} USING (slice_feature, slice_value)""",
        *PRED, _BANDED.replace("FROM predictions", "FROM predictions WHERE model = 'BASELINE'"), _long(slices.AUDIT_FIELDS),
    ),
)
def audit_slices(spark, folder):
    return slices.audit_slices(baseline_predictions(spark, folder), Y, P)


_ERRORS = f"""wrong AS (SELECT *, CASE WHEN {Y} = 0 THEN 'FALSE_POSITIVE' ELSE 'FALSE_NEGATIVE' END AS error_type,
    CASE WHEN {Y} = 0 THEN {P} ELSE 1 - {P} END AS confidence FROM predictions
  WHERE ({Y} = 0 AND {P} >= 0.4::DOUBLE) OR ({Y} = 1 AND {P} < 0.4::DOUBLE)),
top_errors AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, error_type ORDER BY confidence DESC, prediction_month, identity_key) AS rank
  FROM wrong) WHERE rank <= 10)"""


@query(
    "confident_errors",
    with_(
        "SELECT model, error_type, CAST(rank AS INTEGER) AS rank, identity_key, prediction_month, probability, round(confidence, 6) AS confidence_mistake, sector FROM top_errors",
        *PRED, _ERRORS,
    ),
)
def confident_errors(spark, folder):
    return slices.confident_errors(predictions(spark, folder), Y, P, ["model"]).select(
        "model", "error_type", "rank", "identity_key", "prediction_month", "probability",
        F.round("confidence_mistake", 6).alias("confidence_mistake"), "sector",
    )


_ERROR_FIELDS = ("sector", "state", "age_range", "progress_range", "expenditure_range")


@query(
    "largest_error_groups",
    with_(
        f""", w AS (SELECT *, {_band('expenditure_current', slices.EXPENDITURE_BAND)} AS expenditure_range,
              CASE WHEN {Y} = 0 THEN 'false_positive' ELSE 'false_negative' END AS error_type FROM banded
              WHERE ({Y} = 0 AND {P} >= 0.4::DOUBLE) OR ({Y} = 1 AND {P} < 0.4::DOUBLE)),
            l AS (SELECT unnest([{', '.join(f"'{f}'" for f in _ERROR_FIELDS)}]) AS field, unnest([{', '.join(_ERROR_FIELDS)}]) AS value, error_type FROM w),
            g AS (SELECT field, value, error_type, count(*) AS errors FROM l WHERE value IS NOT NULL GROUP BY 1, 2, 3)
        SELECT field, value, error_type, errors, CAST(rank AS INTEGER) AS rank FROM (
          SELECT *, row_number() OVER (PARTITION BY field ORDER BY errors DESC, value, error_type) AS rank FROM g) WHERE rank <= 5""",
        *PRED, _BANDED,
    ),
)
def largest_error_groups(spark, folder):
    return slices.largest_error_groups(predictions(spark, folder), Y, P, 0.40)


@query(
    "pooled_error_types",
    with_(
        f", t AS ({_thresholds('model', metrics.FIXED_THRESHOLDS)}) SELECT model, threshold, tn + fp + fn + tp AS rows, tn AS true_negatives, fp AS false_positives, fn AS false_negatives, tp AS true_positives FROM t",
        *PRED,
    ),
)
def pooled_error_types(spark, folder):
    return slices.error_totals(predictions(spark, folder), Y, P)


@query(
    "confidence_summary",
    with_(
        """SELECT model, error_type, total AS total_errors_at_40, coalesce(k, 0) AS top10_count, m AS top10_mean_confidence_mistake,
             lo AS top10_min_confidence_mistake, hi AS top10_max_confidence_mistake
        FROM (SELECT model, 'FALSE_POSITIVE' AS error_type, count(*) FILTER (WHERE future_schedule_later_3m = 0 AND probability >= 0.4::DOUBLE) AS total FROM predictions GROUP BY 1
              UNION ALL SELECT model, 'FALSE_NEGATIVE', count(*) FILTER (WHERE future_schedule_later_3m = 1 AND probability < 0.4::DOUBLE) FROM predictions GROUP BY 1)
        LEFT JOIN (SELECT model, error_type, count(*) AS k, round(avg(confidence), 6) AS m, round(min(confidence), 6) AS lo, round(max(confidence), 6) AS hi
                   FROM top_errors GROUP BY 1, 2) USING (model, error_type)""",
        *PRED, _ERRORS,
    ),
)
def confidence_summary(spark, folder):
    return slices.confidence_summary(predictions(spark, folder), Y, P)


def _side(prefix: str, model: str, names) -> str:
    return ", ".join(f"max(CASE WHEN model = '{model}' THEN {n} END) AS {prefix}_{n}" for n in names)


_RATE_NAMES = ("precision_at_40", "recall_at_40", "f1_at_40", "precision_at_50", "recall_at_50", "f1_at_50")


def _model_table(keys: str, source: str) -> str:
    return f"""(SELECT r.*, c.* EXCLUDE (model, {keys}), {_REPORT_RATES} FROM {_ranking('model, ' + keys, source)} r JOIN (
        SELECT model, {keys}, count(DISTINCT identity_key) AS projects, {_confusion_at(40)}, {_confusion_at(50)} FROM {source} GROUP BY ALL) c
        USING (model, {keys}))"""


def _paired(keys: str, source: str, names) -> str:
    return f"""SELECT {keys}, max(CASE WHEN model = '{BASELINE}' THEN observations END) AS observations,
        max(CASE WHEN model = '{BASELINE}' THEN projects END) AS projects, max(CASE WHEN model = '{BASELINE}' THEN events END) AS events,
        round(max(CASE WHEN model = '{BASELINE}' THEN events END)::DOUBLE / max(CASE WHEN model = '{BASELINE}' THEN observations END), 6) AS event_rate,
        {_side('baseline', BASELINE, names)}, {_side('challenger', CHALLENGER, names)}
      FROM (SELECT * REPLACE (round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc) FROM {_model_table(keys, source)}) GROUP BY {keys}"""


def _direction(value: str) -> str:
    return f"CASE WHEN {value} > 0.005::DOUBLE THEN '{CHALLENGER}' WHEN {value} < -0.005::DOUBLE THEN '{BASELINE}' ELSE 'NEGLIGIBLE' END"


_DELTAS = f"""{rnd('challenger_roc_auc - baseline_roc_auc')} AS delta_roc_auc, {rnd('challenger_pr_auc - baseline_pr_auc')} AS delta_pr_auc"""
_COMPARED = f"""paired AS ({_paired('slice_feature, slice_value', 'long', slices.PAIRED_METRICS)}),
compared AS (SELECT *, {_direction('delta_pr_auc')} AS pr_direction, 'ADEQUATE' AS sample_status FROM (SELECT *, {_DELTAS} FROM paired
  WHERE observations >= 50 AND projects >= 25 AND events >= 20 AND observations - events >= 20))"""
_CMP = (*PRED, _BANDED, _long(slices.AUDIT_FIELDS), _COMPARED)


def _compared(spark, folder):
    return slices.slice_comparison(predictions(spark, folder), Y, P, BASELINE, CHALLENGER)


@query("slice_comparison", with_("SELECT * FROM compared", *_CMP))
def slice_comparison(spark, folder):
    return _compared(spark, folder)


_KEYED = f"SELECT identity_key, prediction_month, {Y} FROM"
_UNMATCHED = """(SELECT count(*) FROM ({a} EXCEPT ALL {b})) + (SELECT count(*) FROM ({b} EXCEPT ALL {a}))"""
_BOTH = {
    "same rows": (f"{_KEYED} predictions WHERE model = 'BASELINE'", f"{_KEYED} predictions WHERE model = 'CHALLENGER'"),
    "unequal rows": (
        f"{_KEYED} predictions WHERE model = 'BASELINE' AND identity_key NOT LIKE '%7'",
        f"{_KEYED} predictions WHERE model = 'CHALLENGER' AND (fold <> 3 OR identity_key NOT LIKE '%5') UNION ALL "
        f"{_KEYED} predictions WHERE model = 'CHALLENGER' AND identity_key LIKE '%11'",
    ),
}


@query(
    "models_share_rows",
    with_(
        " UNION ALL ".join(
            f"SELECT '{case}' AS inputs, " + _UNMATCHED.format(a=f"({a})", b=f"({b})") + " AS unmatched_rows" for case, (a, b) in _BOTH.items()
        ),
        *PRED,
    ),
)
def models_share_rows(spark, folder):
    """The guard on models that scored the same rows, and on models with missing and repeated rows."""
    rows = stored_predictions(spark, folder)
    one, other, key = F.col("model") == BASELINE, F.col("model") == CHALLENGER, F.col("identity_key")
    unequal = rows.where((one & ~key.like("%7")) | (other & ((F.col("fold") != 3) | ~key.like("%5")))).unionByName(
        rows.where(other & key.like("%11"))
    )
    found = [
        slices.unmatched_rows(given, Y, BASELINE, CHALLENGER).agg(F.count("*").alias("unmatched_rows")).withColumn("inputs", F.lit(case))
        for case, given in (("same rows", rows), ("unequal rows", unequal))
    ]
    return found[0].unionByName(found[1])


_MONTHS = ("2020-04", "2020-05", "2021-01", "2022-01")
_MONTH_SLICES = {
    "Other sectors": ("roads_group", "Other sectors"), "Waste & Water": ("sector", "Waste & Water"),
    "Railways": ("sector", "Railways"),
}
_GRID = ", ".join(f"('{x}', '{f}', '{v}', '{m}')" for x, (f, v) in _MONTH_SLICES.items() for m in _MONTHS)
_MONTH_ROWS = " UNION ALL ".join(
    f"SELECT '{x}' AS important_slice, prediction_month AS evaluation_period, b.* FROM banded b WHERE {f} = '{v}' AND prediction_month IN ({', '.join(repr(m) for m in _MONTHS)})"
    for x, (f, v) in _MONTH_SLICES.items()
)
_SHOWN = slices.PAIRED_METRICS[:8]
_MONTH_ADEQUATE = "(coalesce(observations, 0) >= 50 AND coalesce(projects, 0) >= 25 AND coalesce(events, 0) >= 20 AND coalesce(observations, 0) - coalesce(events, 0) >= 20)"
_BY_MONTH = f"""month_rows AS ({_MONTH_ROWS}),
grid(important_slice, slice_feature, slice_value, evaluation_period) AS (VALUES {_GRID}),
month_paired AS ({_paired('important_slice, evaluation_period', 'month_rows', _SHOWN)}),
by_month AS (SELECT important_slice, slice_feature, slice_value, evaluation_period, coalesce(observations, 0) AS observations,
   coalesce(projects, 0) AS projects, coalesce(events, 0) AS events, event_rate,
   CASE WHEN {_MONTH_ADEQUATE} THEN 'ADEQUATE' ELSE 'INSUFFICIENT_SAMPLE' END AS sample_status,
   CASE WHEN {_MONTH_ADEQUATE} THEN '' ELSE 'SUPPORT_RULE_NOT_MET' END AS n_a_reason,
   {', '.join(f'CASE WHEN {_MONTH_ADEQUATE} THEN {s}_{n} END AS {s}_{n}' for s in ('baseline', 'challenger') for n in _SHOWN)},
   CASE WHEN {_MONTH_ADEQUATE} THEN {rnd('challenger_roc_auc - baseline_roc_auc')} END AS delta_roc_auc,
   CASE WHEN {_MONTH_ADEQUATE} THEN {rnd('challenger_pr_auc - baseline_pr_auc')} END AS delta_pr_auc
   FROM grid LEFT JOIN month_paired USING (important_slice, evaluation_period))"""


def _by_month(spark, folder):
    return slices.slice_month_comparison(
        predictions(spark, folder), Y, P, BASELINE, CHALLENGER, _MONTH_SLICES, _MONTHS
    )


@query("slice_month_comparison", with_("SELECT * FROM by_month", *PRED, _BANDED, _BY_MONTH))
def slice_month_comparison(spark, folder):
    return _by_month(spark, folder)


@query(
    "slice_temporal_wins",
    with_(
        """SELECT important_slice, count(*) FILTER (WHERE sample_status = 'ADEQUATE') AS supported_months,
          count(*) FILTER (WHERE delta_pr_auc > 0.005::DOUBLE) AS challenger_wins, count(*) FILTER (WHERE delta_pr_auc < -0.005::DOUBLE) AS baseline_wins,
          min(delta_pr_auc) AS smallest_delta, max(delta_pr_auc) AS largest_delta FROM by_month GROUP BY 1""",
        *PRED, _BANDED, _BY_MONTH,
    ),
)
def slice_temporal_wins(spark, folder):
    return slices.temporal_wins(_by_month(spark, folder))


@query(
    "slice_win_counts",
    with_(
        f"""SELECT coalesce(slice_feature, 'ALL') AS slice_feature, count(*) AS slices, count(*) FILTER (WHERE pr_direction = '{CHALLENGER}') AS wins,
          count(*) FILTER (WHERE pr_direction = '{BASELINE}') AS losses, count(*) FILTER (WHERE pr_direction = 'NEGLIGIBLE') AS ties,
          count(*) FILTER (WHERE delta_pr_auc < -0.05::DOUBLE) AS severe_losses,
          count(*) FILTER (WHERE challenger_precision_at_40 > baseline_precision_at_40) AS precision_at_40_improved,
          count(*) FILTER (WHERE challenger_recall_at_40 > baseline_recall_at_40) AS recall_at_40_improved
        FROM compared GROUP BY ROLLUP (slice_feature)""",
        *_CMP,
    ),
)
def slice_win_counts(spark, folder):
    return slices.win_counts(_compared(spark, folder), BASELINE, CHALLENGER)


@query(
    "slice_robustness_verdict",
    with_(
        f""", ev AS (SELECT count(*) FILTER (WHERE ({' OR '.join(f"(slice_feature = '{f}' AND slice_value = '{v}')" for f, v in slices.IMPORTANT_SLICES.values())})
                 AND delta_pr_auc < -0.005::DOUBLE) AS important_losses, count(*) FILTER (WHERE delta_pr_auc < -0.05::DOUBLE) AS severe_losses,
               avg(CAST(delta_pr_auc >= -0.005::DOUBLE AS INTEGER)) AS share FROM compared),
            fns AS (SELECT threshold, max(CASE WHEN model = '{BASELINE}' THEN fn END) AS b, max(CASE WHEN model = '{CHALLENGER}' THEN fn END) AS c
               FROM ({_thresholds('model', metrics.FIXED_THRESHOLDS)}) GROUP BY 1)
        SELECT important_losses, severe_losses, round(share, 6) AS maintained_share, (SELECT bool_and(c < b) FROM fns) AS false_negatives_improve,
          CASE WHEN severe_losses > 0 AND important_losses >= 2 THEN 'SIGNIFICANT SLICE CONCERNS'
               WHEN important_losses = 0 AND share >= 0.75 AND (SELECT bool_and(c < b) FROM fns) THEN 'ROBUST ACROSS SUPPORTED SLICES'
               ELSE 'MIXED SLICE ROBUSTNESS' END AS verdict FROM ev""",
        *_CMP,
    ),
)
def slice_robustness_verdict(spark, folder):
    rows = stored_predictions(spark, folder, columns=_SLICE_COLUMNS)
    return slices.robustness_verdict(
        slices.slice_comparison(rows, Y, P, BASELINE, CHALLENGER), slices.error_totals(rows, Y, P), slices.IMPORTANT_SLICES, BASELINE, CHALLENGER
    )


@query(
    "high_progress_review",
    with_(
        f""", h AS (SELECT *, (({P} >= 0.4::DOUBLE) <> ({Y} = 1)) AS err FROM predictions WHERE model = 'BASELINE' AND progress_current > 75)
        SELECT count(*) AS rows, count(DISTINCT identity_key) AS projects, count(DISTINCT CASE WHEN err THEN identity_key END) AS projects_with_error,
          round(avg({Y}), 6) AS positive_rate, round(avg(err::INT), 6) AS error_rate,
          round(avg((sector = 'Water Resources')::INT), 6) AS sector_share_of_rows,
          round(count(*) FILTER (WHERE err AND sector = 'Water Resources')::DOUBLE / count(*) FILTER (WHERE err), 6) AS sector_share_of_errors FROM h""",
        *PRED,
    ),
)
def high_progress_review(spark, folder):
    return slices.high_progress_review(baseline_predictions(spark, folder), Y, P, 0.40, "Water Resources")


# --- drift -----------------------------------------------------------------------------

_CATEGORIES = ["sector", "state", "ministry", "agency"]
_NUMBERS = [f for f in ALL_FEATURES if f not in _CATEGORIES]


def _parts(spark, folder):
    month = F.col("prediction_month")
    part = F.when(month <= "2024-12", "development").when(month >= "2025-07", "future")
    return build_features(supplier_panel(spark, folder)).withColumn("part", part)


_PARTS = """parts AS (SELECT *, CASE WHEN prediction_month <= '2024-12' THEN 'development' WHEN prediction_month >= '2025-07' THEN 'future' END AS part FROM features)"""


def _numeric_drift(f: str) -> str:
    a, b = "FILTER (WHERE part = 'development')", "FILTER (WHERE part = 'future')"
    return f"""SELECT '{f}' AS feature_name, 1 - count({f}) {a}::DOUBLE / count(*) {a} AS m1, 1 - count({f}) {b}::DOUBLE / count(*) {b} AS m2,
      CASE WHEN stddev_samp({f}) {a} > 0 THEN abs(avg({f}) {b} - avg({f}) {a}) / stddev_samp({f}) {a} END AS d, 0.5 AS lim FROM parts"""


def _category_drift(f: str) -> str:
    return f"""SELECT '{f}' AS feature_name, sum(CASE WHEN c = '<MISSING>' THEN s1 ELSE 0 END) AS m1, sum(CASE WHEN c = '<MISSING>' THEN s2 ELSE 0 END) AS m2,
      0.5 * sum(abs(s1 - s2)) AS d, 0.2 AS lim FROM (
        SELECT coalesce(a.c, b.c) AS c, coalesce(s1, 0) AS s1, coalesce(s2, 0) AS s2 FROM
          (SELECT coalesce({f}, '<MISSING>') AS c, count(*)::DOUBLE / (SELECT count(*) FROM parts WHERE part = 'development') AS s1 FROM parts WHERE part = 'development' GROUP BY 1) a
          FULL JOIN (SELECT coalesce({f}, '<MISSING>') AS c, count(*)::DOUBLE / (SELECT count(*) FROM parts WHERE part = 'future') AS s2 FROM parts WHERE part = 'future' GROUP BY 1) b
          ON a.c = b.c)"""


_MOVES = f"""moves AS ({' UNION ALL '.join([_numeric_drift(f) for f in _NUMBERS] + [_category_drift(f) for f in _CATEGORIES])})"""


@query(
    "future_drift",
    with_(
        f"""SELECT feature_name, round(m1, 6) AS development_missing_rate, round(m2, 6) AS future_missing_rate, round(d, 6) AS distribution_difference,
          feature_name IN ({', '.join(repr(x) for x in DRIFTING)}) AS prior_drift_flag,
          CASE WHEN d > lim THEN 'POTENTIALLY_PROBLEMATIC' ELSE 'STABLE_BY_THRESHOLD' END AS drift_status FROM moves""",
        SUPPLIER, FEATURES, _PARTS, _MOVES,
    ),
)
def future_drift(spark, folder):
    # Two branches read the tagged features.
    return drift.drift_table(
        written(_parts(spark, folder), "tagged-features"), "part", "development", "future", _NUMBERS, _CATEGORIES, set(DRIFTING)
    )


@query(
    "numeric_drift",
    with_(
        "SELECT feature_name, round(d, 6) AS distribution_difference FROM moves WHERE lim = 0.5", SUPPLIER, FEATURES, _PARTS, _MOVES
    ),
)
def numeric_drift(spark, folder):
    return drift.numeric_drift(_parts(spark, folder), "part", "development", "future", _NUMBERS).select(
        "feature_name", F.round("distribution_difference", 6).alias("distribution_difference")
    )


@query(
    "categorical_drift",
    with_(
        "SELECT feature_name, round(d, 6) AS distribution_difference FROM moves WHERE lim = 0.2", SUPPLIER, FEATURES, _PARTS, _MOVES
    ),
)
def categorical_drift(spark, folder):
    return drift.categorical_drift(_parts(spark, folder), "part", "development", "future", _CATEGORIES).select(
        "feature_name", F.round("distribution_difference", 6).alias("distribution_difference")
    )


_COUNTABLE = [
    "sector", "state", "ministry", "agency", "project_age_months", "cost_revision_count_to_date", "months_since_cost_revision",
    "schedule_revision_count_to_date", "months_since_schedule_revision", "months_observed", "months_since_first_observation",
    "revised_cost_missing", "progress_missing", "effective_target_months_from_cutoff",
]


@query(
    "missing_and_constant",
    with_(
        " UNION ALL ".join(
            f"""SELECT '{f}' AS feature_name, round(1 - count({f})::DOUBLE / count(*), 6) AS missing_rate, count(DISTINCT {f}) AS unique_values,
            1 - count({f})::DOUBLE / count(*) > 0.5 AS high_missing,
            (count(DISTINCT {f}) <= 1 OR (SELECT max(n) FROM (SELECT count(*) AS n FROM features GROUP BY {f}))::DOUBLE / count(*) >= 0.99) AS near_constant FROM features"""
            for f in _COUNTABLE
        ),
        SUPPLIER, FEATURES,
    ),
)
def missing_and_constant(spark, folder):
    return drift.missing_and_constant(build_features(supplier_panel(spark, folder)), _COUNTABLE)


_PAIRABLE = [
    "progress_current", "expenditure_current", "original_cost_current", "progress_change_3m", "progress_velocity_3m",
    "expenditure_change_3m", "expenditure_velocity_3m", "months_observed", "months_since_first_observation",
]


@query(
    "redundant_pairs",
    with_(
        "SELECT * FROM (" + " UNION ALL ".join(
            f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 4) AS correlation FROM features"
            for i, a in enumerate(_PAIRABLE) for b in _PAIRABLE[i + 1 :]
        ) + ") WHERE abs(correlation) > 0.98",
        SUPPLIER, FEATURES,
    ),
)
def redundant_pairs(spark, folder):
    return drift.redundant_pairs(build_features(supplier_panel(spark, folder)), _PAIRABLE).select(
        "feature_a", "feature_b", F.round("correlation", 4).alias("correlation")
    )


@query(
    "target_correlation",
    with_(
        " UNION ALL ".join(f"SELECT '{f}' AS feature_name, round(corr({f}, {Y}), 6) AS target_correlation FROM supervised" for f in _PAIRABLE),
        SUPPLIER, FEATURES, LABELS, SUPERVISED,
    ),
)
def target_correlation(spark, folder):
    table = drift.target_correlations(supervised(spark, folder), _PAIRABLE, Y)
    return table.select("feature_name", F.round("target_correlation", 6).alias("target_correlation"))


_GAPPY = ["revised_cost_current", "progress_change_3m", "months_since_cost_revision", "months_since_schedule_revision", "progress_current"]


@query(
    "period_missingness",
    with_(
        " UNION ALL ".join(
            f"SELECT '{f}' AS feature_name, round(max(r) - min(r), 6) AS missing_range, max(r) - min(r) > 0.5 AS period_dominated FROM (SELECT prediction_month, 1 - count({f})::DOUBLE / count(*) AS r FROM features GROUP BY 1)"
            for f in _GAPPY
        ),
        SUPPLIER, FEATURES,
    ),
)
def period_missingness(spark, folder):
    table = drift.period_missingness(build_features(supplier_panel(spark, folder)), _GAPPY)
    return table.withColumn("missing_range", F.round("missing_range", 6))


@query("feature_diagnostics")
def feature_diagnostics(spark, folder):
    month = F.col("prediction_month")
    part = F.when(month <= "2024-12", "train").when(month >= "2025-07", "test")
    rows = supervised(spark, folder).withColumn("part", part)
    return drift.feature_diagnostics(rows, "part", "train", "test", Y, _PAIRABLE + _GAPPY[2:4], _CATEGORIES)


@query(
    "conditional_review",
    with_(
        " UNION ALL ".join(
            f"SELECT '{f}' AS feature_name, round(1 - count({f})::DOUBLE / count(*), 6) AS missing_rate, '{'DEFER' if f == 'last_cost_revision_pct' else 'INCLUDE'}' AS decision FROM supervised"
            for f in ("state", "ministry", "agency", "project_age_months", "revised_cost_current", "effective_target_months_from_cutoff",
                      "last_cost_revision_pct", "expenditure_to_revised_cost", "cost_revision_pct_current")
        ),
        SUPPLIER, FEATURES, LABELS, SUPERVISED,
    ),
)
def conditional_review(spark, folder):
    return review_conditional(supervised(spark, folder)).select("feature_name", "missing_rate", "decision")


# --- comparison and policies -----------------------------------------------------------

_FOLD_REPORT = f"fold_report AS ({_report('model, fold')})"
_FOLDS = f"""folds AS (SELECT fold, {_side('baseline', BASELINE, compare.COMPARISON_METRICS)}, {_side('challenger', CHALLENGER, compare.COMPARISON_METRICS)}
  FROM fold_report GROUP BY fold),
fold_pairs AS (SELECT *, {_direction('delta_pr_auc')} AS pr_direction FROM (SELECT *,
  CASE WHEN baseline_roc_auc IS NOT NULL THEN {rnd('challenger_roc_auc - baseline_roc_auc')} END AS delta_roc_auc,
  CASE WHEN baseline_pr_auc IS NOT NULL THEN {rnd('challenger_pr_auc - baseline_pr_auc')} END AS delta_pr_auc FROM folds))"""
_FP = (*PRED, _FOLD_REPORT, _FOLDS)


def _fold_pairs(spark, folder):
    report = metrics.classification_report(predictions(spark, folder), Y, P, ["model", "fold"])
    return compare.paired_folds(report, BASELINE, CHALLENGER)


@query("paired_folds", with_("SELECT * FROM fold_pairs", *_FP))
def paired_folds(spark, folder):
    return _fold_pairs(spark, folder)


def _stat(side: str, m: str) -> str:
    c = f"{side}_{m}"
    return f"round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_sd, min({c}) AS {c}_min"


@query(
    "comparison_summary",
    with_(
        f"""SELECT count(*) AS folds, {', '.join(_stat(s, m) for s in ('baseline', 'challenger') for m in ('roc_auc', 'pr_auc'))},
          {rnd('avg(delta_roc_auc)')} AS mean_delta_roc_auc, {rnd('avg(delta_pr_auc)')} AS mean_delta_pr_auc,
          count(*) FILTER (WHERE pr_direction = '{CHALLENGER}') AS wins, count(*) FILTER (WHERE pr_direction = '{BASELINE}') AS losses,
          count(*) FILTER (WHERE pr_direction = 'NEGLIGIBLE') AS ties FROM fold_pairs""",
        *_FP,
    ),
)
def comparison_summary(spark, folder):
    return compare.comparison_summary(_fold_pairs(spark, folder), BASELINE, CHALLENGER)


def _held_out(spark, folder):
    return _test_part(predictions(spark, folder))


@query(
    "entity_disjoint_comparison",
    with_(f"{_DISJOINT_SQL} {_report('model', 'held')}", *PRED),
)
def entity_disjoint_comparison(spark, folder):
    return metrics.classification_report(_held_out(spark, folder), Y, P, ["model"])


@query(
    "model_decision",
    with_(
        f"""{_DISJOINT_SQL}, rep AS ({_report('model', 'held')}),
        u AS (SELECT max(CASE WHEN model = '{CHALLENGER}' THEN pr_auc END) - max(CASE WHEN model = '{BASELINE}' THEN pr_auc END) AS upr,
                     max(CASE WHEN model = '{CHALLENGER}' THEN roc_auc END) - max(CASE WHEN model = '{BASELINE}' THEN roc_auc END) AS uroc FROM rep),
        f AS (SELECT avg(delta_pr_auc) AS pr, avg(delta_roc_auc) AS roc, count(*) FILTER (WHERE pr_direction = '{CHALLENGER}') AS wins,
                     count(*) FILTER (WHERE pr_direction = '{BASELINE}') AS losses FROM fold_pairs)
        SELECT {rnd('pr')} AS mean_delta_pr_auc, {rnd('roc')} AS mean_delta_roc_auc, wins, losses, {rnd('upr')} AS disjoint_delta_pr_auc,
          {rnd('uroc')} AS disjoint_delta_roc_auc,
          CASE WHEN pr >= 0.01 AND roc >= 0.005 AND wins >= 4 AND losses <= 1 AND upr >= 0.005 AND uroc >= 0 THEN '{CHALLENGER} CLEARLY BETTER'
               WHEN pr <= -0.01 AND roc <= -0.005 AND losses >= 4 AND upr < 0 THEN '{CHALLENGER} WORSE'
               WHEN pr > 0 AND roc > 0 AND upr >= 0 AND uroc >= 0 THEN '{CHALLENGER} MARGINALLY BETTER' ELSE '{BASELINE} PREFERRED' END AS verdict,
          CASE WHEN pr >= 0.01 AND roc >= 0.005 AND wins >= 4 AND losses <= 1 AND upr >= 0.005 AND uroc >= 0 THEN '{CHALLENGER}' ELSE '{BASELINE}' END AS selected_model
        FROM f, u""",
        *_FP,
    ),
)
def model_decision(spark, folder):
    disjoint = metrics.ranking_metrics(_held_out(spark, folder), Y, P, ["model"])
    return compare.decision(_fold_pairs(spark, folder), disjoint, BASELINE, CHALLENGER)


_RUN_METRICS = ["brier", "mean_prediction"]


def _runs(spark, folder):
    """Fold metrics of the full run, and of a run that lacks one fold and some entities."""
    rows = stored_predictions(spark, folder).where(F.col("model") == BASELINE)

    def report(part):
        y, p = F.col(Y), F.col(P)
        return part.groupBy("fold").agg(
            F.round(F.avg((p - y) * (p - y)), 6).alias("brier"), F.round(F.avg(p), 6).alias("mean_prediction")
        )

    again = rows.where((F.col("fold") != 3) & ~((F.col("fold") >= 5) & F.col("identity_key").endswith("7")))
    return report(rows), report(again)


_RUNS = f"""runs AS (SELECT fold, a.brier AS brier_first, a.mp AS mean_prediction_first, b.brier AS brier_second, b.mp AS mean_prediction_second,
    {rnd('b.brier - a.brier')} AS brier_delta, {rnd('b.mp - a.mp')} AS mean_prediction_delta FROM
  (SELECT fold, round(avg(({P} - {Y}) * ({P} - {Y})), 6) AS brier, round(avg({P}), 6) AS mp FROM predictions WHERE model = 'BASELINE' GROUP BY 1) a
  FULL JOIN (SELECT fold, round(avg(({P} - {Y}) * ({P} - {Y})), 6) AS brier, round(avg({P}), 6) AS mp FROM predictions
       WHERE model = 'BASELINE' AND fold <> 3 AND NOT (fold >= 5 AND identity_key LIKE '%7') GROUP BY 1) b USING (fold)),
compared_runs AS (SELECT *, abs(brier_delta) AS brier_absolute_delta, abs(mean_prediction_delta) AS mean_prediction_absolute_delta,
   coalesce(greatest(abs(b2), abs(m2)) <= 0.000001, false) AS within_tolerance FROM (
     SELECT * REPLACE (CASE WHEN brier_second IS NOT NULL THEN brier_delta END AS brier_delta, CASE WHEN brier_second IS NOT NULL THEN mean_prediction_delta END AS mean_prediction_delta),
       CASE WHEN brier_second IS NULL THEN 1 ELSE brier_delta END AS b2, CASE WHEN brier_second IS NULL THEN 1 ELSE mean_prediction_delta END AS m2 FROM runs))"""


@query("run_comparison", with_("SELECT * EXCLUDE (b2, m2) FROM compared_runs", *PRED, _RUNS))
def run_comparison(spark, folder):
    first, second = _runs(spark, folder)
    return metrics.rounded(compare.run_comparison(first, second, "fold", _RUN_METRICS, 1e-6))


@query(
    "run_comparison_summary",
    with_(
        """SELECT count(*) AS compared, max(brier_absolute_delta) AS max_brier_delta, max(mean_prediction_absolute_delta) AS max_mean_prediction_delta,
          bool_and(within_tolerance) AS all_within_tolerance, min(CASE WHEN NOT within_tolerance THEN fold END) AS first_divergent FROM compared_runs""",
        *PRED, _RUNS,
    ),
)
def run_comparison_summary(spark, folder):
    first, second = _runs(spark, folder)
    compared = compare.run_comparison(first, second, "fold", _RUN_METRICS, 1e-6)
    return metrics.rounded(compare.run_comparison_summary(compared, "fold", _RUN_METRICS))


_LEAVES = f"""leaves AS (SELECT model, fold, leaf, sha256(string_agg(row_text, chr(10) ORDER BY place)) AS digest FROM (
  SELECT model, fold, row_text, place, place // {LEAF} AS leaf FROM (
    SELECT model, fold, row_text, row_number() OVER (PARTITION BY model, fold ORDER BY identity_key, prediction_month, row_text) - 1 AS place FROM (
      SELECT *, identity_key || '|' || prediction_month || '|' || printf('%.12f', {P}) AS row_text FROM predictions))) GROUP BY 1, 2, 3)"""


@query(
    "prediction_summary",
    with_(
        f"""SELECT * FROM (SELECT model, fold, count(*) AS prediction_length, min({P}) AS prediction_min, max({P}) AS prediction_max,
          round(avg({P}), 6) AS prediction_mean FROM predictions GROUP BY 1, 2)
        JOIN (SELECT model, fold, CASE WHEN count(*) = 1 THEN min(digest) ELSE sha256(string_agg(digest, chr(10) ORDER BY leaf)) END AS prediction_digest
          FROM leaves GROUP BY 1, 2) USING (model, fold)""",
        *PRED, _LEAVES,
    ),
)
def prediction_summary(spark, folder):
    return compare.prediction_summary(stored_predictions(spark, folder), P, ["model", "fold"])


@query(
    "threshold_transfer",
    with_(
        f", t AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in _RATES.items())
        + f" FROM ({_thresholds('model, fold', metrics.REVIEW_THRESHOLDS)})) SELECT model, threshold, count(*) AS folds, "
        + ", ".join(f"round(min({m}), 6) AS min_{m}, round(max({m}), 6) AS max_{m}" for m in ("precision", "recall", "f1"))
        + " FROM t GROUP BY 1, 2",
        *PRED,
    ),
)
def threshold_transfer(spark, folder):
    table = metrics.at_thresholds(predictions(spark, folder), Y, P, ["model", "fold"], metrics.REVIEW_THRESHOLDS)
    return compare.threshold_transfer(table)


@query(
    "metric_stability",
    with_(
        "SELECT model, count(*) AS folds, " + ", ".join(
            f"round(avg({m}), 6) AS mean_{m}, round(stddev_pop({m}), 6) AS sd_{m}, round(min({m}), 6) AS min_{m}, round(max({m}), 6) AS max_{m}"
            for m in ("roc_auc", "pr_auc", "brier")
        ) + " FROM fold_report GROUP BY 1",
        *PRED, _FOLD_REPORT,
    ),
)
def metric_stability(spark, folder):
    report = metrics.classification_report(predictions(spark, folder), Y, P, ["model", "fold"])
    return compare.metric_stability(report, "model", ["roc_auc", "pr_auc", "brier"])


def _policies(by: str, source: str = "predictions") -> str:
    keys = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    parts = " UNION ALL ".join(
        f"""SELECT {keys}CAST({t!r} AS DOUBLE) AS threshold, count(*) AS n, count(DISTINCT identity_key) AS projects,
          count(DISTINCT prediction_month) = 1 AS one_month, count(DISTINCT CASE WHEN {P} >= CAST({t!r} AS DOUBLE) THEN identity_key END) AS flagged_projects,
          {_confusion(t)} FROM {source}{group}"""
        for t in metrics.FIXED_THRESHOLDS
    )
    return f"""SELECT {keys}threshold, n AS observations_evaluated, projects AS unique_projects_evaluated, tp + fp AS flagged_review_actions,
      round((tp + fp)::DOUBLE / n, 8) AS flagged_percent, CASE WHEN one_month THEN flagged_projects END AS unique_projects_flagged,
      CASE WHEN one_month THEN 'ONE_MONTH_UNIQUE' ELSE 'NOT_AGGREGATED_ACROSS_MONTHS' END AS project_flagging_scope,
      tp AS true_errors_captured, fp AS false_interventions, fn AS error_observations_missed, tn AS true_negatives,
      round({ratio('tp', 'tp + fp')}, 8) AS intervention_precision,
      CASE WHEN tp + fp > 0 THEN 'DEFINED' ELSE 'N/A_NO_FLAGGED_OBSERVATIONS' END AS precision_status,
      round({ratio('tp', 'tp + fn')}, 8) AS intervention_recall,
      CASE WHEN tp + fn > 0 THEN 'DEFINED' ELSE 'N/A_NO_ERROR_OBSERVATIONS' END AS recall_status,
      CASE WHEN tp > 0 THEN round({ratio('2 * tp', '2 * tp + fp + fn')}, 8) END AS f1,
      CASE WHEN tp > 0 THEN 'DEFINED' ELSE 'N/A_UNDEFINED_PRECISION_OR_RECALL' END AS f1_status,
      round((tp + fp)::DOUBLE / n, 8) AS intervention_burden, round({ratio('tp', 'tp + fn')}, 8) AS error_capture_rate,
      round({ratio('fp', 'tp')}, 8) AS false_interventions_per_true_error_captured, round({ratio('tp + fp', 'tp + fn')}, 8) AS review_workload_ratio
    FROM ({parts})"""


@query("intervention_policies", with_(_policies("model"), *PRED))
def intervention_policies(spark, folder):
    return policy.overall_policies(predictions(spark, folder), Y, P)


@query("intervention_policies_by_fold", with_(_policies("model, fold, prediction_month"), *PRED))
def intervention_policies_by_fold(spark, folder):
    return policy.fold_policies(predictions(spark, folder), Y, P)


@query(
    "fold_policy_summary",
    with_(
        f", pol AS ({_policies('model, fold, prediction_month')}) SELECT model, threshold, count(*) AS folds, "
        + ", ".join(f"round(avg({m}), 6) AS mean_{m}, round(stddev_pop({m}), 6) AS sd_{m}" for m in policy.FOLD_METRICS)
        + " FROM pol GROUP BY 1, 2",
        *PRED,
    ),
)
def fold_policy_summary(spark, folder):
    return policy.fold_policy_summary(policy.fold_policies(predictions(spark, folder), Y, P))


_COUNT_METRICS = policy._COUNTS


def _policy_delta(m: str) -> str:
    d = f"challenger_{m} - baseline_{m}"
    return f"{d} AS delta_{m}" if m in _COUNT_METRICS else f"(CASE WHEN {d} IS NOT NULL THEN {rnd(d)} END) AS delta_{m}"


_POLICY_WIDE = f"""pol AS ({_policies('model')}),
wide AS (SELECT threshold, {_side('baseline', BASELINE, policy.POLICY_METRICS)}, {_side('challenger', CHALLENGER, policy.POLICY_METRICS)} FROM pol GROUP BY 1),
policy_pairs AS (SELECT *, {', '.join(_policy_delta(m) for m in policy.POLICY_METRICS)} FROM wide)"""


@query(
    "policy_comparison",
    with_(
        f"""SELECT *, (CASE WHEN delta_true_errors_captured <> 0 THEN {rnd('delta_false_interventions::DOUBLE / delta_true_errors_captured')} END)
           AS additional_false_interventions_per_additional_true_error FROM policy_pairs""",
        *PRED, _POLICY_WIDE,
    ),
)
def policy_comparison(spark, folder):
    return policy.policy_comparison(policy.overall_policies(predictions(spark, folder), Y, P), BASELINE, CHALLENGER)


_POLICY_VALUES = (
    "observations_evaluated", "unique_projects_evaluated", "flagged_review_actions", "flagged_percent", "unique_projects_flagged",
    "project_flagging_scope", "true_errors_captured", "false_interventions", "error_observations_missed", "true_negatives",
    "intervention_precision", "precision_status", "intervention_recall", "recall_status", "f1", "f1_status", "intervention_burden",
    "error_capture_rate", "false_interventions_per_true_error_captured", "review_workload_ratio",
)


@query(
    "slice_policies",
    with_(
        f""", s AS (SELECT w.*, count(identity_key) AS n, count(DISTINCT identity_key) AS e, coalesce(sum({Y}), 0) AS pos FROM wanted w
            LEFT JOIN (SELECT * FROM named WHERE model = '{BASELINE}') USING (important_slice, slice_feature, slice_value) GROUP BY ALL),
          pol AS ({_policies('important_slice, model', 'named')})
        SELECT s.important_slice, slice_feature, slice_value, model, threshold,
          CASE WHEN {_ADEQUATE} THEN 'ADEQUATE' ELSE 'INSUFFICIENT_SAMPLE' END AS sample_status,
          CASE WHEN {_ADEQUATE} THEN '' ELSE 'SUPPORT_RULE_NOT_MET' END AS n_a_reason,
          {', '.join(f'CASE WHEN {_ADEQUATE} THEN {v} END AS {v}' for v in _POLICY_VALUES)}
        FROM s LEFT JOIN pol ON s.important_slice = pol.important_slice""",
        *PRED, _SLICED,
    ),
)
def slice_policies(spark, folder):
    return policy.slice_policies(predictions(spark, folder), Y, P, BASELINE)


@query("entity_disjoint_policies", with_(f"{_DISJOINT_SQL} {_policies('model', 'held')}", *PRED))
def entity_disjoint_policies(spark, folder):
    return policy.overall_policies(_held_out(spark, folder), Y, P)


@query(
    "cost_scenarios",
    with_(
        f""", pol AS ({_policies('model')}),
        sc(scenario, fnc, fpc) AS (VALUES {', '.join(f"('{n}', {a}, {b})" for n, (a, b) in policy.COST_SCENARIOS.items())}),
        c AS (SELECT scenario, fnc, fpc, threshold, model, fnc * error_observations_missed + fpc * false_interventions AS cost FROM pol, sc)
        SELECT scenario, fnc::BIGINT AS false_negative_relative_cost, fpc::BIGINT AS false_positive_relative_cost, threshold,
          max(CASE WHEN model = '{BASELINE}' THEN cost END) AS baseline_total_simulated_cost,
          max(CASE WHEN model = '{CHALLENGER}' THEN cost END) AS challenger_total_simulated_cost,
          max(CASE WHEN model = '{CHALLENGER}' THEN cost END) - max(CASE WHEN model = '{BASELINE}' THEN cost END) AS delta_challenger_minus_baseline
        FROM c GROUP BY 1, 2, 3, 4""",
        *PRED,
    ),
)
def cost_scenarios(spark, folder):
    return policy.cost_scenarios(policy.overall_policies(predictions(spark, folder), Y, P), BASELINE, CHALLENGER)


@query(
    "operational_verdict",
    with_(
        """, e AS (SELECT bool_and(delta_true_errors_captured > 0) AS a, bool_and(delta_false_interventions > 0) AS b,
              bool_and(delta_false_interventions <= 0) AS c, bool_or(delta_flagged_percent >= 0.1) AS d FROM policy_pairs)
        SELECT a AS captures_more, b AS more_false, c AS no_more_false, d AS heavier_burden,
          CASE WHEN a AND b AND d THEN 'OPERATIONALLY MIXED' WHEN a AND c THEN 'OPERATIONALLY PROMISING' ELSE 'OPERATIONALLY WEAK' END AS verdict FROM e""",
        *PRED, _POLICY_WIDE,
    ),
)
def operational_verdict(spark, folder):
    overall = policy.overall_policies(predictions(spark, folder), Y, P)
    return policy.operational_verdict(policy.policy_comparison(overall, BASELINE, CHALLENGER))


_NUMERIC, _TEXT = split_features(ALL_FEATURES)
_RANKED = ", ".join(f"'{f}'" for f in STABLE), ", ".join(f"'{f}'" for f in DRIFTING)


def _share(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN sqrt({part} / {whole}) ELSE 0 END"


@query(
    "importance_ranking",
    with_(
        ", base AS (SELECT * FROM predictions WHERE model = 'BASELINE'), imp AS ("
        + " UNION ALL ".join(
            [
                f"""SELECT fold, '{f}' AS feature_name, CASE WHEN var_pop(x) > 0 AND var_pop(y) > 0
                    THEN abs(covar_pop(x, y)) / sqrt(var_pop(x) * var_pop(y)) ELSE 0 END AS importance
                    FROM (SELECT fold, CAST({f} AS DOUBLE) AS x, CASE WHEN {f} IS NOT NULL THEN CAST({Y} AS DOUBLE) END AS y FROM base) GROUP BY fold"""
                for f in _NUMERIC
            ]
            + [
                f"""SELECT fold, '{f}', {_share('greatest(0, sum(s * s / n) - sum(s) * sum(s) / sum(n))', '(sum(s) - sum(s) * sum(s) / sum(n))')}
                    FROM (SELECT fold, count({f})::DOUBLE AS n, CAST(sum(CASE WHEN {f} IS NOT NULL THEN {Y} ELSE 0 END) AS DOUBLE) AS s
                          FROM base GROUP BY fold, {f}) WHERE n > 0 GROUP BY fold"""
                for f in _TEXT
            ]
        )
        + f""") SELECT feature_name, round(avg(importance), 6) AS mean_importance, round(stddev_pop(importance), 6) AS sd_importance,
          feature_name IN ({_RANKED[0]}) AS stable_feature, feature_name IN ({_RANKED[1]}) AS prior_drift_flag FROM imp GROUP BY 1""",
        *PRED,
    ),
)
def importance_ranking(spark, folder):
    """Every feature by the size of its correlation with the target, per fold; for text, the correlation ratio."""
    rows = baseline_predictions(spark, folder)
    pairs = [F.struct(F.lit(f).alias("feature_name"), F.col(f).cast("double").alias("x"), F.lit(None).cast("string").alias("v")) for f in _NUMERIC]
    pairs += [F.struct(F.lit(f).alias("feature_name"), F.lit(None).cast("double").alias("x"), F.col(f).alias("v")) for f in _TEXT]
    long = rows.select("fold", F.col(Y).cast("double").alias("y"), F.explode(F.array(*pairs)).alias("p")).select("fold", "y", "p.*")
    known = F.when(F.col("x").isNotNull(), F.col("y"))
    numbers = long.where(F.col("feature_name").isin(_NUMERIC)).groupBy("fold", "feature_name").agg(
        F.covar_pop("x", "y").alias("both"), (F.var_pop("x") * F.var_pop(known)).alias("spread")
    )
    # the target is 0 or 1, so its sum of squares is its sum
    groups = long.where(F.col("v").isNotNull()).groupBy("fold", "feature_name", "v").agg(F.count("*").alias("n"), F.sum("y").alias("s"))
    mean = F.sum("s") * F.sum("s") / F.sum("n")
    texts = groups.groupBy("fold", "feature_name").agg((F.sum(F.col("s") * F.col("s") / F.col("n")) - mean).alias("part"), (F.sum("s") - mean).alias("whole"))
    importances = numbers.select(
        "fold", "feature_name", F.when(F.col("spread") > 0, F.abs("both") / F.sqrt("spread")).otherwise(0.0).alias("importance")
    ).unionByName(texts.select("fold", "feature_name", F.when(F.col("whole") > 0, F.sqrt(F.greatest(F.lit(0.0), F.col("part")) / F.col("whole"))).otherwise(0.0).alias("importance")))
    return metrics.rounded(compare.importance_ranking(importances, set(STABLE), set(DRIFTING), len(ALL_FEATURES)))
