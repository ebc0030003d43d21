import math
import random

import pytest
from pyspark.sql import functions as F

from panelwatch.operators import calibration, compare, drift, metrics, policy, slices
from tests.conftest import column, one


def scored(spark, pairs):
    rows = [(f"P:{i}", "2026-01", y, p) for i, (y, p) in enumerate(pairs)]
    return spark.createDataFrame(rows, "identity_key string, prediction_month string, y int, p double")


def brute_auc(pairs):
    pos = [p for y, p in pairs if y == 1]
    neg = [p for y, p in pairs if y == 0]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def brute_ap(pairs):
    positives = sum(y for y, _ in pairs)
    total, recall = 0.0, 0.0
    for t in sorted({p for _, p in pairs}, reverse=True):
        tp = sum(y for y, p in pairs if p >= t)
        n = sum(1 for _, p in pairs if p >= t)
        total += (tp / positives - recall) * tp / n
        recall = tp / positives
    return total


def random_pairs(n=400, ties=True):
    random.seed(3)
    pairs = []
    for _ in range(n):
        y = int(random.random() < 0.3)
        p = min(1.0, max(0.0, random.gauss(0.35 + 0.2 * y, 0.2)))
        pairs.append((y, round(p, 2) if ties else p))
    return pairs


@pytest.mark.parametrize("ties", [True, False])
def test_ranking_matches_brute_force(spark, ties):
    pairs = random_pairs(ties=ties)
    row = one(metrics.ranking_metrics(scored(spark, pairs), "y", "p", []))
    assert row.roc_auc == pytest.approx(brute_auc(pairs), abs=1e-6)
    assert row.pr_auc == pytest.approx(brute_ap(pairs), abs=1e-6)


def test_single_class_has_no_ranking(spark):
    row = one(metrics.ranking_metrics(scored(spark, [(1, 0.2), (1, 0.7)]), "y", "p", []))
    assert row.roc_auc is None and row.metric_status == "N/A_SINGLE_CLASS"


@pytest.mark.parametrize("pair", [(2, 0.5), (None, 0.5), (1, None), (1, 1.5), (0, float("nan"))])
def test_invalid_predictions_are_refused(spark, pair):
    with pytest.raises(Exception, match="0/1 target"):
        metrics.validated(scored(spark, [pair]), "y", "p").collect()


def test_brier_and_bins_hand_values(spark):
    pairs = [(0, 0.1), (1, 0.8), (1, 0.6), (0, 0.3)]
    frame = scored(spark, pairs)
    row = one(calibration.brier_metrics(frame, "y", "p", []))
    assert row.brier_score == pytest.approx((0.01 + 0.04 + 0.16 + 0.09) / 4)
    assert row.prevalence_only_brier == pytest.approx(0.25)
    bins = calibration.reliability_bins(frame, "y", "p", []).collect()
    assert len(bins) == 10 and sum(b.observations for b in bins) == 4
    assert [b.bin_index for b in bins if b.observations] == [1, 3, 6, 8]
    assert bins[1].bin_status == "EMPTY" and bins[1].mean_predicted_score is None
    ece = one(calibration.expected_calibration_error(frame, "y", "p", [])).ece_10_equal_width
    assert ece == pytest.approx((0.1 + 0.3 + 0.4 + 0.2) / 4)


def test_zero_belongs_to_the_first_bin(spark):
    bins = calibration.reliability_bins(scored(spark, [(0, 0.0), (1, 0.1), (1, 1.0)]), "y", "p", []).collect()
    assert bins[0].observations == 2 and bins[9].observations == 1


def newton(pairs):
    a, b = 0.0, 1.0
    for _ in range(60):
        g0 = g1 = h00 = h01 = h11 = 0.0
        for y, p in pairs:
            p = min(1 - 1e-6, max(1e-6, p))
            x = math.log(p / (1 - p))
            f = 1 / (1 + math.exp(-(a + b * x)))
            w = f * (1 - f)
            g0 += f - y
            g1 += (f - y) * x
            h00 += w
            h01 += w * x
            h11 += w * x * x
        d = h00 * h11 - h01 * h01
        a, b = a - (h11 * g0 - h01 * g1) / d, b - (h00 * g1 - h01 * g0) / d
    return a, b


def test_calibration_line_matches_a_plain_newton_fit(spark):
    pairs = random_pairs()
    row = one(calibration.calibration_intercept_slope(scored(spark, pairs), "y", "p", []))
    a, b = newton(pairs)
    assert row.calibration_intercept == pytest.approx(a, abs=1e-6)
    assert row.calibration_slope == pytest.approx(b, abs=1e-6)


def test_calibration_line_of_two_points(spark):
    # Two scores: the fit passes through both observed log-odds exactly.
    pairs = [(1, 0.2)] * 1 + [(0, 0.2)] * 3 + [(1, 0.8)] * 3 + [(0, 0.8)] * 2
    row = one(calibration.calibration_intercept_slope(scored(spark, pairs), "y", "p", []))
    logit = math.log(4.0)
    slope = (math.log(3 / 2) - math.log(1 / 3)) / (2 * logit)
    assert row.calibration_slope == pytest.approx(slope, abs=1e-8)
    assert row.calibration_intercept == pytest.approx(math.log(3 / 2) - slope * logit, abs=1e-8)


def test_calibration_line_statuses_per_group(spark):
    frame = scored(spark, [(1, 0.5), (1, 0.6), (0, 0.5), (1, 0.5)]).withColumn(
        "g", F.when(F.col("identity_key").isin("P:0", "P:1"), "single").otherwise("constant")
    )
    table = calibration.calibration_intercept_slope(frame, "y", "p", ["g"])
    assert column(table, "calibration_diagnostic_status", "g") == {
        "single": "N/A_SINGLE_CLASS", "constant": "N/A_CONSTANT_SCORE",
    }


def test_calibration_lines_of_many_groups_need_no_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    n = 1500
    rows = spark.range(n * 60).select(
        F.concat(F.lit("P:"), F.col("id").cast("string")).alias("identity_key"),
        F.when(F.col("id") % n != 0, F.col("id") % n).alias("g"),
        ((F.xxhash64("id") % 97 + 97) % 97 / 100.0 + 0.015).alias("p"),
    )
    rows = rows.withColumn("y", (F.pmod(F.xxhash64("identity_key", F.lit(3)), F.lit(100)) / 100.0 < F.col("p") * 0.7 + 0.1).cast("int"))
    pairs = {}
    for r in rows.collect():
        pairs.setdefault(r.g, []).append((r.y, r.p))

    def refused(self):
        raise AssertionError("groups were collected")

    with monkeypatch.context() as patch:
        patch.setattr(DataFrame, "collect", refused)
        fitted = calibration.calibration_intercept_slope(rows, "y", "p", ["g"])
    found = {r.g: r for r in fitted.collect()}
    assert len(found) == n and None in found
    checked = 0
    for g in [None, *range(1, n, 37)]:
        if len({y for y, _ in pairs[g]}) == 2 and found[g].calibration_diagnostic_status == "DEFINED":
            try:
                a, b = newton(pairs[g])
            except (OverflowError, ZeroDivisionError):
                continue
            if abs(a) < 20 and abs(b) < 20:
                checked += 1
                assert found[g].calibration_intercept == pytest.approx(a, abs=1e-5)
                assert found[g].calibration_slope == pytest.approx(b, abs=1e-5)
    assert checked > 30


def test_threshold_choice_prefers_recall(spark):
    row = one(metrics.choose_threshold(scored(spark, [(1, 0.9), (1, 0.5), (0, 0.4), (0, 0.1)]), "y", "p", []))
    assert row.threshold == 0.45 and row.f1 == 1.0


def test_population_deviation_in_summaries(spark):
    folds = spark.createDataFrame([(1, 0.2), (2, 0.4)], "fold int, event_rate double")
    row = one(calibration.metric_summary(folds))
    assert row.standard_deviation == pytest.approx(0.1) and row.supported_folds == 2


def policies(spark, pairs, model="m"):
    return scored(spark, pairs).withColumns({"model": F.lit(model), "fold": F.lit(1)})


def test_intervention_metrics_hand_values(spark):
    frame = policies(spark, [(1, 0.9), (0, 0.6), (1, 0.3), (0, 0.1)])
    row = policy.overall_policies(frame, "y", "p").where("threshold = 0.4").first()
    assert (row.true_errors_captured, row.false_interventions, row.error_observations_missed) == (1, 1, 1)
    assert row.intervention_precision == 0.5 and row.f1 == 0.5 and row.review_workload_ratio == 1.0
    assert row.unique_projects_flagged == 2 and row.project_flagging_scope == "ONE_MONTH_UNIQUE"


def test_intervention_without_flags_or_events(spark):
    row = policy.overall_policies(policies(spark, [(0, 0.1), (0, 0.2)]), "y", "p").first()
    assert row.precision_status == "N/A_NO_FLAGGED_OBSERVATIONS" and row.recall_status == "N/A_NO_ERROR_OBSERVATIONS"
    assert row.f1 is None


def test_duplicate_entities_in_a_fold_are_refused(spark):
    frame = policies(spark, [(1, 0.9), (0, 0.6)]).withColumn("identity_key", F.lit("P:1"))
    with pytest.raises(Exception, match="duplicate entity"):
        policy.fold_policies(frame, "y", "p").collect()


def test_cost_scenarios(spark):
    both = policies(spark, [(1, 0.9), (1, 0.1), (0, 0.8)], "b").unionByName(policies(spark, [(1, 0.9), (1, 0.7), (0, 0.8)], "c"))
    overall = policy.overall_policies(both, "y", "p")
    rows = {(r.scenario, r.threshold): r for r in policy.cost_scenarios(overall, "b", "c").collect()}
    assert rows[("B_FN_DOUBLE", 0.4)].baseline_total_simulated_cost == 3
    assert rows[("B_FN_DOUBLE", 0.4)].challenger_total_simulated_cost == 1
    assert rows[("C_FN_FIVEFOLD", 0.4)].delta_challenger_minus_baseline == -5


def decision_of(spark, deltas, disjoint=(0.02, 0.02)):
    winner = lambda d: "C" if d > 0.005 else "B" if d < -0.005 else "NEGLIGIBLE"
    folds = spark.createDataFrame(
        [(i, d, d, winner(d)) for i, d in enumerate(deltas)],
        "fold int, delta_pr_auc double, delta_roc_auc double, pr_direction string",
    )
    unseen = spark.createDataFrame(
        [("B", 0.5, 0.5), ("C", 0.5 + disjoint[0], 0.5 + disjoint[1])], "model string, pr_auc double, roc_auc double"
    )
    return one(compare.decision(folds, unseen, "B", "C")).verdict


def test_decision_rule(spark):
    assert decision_of(spark, [0.02] * 5 + [0.0]) == "C CLEARLY BETTER"
    assert decision_of(spark, [-0.02] * 6, (-0.1, -0.1)) == "C WORSE"
    assert decision_of(spark, [0.004] * 6) == "C MARGINALLY BETTER"
    assert decision_of(spark, [0.02] * 6, (-0.1, 0.0)) == "B PREFERRED"


def test_support_rule_boundaries(spark):
    frame = spark.createDataFrame(
        [(50, 25, 20), (49, 25, 20), (50, 24, 20), (50, 25, 19), (50, 25, 31)], "n int, e int, pos int"
    )
    got = [r[0] for r in frame.select(slices.support_status(F.col("n"), F.col("e"), F.col("pos"))).collect()]
    assert got == ["ADEQUATE"] + ["INSUFFICIENT_SAMPLE"] * 4


def test_a_category_named_like_the_missing_marker_is_not_missing(spark):
    rows = [("a", "<MISSING>"), ("a", None), ("b", "<MISSING>"), ("b", "<MISSING>")]
    frame = spark.createDataFrame(rows, "part string, c string")
    got = one(drift.categorical_drift(frame, "part", "a", "b", ["c"]))
    assert (got.first_missing_rate, got.second_missing_rate, got.distribution_difference) == (0.5, 0.0, 0.5)


def test_drift_measures(spark):
    frame = spark.createDataFrame(
        [("a", 1.0, "x"), ("a", 3.0, "x"), ("b", 5.0, "y"), ("b", 5.0, None)], "part string, n double, c string"
    )
    numeric = one(drift.numeric_drift(frame, "part", "a", "b", ["n"]))
    assert numeric.distribution_difference == pytest.approx(3 / math.sqrt(2))
    assert one(drift.categorical_drift(frame, "part", "a", "b", ["c"])).distribution_difference == 1.0


def test_correlations_match_numpy(spark):
    import numpy as np

    random.seed(9)
    x = [random.gauss(1e6, 10) for _ in range(300)]
    y = [2 * v + random.gauss(0, 5) for v in x]
    data = [(a, b if i % 7 else None, 4.0) for i, (a, b) in enumerate(zip(x, y))]
    frame = spark.createDataFrame(data, "a double, b double, c double").repartition(3)
    got = {(r.feature_a, r.feature_b): r.correlation for r in drift.correlations(frame, ["a", "b", "c"]).collect()}
    kept = [(a, b) for a, b, _ in data if b is not None]
    assert got[("a", "b")] == pytest.approx(np.corrcoef(*zip(*kept))[0, 1], abs=1e-9)
    assert got[("a", "c")] is None


def test_run_comparison_finds_the_first_divergence(spark):
    first = spark.createDataFrame([(1, 0.5), (2, 0.6), (3, 0.7)], "fold int, m double")
    second = spark.createDataFrame([(1, 0.5), (2, 0.61), (4, 0.7)], "fold int, m double")
    compared = compare.run_comparison(first, second, "fold", ["m"], 1e-9)
    row = one(compare.run_comparison_summary(compared, "fold", ["m"]))
    assert row.compared == 4 and row.first_divergent == 2 and not row.all_within_tolerance


def test_the_disjoint_test_part_has_both_classes(spark):
    from panelwatch.plans.inputs import DISJOINT, TARGET, supervised
    from panelwatch.operators.splits import with_disjoint_split

    rows = with_disjoint_split(supervised(spark, "/root/testdata/sf0.01"), DISJOINT).where("part = 'test'")
    counts = {r[TARGET]: r["count"] for r in rows.groupBy(TARGET).count().collect()}
    assert counts[0] > 20 and counts[1] > 5


def test_all_features_are_ranked_by_correlation(spark, data):
    import numpy as np

    from panelwatch.operators.modelling import ALL_FEATURES
    from panelwatch.plans import all_queries
    from panelwatch.plans.inputs import TARGET, baseline_predictions

    got = {r.feature_name: r for r in all_queries()["importance_ranking"](spark, data).collect()}
    assert set(got) == set(ALL_FEATURES)
    rows = baseline_predictions(spark, data).select("fold", TARGET, "progress_current", "sector").collect()

    def size(pairs):
        x, y = (np.array(c, dtype=float) for c in zip(*pairs))
        return abs(np.corrcoef(x, y)[0, 1]) if x.std() > 0 and y.std() > 0 else 0.0

    numbers, texts = [], []
    for fold in sorted({r.fold for r in rows}):
        part = [r for r in rows if r.fold == fold]
        numbers.append(size([(r.progress_current, r[TARGET]) for r in part if r.progress_current is not None]))
        groups = {}
        for r in part:
            if r.sector is not None:
                groups.setdefault(r.sector, []).append(r[TARGET])
        means = [(np.mean(groups[r.sector]), r[TARGET]) for r in part if r.sector is not None]
        texts.append(size(means) if len({round(m, 12) for m, _ in means}) > 1 else 0.0)
    for name, values in (("progress_current", numbers), ("sector", texts)):
        assert got[name].mean_importance == pytest.approx(np.mean(values), abs=2e-6)
        assert got[name].sd_importance == pytest.approx(np.std(values), abs=2e-6)
