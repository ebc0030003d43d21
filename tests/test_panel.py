from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelwatch.operators import features, history, identity, integrity, labels, master, splits
from panelwatch.operators.features import build_features
from panelwatch.sources.panel import PANEL_COLUMNS, typed_panel
from tests.conftest import column, one

NUMERIC = {"original_cost", "revised_cost", "expenditure", "physical_progress"}
SCHEMA = ", ".join(
    f"{c} {'double' if c in NUMERIC else 'int' if c in ('sl_no', 'source_page') else 'string'}" for c in PANEL_COLUMNS
)


def panel(spark, rows):
    base = dict.fromkeys(PANEL_COLUMNS)
    base |= {
        "sl_no": 1, "project_code": "612345", "identifier_status": "PRIMARY_IDENTIFIER", "project_name": "Bridge",
        "agency": "A", "state": "Goa", "sector": "Coal", "ministry": "M", "start_date": "01/2025",
        "original_doc": "06/2026", "original_cost": 100.0, "source_file": "f", "source_page": 1,
        "source_section": "s", "extraction_status": "SUCCESS",
    }
    full = [tuple((base | r)[c] for c in PANEL_COLUMNS) for r in rows]
    return typed_panel(identity.with_identity(spark.createDataFrame(full, SCHEMA)))


@pytest.fixture(scope="module")
def feature_panel(spark):
    progress = [20, 30, 45, 50, 60, 70, 80]
    spend = [20, 30, 45, 55, 65, 75, 85]
    return panel(
        spark,
        [
            {
                "report_month": f"2026-{i + 1:02d}", "physical_progress": float(progress[i]), "expenditure": float(spend[i]),
                "revised_cost": 120.0 if i >= 3 else None, "revised_doc": "09/2026" if i >= 3 else None,
            }
            for i in range(7)
        ],
    )


def test_features_hand_values(feature_panel):
    rows = {r.prediction_month: r for r in build_features(feature_panel).collect()}
    assert rows["2026-03"].progress_acceleration_3m == 5
    assert rows["2026-04"].progress_change_3m == 30
    assert rows["2026-03"].effective_target_months_from_cutoff == 3
    assert rows["2026-03"].revised_cost_current is None
    assert rows["2026-04"].cost_revision_count_to_date == 1
    assert rows["2026-04"].months_since_cost_revision == 0
    assert rows["2026-06"].months_since_schedule_revision == 2
    assert rows["2026-04"].last_cost_revision_pct == pytest.approx(0.2)
    assert rows["2026-01"].progress_change_1m is None and rows["2026-01"].months_observed == 1


def test_supervised_row_counts(feature_panel):
    schedule = labels.supervised_table(feature_panel, "future_schedule_later_3m")
    assert schedule.count() == 4
    assert schedule.where("prediction_month = '2026-05'").count() == 0
    assert labels.supervised_table(feature_panel, "future_cost_increase_5pct_6m").count() == 1


def test_features_do_not_see_the_future(feature_panel):
    assert features.leaking_rows(feature_panel, "2026-04").count() == 0


def test_duplicate_months_are_refused(spark, feature_panel):
    twice = feature_panel.unionByName(feature_panel.where("report_month = '2026-02'"))
    with pytest.raises(Exception, match="duplicate entity-month"):
        build_features(twice).collect()


def test_gap_separates_exact_lag_from_previous_row(spark):
    rows = panel(
        spark,
        [
            {"report_month": "2026-01", "physical_progress": 10.0, "revised_cost": 100.0},
            {"report_month": "2026-03", "physical_progress": 30.0, "revised_cost": 150.0},
        ],
    )
    last = build_features(rows).where("prediction_month = '2026-03'").first()
    assert last.progress_change_1m is None
    assert last.cost_revision_count_to_date == 1


@pytest.fixture(scope="module")
def label_panel(spark):
    ends = {1: "04/2026", 2: "04/2026", 3: "06/2026", 4: "06/2026", 7: "06/2026"}
    costs = {1: 100.0, 2: 100.0, 3: 100.0, 4: 106.0, 7: 106.0}
    return panel(
        spark,
        [
            {"report_month": f"2026-{m:02d}", "original_doc": ends[m], "revised_cost": costs[m], "physical_progress": 1.0}
            for m in ends
        ],
    )


def test_labels_need_the_exact_endpoint(label_panel):
    schedule = column(labels.label_table(label_panel, "future_schedule_later_3m"), "label", "prediction_month")
    assert schedule["2026-01"] == 1
    cost = column(labels.label_table(label_panel, "future_cost_increase_3m"), "label", "prediction_month")
    assert "2026-02" not in cost
    five = column(labels.label_table(label_panel, "future_cost_increase_5pct_6m"), "label", "prediction_month")
    assert five["2026-01"] == 1


def test_label_accounting_adds_up(label_panel):
    for r in labels.label_accounting(label_panel).collect():
        assert r.eligible_rows + r.unknown_rows == 5
        assert r.positive_rows + r.negative_rows == r.eligible_rows


def test_first_later_change(label_panel):
    rows = {r.prediction_month: r for r in labels.first_later_change(label_panel, 3, 1).collect()}
    assert (rows["2026-01"].label, rows["2026-01"].first_change_month) == (1, "2026-03")
    assert rows["2026-04"].first_change_month == ""


def test_history_profile(label_panel):
    row = one(history.build_history(label_panel))
    assert (row.number_of_months, row.consecutive_months, row.gaps) == (5, 4, 2)
    assert (row.months_before_first_revision, row.months_before_last_revision) == (2, 3)
    assert (row.eligible_cutoffs_3m, row.eligible_cutoffs_6m) == (2, 1)


def test_modal_value_takes_latest_on_tie(spark):
    rows = panel(
        spark,
        [
            {"report_month": "2026-01", "state": "Goa"}, {"report_month": "2026-02", "state": "Bihar"},
            {"report_month": "2026-03", "state": " "},
        ],
    )
    got = one(master.build_master(rows))
    assert got.state == "Bihar" and got.field_conflicts == "state:2" and got.months_observed == 3


def test_identity_rules(spark):
    rows = panel(
        spark,
        [
            {"report_month": "2026-01", "sl_no": 1},
            {"report_month": "2026-01", "sl_no": 2, "project_code": None, "legacy_ocms_code": "N1234567"},
            {"report_month": "2026-01", "sl_no": 3, "project_code": None, "project_name": "Work (612345)"},
            {"report_month": "2026-01", "sl_no": 4, "project_code": None, "identifier_status": "SOURCE_MISSING_ID"},
            {"report_month": "2026-01", "sl_no": 5, "project_code": None},
        ],
    )
    got = column(rows, "identifier_classification", "sl_no")
    assert list(got.values()) == [
        "PRIMARY_ID_PRESENT", "ALTERNATE_ID_AVAILABLE", "EXTRACTION_FAILURE", "SOURCE_MISSING_ID", "UNRESOLVED",
    ]
    assert column(rows, "identity_key", "sl_no")[2] == "L:N1234567"


def test_decrease_ignores_a_missing_previous_value(spark):
    rows = panel(
        spark,
        [
            {"report_month": "2026-01", "expenditure": 50.0}, {"report_month": "2026-02", "expenditure": None},
            {"report_month": "2026-03", "expenditure": 10.0}, {"report_month": "2026-05", "expenditure": 5.0},
        ],
    )
    drops = [(r.report_month, r.field) for r in integrity.decreases(rows).collect()]
    assert drops == [("2026-05", "expenditure")]


def test_reappearance_uses_published_months(spark):
    rows = panel(
        spark,
        [
            {"report_month": "2026-01"}, {"report_month": "2026-04"},
            {"report_month": "2026-02", "project_code": "700000"},
        ],
    )
    got = one(integrity.reappearances(rows))
    assert got.missing_months == "2026-02"


def test_batch_gate(spark):
    rows = [{"report_month": "2026-08", "physical_progress": 50.0, "expenditure": 1.0}]
    clean = identity.enrich_panel(panel(spark, rows).select(*PANEL_COLUMNS))
    assert one(history.batch_gate(clean, "2026-08")).validation_status == "VALID"
    assert one(history.batch_gate(clean, "2026-07")).validation_status == "INVALID"
    twice = clean.unionByName(clean)
    assert one(history.batch_gate(twice, "2026-08")).duplicate_project_rows == 2
    worse = clean.withColumns({"expenditure": F.lit(-1.0), "start_date": F.lit("2026"), "physical_progress": F.lit(120.0)})
    row = one(history.batch_gate(worse, "2026-08"))
    assert (row.invalid_numeric_values, row.malformed_dates, row.impossible_progress_values) == (1, 1, 1)
    missing = one(history.batch_gate(clean.drop("sector"), "2026-08"))
    assert missing.missing_columns == "sector" and missing.validation_status == "INVALID"


def test_quality_flags(spark):
    rows = panel(
        spark,
        [
            {"report_month": "2026-01", "physical_progress": 120.0, "extraction_status": "PARTIAL"},
            {"report_month": "2026-01", "sl_no": 2},
        ],
    ).select(*PANEL_COLUMNS)
    got = column(identity.enrich_panel(rows), "quality_flags", "sl_no")
    assert got[1] == "PARTIAL_EXTRACTION;DUPLICATE_PRIMARY_ID_IN_MONTH;PROGRESS_OUT_OF_RANGE"
    assert got[2] == "DUPLICATE_PRIMARY_ID_IN_MONTH"


def test_holdout_is_refused_when_empty_or_overlapping(spark):
    frame = spark.createDataFrame([("a", "2026-04"), ("b", "2026-05")], "identity_key string, report_month string")
    development, holdout = frame.where("report_month <= '2026-04'"), frame.where("report_month > '2026-04'")
    history.require_separation(development, holdout, "2026-04", "2026-05")
    with pytest.raises(ValueError, match="EMPTY_HOLDOUT"):
        history.require_separation(development, holdout.limit(0), "2026-04", "2026-05")
    with pytest.raises(ValueError, match="HOLDOUT_BEFORE_BOUNDARY"):
        history.require_separation(development, development, "2026-04", "2026-05")


def test_ids_of_all_months_are_counted(spark, data):
    from panelwatch.plans import all_queries
    from panelwatch.plans.inputs import customer_panel

    rows = [("Q:" if r.sl_no % 50 == 7 else r.identity_key) for r in customer_panel(spark, data).select("sl_no", "identity_key").collect()]
    known = Counter(i for i in rows if i is not None and i != "Q:")
    got = one(all_queries()["id_quality"](spark, data))
    assert (got.missing_ids, got.malformed_ids) == (rows.count(None), rows.count("Q:"))
    assert got.duplicate_project_rows == sum(n for n in known.values() if n > 1)
    assert got.duplicate_project_ids == sum(n > 1 for n in known.values())


def test_each_month_is_valid_for_itself_alone(spark, data):
    from panelwatch.plans import all_queries
    from panelwatch.plans.inputs import customer_panel

    months = Counter(r.report_month for r in customer_panel(spark, data).select("report_month").collect())
    got = all_queries()["reporting_period_check"](spark, data).collect()
    assert len(got) == 2 * len(months) > 2
    for r in got:
        own = r.batch == r.expected
        assert (r.rows, r.other_month_rows, r.reporting_period_valid) == (months[r.batch], 0 if own else months[r.batch], own)


def test_the_boundary_guard_refuses_the_unfiltered_rows(spark, data):
    from panelwatch.plans.inputs import TARGET, supervised

    rows = supervised(spark, data)
    assert rows.where("prediction_month > '2026-04'").count() > 0
    with pytest.raises(Exception, match="past the labelled boundary"):
        splits.labelled_scope(rows, TARGET, "2026-04").collect()


def test_fold_bounds_have_an_embargo():
    assert splits.fold_bounds()[0] == ("2025-07", "2025-07", "2025-11")
    assert splits.fold_bounds()[-1] == ("2025-07", "2025-12", "2026-04")


def test_unknown_targets_are_refused(spark):
    frame = spark.createDataFrame([("a", "2025-08", None)], "identity_key string, prediction_month string, y int")
    with pytest.raises(Exception, match="unknown values"):
        splits.with_split(frame, "y", "schedule").collect()


def test_month_past_the_boundary_is_refused(spark):
    frame = spark.createDataFrame([("a", "2026-05", 1)], "identity_key string, prediction_month string, y int")
    with pytest.raises(Exception, match="past the labelled boundary"):
        splits.labelled_scope(frame, "y", "2026-04").collect()
