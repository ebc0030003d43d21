"""What queries read: raw tables once, and what they have written after that."""

import io
from contextlib import redirect_stdout

import pytest

from panelwatch.operators import records
from panelwatch.plans import all_queries, model_queries
from panelwatch.plans.text_queries import _supplier_lines


def plan(frame) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        frame.explain("simple")
    return out.getvalue()


def test_period_routing_reads_the_orders_once(spark, data):
    assert plan(all_queries()["period_routing"](spark, data)).count("orders.parquet") == 1


def test_printed_totals_need_no_windows(spark, data):
    # only the panel's own
    assert plan(records.printed_totals(_supplier_lines(spark, data))).count("Window") == plan(_supplier_lines(spark, data)).count("Window")


@pytest.mark.parametrize("query", ["header_carry_forward", "header_carry_forward_documents", "record_segmentation", "extracted_records"])
def test_lines_are_classified_once(spark, data, query):
    found = plan(all_queries()[query](spark, data))
    assert "lineitem.parquet" not in found and "documents.parquet" not in found


@pytest.mark.parametrize("query", ["slice_robustness_verdict", "calibration_verdict", "entity_disjoint_calibration"])
def test_verdicts_read_stored_predictions(spark, data, query, monkeypatch):
    from panelwatch.plans import inputs, metric_queries

    wide = []

    def noted(df, name, *partition_by):
        wide.append(len(df.columns))
        return written(df, name, *partition_by)

    written = inputs.written
    monkeypatch.setattr(inputs, "written", noted)
    monkeypatch.setattr(metric_queries, "written", noted)
    assert "lineitem.parquet" not in plan(all_queries()[query](spark, data))
    assert max(wide) < 15


def test_fills_are_fitted_on_written_rows(spark, data, monkeypatch):
    seen = []
    fit = model_queries.ml.fit_imputation
    monkeypatch.setattr(model_queries.ml, "fit_imputation", lambda train, features: seen.append(plan(train)) or fit(train, features))
    all_queries()["imputation_fills"](spark, data).collect()
    assert len(seen) == 1 and "lineitem.parquet" not in seen[0]


def test_months_are_folded_from_a_narrow_panel(spark, data, monkeypatch):
    from panelwatch.plans import feature_queries

    seen = []
    fold = feature_queries.feature_state.fold
    monkeypatch.setattr(feature_queries.feature_state, "fold", lambda state, batch, month: seen.append(len(batch.columns)) or fold(state, batch, month))
    all_queries()["arriving_month_features"](spark, data).count()
    assert len(seen) == 6 and max(seen) < 20
