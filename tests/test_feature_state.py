"""Months folded one by one give the features of the whole history."""

import random

import pytest
from pyspark.sql import functions as F

from panelwatch.operators import feature_state, features
from panelwatch.plans.inputs import customer_panel
from panelwatch.sources.panel import typed_panel
from tests.conftest import DATA

COLUMNS = (
    "report_month string, project_code string, identity_key string, agency string, ministry string, sector string, state string, "
    "date_of_approval string, start_date string, original_doc string, revised_doc string, original_cost double, revised_cost double, "
    "expenditure double, physical_progress double"
)


def made_panel(spark, seed=4, entities=12, months=14):
    rnd = random.Random(seed)
    rows = []
    for e in range(entities):
        cost, end = 100.0, 30
        for m in range(months):
            if rnd.random() < 0.35:
                continue
            cost += rnd.choice([0, 0, 0.005, 5, -100])
            end += rnd.choice([0, 0, 3])
            rows.append(
                (
                    f"2025-{m + 1:02d}" if m < 12 else f"2026-{m - 11:02d}", str(e), f"P:{e}" if e else "N:0", "a", "m", "s", "t",
                    "01/2020", rnd.choice([None, "03/2021"]), "01/2030", rnd.choice([None, f"0{end % 9 + 1}/2031"]), rnd.choice([100.0, None, 0.0]),
                    rnd.choice([None, cost]), rnd.choice([None, float(m)]), rnd.choice([None, float(rnd.randrange(0, 9)) / 2]),
                )
            )
    return typed_panel(spark.createDataFrame(rows, COLUMNS))


def table(frame):
    rounded = [
        F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in frame.dtypes
    ]
    return sorted(str(sorted(r.asDict().items())) for r in frame.select(*rounded).collect())


def stored(spark, folder, months):
    schema = None
    for month in months:
        part = spark.read.parquet(f"{folder}/features/{month}")
        schema = part if schema is None else schema.unionByName(part)
    return schema


def test_folding_every_month_gives_the_full_build(spark, tmp_path):
    panel = made_panel(spark).cache()
    months = sorted(r[0] for r in panel.select("report_month").distinct().collect())
    for month in months:
        feature_state.advance(panel.where(F.col("report_month") == month), month, str(tmp_path))
    full = features.build_features(panel)
    found = stored(spark, str(tmp_path), months).select(*full.columns)
    assert table(found) == table(full) and found.count() > 60
    # the state read off the history is the folded one
    last = spark.read.parquet(f"{tmp_path}/state/{months[-1]}")
    whole = feature_state.state_of(panel, months[-1]).select(*last.columns)
    assert table(last) == table(whole)


def test_every_month_of_the_sparse_panel_from_its_state(spark, tmp_path):
    panel = customer_panel(spark, DATA).cache()
    months = sorted(r[0] for r in panel.select("report_month").distinct().collect())
    full = features.build_features(panel).cache()
    parts, expected = [], []
    # the state before each month, and the month folded into it, for all months in one plan
    for month, before in list(zip(months[1:], months))[::6]:
        got, _ = feature_state.fold(feature_state.state_of(panel, before), panel.where(F.col("report_month") == month), month)
        parts.append(got.select(*full.columns))
        expected.append(month)
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    assert table(union) == table(full.where(F.col("prediction_month").isin(*expected)))


def test_late_and_mixed_batches_are_refused_and_the_last_month_may_come_again(spark, tmp_path):
    panel = made_panel(spark, 8).cache()
    january, february = (panel.where(F.col("report_month") == m) for m in ("2025-01", "2025-02"))
    feature_state.advance(january, "2025-01", str(tmp_path))
    first = table(feature_state.advance(february, "2025-02", str(tmp_path)))
    assert table(feature_state.advance(february, "2025-02", str(tmp_path))) == first
    with pytest.raises(ValueError, match="too late"):
        feature_state.advance(january, "2025-01", str(tmp_path))
    state = spark.read.parquet(f"{tmp_path}/state/2025-02")
    with pytest.raises(Exception, match="not earlier"):
        feature_state.fold(state, january, "2025-01")[1].collect()
    with pytest.raises(Exception, match="another month"):
        feature_state.fold(feature_state.empty_state(spark), january.union(february), "2025-01")[0].collect()
    with pytest.raises(Exception, match="duplicate entity-month"):
        feature_state.fold(state, panel.where("report_month = '2025-03'").union(panel.where("report_month = '2025-03'")), "2025-03")[0].collect()
