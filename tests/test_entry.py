import re

import __spark_entry__ as entry
from panelwatch.plans import all_queries
from tests.conftest import DATA


def test_every_equivalent_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 190


def test_readme_names_only_registered_queries_and_all_of_them():
    text = open("README.md", encoding="utf-8").read().split("## Coverage")[1].split("## Decisions")[0]
    named = set()
    for row in text.splitlines():
        if row.startswith("| ") and not row.startswith("| rows"):
            named |= set(re.findall(r"`([a-z0-9_]+\*?)`", row.rsplit("|", 2)[1]))
    queries = set(all_queries())
    covered = set()
    for name in named:
        matches = {q for q in queries if q.startswith(name[:-1])} if name.endswith("*") else {name} & queries
        assert matches, name
        covered |= matches
    assert covered == queries


def test_flagship_query(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["prediction_month", "eligible_rows", "positive_rows", "positive_rate", "projects"]
    assert frame.count() > 0


def test_plans_stay_pruned_and_shuffle_once_for_labels(spark):
    from panelwatch.operators.labels import supervised_table
    from panelwatch.plans.inputs import TARGET, supplier_panel

    plan = supervised_table(supplier_panel(spark, DATA), TARGET)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(identity_key") == 1
    assert "BatchEvalPython" not in plan and "CartesianProduct" not in plan
    scan = next(part for part in plan.split("FileScan parquet") if "l_suppkey" in part[:200])
    assert "l_tax" not in scan[:300]
