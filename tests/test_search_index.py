"""The gram index returns the rows of a full scan."""

import random

from panelwatch.operators import portfolio, search_index


def made_view(spark, n=300):
    rnd = random.Random(2)
    words = ["Brücke", "ÉCOLE", "road", "Ro", "a", "漢字", "x%_y", "N00000012", "  spaced  ", "İstanbul"]
    rows = [
        (f"p{i}", f"C{i % 50}", " ".join(rnd.choices(words, k=rnd.randrange(4))), rnd.choice([None, "agency"]), rnd.choice([None, "Min"]), None, rnd.choice(["Goa", ""]))
        for i in range(n)
    ]
    rows.append(("empty", None, None, None, None, None, None))
    return spark.createDataFrame(rows, "project_id string, code string, name string, agency string, ministry string, sector string, state string")


def test_same_rows_as_the_full_scan(spark, tmp_path):
    view = made_view(spark)
    folder = str(tmp_path / "index")
    search_index.write_index(view, folder)
    for query in ("a", "ro", "RO", "road", "brücke", "ÉCOLE", "漢", "漢字", "%_", "x%_y", "n00000012 ro", "agency min", "goa", "zzz", "", "  ", "i̇stan", "a a a"):
        want = sorted(r.project_id for r in portfolio.search(view, query).collect())
        found = search_index.indexed_search(view, folder, query)
        assert sorted(r.project_id for r in found.collect()) == want, query
        top = [r.project_id for r in search_index.indexed_search_top(view, folder, query).collect()]
        assert top == [r.project_id for r in portfolio.search_top(view, query).collect()]


def test_only_files_with_the_grams_are_asked_and_repeated_entities_stay(spark, tmp_path):
    view = made_view(spark, 60)
    twice = view.unionByName(view)
    folder = str(tmp_path / "index")
    search_index.write_index(twice, folder)
    assert search_index.indexed_search(twice, folder, "road").count() == portfolio.search(twice, "road").count()
    plan = search_index.candidates(spark, folder, "road")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan
    plan = search_index.candidates(spark, folder, "ro")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(gram,ro)" in plan
    empty = view.limit(0)
    search_index.write_index(empty, str(tmp_path / "none"))
    assert search_index.indexed_search(empty, str(tmp_path / "none"), "road").count() == 0
