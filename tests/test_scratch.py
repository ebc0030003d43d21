"""Intermediate tables live in one folder per application and can be removed."""

from pathlib import Path

import pytest

from panelwatch import session


@pytest.fixture()
def shared(tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda spark: f"file://{tmp_path}")
    return tmp_path


def folders(shared: Path) -> list[str]:
    return sorted(p.name for p in shared.glob("panelwatch-*/*"))


def test_tables_are_in_one_folder_and_are_discarded_one_by_one(spark, shared):
    kept, gone = (session.written(spark.range(5), name) for name in ("kept", "gone"))
    assert [f.split("-")[0] for f in folders(shared)] == ["gone", "kept"]
    session.discard(gone)
    assert [f.split("-")[0] for f in folders(shared)] == ["kept"] and kept.count() == 5


def test_scratch_of_a_run_is_removed_and_other_files_stay(spark, shared):
    (shared / "other").mkdir()
    session.written(spark.range(3), "a")
    session.written(spark.range(3).selectExpr("id", "id % 2 AS part"), "b", "part")
    session.remove_scratch(spark)
    assert folders(shared) == [] and (shared / "other").exists()
    session.remove_scratch(spark)
    assert session.written(spark.range(2), "again").count() == 2


def test_an_iteration_leaves_only_what_its_result_reads(spark, shared):
    from panelwatch.operators import digests
    from pyspark.sql import functions as F

    rows = spark.range(50).withColumn("g", F.lit(1))
    digests.ordered_digest(rows, ["g"], [F.col("id")], F.col("id").cast("string"), 4).collect()
    left = [f.split("-")[0] for f in folders(shared)]
    assert left.count("ranged") <= 1 and left.count("digests") <= 3
