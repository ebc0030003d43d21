import hashlib

import pytest
from pyspark.sql import functions as F

from panelwatch.operators import digests, profile
from panelwatch.sources import digest_source, month_store, reports
from tests.conftest import DATA, column, one

FILES = {
    "2026-04/Cost-Wise-Report.csv": '"Cost Wise Details"\n\n"","₹ 37,12,662","₹ 42,78,402","₹ 20,36,107"',
    "2026-04/State-Wise-Report.csv": '"State Wise Details"\n\n"1","Goa","2","542567.88 (667045.23)","431680.03"\n"2","Bihar ","1","5","x"\n"short","row"',
    "2026-04/Unknown-Report.csv": "1,2\n3,4",
    "undated/State-Wise-Report.csv": '"State Wise Details"\n"1","Goa","2","1 (2)","3"',
}


def folder(tmp_path):
    for name, text in FILES.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    return str(tmp_path)


def test_discovery_and_routing(spark, tmp_path):
    root = folder(tmp_path)
    found = {(r.dataset_type, r.report_month) for r in reports.discover_files(spark, root).collect()}
    assert ("Cost-Wise-Report", "2026-04") in found and ("State-Wise-Report", None) in found
    counts = column(reports.routing_counts(reports.read_text_files(spark, root)), "files", "routing")
    assert counts == {"PROCESSED": 2, "SKIPPED_UNKNOWN_TYPE": 1, "SKIPPED_NO_MONTH": 1}


def test_a_table_in_parts_is_one_entry(spark, tmp_path):
    for name in ("2026-01/a.csv/part-0.csv", "2026-01/a.csv/part-1.csv", "2026-01/a.csv/_SUCCESS", "2026-01/b.csv", "c.csv/x=1/part-0.csv", "d.parts/e.csv"):
        path = tmp_path / "in.csv" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("12345")
    for root in (str(tmp_path / "in.csv"), f"file://{tmp_path}/in.csv/"):
        found = [(r.file_name, r.dataset_type, r.report_month, r.size_bytes) for r in reports.discover_files(spark, root).collect()]
        assert sorted(found) == [("a.csv", "a", "2026-01", 10), ("b.csv", "b", "2026-01", 5), ("c.csv", "c", None, 5), ("e.csv", "e", None, 5)]


def test_typed_tables_and_ordered_output(spark, tmp_path):
    root = folder(tmp_path / "in")
    tables = reports.process_reports(reports.read_text_files(spark, root))
    cost = one(tables["cost_overview_monthly"])
    assert (cost.original_cost_crores, cost.revised_cost_crores, cost.expenditure_crores) == (3712662.0, 4278402.0, 2036107.0)
    states = {r.state: r for r in tables["state_monthly"].collect()}
    assert set(states) == {"Goa", "Bihar"}
    assert states["Goa"].revised_cost_crores == 667045.23 and states["Bihar"].expenditure_crores is None
    reports.write_reports(tables, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out" / "state_monthly"), header=True)
    assert back.count() == 2


def test_quotes_and_ragged_rows(spark):
    content = '"Title, with comma"\n\n"a ""b""",,"c,d"\nplain\n'
    files = spark.createDataFrame([("x/2026-01/T.csv", content)], "path string, content string")
    rows = reports.read_titled_csv(files).orderBy("row_number").collect()
    assert rows[0].title == "Title, with comma"
    assert [r.fields for r in rows] == [['a "b"', "", "c,d"], ["plain"]]


def test_numeric_first_line_is_data_for_the_audit(spark):
    files = spark.createDataFrame([("x/T.csv", "12.5\n13")], "path string, content string")
    assert reports.read_titled_csv(files).count() == 1
    assert reports.read_titled_csv(files, refuse_numeric_title=True).count() == 2


def test_manifest(spark, tmp_path):
    root = folder(tmp_path)
    manifest = reports.file_manifest(spark, root, "*.csv")
    shas = {r.sha256 for r in manifest.collect()}
    assert shas == {hashlib.sha256(t.encode()).hexdigest() for t in FILES.values()}
    assert one(reports.manifest_summary(manifest, 4)).intact
    assert not one(reports.manifest_summary(manifest, 5)).intact


def test_a_file_beyond_the_chunk_and_beyond_2_gb_is_streamed(spark, tmp_path):
    import os

    big = tmp_path / "big.bin"
    with open(big, "wb") as file:  # sparse: holds no disk
        file.truncate((1 << 31) + 4096)
        file.seek(1 << 31)
        file.write(b"end")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "small.bin").write_bytes(os.urandom(1000))
    (tmp_path / "_hidden.bin").write_bytes(b"x")
    state = hashlib.sha256()
    with open(big, "rb") as file:
        while data := file.read(1 << 24):
            state.update(data)
    expected = {"big.bin": (big.stat().st_size, state.hexdigest())}
    small = (tmp_path / "sub" / "small.bin").read_bytes()
    expected["small.bin"] = (1000, hashlib.sha256(small).hexdigest())
    for root in (str(tmp_path), f"file://{tmp_path}"):
        found = {r.file_name: (r.size_bytes, r.sha256) for r in reports.file_manifest(spark, root, "*.bin").collect()}
        assert found == expected
    chunked = reports.file_manifest(spark, str(tmp_path / "sub"), "*.bin", chunk="7", taskBytes="1").collect()
    assert chunked[0].sha256 == expected["small.bin"][1]


def test_files_are_packed_by_size_and_other_stores_fall_back(spark, tmp_path):
    files = [("a", 5), ("b", 100), ("c", 5), ("d", 60), ("e", 0)]
    parts = digest_source.packed(files, 65)
    assert sorted(x for p in parts for x in p) == ["a", "b", "c", "d", "e"] and parts[0] == ("b",)
    assert all(len(p) == 1 or sum(dict(files)[x] for x in p) <= 65 for p in parts)
    assert not digest_source.reachable("viewfs://store/in") and digest_source.reachable("file:/tmp")
    (tmp_path / "none").mkdir()
    assert reports.file_manifest(spark, str(tmp_path / "none")).count() == 0


def test_a_delivered_month_replaces_itself_and_nothing_else(spark, tmp_path):
    store = str(tmp_path / "store")
    schema = "report_month string, key string, x double"

    def delivery(*rows):
        return spark.createDataFrame(list(rows), schema)

    def changes(frame):
        return {r.report_month: r.change for r in month_store.store_months(frame, store, ("key",)).collect()}

    def stored():
        return sorted(tuple(r) for r in month_store.read_months(spark, store, delivery().schema).collect())

    def files():
        return {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}

    first = [("2026-01", "a", 1.0), ("2026-01", "b", None), ("2026-03", "a", 2.0)]
    assert changes(delivery(*first)) == {"2026-01": "NEW", "2026-03": "NEW"} and stored() == sorted(first)
    before = files()
    assert changes(delivery(*first[::-1]).repartition(3)) == {"2026-01": "UNCHANGED", "2026-03": "UNCHANGED"}
    assert files() == before
    again = [("2026-03", "a", 2.5), ("2026-03", "c", 9.0)]
    assert changes(delivery(*again)) == {"2026-03": "REPLACED"}
    assert stored() == sorted(first[:2] + again)
    assert {p: t for p, t in files().items() if "2026-01" in str(p)} == {p: t for p, t in before.items() if "2026-01" in str(p)}
    late = [("2026-02", "a", 7.0)]
    assert changes(delivery(*late, *again)) == {"2026-02": "NEW", "2026-03": "UNCHANGED"}
    assert stored() == sorted(first[:2] + again + late)
    kept = {r.report_month: r.rows for r in month_store.manifest(spark, store).collect()}
    assert kept == {"2026-01": 2, "2026-02": 1, "2026-03": 2}
    with pytest.raises(Exception, match="without a month"):
        changes(delivery((None, "a", 1.0)))


def test_reports_delivered_month_by_month_are_stored_like_all_at_once(spark, tmp_path):
    from panelwatch.sources.panel import supplier_month

    panel = supplier_month(spark, DATA).where("report_month LIKE '2021-1%'")
    files = reports.report_files_from_panel(panel)
    whole = reports.process_reports(files)
    reports.write_reports(whole, str(tmp_path / "once"))
    for month in ("2021-12", "2021-10", "2021-11"):
        part = reports.process_reports(files.where(F.col("path").contains(month) | (F.col("path").contains("undated") & (month == "2021-12"))))
        reports.write_reports(part, str(tmp_path / "bit"))
    once, bit = (reports.read_reports(spark, str(tmp_path / f), whole) for f in ("once", "bit"))
    for name in whole:
        rows = [sorted(map(str, t[name].collect())) for t in (whole, once, bit)]
        assert rows[0] == rows[1] == rows[2]
    assert whole["state_monthly"].count() > 10


def test_ordered_digest_is_that_of_a_plain_loop(spark):
    rows = [("g" if i % 3 else None, i * 7 % 1000, f"row {i}") for i in range(700)]
    frame = spark.createDataFrame(rows, "g string, at int, body string")
    for leaf in (2, 10, 1024):
        expected = {
            g: digests.plain_digest([b for _, b in sorted((at, b) for x, at, b in rows if x == g)], leaf) for g in ("g", None)
        }
        for parts in (1, 7):
            found = digests.ordered_digest(frame.repartition(parts), ["g"], [F.col("at")], F.col("body"), leaf)
            assert {r.g: r.digest for r in found.collect()} == expected
    # two rows that change places change the digest
    swapped = frame.withColumn("at", F.when(F.col("at") == 7, 14).when(F.col("at") == 14, 7).otherwise(F.col("at")))
    found = digests.ordered_digest(swapped, ["g"], [F.col("at")], F.col("body"))
    assert {r.g: r.digest for r in found.collect()}["g"] != expected["g"]
    assert digests.ordered_digest(frame.limit(0), ["g"], [F.col("at")], F.col("body")).count() == 0


def test_positions_count_through_partitions(spark):
    rows = spark.range(5000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v")).repartition(9)
    found = digests.positions(rows, ["g"], [F.col("v")]).collect()
    assert all(r.position == r.v // 2 for r in found) and len(found) == 5000


def test_fixed_precision_and_period_sinks(spark, tmp_path):
    from panelwatch.operators.identity import report_layout

    frame = spark.createDataFrame([("2025-04", 1, "QPISR_a", 0.1234567), ("2025-07", 2, "b", None)],
                                  "report_month string, sl_no int, source_file string, x double")
    reports.write_fixed_csv(frame, str(tmp_path / "fixed"))
    back = spark.read.csv(str(tmp_path / "fixed"), header=True).orderBy("sl_no").collect()
    assert [r.x for r in back] == ["0.123457", None]
    reports.write_periods(frame, report_layout(F.col("report_month"), F.col("source_file")), str(tmp_path / "periods"))
    assert spark.read.parquet(str(tmp_path / "periods" / "project_quarterly")).count() == 1
    assert spark.read.parquet(str(tmp_path / "periods" / "project_monthly")).count() == 1


def test_report_text_sink(spark, tmp_path):
    lines = spark.createDataFrame([(1, "b", "row b"), (0, "0", "title"), (1, "a", "row a")], "section int, sort_key string, line string")
    reports.write_report_text(lines, str(tmp_path / "report"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "report")).collect()) == ["row a", "row b", "title"]


def test_profile_of_a_ragged_file(spark):
    content = '"Project Report"\n"1","₹ 5","0-10"\n"2","₹ 6"\n"2","₹ 6"\n'
    files = spark.createDataFrame([("x/2026-01/Phys.csv", content)], "path string, content string")
    rows = reports.read_titled_csv(files, refuse_numeric_title=True)
    got = {r.column_index: r for r in profile.file_columns(rows).collect()}
    assert (got[0].inferred_dtype, got[1].inferred_dtype, got[2].inferred_dtype) == ("numeric", "currency", "progress_range")
    assert (got[2].non_null_count, got[2].null_count, got[1].samples) == (1, 2, "₹ 5 | ₹ 6")
    assert one(profile.file_shape(rows)).duplicate_rows == 1


def long_of(spark, columns):
    rows = [(k, name, v) for name, values in columns.items() for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "row_number long, column_name string, value string").repartition(3)


def test_bitmaps_count_what_values_count(spark):
    columns = {
        "ids": [str(i - 400) for i in range(900)] * 2,
        "sparse": [str(i * 10**14 * (-1) ** i) for i in range(300)],
        "edges": ["0", "-0", "007", "7", "32768", "32769", "-32768", "-32767", "999999999999999999", "1000000000000000000", "+5", " 5", "5"],
        "mixed": [str(i % 4) if i % 3 else f"x{i % 7}" for i in range(500)],
        "same first": ["1"] * 1500 + [str(i % 9) for i in range(100)],
        "₹": ["₹ 5", "₹ 5", "1 (2)", "1-2"],
    }
    long = long_of(spark, columns)
    want = {tuple(r) for r in profile.column_profile(long, ["column_name"]).select("column_name", "non_null_count", "unique_count", "inferred_dtype", "samples").collect()}
    got = {tuple(r) for r in profile.table_profile(long, ["column_name"]).select("column_name", "non_null_count", "unique_count", "inferred_dtype", "samples").collect()}
    assert got == want and len(got) == len(columns)
    assert profile.table_profile(long.limit(0), ["column_name"]).count() == 0


def shuffled_bytes(frame):
    """Bytes that the exchanges of an executed plan have written."""
    frame.collect()
    total, nodes = 0, [frame._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            nodes.append(node.plan())
        metrics = node.metrics()
        if metrics.contains("shuffleBytesWritten"):
            total += metrics.get("shuffleBytesWritten").get().value()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_bitmaps_shuffle_less_of_a_million_integers(spark):
    long = spark.range(1_000_000).select(F.col("id").alias("row_number"), F.lit("key").alias("column_name"), F.col("id").cast("string").alias("value"))
    plain, bitmaps = profile.column_profile(long, ["column_name"]), profile.table_profile(long, ["column_name"])
    big, small = shuffled_bytes(plain), shuffled_bytes(bitmaps)
    assert 0 < small < big / 5
    assert plain.collect() == bitmaps.collect()
