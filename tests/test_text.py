from pyspark.sql import functions as F

from panelwatch.operators import layout, lines, records
from tests.conftest import one

PAGE_1 = """MARCH 2026
Table 6: All Ongoing Projects
Sl.No Project Name (Agency) State
Ministry of Civil Aviation
Aviation & Aviation Infrastructure
Construction of New Domestic Terminal Building
including maintenance at Kadapa Airport
03/2023 01/2026 265.91
1 (Airport Authority of India [AAI]) Andhra Pradesh 120.19 60
(612786) (01/2024) (07/2026) (265.91)
(N04000106) (-)
297700 to Km 308729 widening Goa 7 8
Runway works 06/2020 09/2022 611.8
2 Bihar 523.14 87.2
(612787) (-) (-) (-)
Total (2)
Page 54"""
PAGE_2 = """Table 6: All Ongoing Projects
Stray text before a total
Total (0)
Coal
Mine access
across the page end 11/2021 10/2026 12.5
3 Odisha 4 5.5
(-) (05/2022) (-) (-)
(-) (10550)
Page 55"""


def page_frame(spark, *texts, name="FlashReport.pdf"):
    return spark.createDataFrame([(name, i + 54, t) for i, t in enumerate(texts)], "file string, page int, text string")


def extracted(spark, check=True):
    pages = page_frame(spark, PAGE_1, PAGE_2)
    return {r.sl_no: r for r in records.extract_records(lines.page_lines(pages), check).collect()}


def test_records_across_pages(spark):
    rows = extracted(spark)
    assert sorted(rows) == [1, 2, 3]
    first = rows[1]
    assert first.project_name == "Construction of New Domestic Terminal Building including maintenance at Kadapa Airport"
    assert (first.agency, first.state) == ("Airport Authority of India [AAI]", "Andhra Pradesh")
    assert (first.date_of_approval, first.original_doc, first.start_date, first.revised_doc) == (
        "03/2023", "01/2026", "01/2024", "07/2026",
    )
    assert (first.original_cost, first.revised_cost, first.expenditure, first.physical_progress) == (265.91, 265.91, 120.19, 60.0)
    assert (first.project_code, first.legacy_ocms_code, first.identifier_status) == ("612786", "N04000106", "PRIMARY_IDENTIFIER")
    assert (first.sector, first.ministry) == ("Aviation & Aviation Infrastructure", "Ministry of Civil Aviation")
    third = rows[3]
    assert third.project_code is None and third.identifier_status == "UNKNOWN" and third.extraction_status == "PARTIAL"
    assert third.project_name == "Mine access across the page end" and third.sector == "Coal"
    assert third.ministry == "Ministry of Civil Aviation" and third.source_page == 55
    assert third.revised_cost is None


def test_out_of_sequence_serial_becomes_text(spark):
    rows = extracted(spark)
    assert rows[2].project_name.endswith("Runway works") and rows[2].expenditure == 523.14
    assert 297700 in extracted(spark, check=False)


def test_totals_and_completeness(spark):
    pages = page_frame(spark, PAGE_1.replace("297700 to Km 308729 widening Goa 7 8\n", ""))
    row = one(records.printed_totals(lines.page_lines(pages)))
    assert (row.printed_total, row.records, row.highest_serial, row.reconciled) == (2, 2, 2, True)
    serials = spark.createDataFrame([("f", 1), ("f", 2), ("f", 4), ("f", 4)], "file string, sl_no long")
    gap = one(records.serial_completeness(serials))
    assert (gap.missing_serials, gap.repeated_serials, gap.complete) == (1, 1, False)


def test_one_file_over_many_page_blocks(spark):
    texts = [("f", p * 700, f"Coal\nMine {p} 01/2020 02/2030 5.5\n{p} Goa 1 2\n(61{p:04d})" if p == 1 else
              f"Mine {p} 01/2020 02/2030 5.5\n{p} Goa 1 2\n(61{p:04d})") for p in range(1, 8)]
    pages = spark.createDataFrame(texts, "file string, page int, text string")
    rows = records.extract_records(lines.page_lines(pages)).orderBy("sl_no").collect()
    assert [r.sl_no for r in rows] == list(range(1, 8))
    assert {r.sector for r in rows} == {"Coal"}


def cell(spark, function, text):
    return one(spark.createDataFrame([(text,)], "c string").select(function(F.col("c")).alias("v"))).v


def test_cells_keep_anticipated_values_apart(spark):
    dates = cell(spark, records.printed_dates, "3/2025\n(N.A.)\n{12/2025}")
    assert (dates.original, dates.revised) == ("03/2025", None)
    costs = cell(spark, records.printed_costs, "235.72\n(N.A.)\n{235.72}")
    assert (costs.original, costs.revised) == (235.72, None)
    both = cell(spark, records.printed_costs, "417.23\n(707.73)\n{707.73}")
    assert (both.original, both.revised) == (417.23, 707.73)
    project = cell(spark, records.project_cell, "LONG PROJECT NAME (PHASE II)\n(NHAI)\n(N24002208)")
    assert (project.name, project.agency, project.alternate_id) == ("LONG PROJECT NAME (PHASE II)", "NHAI", "N24002208")


def test_nearest_marker_tolerates_a_slightly_lower_label(spark):
    serials = spark.createDataFrame([("f", 1, 10.0, 1), ("f", 1, 30.0, 2), ("f", 2, 5.0, 3)], "file string, page int, top double, serial long")
    markers = spark.createDataFrame([("f", 1, 17.0, "A"), ("f", 1, 39.0, "B")], "file string, page int, top double, label string")
    got = {r.serial: r.label for r in lines.nearest_marker(serials, markers).collect()}
    assert got == {1: "A", 2: "A", 3: None}


def test_layout_audit(spark):
    audited = layout.audit_layouts(page_frame(spark, PAGE_1, PAGE_2))
    row = one(audited)
    assert row.report_type == "MONTHLY" and row.table_label == "Table 6"
    assert row.serial_lines == 3 and row.continued_pages == 1
    assert row.agency_layout == "MIXED" and row.risk_level == "MEDIUM"
    quarterly = one(layout.audit_layouts(page_frame(spark, PAGE_1, name="QPISR_1.pdf")))
    assert quarterly.layout_class == "QUARTERLY_FORMAT" and quarterly.compatibility == "PARSER_NEEDS_NEW_HANDLER"


def test_section_pages(spark):
    row = one(lines.section_pages(page_frame(spark, "cover", PAGE_1, PAGE_2)))
    assert (row.first_page, row.last_page, row.section_pages) == (55, 56, 2)


def sequential(serials):
    last, kept = None, []
    for serial in serials:
        if last is None or abs(serial - last) <= max(200, last * 0.5):
            kept.append(serial)
            last = serial
    return kept


def test_serials_are_judged_as_if_read_in_order(spark):
    import random

    rng = random.Random(2)
    cases = [
        [10, 297700, 297710, 11, 12, 13], [10, 297700, 297710, 11, 12, 13, 14, 15, 16],
        [10, 297700, 297710, 297720, 11, 12, 13, 14], [10, 297700, 5000, 297710, 5010, 11, 12],
        [1, 900, 2, 900, 3, 900, 4], [5], [297700, 1, 2, 3],
    ]
    for _ in range(6):
        case, serial = [], 1
        for _ in range(60):
            case += [rng.choice([serial + 150_000, 9000 + rng.randint(0, 50)]) for _ in range(rng.choice([0, 0, 0, 1, 2, 3, 4]))]
            case.append(serial)
            serial += 1
        cases.append(case)
    rows = [(f"f{n}", i // 7 + 1, i % 7, f"{s} Bihar 10.5 60") for n, case in enumerate(cases) for i, s in enumerate(case)]
    frame = lines.classified(spark.createDataFrame(rows, "file string, page long, position int, line string"))
    got = {}
    for r in records.accepted_serials(frame).orderBy("file", "page", "position").collect():
        got.setdefault(r.file, []).append(r.serial)
    assert got == {f"f{n}": sequential(case) for n, case in enumerate(cases)}
    assert got["f0"] == [10, 11, 12, 13]


def test_serials_of_many_page_blocks_need_few_passes(spark, monkeypatch):
    """Blocks that begin with false serials, and blocks behind a jump that nothing bridges."""
    import random

    rng = random.Random(5)
    cases = []
    for _ in range(3):
        case, serial = [], 1
        for _ in range(40):
            case += [rng.choice([serial + 150_000, 9000 + rng.randint(0, 50)]) for _ in range(rng.choice([0, 1, 4, 9]))]
            case.append(serial)
            serial += 1
        cases.append(case)
    rows = [(f"f{n}", i * lines.PAGES_PER_BLOCK // 6, i % 2, f"{s} Bihar 10.5 60") for n, case in enumerate(cases) for i, s in enumerate(case)]
    frame = lines.classified(spark.createDataFrame(rows, "file string, page long, position int, line string"))
    got = {}
    for r in records.accepted_serials(frame).orderBy("file", "page", "position").collect():
        got.setdefault(r.file, []).append(r.serial)
    assert got == {f"f{n}": sequential(case) for n, case in enumerate(cases)}

    # Nothing bridges the jump: each of the lines behind it is refused by the line before the jump.
    case, tables = [1, 2] + list(range(90_000, 90_060)) + [3], []

    def counted(df, name, *partition_by):
        tables.append(name)
        return written(df, name, *partition_by)

    written = records.written
    monkeypatch.setattr(records, "written", counted)
    rows = [("f", i // 25 * lines.PAGES_PER_BLOCK, i, f"{s} Bihar 10.5 60") for i, s in enumerate(case)]
    frame = lines.classified(spark.createDataFrame(rows, "file string, page long, position int, line string"))
    assert sorted(r.serial for r in records.accepted_serials(frame).collect()) == [1, 2, 3]
    assert len(tables) < 10


def test_older_layout_prints_the_start_on_the_serial_line(spark):
    text = "Some road project\n1 (Agency One) Bihar 10/2018 1046.48 94\n(100.50)\n2 Assam, Bihar 01/2020 5 60"
    pages = spark.createDataFrame([("f", 1, text)], "file string, page long, text string")
    rows = {r.sl_no: r for r in records.extract_records(lines.page_lines(pages), layout="OLD_FORMAT_A").collect()}
    assert (rows[1].start_date, rows[1].state, rows[1].agency) == ("10/2018", "Bihar", "Agency One")
    assert (rows[1].expenditure, rows[1].physical_progress) == (1046.48, 94.0)
    assert (rows[2].start_date, rows[2].state) == ("01/2020", "Assam, Bihar,")
    newer = {r.sl_no: r for r in records.extract_records(lines.page_lines(pages)).collect()}
    assert newer[1].start_date is None


def test_boilerplate_of_another_source_is_passed_down(spark):
    pages = spark.createDataFrame([("f", 1, "(SOURCE SYSTEM)\nA project\n1 Bihar 5.5 60")], "file string, page long, text string")
    own = lines.BOILERPLATE + (r"\(SOURCE SYSTEM\)",)
    rows = records.extract_records(lines.page_lines(pages), boilerplate=own).collect()
    assert [r.project_name for r in rows] == ["A project"]
