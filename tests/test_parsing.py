import pytest
from pyspark.sql import functions as F

from panelwatch.functions import months, numbers, text


def values(spark, function, *inputs):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, x string")
    return [r.y for r in frame.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()]


def test_currency_drops_the_decimal_point_unless_kept(spark):
    assert values(spark, text.parse_currency, "₹ 23,75,332", "12.5", "Rs. 1,200", "", "abc", None) == [
        2375332.0, 125.0, 1200.0, None, None, None,
    ]
    kept = values(spark, lambda c: text.parse_currency(c, keep_decimals=True), "₹ 12.5", "Rs. 1,200.75")
    assert kept == [12.5, 1200.75]


def test_numeric_and_missing_markers(spark):
    assert values(spark, text.parse_numeric, "1,234.5", " 7 ", "-", "NA", "n/a", "--", "", "1x", "NaN") == [
        1234.5, 7.0, None, None, None, None, None, None, None,
    ]


def test_paren_costs(spark):
    rows = values(spark, text.parse_paren_costs, "381959.22 (382705.77)", "12.5", "x (1)")
    assert [(r.original, r.revised) for r in rows] == [(381959.22, 382705.77), (12.5, None), (None, None)]


def test_flexible_months(spark):
    assert values(spark, months.normalise_flexible_month, "10-2013", "(Jun-2023)", "{6/2023}", "N.A.") == [
        "10/2013", "06/2023", "06/2023", None,
    ]


def test_month_dates_and_labels(spark):
    assert values(spark, months.parse_month_date, "01/2024", "6/2024", "13/2024", "1/1/2024", "", None) == [
        2024 * 12 + 1, 2024 * 12 + 6, None, None, None, None,
    ]
    assert values(spark, lambda c: months.month_add(c, 3), "2025-11", "2025-12") == ["2026-02", "2026-03"]
    assert values(spark, months.month_from_path, "a/2026-04/b.csv", "FR_April2025.pdf", "x/2026-13/y") == [
        "2026-04", "2025-04", None,
    ]
    assert values(spark, months.month_from_text, "FLASH REPORT MARCH 2026 page") == ["2026-03"]


def test_trailing_numbers(spark):
    assert values(spark, text.trailing_numbers, "Andhra Pradesh 523.14 87.2", "12 x", "1,200 -3", "", "a 1 b 2") == [
        [523.14, 87.2], [], [1200.0, -3.0], [], [2.0],
    ]
    assert values(spark, text.without_trailing_numbers, "Airport. 06/2020 611.8", "5 6") == ["Airport. 06/2020", ""]


def test_longest_match_prefers_the_longer_word(spark):
    assert values(spark, text.longest_match, "in Goa and Uttarakhand", "nowhere") == ["Uttarakhand", None]
    overlapping = values(spark, lambda c: text.longest_match(c, ["ab", "bcd"]), "abcd", "ab")
    assert overlapping == ["bcd", "ab"]


def test_hash_bucket_equals_the_big_integer(spark):
    import hashlib

    keys = ["P:100001", "L:N00000020", "x"]
    expected = [int(hashlib.sha256(k.encode()).hexdigest(), 16) % 10 for k in keys]
    assert values(spark, text.hash_bucket, *keys) == expected


def test_official_source(spark):
    hosts = ("reports.example.org",)
    check = lambda c: text.is_official_source(c, hosts)
    assert values(
        spark, check, "https://reports.example.org/a", "http://reports.example.org/a", "https://other.example.org", "bad url", None
    ) == [True, False, False, False, False]


def test_rounding_and_differences(spark):
    frame = spark.createDataFrame([(0.5,), (-0.5,), (2.5,), (-1.5,)], "x double")
    assert [r[0] for r in frame.select(numbers.js_round(F.col("x"))).collect()] == [1, 0, 3, -1]
    pairs = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (None, 5.0), (5.0, None), (11.0, 10.0)], "a double, e double")
    got = [r[0] for r in pairs.select(numbers.percent_difference(F.col("a"), F.col("e"))).collect()]
    assert got[:4] == [0.0, None, None, None] and got[4] == pytest.approx(10.0)


def test_right_closed_bands(spark):
    frame = spark.createDataFrame([(25.0,), (25.1,), (75.0,), (99.0,), (None,)], "x double")
    band = numbers.right_closed_band(F.col("x"), [25, 50, 75], ["<=25", "25-50", "50-75", ">75"])
    assert [r[0] for r in frame.select(band).collect()] == ["<=25", "25-50", "50-75", ">75", None]
