"""Numeric column helpers: guarded ratios, rounding conventions and number parsing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
MISSING_MARKERS = ("", "-", "NA", "N/A", "na", "n/a", "--")  # fixed values


def money(value: Column) -> Column:
    """Exact two-decimal amount, so sums do not depend on row order."""
    return value.cast("decimal(18,2)")


def cents(value: Column) -> Column:
    """Amount in hundredths as an integer: exact sums at the price of an integer add."""
    return F.floor(value * 100 + 0.5)


def as_number(text: Column) -> Column:
    """Plain decimal text to double; anything else is null."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Ratio that is null unless the denominator is positive."""
    return F.when(denominator > 0, numerator / denominator)


def ratio_or_null(numerator: Column, denominator: Column) -> Column:
    """Ratio that is null when the denominator is zero or missing."""
    return F.when(denominator != 0, numerator / denominator)


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    """Ratio that is zero when the denominator is zero."""
    return F.when(denominator != 0, numerator / denominator).otherwise(F.lit(0.0))


def effective_value(revised: Column, original: Column) -> Column:
    """The revised value where there is one, else the original."""
    return F.coalesce(revised, original)


def js_round(value: Column) -> Column:
    """Round half toward positive infinity, as the dashboard metrics do."""
    return F.floor(value + F.lit(0.5))


def js_round_to(value: Column, digits: int) -> Column:
    """``js_round`` at a number of decimals."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale


def percent_difference(actual: Column, expected: Column) -> Column:
    """Absolute % difference; zero against zero is 0, anything else against zero is null."""
    zero_case = F.when(actual == 0, F.lit(0.0))
    return F.when(expected == 0, zero_case).otherwise(
        F.abs(actual - expected) / F.abs(F.when(expected != 0, expected)) * 100
    )


def format_crore(value: Column) -> Column:
    """Amount in crore as a lakh-crore or thousand-crore label."""
    return F.when(
        value / 100000 >= 1, F.format_string("₹%.2fL Cr", value / 100000)
    ).otherwise(F.format_string("₹%.2fk Cr", value / 1000))


def right_closed_band(value: Column, bounds: list[float], labels: list[str]) -> Column:
    """Label of the first band whose upper bound is >= value; null stays null."""
    band = F.when(value <= bounds[0], F.lit(labels[0]))
    for bound, label in zip(bounds[1:], labels[1:]):
        band = band.when(value <= bound, F.lit(label))
    return band.when(value.isNotNull(), F.lit(labels[len(bounds)]))
