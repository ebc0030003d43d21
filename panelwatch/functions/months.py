"""Month parsing and arithmetic. A month is the integer ``year * 12 + month``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .lexicon import FLEXIBLE_MONTH, MONTH_NAMES

PATH_MONTH = r"(20\d{2})[-_/](0[1-9]|1[0-2])"
NAMED_MONTH = "(?i)(" + "|".join(MONTH_NAMES) + r")[\s_]*(\d{4})"
MONTH_YEAR = r"^(1[0-2]|0?[1-9])/(\d{4})$"


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return F.try_element_at(table, key)


def _two_digits(text: Column) -> Column:
    return F.lpad(text, 2, "0")


def month_from_text(text: Column) -> Column:
    """'YYYY-MM' from a month name followed by a year, else null."""
    name = F.lower(F.regexp_extract(text, NAMED_MONTH, 1))
    numbers = {m.lower(): f"{i:02d}" for i, m in enumerate(MONTH_NAMES, start=1)}
    return F.concat(F.regexp_extract(text, NAMED_MONTH, 2), F.lit("-"), _lookup(numbers, name))


def month_from_path(path: Column) -> Column:
    """'YYYY-MM' from a path: a numeric year-month first, then a month name."""
    year = F.regexp_extract(path, PATH_MONTH, 1)
    numeric = F.concat(year, F.lit("-"), F.regexp_extract(path, PATH_MONTH, 2))
    return F.coalesce(F.when(year != "", numeric), month_from_text(path))


def month_number(label: Column) -> Column:
    """Month integer of a 'YYYY-MM' label."""
    year = F.substring(label, 1, 4).try_cast("int")
    return year * 12 + F.substring(label, 6, 2).try_cast("int")


def month_number_of(date: Column) -> Column:
    """Month integer of a date or timestamp."""
    return F.year(date) * 12 + F.month(date)


def _year_of(number: Column) -> Column:
    return F.floor((number - 1) / 12).cast("int")


def month_label(number: Column) -> Column:
    """'YYYY-MM' of a month integer."""
    year = _year_of(number)
    month = (number - year * 12).cast("int")
    return F.concat(year.cast("string"), F.lit("-"), _two_digits(month.cast("string")))


def month_text(number: Column) -> Column:
    """'MM/YYYY' of a month integer."""
    year = _year_of(number)
    month = (number - year * 12).cast("int")
    return F.concat(_two_digits(month.cast("string")), F.lit("/"), year.cast("string"))


def month_add(label: Column, months: int) -> Column:
    """'YYYY-MM' label moved by a number of months."""
    return month_label(month_number(label) + months)


def parse_month_date(text: Column) -> Column:
    """Month integer of 'MM/YYYY' text; malformed text is null."""
    year = F.regexp_extract(text, MONTH_YEAR, 2)
    month = F.regexp_extract(text, MONTH_YEAR, 1)
    return F.when(text.rlike(MONTH_YEAR), year.try_cast("int") * 12 + month.try_cast("int"))


def normalise_flexible_month(text: Column) -> Column:
    """'MM/YYYY' from M/YYYY, MM-YYYY, Mon-YYYY or a braced form, else null."""
    clean = F.translate(text, "{}", "")
    numeric = F.regexp_extract(clean, FLEXIBLE_MONTH, 1)
    named = F.lower(F.regexp_extract(clean, FLEXIBLE_MONTH, 3))
    abbreviations = {m[:3].lower(): f"{i:02d}" for i, m in enumerate(MONTH_NAMES, start=1)}
    return F.when(
        numeric != "",
        F.concat(_two_digits(numeric), F.lit("/"), F.regexp_extract(clean, FLEXIBLE_MONTH, 2)),
    ).when(
        named != "",
        F.concat(_lookup(abbreviations, named), F.lit("/"), F.regexp_extract(clean, FLEXIBLE_MONTH, 4)),
    )


def months_between(later: Column, earlier: Column) -> Column:
    """Whole months from ``earlier`` to ``later`` (both month integers)."""
    return later - earlier
