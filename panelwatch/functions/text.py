"""Text column helpers: cleaning, dictionary matches, token extraction, hashing."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from .lexicon import (
    FULL_DATE_TEXT,
    MONTH_DATE_TEXT,
    MONTH_DATE_TOKEN,
    STATES,
    STATE_LABELS,
)
from .numbers import MISSING_MARKERS, as_number

CURRENCY_NOISE = r"[₹Rs.\s,]+"
CURRENCY_NOISE_KEEP_POINT = r"₹|Rs\.?|[\s,]+"
PAREN_COSTS = r"^([\d,.]+)\s*\(([\d,.]+)\)$"
TOKEN_NUMBER = r"[+-]?,*(?:\d[\d,]*(?:\.[\d,]*)?|\.,*\d[\d,]*)(?:[eE][+-]?\d+)?"
TRAILING_RUN = rf"(?:^|\s)({TOKEN_NUMBER}(?:\s+{TOKEN_NUMBER})*)\s*$"
TIGHT_MONTH_TEXT = r"^(0?[1-9]|1[0-2])/\d{4}$"


WHITESPACE = " \t\n\r\f\x0b\xa0"


def strip(text: Column) -> Column:
    """Trim every kind of leading and trailing whitespace (no regular expression)."""
    return F.trim(text, F.lit(WHITESPACE))


def clean_text(text: Column) -> Column:
    """Trimmed text, with missing shown as the empty string."""
    return strip(F.coalesce(text.cast("string"), F.lit("")))


def collapse_whitespace(text: Column) -> Column:
    """Runs of whitespace become one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def parse_currency(text: Column, keep_decimals: bool = False) -> Column:
    """Currency text to a number.

    The default removes the decimal point with the other noise characters, so
    '12.5' reads as 125; ``keep_decimals=True`` keeps it.
    """
    noise = CURRENCY_NOISE_KEEP_POINT if keep_decimals else CURRENCY_NOISE
    return as_number(F.regexp_replace(text, noise, ""))


def parse_numeric(text: Column) -> Column:
    """Number with thousands separators and blanks removed; missing markers are null."""
    value = strip(text)
    return F.when(
        ~value.isin(*MISSING_MARKERS), as_number(F.regexp_replace(value, "[, ]", ""))
    )


def parse_paren_costs(text: Column) -> Column:
    """'a (b)' as a struct (original, revised); a plain number has no revised value."""
    value = strip(text)
    paired = value.rlike(PAREN_COSTS)
    first = parse_numeric(F.regexp_extract(value, PAREN_COSTS, 1))
    second = parse_numeric(F.regexp_extract(value, PAREN_COSTS, 2))
    return F.struct(
        F.when(paired, first).otherwise(parse_numeric(value)).alias("original"),
        F.when(paired, second).alias("revised"),
    )


def any_of(words: Iterable[str]) -> str:
    """Regular expression matching any of the words literally, longest first."""
    return "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))


def _overlap(words: list[str]) -> bool:
    """Some word ends with the beginning of another word."""
    return any(
        a[i:] and b.startswith(a[i:]) for a in words for b in words for i in range(1, len(a))
    )


def longest_match(text: Column, words: Iterable[str] = STATES) -> Column:
    """Longest dictionary word contained in the text, ties alphabetical, else null.

    One pass of an alternation finds every occurrence when no two words can overlap in a
    text; otherwise the words are tried one by one, longest first.
    """
    ordered = sorted(words, key=lambda w: (-len(w), w))
    if _overlap(ordered):
        return F.coalesce(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in ordered])
    found = F.regexp_extract_all(text, F.lit(f"({any_of(ordered)})"), F.lit(1))
    ranked = F.transform(found, lambda w: F.struct((-F.length(w)).alias("rank"), w.alias("word")))
    return F.array_min(ranked)["word"]


def canonical_state(label: Column) -> Column:
    """Canonical state name of a printed label, else null."""
    table = F.create_map(*[F.lit(x) for pair in STATE_LABELS.items() for x in pair])
    return F.try_element_at(table, F.upper(collapse_whitespace(label)))


def extract_month_dates(text: Column) -> Column:
    """Array of all MM/YYYY tokens."""
    return F.regexp_extract_all(text, F.lit(f"({MONTH_DATE_TOKEN})"), F.lit(1))


def trailing_numbers(text: Column) -> Column:
    """Maximal run of numbers at the end of the text, in reading order."""
    run = F.regexp_extract(text, TRAILING_RUN, 1)
    numbers = F.transform(
        F.split(run, r"\s+"), lambda t: F.regexp_replace(t, ",", "").try_cast("double")
    )
    return F.when(run != "", numbers).otherwise(F.array().cast("array<double>"))


def has_trailing_numbers(text: Column, count: int) -> Column:
    """The text ends with at least ``count`` numbers."""
    return text.rlike(r"(?:^|\s)" + r"\s+".join([TOKEN_NUMBER] * count) + r"\s*$")


def without_trailing_numbers(text: Column) -> Column:
    """The text with its trailing run of numbers removed, tokens joined by one space."""
    return collapse_whitespace(F.regexp_replace(text, TRAILING_RUN, ""))


def is_report_date(text: Column) -> Column:
    """Text is MM/YYYY or a full D/M/YYYY date."""
    return text.rlike(MONTH_DATE_TEXT) | text.rlike(FULL_DATE_TEXT)


def is_month_date(text: Column) -> Column:
    """Text is M/YYYY or MM/YYYY with a valid month."""
    return text.rlike(TIGHT_MONTH_TEXT)


def is_official_source(url: Column, hosts: Iterable[str]) -> Column:
    """The URL is https and its host is in the allow-list."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    return F.coalesce((scheme == "https") & host.isin(*hosts), F.lit(False))


def hash_bucket(identity: Column, buckets_base: int = 10) -> Column:
    """SHA-256 of the identity, read as one big integer, modulo ``buckets_base``."""
    digits = F.split(F.sha2(identity, 256), "")
    step = 16 % buckets_base

    def fold(total: Column, digit: Column) -> Column:
        value = F.instr(F.lit("0123456789abcdef"), digit) - 1
        return (total * step + value) % buckets_base

    return F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0), fold)


def search_text(*columns: Column) -> Column:
    """Lower-case text of several fields for substring search."""
    return F.lower(F.concat_ws(" ", *columns))


def summed_hashes(digest: Column) -> Column:
    """Aggregate of SHA-256 digests that does not depend on their order: four sums of 64 bits."""
    lanes = [F.conv(F.substring(digest, 16 * i + 1, 16), 16, 10).cast("decimal(20,0)") for i in range(4)]
    return F.concat_ws("-", *[F.sum(lane.cast("decimal(38,0)")).cast("string") for lane in lanes])
