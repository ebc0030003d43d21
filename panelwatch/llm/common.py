"""Column helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Fixed value: the characters that separate words and are stripped from lines.
SPACE = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text, as an array; empty for a null text or one of spaces only."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE_RUN)).otherwise(
        F.array().cast("array<string>")
    )


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_key(text: Column) -> Column:
    """Hash of a text. With the id it names a row, so that rows that repeat an id stay apart."""
    return F.xxhash64(text)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it in lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)
