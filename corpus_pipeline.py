"""The corpus pipeline: five stages over ``documents``, each written before the next reads it.

Defined cases, for all stages: rows with a null id and rows that repeat an id are documents of
their own and are judged by their own text; an empty table stays empty; further columns, whatever
their names, go through unchanged, but for those by the name of a column that the last stage adds
(size, source_size, target, taken, copies), which it replaces. Very long texts are processed whole. Null and empty texts have
no words: the quality rules reject them, so that no later stage sees them; a stage that is
applied alone keeps them (see each stage).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelwatch.llm import decontaminate, line_dedup, mixing, quality_rules, simhash
from panelwatch.llm.common import read_table
from panelwatch.session import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; null and empty texts do not."""
    return quality_rules.kept_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that the largest of three or more documents keeps for them.

    No document goes; a null or empty text is one empty line and stays as it is.
    """
    return line_dedup.without_repeated_lines(docs, line_dedup.keep_bitmaps(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Texts without words have one fingerprint and are a group like any other.
    """
    return simhash.one_of_each(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark; texts without words are clean."""
    return decontaminate.clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the number of copies; texts without words have size 0."""
    return mixing.with_copies(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_copies),
    ("benchmark decontamination", contamination),
    ("mixing", mixture),
]

#: Fingerprints, components and tilts are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents`` on."""
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
