"""Substring search over large snapshots by an index of three-character grams.

``portfolio.search`` reads every row of a snapshot for every query. The index holds one row per
(gram, entity), sorted by gram over all files, so the statistics of the files let a search read
only what holds its grams. A search takes the rarest grams of its text, intersects their
entities, and verifies the text of these alone; it returns the same rows as the full scan.

Texts end with two marks, so that every character begins a gram: a search for one or two
characters reads the grams that begin with them. A gram that every entity has is one run of
rows over as many files as it needs; it is read only if the search has no rarer one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import search_text
from .portfolio import SEARCH_FIELDS

GRAM = 3
#: Ends a text; no search text holds it.
END = "\x00"
#: Grams of a search that are intersected; the text itself is verified anyway.
RAREST = 4
POSTINGS = "gram string, project_id string"
COUNTS = "gram string, entities long"


def _text(fields: tuple[str, ...]) -> Column:
    return search_text(*[F.col(c) for c in fields])


def grams_of(text: Column) -> Column:
    """The distinct grams that begin at the characters of a text."""
    padded = F.concat(text, F.lit(END * (GRAM - 1)))
    starts = F.sequence(F.lit(1), F.length(text))
    found = F.transform(starts, lambda i: F.substring(padded, i, F.lit(GRAM)))
    return F.when(F.length(text) > 0, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def postings(view: DataFrame, fields: tuple[str, ...] = SEARCH_FIELDS) -> DataFrame:
    """(gram, project_id) of every entity."""
    return view.select(F.col("project_id").cast("string").alias("project_id"), F.explode(grams_of(_text(fields))).alias("gram")).select(
        "gram", "project_id"
    )


def write_index(view: DataFrame, folder: str, fields: tuple[str, ...] = SEARCH_FIELDS) -> None:
    """Store the index of a snapshot: postings sorted by gram, and the number of entities per gram."""
    spark = view.sparkSession
    rows = postings(view, fields).distinct()
    # By gram and entity, so that a frequent gram spreads over several files.
    ordered = rows.repartitionByRange("gram", "project_id").sortWithinPartitions("gram", "project_id")
    ordered.write.mode("overwrite").parquet(f"{folder}/postings")
    stored = spark.read.schema(POSTINGS).parquet(f"{folder}/postings")
    counted = stored.groupBy("gram").agg(F.count("*").alias("entities"))
    counted.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{folder}/counts")


def _tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(POSTINGS).parquet(f"{folder}/postings"), spark.read.schema(COUNTS).parquet(f"{folder}/counts")


def candidates(spark: SparkSession, folder: str, wanted: str) -> DataFrame:
    """(project_id) of the entities that have the grams of a search; a superset of the matches."""
    rows, counts = _tables(spark, folder)
    if len(wanted) < GRAM:
        return rows.where(F.col("gram").startswith(wanted)).select("project_id").distinct()
    grams = sorted({wanted[i : i + GRAM] for i in range(len(wanted) - GRAM + 1)})
    # At most one row per gram of the search text.
    known = {r["gram"]: r["entities"] for r in counts.where(F.col("gram").isin(grams)).collect()}
    if len(known) < len(grams):
        return rows.where(F.lit(False)).select("project_id")
    rarest = sorted(grams, key=lambda g: (known[g], g))[:RAREST]
    shared = rows.where(F.col("gram").isin(rarest)).groupBy("project_id").agg(F.count("*").alias("n"))
    return shared.where(F.col("n") == len(rarest)).select("project_id")


def indexed_search(view: DataFrame, folder: str, query: str, fields: tuple[str, ...] = SEARCH_FIELDS) -> DataFrame:
    """Entities whose searchable text contains the query; a blank query keeps all.

    The same rows as ``portfolio.search`` on the snapshot that was indexed.
    """
    wanted = query.strip().lower()
    if not wanted:
        return view
    found = candidates(view.sparkSession, folder, wanted).withColumnRenamed("project_id", "__found")
    narrowed = view.join(found, F.col("project_id").cast("string") == F.col("__found"), "left_semi")
    return narrowed.where(F.contains(_text(fields), F.lit(wanted)))


def indexed_search_top(view: DataFrame, folder: str, query: str, top: int = 8) -> DataFrame:
    """First matches in code order (top-k)."""
    return indexed_search(view, folder, query).orderBy("code", "project_id").limit(top)
