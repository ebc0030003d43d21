"""Stored months: a delivered month replaces itself and leaves every other month alone.

A store is a table partitioned by month, and beside it a manifest with one row per month: rows
and a digest of their content that does not depend on their order. A delivery is written once,
its months are compared with the manifest, and only months that are new or differ are written,
by dynamic partition overwrite. So a repeated run changes nothing, a corrected month replaces
its own partition, and a late month joins the others. The manifest row follows its month: a run
that fails between the two finds the month different and writes it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions.text import summed_hashes
from ..session import discard, written

MANIFEST = "report_month string, rows long, digest string"


def month_digests(frame: DataFrame, month: str = "report_month") -> DataFrame:
    """(report_month, rows, digest) of every month of a table."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in frame.columns]), {"ignoreNullFields": "false"})
    return frame.groupBy(F.col(month).cast("string").alias("report_month")).agg(
        F.count("*").alias("rows"), summed_hashes(F.sha2(row, 256)).alias("digest")
    )


def _manifest_path(folder: str) -> str:
    return f"{folder.rstrip('/')}.manifest"


def _folder_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(report_month, rows, digest) of the stored months; empty before the first delivery."""
    path = _manifest_path(folder)
    if not _folder_exists(spark, path):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(path)


def store_months(
    frame: DataFrame, folder: str, order: tuple[str, ...] = (), month: str = "report_month", fmt: str = "parquet", **options
) -> DataFrame:
    """Bring a store up to a delivery; returns (report_month, change) of the delivered months.

    ``change`` is NEW, REPLACED or UNCHANGED. Rows without a month are refused. Inside a month
    rows are sorted by ``order``.
    """
    spark = frame.sparkSession
    named = F.when(F.col(month).isNotNull(), F.col(month)).otherwise(F.raise_error(F.lit("a row without a month")).cast("string"))
    delivered = written(frame.withColumn(month, named), "delivery")
    found = written(
        month_digests(delivered, month)
        .join(manifest(spark, folder).select("report_month", F.col("rows").alias("_rows"), F.col("digest").alias("_digest")), "report_month", "left")
        .select(
            "report_month", "rows", "digest",
            F.when(F.col("_digest").isNull(), "NEW")
            .when((F.col("_digest") == F.col("digest")) & (F.col("_rows") == F.col("rows")), "UNCHANGED")
            .otherwise("REPLACED").alias("change"),
        ),
        "delivery-months",
    )
    changed = found.where("change != 'UNCHANGED'")
    if not changed.isEmpty():
        # One row per calendar month, whatever the size of the delivery.
        months = F.broadcast(changed.select(F.col("report_month").alias(month)))
        rows = delivered.join(months, month, "left_semi").repartitionByRange(month, *order).sortWithinPartitions(month, *order)
        _replace(rows.write, month, f"{folder}", fmt, options)
        _replace(changed.select("report_month", "rows", "digest").coalesce(1).write, "report_month", _manifest_path(folder), "parquet", {})
    discard(delivered)
    return found.select("report_month", "change")


def _replace(writer, month: str, path: str, fmt: str, options: dict) -> None:
    writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**options).partitionBy(month).format(fmt).save(path)


def read_months(spark: SparkSession, folder: str, schema: StructType, fmt: str = "parquet", **options) -> DataFrame:
    """The stored table, empty before the first delivery; the schema keeps months as text."""
    if not _folder_exists(spark, folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(fmt).options(**options).load(folder).select(*[f"`{c}`" for c in schema.names])
