"""Inputs shared by the registered queries, all derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.identity import with_identity
from ..operators.labels import supervised_table
from ..operators.portfolio import snapshots_from_panel
from ..session import written
from ..sources.panel import customer_month, supplier_month, typed_panel

TARGET = "future_schedule_later_3m"
BASELINE, CHALLENGER = "BASELINE", "CHALLENGER"
#: Forward periods of the entity-disjoint evaluation; the test part has both classes.
DISJOINT = {"train": (None, "2023-12"), "validation": ("2024-01", "2024-06"), "test": ("2024-07", None)}


def supplier_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Typed dense panel."""
    return typed_panel(with_identity(supplier_month(spark, folder)))


def customer_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Typed sparse panel."""
    return typed_panel(with_identity(customer_month(spark, folder)))


def supplier_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshot series of the dense panel."""
    return snapshots_from_panel(supplier_panel(spark, folder))


def supervised(spark: SparkSession, folder: str) -> DataFrame:
    """Features and the schedule label of the dense panel."""
    return supervised_table(supplier_panel(spark, folder), TARGET)


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Prediction table with two models whose scores are arithmetic hashes of the row.

    The scores lean toward the label by a fixed share, so that metrics are neither
    perfect nor random, and are rounded, so that ties occur. Folds are calendar years.
    """
    rows = supervised(spark, folder)
    number = F.substring("identity_key", 3, 20)
    entity = F.regexp_replace(number, "[^0-9]", "").cast("long")
    month = F.substring("prediction_month", 1, 4).cast("long") * 12 + F.substring(
        "prediction_month", 6, 2
    ).cast("long")
    first = ((entity * 7919 + month * 104729) % 10007) / 10007
    second = ((entity * 6271 + month * 15485863) % 10009) / 10009
    y = F.col(TARGET)
    models = F.array(
        F.struct(F.lit(BASELINE).alias("model"), F.round(first * 0.65 + y * 0.30, 3).alias("probability")),
        F.struct(F.lit(CHALLENGER).alias("model"), F.round(second * 0.55 + y * 0.40, 4).alias("probability")),
    )
    return (
        rows.withColumn("m", F.explode(models))
        .withColumns(
            {
                "model": F.col("m.model"),
                "probability": F.col("m.probability"),
                "fold": F.substring("prediction_month", 1, 4).cast("int") - 2019,
            }
        )
        .drop("m")
    )


def stored_predictions(spark: SparkSession, folder: str, model: str | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """The prediction table written once, for queries that scan it several times.

    Of one model and with the key, scores and ``columns`` only, if these are named: other features
    are neither worked out nor written.
    """
    rows = predictions(spark, folder)
    if model:
        rows = rows.where(F.col("model") == model)
    if columns:
        rows = rows.select("identity_key", "prediction_month", TARGET, "model", "probability", "fold", *columns)
    return written(rows, "predictions")


def baseline_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the first model only."""
    return predictions(spark, folder).where(F.col("model") == BASELINE)
