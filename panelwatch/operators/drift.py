"""Distribution drift and feature diagnostics between two populations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import ratio_or_null

NUMERIC_LIMIT, CATEGORICAL_LIMIT = 0.50, 0.20  # fixed values
HIGH_MISSING, DOMINANT_SHARE = 0.50, 0.99  # fixed values
REDUNDANT_CORRELATION, PERIOD_MISSING_RANGE = 0.98, 0.50  # fixed values


def _struct_rows(fields: list[tuple[str, dict[str, Column]]]) -> Column:
    return F.array(
        *[
            F.struct(F.lit(name).alias("feature_name"), *[c.alias(n) for n, c in columns.items()])
            for name, columns in fields
        ]
    )


def numeric_drift(tagged: DataFrame, part: str, first: str, second: str, features: list[str]) -> DataFrame:
    """|mean2 - mean1| / sample deviation of the first population, all features in one pass."""
    in_first, in_second = F.col(part) == first, F.col(part) == second

    def of(test: Column, name: str) -> Column:
        return F.when(test, F.col(name).cast("double"))

    aggregates = []
    for f in features:
        aggregates += [
            F.avg(of(in_first, f)).alias(f"{f}__mean1"),
            F.stddev_samp(of(in_first, f)).alias(f"{f}__sd1"),
            F.avg(of(in_second, f)).alias(f"{f}__mean2"),
            (1 - F.count(of(in_first, f)) / F.nullif(F.count_if(in_first), F.lit(0))).alias(f"{f}__miss1"),
            (1 - F.count(of(in_second, f)) / F.nullif(F.count_if(in_second), F.lit(0))).alias(f"{f}__miss2"),
        ]
    rows = _struct_rows(
        [
            (
                f,
                {
                    "first_mean": F.col(f"{f}__mean1"),
                    "first_sd": F.col(f"{f}__sd1"),
                    "second_mean": F.col(f"{f}__mean2"),
                    "first_missing_rate": F.col(f"{f}__miss1"),
                    "second_missing_rate": F.col(f"{f}__miss2"),
                    "distribution_difference": F.when(
                        F.col(f"{f}__sd1") > 0,
                        F.abs(F.col(f"{f}__mean2") - F.col(f"{f}__mean1")) / F.col(f"{f}__sd1"),
                    ),
                },
            )
            for f in features
        ]
    )
    return tagged.agg(*aggregates).select(F.explode(rows).alias("r")).select("r.*")


def categorical_drift(
    tagged: DataFrame, part: str, first: str, second: str, features: list[str]
) -> DataFrame:
    """Total variation distance between two category distributions, missing included.

    Counting both populations side by side in one grouping gives what a full outer join
    of two frequency tables gives.
    """
    pairs = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature_name"),
                # null is a category of its own, unlike any text
                F.col(f).cast("string").alias("category"),
            )
            for f in features
        ]
    )
    counted = (
        tagged.select(F.col(part).alias("part"), F.explode(pairs).alias("p"))
        .groupBy("p.feature_name", "p.category")
        .agg(
            F.count_if(F.col("part") == first).alias("n1"),
            F.count_if(F.col("part") == second).alias("n2"),
        )
    )
    totals = counted.groupBy("feature_name").agg(F.sum("n1").alias("t1"), F.sum("n2").alias("t2"))
    share1 = F.coalesce(ratio_or_null(F.col("n1"), F.col("t1")), F.lit(0.0))
    share2 = F.coalesce(ratio_or_null(F.col("n2"), F.col("t2")), F.lit(0.0))
    missing = F.col("category").isNull()
    return counted.join(totals, "feature_name").groupBy("feature_name").agg(
        (0.5 * F.sum(F.abs(share1 - share2))).alias("distribution_difference"),
        F.sum(F.when(missing, share1).otherwise(0.0)).alias("first_missing_rate"),
        F.sum(F.when(missing, share2).otherwise(0.0)).alias("second_missing_rate"),
    )


def drift_table(
    tagged: DataFrame, part: str, first: str, second: str,
    numeric: list[str], categorical: list[str], prior_flags: set[str],
) -> DataFrame:
    """Missing rates, difference, earlier flag and status of every feature."""

    def finished(frame: DataFrame, limit: float) -> DataFrame:
        difference = F.col("distribution_difference")
        return frame.select(
            "feature_name",
            F.round("first_missing_rate", 6).alias("development_missing_rate"),
            F.round("second_missing_rate", 6).alias("future_missing_rate"),
            F.round(difference, 6).alias("distribution_difference"),
            F.col("feature_name").isin(*prior_flags).alias("prior_drift_flag"),
            F.when(difference > limit, "POTENTIALLY_PROBLEMATIC")
            .otherwise("STABLE_BY_THRESHOLD")
            .alias("drift_status"),
        )

    return finished(numeric_drift(tagged, part, first, second, numeric), NUMERIC_LIMIT).unionByName(
        finished(categorical_drift(tagged, part, first, second, categorical), CATEGORICAL_LIMIT)
    )


def missing_and_constant(frame: DataFrame, features: list[str]) -> DataFrame:
    """Missing rate, distinct values, share of the most frequent value and two flags.

    Values are counted once per (feature, value) before any feature is looked at as a
    whole, so a dominant value is one row.
    """
    pairs = F.array(
        *[F.struct(F.lit(f).alias("feature_name"), F.col(f).cast("string").alias("value")) for f in features]
    )
    counted = (
        frame.select(F.explode(pairs).alias("p"))
        .groupBy("p.feature_name", "p.value")
        .agg(F.count("*").alias("n"))
    )
    stats = counted.groupBy("feature_name").agg(
        F.sum("n").alias("total"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing"),
        F.count("value").alias("unique_values"),
        F.max("n").alias("top"),
    )
    missing = F.col("missing") / F.col("total")
    return stats.select(
        "feature_name",
        F.round(missing, 6).alias("missing_rate"),
        "unique_values",
        (missing > HIGH_MISSING).alias("high_missing"),
        ((F.col("unique_values") <= 1) | (F.col("top") / F.col("total") >= DOMINANT_SHARE)).alias("near_constant"),
    )


def _merged(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Co-moments (n, mean x, mean y, xx, yy, xy) of two disjoint row sets, one row per pair."""
    n = left[:, 0] + right[:, 0]
    share = np.divide(right[:, 0], n, out=np.zeros_like(n), where=n > 0)
    dx, dy = right[:, 1] - left[:, 1], right[:, 2] - left[:, 2]
    weight = left[:, 0] * share
    return np.column_stack(
        [
            n, left[:, 1] + dx * share, left[:, 2] + dy * share,
            left[:, 3] + right[:, 3] + dx * dx * weight,
            left[:, 4] + right[:, 4] + dy * dy * weight,
            left[:, 5] + right[:, 5] + dx * dy * weight,
        ]
    )


def _batch_moments(values: np.ndarray, pairs: list[tuple[int, int]]) -> np.ndarray:
    """Co-moments of one batch over the rows where both columns are known."""
    known = ~np.isnan(values)
    out = np.zeros((len(pairs), 6))
    for k, (i, j) in enumerate(pairs):
        both = known[:, i] & known[:, j]
        if both.any():
            x, y = values[both, i], values[both, j]
            dx, dy = x - x.mean(), y - y.mean()
            out[k] = len(x), x.mean(), y.mean(), dx @ dx, dy @ dy, dx @ dy
    return out


def correlations(frame: DataFrame, features: list[str]) -> DataFrame:
    """Pairwise-complete correlation of every feature pair; a constant side gives null.

    Each task reduces its rows to one row of co-moments per pair, so what is shuffled
    depends on the number of tasks and pairs, not on the rows scanned.
    """
    pairs = [(i, j) for i in range(len(features)) for j in range(i + 1, len(features))]

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(pairs), 6))
        for batch in batches:
            total = _merged(total, _batch_moments(batch.to_numpy(dtype=float), pairs))
        table = pd.DataFrame(total, columns=["n", "mx", "my", "xx", "yy", "xy"])
        table.insert(0, "j", [j for _, j in pairs])
        table.insert(0, "i", [i for i, _ in pairs])
        yield table[table.n > 0]

    schema = "i int, j int, n double, mx double, my double, xx double, yy double, xy double"
    columns = [F.col(f).cast("double").alias(f) for f in features]
    partial = frame.select(columns).mapInPandas(moments, schema)
    n = F.col("n")
    same_pair = Window.partitionBy("i", "j")
    centred = partial.withColumns(
        {
            "dx": F.col("mx") - F.sum(n * F.col("mx")).over(same_pair) / F.sum(n).over(same_pair),
            "dy": F.col("my") - F.sum(n * F.col("my")).over(same_pair) / F.sum(n).over(same_pair),
        }
    )
    merged = centred.groupBy("i", "j").agg(
        F.sum(F.col("xx") + n * F.col("dx") * F.col("dx")).alias("xx"),
        F.sum(F.col("yy") + n * F.col("dy") * F.col("dy")).alias("yy"),
        F.sum(F.col("xy") + n * F.col("dx") * F.col("dy")).alias("xy"),
    )
    names = F.array(*[F.lit(f) for f in features])
    spread = (F.col("xx") > 0) & (F.col("yy") > 0)
    return merged.select(
        names[F.col("i")].alias("feature_a"), names[F.col("j")].alias("feature_b"),
        F.when(spread, F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).alias("correlation"),
    )


def redundant_pairs(frame: DataFrame, features: list[str]) -> DataFrame:
    """Feature pairs whose absolute correlation exceeds the limit."""
    return correlations(frame, features).where(F.abs("correlation") > REDUNDANT_CORRELATION)


def target_correlations(frame: DataFrame, features: list[str], target: str) -> DataFrame:
    """Correlation of each feature with the target, null for constant features."""
    row = frame.agg(
        *[
            c
            for f in features
            for c in (
                F.corr(F.col(f).cast("double"), F.when(F.col(f).isNotNull(), F.col(target).cast("double"))).alias(f"{f}__c"),
                F.min(f).cast("double").alias(f"{f}__lo"),
                F.max(f).cast("double").alias(f"{f}__hi"),
                F.min(F.when(F.col(f).isNotNull(), F.col(target))).alias(f"{f}__ylo"),
                F.max(F.when(F.col(f).isNotNull(), F.col(target))).alias(f"{f}__yhi"),
            )
        ]
    )
    rows = _struct_rows(
        [
            (
                f,
                {
                    "target_correlation": F.when(
                        (F.col(f"{f}__lo") < F.col(f"{f}__hi")) & (F.col(f"{f}__ylo") < F.col(f"{f}__yhi")),
                        F.col(f"{f}__c"),
                    )
                },
            )
            for f in features
        ]
    )
    return row.select(F.explode(rows).alias("r")).select("r.*")


def period_missingness(frame: DataFrame, features: list[str], month: str = "prediction_month") -> DataFrame:
    """Range of the monthly missing rate per feature and the period-dominated flag."""
    monthly = frame.groupBy(month).agg(
        *[(1 - F.count(f) / F.count("*")).alias(f) for f in features]
    )
    row = monthly.agg(*[(F.max(f) - F.min(f)).alias(f) for f in features])
    rows = _struct_rows([(f, {"missing_range": F.col(f)}) for f in features])
    return (
        row.select(F.explode(rows).alias("r")).select("r.*")
        .withColumn(
            "period_dominated", F.coalesce(F.col("missing_range") > PERIOD_MISSING_RANGE, F.lit(False))
        )
    )


def feature_diagnostics(
    labelled: DataFrame, part: str, first: str, second: str, target: str,
    numeric: list[str], categorical: list[str],
) -> DataFrame:
    """All diagnostics joined, one row per feature, with ';'-joined flags.

    ``labelled`` is the whole table, with the part name null outside both parts.
    """
    features = numeric + categorical
    train = labelled.where(F.col(part) == first)
    moved = numeric_drift(labelled, part, first, second, numeric).select(
        "feature_name", "first_mean", "first_sd", "second_mean", "distribution_difference",
        F.lit(NUMERIC_LIMIT).alias("limit"),
    )
    shifted = categorical_drift(labelled, part, first, second, categorical).select(
        "feature_name", F.lit(None).cast("double").alias("first_mean"),
        F.lit(None).cast("double").alias("first_sd"), F.lit(None).cast("double").alias("second_mean"),
        "distribution_difference", F.lit(CATEGORICAL_LIMIT).alias("limit"),
    )
    pairs = redundant_pairs(train, numeric)
    redundant = (
        pairs.select(F.explode(F.array("feature_a", "feature_b")).alias("feature_name"))
        .distinct()
        .withColumn("redundant", F.lit(True))
    )
    table = (
        missing_and_constant(labelled, features)
        .join(moved.unionByName(shifted), "feature_name")
        .join(target_correlations(train, numeric, target), "feature_name", "left")
        .join(period_missingness(labelled, features), "feature_name")
        .join(redundant, "feature_name", "left")
    )
    drifted = F.coalesce(F.col("distribution_difference") > F.col("limit"), F.lit(False))
    flags = F.concat_ws(
        ";",
        F.when(F.col("high_missing"), F.lit("HIGH_MISSING")),
        F.when(F.col("near_constant"), F.lit("NEAR_CONSTANT")),
        F.when(F.col("period_dominated"), F.lit("PERIOD_DOMINATED_MISSINGNESS")),
        F.when(drifted, F.lit("DISTRIBUTION_SHIFT")),
        F.when(F.col("redundant"), F.lit("POTENTIALLY_REDUNDANT")),
    )
    return table.select(
        "feature_name", "missing_rate", "unique_values",
        F.round("first_mean", 4).alias("train_mean"),
        F.round("first_sd", 4).alias("train_std"),
        F.round("second_mean", 4).alias("test_mean"),
        F.round("distribution_difference", 6).alias("train_test_distribution_difference"),
        F.round("target_correlation", 6).alias("train_target_correlation"),
        F.when(drifted, "POTENTIALLY_PROBLEMATIC").otherwise("EXPECTED").alias("drift_assessment"),
        F.when(flags == "", "NONE").otherwise(flags).alias("flags"),
    )
