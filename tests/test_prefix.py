"""The block-wise totals must equal one plain window over the whole group."""

import random

from pyspark.sql import Window, functions as F

from panelwatch.operators.prefix import carried_forward, running_totals, value_blocks
from panelwatch.operators.quantiles import exact_quantiles


def rows(spark):
    random.seed(5)
    data = [
        (random.choice(["a", "b", None]), b, s, p, random.randint(0, 5), random.choice([None, None, f"v{p}"]))
        for b in range(3) for s in range(2) for p in range(6)
    ]
    frame = spark.createDataFrame(data, "g string, b int, s int, p int, n int, v string")
    return frame.withColumn("s", F.col("b") * 2 + F.col("s")).withColumn("p", F.col("s") * 10 + F.col("p"))


def test_running_totals_match_a_window(spark):
    frame = rows(spark)
    for descending in (False, True):
        order = F.desc("p") if descending else F.asc("p")
        window = Window.partitionBy("g").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        plain = frame.withColumn("n_before", F.coalesce(F.sum("n").over(window), F.lit(0)))
        blocked = running_totals(frame, ["g"], ["b", "s"], ["p"], ["n"], descending)
        assert sorted(map(str, plain.collect())) == sorted(map(str, blocked.select(*plain.columns).collect()))


def test_carried_forward_matches_a_window(spark):
    frame = rows(spark)
    for strict in (False, True):
        window = Window.partitionBy("g").orderBy("p").rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
        plain = frame.withColumn("last", F.last("v", ignorenulls=True).over(window))
        blocked = carried_forward(frame, ["g"], ["b", "s"], ["p"], {"last": "v"}, strict)
        assert sorted(map(str, plain.collect())) == sorted(map(str, blocked.select(*plain.columns).collect()))


def test_value_blocks_are_nested_and_ordered(spark):
    frame = spark.range(1000).select((F.col("id") / 999).alias("x"), F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    blocks = frame.withColumns(value_blocks("x", "lo", "hi", 16)).orderBy("x").collect()
    assert [r.block for r in blocks] == sorted(r.block for r in blocks)
    assert all(r.subblock // 16 == r.block for r in blocks)


def test_exact_quantiles_match_numpy(spark):
    import numpy as np

    random.seed(1)
    values = [random.choice([random.gauss(1e6, 3e5), 7.0, -2.5]) for _ in range(501)]
    frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    probabilities = [0.0, 0.01, 0.25, 0.5, 0.731, 1.0]
    got = {r.probability: r["quantile"] for r in exact_quantiles(frame, "x", [], probabilities).collect()}
    for p in probabilities:
        assert abs(got[p] - np.quantile(values, p)) < 1e-6 * max(1, abs(got[p]))


def test_quantiles_of_a_constant(spark):
    frame = spark.createDataFrame([("a", 3.0), ("a", 3.0), ("b", 1.0)], "g string, x double")
    got = {r.g: r["quantile"] for r in exact_quantiles(frame, "x", ["g"], [0.5]).collect()}
    assert got == {"a": 3.0, "b": 1.0}
