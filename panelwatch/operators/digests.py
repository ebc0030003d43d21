"""Digest of an ordered table as a hash tree, without passing the table through one task.

The rows of a group are numbered in their order over all tasks. A leaf is the SHA-256 of a fixed
number of consecutive row texts, a node that of a fixed number of consecutive digests, and the
root is what is left. Leaves are cut by row number, never by partition, so the digest depends on
the rows and their order alone, and a row moved, changed or left out changes it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written

#: Rows of a leaf, and digests of a node.
LEAF = 1024
SEPARATOR = "\n"


def positions(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The rows with ``position``, counted from 0 in each group, for groups longer than a task.

    Rows are range-partitioned by group and order; what a partition counts is raised by the rows
    of the same group in the partitions before it, at most one such group per partition.
    """
    ranged = written(
        rows.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("__part", F.spark_partition_id()), "ranged"
    )
    inside = F.row_number().over(Window.partitionBy(*by, "__part").orderBy(*order)) - 1
    sizes = ranged.groupBy(*by, "__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    goes_on = sizes.withColumn("__before", before).where("__before > 0").select(
        F.col("__part").alias("__p"), "__before", *[F.col(c).alias(f"__{c}") for c in by]
    )
    same = F.col("__part") == F.col("__p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    numbered = ranged.withColumn("__inside", inside).join(F.broadcast(goes_on), same, "left")
    return numbered.select(
        *rows.columns, (F.col("__inside") + F.coalesce("__before", F.lit(0))).cast("long").alias("position")
    )


def _folded(level: DataFrame, by: list[str], fan: int) -> DataFrame:
    """Digests of runs of ``fan`` neighbouring texts; a run is bounded, whatever the group."""
    run = F.floor(F.col("position") / fan)
    texts = F.array_sort(F.collect_list(F.struct("position", "text")))
    return level.groupBy(*by, run.alias("run")).agg(texts.alias("texts")).select(
        *by, F.col("run").cast("long").alias("position"),
        F.sha2(F.array_join(F.transform("texts", lambda t: t["text"]), SEPARATOR), 256).alias("text"),
    )


def ordered_digest(rows: DataFrame, by: list[str], order: list[Column], text: Column, leaf: int = LEAF) -> DataFrame:
    """(group, digest) of the row texts in their order; ties in ``order`` go by the text itself.

    ``order`` names plain columns, smallest first. Null texts count as empty ones. A group without rows has no digest.
    """
    if leaf < 2:
        raise ValueError("a node has two children at least")
    named = rows.select(*by, F.coalesce(text, F.lit("")).alias("text"), *[o.alias(f"__o{i}") for i, o in enumerate(order)])
    sort = [F.col(f"__o{i}") for i in range(len(order))] + [F.col("text")]
    open_nodes = written(_folded(positions(named, by, sort).select(*by, "position", "text"), by, leaf), "digests")
    done = None
    while True:
        # a group with one node is finished, however many levels others still have
        last = open_nodes.groupBy(*by).agg(F.max("position").alias("__last"))
        renamed = last.select("__last", *[F.col(c).alias(f"__{c}") for c in by])
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
        tagged = open_nodes.join(renamed, same).select(*by, "position", "text", "__last")
        roots = tagged.where("__last = 0").select(*by, F.col("text").alias("digest"))
        done = roots if done is None else done.unionByName(roots)
        if open_nodes.where("position > 0").isEmpty():
            return done
        open_nodes = written(_folded(tagged.where("__last > 0"), by, leaf), "digests")


def plain_digest(texts: Iterable[str], leaf: int = LEAF) -> str:
    """The digest of a list that fits in memory, for checks."""
    level = list(texts)
    while True:
        level = [
            hashlib.sha256(SEPARATOR.join(level[i : i + leaf]).encode()).hexdigest() for i in range(0, len(level), leaf)
        ]
        if len(level) < 2:
            return level[0] if level else ""
