"""Running totals and carried values over an order too long for one window partition.

A plain unpartitioned (or hot-key) window sends a whole group to one task. Here the
order is cut into nested blocks. Each level summarises its blocks, runs a window over
the summaries of one parent block only, and hands the result down by an equi-join, so
no window partition grows with the data beyond its block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that matches null keys with null keys."""
    renamed = right.select(
        *[F.col(k).alias(f"r__{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"r__{k}"))
    return left.join(renamed, condition, "left").drop(*[f"r__{k}" for k in keys])


def _levels(
    rows: DataFrame, group: list[str], blocks: list[str], finest: dict, latest: bool = False
) -> list[tuple[list[str], list[str], DataFrame]]:
    """(level columns, parent columns, summary) per block level, coarsest first.

    Only the finest summary reads the rows; coarser ones are built from the next finer.
    """
    summary = rows.groupBy(*group, *blocks).agg(*finest.values())
    levels = []
    for depth in range(len(blocks), 0, -1):
        level = blocks[:depth]
        if depth < len(blocks):
            finer = F.col(blocks[depth])
            if latest:
                columns = [
                    F.max_by(F.col(n), F.when(F.col(n).isNotNull(), finer)).alias(n) for n in finest
                ]
            else:
                columns = [F.sum(n).alias(n) for n in finest]
            summary = summary.groupBy(*group, *level).agg(*columns)
        levels.append((level, group + blocks[: depth - 1], summary))
    return levels[::-1]


def running_totals(
    rows: DataFrame,
    group: list[str],
    blocks: list[str],
    order: list[str],
    values: list[str],
    descending: bool = False,
) -> DataFrame:
    """Add ``<value>_before``: the total of ``value`` over all earlier rows of the group.

    ``blocks`` are nested block columns, coarsest first, that agree with ``order``.
    """
    direction = F.desc if descending else F.asc
    offsets = None
    for level, parent, summary in _levels(rows, group, blocks, {v: F.sum(v).alias(v) for v in values}):
        window = (
            Window.partitionBy(*parent)
            .orderBy(direction(level[-1]))
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        summary = summary.select(
            *group, *level,
            *[F.coalesce(F.sum(v).over(window), F.lit(0)).alias(f"{v}__here") for v in values],
        )
        if offsets is None:
            offsets = summary.withColumnsRenamed({f"{v}__here": f"{v}__off" for v in values})
        else:
            joined = null_safe_join(summary, offsets, parent)
            offsets = joined.select(
                *group, *level,
                *[(F.col(f"{v}__here") + F.col(f"{v}__off")).alias(f"{v}__off") for v in values],
            )
    # The offset of a block goes before its rows, so that these are moved and sorted once.
    inside = (
        Window.partitionBy(*group, *blocks)
        .orderBy("is__row", *[direction(c) for c in order])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    both = rows.withColumn("is__row", F.lit(True)).unionByName(
        offsets.withColumn("is__row", F.lit(False)), allowMissingColumns=True
    )
    before = {
        f"{v}_before": F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.first(f"{v}__off").over(inside) for v in values
    }
    return both.withColumns(before).where("is__row").select(*rows.columns, *before)


def carried_forward(
    rows: DataFrame,
    group: list[str],
    blocks: list[str],
    order: list[str],
    values: dict[str, str],
    strict: bool = False,
) -> DataFrame:
    """Add columns holding the last non-null value at or before each row of the group.

    ``values`` maps each new column to its source column; ``strict`` looks only at
    earlier rows.
    """
    position = F.struct(*[F.col(c) for c in order])
    finest = {
        n: F.max_by(F.col(source), F.when(F.col(source).isNotNull(), position)).alias(n)
        for n, source in values.items()
    }
    carried = None
    for level, parent, summary in _levels(rows, group, blocks, finest, latest=True):
        window = (
            Window.partitionBy(*parent).orderBy(level[-1]).rowsBetween(Window.unboundedPreceding, -1)
        )
        summary = summary.select(
            *group, *level,
            *[F.last(n, ignorenulls=True).over(window).alias(f"{n}__here") for n in values],
        )
        if carried is None:
            carried = summary.withColumnsRenamed({f"{n}__here": f"{n}__off" for n in values})
        else:
            joined = null_safe_join(summary, carried, parent)
            carried = joined.select(
                *group, *level,
                *[F.coalesce(f"{n}__here", f"{n}__off").alias(f"{n}__off") for n in values],
            )
    # What is carried into a block goes before its rows, so that these are moved and sorted once.
    inside = (
        Window.partitionBy(*group, *blocks)
        .orderBy("is__row", *order)
        .rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    )
    both = rows.withColumn("is__row", F.lit(True)).unionByName(
        carried.withColumn("is__row", F.lit(False)), allowMissingColumns=True
    )
    found = {
        n: F.last(F.coalesce(f"{n}__off", s), ignorenulls=True).over(inside) for n, s in values.items()
    }
    return both.withColumns(found).where("is__row").select(*rows.columns, *found)


def value_blocks(value: str, low: str, high: str, fanout: int = 4096) -> dict:
    """Two nested block numbers of a value within [low, high], coarse and fine.

    Blocks are even on a signed logarithmic scale, so that amounts spread over many
    orders of magnitude do not crowd into a few of them. The scale never reverses order.
    """

    def scaled(name: str) -> Column:
        return F.signum(name) * F.log1p(F.abs(F.col(name)))

    width = scaled(high) - scaled(low)
    share = F.when(width > 0, (scaled(value) - scaled(low)) / width).otherwise(F.lit(0.0))
    return {
        "block": F.floor(share * fanout),
        "subblock": F.floor(share * fanout * fanout),
    }
