"""Connected components of a table of links, by alternating star operations.

Each round replaces links by links to the smallest neighbour, first from the larger and then
from the smaller side. Only a minimum per node is aggregated and joined back, so no node's
neighbours are gathered, however many it has. The minima are written before they are joined:
aggregated in the join's own stage, all links of a node would have to be one task, and a node
may hold a third of all links; read from a table, the join can be split where a node is large. Rounds are written to the shared folder, and
the tables of earlier rounds are removed once the next one is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import discard, written


def _smallest(edges: DataFrame) -> DataFrame:
    """(u, m) with ``m``, the smallest of u and all v of the same u, written."""
    return written(edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "smallest")


def _large_star(edges: DataFrame, smallest: DataFrame) -> DataFrame:
    """Links from the larger neighbours of a node to the smallest; ``edges`` has both directions."""
    return edges.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, smallest: DataFrame) -> DataFrame:
    """Edges point from the larger node u to the smaller v."""
    moved = edges.join(smallest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct()


def _round(state: DataFrame) -> DataFrame:
    both = state.select("u", "v").unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _smallest(both)
    large = written(_large_star(both, least), "links")
    discard(least)
    least = _smallest(large)
    step = written(_small_star(large, least), "links")
    discard(least)
    discard(large)
    return step


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of a link (u, v); the component is its smallest node.

    Links from a node to itself, and links given twice or in both directions, change nothing;
    nodes must not be null. The loop ends when a round changes no link.
    """
    links = edges.where("u != v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).distinct()
    state = written(links, "links")
    before = _fingerprint(state)
    while True:
        step = _round(state)
        after = _fingerprint(step)
        discard(state)
        state = step
        if after == before:
            break
        before = after
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
