"""Prefix trie of rebuilt conversations, rolled up by centroid decomposition.

A node is a distinct sequence of first turns. It is named by its depth and two sums of hashes of
(position, turn), which are running totals, so a conversation of any length is cut into blocks
instead of being walked by one task. Members, children and the number of turns below a node come
from grouping these names.

What is summed over subtrees (leaves, saved tokens) is rolled up on the forest of parent edges:

* a component is a connected part of the trie; its weight is the number of turns of all
  conversations in it, which each node already knows for its own subtree;
* the nodes that hold more than half of the weight are a path from the top down. Its last node is
  the centroid: without it no part has more than half of the weight;
* the totals of the parts below the centroid, and its own value, are its total within the
  component. It is added to every node of the path above, whose weight goes down accordingly;
* the centroid leaves, and the parts are the components of the next round.

So the number of rounds is the logarithm of the weight, not the depth of the trie. A node is
below the centroid if the smallest conversation that holds it holds the centroid too, which one
join on conversations tells. Components of at most ``limit`` turns are finished side by side
inside tasks by the same rounds over arrays.

Defined cases: turns are ordered by ``turn``, null first, ties by the SHA-256 of role and text;
rows that repeat a turn are turns of their own. Null role or text is empty. Rows without a
conversation id belong to no conversation. Texts are read once, for hash and length, however
long. Other columns are not read. An empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.prefix import running_totals
from ..session import discard, written

#: Turns that a conversation may take from the first one of its group, less one, and the group.
BORROWED = 9
GROUP = 5
#: Turns of one block of running totals.
BLOCK = 4096
#: Weight up to which a component is finished in one task.
LIMIT = 4096
#: Ids in one piece of an ordered list.
PIECE = 1 << 16
KEY = ["depth", "k1", "k2"]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv, pos, digest, bytes): the turns of each conversation, numbered from 1."""
    text, role = (F.coalesce(F.col(c), F.lit("")) for c in ("text", "role"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
        # tells equal rows apart, so that many of them need not share a partition
        F.monotonically_increasing_id().alias("row"),
    )
    order = [F.asc_nulls_first("turn"), F.col("digest"), F.col("row")]
    ranged = written(
        turns.repartitionByRange(F.col("conv"), *order).withColumn("part", F.spark_partition_id()), "turns"
    )
    inside = F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order))
    sizes = ranged.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # Only what goes on from one range into the next: at most one conversation per partition.
    goes_on = sizes.withColumn("before", before).where("before > 0").select("conv", "part", "before")
    numbered = ranged.withColumn("inside", inside).join(F.broadcast(goes_on), ["conv", "part"], "left")
    return numbered.select(
        "conv", (F.col("inside") + F.coalesce("before", F.lit(0))).cast("long").alias("pos"), "digest", "bytes"
    )


def _borrowed(conv: Column) -> Column:
    return F.crc32(conv.cast("string")) % BORROWED


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv, base, h, k, size): turns asked for and got from the base, and all turns, rebuilt."""
    own = turns.groupBy("conv").agg(F.max("pos").alias("n_own"))
    named = own.select(
        "conv", "n_own", (F.col("conv") - F.col("conv") % GROUP).alias("base"), _borrowed(F.col("conv")).alias("h")
    )
    bases = own.select(F.col("conv").alias("base"), F.col("n_own").alias("n_base"))
    k = F.least("h", F.coalesce("n_base", F.lit(0)))
    return named.join(bases, "base", "left").select(
        "conv", "base", "h", k.alias("k"), (k + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("size")
    )


def rebuilt_turns(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, depth, size, digest, bytes): the first ``k`` turns of the base, then the own ones from ``h`` on."""
    first = turns.where(F.col("pos") < BORROWED).withColumnRenamed("conv", "base")
    taken = first.join(convs, "base").where("pos <= k").select("conv", F.col("pos").alias("depth"), "size", "digest", "bytes")
    own = turns.join(convs, "conv").where("pos > h").select(
        "conv", (F.col("k") + F.col("pos") - F.col("h")).alias("depth"), "size", "digest", "bytes"
    )
    return taken.unionByName(own)


def _name(total: Column) -> Column:
    """A 63-bit name of an exact sum."""
    modulus = F.lit(1 << 62).cast("decimal(38,0)")
    return F.pmod(total.cast("decimal(38,0)"), modulus).cast("long")


def paths(rebuilt: DataFrame) -> DataFrame:
    """One row per conversation and depth with the name of the node and of its parent."""
    hashed = rebuilt.select(
        "*",
        F.floor(F.col("depth") / BLOCK).alias("block"),
        *[F.xxhash64(F.lit(k), "depth", "digest").cast("decimal(20,0)").alias(f"x{k}") for k in (1, 2)],
    )
    summed = running_totals(hashed, ["conv"], ["block"], ["depth"], ["x1", "x2"])
    return summed.select(
        "conv", "depth", "size", "bytes",
        *[_name(F.col(f"x{k}_before") + F.col(f"x{k}")).alias(f"k{k}") for k in (1, 2)],
        *[_name(F.col(f"x{k}_before")).alias(f"p{k}") for k in (1, 2)],
    )


def nodes_of(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node: name, smallest member, parent, members, children, weight, values to sum."""
    own = rows.groupBy(*KEY).agg(
        F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"),
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.sum(F.col("size") - F.col("depth") + 1).alias("weight"),
    )
    root = convs.agg(
        F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.sum(F.col("size") + 1).alias("weight")
    ).where("n_convs > 0").select(
        F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv",
        "n_convs", F.lit(0).cast("long").alias("bytes"), F.lit(None).cast("long").alias("p1"),
        F.lit(None).cast("long").alias("p2"), "weight",
    )
    every = written(own.unionByName(root), "trie-nodes")
    parent = every.select(
        (F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent_conv")
    )
    children = every.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count("*").alias("n_children")
    )
    counted = every.join(parent, ["depth", "p1", "p2"], "left").join(children, KEY, "left")
    return counted.select(
        *KEY, "conv", "parent_conv", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "weight",
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
    )


VALUES = ["leaves", "saved"]


def array_rollup(parent: np.ndarray, depth: np.ndarray, weight: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
    """Sums over subtrees of a forest of small components, by rounds over all centroids at once.

    ``parent`` is the row of the parent, -1 at the top of a component; ``weight`` the weight of
    the node's subtree within its component.
    """
    n = len(parent)
    weight, alive, rows = weight.copy(), np.ones(n, dtype=bool), np.arange(n)
    sums = [np.zeros(n, dtype=np.int64) for _ in values]

    def tops() -> np.ndarray:
        up = np.where((parent >= 0) & alive[parent], parent, rows)
        while True:
            further = up[up]
            if (further == up).all():
                return up
            up = further

    top = tops()
    while alive.any():
        path = np.flatnonzero(alive & (2 * weight > weight[top]))
        deepest = np.full(n, -1)
        np.maximum.at(deepest, top[path], depth[path])
        centroid = path[depth[path] == deepest[top[path]]]
        of = top[centroid]
        alive[centroid] = False
        now = tops()
        below = np.flatnonzero(alive & (now != top))
        upper = path[alive[path]]
        lost = np.zeros(n, dtype=np.int64)
        lost[of] = weight[centroid]
        for total, value in zip(sums, values):
            found = np.zeros(n, dtype=np.int64)
            found[of] = value[centroid]
            np.add.at(found, top[below], value[below])
            total[centroid] += found[of]
            total[upper] += found[top[upper]]
        weight[upper] -= lost[top[upper]]
        top = now
    return sums


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by component, with what they got so far: the final sums of all nodes."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        get = lambda name: table.column(name).to_numpy()
        conv, depth = get("conv"), get("depth")
        known, place = np.unique(conv, return_inverse=True)
        span = int(depth.max()) + 2
        name = place * span + depth
        order = np.argsort(name)
        above = get("parent")
        at = np.minimum(np.searchsorted(known, above), len(known) - 1)
        wanted = at * span + depth - 1
        row = order[np.minimum(np.searchsorted(name[order], wanted), len(order) - 1)]
        parent = np.where((known[at] == above) & (depth > 0) & (name[row] == wanted), row, -1)
        sums = array_rollup(parent, depth, get("weight"), [get(v) for v in VALUES])
        return pa.RecordBatch.from_arrays(
            [pa.array(get(k)) for k in KEY] + [pa.array(s + get(f"got_{v}")) for s, v in zip(sums, VALUES)], names=KEY + VALUES
        )

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        names = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("cd", "c1", "c2")]
        new = np.flatnonzero(np.any([x[1:] != x[:-1] for x in names], axis=0)) + 1
        if held:
            before = [held[-1].column(c)[-1].as_py() for c in ("cd", "c1", "c2")]
            if before != [int(x[0]) for x in names]:
                new = np.concatenate([[0], new])
        if len(new):
            # everything before the last change of component is complete
            cut = int(new[-1])
            ready = [*held, batch.slice(0, cut)]
            if sum(b.num_rows for b in ready):
                yield solve(pa.Table.from_batches(ready))
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield solve(pa.Table.from_batches(held))


def _with_totals(state: DataFrame, comp: list[str]) -> DataFrame:
    """Add the weight of the whole component, which is that of its top."""
    rows = written(state, "component-nodes")
    tops = written(rows.groupBy(*comp).agg(F.max("weight").alias("total")), "component-totals")
    return rows.join(tops, comp)


def rollup(nodes: DataFrame, rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(name, leaves, saved): the sums over the subtree of every node.

    ``nodes`` has name, ``conv`` (the smallest member), ``parent_conv``, ``weight`` and the values;
    ``rows`` says which conversation goes through which node.
    """
    comp = ["cd", "c1", "c2"]
    state = nodes.select(
        *KEY, "conv", F.coalesce("parent_conv", F.lit(-1)).alias("parent"), "weight", *VALUES,
        *[F.lit(0).cast("long").alias(f"got_{v}") for v in VALUES],
        *[F.lit(0).cast("long").alias(c) for c in comp],
    )
    state = _with_totals(state, comp)
    done, small = [], []
    while True:
        small.append(state.where(F.col("total") <= limit))
        large = state.where(F.col("total") > limit)
        if large.isEmpty():
            break
        path = large.where(F.col("weight") * 2 > F.col("total"))
        centroid = written(
            path.groupBy(*comp).agg(F.max_by(F.struct(*KEY, "weight"), "depth").alias("c")).select(
                *comp, *[F.col(f"c.{k}").alias(f"at_{k}") for k in KEY], F.col("c.weight").alias("lost")
            ),
            "centroids",
        )
        # conversations that go on below a centroid, and the part that they go into
        members = rows.select(
            F.col("conv"), (F.col("depth") - 1).alias("at_depth"), F.col("p1").alias("at_k1"), F.col("p2").alias("at_k2"),
            F.col("k1").alias("n1"), F.col("k2").alias("n2"),
        ).join(centroid, ["at_depth", "at_k1", "at_k2"]).select(*comp, "conv", "n1", "n2")
        below = F.col("n1").isNotNull() & (F.col("depth") > F.col("at_depth"))
        placed = written(
            large.join(centroid, comp).join(members, [*comp, "conv"], "left").select(
                *state.columns, "lost", "at_depth", "n1", "n2",
                below.alias("below"),
                ((F.col("depth") == F.col("at_depth")) & (F.col("k1") == F.col("at_k1")) & (F.col("k2") == F.col("at_k2"))).alias("is_centroid"),
            ),
            "placed",
        )
        found = placed.where("below OR is_centroid").groupBy(*comp).agg(*[F.sum(v).alias(f"s_{v}") for v in VALUES])
        moved = placed.join(found, comp)
        done.append(
            written(moved.where("is_centroid").select(*KEY, *[(F.col(f"got_{v}") + F.col(f"s_{v}")).alias(v) for v in VALUES]), "rolled-up")
        )
        on_path = ~F.col("below") & (F.col("weight") * 2 > F.col("total"))
        rest = moved.where("NOT is_centroid").select(
            *KEY, "conv", "parent", F.when(on_path, F.col("weight") - F.col("lost")).otherwise(F.col("weight")).alias("weight"), *VALUES,
            *[F.when(on_path, F.col(f"got_{v}") + F.col(f"s_{v}")).otherwise(F.col(f"got_{v}")).alias(f"got_{v}") for v in VALUES],
            F.when(F.col("below"), F.col("at_depth") + 1).otherwise(F.col("cd")).alias("cd"),
            F.when(F.col("below"), F.col("n1")).otherwise(F.col("c1")).alias("c1"),
            F.when(F.col("below"), F.col("n2")).otherwise(F.col("c2")).alias("c2"),
        )
        state = _with_totals(rest, comp)
        discard(placed)
        discard(centroid)
    parts = small[0]
    for part in small[1:]:
        parts = parts.unionByName(part)
    local = parts.repartition(*comp).sortWithinPartitions(*comp).select(
        *KEY, "conv", "parent", "weight", *VALUES, *[f"got_{v}" for v in VALUES], *comp
    ).mapInArrow(_finish, ", ".join(f"{c} long" for c in KEY + VALUES))
    for part in done:
        local = local.unionByName(part)
    return local


def _runs(columns: list[np.ndarray]) -> list[int]:
    """Where rows differ from the row before, the first row included, and the end."""
    change = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return [0, *(np.flatnonzero(change) + 1).tolist(), len(columns[0])]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (name, conv) into (name, first conv, ids joined by commas)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in KEY]
        conv = batch.column("conv")
        cuts = _runs(columns)
        pieces = [(a, min(a + PIECE, b)) for x, b in zip(cuts, cuts[1:]) for a in range(x, b, PIECE)]
        first = np.array([a for a, _ in pieces])
        texts = [",".join(map(str, conv.slice(a, b - a).to_pylist())) for a, b in pieces]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c[first]) for c in columns] + [conv.take(pa.array(first)), pa.array(texts, type=pa.string())],
            names=[*KEY, "first", "ids"],
        )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces into one digest per name; only the digest's state is held between rows."""

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate([pa.int64()] * 3 + [pa.string()])], names=[*KEY, "digest"])

    name, state = None, None
    for batch in batches:
        rows = []
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in [*KEY, "ids"])):
            if key != name:
                if name is not None:
                    rows.append((*name, state.hexdigest()))
                name, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield out(rows)
    if name is not None:
        yield out([(*name, state.hexdigest())])


def end_digests(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(name, digest) of the nodes where conversations end: SHA-256 of their ids in order.

    A digest has to be taken in order, so the ids are sorted over all tasks and joined into
    pieces first; what is left for one task is a few long strings, however many ids a node has.
    """
    ends = rows.where("depth = size").select(*KEY, "conv").unionByName(
        convs.where("size = 0").select(*[F.lit(0).cast("long").alias(k) for k in KEY], "conv")
    )
    order = [*KEY, "conv"]
    packed = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _packed, ", ".join(f"{k} long" for k in KEY) + ", first long, ids string"
    )
    return packed.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(
        _hashed, ", ".join(f"{k} long" for k in KEY) + ", digest string"
    )


def trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per node: smallest member, depth, parent, members, children, leaves, saved bytes, ends."""
    turns = written(ordered_turns(conversations), "numbered-turns")
    convs = written(conversations_of(turns), "rebuilt")
    rows = written(paths(rebuilt_turns(turns, convs)), "paths")
    nodes = written(nodes_of(rows, convs), "trie")
    sums = rollup(nodes, rows, limit)
    kept = nodes.drop(*VALUES).join(sums, KEY).join(end_digests(rows, convs), KEY, "left")
    return kept.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
