"""SimHash near-dedup by ball hashing that meets in the middle.

Two fingerprints within radius r share a variant when both emit all variants within half of r.
The radius of three is odd. The code is therefore also cut into three blocks: of two different
fingerprints at most three bits apart, some block holds at least one of the bits, so with that
block masked at most two are left, and the balls of radius one around both masked codes meet.
Each distinct fingerprint emits 3 * (1 + 42 or 43) variants instead of the 2081 of a ball of
radius two.

Variants are shuffled and sorted; a task streams them and verifies the pairs of each bucket of
up to ``PAIRED`` fingerprints with one bit count per pair. A larger bucket, as dense groups of
near copies make them, is not paired. Its members go to an exact second round without pairs:
a variant of even parity, one bit from an odd fingerprint and nought or two bits from an even
one, is a hub. All that meet in a hub with an odd or the very fingerprint are within three
bits of that one, so each is linked to it alone.

Defined cases: a text without words (null, empty) has fingerprint zero, which links like any
other. Rows that repeat an id or a text are members of the same component through their equal
fingerprints; a null id never names a component unless no member has an id. Only id and text
of the input are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import written
from .common import text_key
from .components import components

SHINGLE = 3
RADIUS = 3
SEED = 42
BITS = 64
#: Buckets of up to this many fingerprints are compared pair by pair, larger ones by hubs.
PAIRED = 48


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of the word shingles of a text."""
    # bytes.lower() and bytes.split() know only ASCII, as the words are defined
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = [e - 1 for e in accumulate(len(t) + 1 for t in tokens)]
    width = min(shingle, len(tokens))
    starts = [0] + [e + 1 for e in ends[: len(tokens) - width]]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :])], dtype="<u8")
    counts = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def fingerprint(text: pd.Series) -> pd.Series:
    return text.map(fingerprint_of).astype("int64")


def _bits(*positions: int) -> int:
    """The signed 64-bit number with these bits set."""
    value = sum(1 << p for p in positions)
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _blocks(count: int) -> list[range]:
    cuts = [BITS * i // count for i in range(count + 1)]
    return [range(a, b) for a, b in zip(cuts, cuts[1:])]


def _variants(prints: DataFrame) -> DataFrame:
    """(block, variant, fp): every fingerprint's ball of radius one with each block masked."""
    table = [
        F.struct(
            F.lit(number).cast("byte").alias("block"),
            F.lit(~_bits(*block)).cast("long").alias("shown"),
            F.lit(_bits(*flip)).cast("long").alias("flip"),
        )
        for number, block in enumerate(_blocks(RADIUS))
        for flip in [(), *[(b,) for b in range(BITS) if b not in block]]
    ]
    variant = F.col("fp").bitwiseAND(F.col("e.shown")).bitwiseXOR(F.col("e.flip"))
    return prints.select("fp", F.explode(F.array(*table)).alias("e")).select(
        "e.block", variant.alias("variant"), "fp"
    )


def _settle(held: list[int], us: list, vs: list) -> None:
    """Verify the pairs of a finished bucket."""
    members = np.array(held, dtype=np.uint64)
    a, b = np.triu_indices(len(members), 1)
    near = np.bitwise_count(members[a] ^ members[b]) <= RADIUS
    us.append(members[a[near]])
    vs.append(members[b[near]])


def _compare(limit: int):
    """Over (block, variant, fp) in order: verified links (u, v), and (u, u) for each member of a larger bucket."""

    def out(us: list[np.ndarray], vs: list[np.ndarray], crowd: list[np.ndarray]) -> pa.RecordBatch:
        u = np.concatenate([*us, *crowd, np.empty(0, np.uint64)])
        v = np.concatenate([*vs, *crowd, np.empty(0, np.uint64)])
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, crowded = None, [], False
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            us, vs, crowd = [], [], []
            block, variant, prints = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            prints = prints.astype(np.int64).view(np.uint64)
            starts = np.flatnonzero(
                np.concatenate([[True], (block[1:] != block[:-1]) | (variant[1:] != variant[:-1])])
            )
            ends = np.append(starts[1:], n)
            wanted = (ends - starts > 1) | (starts == 0) | (ends == n)
            for a, b in zip(starts[wanted].tolist(), ends[wanted].tolist()):
                here = (int(block[a]), int(variant[a]))
                if here != key:
                    _settle(held, us, vs)
                    key, held, crowded = here, [], False
                for c in range(a, b, limit):
                    part = prints[c : min(b, c + limit)]
                    if not crowded and len(held) + len(part) > limit:
                        crowded = True
                        crowd.append(np.array(held, dtype=np.uint64))
                        held = []
                    if crowded:
                        crowd.append(part)
                    else:
                        held.extend(part.tolist())
            yield out(us, vs, crowd)
        us, vs = [], []
        _settle(held, us, vs)
        yield out(us, vs, [])

    return run


def _hub_links(prints: DataFrame) -> DataFrame:
    """All links between the given fingerprints, as links to one member of each hub.

    Odd fingerprints emit the variants one bit away, which have even parity; even ones emit
    themselves and the variants two bits away. An odd and an even fingerprint three bits apart
    share a hub, since two of the three bits lie in the same half of the code, so pairs of bits
    inside one half are enough. Even fingerprints two bits apart meet one bit away from both.
    """
    own = [()]
    one = [(b,) for b in range(BITS)]
    two = [(a, b) for half in _blocks(2) for a in half for b in half if a < b]

    def entries(flips: list, anchor: bool) -> Column:
        masks = F.array(*[F.lit(_bits(*f)).cast("long") for f in flips])
        return F.transform(
            masks, lambda x: F.struct(F.col("fp").bitwiseXOR(x).alias("hub"), F.lit(anchor).alias("anchor"))
        )

    odd = F.bit_count("fp") % 2 == 1
    spread = F.when(odd, entries(one, True)).otherwise(
        F.concat(entries(own + one, True), entries(two, False))
    )
    members = prints.select("fp", F.explode(spread).alias("e")).select("fp", "e.hub", "e.anchor")
    centres = members.where("anchor").groupBy("hub").agg(F.min("fp").alias("centre"))
    return (
        members.join(centres, "hub")
        .where("fp != centre")
        .select(F.col("fp").alias("u"), F.col("centre").alias("v"))
        .distinct()
    )


def links(prints: DataFrame, paired: int = PAIRED) -> DataFrame:
    """(u, v) links that connect all distinct fingerprints ``fp`` at ``RADIUS`` or fewer bits."""
    schema = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])
    met = (
        _variants(prints)
        .repartition("block", "variant")
        .sortWithinPartitions("block", "variant", "fp")
        .mapInArrow(_compare(paired), schema)
    )
    found = written(met, "near-prints")
    dense = found.where("u = v").select(F.col("u").alias("fp")).distinct()
    return found.where("u != v").unionByName(_hub_links(written(dense, "dense-prints")))


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row_key, fp, keeper) per row; keeper is the smallest (no_id, id, row_key) of its component."""
    rows = written(
        docs.select(
            F.col(id_col).alias("id"),
            text_key(F.col(text_col)).alias("row_key"),
            fingerprint(F.col(text_col)).alias("fp"),
        ),
        "fingerprints",
    )
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row_key"))
    prints = written(rows.groupBy("fp").agg(first.alias("first")), "prints")
    members = components(links(prints.select("fp")))
    named = prints.join(members, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")
    )
    keepers = named.groupBy("component").agg(F.min("first").alias("keeper"))
    return rows.join(named.join(keepers, "component").select("fp", "keeper"), "fp")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, fingerprint in hex, and the smallest id of its component."""
    return grouped(docs, id_col, text_col).select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("keeper.id").alias("component_id"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that name their component, one row of each, with all their columns."""
    keepers = grouped(docs, id_col, text_col).select("keeper.*").distinct()

    def name(column: str) -> Column:
        return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))

    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        name(f"`{id_col}`").alias("_name"),
        text_key(F.col(text_col)).alias("_key"),
    )
    wanted = keepers.select(name("id").alias("_name"), F.col("row_key").alias("_key"))
    return rows.join(wanted, ["_name", "_key"], "left_semi").dropDuplicates(["_name", "_key"]).select("_row.*")
