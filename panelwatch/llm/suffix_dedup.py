"""Removal of long byte strings that occur more than once, over sampled suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it starts at two places or more, in the
same document or any other. Sorting all suffixes, or refining the interleave of shard
transforms byte by byte, passes over every byte up to ``LENGTH`` times. Here the refinement
runs over a sample of the suffixes instead. In every window of ``LENGTH`` bytes the place with
the smallest hash of its next ``GRAM`` bytes is an anchor. Equal windows have their anchor at
the same place, so only suffixes at anchors, about one in 160, need to be interleaved:

* anchors fall into classes by their gram, and by all the bytes that their windows span; what
  shares the whole span is repeated, what shares no gram is not;
* what is left shares a gram but not the span. Its windows are split into ranges, and each round
  refines the classes: a range is repeated if the bytes of all its windows together (a longer
  common context) occur twice, and is not if the bytes common to all its windows occur once.
  Otherwise it goes to the next round, down to single windows.

No class is gathered: classes are counts, joined back. Equal spans are one row from the first
round on, however many documents hold them.

Defined cases: null and empty texts have no bytes; texts shorter than ``LENGTH`` lose nothing.
Rows that repeat an id and a text are two documents that repeat each other. Very long texts are
read in pieces of ``PIECE`` windows. Only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import discard, written
from .common import same, text_key

LENGTH = 400
#: Windows that share an anchor, and the bytes an anchor's hash covers.
REACH = 320
GRAM = LENGTH - REACH + 1
PIECE = (1 << 19) - LENGTH
#: Each round cuts a range of windows into so many.
SPLIT = 8
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int, base: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    done = 1
    step = np.uint64(base)
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * step
        step = step * step
        done += more
    return out


_POWERS: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = 1 << (n - 1).bit_length()
        _POWERS["up"] = _powers(size, _BASE)
        _POWERS["down"] = _powers(size, pow(_BASE, -1, 1 << 64))
    return _POWERS["up"][:n], _POWERS["down"][:n]


def anchors_of(data: bytes) -> np.ndarray:
    """Places whose gram has the smallest hash in some window of ``LENGTH`` bytes."""
    values = np.frombuffer(data, dtype=np.uint8)
    found = []
    with np.errstate(over="ignore"):
        for begin in range(0, max(0, len(values) - LENGTH + 1), PIECE):
            part = values[begin : begin + PIECE + LENGTH - 1].astype(np.uint64) + np.uint64(1)
            up, down = _tables(len(part))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * up, dtype=np.uint64)])
            grams = (sums[GRAM:] - sums[:-GRAM]) * down[: len(part) - GRAM + 1]
            grams ^= grams >> np.uint64(31)
            grams *= np.uint64(0xBF58476D1CE4E5B9)
            grams ^= grams >> np.uint64(29)
            # The place in the low bits: of equal hashes the first one counts.
            keys = (grams & ~np.uint64(0xFFFFF)) | np.arange(len(grams), dtype=np.uint64)
            windows = len(keys) - REACH + 1
            padded = np.full(-(-len(keys) // REACH) * REACH, np.iinfo(np.uint64).max, dtype=np.uint64)
            padded[: len(keys)] = keys
            rows = padded.reshape(-1, REACH)
            before = np.minimum.accumulate(rows, axis=1).ravel()
            after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
            least = np.minimum(after[:windows], before[REACH - 1 : REACH - 1 + windows])
            places = (least & np.uint64(0xFFFFF)).astype(np.int64)
            found.append(begin + places[np.concatenate([[True], places[1:] != places[:-1]])])
    return np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.int64)


def _span(place: int, size: int) -> tuple[int, int]:
    """The bytes of all windows that hold the gram at a place."""
    return max(0, place - REACH + 1), min(size, place + LENGTH)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, places, grams, spans = [], [], [], []
        for i, text in enumerate(batch.column(2).to_pylist()):
            data = (text or "").encode("utf-8", "surrogatepass")
            for place in anchors_of(data).tolist():
                a, b = _span(place, len(data))
                row.append(i)
                places.append(place)
                grams.append(xxhash.xxh3_64_intdigest(data[place : place + GRAM]))
                spans.append(xxhash.xxh3_128_digest(data[a:b], seed=place - a))
        halves = np.frombuffer(b"".join(spans), dtype=">i8").astype("int64").reshape(-1, 2)
        take = pa.array(row, type=pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(take), batch.column(1).take(take), pa.array(places, type=pa.int64()),
                pa.array(np.array(grams, dtype=np.uint64).view(np.int64)),
                pa.array(halves[:, 0]), pa.array(halves[:, 1]),
            ],
            names=["doc", "row_key", "place", "gram", "t1", "t2"],
        )


@F.pandas_udf(T.BinaryType())
def _packed(text: pd.Series) -> pd.Series:
    """A text as compressed bytes, for the shuffle."""
    pack = zstandard.ZstdCompressor(level=3)
    return text.map(lambda t: pack.compress((t or "").encode("utf-8", "surrogatepass")))


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def _cut_spans(packed: pd.Series, places: pd.Series) -> pd.Series:
    unpack = zstandard.ZstdDecompressor()

    def cut(blob, wanted):
        data = unpack.decompress(blob)
        return [data[slice(*_span(int(place), len(data)))] for place in wanted]

    return pd.Series([cut(b, w) for b, w in zip(packed, places)], dtype=object)


DIGEST = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()),
    ]
)


def _kept(data: bytes, starts, ends) -> tuple[bytes, int, int]:
    """What stays without the windows that start in [start, end], and the removed bytes and runs."""
    pieces, at, removed, runs = [], 0, 0, 0
    reach = -1
    for a, b in sorted(zip(starts, ends)):
        a, b = max(0, a), min(b, len(data) - LENGTH) + LENGTH
        if b - a < LENGTH:
            continue
        if a > reach:
            runs += 1
            pieces.append(data[at:a])
            removed += b - a
        else:
            removed += max(0, b - reach)
        reach = max(reach, b)
        at = reach
    return b"".join([*pieces, data[at:]]), removed, runs


@F.pandas_udf(DIGEST)
def _digest(packed: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
    unpack, rows = zstandard.ZstdDecompressor(), []
    for blob, a, b in zip(packed, starts, ends):
        data = unpack.decompress(blob)
        kept, removed, runs = _kept(data, [] if a is None else a.tolist(), [] if b is None else b.tolist())
        rows.append((len(data), removed, runs, hashlib.sha256(kept).hexdigest()))
    return pd.DataFrame(rows, columns=DIGEST.names)


@F.pandas_udf(T.BinaryType())
def _kept_bytes(packed: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    unpack = zstandard.ZstdDecompressor()
    return pd.Series(
        [
            _kept(unpack.decompress(blob), [] if a is None else a.tolist(), [] if b is None else b.tolist())[0]
            for blob, a, b in zip(packed, starts, ends)
        ],
        dtype=object,
    )


def _refined(spans: DataFrame) -> DataFrame:
    """(t1, t2, a, b): ranges of windows, a to b bytes before the anchor, that occur twice or more.

    ``spans`` has (t1, t2, docs, left, data): distinct spans, the number of anchors that hold each,
    and how many of their bytes are before the anchor. Ranges of spans with one anchor are returned.
    """
    size = F.length("data")

    def piece(start: Column, end: Column) -> Column:
        inside = (start >= 0) & (end <= size)
        return F.when(inside, F.col("data").substr(start + 1, end - start))

    def both(prefix: str, value: Column) -> list[Column]:
        return [F.xxhash64(value).alias(prefix + "1"), F.xxhash64(F.lit(prefix), value).alias(prefix + "2")]

    ranges = spans.select(
        "t1", "t2",
        F.array(F.struct(F.lit(0).alias("a"), F.lit(REACH - 1).alias("b"), F.col("docs").alias("docs"))).alias("ranges"),
    )
    done, width, state = None, REACH, written(ranges, "ranges")
    while width > 1:
        part = -(-width // SPLIT)
        # range [a, b] -> its parts of up to ``part`` windows
        cut = F.explode(
            F.flatten(
                F.transform(
                    "ranges",
                    lambda r: F.transform(
                        F.sequence(r["a"], r["b"], F.lit(part)),
                        lambda s: F.struct(
                            s.alias("a"), F.least(s + F.lit(part - 1), r["b"]).alias("b"), r["docs"].alias("docs")
                        ),
                    ),
                )
            )
        )
        cells = spans.join(state, ["t1", "t2"]).select("t1", "t2", "left", "data", cut.alias("r"))
        a, b = F.col("r.a"), F.col("r.b")
        common = piece(F.col("left") - a, F.col("left") - b + LENGTH)
        whole = piece(F.col("left") - b, F.col("left") - a + LENGTH)
        hashed = (
            cells.withColumns({"common": common, "whole": whole})
            .where(F.col("common").isNotNull())
            .select(
                "t1", "t2", F.col("r.docs").alias("docs"), a.alias("a"), b.alias("b"), *both("c", F.col("common")),
                *[F.when(F.col("whole").isNotNull(), c).alias(n) for n, c in zip(("w1", "w2"), both("w", F.col("whole")))],
            )
        )
        nodes = written(hashed, "nodes")
        key = ["a", "b", "c1", "c2"]
        # Equal whole contexts are one class; one that leaves its document is a class of its own.
        # Classes are written before they are joined back, so that the join may split a frequent one.
        classes = written(
            nodes.where(F.col("w1").isNotNull())
            .groupBy(*key, "w1", "w2")
            .agg(F.sum("docs").alias("n"), F.min(F.struct("t1", "t2")).alias("t")),
            "classes",
        )
        alone = nodes.where(F.col("w1").isNull()).select(*key, F.col("docs").alias("n"), "docs")
        summary = written(
            classes.select(*key, "n", F.col("n").alias("docs"))
            .unionByName(alone)
            .groupBy(*key)
            .agg(F.sum("docs").alias("all"), F.min("n").alias("rarest"))
            .where((F.col("all") > 1) & (F.col("rarest") == 1))
            .select(*key),
            "open-classes",
        )
        repeated = (
            nodes.join(classes.where("n > 1"), [*key, "w1", "w2"])
            .where("docs = 1")
            .select("t1", "t2", "a", "b")
        )
        repeated = written(repeated, "repeated")
        done = repeated if done is None else done.unionByName(repeated)
        # One member of each class goes on, and every range that leaves its document.
        first = classes.join(summary, key).select("t.*", "a", "b", F.col("n").alias("docs"))
        rest = nodes.where(F.col("w1").isNull()).join(summary, key).select("t1", "t2", "a", "b", "docs")
        state_next = (
            first.unionByName(rest)
            .groupBy("t1", "t2")
            .agg(F.collect_list(F.struct("a", "b", "docs")).alias("ranges"))
        )
        following = written(state_next, "ranges")
        for table in (state, nodes, classes, summary):
            discard(table)
        state, width = following, part
    discard(state)
    return done


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, row_key, starts, ends): ranges of places where a repeated string starts.

    A range may reach over the ends of the document; only places with ``LENGTH`` bytes count.
    """
    doc_field = T.StructField("doc", docs.schema[id_col].dataType)
    longs = [T.StructField(n, T.LongType()) for n in ("row_key", "place", "gram", "t1", "t2")]
    rows = docs.select(F.col(id_col).alias("doc"), text_key(F.col(text_col)).alias("row_key"), F.col(text_col).alias("text"))
    anchors = written(rows.mapInArrow(_anchor_rows, T.StructType([doc_field, *longs])), "anchors")
    # Counts are written before they are joined back, so that the join may split a frequent key.
    shared = written(
        anchors.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "shared-grams"
    )
    met = written(anchors.join(shared, "gram"), "shared-anchors")
    discard(anchors)
    discard(shared)
    spans = written(
        met.groupBy("t1", "t2").agg(
            F.count("*").alias("docs"), F.min("gram").alias("gram"), F.min(F.struct("doc", "row_key", "place")).alias("at")
        ),
        "span-counts",
    )
    everywhere = met.join(spans.where("docs > 1").select("t1", "t2"), ["t1", "t2"]).select(
        "doc", "row_key", (F.col("place") - (REACH - 1)).alias("start"), F.col("place").alias("end")
    )
    mixed = written(
        spans.groupBy("gram")
        .agg(F.count("*").alias("n"), F.min("docs").alias("rarest"))
        .where("n > 1 AND rarest = 1")
        .select("gram"),
        "open-grams",
    )
    wanted = (
        spans.join(mixed, "gram")
        .select("at.*", "t1", "t2", "docs")
        .groupBy("doc", "row_key")
        .agg(F.sort_array(F.collect_list(F.struct("place", "t1", "t2", "docs"))).alias("wanted"))
    )
    packed = rows.select(
        F.col("doc").alias("doc2"), F.col("row_key").alias("key2"), _packed("text").alias("packed")
    )
    cut = wanted.join(packed, same(F.col("doc"), F.col("doc2")) & (F.col("row_key") == F.col("key2"))).select(
        F.explode(F.arrays_zip("wanted", _cut_spans("packed", F.col("wanted.place")).alias("data"))).alias("e")
    )
    open_spans = written(
        cut.select(
            "e.wanted.t1", "e.wanted.t2", "e.wanted.docs",
            F.least(F.col("e.wanted.place"), F.lit(REACH - 1)).cast("int").alias("left"), "e.data",
        ).dropDuplicates(["t1", "t2"]),
        "open-spans",
    )
    refined = _refined(open_spans)
    partly = (
        refined
        .join(spans.select("t1", "t2", "at"), ["t1", "t2"])
        .select(
            "at.doc", "at.row_key", (F.col("at.place") - F.col("b")).alias("start"), (F.col("at.place") - F.col("a")).alias("end")
        )
    )
    found = written(
        everywhere.unionByName(partly)
        .groupBy("doc", "row_key")
        .agg(F.collect_set(F.struct("start", "end")).alias("r"))
        .select("doc", "row_key", F.col("r.start").alias("starts"), F.col("r.end").alias("ends")),
        "repeated-windows",
    )
    # The ranges are all that is still read.
    for table in (met, spans, mixed, open_spans, refined):
        discard(table)
    return found


def _with_windows(docs: DataFrame, repeated: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(
        F.col(id_col).alias("_id"), text_key(F.col(text_col)).alias("_key"), _packed(text_col).alias("_packed")
    )
    return rows.join(repeated, same(F.col("_id"), F.col("doc")) & (F.col("_key") == F.col("row_key")), "left")


def digests(docs: DataFrame, repeated: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, bytes, removed bytes and runs, and the hash of what stays."""
    return _with_windows(docs, repeated, id_col, text_col).select(
        F.col("_id").alias(id_col), _digest("_packed", "starts", "ends").alias("d")
    ).select(id_col, "d.*")


def kept_bytes(docs: DataFrame, repeated: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id and the bytes that stay; a cut may fall inside a character."""
    return _with_windows(docs, repeated, id_col, text_col).select(
        F.col("_id").alias(id_col), _kept_bytes("_packed", "starts", "ends").alias("kept")
    )
