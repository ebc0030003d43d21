"""Line dedup: lines that many documents share stay only in one of them.

The hashes of all long lines are range-partitioned by (hash, document) and sorted inside each
partition by hash, document and position, so that a line held by a third of all rows is cut
over as many partitions as it needs. A task streams its sorted rows, holds the rows of at most
``min_docs`` documents at a time, and writes the positions that go. Only the first and last
hash of a partition can go on in a neighbour; their few undecided rows are settled by a table
of at most two rows per partition. What comes back is one compressed keep bitmap per document,
never text.

Defined cases: a null or empty text is one empty line. A null id counts as one document that
is smaller than every other. Rows that repeat an id count as one document and keep or lose
their lines alike; a row is named by its id and the hash of its text. Lines of very long texts
are read in place. Other columns of the input are not read by ``keep_bitmaps``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import written
from .common import SPACE, same, text_key

MIN_CHARS = 20
MIN_DOCS = 3
DROP, OPEN, SUMMARY = 0, 1, 2


def _long_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, row, pos = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                for k, line in enumerate((text or "").split("\n")):
                    line = line.strip(SPACE)
                    if len(line) >= min_chars:
                        # bytes.lower() changes A-Z only
                        digests.append(xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass").lower()))
                        row.append(i)
                        pos.append(k)
            halves = np.frombuffer(b"".join(digests), dtype=">i8").astype("int64").reshape(-1, 2)
            take = pa.array(row, type=pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(halves[:, 0]), pa.array(halves[:, 1]),
                    batch.column(0).take(take), batch.column(1).take(take), pa.array(pos, type=pa.int32()),
                ],
                names=["h1", "h2", "doc", "row_key", "pos"],
            )

    return run


class _Run:
    """The rows of one hash, fed in pieces, largest document first."""

    def __init__(self, key: tuple[int, int], min_docs: int, emit):
        self.key, self.min_docs, self.emit = key, min_docs, emit
        self.n_docs, self.last, self.held = 0, None, []

    def feed(self, docs: list, keys: list, pos: list) -> None:
        for doc, key, p in zip(docs, keys, pos):
            if self.n_docs == 0 or doc != self.last:
                self.n_docs, self.last = self.n_docs + 1, doc
                if self.n_docs == self.min_docs:
                    # all but the largest document lose the line for certain
                    for rank, row in self.held:
                        if rank > 1:
                            self.emit(DROP, self.key, row)
                    self.held = [x for x in self.held if x[0] == 1]
            if self.n_docs >= self.min_docs and self.n_docs > 1:
                self.emit(DROP, self.key, (doc, key, p))
            else:
                self.held.append((self.n_docs, (doc, key, p)))

    def close(self, goes_on_before: bool, goes_on_after: bool) -> None:
        if goes_on_before or goes_on_after:
            if goes_on_after or self.n_docs < self.min_docs:
                for _, row in self.held:
                    self.emit(OPEN, self.key, row)
            first = self.held[0][1]
            self.emit(SUMMARY, self.key, (first[0], None, self.n_docs))


def _stream(min_docs: int, doc_type: pa.DataType):
    names = ["kind", "h1", "h2", "doc", "row_key", "n"]
    types = [pa.int8(), pa.int64(), pa.int64(), doc_type, pa.int64(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def emit(kind, key, row):
            out.append((kind, *key, *row))

        def flush():
            columns = list(zip(*out)) or [()] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=names)

        current, first = None, True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            h1, h2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            starts = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]))
            ends = np.append(starts[1:], n)
            # A hash with one row inside the batch concerns one document only.
            wanted = (ends - starts > 1) | (starts == 0) | (ends == n)
            for a, b in zip(starts[wanted].tolist(), ends[wanted].tolist()):
                key = (int(h1[a]), int(h2[a]))
                if current is None or current.key != key:
                    if current is not None:
                        current.close(first, False)
                        first = False
                    current = _Run(key, min_docs, emit)
                rows = (batch.column(i).slice(a, b - a).to_pylist() for i in (2, 3, 4))
                current.feed(*rows)
                if len(out) > 50_000:
                    yield flush()
        if current is not None:
            current.close(first, True)
        yield flush()

    return run


@F.pandas_udf(T.BinaryType())
def _bitmap(dropped: pd.Series) -> pd.Series:
    """Compressed bits, one per line up to the last dropped one: 1 keeps, 0 drops."""

    def pack(positions):
        bits = np.ones((int(max(positions)) + 8) // 8 * 8, dtype=np.uint8)
        bits[np.asarray(positions)] = 0
        return zlib.compress(np.packbits(bits).tobytes())

    return dropped.map(pack)


@F.pandas_udf(T.StringType())
def _kept_text(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    def keep(t, b):
        if b is None or t is None:
            return t
        bits = np.unpackbits(np.frombuffer(zlib.decompress(b), dtype=np.uint8))
        return "\n".join(x for i, x in enumerate(t.split("\n")) if i >= len(bits) or bits[i])

    return pd.Series([keep(t, b) for t, b in zip(text, bitmap)], dtype=object)


def keep_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """(doc, row_key, keep_bitmap, n_dropped) of the documents that lose lines."""
    if min_docs < 2:
        raise ValueError("a line is shared by two documents at least")
    doc_type = docs.schema[id_col].dataType
    lines = docs.select(
        F.col(id_col).alias("doc"), text_key(F.col(text_col)).alias("row_key"), F.col(text_col).alias("text")
    ).mapInArrow(
        _long_lines(min_chars),
        T.StructType(
            [
                T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("doc", doc_type),
                T.StructField("row_key", T.LongType()), T.StructField("pos", T.IntegerType()),
            ]
        ),
    )
    # Written first, so that choosing the ranges does not read the texts a second time.
    ranged = (
        written(lines, "line-hashes")
        .repartitionByRange("h1", "h2", "doc")
        .sortWithinPartitions("h1", "h2", F.desc_nulls_last("doc"), "row_key", "pos")
    )
    schema = T.StructType(
        [
            T.StructField("kind", T.ByteType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()),
            T.StructField("doc", doc_type), T.StructField("row_key", T.LongType()), T.StructField("n", T.IntegerType()),
        ]
    )
    found = written(ranged.mapInArrow(_stream(min_docs, to_arrow_type(doc_type)), schema), "line-drops")
    # At most two rows for each partition of the sort, so this table is small at any size.
    totals = (
        found.where(F.col("kind") == SUMMARY)
        .groupBy("h1", "h2")
        .agg(F.sum("n").alias("total"), F.max("doc").alias("keeper"))
    )
    settled = (
        found.where(F.col("kind") == OPEN)
        .join(F.broadcast(totals), ["h1", "h2"])
        .where((F.col("total") >= min_docs) & ~same(F.col("doc"), F.col("keeper")))
    )
    columns = ["doc", "row_key", F.col("n").alias("pos")]
    dropped = found.where(F.col("kind") == DROP).select(*columns).unionByName(settled.select(*columns))
    return (
        dropped.groupBy("doc", "row_key")
        .agg(F.sort_array(F.collect_set("pos")).alias("positions"))
        .select("doc", "row_key", _bitmap("positions").alias("keep_bitmap"), F.size("positions").alias("n_dropped"))
    )


def _with_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_row`` with all columns of a document, ``_text``, and its bitmap where it loses lines."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col(id_col).alias("_id"),
        F.col(text_col).alias("_text"),
        text_key(F.col(text_col)).alias("_key"),
    )
    found = rows.join(
        bitmaps, same(F.col("_id"), F.col("doc")) & (F.col("_key") == F.col("row_key")), "left"
    )
    changed = F.col("keep_bitmap").isNotNull()
    kept = _kept_text(F.when(changed, F.col("_text")), "keep_bitmap")
    return found.withColumn("_kept", F.when(changed, kept).otherwise(F.col("_text")))


def digests(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, lines before, lines dropped, and the hash of what stays."""
    whole = F.coalesce("_text", F.lit(""))
    return _with_bitmaps(docs.select(id_col, text_col), bitmaps, id_col, text_col).select(
        F.col("_id").alias(id_col),
        F.size(F.split(whole, "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(F.coalesce("_kept", F.lit("")), 256).alias("kept_sha256"),
    )


def without_repeated_lines(
    docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents with their kept text; all other columns as they are."""
    row = F.col("_row").withField(f"`{text_col}`", F.col("_kept"))
    return _with_bitmaps(docs, bitmaps, id_col, text_col).select(row.alias("_row")).select("_row.*")
