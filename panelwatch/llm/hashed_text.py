"""Hashed n-gram indicators of texts, and the bounded labelled samples that models are fitted on.

All work on a text is vectorised over its bytes; a very long text is read in overlapping pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import text_key

BITS = 18
SIZE = 1 << BITS
#: One row of ten tenths of labels: rows of this remainder are never learned from.
FOLDS, HELD_OUT = 5, 0
#: Most labelled rows that a model is fitted on; the first by hash of the id.
MAX_LABELLED = 12_000
PIECE = 1 << 20
#: Bytes at the beginning of longer words that are features of their own, for inflected forms.
PREFIXES = (4, 5, 6, 7)
GAPS = (1, 2)
_BASE, _INVERSE = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.ones(256, dtype=bool)
IN_WORD[:128] = [chr(c).isalnum() for c in range(128)]


def _powers(base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        factors = np.full(PIECE + 1, base, dtype=np.uint64)
        factors[0] = 1
        return np.cumprod(factors, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE), _powers(_INVERSE)


def _slot(values: np.ndarray, kind: int) -> np.ndarray:
    """Place of each value in the table, by a hash that differs for each kind of n-gram."""
    with np.errstate(over="ignore"):
        x = values ^ np.uint64(kind * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - BITS)).astype(np.int64)


def _parts(data: np.ndarray) -> Iterator[np.ndarray]:
    """The bytes of a text in parts of up to ``PIECE``, cut between words; a part begins with the last but
    one word of the part before, so that no pair of neighbours is lost or made up."""
    at = 0
    while at + PIECE < len(data):
        inside = IN_WORD[data[at : at + PIECE]]
        starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
        if len(starts) > 2 and starts[-2] > PIECE // 2:
            yield data[at : at + int(starts[-1])]
            at += int(starts[-2])
        else:  # a word without end is cut
            yield data[at : at + PIECE]
            at += PIECE
    yield data[at:]


def _mark(data: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Mark the n-grams of one part; return how many words repeat the one or the two before, of how many."""
    low = LOWER[data]
    inside = np.concatenate([[False], IN_WORD[low], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _UP[: len(low)], dtype=np.uint64)])
        words = (sums[ends] - sums[starts]) * _DOWN[starts]
        seen[_slot(words, 1)] = True
        if len(words) > 1:
            seen[_slot(words[:-1] * np.uint64(_BASE) + words[1:], 2)] = True
        wide = data.astype(np.uint64)
        if len(wide) > 2:
            seen[_slot(wide[:-2] << np.uint64(16) | wide[1:-1] << np.uint64(8) | wide[2:], 3)] = True
    return np.array([[(words[gap:] == words[:-gap]).sum(), max(0, len(words) - gap)] for gap in GAPS])


def indicators(text: str | None, seen: np.ndarray) -> np.ndarray:
    """Sorted places of the text's n-grams: words, pairs of words and three bytes in a row.

    ``seen`` is a table of ``SIZE`` false values and is left so.
    """
    again = np.zeros((len(GAPS), 2), dtype=np.int64)
    for part in _parts(np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)):
        again = again + _mark(part, seen)
    # how much of a text repeats its neighbours, in quarters, as an n-gram of its own
    shares = [gap * 16 + (4 * int(k) + int(n) - 1) // int(n) for gap, (k, n) in zip(GAPS, again) if n]
    seen[_slot(np.array(shares, dtype=np.uint64), 4)] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


def distinct_word_hashes(text: str | None) -> np.ndarray:
    return np.unique(word_hashes(text))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words, pairs of neighbouring words, and beginnings of words."""
    found = []
    for part in _parts(np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)):
        low = LOWER[part]
        inside = np.concatenate([[False], IN_WORD[low], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _UP[: len(low)], dtype=np.uint64)])
            words = (sums[ends] - sums[starts]) * _DOWN[starts]
            found += [words, (words[:-1] * np.uint64(_BASE) + words[1:]) ^ np.uint64(1 << 40)]
            for length in PREFIXES:
                long = ends - starts > length
                heads = (sums[starts[long] + length] - sums[starts[long]]) * _DOWN[starts[long]]
                found.append(heads ^ np.uint64(1 << 41))
    return np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)


def held_out(id_col: Column) -> Column:
    """Whether a row is kept from learning: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(id_col.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def table_places() -> Callable[[str | None], np.ndarray]:
    """Places of a text in the hashed table, as a function with a table of its own."""
    seen = np.zeros(SIZE, dtype=bool)
    return lambda text: indicators(text, seen)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, targets: list[str], id_col: str, text_col: str, features: Callable, most: int
) -> DataFrame:
    """(doc, targets, places) of at most ``most`` labelled documents outside the held-out part.

    Ids with a null or with contradicting labels are left out. The ids are broadcast: there are
    at most ``most``.
    """
    agreed = labels.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("doc")).agg(
        *[F.min(t).alias(t) for t in targets], *[F.max(t).alias(f"max_{t}") for t in targets]
    )
    for t in targets:
        agreed = agreed.where(F.col(t).isNotNull() & (F.col(t) == F.col(f"max_{t}"))).drop(f"max_{t}")
    chosen = agreed.orderBy(F.xxhash64("doc"), "doc").limit(most)
    rows = docs.select(F.col(id_col).alias("doc"), text_key(F.col(text_col)).alias("row_key"), F.col(text_col).alias("text"))
    found = rows.join(F.broadcast(chosen), "doc").select("doc", "row_key", *targets, "text")
    fields = [found.schema[c] for c in ("doc", "row_key", *targets)]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places_of = features()
        for batch in batches:
            places = [places_of(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(places, type=pa.list_(pa.int64()))], names=[*(f.name for f in fields), "places"]
            )

    marked = found.mapInArrow(extract, T.StructType([*fields, T.StructField("places", T.ArrayType(T.LongType()))]))
    return marked.groupBy("doc").agg(F.min_by(F.struct(*targets, "places"), "row_key").alias("r")).select("doc", "r.*")


def fitted(sample: DataFrame, fit: Callable[[list, list[np.ndarray]], bytes], targets: list[str]) -> bytes:
    """Fit one model on a sample, in one task; returns what ``fit`` makes of labels and places.

    The sample is bounded by its maker and the model by its table, so both fit one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(len(targets) + 1)]
            places = [np.asarray(p.values, dtype=np.int64) for p in batch.column(len(targets) + 1)]
            rows.extend(zip(*columns, places))
        rows.sort(key=lambda r: r[0])
        labels = [tuple(r[1:-1]) for r in rows]
        yield pa.RecordBatch.from_arrays([pa.array([fit(labels, [r[-1] for r in rows])], type=pa.binary())], names=["model"])

    schema = T.StructType([T.StructField("model", T.BinaryType())])
    return bytes(sample.select("doc", *targets, "places").repartition(1).mapInArrow(run, schema).first()["model"])


def scored(
    docs: DataFrame, id_col: str, text_col: str, features: Callable, names: list[str], score: Callable[[np.ndarray], tuple]
) -> DataFrame:
    """(id, *names): the scores of every whole text."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places_of = features()
        for batch in batches:
            found = [score(places_of(t)) for t in batch.column(1).to_pylist()]
            columns = list(zip(*found)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, type=pa.float64()) for c in columns]], names=[id_col, *names]
            )

    schema = T.StructType(
        [T.StructField(id_col, rows.schema["_id"].dataType), *[T.StructField(n, T.DoubleType()) for n in names]]
    )
    return rows.mapInArrow(run, schema)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))
