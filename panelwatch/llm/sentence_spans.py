"""Substring dedup over sliding runs of sentences.

Each character of a script without spaces (Chinese, Japanese, Thai and so on) is a word of its own.
A text is cut into sentences at line ends and after end marks, full-width ones too, and inside a sentence after each word
whose hash is the smallest, ties included, of some ``NEAR`` words in a row; a word before an end mark
counts as smaller than any other there. So every ``NEAR`` words in a row hold a cut, whatever the
words are, and a run of equal words is cut after each. A cut depends on ``NEAR`` - 1 words to each
side and the marks between them, so a passage is cut alike wherever it stands, but for that many words
at its ends: one of 4 * ``NEAR`` + 10 words, 42, always holds a whole span. From every such sentence runs the shortest span of at least ``SENTENCES`` of them and ``WORDS`` words; its
normalised words are hashed and counted over all documents. The first occurrence of a span, by
document and position, stays; every sentence under a later one goes. Hashes are counted first and
only those found again go on, with their first place as an aggregate, so a passage that a third
of all rows share is one row of that table.

Defined cases: null and empty texts have no sentences and stay as they are. Sentences without
words add nothing to a span's hash, and go only with the sentences around them. A null id is
smaller than every other. Rows that repeat an id are ordered by the hash of their text; rows that
repeat id and text are the same place, and lose sentences alike. Only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import written
from .common import same, text_key
from .hashed_text import IN_WORD, LOWER

#: A span has at least so many sentences and so many words.
SENTENCES = 2
WORDS = 12
#: So many words in a row hold the end of a sentence.
NEAR = 8
#: Bytes read at a time; more where a single sentence is longer.
PIECE = 1 << 20

_ENDS = np.zeros(256, dtype=bool)
_ENDS[list(b".!?\n")] = True
#: First code points of ranges in and out of scripts without spaces, in turn.
_SPACELESS = np.array(
    [
        0x0E00, 0x1000, 0x1000, 0x10A0, 0x1780, 0x1800, 0x1950, 0x19E0, 0x1A20, 0x1AB0, 0x3005, 0x3008, 0x3041, 0x3130,
        0x31A0, 0x31C0, 0x31F0, 0x3200, 0x3400, 0x4DC0, 0x4E00, 0xA4D0, 0xF900, 0xFB00, 0xFF66, 0xFFA0, 0x1B000, 0x1B300,
        0x20000, 0x40000,
    ]
)
#: Ideographic full stop, full-width . ! ? and the half-width full stop.
_WIDE_ENDS = np.array([0x3002, 0xFF0E, 0xFF01, 0xFF1F, 0xFF61])
_FACTORS = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)


@lru_cache(maxsize=8)
def _powers(factor: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = (np.full(size, f, dtype=np.uint64) for f in (factor, pow(factor, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _sums(values: np.ndarray, factor: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of values times rising powers, and the falling powers that undo them."""
    up, down = _powers(factor, 1 << max(16, len(values).bit_length()))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)]), down


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _wide(low: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places and code points of the characters of three and of four bytes; none is cut off."""
    found = []
    for size, least, most in ((3, 0xE0, 0xF0), (4, 0xF0, 0xF8)):
        at = np.flatnonzero((low >= least) & (low < most))
        at = at[at + size <= len(low)]
        points = low[at].astype(np.int64) & (0xFF >> (size + 1))
        for i in range(1, size):
            points = points << 6 | (low[at + i] & 0x3F)
        found.append((size, at, points))
    return found


def _over(values: np.ndarray, n: int, pick: np.ufunc) -> np.ndarray:
    """The least or most of each n values in a row."""
    size = 1
    while size < n:
        step = min(size, n - size)
        values = pick(values[:-step], values[step:])
        size += step
    return values


def _cut(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the words, their hashes, and the number of the first word of each sentence."""
    low = LOWER[data]
    inside = np.concatenate([[False], IN_WORD[low], [False]])
    ending, split = _ENDS[low], np.zeros(len(low) + 1, dtype=bool)
    if (low >= 0xE0).any():
        for size, at, points in _wide(low):
            alone = at[np.searchsorted(_SPACELESS, points, "right") % 2 == 1]
            split[alone] = split[alone + size] = True
            marks = at[np.isin(points, _WIDE_ENDS)]
            ending[marks] = True
            for i in range(size):
                inside[marks + 1 + i] = False
    starts = np.flatnonzero(inside[1:] & (split | ~inside[:-1]))
    ends = np.flatnonzero(inside[:-1] & (split | ~inside[1:]))
    sums, undo = _sums(low.astype(np.uint64) + np.uint64(1), _FACTORS[0])
    words = _mixed((sums[ends] - sums[starts]) * undo[starts])
    marks = np.concatenate([[0], np.cumsum(ending)])
    after = marks[starts[1:]] > marks[ends[:-1]]
    if len(words) >= NEAR:
        order = words.copy()
        order[:-1][after] = 0
        edge = np.zeros(NEAR - 1, dtype=np.uint64)
        least = np.concatenate([edge, _over(order, NEAR, np.minimum), edge])
        # the greatest of the minima around a word is its own where it is one of them
        after = after | (order == _over(least, NEAR, np.maximum))[:-1]
    first = np.flatnonzero(np.concatenate([[len(words) > 0], after]))
    return starts, words, first


def spans(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes, begin and end of each span, in bytes of the text."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    found, at, size, back = [], 0, PIECE, 0
    with np.errstate(over="ignore"):
        while at < len(data):
            last = at + size >= len(data)
            # cuts depend on the words before the part and behind it
            starts, words, first = _cut(data[back : at + size])
            begin = np.searchsorted(starts, at - back)
            bounds = np.concatenate([np.arange(begin, len(words))[:1], first[first > begin]])
            bounds = np.append(bounds, len(words)) if last else bounds[bounds <= len(words) - NEAR]
            n = max(0, len(bounds) - 1)
            here = np.arange(n)
            stop = np.maximum(here + SENTENCES, np.searchsorted(bounds, bounds[:n] + WORDS))
            whole = stop <= n
            a, b = bounds[:n][whole], bounds[stop[whole]]
            hashes = []
            for factor in _FACTORS:
                sums, undo = _sums(words, factor)
                hashes.append(_mixed((sums[b] - sums[a]) * undo[a]).view(np.int64))
            places = np.append(starts + back, min(at + size, len(data)))
            found.append((*hashes, places[a], places[b]))
            if last:
                break
            done = int(whole.sum())
            if done:
                at, size, back = int(places[bounds[done]]), PIECE, int(places[max(0, bounds[done] - NEAR + 1)])
            else:
                size *= 2
    none = np.empty(0, dtype=np.int64)
    return tuple(np.concatenate([none, *column]) for column in zip(*found)) if found else (none,) * 4


def _span_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [spans(text) for text in batch.column(2).to_pylist()]
        h1, h2, first, last = (np.concatenate([np.empty(0, np.int64), *c]) for c in zip(*found)) if found else (np.empty(0, np.int64),) * 4
        take = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(h1), pa.array(h2), batch.column(0).take(take), batch.column(1).take(take), pa.array(first), pa.array(last)],
            names=["h1", "h2", "doc", "row_key", "first", "last"],
        )


def _without(text: str | None, firsts, lasts) -> tuple[str | None, int]:
    """The text without its spans (begin, end), and the bytes removed."""
    if text is None or firsts is None:
        return text, 0
    data, pieces, at, removed = text.encode("utf-8", "surrogatepass"), [], 0, 0
    for a, b in sorted(zip(firsts, lasts)):
        pieces.append(data[at : max(a, at)])
        removed += max(0, b - max(a, at))
        at = max(at, b)
    return b"".join([*pieces, data[at:]]).decode("utf-8", "surrogatepass"), removed


RESULT = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("kept", T.StringType()), T.StructField("kept_sha256", T.StringType()),
    ]
)


@F.pandas_udf(RESULT)
def _kept(text: pd.Series, firsts: pd.Series, lasts: pd.Series) -> pd.DataFrame:
    rows = []
    for t, a, b in zip(text, firsts, lasts):
        kept, removed = _without(t, a, b)
        digest = hashlib.sha256((kept or "").encode("utf-8", "surrogatepass")).hexdigest()
        rows.append((len((t or "").encode("utf-8", "surrogatepass")), removed, kept, digest))
    return pd.DataFrame(rows, columns=RESULT.names)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, row_key, firsts, lasts): the spans of each document that an earlier place has too, in bytes."""
    rows = docs.select(F.col(id_col).alias("doc"), text_key(F.col(text_col)).alias("row_key"), F.col(text_col).alias("text"))
    schema = T.StructType(
        [
            T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()),
            T.StructField("doc", docs.schema[id_col].dataType), T.StructField("row_key", T.LongType()),
            T.StructField("first", T.LongType()), T.StructField("last", T.LongType()),
        ]
    )
    # The texts are cut twice, so that spans that occur once are neither written nor joined by place.
    found = rows.mapInArrow(_span_rows, schema)
    # Counts are written before they are joined back, so that the join may split a frequent key.
    again = written(found.select("h1").groupBy("h1").agg(F.count("*").alias("n")).where("n > 1").select("h1"), "shared-spans")
    met = written(found.join(again, "h1"), "spans")
    place = F.struct(F.col("doc").isNotNull().alias("known"), "doc", "row_key", "first")
    shared = written(met.groupBy("h1", "h2").agg(F.min(place).alias("place")), "first-places")
    later = met.join(shared, ["h1", "h2"]).where(~same(place, F.col("place")))
    return (
        later.groupBy("doc", "row_key")
        .agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("s"))
        .select("doc", "row_key", F.col("s.first").alias("firsts"), F.col("s.last").alias("lasts"))
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, bytes, removed bytes, the kept text and its hash."""
    repeated = repeated_spans(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("_id"), text_key(F.col(text_col)).alias("_key"), F.col(text_col).alias("_text"))
    met = rows.join(repeated, same(F.col("_id"), F.col("doc")) & (F.col("_key") == F.col("row_key")), "left")
    return met.select(F.col("_id").alias(id_col), _kept("_text", "firsts", "lasts").alias("r")).select(id_col, "r.*")
