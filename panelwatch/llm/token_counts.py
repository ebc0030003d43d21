"""Token counts of whole texts by a byte-level BPE vocabulary, by rank-synchronous array merging.

A task holds the pre-tokens of about ``byte_bpe.PIECE`` bytes of text as one ragged array, merges
all distinct ones together, the lowest-ranked pair of each sequence in every round, and counts
the symbols that survive. Nothing is shuffled.

Special strings inside a text (``special=True``) are one token each, as the library has it by
default; otherwise they are plain text.

Defined cases: a null or empty text has no bytes and no tokens. Rows that repeat an id are
counted one by one, a null id stays null. Very long texts are read in parts, cut where the
tokens stay the same; a run without such a place (no single space between visible ASCII
characters) is held whole. Only id and text are read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import byte_bpe

LIMIT = 512


def _piece_counts(model: byte_bpe.ByteBPE, data: np.ndarray, bounds: np.ndarray, special: bool) -> np.ndarray:
    """Tokens of each text of a piece; ``bounds`` are its n + 1 offsets."""
    texts = bounds[:-1]
    begins = ends = np.zeros(0, dtype=np.int64)
    if special:
        begins, ends = model.special_places(data, texts)
    starts = byte_bpe.Points(data, np.concatenate([texts, begins, ends])).pre_tokens(begins, ends)
    if not len(starts):
        return np.zeros(len(texts), dtype=np.int64)
    number, unique, offsets = byte_bpe.distinct(data, starts)
    _, sizes = model.merge(unique, offsets[:-1])
    tokens = sizes[number]
    tokens[np.searchsorted(starts, begins)] = 1
    total = np.concatenate([[0], np.cumsum(tokens)])
    return np.diff(total[np.searchsorted(starts, bounds)])


def counts(model: byte_bpe.ByteBPE, column: pa.Array, special: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, tokens) of every text of a column."""
    data, offsets = byte_bpe.as_bytes(column)
    tokens = np.zeros(len(column), dtype=np.int64)
    for bounds, rows in byte_bpe.pieces(data, offsets):
        part = data[bounds[0] : bounds[-1]]
        np.add.at(tokens, rows, _piece_counts(model, part, bounds - bounds[0], special))
    return np.diff(offsets), tokens


def token_counts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, special: bool = True
) -> DataFrame:
    """Id, UTF-8 bytes, tokens, and whether the tokens exceed ``limit``, of every document.

    ``path`` names the vocabulary file, which every executor must be able to read.
    """
    id_type = docs.schema[id_col].dataType
    arrow_id = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = byte_bpe.load(path)
        for batch in batches:
            size, tokens = counts(model, batch.column(1), special)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(arrow_id), pa.array(size), pa.array(tokens)], names=["_id", "n_bytes", "n_tokens"]
            )

    schema = T.StructType([T.StructField("_id", id_type), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, schema).select(
        F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
