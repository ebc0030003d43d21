"""Alignment of two tokenizers over whole texts, scored by inverted pair bitmaps.

Each text is encoded by a byte-level BPE (A) and a sentence-piece model (B). Byte offsets where
tokens of both end cut it into groups, and the A and B token that end there are linked. For
every pair of ids the documents that link it are kept as an inverted list: documents are numbered
inside blocks of about ``BLOCK`` bytes of text, and a block holds, per pair, one compressed
bitmap for each binary digit of the number of links in a document (multiplicity planes). Partial
bitmaps of the pieces of a block are merged by OR as the block closes. Population counts of the
planes give the links of a pair, those of their OR its documents. The counts go back along the
bitmaps: each block adds up the scores of its own documents, so no list is longer than a block,
however frequent a pair is.

Texts are cut at single spaces between visible characters for the work, where no token of either
model goes on, and each distinct unit of a piece is encoded and aligned once.

Defined cases: null and empty texts, and texts whose tokens do not spell a space and the text
(such as those with U+2581), have no tokens: zeros and an empty digest. Rows that repeat an id
are documents of their own; a null id stays null. Very long texts are read in parts. Only id and
text are read. An empty table gives empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import written
from . import byte_bpe
from .byte_bpe import ragged

#: Bytes of text, and documents, of a block. Slots take 16 bits.
BLOCK = 1 << 24
SLOTS = 1 << 15
SLICE = 1 << 12
DOCUMENT, POSTING = 0, 1
_NONE = np.zeros(0, dtype=np.int64)


class Pieces:
    """A sentence-piece model with the bytes that each id stands for."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.size_of_vocab = n
        names = [self.model.id_to_piece(i) for i in range(n)]
        spelled = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(names)
        ]
        self.token_bytes = spelled
        self.token_size = np.array([len(b) for b in spelled], dtype=np.int64)
        self.offset = np.cumsum(self.token_size) - self.token_size
        self.flat = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        # a piece with a space behind another character could reach over a cut
        if any("▁" in p.lstrip("▁") for i, p in enumerate(names) if not self.model.is_control(i)):
            raise ValueError("pieces that go on behind a space are not read")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, tokens per text)."""
        found = self.model.encode(texts, num_threads=1)
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.fromiter(chain.from_iterable(found), dtype=np.int64, count=int(sizes.sum())), sizes


@lru_cache(maxsize=4)
def load_pieces(path: str) -> Pieces:
    return Pieces(path)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring ``bounds``."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[bounds])


class Units:
    """Distinct units of a piece, aligned."""

    def __init__(self, a: byte_bpe.ByteBPE, b: Pieces, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        sizes = np.diff(offsets)
        a_ids, self.n_a = self._encode_a(a, data, offsets)
        texts = [bytes(data[x + 1 : y]).decode("utf-8", "replace") for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        b_ids, self.n_b = b.encode(texts)
        self.ok = self._spelled(b, b_ids, data, offsets)
        a_ids, b_ids = a_ids[np.repeat(self.ok, self.n_a)], b_ids[np.repeat(self.ok, self.n_b)]
        a_end, b_end = np.cumsum(a.token_size[a_ids]), np.cumsum(b.token_size[b_ids])
        # ends of the units in the same coordinates, units that do not count being empty
        unit_end = np.cumsum(np.where(self.ok, sizes, 0))
        at = np.searchsorted(a_end, b_end)
        both = np.flatnonzero(a_end[np.minimum(at, len(a_end) - 1)] == b_end) if len(a_end) else _NONE
        common = b_end[both]
        self.pairs = a_ids[at[both]] * b.size_of_vocab + b_ids[both]
        groups = np.concatenate([[0], np.searchsorted(common, unit_end, side="right")])
        self.n_groups = np.diff(groups)
        self.first_pair = groups[:-1]
        self.strings = self._strings(a_ids, b_ids, np.searchsorted(common, a_end), np.searchsorted(common, b_end), groups, n)

    @staticmethod
    def _encode_a(a, data, offsets):
        starts = byte_bpe.Points(data, offsets[:-1]).pre_tokens(_NONE, _NONE)
        number, unique, bounds = byte_bpe.distinct(data, starts)
        ids, sizes = a.merge(unique, bounds[:-1])
        firsts = np.cumsum(sizes) - sizes
        sizes, firsts = sizes[number], firsts[number]
        return ids[ragged(firsts, sizes)], _sums(sizes, np.searchsorted(starts, offsets))

    def _spelled(self, b, ids, data, offsets):
        """Whether the pieces of each unit spell it."""
        sizes = np.diff(offsets)
        bounds = np.concatenate([[0], np.cumsum(self.n_b)])
        ok = _sums(b.token_size[ids], bounds) == sizes
        mine = ids[np.repeat(ok, self.n_b)]
        spelled = b.flat[ragged(b.offset[mine], b.token_size[mine])]
        wrong = spelled != data[np.repeat(ok, sizes)]
        good = np.flatnonzero(ok)
        ok[good] = _sums(wrong, np.concatenate([[0], np.cumsum(sizes[good])])) == 0
        return ok

    @staticmethod
    def _strings(a_ids, b_ids, a_group, b_group, groups, n) -> pa.Array:
        """``a1,a2|b1;`` for all groups of a unit, one string per unit."""
        key = np.concatenate([2 * a_group, 2 * b_group + 1])
        order = np.argsort(key, kind="stable")
        key, ids = key[order], np.concatenate([a_ids, b_ids])[order]
        width = np.ones(len(ids), dtype=np.int64)
        top = int(ids.max()) if len(ids) else 0
        for k in range(1, len(str(top))):
            width += ids >= 10**k
        end = np.cumsum(width + 1)
        out = np.empty(int(end[-1]) if len(end) else 0, dtype=np.uint8)
        follows = np.append(key[1:], -1)
        out[end - 1] = np.where(follows == key, ord(","), np.where(key % 2 == 0, ord("|"), ord(";")))
        rest = ids.copy()
        for k in range(len(str(top))):
            shown = width > k
            out[end[shown] - 2 - k] = 48 + rest[shown] % 10
            rest //= 10
        tokens = np.searchsorted(key, 2 * groups)
        bounds = np.concatenate([[0], end])[tokens]
        return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out)])


class _Block:
    """Documents of one block, and the links of their pairs."""

    def __init__(self, number: int):
        self.number, self.bytes = number, 0
        self.ids: list[pa.Array] = []
        self.n = 0
        self.sums = np.zeros((3, SLOTS), dtype=np.int64)
        self.ok = np.ones(SLOTS, dtype=bool)
        self.hashes: list = []
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, a, b, data: np.ndarray, bounds: np.ndarray, slots: np.ndarray) -> None:
        """One piece; ``slots`` are the documents of its segments."""
        starts = byte_bpe.Points(data, bounds[:-1]).words()
        number, unique, offsets = byte_bpe.distinct(data, starts)
        units = Units(a, b, unique, offsets)
        cut = np.searchsorted(starts, bounds)
        self.ok[slots[_sums(~units.ok[number], cut) > 0]] = False
        for k, values in enumerate((units.n_a, units.n_b, units.n_groups)):
            np.add.at(self.sums[k], slots, _sums(values[number], cut))
        text = units.strings.take(pa.array(number))
        chars, at = byte_bpe.as_bytes(text)
        chars, at = memoryview(np.ascontiguousarray(chars)), at[cut].tolist()
        for slot, x, y in zip(slots.tolist(), at, at[1:]):
            held = self.hashes[slot]
            # the mark behind a group is written when the next group comes
            if y > x:
                if held[1]:
                    held[0].update(b";")
                held[0].update(chars[x : y - 1])
                held[1] = True
        links = units.n_groups[number]
        pairs = units.pairs[ragged(units.first_pair[number], links)]
        slot = np.repeat(slots, np.diff(cut))
        keys, counts = np.unique((pairs << 16) | np.repeat(slot, links), return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)

    def open(self, ids: pa.Array) -> int:
        """Slots for the next documents; returns the first."""
        first = self.n
        self.ids.append(ids)
        self.n += len(ids)
        self.hashes.extend([hashlib.sha256(), False] for _ in range(len(ids)))
        return first

    def documents(self) -> dict:
        ok = self.ok[: self.n] & (self.sums[0, : self.n] > 0)
        n_a, n_b, groups = (np.where(ok, s[: self.n], 0) for s in self.sums)
        digests = [h[0].hexdigest() if good else "" for h, good in zip(self.hashes, ok.tolist())]
        return {
            "slot": pa.array(np.arange(self.n, dtype=np.int32)), "doc": pa.concat_arrays(self.ids),
            "n_a": pa.array(n_a), "n_b": pa.array(n_b), "n_groups": pa.array(groups), "groups_sha256": pa.array(digests),
        }

    def postings(self, base: int) -> Iterator[dict]:
        """One dict of columns per multiplicity plane."""
        if not self.keys:
            return
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        known = self.ok[keys & 0xFFFF]
        keys, counts = keys[known], counts[known]
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        if len(keys):
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys, counts = keys[first], np.add.reduceat(counts, first)
        plane, width = 0, (self.n + 7) // 8
        while len(counts) and (counts >> plane).any():
            inside = np.flatnonzero((counts >> plane) & 1)
            if len(inside):
                pair, slots = keys[inside] >> 16, (keys[inside] & 0xFFFF).astype("<u2")
                first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
                n = np.diff(np.append(first, len(pair)))
                fresh = np.add.reduceat(((counts[inside] & ((1 << plane) - 1)) == 0).astype(np.int64), first)
                dense = 2 * n > width
                yield {
                    "a": pa.array((pair[first] // base).astype(np.int32)), "b": pa.array((pair[first] % base).astype(np.int32)),
                    "plane": pa.array(np.full(len(n), plane, dtype=np.int32)), "dense": pa.array(dense),
                    "n": pa.array(n), "fresh": pa.array(fresh), "bits": _containers(slots, first, n, dense, width),
                }
            plane += 1


def _containers(slots: np.ndarray, first: np.ndarray, n: np.ndarray, dense: np.ndarray, width: int) -> pa.Array:
    """Compressed bitmaps: sorted 16-bit slots, or plain bits where these are shorter."""
    size = np.where(dense, width, 2 * n)
    end = np.cumsum(size)
    out = np.empty(int(end[-1]), dtype=np.uint8)
    sparse = ~dense
    out[ragged((end - size)[sparse], size[sparse])] = slots.view(np.uint8)[ragged(2 * first[sparse], size[sparse])]
    bits = np.zeros(width * 8, dtype=np.uint8)
    for k in np.flatnonzero(dense).tolist():
        bits[:] = 0
        bits[slots[first[k] : first[k] + n[k]]] = 1
        out[end[k] - width : end[k]] = np.packbits(bits, bitorder="little")
    offsets = np.concatenate([[0], end]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _schema(id_type: T.DataType) -> T.StructType:
    fields = {
        "kind": T.IntegerType(), "block": T.LongType(), "slot": T.IntegerType(), "doc": id_type, "n_a": T.LongType(),
        "n_b": T.LongType(), "n_groups": T.LongType(), "groups_sha256": T.StringType(), "a": T.IntegerType(),
        "b": T.IntegerType(), "plane": T.IntegerType(), "dense": T.BooleanType(), "n": T.LongType(), "fresh": T.LongType(),
        "bits": T.BinaryType(),
    }
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def aligned(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK
) -> DataFrame:
    """Documents (kind 0: counts and digest by block and slot) and postings (kind 1: bitmaps by pair, block and plane).

    The table is written once: block numbers belong to the tasks that wrote them.
    """
    schema = _schema(docs.schema[id_col].dataType)
    arrow = to_arrow_schema(schema)

    def rows(kind: int, number: int, columns: dict) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        columns = columns | {"kind": pa.array(np.full(n, kind, dtype=np.int32)), "block": pa.array(np.full(n, number, dtype=np.int64))}
        return pa.RecordBatch.from_arrays(
            [columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in arrow], schema=arrow
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_bpe.load(a_path), load_pieces(b_path)
        number = TaskContext.get().partitionId() << 32
        current = _Block(number)

        def close(done: _Block) -> Iterator[pa.RecordBatch]:
            if done.n:
                yield rows(DOCUMENT, done.number, done.documents())
                for columns in done.postings(b.size_of_vocab):
                    yield rows(POSTING, done.number, columns)

        for batch in batches:
            for low in range(0, batch.num_rows, SLICE):
                part = batch.slice(low, SLICE)
                if current.n + part.num_rows > SLOTS or current.bytes >= block:
                    yield from close(current)
                    number += 1
                    current = _Block(number)
                first = current.open(part.column(0))
                data, offsets = byte_bpe.as_bytes(part.column(1), b" ")
                current.bytes += len(data)
                for bounds, texts in byte_bpe.pieces(data, offsets):
                    current.add(a, b, data[bounds[0] : bounds[-1]], bounds - bounds[0], first + texts)
        yield from close(current)

    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    return written(texts.mapInArrow(run, schema), "aligned")


def pair_counts(table: DataFrame) -> DataFrame:
    """(a, b, n_links, n_docs, best) of every linked pair; ``best``: no A id has more links with b."""
    pairs = table.where(F.col("kind") == POSTING).groupBy("a", "b").agg(
        F.sum(F.expr("shiftleft(n, plane)")).alias("n_links"), F.sum("fresh").alias("n_docs")
    )
    pairs = written(pairs, "pair-counts")
    # as many rows as B has ids
    top = pairs.groupBy("b").agg(F.max("n_links").alias("_top"))
    return pairs.join(top, "b").select("a", "b", "n_links", "n_docs", (F.col("n_links") == F.col("_top")).alias("best"))


def _add_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block: (block, slot, count_sum, n_best) of the slots that have links."""

    def close(number, totals):
        used = np.flatnonzero(totals[2])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(used), number, dtype=np.int64)), pa.array(used.astype(np.int32)), pa.array(totals[0][used]), pa.array(totals[1][used])],
            names=["block", "slot", "count_sum", "n_best"],
        )

    current, totals = None, None
    for batch in batches:
        block, plane, dense, links, best = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 3, 4))
        cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else _NONE
        for x, y in zip(cuts.tolist(), np.append(cuts[1:], len(block)).tolist()):
            if current != block[x]:
                if current is not None:
                    yield close(current, totals)
                current, totals = int(block[x]), np.zeros((3, SLOTS), dtype=np.int64)
            slots, sizes = _slots(batch.column(5).slice(x, y - x), dense[x:y])
            times = np.int64(1) << plane[x:y].astype(np.int64)
            np.add.at(totals[0], slots, np.repeat(links[x:y] * times, sizes))
            np.add.at(totals[1], slots, np.repeat(np.where(best[x:y], times, 0), sizes))
            totals[2][slots] = 1
    if current is not None:
        yield close(current, totals)


def _slots(bits: pa.Array, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots of all containers, one after the other, number of slots of each)."""
    data, offsets = byte_bpe.as_bytes(bits)
    sizes = np.diff(offsets) // 2
    found = []
    if dense.any():
        at = 0
        for k in np.flatnonzero(dense).tolist():
            found.append(data[offsets[at] : offsets[k]].view("<u2"))
            plain = np.flatnonzero(np.unpackbits(data[offsets[k] : offsets[k + 1]], bitorder="little")).astype("<u2")
            found.append(plain)
            sizes[k], at = len(plain), k + 1
        found.append(data[offsets[at] :].view("<u2"))
        return np.concatenate(found).astype(np.int64), sizes
    return data.view("<u2").astype(np.int64), sizes


def scores(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """(block, slot, count_sum, n_best) of the documents that have links."""
    found = table.where(F.col("kind") == POSTING).join(pairs, ["a", "b"]).select(
        "block", "plane", "dense", "n_links", "best", "bits"
    )
    return found.repartition("block").sortWithinPartitions("block").mapInArrow(
        _add_scores, "block long, slot int, count_sum long, n_best long"
    )


def digests(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Per document: tokens of both, groups, links, best links, sum of counts, digest of the groups."""
    table = aligned(docs, a_path, b_path, id_col, text_col, block)
    found = scores(table, written(pair_counts(table), "pair-scores"))
    rows = table.where(F.col("kind") == DOCUMENT).select("block", "slot", "doc", "n_a", "n_b", "n_groups", "groups_sha256")
    return rows.join(found, ["block", "slot"], "left").select(
        F.col("doc").alias(id_col), "n_a", "n_b", "n_groups",
        # the ranges of two tokens end together at a common end only, once
        F.col("n_groups").alias("n_links"),
        F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"),
        "groups_sha256",
    )
