"""Byte-level BPE over ragged arrays: pre-tokens of many texts at once, merged rank by rank.

Texts of a batch lie one after the other in a byte array. Pre-token bounds follow from the
classes of neighbouring code points alone, so they are found for the whole batch by array
comparisons. Each distinct pre-token is then one sequence of a ragged symbol array. A round
finds the lowest rank among the pairs of every sequence and applies it in all sequences, and at
all its places in a sequence, at once; a pair that holds a new symbol always ranks behind the
pair that made the symbol, so no place is applied too early. Sequences without a pair that can
be merged leave the array.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Classes of code points.
OTHER, LETTER, NUMBER, SPACING = 0, 1, 2, 3
NO_PAIR = np.int64(1 << 40)
#: Bytes of text handled at once; a longer text is cut between words where that changes nothing.
PIECE = 1 << 22
_CUT = re.compile(rb"[!-~] (?=[!-~])")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each code point, as the tokenizer library itself tells them apart."""
    from tokenizers import Regex, pre_tokenizers

    table = np.zeros(0x110000, dtype=np.uint8)
    # No version of Unicode has letters, numbers or spaces from 0x40000 on.
    points = np.array([c for c in range(0x40000) if not 0xD800 <= c < 0xE000])
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACING, r"\s+")):
        splitter = pre_tokenizers.Split(Regex(pattern), "removed")
        for low in range(0, len(points), 8192):
            part = points[low : low + 8192]
            inside = np.ones(len(part), dtype=bool)
            for _, (a, b) in splitter.pre_tokenize_str("".join(map(chr, part))):
                inside[a:b] = False
            table[part[inside]] = kind
    return table


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = {b: chr(b) for b in plain}
    others = [b for b in range(256) if b not in shown]
    return [shown.get(b) or chr(256 + others.index(b)) for b in range(256)]


def as_bytes(column: pa.Array, prefix: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column in one byte array, and the n + 1 offsets; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if prefix:
        column = pc.binary_join_element_wise(pa.scalar(prefix, pa.large_binary()), column, pa.scalar(b"", pa.large_binary()))
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray, size: int = PIECE):
    """(first row, segment offsets, rows of the segments) of pieces of about ``size`` bytes.

    A text that is longer is cut before single spaces between visible ASCII characters: there a
    pre-token ends whatever follows, so the parts give the tokens of the whole.
    """
    bounds, rows = [int(offsets[0])], []
    for row in range(len(offsets) - 1):
        at, end = int(offsets[row]), int(offsets[row + 1])
        if end - at > size:
            if rows:
                yield np.array(bounds), np.array(rows)
                bounds, rows = [at], []
            text = memoryview(data[at:end])
            start = 0
            while end - at - start > size:
                found = _CUT.search(text, start + size)
                if found is None:
                    break
                yield np.array([at + start, at + found.start() + 1]), np.array([row])
                start = found.start() + 1
            at += start
            bounds = [at]
        bounds.append(end)
        rows.append(row)
        if end - bounds[0] >= size:
            yield np.array(bounds), np.array(rows)
            bounds, rows = [end], []
    if rows:
        yield np.array(bounds), np.array(rows)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of runs that begin at ``starts``, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Points:
    """Code points of a byte array that holds texts one after the other."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        self.data = data
        self.at = np.flatnonzero((data & 0xC0) != 0x80)
        first = data[self.at]
        self.byte = first
        self.kind = _classes()[:128][np.minimum(first, 127)]
        wide = np.flatnonzero(first >= 0xC0)
        if len(wide):
            p, lead = self.at[wide], first[wide].astype(np.int32)
            padded = np.concatenate([data, np.zeros(3, dtype=np.uint8)])
            b1, b2, b3 = ((padded[p + k] & 0x3F).astype(np.int32) for k in (1, 2, 3))
            two = ((lead & 0x1F) << 6) | b1
            three = ((lead & 0x0F) << 12) | (b1 << 6) | b2
            four = ((lead & 0x07) << 18) | (b1 << 12) | (b2 << 6) | b3
            self.kind[wide] = _classes()[np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four))]
        #: True where a text begins, and once more behind the last code point.
        self.hard = np.zeros(len(self.at) + 1, dtype=bool)
        self.hard[np.searchsorted(self.at, starts)] = True
        self.hard[-1] = True

    def words(self) -> np.ndarray:
        """Byte offsets where texts begin, and before single spaces between visible characters."""
        n = len(self.at)
        if not n:
            return np.zeros(0, dtype=np.int64)
        start = self.hard[:-1].copy()
        seen = self.kind != SPACING
        inner = (self.byte[1:-1] == 0x20) & seen[:-2] & seen[2:] & ~self.hard[2:-1]
        start[1:-1] |= inner
        return self.at[start]

    def pre_tokens(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Byte offsets of all pre-tokens; from each of ``begins`` to its end all is one."""
        n = len(self.at)
        if not n:
            return np.zeros(0, dtype=np.int64)
        kind, byte, hard = self.kind, self.byte, self.hard
        space = kind == SPACING
        start = hard[:-1].copy()
        before, here = space[:-1], space[1:]
        goes_on = np.append(~space[2:] & ~hard[2:-1], False)  # a visible character follows
        start[1:] |= (
            (~before & ~here & (kind[1:] != kind[:-1]))
            | (before & ~here & (byte[:-1] != 0x20))
            | (~before & here)
            | (before & here & goes_on)
        )
        self._contractions(start)
        first, behind = np.searchsorted(self.at, begins), np.searchsorted(self.at, ends)
        start[ragged(first + 1, behind - first - 1)] = False
        return self.at[start]

    def _contractions(self, start: np.ndarray) -> None:
        """An apostrophe that begins a pre-token takes s, t, m, d, re, ve or ll with it."""
        quotes = np.flatnonzero((self.byte == 0x27) & start)
        n = len(self.at)
        quotes = quotes[(quotes + 1 < n)]
        quotes = quotes[~self.hard[quotes + 1]]
        if not len(quotes):
            return
        one = self.byte[quotes + 1]
        third = np.minimum(quotes + 2, n - 1)
        two = np.where((quotes + 2 < n) & ~self.hard[third], self.byte[third], 0)
        short = np.isin(one, np.frombuffer(b"stmd", dtype=np.uint8))
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        quotes, size = quotes[short | long], np.where(short, 2, 3)[short | long]
        start[quotes + 1] = False
        after = quotes + size
        start[after[after < n]] = True


class ByteBPE:
    """Vocabulary and merges of a byte-level BPE file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec["pre_tokenizer"]
        plain = (
            model["type"] == "BPE"
            and pre["type"] == "ByteLevel"
            and pre["use_regex"]
            and not pre["add_prefix_space"]
            and spec["normalizer"] is None
            and not (model.get("ignore_merges") or model.get("byte_fallback") or model.get("dropout"))
        )
        if not plain:
            raise ValueError("only plain byte-level BPE files are read")
        vocab = model["vocab"]
        symbols = byte_symbols()
        self.byte_id = np.array([vocab[s] for s in symbols], dtype=np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], dtype=np.int64) for k in (0, 1))
        result = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.base = int(max(vocab.values())) + 1
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of = keys[order], order.astype(np.int64)
        self.result = result
        made = dict(zip(result.tolist(), range(len(result))))
        if any(made.get(x, -1) >= r for r, pair in enumerate(zip(left.tolist(), right.tolist())) for x in pair):
            raise ValueError("a merge comes before one that makes its part")
        self.specials = {t["content"].encode(): t["id"] for t in spec["added_tokens"] if t["special"]}
        odd = [t for t in spec["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]]
        if odd or len(self.specials) != len(spec["added_tokens"]):
            raise ValueError("added tokens with options are not read")
        back = {s: b for b, s in enumerate(symbols)}
        #: The bytes of each id.
        self.token_bytes = [b""] * (max([self.base - 1, *self.specials.values()]) + 1)
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in token)
        for content, i in self.specials.items():
            self.token_bytes[i] = content
        self.token_size = np.array([len(t) for t in self.token_bytes], dtype=np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], NO_PAIR)

    def merge(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count per sequence) of the byte sequences that begin at ``starts``."""
        lengths = np.diff(np.append(starts, len(data)))
        ids = self.byte_id[data]
        last = np.zeros(len(ids), dtype=bool)
        last[starts + lengths - 1] = True
        rank = np.full(len(ids), NO_PAIR)
        inner = np.flatnonzero(~last)
        rank[inner] = self._ranks(ids[inner], ids[inner + 1])
        which = np.arange(len(starts))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(which):
            firsts = np.cumsum(lengths) - lengths
            lowest = np.minimum.reduceat(rank, firsts)
            live = lowest < NO_PAIR
            if not live.all():
                mask = np.repeat(live, lengths)
                done.append((which[~live], lengths[~live], ids[~mask]))
                ids, rank, last = ids[mask], rank[mask], last[mask]
                which, lengths, lowest = which[live], lengths[live], lowest[live]
                if not len(which):
                    break
            hit = rank == np.repeat(lowest, lengths)
            at = np.flatnonzero(hit)
            # in a run of one symbol the pairs overlap: every other one is taken, from the left
            fresh = np.concatenate([[True], np.diff(at) != 1])
            nth = np.arange(len(at))
            at = at[(nth - np.maximum.accumulate(np.where(fresh, nth, 0))) % 2 == 0]
            ids[at] = self.result[rank[at]]
            last[at] = last[at + 1]
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            owner = np.searchsorted(np.cumsum(lengths), at, side="right")
            lengths = lengths - np.bincount(owner, minlength=len(lengths))
            ids, rank, last = ids[keep], rank[keep], last[keep]
            at = at - np.arange(len(at))
            changed = np.concatenate([at, at[at > 0] - 1])
            ends = last[changed]
            rank[at] = NO_PAIR
            changed = changed[~ends]
            rank[changed] = self._ranks(ids[changed], ids[changed + 1])
        if not done:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        which, sizes, ids = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(which)
        firsts = np.cumsum(sizes) - sizes
        sizes = sizes[order]
        return ids[ragged(firsts[order], sizes)], sizes

    def special_places(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the special strings inside texts, leftmost first."""
        if not self.specials:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        whole = data.tobytes()
        if not any(s in whole for s in self.specials):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        pattern = re.compile(b"|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True)))
        bounds = np.append(starts, len(data)).tolist()
        found = [
            (a + m.start(), a + m.end()) for a, b in zip(bounds, bounds[1:]) if b > a for m in pattern.finditer(whole[a:b])
        ]
        places = np.array(found, dtype=np.int64).reshape(-1, 2)
        return places[:, 0], places[:, 1]


@lru_cache(maxsize=4)
def load(path: str) -> ByteBPE:
    """The vocabulary of a file, read once per process."""
    return ByteBPE(path)


def distinct(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each string, bytes of the distinct strings, their offsets).

    Strings begin at ``starts`` and end where the next one begins.
    """
    offsets = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
    strings = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, offsets, pa.py_buffer(data)])
    coded = strings.dictionary_encode()
    unique, bounds = as_bytes(coded.dictionary)
    return coded.indices.to_numpy(zero_copy_only=False), unique, bounds
