"""Words of whole texts as numpy arrays, straight from Arrow buffers.

A slice of a string column is one byte buffer plus document offsets. Words are runs
of bytes other than 0x20 and 0x09-0x0D, which is safe on UTF-8 because separators are
single bytes there. Nothing here makes a Python object for each word, so one pass
over a text costs a few dozen nanoseconds a character, and a slice is bounded in bytes
(a longer single document is one slice), which bounds a worker's memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1_000_000

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_MULT = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_POW: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, at least n of each."""
    if not _POW or len(_POW[0]) < n:
        size = max(n, SLICE_BYTES) + 1
        up = np.full(size, _MULT, dtype=np.uint64)
        down = np.full(size, pow(_MULT, -1, 2**64), dtype=np.uint64)
        up[0] = down[0] = 1
        _POW[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POW[0], _POW[1]


@dataclass
class Texts:
    """Documents first..first+n-1 of a batch: bytes and offsets (n + 1 of them)."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[Texts]:
    """The column's texts in order, nulls as empty, in slices of at most `most` bytes or one text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield Texts(a, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        a = b


@dataclass
class Words:
    """start and end byte of each word, its document, and each document's first word (n + 1)."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)


def words(t: Texts, cut: np.ndarray | None = None) -> Words:
    """cut: more bytes that separate, as a table of 256 flags."""
    size = len(t.data)
    if not size:
        z = np.zeros(0, np.int64)
        return Words(z, z, z, np.zeros(t.n + 1, np.int64))
    gap = (SPACE if cut is None else cut)[t.data]
    edge = np.zeros(size + 1, dtype=bool)
    edge[t.offsets] = True
    start = ~gap
    start[1:] &= gap[:-1] | edge[1:size]
    end = ~gap
    end[:-1] &= gap[1:] | edge[1:size]
    s = np.flatnonzero(start)
    first = np.searchsorted(s, t.offsets)
    doc = np.repeat(np.arange(t.n), np.diff(first))
    return Words(s, np.flatnonzero(end) + 1, doc, first)


def span_hashes(t: Texts, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each byte span; equal spans hash alike in every slice, document and process."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(t.data))
    run = np.zeros(len(t.data) + 1, dtype=np.uint64)
    np.cumsum((_BYTE[LOWER] if lower else _BYTE)[t.data] * up[: len(t.data)], out=run[1:])
    h = (run[end] - run[start]) * down[start]
    return mix(h + (end - start).astype(np.uint64))


def word_hashes(t: Texts, w: Words, lower: bool = True) -> np.ndarray:
    return span_hashes(t, w.start, w.end, lower)


def normalised(t: Texts, w: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Lower-cased bytes with one blank after each word, and each word's start and end in them."""
    keep = ~SPACE[t.data]
    after = w.end[w.end < len(t.data)]
    out = LOWER[t.data]
    out[after[~keep[after]]] = 32
    keep[after] = True
    at = np.zeros(len(keep) + 1, dtype=np.int64)
    np.cumsum(keep, out=at[1:])
    return out[keep].tobytes(), at[w.start], at[w.end]


def spans_of(w: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, last word and document of each shingle; a shorter document is one shingle of all its words."""
    n = w.count
    many = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), many)
    base = np.zeros(len(n) + 1, np.int64)
    np.cumsum(many, out=base[1:])
    a = np.arange(base[-1]) - base[doc] + w.first[doc]
    return a, np.minimum(a + width, w.first[doc + 1]) - 1, doc


_SPREAD = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64)).ravel()


def bit_counts(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """How often each of 64 bits is set among each document's values: (n, 64). doc is ascending."""
    out = np.zeros((n, 64), dtype=np.int64)
    if not len(values):
        return out
    first = np.searchsorted(doc, np.arange(n + 1))
    inside = np.arange(len(values)) - first[doc]
    cuts = np.flatnonzero(inside % 255 == 0)  # a lane of eight bits holds a sum of 255
    owner = doc[cuts]
    octets = values.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        lanes = np.add.reduceat(_SPREAD[octets[:, k]], cuts)
        np.add.at(out[:, 8 * k : 8 * k + 8], owner, lanes.view(np.uint8).reshape(-1, 8).astype(np.int64))
    return out


def majority(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """A bit is one if it is set in over half the values; no values: zero."""
    bits = counts * 2 > total[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


class Counts:
    """Exact counts (1 or more) of known 64-bit keys: open addressing over numpy arrays, 64 bytes a key at most."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 2).bit_length())
        self.key = np.zeros(1 << self.bits, np.uint64)
        self.value = np.zeros(1 << self.bits, np.int64)
        slot, mask = self._slot(keys), np.int64((1 << self.bits) - 1)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.value[slot[left]] == 0]
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.key[slot[put]], self.value[slot[put]] = keys[put], values[put]
            done = np.zeros(len(keys), dtype=bool)
            done[put] = True
            left = left[~done[left]]
            slot[left] = (slot[left] + 1) & mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Each key's count; 0 if unknown."""
        out = np.zeros(len(keys), np.int64)
        slot, live = self._slot(keys), np.arange(len(keys))
        mask = np.int64((1 << self.bits) - 1)
        while len(live):
            live = live[self.value[slot[live]] > 0]
            same = self.key[slot[live]] == keys[live]
            out[live[same]] = self.value[slot[live[same]]]
            live = live[~same]
            slot[live] = (slot[live] + 1) & mask
        return out
