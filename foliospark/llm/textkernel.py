"""Vectorised text kernel shared by the corpus operators.

Texts arrive as Arrow string columns; words are maximal runs of bytes other than ASCII white space, so a word
never splits a UTF-8 character.  Everything here works on the column's byte buffer with numpy: no Python object is
made per word.  Batches are cut into slices of bounded bytes (a longer single text makes a slice of its own), which
bounds a worker's memory whatever Arrow batch it was sent.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2_000_000

WHITE = np.zeros(256, np.bool_)
WHITE[[9, 10, 11, 12, 13, 32]] = True

_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_GRAM = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([0] + [(1 << (8 * i)) - 1 for i in range(1, 9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; works in place on a fresh array."""
    h ^= h >> np.uint64(33)
    h *= _M1
    h ^= h >> np.uint64(29)
    h *= _M2
    h ^= h >> np.uint64(32)
    return h


class Words:
    """Words of a slice of texts: byte bounds, owning row and 64-bit hash.

    ``first[r]:first[r + 1]`` are row r's words; null and blank texts have none.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        self.offsets = offsets
        rows = len(offsets) - 1
        ink = np.zeros(len(data) + 2, np.int8)
        ink[1:-1] = ~WHITE[data]
        step = np.diff(ink)
        # a text's end closes a word even if the next text starts without white space
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        inner = inner[(ink[inner] == 1) & (ink[inner + 1] == 1)]
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        if len(inner):
            inner = np.unique(inner)
            start, end = np.sort(np.concatenate([start, inner])), np.sort(np.concatenate([end, inner]))
        self.start, self.end = start, end
        self.first = np.searchsorted(start, offsets)
        self.row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(self.first))
        self._hash: np.ndarray | None = None

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = hash_spans(self.data, self.start, self.end)
        return self._hash

    def text(self, row: int) -> str:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes().decode("utf-8", "replace")

    def word(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, eight bytes a round; the length is mixed in last."""
    size = len(data)
    padded = np.zeros(size + 8, np.uint8)
    padded[:size] = data
    # eight byte planes would cost eight gathers; an overlapping view costs one
    view = np.ndarray((size + 1,), np.dtype("<u8"), padded.data, 0, (1,))
    length = end - start
    h = (view[start] & _MASK[np.minimum(length, 8)]) * _M2
    h ^= h >> np.uint64(31)
    more, at = np.flatnonzero(length > 8), 8
    while len(more):
        part = view[start[more] + at] & _MASK[np.minimum(length[more] - at, 8)]
        x = (h[more] ^ part) * _M1
        x ^= x >> np.uint64(32)
        h[more] = x
        at += 8
        more = more[length[more] > at]
    h += length.astype(np.uint64) * _GRAM
    return mix(h)


def grams(words: Words, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word of every n-gram of words that lies within one row.

    short: a row of 1 to n - 1 words gives one gram of all its words.
    """
    h, row = words.hash, words.row
    if len(h) >= n:
        size = len(h) - n + 1
        g = h[:size].copy()
        for j in range(1, n):
            g *= _GRAM
            g += h[j : size + j]
        at = np.flatnonzero(row[:size] == row[n - 1 :])
        g = mix(g[at])
    else:
        at, g = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    r = row[at]
    if short:
        few = np.flatnonzero((words.count > 0) & (words.count < n))
        extra = np.zeros(len(few), np.uint64)
        for j in range(n - 1):
            has = words.count[few] > j
            extra[has] = extra[has] * _GRAM + h[words.first[few[has]] + j]
        g = np.concatenate([g, mix(extra)])
        r = np.concatenate([r, few.astype(np.int32)])
        at = np.concatenate([at, words.first[few]])
    return g, r, at


@lru_cache(maxsize=1)
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Make the allocators give back what is free: a worker serves many tasks and would otherwise keep the most that
    any of them needed."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column's bytes and offsets, as numpy; a null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def sliced(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Slices of the batches holding up to ``most`` bytes of text (or one text), with their words."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        data, off = column_bytes(column)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            to = min(to, batch.num_rows)
            yield batch.slice(at, to - at), Words(data[off[at] : off[to]], off[at : to + 1] - off[at])
            at = to
    release()


def unique_rows(g: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, gram), ordered by row, then gram."""
    if not len(g):
        return g, row
    o = np.argsort(g, kind="stable")
    o = o[np.argsort(row[o], kind="stable")]
    g, row = g[o], row[o]
    keep = np.ones(len(g), np.bool_)
    keep[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    return g[keep], row[keep]
