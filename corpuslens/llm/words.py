"""Vectorised words and hashes over Arrow text columns (numpy, inside tasks).

A column of texts is one UTF-8 byte array plus row offsets, so words, their
64-bit hashes and their spans come out of a few array passes; no Python
string is made per word.  Work goes in slices of whole rows of about
``SLICE_BYTES`` so that memory is bounded by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_MULT = 6364136223846793005  # odd, so powers are invertible modulo 2**64
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (xor-shift-multiply, in place on a copy)."""
    x = x.astype(np.uint64)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def random_words(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random uint64 numbers for a seed, the same on every machine."""
    return mix64((np.arange(1, n + 1, dtype=np.uint64) + _U(seed) * _U(1 << 32)) * _U(0x9E3779B97F4A7C15))


def lower_bytes() -> np.ndarray:
    """Maps A-Z to a-z and leaves every other byte."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def not_space() -> np.ndarray:
    """Bytes of words ``[^\\x20\\x09-\\x0D]+``."""
    t = np.ones(256, bool)
    t[[32, 9, 10, 11, 12, 13]] = False
    return t


def word_bytes() -> np.ndarray:
    """Bytes of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing."""
    t = np.zeros(256, bool)
    t[48:58] = t[97:123] = t[128:] = True
    return t


class SpanHasher:
    """64-bit hashes of spans of a unit array; one object per task holds the
    tables (powers of an odd multiplier and a random number per unit)."""

    def __init__(self, units: int = 256):
        self.table = random_words(units, 7)
        self._up = self._down = np.ones(0, np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n + 1:
            size = SLICE_BYTES
            while size < n + 1:
                size *= 2
            up = np.full(size, _MULT, np.uint64)
            down = np.full(size, pow(_MULT, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self._up, self._down = np.cumprod(up), np.cumprod(down)
        return self._up, self._down

    def sums(self, units: np.ndarray) -> np.ndarray:
        """Running sums from which ``spans`` reads any span's hash."""
        up, _ = self._powers(len(units))
        h = np.empty(len(units) + 1, np.uint64)
        h[0] = 0
        v = self.table[units]
        v *= up[:len(units)]
        np.cumsum(v, out=h[1:])
        return h

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = sums[end] - sums[start]
        out *= self._down[start]
        return mix64(out + (end - start).astype(np.uint64))

    def hash(self, units: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.spans(self.sums(units), start, end)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, last row + 1, bytes, offsets)`` of whole rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    if column.null_count:  # a null row may own bytes in its buffer: leave them out
        column = pa.array([x if x is not None else b"" for x in column.to_pylist()], pa.large_binary())
        offs = np.frombuffer(column.buffers()[1], np.int64)[:n + 1]
        data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else data[:0]
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        i = j


class Words:
    """Words of a slice: byte spans, hashes, and the first word of each row."""

    __slots__ = ("data", "start", "end", "hash", "first", "sums")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, mask: np.ndarray, hasher: SpanHasher):
        self.data = lower_bytes()[data]
        inside = mask[self.data]
        begin, stop = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        stop[:-1] &= ~inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        begin[edges] = inside[edges]
        stop[edges - 1] = inside[edges - 1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.sums = hasher.sums(self.data)
        self.hash = hasher.spans(self.sums, self.start, self.end)
        self.first = np.searchsorted(self.start, offsets)  # words of row r: first[r]:first[r + 1]

    def texts(self, lo: int, hi: int) -> bytes:
        """Lower-cased words lo..hi joined by one space (for exact comparison)."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[lo:hi], self.end[lo:hi]))


def shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of ``size`` words, and the row starts in that
    array.  A row with fewer words, but not none, has its whole sequence as one."""
    first, h = words.first, words.hash
    count = np.diff(first)
    n = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(n)), n)
    at = first[:-1][row] + (np.arange(starts[-1]) - starts[:-1][row])
    out = np.zeros(len(at), np.uint64)
    left = np.minimum(count[row], size)
    for k in range(size):
        use = left > k
        out[use] = mix64(out[use] * _U(0x9E3779B97F4A7C15) + h[at[use] + k])
    return mix64(out + left.astype(np.uint64)), starts


def distinct_in_rows(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row and the new row starts."""
    parts = [np.unique(values[a:b]) for a, b in zip(starts[:-1], starts[1:])]
    n = np.array([len(p) for p in parts], np.int64)
    flat = np.concatenate(parts) if len(parts) and n.sum() else np.zeros(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum(n)])
