"""Words of many texts at once: numpy over the bytes of an Arrow string column, without Python strings.

Words are runs of bytes above 0x20 (ASCII white space and control characters
separate them). A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; bounds the temporaries of a task.
CHUNK = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (rows + 1) and bytes of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, off, data = column.buffers()
    if off is None or len(column) == 0:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(off, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], whole[offsets[0] : offsets[-1]]


def chunks(offsets: np.ndarray, data: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about ``most`` bytes: first row, end row, offsets from 0, bytes. A longer text is a chunk of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]
        lo = hi


def lower(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the two-byte Latin letters À to Þ."""
    out = _LOWER[data]
    if len(out) > 1:
        up = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][up] += 0x20
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: near values give unrelated ones."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _P, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Words of a chunk: ``start`` and ``end`` byte, ``hash``, and ``first`` word of each row (rows + 1)."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, prefixes: tuple[int, ...] = ()):
        solid = data > 32
        edge = np.empty(len(data) + 1, bool)
        edge[0] = True
        edge[1:] = True
        if len(data):
            edge[1:-1] = ~solid[:-1]
            edge[offsets[:-1][offsets[:-1] < len(data)]] = True
        begins = solid & edge[:-1]
        self.start = np.flatnonzero(begins)
        n = len(self.start)
        if not n:
            self.end = self.start
            self.hash = np.zeros(0, np.uint64)
            self.prefix = {p: self.hash for p in prefixes}
        else:
            packed = data[solid]
            at = np.flatnonzero(begins[solid])
            length = np.diff(np.append(at, len(packed)))
            self.end = self.start + length
            place = np.arange(len(packed)) - np.repeat(at, length)
            terms = (packed.astype(np.uint64) + np.uint64(1)) * powers(int(length.max()) + 1)[place]
            self.hash = mix(np.add.reduceat(terms, at))
            self.prefix = {}
            for p in prefixes:
                cut = np.where(place < p, terms, np.uint64(0))
                self.prefix[p] = mix(np.add.reduceat(cut, at) + np.uint64(p * 0xD6E8FEB86659FD93 & (2**64 - 1)))
        self.first = np.searchsorted(self.start, offsets)

    def row(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every run of ``n`` words. A row of 1 to n - 1 words has one shingle of all of them."""
    count = np.diff(words.first)
    row = words.row()
    left = np.repeat(words.first[1:], count) - np.arange(len(row))
    take = np.minimum(left, n)
    h = words.hash.copy()
    for i in range(1, n):
        more = take > i
        nxt = np.zeros(len(h), np.uint64)
        nxt[:-i] = words.hash[i:] if i else words.hash
        h = np.where(more, h * _P + nxt, h)
    ok = (left >= n) | (np.arange(len(row)) == np.repeat(words.first[:-1], count)) & (np.repeat(count, count) < n)
    return row[ok], mix(h[ok])
