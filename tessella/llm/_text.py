"""NumPy kernels over Arrow text batches: words, word hashes and shingles of whole texts.

A batch's texts stay one byte array (UTF-8); words are maximal runs of bytes other than
U+0020 and U+0009..U+000D, so byte and code point tokenisation agree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240817).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a string column: its bytes, the n + 1 offsets of its rows in them, and which rows are null."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    col = col.cast(pa.large_string())
    null = np.asarray(col.is_null())
    if null.any():
        col = col.fill_null("")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), null
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64, n + 1, col.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0], null


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    """A-Z become a-z, all other bytes stay."""
    return _LOWER[raw]


@dataclass
class Words:
    start: np.ndarray  #: first byte of each word
    end: np.ndarray  #: byte after each word
    first: np.ndarray  #: n + 1 offsets of the rows in the word list

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)


def words(raw: np.ndarray, off: np.ndarray) -> Words:
    """The words of every row of a batch."""
    inside = ~_WS[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(raw))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start = np.flatnonzero(begins)
    return Words(start, np.flatnonzero(ends) + 1, np.searchsorted(start, off))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        up, down = np.full(size, _BASE), np.full(size, _INV)
        up[0] = down[0] = 1
        _POWERS[size] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _POWERS[size]


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, from one prefix sum over the batch (equal bytes, equal hash)."""
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_sets(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct k-word shingles as sorted 64-bit hashes, and the rows' n + 1 offsets in them.

    A row with fewer than k words (but some) has one shingle, its whole word sequence.
    """
    n = len(first) - 1
    out, sizes = [], np.zeros(n, np.int64)
    if len(h) >= k:
        roll = h[: len(h) - k + 1].copy()
        for i in range(1, k):
            roll = mix(roll) + h[i : len(h) - k + 1 + i]
        roll = mix(roll)
    for r in range(n):
        a, b = first[r], first[r + 1]
        if b - a >= k:
            s = np.unique(roll[a : b - k + 1])
        elif b > a:
            v = h[a : a + 1]
            for i in range(a + 1, b):
                v = mix(v) + h[i : i + 1]
            s = mix(v) ^ np.uint64(b - a)
        else:
            continue
        out.append(s)
        sizes[r] = len(s)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def blocks(off: np.ndarray, limit: int = 1 << 20):
    """Runs of rows (i, j) whose texts hold about ``limit`` bytes; a longer text comes alone and whole."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
