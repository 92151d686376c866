"""Word shingles of a batch of texts, hashed with numpy inside a task.

Words are maximal runs without ASCII white space, A-Z lower-cased. A text's set holds the 64-bit hash of every
window of k words; a text with fewer words gives one shingle, its whole sequence; no words give the empty set.
Two different shingles get the same hash with odds of about 2^-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_PIECE = 1 << 20  # bytes hashed at a time, so that the arrays stay in cache; a longer text is hashed alone
_BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses modulo 2^64


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing, so that every bit of the result depends on every bit of x."""
    x = x.astype(np.uint64, copy=True)
    for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(by)
    return x ^ (x >> np.uint64(33))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_BYTE[ord("A"):ord("Z") + 1] = _BYTE[ord("a"):ord("z") + 1]
_WORD_BYTE = np.ones(256, dtype=bool)
_WORD_BYTE[[0x20, *range(0x09, 0x0E)]] = False
_PLACE = mix(np.arange(901, 1000, dtype=np.uint64)) | np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and its inverse for i < n, at least one piece long; kept per worker up to one piece."""
    size = max(n, _PIECE)
    if size in _powers:
        return _powers[size]
    up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    both = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    if size == _PIECE:
        _powers[size] = both
    return both


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data, offsets


def pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about one piece of bytes together."""
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _PIECE, "right")) - 1)
        yield first, last
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in order, and for each text the index of its first word (n + 1 values)."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    raw, at = data[lo:hi], (offsets - lo).astype(np.int64)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    inside = _WORD_BYTE[raw]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    edges = at[:-1][at[:-1] < at[1:]]
    start[edges] = inside[edges]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | start[1:]
    begin, end = np.flatnonzero(start), np.flatnonzero(stop) + 1
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[:len(raw)], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin]), np.searchsorted(begin, at)


def shingle_sets(column, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order."""
    data, offsets = text_buffer(column)
    for first, last in pieces(offsets):
        words, at = word_hashes(data, offsets[first:last + 1])
        windows = np.zeros(max(0, len(words) - k + 1), np.uint64)
        for i in range(k):
            windows += words[i:len(words) - k + 1 + i] * _PLACE[i]
        windows = mix(windows)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a >= k:
                yield np.unique(windows[a:b - k + 1])
            elif b > a:
                yield mix((words[a:b] * _PLACE[:b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)
