"""Suffix arrays of many short strings at once, by two-stage sorting, with numpy inside a task.

Strings are laid out one after the other. A symbol is a byte + 1; GAP zeros end each string, and the zero behind
a string sorts before everything, zeros by place. Stage one sorts only the suffixes that are smaller than their successor (the
suffix that begins one symbol later), word by word. Stage two scans the buckets of first symbols in rising order: the predecessor of a scanned suffix,
if larger than it, is the next of its bucket's larger suffixes, which stand before the bucket's directly sorted ones. Then prefixes of neighbours are compared.
"""

from __future__ import annotations

import numpy as np

BITS, GAP = 9, 7  # seven symbols make a word of 63 bits


def layout(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols, and where each string begins."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    begin = np.cumsum(sizes + GAP) - sizes - GAP
    symbols = np.zeros(int(sizes.sum()) + GAP * (len(strings) + 1), np.int64)
    at = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    symbols[at] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1
    return symbols, begin


def words_of(symbols: np.ndarray) -> np.ndarray:
    """At every place the next GAP symbols as one number that sorts like them."""
    padded = np.concatenate([symbols, np.zeros(GAP, np.int64)])
    words = np.zeros(len(symbols), np.int64)
    for k in range(GAP):
        words |= padded[k:k + len(symbols)] << (BITS * (GAP - 1 - k))
    return words


def smaller_than_next(symbols: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successor; equal first symbols decide like the first unequal pair behind."""
    step = np.diff(symbols, append=0)
    last = len(step) - 1
    told = np.where(step != 0, np.arange(len(step)), last)
    told = np.minimum.accumulate(told[::-1])[::-1]
    return step[told] > 0


def sort_directly(places: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Suffixes that begin at the places, in order; equal ones by place."""
    order = places[np.argsort(words[places], kind="stable")]
    key = words[order]
    group = np.cumsum(np.r_[False, key[1:] != key[:-1]]) if len(order) else key
    open_, step = _tied(group, key), GAP
    while len(open_):
        key = words[order[open_] + step]
        by = np.lexsort((key, group[open_]))
        key, tied = key[by], group[open_]
        order[open_] = order[open_][by]
        fresh = np.r_[False, (key[1:] != key[:-1]) | (tied[1:] != tied[:-1])]
        group = np.cumsum(fresh)
        keep = _tied(group, key)
        open_, group_open, step = open_[keep], group[keep], step + GAP
        group = np.zeros(len(order), np.int64)
        group[open_] = group_open
    return order


def _tied(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Indices whose group has several members that do not end within this word."""
    if not len(group):
        return np.zeros(0, np.int64)
    same = group[1:] == group[:-1]
    several = np.r_[same, False] | np.r_[False, same]
    return np.flatnonzero(several & ((key & ((1 << BITS) - 1)) != 0))


def suffix_array(symbols: np.ndarray, words: np.ndarray) -> np.ndarray:
    """All suffixes that begin at a symbol (not at a zero), in order."""
    real = symbols > 0
    small = smaller_than_next(symbols) & real
    direct = sort_directly(np.flatnonzero(small), words)
    cut = np.searchsorted(symbols[direct], np.arange(259))
    waiting: list[list[np.ndarray]] = [[] for _ in range(258)]

    def induce(scanned: np.ndarray, own: int) -> np.ndarray:
        """Deals the larger predecessors out to their buckets; gives back those of bucket `own`."""
        before = scanned[scanned > 0] - 1
        before = before[real[before] & ~small[before]]
        first = symbols[before]
        by = np.argsort(first, kind="stable")
        before, first = before[by], first[by]
        edges = np.flatnonzero(np.r_[True, first[1:] != first[:-1]]) if len(first) else np.zeros(0, np.int64)
        mine = np.zeros(0, np.int64)
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(first)]):
            if first[a] == own:
                mine = before[a:b]
            else:
                waiting[first[a]].append(before[a:b])
        return mine

    ends = np.flatnonzero(~real & np.r_[False, real[:-1]])
    induce(ends, 0)
    out = []
    for c in range(1, 257):
        block = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        waiting[c] = []
        while len(block):  # predecessors within the bucket come from runs of one symbol
            out.append(block)
            block = induce(block, c)
        block = direct[cut[c]:cut[c + 1]]
        if len(block):
            out.append(block)
            induce(block, c)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefixes(suffixes: np.ndarray, words: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it (0 for the first), at most `most`. Suffixes must be `most` long at least."""
    length = np.zeros(len(suffixes), np.int64)
    open_ = np.arange(1, len(suffixes))
    for step in range(0, most, GAP):
        differ = words[suffixes[open_] + step] ^ words[suffixes[open_ - 1] + step]
        same = differ == 0
        rest = np.frexp(differ[~same].astype(np.float64))[1]  # bit length; exact enough, see below
        exact = differ[~same]
        rest = rest - ((exact >> np.maximum(rest - 1, 0)) == 0)  # rounding up to a power of two
        length[open_[~same]] = step + (BITS * GAP - rest) // BITS
        open_ = open_[same]
        length[open_] = step + GAP
    return np.minimum(length, most)
