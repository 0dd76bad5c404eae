"""Burrows-Wheeler transform and common prefixes of a collection of strings, built column by column.

Each round inserts one symbol of every string, from the last to the first: the suffix that starts there goes to its
place among the suffixes so far, which the transform itself tells (a symbol's rank in it), and its common prefix with
either neighbour is the symbol's length more than the least common prefix between their tails. Every round reads and writes the
columns once, from front to back.
"""

from __future__ import annotations

import numpy as np


def repeated_starts(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string, which of its starts 0 .. len - length begin a substring of that length that occurs at another
    start too, in any of the strings."""
    symbols = [np.frombuffer(s, np.uint8).astype(np.uint16) + np.uint16(1) for s in strings]
    return repeated_symbols(symbols, [max(0, len(s) - length + 1) for s in strings], length, np.ones(257, np.uint16))


def repeated_symbols(strings: list[np.ndarray], starts: list[int], length: int, weight: np.ndarray) -> list[np.ndarray]:
    """The same over strings of symbols from 1 up, where symbol c stands for weight[c] bytes: which of each string's first
    starts have a common prefix of ``length`` bytes with another suffix."""
    m = len(strings)
    size = np.array([len(s) for s in strings], np.int64)
    base = np.concatenate([[0], np.cumsum(size)])
    data = np.concatenate([*strings, np.zeros(0, np.uint16)])
    left = size.copy()  # symbols not yet inserted
    bwt = np.zeros(m, np.uint16)
    some = size > 0
    bwt[some] = data[(base[1:] - 1)[some]]
    lcp = np.zeros(m, np.uint16)
    suffix = np.full(m, -1, np.int64)
    who, pos = np.arange(m)[some], np.arange(m)[some]
    while len(who):
        n = len(bwt)
        order = np.argsort(bwt, kind="stable").astype(np.int32)
        rank = np.empty(n, np.int32)
        rank[order] = np.arange(n, dtype=np.int32)
        symbol, k = bwt[pos], rank[pos]
        ended = n - np.count_nonzero(bwt)
        at = m + k - ended
        before, after = order[np.maximum(k - 1, 0)], order[np.minimum(k + 1, n - 1)]
        has_before = (k > ended) & (bwt[before] == symbol)
        has_after = (k + 1 < n) & (bwt[after] == symbol)
        wide = np.append(lcp, np.uint16(0))

        def least(lo: np.ndarray, hi: np.ndarray, own: np.ndarray, wide=wide) -> np.ndarray:
            by = np.argsort(lo, kind="stable")
            out = np.empty(len(lo), np.uint16)
            out[by] = np.minimum.reduceat(wide, np.stack([lo[by], hi[by]], 1).ravel())[::2]
            return np.minimum(out.astype(np.int64) + weight[own], length).astype(np.uint16)

        old = np.ones(n + len(who), bool)
        old[at] = False
        grown = [np.empty(n + len(who), x.dtype) for x in (bwt, lcp, suffix)]
        for new, now in zip(grown, (bwt, lcp, suffix), strict=True):
            new[old] = now
        left[who] -= 1
        start = left[who]
        more = start > 0
        bwt, lcp, suffix = grown
        bwt[at] = np.where(more, data[np.maximum(base[who] + start - 1, 0)], 0)
        suffix[at] = base[who] + start
        lcp[at] = 0
        if has_before.any():
            lcp[at[has_before]] = least(before[has_before] + 1, pos[has_before] + 1, symbol[has_before])
        if has_after.any():
            lcp[at[has_after] + 1] = least(pos[has_after] + 1, after[has_after] + 1, symbol[has_after])
        by = np.argsort(at[more])
        who, pos = who[more][by], at[more][by].astype(np.int64)
    long = lcp >= length
    hit = np.zeros(int(base[-1]) + 1, bool)
    found = np.nonzero(long)[0]
    hit[suffix[found]] = True
    hit[suffix[found - 1]] = True
    return [hit[base[i] : base[i] + starts[i]] for i in range(m)]
