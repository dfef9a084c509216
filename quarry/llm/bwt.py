"""Repeated substrings of a block of strings by a Burrows-Wheeler transform.

The suffixes of the block are sorted by their first symbols (prefix doubling to
a little over the wanted length), which gives the transform.  Then intervals of
suffixes that share a prefix are expanded breadth first: from those of prefix
length l follow, by prepending a symbol, those of length l + 1; the first time an
interval ends at a place, the common prefix there has length l.  Lengths come
out in rising order and the search stops at the wanted length: places without a
value lie inside a class of suffixes that share it.
"""

from __future__ import annotations

import numpy as np

#: Symbols in the first sort key, of nine bits each: bytes plus one; 0 is the end of a string.
HEAD = 7
#: Intervals of more rows are extended symbol by symbol, smaller ones row by row.
WIDE = 64


def sorted_suffixes(data: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """Suffix starts ordered by their first ``depth`` symbols at least."""
    n = len(data)
    at = np.arange(n)
    key = np.zeros(n, np.uint64)
    for j in range(HEAD):
        inside = at + j < end
        key = key << np.uint64(9) | np.where(inside, data[np.minimum(at + j, n - 1)], 0).astype(np.uint64)
    order, h = np.argsort(key), HEAD
    while True:
        ranked = key[order]
        new = np.r_[True, ranked[1:] != ranked[:-1]]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new).astype(np.uint64)
        if h >= depth or new.all():
            return order
        then = at + h
        key = rank << np.uint64(32) | np.where(then < end, rank[np.minimum(then, n - 1)], np.uint64(0))
        order, h = np.argsort(key), 2 * h


def shared_prefix_bounds(data: np.ndarray, start: np.ndarray, end: np.ndarray, sa: np.ndarray, least: int) -> np.ndarray:
    """bound[r]: the suffix at row r shares fewer than ``least`` symbols with the one before."""
    n = len(data)
    bwt = np.where(sa == start[sa], 0, data[sa - 1])
    count = np.bincount(data, minlength=258)
    first = np.cumsum(count) - count  # rows of suffixes with a smaller first symbol
    ends = np.bincount(data[np.unique(end) - 1], minlength=258)  # strings that end with the symbol
    base = first + ends
    by_symbol = np.argsort(bwt.astype(np.uint16), kind="stable")
    have = np.bincount(bwt, minlength=258)
    begin = np.cumsum(have) - have
    sorted_bwt = bwt[by_symbol]
    lf = np.empty(n, np.int64)
    lf[by_symbol] = base[sorted_bwt] + np.arange(n) - begin[sorted_bwt]
    same = sorted_bwt[1:] == sorted_bwt[:-1]
    after, before = np.full(n, n), np.full(n, -1)
    after[by_symbol[:-1]] = np.where(same, by_symbol[1:], n)
    before[by_symbol[1:]] = np.where(same, by_symbol[:-1], -1)
    symbols = np.flatnonzero(have[1:]) + 1

    bound = np.zeros(n + 1, bool)
    bound[0] = bound[n] = True
    present = np.flatnonzero(count)
    lo, hi = first[present], first[present] + count[present]

    def fresh(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = ~bound[hi]
        bound[hi] = True
        return lo[new], hi[new]

    lo, hi = fresh(lo, hi)
    closing = np.flatnonzero(ends)
    for length in range(1, least):
        size = hi - lo
        small = size <= WIDE
        # rows of the small intervals
        a, b, s = lo[small], hi[small], size[small]
        rows = np.repeat(a - np.cumsum(s) + s, s) + np.arange(s.sum())
        real = bwt[rows] != 0
        opens = real & (before[rows] < np.repeat(a, s))
        closes = real & (after[rows] >= np.repeat(b, s))
        # intervals of one length are disjoint: starts and ends pair up in order
        starts, stops = [lf[rows[opens]]], [lf[rows[closes]] + 1]
        a, b = lo[~small], hi[~small]
        if len(a):
            for c in symbols:
                where = by_symbol[begin[c]:begin[c] + have[c]]
                i, j = np.searchsorted(where, a), np.searchsorted(where, b)
                some = j > i
                starts.append(base[c] + i[some])
                stops.append(base[c] + j[some])
        if length == 1:  # the symbol before the end of a string
            starts.append(first[closing])
            stops.append(first[closing] + ends[closing])
        lo, hi = fresh(np.sort(np.concatenate(starts)), np.sort(np.concatenate(stops)))
        if not len(lo):
            break
    return bound[:n]


def repeated(strings: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, class) of every substring of ``least`` bytes that lies in
    the strings at two places or more; equal substrings have equal classes."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    stop = np.cumsum(sizes)
    data = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1
    if len(data) < least:
        none = np.zeros(0, np.int64)
        return none, none, none
    who = np.repeat(np.arange(len(strings)), sizes)
    end, start = stop[who], (stop - sizes)[who]
    sa = sorted_suffixes(data, end, least)
    group = np.cumsum(shared_prefix_bounds(data, start, end, sa, least))
    long = end[sa] - sa >= least
    sa, group = sa[long], group[long]
    many = np.bincount(group)[group] > 1
    sa, group = sa[many], group[many]
    return who[sa], sa - start[sa], group
