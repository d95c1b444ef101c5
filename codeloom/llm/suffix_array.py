"""Suffix arrays by induced sorting, in numpy.

The steps are those of linear-time induced sorting (Nong, Zhang and Chan, 2009). The scans that induce
one suffix from another run in batches: of a stretch of the array, the longest beginning is handled at
once whose entries all induce positions beyond the stretch. A batch costs a few array operations, each
suffix is induced once, and the alphabet may be of any size, so the recursion uses the same code.
"""

from __future__ import annotations

import numpy as np

#: Reduced strings below this length are sorted by prefix doubling, as batches are short there.
SHORT = 1 << 18


def _ranks(c: np.ndarray) -> np.ndarray:
    """How many earlier entries are equal, for each entry."""
    order = np.argsort(c, kind="stable")
    s = c[order]
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    rank = np.empty(len(c), np.int64)
    rank[order] = np.arange(len(c)) - np.repeat(first, np.diff(np.append(first, len(c))))
    return rank


def _induce(t, is_s, lms, begin, end):
    n = len(t)
    sa = np.full(n, -1, np.int32)
    c = t[lms]
    counts = np.bincount(c, minlength=len(begin))
    sa[end[c] - counts[c] + _ranks(c)] = lms
    head = begin.copy()
    sa[head[t[n - 1]]] = n - 1  # induced by the empty suffix
    head[t[n - 1]] += 1
    i, width = 0, 1024
    while i < n:
        j = min(i + width, n)
        block = sa[i:j]
        at = np.flatnonzero(block > 0)
        p = block[at] - 1
        take = ~is_s[p]
        at, p = at[take], p[take]
        if len(p):
            c = t[p]
            to = head[c] + _ranks(c)
            least = int(to.min())
            if least < j:
                m = int(np.searchsorted(at, least - i))
                p, c, to, j, width = p[:m], c[:m], to[:m], least, max(64, 2 * (least - i))
            else:
                width = min(2 * width, 1 << 17)
            sa[to] = p
            head[c] = to + 1  # of equal indices the last, largest, one stays
        i = j
    tail = end.copy()
    j, width = n, 1024
    while j > 0:
        i = max(j - width, 0)
        block = sa[i:j][::-1]
        at = np.flatnonzero(block > 0)
        p = block[at] - 1
        take = is_s[p]
        at, p = at[take], p[take]
        if len(p):
            c = t[p]
            to = tail[c] - 1 - _ranks(c)
            most = int(to.max())
            if most >= i:
                m = int(np.searchsorted(at, j - 1 - most))
                p, c, to, width = p[:m], c[:m], to[:m], max(64, 2 * (j - 1 - most))
                i = most + 1
            else:
                width = min(2 * width, 1 << 17)
            sa[to] = p
            tail[c] = to
        j = i
    return sa


def _doubled(t):
    """The suffix array by prefix doubling."""
    rank, k, n = t.astype(np.int64) + 1, 1, len(t)
    while True:
        key = rank << 32
        key[: n - k] |= rank[k:]
        order = np.argsort(key, kind="stable")
        new = np.append(True, np.diff(key[order]) != 0)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if new.all():
            return order
        k *= 2


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of ``t`` (non-negative integers below len(t) + 256) in their order."""
    t = np.ascontiguousarray(t, np.int32)
    n = len(t)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    # classify: S if less than the next suffix; a run of equal symbols is of the class of its end
    step = np.append(np.sign(t[1:].astype(np.int64) - t[:-1]), -1)
    decisive = np.where(step != 0, np.arange(n), n)
    decisive = np.minimum.accumulate(decisive[::-1])[::-1]
    is_s = step[decisive] > 0
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]).astype(np.int32) + 1
    end = np.cumsum(np.bincount(t))
    begin = np.append(0, end[:-1])
    if len(end) <= 1 << 16:
        t = t.astype(np.uint16)  # sorts of 16-bit numbers take linear time
    sa = _induce(t, is_s, lms, begin, end)
    if len(lms) < 2:
        return sa
    # name the sorted leftmost-smaller substrings; equal ones share a name
    marked = np.zeros(n, bool)
    marked[lms] = True
    ordered = sa[marked[sa]]
    number = np.empty(n, np.int32)
    number[lms] = np.arange(len(lms), dtype=np.int32)
    size = np.append(np.diff(lms) + 1, n - lms[-1] + 1)[number[ordered]]
    a, b = ordered[:-1], ordered[1:]
    alike = np.flatnonzero((size[:-1] == size[1:]) & (a != lms[-1]) & (b != lms[-1]))
    k = 0
    left = alike
    same = np.zeros(len(a), bool)
    while len(left):
        left = left[t[a[left] + k] == t[b[left] + k]]
        k += 1
        over = size[left] == k
        same[left[over]] = True
        left = left[~over]
    name = np.append(0, np.cumsum(~same)).astype(np.int32)
    if name[-1] + 1 < len(lms):
        reduced = np.empty(len(lms), np.int32)
        reduced[number[ordered]] = name
        ordered = lms[_doubled(reduced) if len(lms) < SHORT else suffix_array(reduced)]
    return _induce(t, is_s, ordered, begin, end)


def common_prefixes(text: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Permuted common prefixes: at each position, the bytes shared with the suffix before it in ``sa``, up to ``most``.

    ``text`` must be followed by at least ``most + 8`` bytes of padding beyond the suffixes in ``sa``.
    """
    n = len(sa)
    before = np.empty(n, np.int32)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int32)
    words = np.ndarray((len(text) - 7,), "<u8", buffer=np.ascontiguousarray(text), strides=(1,))
    at = np.ones(n, bool)
    at[sa[0]] = False
    at = np.flatnonzero(at)
    k = 0
    while len(at) and k < most:
        x = words[at + k] ^ words[before[at] + k]
        differs = x != 0
        y = x[differs]
        low = y & (~y + np.uint64(1))  # lowest set bit, of the first byte that differs
        out[at[differs]] = k + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        at = at[~differs]
        k += 8
        out[at] = k
    limit = np.minimum(n - np.arange(n), n - before)
    limit[sa[0]] = 0
    return np.minimum(np.minimum(out, most), limit)
