"""Suffix arrays by induced sorting, and common prefixes in text order.

Suffixes are classed as smaller (S) or larger (L) than the next one; the leftmost S of each run (LMS) are sorted by
inducing their substrings, naming these, and recursing on the names; all others are induced from them, linearly.
Over bytes a whole run of a bucket is induced at once: entries that a bucket gives to itself form further waves. The
recursion has an alphabet too large for that and goes entry by entry.
"""

from __future__ import annotations

import numpy as np

from strandline.llm.words import powers


def _smaller(s: np.ndarray) -> np.ndarray:
    """True for S suffixes; the last symbol is an end mark below all others, and S."""
    step = np.sign(s[1:].astype(np.int64) - s[:-1])
    step = np.r_[step, 1]
    place = np.where(step != 0, np.arange(len(s)), len(s) - 1)
    place = np.minimum.accumulate(place[::-1])[::-1]
    return step[place] > 0


class _Buckets:
    def __init__(self, s: np.ndarray, symbols: int):
        counts = np.bincount(s, minlength=symbols)
        self.end = np.cumsum(counts)
        self.start = self.end - counts


def _give(array: np.ndarray, at: np.ndarray, symbols: np.ndarray, items: np.ndarray, step: int) -> None:
    """Put items into their symbols' buckets in order, from ``at`` upwards or, with step -1, downwards."""
    order = np.argsort(symbols, kind="stable")
    symbols, items = symbols[order], items[order]
    counts = np.bincount(symbols, minlength=len(at))
    first = np.cumsum(counts) - counts
    within = np.arange(len(items)) - first[symbols]
    if step > 0:
        array[at[symbols] + within] = items
        at += counts
    else:
        array[at[symbols] - 1 - within] = items
        at -= counts


def _induce(s: np.ndarray, small: np.ndarray, buckets: _Buckets, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the LMS ones in order."""
    symbols = len(buckets.end)
    narrow = s.astype(np.uint16)
    array = np.full(len(s), -1, np.int64)
    tail = buckets.end.copy()
    _give(array, tail, narrow[lms[::-1]], lms[::-1], -1)
    lms_from, head = tail, buckets.start.copy()

    def larger(block: np.ndarray) -> None:
        before = block[block > 0] - 1
        before = before[~small[before]]
        if len(before):
            _give(array, head, narrow[before], before, 1)

    for c in range(symbols):
        done = buckets.start[c]
        while done < head[c]:
            stop = head[c]
            larger(array[done:stop])
            done = stop
        if lms_from[c] < buckets.end[c]:
            larger(array[lms_from[c] : buckets.end[c]])
    ends = buckets.end.copy()
    array[0] = len(s) - 1
    ends[s[-1]] -= 1

    def lesser(block: np.ndarray) -> None:
        before = block[::-1]
        before = before[before > 0] - 1
        before = before[small[before]]
        if len(before):
            _give(array, ends, narrow[before], before, -1)

    for c in range(symbols - 1, -1, -1):
        done = buckets.end[c]
        while ends[c] < done:
            stop = ends[c]
            lesser(array[stop:done])
            done = stop
        if buckets.start[c] < head[c]:
            lesser(array[buckets.start[c] : head[c]])
    return array


def suffix_array(s: np.ndarray, symbols: int) -> np.ndarray:
    """Of a numpy string of small symbols whose last one is 0 and occurs only there."""
    small = _smaller(s)
    buckets = _Buckets(s, symbols)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    by_symbol = lms[np.argsort(s[lms], kind="stable")]
    array = _induce(s, small, buckets, by_symbol)
    is_lms = np.zeros(len(s), bool)
    is_lms[lms] = True
    ordered = array[is_lms[array]]
    # A name per LMS substring: equal ones stand together, and are told apart by length and hash.
    stop = np.minimum(np.r_[lms[1:], len(s) - 1] + 1, len(s))
    length = np.zeros(len(s), np.int64)
    length[lms] = stop - lms
    spread = (s.astype(np.uint64) + np.uint64(1)) * powers(len(s))[: len(s)]
    prefix = np.r_[np.uint64(0), np.cumsum(spread)]
    size = length[ordered]
    # Compare at the later one's scale: the earlier is lifted by the power of the distance.
    a, b = ordered[:-1], ordered[1:]
    ha, hb = prefix[a + size[:-1]] - prefix[a], prefix[b + size[1:]] - prefix[b]
    low, high = np.minimum(a, b), np.maximum(a, b)
    scale = powers(len(s))[high - low]
    same = (size[:-1] == size[1:]) & (np.where(a < b, ha, hb) * scale == np.where(a < b, hb, ha))
    names = np.cumsum(np.r_[True, ~same]) - 1
    if len(names) and names[-1] + 1 < len(names):
        name_at = np.zeros(len(s), np.int64)
        name_at[ordered] = names
        ordered = lms[np.array(_by_entry(name_at[lms].tolist(), int(names[-1]) + 1))]
    return _induce(s, small, buckets, ordered)


def _by_entry(s: list[int], symbols: int) -> list[int]:
    """The same over a list of names; its last one is least and occurs only there."""
    n = len(s)
    if n == 1:
        return [0]
    small = [True] * n
    for i in range(n - 2, -1, -1):
        small[i] = s[i] < s[i + 1] or (s[i] == s[i + 1] and small[i + 1])
    counts = [0] * symbols
    for c in s:
        counts[c] += 1
    start, end, total = [0] * symbols, [0] * symbols, 0
    for c in range(symbols):
        start[c] = total
        total += counts[c]
        end[c] = total
    lms = [i for i in range(1, n) if small[i] and not small[i - 1]]

    def induce(seed: list[int]) -> list[int]:
        array = [-1] * n
        tail = end[:]
        for i in reversed(seed):
            tail[s[i]] -= 1
            array[tail[s[i]]] = i
        head = start[:]
        for k in range(n):
            i = array[k] - 1
            if i >= 0 and not small[i]:
                c = s[i]
                array[head[c]] = i
                head[c] += 1
        tail = end[:]
        for k in range(n - 1, -1, -1):
            i = array[k] - 1
            if i >= 0 and small[i]:
                c = s[i]
                tail[c] -= 1
                array[tail[c]] = i
        array[0] = n - 1
        return array

    array = induce(lms)
    following = dict(zip(lms, [*lms[1:], n - 1], strict=True))
    ordered = [i for i in array if i in following]
    names, last, previous = {}, -1, None
    for i in ordered:
        part = s[i : following[i] + 1]
        if part != previous:
            last, previous = last + 1, part
        names[i] = last
    if last + 1 < len(ordered):
        ordered = [lms[k] for k in _by_entry([names[i] for i in lms], last + 1)]
    return induce(ordered)


def common_prefixes(s: np.ndarray, array: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In text order: the suffix before each one in the array (-1: none), and the length of their common prefix.

    Where the symbols before both agree, the length is one less than at the position before. Only the other
    positions are compared, eight symbols a step.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[array[1:]] = array[:-1]
    place = np.arange(n)
    led = (place > 0) & (before > 0)
    led[led] = s[place[led] - 1] == s[before[led] - 1]
    length = np.zeros(n, np.int64)
    todo = place[~led & (before >= 0)]
    padded = np.r_[s.astype(np.int64), np.full(8, -1)]
    window = np.lib.stride_tricks.sliding_window_view(padded, 8)
    while len(todo):
        x, y = todo + length[todo], before[todo] + length[todo]
        inside = np.maximum(x, y) < n
        todo, x, y = todo[inside], x[inside], y[inside]
        equal = window[x] == window[y]
        run = np.where(equal.all(1), 8, np.argmin(equal, 1))
        length[todo] += run
        todo = todo[run == 8]
    base = np.maximum.accumulate(np.where(led, 0, place))
    return before, np.maximum(length[base] - (place - base), 0)


