"""Suffix arrays by induced sorting, and permuted common prefixes.

The text over bytes is sorted with arrays: the members of a bucket (a first symbol) induce
their predecessors together, in waves where a predecessor falls into the same bucket. The
string of names of the leftmost-smaller substrings is sorted by the same method, on lists,
as its alphabet is large. Time and memory grow linearly with the text.
"""

from __future__ import annotations

import numpy as np


def classify(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one. The last symbol is smaller than all others and there once."""
    n = len(t)
    smaller = np.zeros(n, bool)
    up = np.sign(t[1:].astype(np.int64) - t[:-1].astype(np.int64)).astype(np.int8)
    # An equal neighbour takes the type of the next one that differs.
    at = np.where(up != 0, np.arange(n - 1), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    smaller[:-1] = up[at] > 0
    smaller[-1] = True
    return smaller


def _group(values: np.ndarray, t: np.ndarray, lists: list[list[np.ndarray]]) -> None:
    """Appends the values to the lists of their first symbols, keeping their order."""
    symbols = t[values]
    order = np.argsort(symbols, kind="stable")
    values, symbols = values[order], symbols[order]
    cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
    for part in np.split(values, cuts):
        lists[t[part[0]]].append(part)


def _induce(t: np.ndarray, smaller: np.ndarray, marks: np.ndarray, width: int) -> np.ndarray:
    """The suffix array that the order of marks (leftmost-smaller positions, by bucket) induces."""
    larger_lists: list[list[np.ndarray]] = [[] for _ in range(width)]
    first: list[list[np.ndarray]] = [[] for _ in range(width)]
    if len(marks):
        _group(marks, t, first)
    larger: list[np.ndarray] = []
    none = np.zeros(0, np.int64)
    for c in range(width):
        out: list[np.ndarray] = []
        wave = np.concatenate(larger_lists[c]) if larger_lists[c] else none
        while len(wave):
            out.append(wave)
            p = wave[wave > 0] - 1
            p = p[~smaller[p]]
            here = t[p] == c
            wave = p[here]
            if len(rest := p[~here]):
                _group(rest, t, larger_lists)
        if first[c]:
            p = np.concatenate(first[c])
            p = p[p > 0] - 1
            p = p[~smaller[p]]
            if len(p):
                _group(p, t, larger_lists)
        larger.append(np.concatenate(out) if out else none)
    # Now from the right; lists are in the reverse order of the array.
    smaller_lists: list[list[np.ndarray]] = [[] for _ in range(width)]
    parts: list[np.ndarray] = []
    for c in range(width - 1, -1, -1):
        out = []
        wave = np.concatenate(smaller_lists[c]) if smaller_lists[c] else none
        while len(wave):
            out.append(wave)
            p = wave[wave > 0] - 1
            p = p[smaller[p]]
            here = t[p] == c
            wave = p[here]
            if len(rest := p[~here]):
                _group(rest, t, smaller_lists)
        p = larger[c][::-1]
        p = p[p > 0] - 1
        p = p[smaller[p]]
        if len(p):
            _group(p, t, smaller_lists)
        parts.append(np.concatenate(out)[::-1] if out else none)
        parts.append(larger[c])
    parts.reverse()
    # The last suffix has nothing after it that could induce it.
    return np.concatenate([[len(t) - 1], *parts]) if len(t) else none


def _names(t: np.ndarray, marks: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """By position in marks: the rank of its leftmost-smaller substring; and how many ranks there are."""
    n = len(marks)
    place = np.empty(len(t), np.int64)
    place[marks] = np.arange(n)
    rank = place[order]
    ends = np.append(marks[1:], len(t) - 1)
    length = ends - marks + 1
    a, b = rank[:-1], rank[1:]
    differ = length[a] != length[b]
    left = np.flatnonzero(~differ)
    offset = 0
    while len(left):
        x, y = marks[a[left]] + offset, marks[b[left]] + offset
        unlike = t[x] != t[y]
        differ[left[unlike]] = True
        offset += 1
        left = left[~unlike & (offset < length[a[left]])]
    names = np.empty(n, np.int64)
    names[rank] = np.concatenate([[0], np.cumsum(differ)])
    return names, int(differ.sum()) + 1


def _sort_list(t: list[int], width: int) -> list[int]:
    """The suffix array of a list over 0 .. width - 1 whose last symbol is 0 and there once."""
    n = len(t)
    if n == 1:
        return [0]
    smaller = classify(np.array(t, np.int64)).tolist()
    marks = [i for i in range(1, n) if smaller[i] and not smaller[i - 1]]
    sizes = np.bincount(np.array(t, np.int64), minlength=width)
    ends = np.cumsum(sizes)
    starts = (ends - sizes).tolist()
    ends = ends.tolist()

    def induce(order: list[int]) -> list[int]:
        sa = [-1] * n
        tail = ends.copy()
        for i in reversed(order):
            c = t[i]
            tail[c] -= 1
            sa[tail[c]] = i
        head = starts.copy()
        for k in range(n):
            j = sa[k] - 1
            if j >= 0 and not smaller[j]:
                c = t[j]
                sa[head[c]] = j
                head[c] += 1
        tail = ends.copy()
        for k in range(n - 1, -1, -1):
            j = sa[k] - 1
            if j >= 0 and smaller[j]:
                c = t[j]
                tail[c] -= 1
                sa[tail[c]] = j
        return sa

    sa = induce(marks)
    if len(marks) > 1:
        is_mark = [False] * n
        for i in marks:
            is_mark[i] = True
        order = [i for i in sa if is_mark[i]]
        names, kinds = _names(np.array(t, np.int64), np.array(marks, np.int64), np.array(order, np.int64))
        if kinds < len(marks):
            order = [marks[i] for i in _sort_list(names.tolist(), kinds)]
        sa = induce(order)
    return sa


def suffix_array(t: np.ndarray, width: int) -> np.ndarray:
    """The suffix array of t over 0 .. width - 1 (a small alphabet); its last symbol must be 0 and there once."""
    if len(t) == 1:
        return np.zeros(1, np.int64)
    smaller = classify(t)
    is_mark = np.zeros(len(t), bool)
    is_mark[1:] = smaller[1:] & ~smaller[:-1]
    marks = np.flatnonzero(is_mark)
    sa = _induce(t, smaller, marks, width)
    sa = sa[_once(sa, len(t))]
    order = sa[is_mark[sa]]
    names, kinds = _names(t, marks, order)
    if kinds < len(marks):
        order = marks[np.array(_sort_list(names.tolist(), kinds), np.int64)]
    sa = _induce(t, smaller, order, width)
    return sa[_once(sa, len(t))]


def _once(sa: np.ndarray, n: int) -> np.ndarray:
    """Which entries to keep: the last suffix is put first and may come again."""
    keep = np.ones(len(sa), bool)
    keep[1:] = sa[1:] != n - 1
    return keep


def common_prefixes(t: np.ndarray, sa: np.ndarray, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """By position: the suffix before it in the array (-1: none), and how many symbols both share before a ``stop`` symbol.

    If the symbols before both are equal, the prefix is one shorter than that of the position
    before (Karkkainen, Manzini and Puglisi). Only the others are compared, eight bytes at a time.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    t = t.astype(np.uint16)
    start = np.ones(n, bool)
    i = np.arange(1, n)
    j = before[1:]
    start[1:] = (j <= 0) | (t[i - 1] != t[np.maximum(j, 1) - 1]) | (t[i - 1] <= stop)
    own = np.flatnonzero(start & (before >= 0))
    # Stops never agree: different numbers on the two sides.
    pad = np.zeros(8, np.uint16)
    left, right = np.concatenate([t, pad]), np.concatenate([t, pad])
    left[np.flatnonzero(left <= stop)] = 0xFFFE
    right[np.flatnonzero(right <= stop)] = 0xFFFF
    words = [np.ndarray((len(x) - 3,), "<u8", x.tobytes(), 0, (2,)) for x in (left, right)]
    found = np.zeros(n, np.int64)
    a, b, live = own.copy(), before[own], own
    while len(live):
        unlike = words[0][a] ^ words[1][b]
        same = unlike == 0
        done = ~same
        if done.any():
            low = unlike[done] & (~unlike[done] + np.uint64(1))
            found[live[done]] += (np.log2(low.astype(np.float64)).astype(np.int64)) // 16
        live = live[same]
        found[live] += 4
        a, b = a[same] + 4, b[same] + 4
    reach = np.where(start, found + np.arange(n), 0)
    shared = np.maximum.accumulate(reach) - np.arange(n)
    return before, np.maximum(shared, 0)


def repeated_windows(texts: list[np.ndarray], width: int, symbols: int) -> list[np.ndarray]:
    """For each text: at which starts its ``width`` symbols occur at another place of these texts as well.

    The symbols are 0 .. symbols - 1, few of them.
    """
    sizes = np.array([len(x) for x in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    t = np.ones(int((sizes + 1).sum()) + 1, np.uint16)
    t[-1] = 0
    for s, x in zip(starts, texts, strict=True):
        t[s : s + len(x)] = x
        t[s : s + len(x)] += 2
    sa = suffix_array(t, symbols + 2)
    before, shared = common_prefixes(t, sa, 1)
    long = shared >= width
    twice = long.copy()
    twice[before[np.flatnonzero(long)]] = True
    return [twice[s : s + max(0, n - width + 1)] for s, n in zip(starts, sizes, strict=True)]
