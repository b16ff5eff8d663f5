"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

The inducing scans go bucket by bucket: everything a bucket holds induces its predecessors
at once, a stable sort by character deals them to the free ends of their buckets, and the
members that a bucket induces into itself (runs of one character) follow in rounds.
Leftmost-smaller (LMS) substrings are sorted by such a scan, named, and where names repeat the
string of names is sorted the same way.  Scans want few buckets, so a string over more than
`FEW_NAMES` names is written with several digits a name, all of one length: suffixes that
begin a name then come in the order of the names.  The recursion ends where names are all
different, or with a string of at most `SHORT` names, or where it would hardly get shorter;
there suffixes are ranked by their first 1, 2, 4, ... names.
"""

from __future__ import annotations

import numpy as np

FEW_NAMES = 512
SHORT = 1 << 17
#: Strings this short are sorted as they are.
TINY = 32


def suffix_array(text: np.ndarray, n_symbols: int) -> np.ndarray:
    """Suffixes of text (integers below n_symbols) in order, to their ends.

    An order that holds to a depth only isn't that of the suffixes one place on, and
    `permuted_common_prefixes` would carry prefixes that aren't shared.
    """
    n = len(text)
    if n <= TINY:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), dtype=np.int64)
    if n_symbols > FEW_NAMES:
        return _doubling(text)
    text = text.astype(np.uint8 if n_symbols <= 256 else np.uint16)  # sorted by counting, and read fast
    smaller = _smaller_than_next(text)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(lms) < 2:
        return _induce(text, n_symbols, lms)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    rough = _induce(text, n_symbols, lms[np.argsort(text[lms], kind="stable")])
    in_order = rough[is_lms[rough]]
    names, n_names = _names(text, lms, in_order)
    if n_names < len(lms):
        in_order = lms[_of_names(names, n_names, n)]
    return _induce(text, n_symbols, in_order)


def _of_names(names: np.ndarray, n_names: int, n: int) -> np.ndarray:
    """As suffix_array, for the string of names of a text of n symbols."""
    digits = 1
    while FEW_NAMES**digits < n_names:
        digits += 1
    if len(names) <= SHORT or 4 * digits * len(names) > 3 * n:
        return _doubling(names)
    base = next(b for b in range(max(2, int(n_names ** (1 / digits)) - 1), FEW_NAMES + 1) if b**digits >= n_names)
    written = np.stack([names // base**k % base for k in reversed(range(digits))], axis=1).ravel()
    order = suffix_array(written, base)
    return order[order % digits == 0] // digits


def _smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Type of each suffix: True if it is smaller than the next one (the last is larger than the end)."""
    n = len(text)
    unequal = text[1:] != text[:-1]
    at = np.where(unequal, np.arange(n - 1), n)
    at = np.minimum.accumulate(at[::-1])[::-1]  # the next place where the symbol changes
    known = at < n
    out = np.zeros(n, dtype=bool)
    out[:-1][known] = text[at[known] + 1] > text[at[known]]
    return out


def _names(text: np.ndarray, lms: np.ndarray, in_order: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of the LMS substrings, in text order, and how many different ones there are."""
    n = len(text)
    length = np.zeros(n, dtype=np.int64)
    length[lms] = np.append(lms[1:], n) - lms + 1
    a, b = in_order[:-1], in_order[1:]
    same = (length[a] == length[b]) & (a != lms[-1]) & (b != lms[-1])
    live, k = np.flatnonzero(same), 0
    while len(live):
        equal = text[a[live] + k] == text[b[live] + k]
        same[live[~equal]] = False
        k += 1
        live = live[equal & (k < length[a[live]])]
    rank = np.concatenate(([0], np.cumsum(~same)))
    names = np.empty(n, dtype=np.int64)
    names[in_order] = rank
    return names[lms], int(rank[-1]) + 1


def _induce(text: np.ndarray, n_symbols: int, lms_in_order: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the LMS suffixes in order."""
    n = len(text)
    size = np.bincount(text, minlength=n_symbols)
    end = np.cumsum(size)
    start, present = end - size, np.flatnonzero(size).tolist()
    order, lms_in_order = np.empty(n, dtype=np.int32), lms_in_order.astype(np.int32)  # half the memory traffic
    lms_at = np.searchsorted(text[lms_in_order], np.arange(n_symbols + 1)).tolist()
    # suffixes larger than the next one, from the fronts of their buckets
    free = start.copy()
    order[free[text[-1]]] = n - 1
    free[text[-1]] += 1
    for c in present:
        _chain(text, c, order, int(start[c]), free, 1)
        _deal(text, c, np.concatenate((order[start[c] : free[c]], lms_in_order[lms_at[c] : lms_at[c + 1]])), order, free, 1)
    # the others, from the backs
    larger, free = free, end.copy()
    for c in reversed(present):
        _chain(text, c, order, int(end[c]), free, -1)
        _deal(text, c, np.concatenate((order[free[c] : end[c]][::-1], order[start[c] : larger[c]][::-1])), order, free, -1)
    return order.astype(np.int64)


def _chain(text: np.ndarray, c: int, order: np.ndarray, low: int, free: np.ndarray, step: int) -> None:
    """Let what bucket c has been given induce into the bucket itself."""
    at = low
    while at != free[c]:
        now = order[at : free[c]] if step > 0 else order[free[c] : at][::-1]
        at = int(free[c])
        before = now[now > 0] - 1
        before = before[text[before] == c]
        if step > 0:
            order[at : at + len(before)] = before
        else:
            order[at - len(before) : at] = before[::-1]
        free[c] += step * len(before)


def _deal(text: np.ndarray, c: int, scanned: np.ndarray, order: np.ndarray, free: np.ndarray, step: int) -> None:
    """Hand the predecessors of scanned suffixes to their (larger, or smaller) buckets, at the free ends."""
    before = scanned[scanned > 0] - 1
    symbol = text[before]
    chosen = symbol > c if step > 0 else symbol < c
    before, symbol = before[chosen], symbol[chosen]
    if not len(before):
        return
    by = np.argsort(symbol, kind="stable")
    count = np.bincount(symbol, minlength=len(free))
    sooner = np.cumsum(count) - count  # of smaller symbols
    if step > 0:
        order[np.repeat(free - sooner, count) + np.arange(len(by))] = before[by]
    else:
        order[np.repeat(free - 1 + sooner, count) - np.arange(len(by))] = before[by]
    free += step * count


def _doubling(text: np.ndarray) -> np.ndarray:
    """Suffixes ranked by their first 1, 2, 4, ... symbols until all differ; only those still equal are sorted again.

    A rank is the place of the first suffix of its class, so ranks of other classes stay as they are.
    """
    n = len(text)
    order = np.argsort(text)
    in_order = text[order]
    fresh = np.concatenate(([True], in_order[1:] != in_order[:-1], [True]))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh[:-1], np.arange(n), 0))
    live, h = np.flatnonzero(~(fresh[:-1] & fresh[1:])), 1  # places in order whose suffix isn't alone in its class
    while len(live):
        at = order[live]
        key = rank[at] * (n + 1)
        inside = at + h < n
        key[inside] += rank[at[inside] + h] + 1
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[live] = at
        fresh = np.concatenate(([True], key[1:] != key[:-1], [True]))
        rank[at] = np.maximum.accumulate(np.where(fresh[:-1], live, 0))
        live = live[~(fresh[:-1] & fresh[1:])]
        h *= 2
    return order


def permuted_common_prefixes(padded: np.ndarray, eights: np.ndarray, order: np.ndarray, most: int, stride: int = 16) -> np.ndarray:
    """For every suffix, by place in the text, the bytes (up to `most`) it shares with the suffix before it in order.

    padded: the text's bytes with most + 16 spare bytes behind it; eights: its 8-byte loads.
    order is that of whole suffixes, so a suffix shares one byte less than the suffix to its
    left at least, and only every `stride`-th is compared from its start.
    """
    n = len(order)
    before = np.empty(n, dtype=np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    shared = np.zeros(n, dtype=np.int64)
    _extend(padded, eights, np.arange(0, n, stride), before, shared, most)
    left = shared[(np.arange(n) // stride) * stride] - np.arange(n) % stride
    rest = np.flatnonzero(np.arange(n) % stride)
    shared[rest] = np.maximum(left[rest], 0)
    _extend(padded, eights, rest, before, shared, most)
    return np.minimum(shared, most)


def _extend(padded: np.ndarray, eights: np.ndarray, places: np.ndarray, before: np.ndarray, shared: np.ndarray, most: int) -> None:
    """Count on from shared[places], eight bytes at a time."""
    live = places[before[places] >= 0]
    live = live[shared[live] < most]
    while len(live):
        k = shared[live]
        unequal = eights[live + k] ^ eights[before[live] + k]
        equal = unequal == 0
        low = unequal & (~unequal + np.uint64(1))  # the lowest bit that differs
        same = np.where(equal, 8, np.log2(np.where(equal, 1, low).astype(np.float64)).astype(np.int64) >> 3)
        shared[live] = k + same
        live = live[equal & (k + same < most)]
