"""Suffix arrays by induced sorting, for text in short pieces, and permuted common prefixes.

The induction runs bucket by bucket: what a bucket's suffixes induce is found for the whole bucket at once
and appended to the other buckets in that order, which is the order a suffix-by-suffix scan would give. Only
runs of one letter need more than one round, and pieces are short.
"""

from __future__ import annotations

import numpy as np

#: The separator after each piece; bytes are kept one higher.
SEPARATOR = 0
#: Order is settled to at least this many bytes.
DEPTH = 64


def _types(s: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than their right neighbour; the last one is."""
    n = len(s)
    step = np.sign(np.append(s[1:].astype(np.int32) - s[:-1].astype(np.int32), 1))
    place = np.where(step != 0, np.arange(n, dtype=np.int32), np.int32(n))
    nxt = np.minimum.accumulate(place[::-1])[::-1]
    return step[np.minimum(nxt, n - 1)] > 0


def _deal(sa: np.ndarray, who: np.ndarray, letters: np.ndarray, ptr: np.ndarray, back: bool) -> None:
    """Appends suffixes to the heads (or, back, to the tails) of their buckets, keeping their order."""
    order = np.argsort(letters, kind="stable")
    c, w = letters[order], who[order]
    first = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
    n = np.diff(np.append(first, len(c)))
    rank = np.arange(len(c)) - np.repeat(first, n)
    at = c[first]
    if back:
        sa[np.repeat(ptr[at], n) - 1 - rank] = w
        ptr[at] -= n
    else:
        sa[np.repeat(ptr[at], n) + rank] = w
        ptr[at] += n


def _induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, letters: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The suffix array, given the leftmost-smaller suffixes in order (right, if their order is)."""
    n = len(s)
    sa = np.full(n, -1, dtype=np.int32)
    heads, tails = bounds[:-1].copy(), bounds[1:].copy()
    first = s[lms]
    count = np.bincount(first, minlength=len(heads))
    start = tails - count
    order = np.argsort(first, kind="stable")
    rank = np.arange(len(lms)) - np.repeat(np.cumsum(count) - count, count)
    sa[np.repeat(start, count) + rank] = lms[order]
    # Nothing comes before the first place: it looks up the last one here, which is neither.
    larger, small = np.append(~small, False), np.append(small, False)
    for c in letters:  # larger suffixes, from the left
        done = bounds[c]
        while done < heads[c]:
            end = heads[c]
            p = sa[done:end] - 1
            p = p[larger[p]]
            if len(p):
                _deal(sa, p, s[p], heads, False)
            done = end
        p = sa[start[c] : bounds[c + 1]] - 1
        p = p[larger[p]]
        if len(p):
            _deal(sa, p, s[p], heads, False)
    sa[bounds[s[-1]]] = n - 1  # nothing induces the last suffix, the smallest
    for c in letters[::-1]:  # smaller suffixes, from the right
        done = bounds[c + 1]
        while done > tails[c]:
            end = tails[c]
            p = sa[end:done][::-1] - 1
            p = p[small[p]]
            if len(p):
                _deal(sa, p, s[p], tails, True)
            done = end
        p = sa[bounds[c] : heads[c]][::-1] - 1
        p = p[small[p]]
        if len(p):
            _deal(sa, p, s[p], tails, True)
    return sa


def _words(s: np.ndarray, more: int) -> tuple[int, np.ndarray]:
    """How many letters 64 bits hold, and those from each place on; ``more`` separators follow the last one."""
    together = 8 // s.dtype.itemsize
    padded = np.concatenate((s, np.full(more + together, SEPARATOR, dtype=s.dtype)))
    return together, np.ndarray(shape=(len(padded) - together + 1,), dtype="<u8", buffer=padded, strides=(s.dtype.itemsize,))


def _names(s: np.ndarray, lms: np.ndarray, length: np.ndarray, order: np.ndarray) -> np.ndarray:
    """A number for each leftmost-smaller substring, by rank; order: their indices in sorted order."""
    together, words = _words(s, int(length.max()))
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    left, off = np.flatnonzero(same), 0
    while len(left):
        # What lies beyond the substrings does not count.
        beyond = np.maximum(together - (length[a[left]] - off), 0).astype(np.uint64) * np.uint64(64 // together)
        equal = (words[lms[a[left]] + off] ^ words[lms[b[left]] + off]) << beyond == 0
        same[left[~equal]] = False
        left = left[equal]
        off += together
        left = left[length[a[left]] > off]
    names = np.empty(len(lms), dtype=np.int64)
    names[order] = np.concatenate(([0], np.cumsum(~same)))
    return names


def _ranked(names: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The order of the reduced string's suffixes: names of pairs of neighbours, recursively, where they are not settled yet.

    ``order`` sorts the names. A suffix is named by the first place of those that are equal so far.
    """
    n = len(names)
    order = order.copy()
    place, key = np.arange(n), names[order]
    rank, width = np.empty(n, dtype=np.int64), 1
    while True:
        new = np.concatenate(([True], key[1:] != key[:-1]))
        who = order[place]
        rank[who] = place[np.maximum.accumulate(np.where(new, np.arange(len(place)), 0))]
        several = ~new
        several[:-1] |= ~new[1:]
        place, who = place[several], who[several]
        if not len(place) or 2 * width >= DEPTH:  # two bytes a substring at least
            return order
        after = who + width
        key = rank[who] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        now = np.argsort(key)
        order[place], key = who[now], key[now]
        width *= 2


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffixes of ``s`` in order, settled to DEPTH letters; s ends with the separator."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    small = _types(s)
    lms = np.flatnonzero(small & np.concatenate(([False], ~small[:-1])))
    count = np.bincount(s)
    bounds = np.concatenate(([0], np.cumsum(count)))
    letters = np.flatnonzero(count)
    if len(lms) > 1:
        index = np.full(n, -1, dtype=np.int32)
        index[lms] = np.arange(len(lms))
        sa = _induce(s, small, lms, letters, bounds)
        order = index[sa]
        order = order[order >= 0]
        length = np.append(np.diff(lms) + 1, 1)
        names = _names(s, lms, length, order)
        lms = lms[_ranked(names, order)]
    return _induce(s, small, lms, letters, bounds)


def common_prefixes(s: np.ndarray, sa: np.ndarray, starts: np.ndarray, most: int = 96) -> np.ndarray:
    """For each place in text order, what its suffix shares with its predecessor in the array, up to ``most``.

    Only irreducible values are compared letter by letter: those whose predecessor does not follow that of
    the place before or comes after another letter, and those at the start of a piece. Each other value is the
    one before less one.
    """
    n = len(s)
    phi = np.full(n, -1, dtype=np.int32)
    phi[sa[1:]] = sa[:-1]
    irreducible = np.ones(n, dtype=bool)
    irreducible[1:] = (phi[1:] != phi[:-1] + 1) | (phi[:-1] < 0) | (s[:-1] != s[phi[:-1]])
    irreducible[starts] = True
    at = np.flatnonzero(irreducible & (phi >= 0))
    together, words = _words(s, most)
    masks = [np.uint64((1 << 64 // together * j) - 1) for j in range(1, together)]
    left, x, y = np.arange(len(at)), at, phi[at]
    shared = np.zeros(len(at), dtype=np.int32)
    for off in range(0, most, together):
        differ = words[x + off] ^ words[y + off]
        equal = differ == 0
        d = differ[~equal]
        shared[left[~equal]] = off + sum((d & m == 0).astype(np.int32) for m in masks)
        left, x, y = left[equal], x[equal], y[equal]
        if not len(left):
            break
        shared[left] = off + together
    value = np.zeros(n, dtype=np.int32)
    value[at] = shared
    place = np.arange(n, dtype=np.int32)
    source = np.maximum.accumulate(np.where(irreducible, place, 0))
    return np.maximum(value[source] - (place - source), 0)
