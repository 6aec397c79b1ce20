"""Suffix arrays in numpy: Larsson-Sadakane refinement, Kasai common prefixes, merging of sorted windows by binary search."""

from __future__ import annotations

import numpy as np

#: Positions that follow each other in one lane of `kasai`.
_LANE = 64


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a number, the first byte lowest; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data), dtype="<u8", buffer=padded, strides=(1,)).copy()


def suffix_array(data: np.ndarray) -> np.ndarray:
    """The suffixes of `data` (uint8) in order.

    Suffixes start sorted by eight bytes. Each round doubles the sorted length by sorting the groups of equal suffixes by the group
    number of what follows; suffixes that are alone in their group are never touched again.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    first = _words(data).byteswap()
    # zero bytes and the end of the data look alike in the number: the shorter suffix goes first
    order = np.lexsort((np.minimum(n - np.arange(n), 8), first))
    key, size = first[order], np.minimum(n - order, 8)
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (size[1:] != size[:-1])])
    group = np.empty(n + 1, np.int64)  # by position: index of the first suffix of its group
    heads = np.flatnonzero(new)[np.cumsum(new) - 1]
    group[order], group[n] = heads, -1
    h = 8
    alone = new & np.concatenate([new[1:], [True]])
    open_ = np.flatnonzero(~alone)  # indexes into `order` of suffixes in groups of several
    while len(open_):
        at = order[open_]
        own, follow = heads[open_], group[np.minimum(at + h, n)]
        by = np.lexsort((follow, own))
        at, follow = at[by], follow[by]  # groups are contiguous, so `own` stays as it is
        order[open_] = at
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (follow[1:] != follow[:-1])])
        heads_now = open_[np.flatnonzero(new)][np.cumsum(new) - 1]
        heads[open_] = heads_now
        group[at] = heads_now
        open_ = open_[~(new & np.concatenate([new[1:], [True]]))]
        h *= 2
    return order


def kasai(data: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix length of each suffix with the one before it in `order`, at most `limit`.

    Positions are walked in text order, as the common prefix shrinks by one at most from a position to the next. The text is cut
    into lanes that walk side by side, eight bytes a comparison.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    word, plcp = _words(data), np.zeros(n, np.int64)
    h = np.zeros(-(-n // _LANE), np.int64)
    for t in range(_LANE):
        i = np.arange(t, n, _LANE)
        h = np.maximum(h[:len(i)] - 1, 0)
        p = before[i]
        h[p < 0] = 0
        live = np.flatnonzero((p >= 0) & (h < limit))
        while len(live):
            a, b = i[live] + h[live], p[live] + h[live]
            inside = np.maximum(a, b) < n
            live, a, b = live[inside], a[inside], b[inside]
            x = word[a] ^ word[b]
            low = x & (~x + np.uint64(1))
            same = np.where(x == 0, 8, np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8)
            same = np.minimum(same, n - np.maximum(a, b))
            h[live] += same
            live = live[(same == 8) & (h[live] < limit)]
        np.minimum(h, limit, out=h)
        plcp[i] = h
    return plcp[order]


def window_classes(data: np.ndarray, valid: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions in suffix order, class) of the valid positions; two have one class if their `width` bytes are equal."""
    order = suffix_array(data)
    label = np.cumsum(kasai(data, order, width) < width)
    kept = valid[order]
    return order[kept], label[kept]


def fixed(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The windows of `width` bytes at `at` as sortable strings; a last byte of one keeps trailing zeros."""
    out = np.ones((len(at), width + 1), np.uint8)
    for lo in range(0, len(at), 1 << 16):
        rows = at[lo:lo + (1 << 16)]
        out[lo:lo + (1 << 16), :width] = data[rows[:, None] + np.arange(width)]
    return out.view(f"S{width + 1}").ravel()


def found_in(needles: np.ndarray, sorted_hay: np.ndarray) -> np.ndarray:
    """For each needle the index of its equal in the sorted strings, by binary search; -1 if there is none."""
    if not len(sorted_hay):
        return np.full(len(needles), -1)
    at = np.minimum(np.searchsorted(sorted_hay, needles), len(sorted_hay) - 1)
    return np.where(sorted_hay[at] == needles, at, -1)
