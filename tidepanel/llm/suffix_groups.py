"""Linear suffix sorting by grouping (the Lyndon-prefix method of Baier, 2016).

Phase 1 sorts suffixes into groups that share their longest Lyndon prefix: groups are
taken in descending order; every member points to the previous suffix of a smaller
group, and suffixes so pointed at move, by how often, into new groups just above
their old ones.  Phase 2 runs through the array from the least suffix and puts each
predecessor, and the chain of its pointers, at the next free place of its group.
There is no recursion and no renaming.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of a sequence of integers, sorted; a prefix sorts first."""
    n = len(symbols) + 1
    if n == 1:
        return np.zeros(0, np.int64)
    values = np.concatenate([np.asarray(symbols, np.int64), [np.min(symbols) - 1]])
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    sizes = np.diff(np.append(begins, n))
    of = np.empty(n, np.int64)
    of[order] = np.repeat(begins, sizes)
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    size = np.zeros(n, np.int64)
    size[begins] = sizes

    # By group: its members stand together in sa from the group's number on.
    sa, group, place, size = order.tolist(), of.tolist(), at.tolist(), size.tolist()
    before = list(range(-1, n - 1))  # nothing between a suffix and this one is in a smaller group
    high = n
    while high:
        low = group[sa[high - 1]]
        hits: dict[int, int] = {}
        for i in sa[low:high]:
            j = before[i]
            while j >= 0 and group[j] >= low:
                j = before[j]
            before[i] = j
            if j >= 0:
                hits[j] = hits.get(j, 0) + 1
        high = low
        if not hits:
            continue
        by: dict[tuple[int, int], list[int]] = {}
        for j, k in hits.items():
            by.setdefault((k, group[j]), []).append(j)
        for k, g in sorted(by, reverse=True) if len(by) > 1 else by:
            moved = by[k, g]
            g = group[moved[0]]
            have = size[g]
            if len(moved) == have:
                continue
            end = g + have
            new = end - len(moved)
            size[g], size[new] = have - len(moved), len(moved)
            for j in moved:
                end -= 1
                p, other = place[j], sa[end]
                sa[p], sa[end] = other, j
                place[other], place[j] = p, end
                group[j] = new

    free = list(range(n))
    out = [-1] * n
    out[0], placed = n - 1, bytearray(n)
    placed[n - 1] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            k = free[g]
            out[k] = j
            free[g] = k + 1
            placed[j] = 1
            j = before[j]
    return np.array(out[1:], np.int64)
