"""Suffix arrays by linear grouping construction.

Every suffix starts with a longest Lyndon word, and suffixes fall into groups by that word. The groups are found in
descending order: a finished group's suffixes point to their previous smaller suffixes, whose words they extend, so
these move up into new groups behind their old ones. Then the groups' inner orders are emitted in one ascending pass:
the next suffix in order places the suffixes whose words end where it begins. There is no renaming and no recursion; the
time is linear.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``symbols`` in lexicographic order; symbols are any integers."""
    n = len(symbols) + 1  # with a terminal below all symbols
    if n <= 2:
        return np.arange(n - 1)
    _, ranks = np.unique(symbols, return_inverse=True)
    ranks = np.append(ranks + 1, 0)
    order = np.argsort(ranks, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(ranks))[:-1]])
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    sa, at, group = order.tolist(), place.tolist(), first[ranks].tolist()
    size = dict(zip(first.tolist(), np.bincount(ranks).tolist()))
    before = [-1] * n  # previous smaller suffix

    # groups in descending order
    top = n - 1
    while top >= 0:
        low = group[sa[top]]
        members = sa[low:top + 1]
        if len(members) > 1:
            members.sort()
        extended: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= low:
                j = before[j]
            before[i] = j
            if j >= 0:
                extended[j] = extended.get(j, 0) + 1
        # suffixes extended once more often than others of their group go higher
        if len(extended) == 1:
            (j, _), = extended.items()
            start = group[j]
            count = size[start]
            if count > 1:
                end = start + count - 1
                other, spot = sa[end], at[j]
                sa[spot], sa[end] = other, j
                at[other], at[j] = spot, end
                size[start] = count - 1
                size[end] = 1
                group[j] = end
        elif extended:
            moved: dict[tuple[int, int], list[int]] = {}
            for j, times in extended.items():
                moved.setdefault((group[j], -times), []).append(j)
            for start, times in sorted(moved):
                part = moved[start, times]
                count = size[start]
                if count == len(part):
                    continue
                fresh = start + count - len(part)
                end = start + count
                for j in part:
                    end -= 1
                    other, spot = sa[end], at[j]
                    sa[spot], sa[end] = other, j
                    at[other], at[j] = spot, end
                size[start] = count - len(part)
                size[fresh] = len(part)
                for j in part:
                    group[j] = fresh
        top = low - 1

    # each group's order, from the smallest suffix up
    result, front, placed = [0] * n, list(range(n)), bytearray(n)
    result[0], placed[n - 1] = n - 1, 1
    for k in range(n):
        j = result[k] - 1
        while j >= 0 and not placed[j]:
            spot = front[group[j]]
            front[group[j]] = spot + 1
            result[spot] = j
            placed[j] = 1
            j = before[j]
    return np.array(result[1:])
