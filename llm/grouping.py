"""Suffix array by linear grouping.

Phase 1 turns groups of suffixes, at first one per leading symbol, into groups per longest Lyndon prefix.
Groups are processed in descending order.  The suffixes of a group point at their previous smaller
suffix (the nearest one to the left in a lower group); those pointed at leave their group for a new one just
above it, higher the more pointers they got.  Phase 2 walks the finished groups in ascending order: every
suffix that gets its place puts the suffix before it, and that one's chain of previous smaller suffixes,
at the front of their groups.  No suffix is ever renamed by a sort over pairs of ranks.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> list[int]:
    """Order of all suffixes of ``symbols``, whose last entry has to be its only 0."""
    n = len(symbols)
    if n == 0:
        return []
    order = np.argsort(symbols, kind="stable")
    at = order.tolist()  # suffixes by group
    ranked = symbols[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    begin_of = np.repeat(first, np.diff(np.append(first, n)))
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    group = begin_of[place].tolist()  # where the group of a suffix begins
    place = place.tolist()
    end = [0] * n  # one past the last place of the group that begins here
    for a, b in zip(first.tolist(), np.append(first[1:], n).tolist()):
        end[a] = b
    smaller = [-2] * n  # previous smaller suffix; -2: not known yet

    top = n
    while top:
        begin = group[at[top - 1]]
        pointed: dict[int, int] = {}
        for i in at[begin:top]:
            j = i - 1
            while j >= 0 and group[j] >= begin:
                j = smaller[j] if smaller[j] != -2 else j - 1
            smaller[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        if pointed:
            by: dict[int, list[int]] = {}
            for j, k in pointed.items():
                by.setdefault(k, []).append(j)
            steps = [by[k] for k in sorted(by, reverse=True)] if len(by) > 1 else by.values()
            for step in steps:
                moved: dict[int, int] = {}
                for j in step:  # to the end of its group
                    g = group[j]
                    last = end[g] - 1 - moved.get(g, 0)
                    moved[g] = moved.get(g, 0) + 1
                    p, other = place[j], at[last]
                    at[p], at[last] = other, j
                    place[other], place[j] = p, last
                for g, count in moved.items():
                    new = end[g] - count
                    if new != g:  # else the whole group moved, and stays as it is
                        end[new] = end[g]
                        end[g] = new
                        for q in range(new, end[new]):
                            group[at[q]] = new
        top = begin

    out, placed = [0] * n, bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    ahead = list(range(n))  # next free place at the front of the group that begins here
    for r in range(n):
        j = out[r] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[ahead[g]] = j
            ahead[g] += 1
            placed[j] = 1
            j = smaller[j]
    return out
