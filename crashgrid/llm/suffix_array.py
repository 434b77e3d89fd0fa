"""Suffix array by linear grouping, without recursion.

First phase: suffixes are grouped by their longest Lyndon prefix. Groups start as those
of one letter and are taken in descending order. Each suffix of a group points to the
previous suffix of a smaller group; a suffix that gets l pointers is followed by l copies
of the group's prefix, so it moves, with the others of its own group that got l, into a
new group right behind. Second phase: the order in a group is that of the suffixes which
follow the common prefix. These are smaller, so going up the array, every suffix found
hands the next free place of their groups to those that it follows.
"""

from __future__ import annotations

import numpy as np


def lyndon_groups(letters: np.ndarray) -> tuple[list[int], list[int]]:
    """Group (its first place in the array) and length of the longest Lyndon prefix of each suffix.

    ``letters`` must end in a letter that is smaller than all others.
    """
    order = np.argsort(letters, kind="stable")
    n = len(letters)
    first = np.flatnonzero(np.r_[True, letters[order][1:] != letters[order][:-1]])
    sizes = np.diff(np.r_[first, n])
    group_at = np.repeat(first, sizes)
    group = np.empty(n, np.int64)
    group[order] = group_at
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    array, group, place = order.tolist(), group.tolist(), place.tolist()
    size, length = [0] * n, [1] * n  # by first place of a group
    for f, s in zip(first.tolist(), sizes.tolist(), strict=True):
        size[f] = s
    previous = [-1] * n

    end = n
    while end:
        start = group[array[end - 1]]
        pointed: dict[int, int] = {}
        most = 1
        for i in array[start:end] if end - start < 2 else sorted(array[start:end]):
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                if j in pointed:
                    pointed[j] = count = pointed[j] + 1
                    if count > most:
                        most = count
                else:
                    pointed[j] = 1
        own = length[start]
        end = start
        for times in range(most, 0, -1):
            if most == 1:
                chosen = pointed
            else:
                chosen = [j for j, count in pointed.items() if count == times]
            if len(chosen) == 1:
                together = [(group[j], (j,)) for j in chosen]
            else:
                by_group: dict[int, list[int]] = {}
                for j in chosen:
                    by_group.setdefault(group[j], []).append(j)
                together = by_group.items()
            for old, moved in together:
                m = len(moved)
                if m == size[old]:
                    length[old] += times * own
                    continue
                size[old] -= m
                new = old + size[old]
                size[new] = m
                length[new] = length[old] + times * own
                at = new
                for j in moved:
                    p, other = place[j], array[at]
                    array[p], place[other] = other, p
                    array[at], place[j] = j, at
                    group[j] = new
                    at += 1
    return group, [length[g] for g in group]


def suffix_array(letters: np.ndarray) -> list[int]:
    """Start positions of all suffixes in ascending order; see ``lyndon_groups`` for the input."""
    n = len(letters)
    if n == 0:
        return []
    group, length = lyndon_groups(letters)
    after = np.arange(n) + np.array(length)  # the suffix behind the Lyndon prefix
    followers = np.argsort(after, kind="stable")
    bounds = np.searchsorted(after[followers], np.arange(n + 1)).tolist()
    followers = followers.tolist()
    out, free = [-1] * n, list(range(n))  # free place by first place of a group
    out[0] = n - 1
    for s in range(n):
        suffix = out[s]
        for j in followers[bounds[suffix] : bounds[suffix + 1]]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
    return out
