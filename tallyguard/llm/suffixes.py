"""Suffix arrays by linear grouping.

The next smaller suffix of a suffix i is the first one right of i that is smaller; the text
from i up to it is i's Lyndon prefix. Phase one groups suffixes by Lyndon prefix: it starts
with groups by first symbol and takes the groups from the largest to the smallest. Each
suffix of the current group is appended to the Lyndon prefix of its previous smaller suffix,
which therefore moves to a new group behind its old one; the pointers to previous smaller
suffixes of larger groups are known by then and serve as jumps. Phase two goes through the
suffixes in order: whoever's next smaller suffix is the current one is the next of its group.
No symbols are renamed and nothing is compared twice.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray | list) -> list[int]:
    """Starts of all suffixes of a sequence of integers, in ascending order."""
    text = np.asarray(symbols, np.int64)
    n = len(text) + 1
    if n == 1:
        return []
    # A smallest symbol ends the text.
    text = np.append(text, text.min() - 1)
    order = np.argsort(text, kind="stable")
    ranked = text[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    starts = np.flatnonzero(first)
    group_of = np.empty(n, np.int64)
    group_of[order] = starts[np.cumsum(first) - 1]
    size = dict(zip(starts.tolist(), np.diff(np.append(starts, n)).tolist()))
    at, group = order.tolist(), group_of.tolist()
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    place = place.tolist()
    smaller = _group_suffixes(at, group, place, size)
    return _emit(group, smaller, size, n)[1:]


def _group_suffixes(at: list, group: list, place: list, size: dict) -> list:
    """Phase one. ``at``: suffixes group by group; ``group``: the first place of each suffix's
    group; ``place``: each suffix's place; ``size``: by first place. Returns the previous
    smaller suffix of each suffix, or -1."""
    smaller = [-1] * len(at)
    end = len(at) - 1
    while end > 0:
        start = group[at[end]]
        times: dict[int, int] = {}
        members = at[start : end + 1]
        if end > start:
            members.sort()
        for suffix in members:
            before = suffix - 1
            while before >= 0 and group[before] >= start:
                before = smaller[before]
            smaller[suffix] = before
            if before >= 0:
                times[before] = times.get(before, 0) + 1
        moved: dict[int, list] = {}
        for suffix, count in times.items():
            moved.setdefault(group[suffix], []).append((count, suffix))
        for old, longer in moved.items():
            if len(longer) > 1:
                longer.sort()
            if len(longer) == size[old] and longer[0][0] == longer[-1][0]:
                continue
            # The more often a Lyndon prefix is appended, the larger the new one.
            last = old + size[old]
            total = size[old]
            at_end = last
            while longer:
                count = longer[-1][0]
                run = []
                while longer and longer[-1][0] == count:
                    suffix = longer.pop()[1]
                    at_end -= 1
                    here, other = place[suffix], at[at_end]
                    at[here], at[at_end] = other, suffix
                    place[other], place[suffix] = here, at_end
                    run.append(suffix)
                for suffix in run:
                    group[suffix] = at_end
                size[at_end] = len(run)
            if at_end > old:
                size[old] = total - (last - at_end)
        end = start - 1
    return smaller


def _emit(group: list, smaller: list, size: dict, n: int) -> list:
    """Phase two: the suffixes in order, the end of the text first."""
    out = [0] * n
    out[0] = n - 1
    free = {start: start for start in size}
    placed = bytearray(n)
    placed[n - 1] = 1
    for i in range(n):
        suffix = out[i] - 1
        while suffix >= 0 and not placed[suffix]:
            own = group[suffix]
            spot = free[own]
            out[spot] = suffix
            free[own] = spot + 1
            placed[suffix] = 1
            suffix = smaller[suffix]
    return out
