"""Set operations on sorted id lists by galloping: doubling steps, then a search in the last step.

A run of ids that no other list interrupts is found in the logarithm of its length and copied
whole, so lists of very different lengths cost little more than the shorter one.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence


def reach(ids: Sequence[int], bound: int, at: int = 0) -> int:
    """The first place from ``at`` on whose id is not below ``bound``."""
    n = len(ids)
    if at >= n or ids[at] >= bound:
        return at
    step, ahead = 1, at + 1
    while ahead < n and ids[ahead] < bound:
        at, step = ahead, 2 * step
        ahead = at + step
    return bisect_left(ids, bound, at + 1, min(ahead, n))


def union(lists: Sequence[Sequence[int]]) -> list[int]:
    """Ids in any of the sorted lists, once each: a k-way merge that copies runs."""
    lists = [x for x in lists if x]
    places, out = [0] * len(lists), []
    while len(lists) > 1:
        heads = [x[p] for x, p in zip(lists, places)]
        low = min(heads)
        lead = heads.index(low)
        bound = None
        for i, head in enumerate(heads):
            if i == lead:
                continue
            if head == low:
                places[i] += 1
                if places[i] == len(lists[i]):
                    continue
                head = lists[i][places[i]]
            if bound is None or head < bound:
                bound = head
        mine = lists[lead]
        end = len(mine) if bound is None else reach(mine, bound, places[lead])
        out += mine[places[lead] : end]
        places[lead] = end
        left = [i for i, x in enumerate(lists) if places[i] < len(x)]
        if len(left) < len(lists):
            lists, places = [lists[i] for i in left], [places[i] for i in left]
    if lists:
        out += lists[0][places[0] :]
    return out


def difference(ids: Sequence[int], without: Sequence[int]) -> list[int]:
    """Ids of the first sorted list that the second lacks."""
    out, i, j = [], 0, 0
    while i < len(ids):
        j = reach(without, ids[i], j)
        if j == len(without):
            return out + list(ids[i:])
        if without[j] == ids[i]:
            i += 1
            continue
        end = reach(ids, without[j], i)
        out += ids[i:end]
        i = end
    return out


def shared(a: Sequence[int], b: Sequence[int]) -> list[int]:
    """Ids in both sorted lists."""
    out, i, j = [], 0, 0
    while i < len(a):
        j = reach(b, a[i], j)
        if j == len(b):
            break
        if b[j] == a[i]:
            out.append(a[i])
            i += 1
        else:
            i = reach(a, b[j], i)
    return out
