"""Suffix sorting by grouping.

Suffixes are grouped by their Lyndon prefix.  Groups are processed from the
highest to the lowest: each of its suffixes finds the previous smaller suffix by
following pointers over finished ones, and that suffix's prefix grows by the
group's.  Once all groups stand in order, a suffix takes the next free place of
its group when the suffix behind its Lyndon prefix has got its own, so nothing
is renamed and sorted again.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_order(text: Sequence[int]) -> list[int]:
    """Starts of all suffixes of the text in ascending order; an empty text has none."""
    n = len(text)
    places: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        places.setdefault(c, []).append(i)
    held = [places[c] for c in sorted(places)]
    lower, upper = list(range(-1, len(held) - 1)), [*range(1, len(held)), -1]
    length, group = [1] * len(held), [0] * n
    for g, own in enumerate(held):
        for s in own:
            group[s] = g
    done, smaller, final = bytearray(n), [-1] * n, []
    g = len(held) - 1
    while g >= 0:
        held[g] = own = [s for s in held[g] if group[s] == g]
        if own:
            final.append(g)
            for s in own:
                done[s] = 1
            times: dict[int, int] = {}
            for s in own:
                j = s - 1
                while j >= 0 and done[j]:
                    j = smaller[j]
                smaller[s] = j
                if j >= 0:
                    times[j] = times.get(j, 0) + 1
            split: dict[tuple[int, int], list[int]] = {}
            for p, k in times.items():
                split.setdefault((group[p], k), []).append(p)
            # a prefix that grew more often stands higher; all stay below the present group
            for old, k in sorted(split, reverse=True) if len(split) > 1 else split:
                new, above = len(held), upper[old]
                held.append(split[old, k])
                length.append(length[old] + k * length[g])
                lower.append(old)
                upper.append(above)
                upper[old] = lower[above] = new
                for p in held[new]:
                    group[p] = new
        g = lower[g]
    final.reverse()
    free, at = [0] * len(held), 0
    behind, beside = [-1] * (n + 1), [-1] * n  # suffixes by where their Lyndon prefix ends
    for g in final:
        free[g] = at
        at += len(held[g])
        for p in held[g]:
            end = p + length[g]
            beside[p], behind[end] = behind[end], p
    order, at, p = [0] * n, 0, behind[n]
    while True:
        while p >= 0:
            g = group[p]
            order[free[g]] = p
            free[g] += 1
            p = beside[p]
        if at == n:
            return order
        p = behind[order[at]]
        at += 1
