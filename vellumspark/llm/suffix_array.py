"""Suffix arrays by linear grouping on Lyndon prefixes.

Suffixes are first grouped by their Lyndon prefix: groups are processed in descending order, each suffix finds the
previous suffix of a smaller group by following previous-smaller pointers, and the suffixes so found move to the
end of their own group, those that are found more often further up, since their prefix grew by one more copy. Then every group's
order follows in one ascending pass: a suffix that comes next in the array places the suffixes whose Lyndon
prefix ends where it starts. Nothing is renamed and nothing recurses. All steps are linear but the first one's sort of the symbols, and
the sorts that put a group's suffixes in order of place, which the interpreter's sort does faster than bucket passes would.
"""

from __future__ import annotations


def suffix_array(symbols: list[int]) -> list[int]:
    """The starts of the suffixes of ``symbols`` in ascending order; a proper prefix sorts before what it begins."""
    if not symbols:
        return []
    low = min(symbols) - 1
    s = [*symbols, low]
    n = len(s)
    order = sorted(range(n), key=s.__getitem__)
    place, group, end, prev = [0] * n, [0] * n, [0] * (n + 1), [-1] * n
    start = 0
    for k, i in enumerate(order):
        if k and s[i] != s[order[k - 1]]:
            end[start] = k
            start = k
        place[i], group[i] = k, start
    end[start] = n

    top = n
    while top:
        low_end = group[order[top - 1]]
        if top - low_end == 1:
            i = order[low_end]
            p = i - 1
            while p >= 0 and group[p] >= low_end:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                g = group[p]
                last = end[g] - 1
                if last > g:
                    q, k = order[last], place[p]
                    order[k], place[q] = q, k
                    order[last], place[p], group[p] = p, last, last
                    end[g], end[last] = last, last + 1
        else:
            found: dict[int, int] = {}
            for i in sorted(order[low_end:top]):
                p = i - 1
                while p >= 0 and group[p] >= low_end:
                    p = prev[p]
                prev[i] = p
                if p >= 0:
                    found[p] = found.get(p, 0) + 1
            by_count: dict[int, list[int]] = {}
            for p, c in found.items():
                by_count.setdefault(c, []).append(p)
            for c in sorted(by_count, reverse=True):
                ends: dict[int, int] = {}
                for p in by_count[c]:
                    g = group[p]
                    last = end[g] - 1
                    ends.setdefault(g, last + 1)
                    q, k = order[last], place[p]
                    order[k], place[q] = q, k
                    order[last], place[p] = p, last
                    end[g] = last
                for g, was in ends.items():
                    new = end[g]
                    if new == g:
                        end[g] = was
                        continue
                    for k in range(new, was):
                        group[order[k]] = new
                    end[new] = was
        top = low_end

    free = list(range(n))
    array = [0] * n
    array[0] = n - 1
    for r in range(n):
        i = array[r]
        stop, j = prev[i], i - 1
        while j != stop:
            g = group[j]
            array[free[g]] = j
            free[g] += 1
            j = prev[j]
    return array[1:]
