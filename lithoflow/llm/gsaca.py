"""Suffix arrays by grouping: suffixes grouped by Lyndon prefixes in descending order, then emitted group by group.

Linear in text and alphabet: the only order taken is a count of symbols. Nothing is renamed or recursed.
"""

from __future__ import annotations

_UNKNOWN = -2


def suffix_array(text: list[int]) -> list[int]:
    """Places of text's suffixes in order; the end counts as a least symbol, whose suffix is left out."""
    n = len(text) + 1
    # counts of symbols give each its interval of places
    at_symbol = [0] * (max(text, default=0) + 1)
    for x in text:
        at_symbol[x] += 1
    at = 1
    for x, count in enumerate(at_symbol):
        at_symbol[x] = at
        at += count
    order = [n - 1] * n
    for i, x in enumerate(text):
        order[at_symbol[x]] = i
        at_symbol[x] += 1
    # a group is an interval of `order`; its members know its start, and stop[start] is its end
    start, stop = [0] * n, [0] * (n + 1)
    at = 0
    while at < n:
        end = at + 1
        if order[at] != n - 1:
            while end < n and text[order[end]] == text[order[at]]:
                end += 1
        for i in range(at, end):
            start[order[i]] = at
        stop[at] = end
        at = end
    place = [0] * n
    for i, s in enumerate(order):
        place[s] = i

    # phase 1: from the greatest group down, move the suffixes just before a group's runs behind their own groups
    before = [_UNKNOWN] * n
    high = n
    while high > 0:
        low = start[order[high - 1]]
        followers: dict[int, int] = {}
        for s in order[low:high]:
            if before[s] != _UNKNOWN:
                continue
            # a member met on the way down has the same smaller one before it
            run, j = [s], s - 1
            while j >= 0 and start[j] >= low:
                if start[j] == low and before[j] == _UNKNOWN:
                    run.append(j)
                    j -= 1
                else:
                    j = before[j]
            for x in run:
                before[x] = j
            if j >= 0:
                followers[j] = followers.get(j, 0) + len(run)
        by_run: dict[int, list[int]] = {}
        for p, k in followers.items():
            by_run.setdefault(k, []).append(p)
        for k in range(max(by_run, default=0), 0, -1):
            if k not in by_run:
                continue
            # those before the longest runs go furthest up: their prefix is extended most
            moved: dict[int, int] = {}
            for p in by_run[k]:
                old = start[p]
                end = stop[old] - 1
                stop[old] = end
                q, i = order[end], place[p]
                order[i], order[end] = q, p
                place[q], place[p] = i, end
                moved[old] = moved.get(old, 0) + 1
            heads = {old: stop[old] for old in moved}
            for p in by_run[k]:
                start[p] = heads[start[p]]
            for old, count in moved.items():
                stop[heads[old]] = heads[old] + count
        high = low

    # phase 2: each emitted suffix emits those whose extended prefixes end at it
    free, out, done = list(range(n)), [0] * n, [False] * n
    out[0] = n - 1
    done[n - 1] = True
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not done[j]:
            g = start[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = True
            j = before[j]
    return out[1:]


def common_prefixes(text: list[int], order: list[int]) -> list[int]:
    """For each place in order the length of the prefix that its suffix has in common with the one before; 0 for the first."""
    n = len(text)
    rank = [0] * n
    for i, s in enumerate(order):
        rank[s] = i
    out, h = [0] * n, 0
    for s in range(n):
        r = rank[s]
        if r:
            t = order[r - 1]
            m = n - max(s, t)
            while h < m and text[s + h] == text[t + h]:
                h += 1
            out[r] = h
            if h:
                h -= 1
        else:
            h = 0
    return out
