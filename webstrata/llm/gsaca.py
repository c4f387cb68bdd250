"""Suffix array by linear grouping: Lyndon-prefix groups in descending order, then direct emission.

The first phase keeps all suffixes in groups of equal known prefix, ordered by that prefix. Taking groups from the
largest down, each suffix i of the group points to prev(i), the nearest earlier suffix in a smaller group; the suffixes
pointed at can be told apart from the rest of their groups (their prefix goes on with this group's), by how often they
are pointed at, and move to a new group right above the old one. At the end suffixes are grouped by their longest
Lyndon prefix. The second phase walks the array from the left and puts, for every suffix emitted, the preceding suffix
and its chain of prev pointers at the front of their groups. Nothing is renamed and nothing recurses.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: list[int]) -> list[int]:
    """Order of all suffixes of ``text``, whose last symbol must be smaller than every other."""
    n = len(text)
    if n == 0:
        return []
    order = sorted(range(n), key=text.__getitem__)
    place, group, size = [0] * n, [0] * n, [0] * (n + 1)
    start = 0
    for at, i in enumerate(order):
        if at and text[i] != text[order[at - 1]]:
            start = at
        place[i], group[i] = at, start
        size[start] += 1
    prev = [-1] * n

    def lift(g: int, chosen: list[int]) -> None:
        """Move ``chosen`` members of group g to a new group right above what is left of g."""
        m, last = len(chosen), g + size[g] - 1
        fresh = last + 1 - m
        for q in chosen:
            at, r = place[q], order[last]
            order[last], order[at] = q, r
            place[q], place[r] = last, at
            group[q] = fresh
            last -= 1
        size[g] -= m
        size[fresh] = m

    end = n
    while end > 0:
        low = group[order[end - 1]]
        if end - low == 1:
            i = order[low]
            p = i - 1
            while p >= 0 and group[p] >= low:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                g = group[p]
                m = size[g]
                if m > 1:
                    last = g + m - 1
                    at = place[p]
                    r = order[last]
                    order[last], order[at] = p, r
                    place[p], place[r] = last, at
                    group[p] = last
                    size[g] = m - 1
                    size[last] = 1
        else:
            pointed: dict[int, int] = {}
            for i in sorted(order[low:end]):
                p = i - 1
                while p >= 0 and group[p] >= low:
                    p = prev[p]
                prev[i] = p
                if p >= 0:
                    pointed[p] = pointed.get(p, 0) + 1
            often = set(pointed.values())
            for times in sorted(often, reverse=True):
                by_group: dict[int, list[int]] = {}
                for p, k in pointed.items():
                    if k == times:
                        g = group[p]
                        if g in by_group:
                            by_group[g].append(p)
                        else:
                            by_group[g] = [p]
                for g, chosen in by_group.items():
                    if size[g] > len(chosen):
                        lift(g, chosen)
        end = low

    out, front, placed = [0] * n, list(range(n)), bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for at in range(n):
        i = out[at] - 1
        while i >= 0 and not placed[i]:
            g = group[i]
            out[front[g]] = i
            front[g] += 1
            placed[i] = 1
            i = prev[i]
    return out


#: Longer texts are sorted one by one; side by side they would leave most lanes idle.
ALONE = 8_000


def suffix_arrays(texts: list[np.ndarray]) -> np.ndarray:
    """Suffix arrays of many texts (each ending in its own smallest symbol), one after another, as places in their concatenation.

    All texts are sorted side by side by the steps of ``suffix_array``: each step takes the largest group left in every
    text, so array operations stand for one step of all of them.
    """
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    out = np.empty(int(starts[-1]), np.int64)
    short = [i for i, t in enumerate(texts) if len(t) <= ALONE]
    short.sort(key=lambda i: len(texts[i]))
    for i, t in enumerate(texts):
        if len(t) > ALONE:
            out[starts[i] : starts[i + 1]] = np.array(suffix_array(t.tolist())) + starts[i]
    if short:
        made = _side_by_side([texts[i] for i in short])
        at = 0
        for i in short:
            n = len(texts[i])
            out[starts[i] : starts[i + 1]] = made[at : at + n] - at + starts[i]
            at += n
    return out


def _side_by_side(texts: list[np.ndarray]) -> np.ndarray:
    sizes = np.array([len(t) for t in texts])
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    text = np.concatenate(texts).astype(np.int64)
    total = len(text)
    lane = np.repeat(np.arange(len(texts)), sizes)
    order = np.lexsort((text, lane))
    place = np.empty(total, np.int64)
    place[order] = np.arange(total)
    new = np.concatenate([[True], (text[order][1:] != text[order][:-1]) | (lane[order][1:] != lane[order][:-1])])
    heads = np.flatnonzero(new)
    size = np.zeros(total + 1, np.int64)
    size[heads] = np.diff(np.append(heads, total))
    group = np.empty(total, np.int64)
    group[order] = np.repeat(heads, size[heads])
    prev = np.full(total, -1, np.int64)
    chosen = np.zeros(total, bool)

    live, end = np.arange(len(texts)), base + sizes
    while len(live):
        top, floor = end[live], base[live]
        low = group[order[top - 1]]
        many = top - low
        # Members of the groups in hand, and the nearest smaller one before each.
        row = np.repeat(np.arange(len(live)), many)
        i = order[np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + low[row]]
        least, limit = floor[row], low[row]
        p = i - 1
        open_ = np.flatnonzero(p >= least)
        while len(open_):
            q = p[open_]
            g, bound = group[q], limit[open_]
            open_, q, g, bound = (x[g >= bound] for x in (open_, q, g, bound))
            p[open_] = np.where(g > bound, prev[q], q - 1)
            open_ = open_[p[open_] >= least[open_]]
        prev[i] = p
        end[live] = low
        live = live[low > floor]
        p = np.sort(p[p >= least])
        if not len(p):
            continue
        first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        u, times = p[first], np.diff(np.append(first, len(p)))
        g = group[u]
        by = np.lexsort((times, g))
        u, times, g = u[by], times[by], g[by]
        # Within each group the chosen go to its end, those pointed at most often last.
        cut = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        k = np.diff(np.append(cut, len(g)))
        owner = g[cut]
        had = size[owner]
        tail = np.repeat(owner + had - k, k)
        to = tail + np.arange(len(g)) - np.repeat(cut, k)
        chosen[u] = True
        at = place[u]
        left = order[to]
        left = left[~chosen[left]]
        holes = at[at < tail]
        order[holes] = left
        place[left] = holes
        order[to] = u
        place[u] = to
        chosen[u] = False
        part = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (times[1:] != times[:-1])]))
        fresh, count = to[part], np.diff(np.append(part, len(g)))
        size[owner] = had - k
        size[fresh] = count
        group[u] = np.repeat(fresh, count)

    out = np.empty(total, np.int64)
    front = np.arange(total + 1)
    placed = np.zeros(total, bool)
    out[base] = base + sizes - 1
    placed[base + sizes - 1] = True
    # Texts stand in ascending length: those still running are a suffix of the list.
    done = 0
    for step in range(int(sizes[-1])):
        while sizes[done] <= step:
            done += 1
        floor = base[done:]
        i = out[floor + step] - 1
        keep = i >= floor
        i, floor = i[keep], floor[keep]
        while len(i):
            keep = ~placed[i]
            i, floor = i[keep], floor[keep]
            g = group[i]
            out[front[g]] = i
            front[g] += 1
            placed[i] = True
            i = prev[i]
            keep = i >= floor
            i, floor = i[keep], floor[keep]
    return out
