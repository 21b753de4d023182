"""Linear suffix array construction by grouping, for many strings at once.

The algorithm is Baier's (CPM 2016): suffixes are first grouped by their Lyndon
prefixes, processing groups from the highest to the lowest and, with previous-
smaller pointers, moving every suffix that a processed suffix points to into a
later group; then each group's order is emitted from the array itself.  No
suffix is renamed recursively.  Here the strings are independent lanes: one step
takes the highest open group of every string together, as array operations over
the members of all these groups."""

from __future__ import annotations

import numpy as np


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], .., start[0] + size[0] - 1, start[1], .."""
    at = np.cumsum(size) - size
    return np.repeat(start - at, size) + np.arange(int(size.sum()))


def suffix_arrays(text: np.ndarray, lane_start: np.ndarray) -> np.ndarray:
    """Suffix arrays of the strings text[lane_start[k]:lane_start[k + 1]], one
    after the other, as positions in ``text``.  ``text``: unsigned integers; a
    string's end counts as smaller than any letter."""
    n = len(text)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    lane = np.repeat(np.arange(len(lane_start) - 1), np.diff(lane_start))
    # first groups: suffixes of one string by their first letter
    key = lane * (int(text.max()) + 1) + text
    sa = np.argsort(key, kind="stable")
    k = key[sa]
    new = np.ones(n, dtype=bool)
    new[1:] = k[1:] != k[:-1]
    start = np.flatnonzero(new)
    size = np.zeros(n, dtype=np.int64)              # of a group, at its first slot
    size[start] = np.diff(np.append(start, n))
    group = np.empty(n, dtype=np.int64)             # of a suffix: the group's first slot
    group[sa] = np.repeat(start, size[start])
    isa = np.empty(n, dtype=np.int64)
    isa[sa] = np.arange(n)
    prev = np.full(n, -1, dtype=np.int64)           # previous suffix of a lower group
    first = lane_start[:-1][lane]

    _group(sa, isa, group, size, prev, first, lane_start)
    return _emit(sa, isa, group, prev, lane_start)


def _group(sa, isa, group, size, prev, first, lane_start):
    """Phase 1: Lyndon grouping, from each string's highest group down."""
    end = lane_start[1:].copy()                     # slots below are still open
    live = np.flatnonzero(end > lane_start[:-1])
    while len(live):
        gs = group[sa[end[live] - 1]]
        count = size[gs]
        member = sa[_ranges(gs, count)]
        g = np.repeat(gs, count)
        _point(member, g, group, prev, first)
        parent = prev[member]
        parent = parent[parent >= 0]
        if len(parent):
            _split(parent, sa, isa, group, size)
        end[live] = gs
        live = live[gs > lane_start[:-1][live]]


def _point(member, g, group, prev, first):
    """prev of every member: the nearest suffix to the left whose group is lower
    than the members' group ``g``; larger groups are jumped over by their own
    pointers, members by the pointers found for them."""
    p = member - 1
    p[p < first[member]] = -1
    chain = np.full(len(member), -1, dtype=np.int64)    # a member that the search ran into
    active = np.flatnonzero(p >= 0)
    while len(active):
        q, gq, ga = p[active], group[p[active]], g[active]
        higher, same = gq > ga, gq == ga
        chain[active[same]] = q[same]
        active = active[higher]
        p[active] = prev[p[active]]
        active = active[p[active] >= 0]
    prev[member] = np.where(chain >= 0, -1, p)
    wait = np.flatnonzero(chain >= 0)
    if len(wait):           # runs of members: take over the pointer at the run's start
        link = chain[wait]
        order = np.argsort(member)
        root = np.arange(len(member))
        root[wait] = order[np.searchsorted(member[order], link)]
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        prev[member] = prev[member[root]]


def _split(parent, sa, isa, group, size):
    """Move every parent to a new group behind the rest of its group; those that
    are pointed to more often, further back."""
    p, times = np.unique(parent, return_counts=True)
    h = group[p]
    order = np.lexsort((times, h))
    p, times, h = p[order], times[order], h[order]
    n = len(p)
    at = np.arange(n)
    head = np.ones(n, dtype=bool)
    head[1:] = h[1:] != h[:-1]
    of_h = np.flatnonzero(head)
    many = np.diff(np.append(of_h, n))              # parents of each old group
    hs = h[of_h]
    tail = hs + size[hs] - many                     # first slot that the parents take
    # free the tail: other members there change places with parents before it
    slot = isa[p]
    tail_of = np.repeat(tail, many)
    front = slot < tail_of
    if front.any():
        slots = _ranges(tail, many)
        there = sa[slots]
        known = np.sort(p)
        stays = known[np.minimum(np.searchsorted(known, there), n - 1)] == there
        movers = there[~stays]                      # by old group, in slot order
        holes = slot[front]                         # by old group as well
        sa[holes] = movers
        isa[movers] = holes
    new_slot = np.repeat(tail - of_h, many) + at
    sa[new_slot] = p
    isa[p] = new_slot
    # new groups: equal old group and equal count
    g = head.copy()
    g[1:] |= times[1:] != times[:-1]
    starts = np.flatnonzero(g)
    count = np.diff(np.append(starts, n))
    size[hs] -= many
    size[new_slot[starts]] = count
    group[p] = np.repeat(new_slot[starts], count)


def _emit(sa, isa, group, prev, lane_start):
    """Phase 2: read each array from its lowest slot; the suffix before the one
    read, and all that its pointers lead to, take the next places of their
    groups.  The virtual empty suffix is read first."""
    out = np.full(len(sa), -1, dtype=np.int64)
    done = np.zeros(len(sa), dtype=bool)
    free = np.arange(len(sa))                       # next place of a group, at its first slot
    lo, hi = lane_start[:-1], lane_start[1:]
    read = lo.copy()                                # next slot to read
    s = np.where(hi > lo, hi - 1, -1)               # the last suffix comes before the empty one
    live = np.flatnonzero(hi > lo)
    while len(live):
        x = s[live]
        place = x >= 0
        place[place] = ~done[x[place]]
        put, wait = live[place], live[~place]
        if len(put):
            x = x[place]
            g = group[x]
            out[free[g]] = x
            free[g] += 1
            done[x] = True
            s[put] = prev[x]
        if len(wait):
            wait = wait[read[wait] < hi[wait]]
            y = out[read[wait]] - 1
            read[wait] += 1
            s[wait] = np.where(y < lo[wait], -1, y)
        live = np.concatenate((put, wait)) if len(put) else wait
    return out
