"""Word-level suffix arrays of many texts at once, with adjacent LCPs."""

from __future__ import annotations

import numpy as np


def suffix_array(codes: np.ndarray, text_end: np.ndarray):
    """Suffix array of every text, one after the other.

    ``codes``: word codes (0..) of all texts; ``text_end``: for each position,
    the end of its text.  Prefix doubling (Larsson and Sadakane): only suffixes
    that still share their rank are sorted again, by the rank that lies as many
    words further as are already sorted.  Returns (sa, ranks); ``ranks[j]``
    numbers the classes of equal prefixes of 2^j words."""
    n = len(codes)
    sa = np.arange(n)
    if n == 0:
        return sa, []
    key = text_end * (int(codes.max()) + 1) + codes      # texts come one after the other
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.ones(n, dtype=bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    slot = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = slot
    sa = order.copy()
    ranks = [rank.astype(np.int32) if n < 2**31 else rank.copy()]
    k = 1
    live = _open(slot)
    while len(live):
        idx = sa[live]                  # positions whose class has others, by class
        first = rank[idx]
        nxt = idx + k
        inside = nxt < text_end[idx]
        second = np.where(inside, rank[np.minimum(nxt, n - 1)], -1) + 1
        key = first * (n + 1) + second
        order = np.argsort(key, kind="stable")
        idx, key, first = idx[order], key[order], first[order]
        pos = np.arange(len(idx))
        g = np.ones(len(idx), dtype=bool)
        g[1:] = first[1:] != first[:-1]
        s = np.ones(len(idx), dtype=bool)
        s[1:] = key[1:] != key[:-1]
        in_group = np.maximum.accumulate(np.where(g, pos, 0))
        in_class = np.maximum.accumulate(np.where(s, pos, 0))
        sa[first + pos - in_group] = idx
        slot = first + in_class - in_group
        rank[idx] = slot
        ranks.append(rank.astype(ranks[0].dtype))
        at = np.flatnonzero(_shared(slot))
        live = first[at] + (pos - in_group)[at]
        k *= 2
    return sa, ranks


def _shared(slot):
    same = slot[1:] == slot[:-1]
    out = np.zeros(len(slot), dtype=bool)
    out[1:] |= same
    out[:-1] |= same
    return out


def _open(slot):
    return np.flatnonzero(_shared(slot))


def adjacent_lcp(sa: np.ndarray, ranks: list, text_end: np.ndarray) -> np.ndarray:
    """lcp[j]: words that the suffixes sa[j-1] and sa[j] share (lcp[0] = 0; 0
    across texts), read off the classes of 2^j words, longest first."""
    lcp = np.zeros(len(sa), dtype=np.int64)
    if len(sa) < 2:
        return lcp
    at = np.flatnonzero((ranks[0][sa[1:]] == ranks[0][sa[:-1]])) + 1    # classes hold one text's suffixes only
    a, b = sa[at - 1].copy(), sa[at].copy()
    ea, eb = text_end[a], text_end[b]
    total = np.zeros(len(at), dtype=np.int64)
    for j in range(len(ranks) - 1, -1, -1):
        ok = (a < ea) & (b < eb)
        ok[ok] = ranks[j][a[ok]] == ranks[j][b[ok]]
        a[ok] += 1 << j
        b[ok] += 1 << j
        total[ok] += 1 << j
    lcp[at] = total
    return lcp


def longest_repeat_at(sa: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest substring that starts there
    and occurs elsewhere in its text: the larger LCP of its two neighbours,
    which is the value of the smallest LCP interval that holds the suffix."""
    m = lcp.copy()
    if len(m) > 1:
        m[:-1] = np.maximum(lcp[:-1], lcp[1:])
    out = np.empty_like(m)
    out[sa] = m
    return out


def covered(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Marks the union of the spans [start, start + length)."""
    diff = np.bincount(start, minlength=n + 1) - np.bincount(start + length, minlength=n + 1)
    return np.cumsum(diff[:n]) > 0
