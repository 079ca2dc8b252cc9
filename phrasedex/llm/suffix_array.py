"""Suffix array by induced sorting, with permuted common prefixes, of several texts at once (numpy).

The texts stand one after another, each closed by a separator below all bytes;
separators differ from one another and grow from left to right. Steps: classify
suffixes as larger (L) or smaller (S) than their right neighbour; sort the
leftmost-S substrings by induction and name them; sort the suffixes of the
string of names, renaming pairs of ranks recursively until they differ; induce
the L and then the S suffixes from them, bucket by bucket, each in linear time.
Permuted common prefixes: only where the characters before two neighbours differ
are prefixes compared; everywhere else a prefix is one shorter than the one
before it.
"""

from __future__ import annotations

import numpy as np

from .rolling import prefix, spans


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than its right neighbour's; the last one counts as smaller."""
    n = len(t)
    place = np.where(t[:-1] != t[1:], np.arange(n - 1), n - 1)
    place = np.minimum.accumulate(place[::-1])[::-1]
    out = np.ones(n, bool)
    inside = place < n - 1
    at = place[inside]
    out[:-1][inside] = t[at] < t[at + 1]
    return out


class _Buckets:
    def __init__(self, t: np.ndarray):
        self.counts = np.bincount(t)
        self.ends = np.cumsum(self.counts)
        self.heads = self.ends - self.counts
        self.symbols = np.flatnonzero(self.counts)


def _deal(sa: np.ndarray, symbols: np.ndarray, items: np.ndarray, fill: np.ndarray, forward: bool) -> None:
    """Append items, in order, to the buckets of their symbols (to the right of ``fill``, or to the left)."""
    if not len(items):
        return
    order = np.argsort(symbols, kind="stable")
    s = symbols[order]
    cut = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    size = np.diff(np.r_[cut, len(s)])
    rank = np.arange(len(s)) - np.repeat(cut, size)
    sa[fill[s] + rank if forward else fill[s] - 1 - rank] = items[order]
    fill[s[cut]] += size if forward else -size


def _induce(t: np.ndarray, small: np.ndarray, b: _Buckets, lms: np.ndarray) -> np.ndarray:
    """Suffixes in order, given the leftmost-S ones in order (or, for substrings, in any order per bucket)."""
    sa = np.full(len(t), -1, np.int64)
    tails = b.ends.copy()
    _deal(sa, t[lms[::-1]], lms[::-1], tails, False)
    lms_from = tails
    heads = b.heads.copy()
    for c in b.symbols.tolist():
        at = b.heads[c]
        while at < heads[c]:  # larger suffixes that start with a run of c
            wave = sa[at : heads[c]]
            at = heads[c]
            before = wave[wave > 0] - 1
            own = before[(t[before] == c) & ~small[before]]
            sa[heads[c] : heads[c] + len(own)] = own
            heads[c] += len(own)
        both = np.concatenate([sa[b.heads[c] : heads[c]], sa[lms_from[c] : b.ends[c]]])
        before = both[both > 0] - 1
        before = before[t[before] > c]
        _deal(sa, t[before], before, heads, True)
    tails = b.ends.copy()
    for c in b.symbols[::-1].tolist():
        at = b.ends[c]
        while at > tails[c]:  # smaller suffixes that start with a run of c
            wave = sa[tails[c] : at][::-1]
            at = tails[c]
            before = wave[wave > 0] - 1
            own = before[(t[before] == c) & small[before]]
            sa[tails[c] - len(own) : tails[c]] = own[::-1]
            tails[c] -= len(own)
        both = np.concatenate([sa[b.heads[c] : heads[c]], sa[tails[c] : b.ends[c]]])[::-1]
        before = both[both > 0] - 1
        before = before[t[before] < c]
        _deal(sa, t[before], before, tails, False)
        if c == 0:
            # Separators are leftmost-S and nothing smaller comes before them: their order is that of the text.
            sa[b.heads[0] : b.ends[0]] = np.flatnonzero(t == 0)
    return sa


def _order_of_names(names: np.ndarray) -> np.ndarray:
    """Suffixes of a string of names in order: ranks of pairs, of pairs of pairs, ... until all differ."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    s = names[order]
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.searchsorted(s, s, side="left") + 1
    rank[n] = 0
    step, open_ = 1, np.arange(n)
    while True:
        size = np.bincount(rank[:-1][open_], minlength=1)
        open_ = open_[size[rank[open_]] > 1]
        if not len(open_):
            break
        nxt = rank[np.minimum(open_ + step, n)]
        # Pairs as one number; the order of equal ones does not matter.
        order = np.argsort(rank[open_] * (n + 1) + nxt)
        r, x, who = rank[open_][order], nxt[order], open_[order]
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        new = np.r_[True, (r[1:] != r[:-1]) | (x[1:] != x[:-1])]
        start = np.repeat(first, np.diff(np.r_[first, len(r)]))
        place = np.arange(len(r)) - start
        lead = np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))
        rank[who] = r + place[lead]
        open_ = who
        step *= 2
    out = np.empty(n, np.int64)
    out[rank[:-1] - 1] = np.arange(n)
    return out


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of symbols that end with a 0; every 0 is a separator of its own, smaller than later ones."""
    small = _types(t)
    b = _Buckets(t)
    is_lms = np.zeros(len(t), bool)
    is_lms[1:] = small[1:] & ~small[:-1]
    is_lms[t == 0] = True
    lms = np.flatnonzero(is_lms)
    rough = _induce(t, small, b, lms)
    by_substring = rough[is_lms[rough]]
    nxt = np.full(len(t), len(t) - 1, np.int64)
    nxt[lms[:-1]] = lms[1:]
    ends = np.minimum(nxt[by_substring] + 1, len(t))
    p = prefix(t.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    h = spans(p, by_substring, ends)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[by_substring[1:]] == 0)
    names = np.empty(len(t), np.int64)
    names[by_substring] = np.cumsum(new)
    order = _order_of_names(names[lms])
    return _induce(t, small, b, lms[order])


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length, neighbour): common prefix of every suffix with the one before it in the array, in text order."""
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    ends = np.flatnonzero(t == 0)
    room = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    head = np.ones(n, bool)
    i = np.flatnonzero((phi[1:] > 0)) + 1
    head[i] = (t[i - 1] != t[phi[i] - 1]) | (t[i - 1] == 0)
    start = np.flatnonzero(head)
    length = np.zeros(n, np.int64)
    pairs = start[phi[start] >= 0]
    data = np.concatenate([np.maximum(t, 1).astype(np.int16) - 1, np.zeros(8, np.int16)]).astype(np.uint8)
    words = np.lib.stride_tricks.as_strided(data[: n + 1].view(np.uint8), (n + 1, 8), (1, 1))
    most = np.minimum(room[pairs], room[phi[pairs]])
    got, open_ = np.zeros(len(pairs), np.int64), np.flatnonzero(most > 0)
    while len(open_):
        a, c = pairs[open_] + got[open_], phi[pairs[open_]] + got[open_]
        x = np.ascontiguousarray(words[a]).view(np.uint64)[:, 0] ^ np.ascontiguousarray(words[c]).view(np.uint64)[:, 0]
        low = x & (~x + np.uint64(1))
        same = np.where(x == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
        got[open_] += same
        go_on = (same == 8) & (got[open_] < most[open_])
        open_ = open_[go_on]
    length[pairs] = np.minimum(got, most)
    lead = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    return np.maximum(length[lead] - (np.arange(n) - lead), 0), phi


def join_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, start of each text): bytes + 1, a 0 after each text."""
    starts = np.cumsum([0] + [len(x) + 1 for x in texts])
    t = np.zeros(int(starts[-1]), np.int16)
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    t[:] = data.astype(np.int16) + 1
    t[starts[1:] - 1] = 0
    return t, starts[:-1]
