"""Suffix arrays by induced sorting, for many strings at once, and their permuted common prefixes.

A string is a lane: one column of a matrix whose rows are positions. Every step of the induction
handles one position of all lanes, so the passes stay linear and run in whole-array operations.
"""

from __future__ import annotations

import numpy as np


def pack(lanes: list[np.ndarray]) -> np.ndarray:
    """Lanes of symbols from 0 up -> a matrix [length, lane] of int32 that ends in a unique 0.

    Shorter lanes get fillers before the end, falling from their number to 1, and their symbols are
    moved up above them; neither changes the order of a lane's own suffixes.
    """
    n = max(map(len, lanes)) + 1
    out = np.zeros((n, len(lanes)), np.int32)
    for b, lane in enumerate(lanes):
        pad = n - 1 - len(lane)
        out[: len(lane), b] = lane
        out[: len(lane), b] += pad + 1
        out[len(lane) : n - 1, b] = np.arange(pad, 0, -1)
    return out


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (S), False where larger (L); the end is S."""
    out = np.ones(t.shape, bool)
    less, same = t[:-1] < t[1:], t[:-1] == t[1:]
    for i in range(len(t) - 2, -1, -1):
        out[i] = less[i] | (same[i] & out[i + 1])
    return out


class _Buckets:
    def __init__(self, t: np.ndarray):
        self.b = t.shape[1]
        self.k = int(t.max()) + 1
        self.lane = np.arange(self.b)
        count = np.bincount((t * np.intp(self.b) + self.lane).ravel(), minlength=self.k * self.b).reshape(self.k, self.b)
        ends = np.cumsum(count, axis=0)
        self.heads, self.tails = (ends - count).ravel().astype(np.int32), (ends - 1).ravel().astype(np.int32)


def _place(sa: np.ndarray, t: np.ndarray, at: np.ndarray, lanes: np.ndarray, buckets: _Buckets) -> None:
    """Puts the suffixes `at` of `lanes`, given in order, at the ends of their buckets."""
    if not len(at):
        return
    cell = t[at, lanes].astype(np.int64) * buckets.b + lanes
    order = np.argsort(cell, kind="stable")
    sorted_cell = cell[order]
    last = np.append(sorted_cell[1:] != sorted_cell[:-1], True)
    stop = np.flatnonzero(last)
    after = stop[np.searchsorted(stop, np.arange(len(cell)))] - np.arange(len(cell))
    sa[buckets.tails[sorted_cell] - after, lanes[order]] = at[order]  # int32, as all positions


def _induce(sa: np.ndarray, v: np.ndarray, buckets: _Buckets) -> None:
    """From the placed suffixes, first the L suffixes forwards, then the S suffixes backwards. v: symbol * 2 + type."""
    n, b = sa.shape
    lane, flat_v, flat_sa = buckets.lane, v.ravel(), sa.ravel()
    for forward in (True, False):
        place = (buckets.heads if forward else buckets.tails).copy()
        step, kind = (1, 0) if forward else (-1, 1)
        for j in range(n) if forward else range(n - 1, -1, -1):
            row = sa[j]
            on = (row > 0).nonzero()[0]
            if not len(on):
                continue
            from_ = row.take(on) - np.int32(1)
            cell = from_ * np.intp(b) + lane.take(on)
            got = flat_v.take(cell)
            fits = ((got & 1) == kind).nonzero()[0]
            if not len(fits):
                continue
            own = on.take(fits)
            slot = (got.take(fits) >> 1) * np.intp(b) + own
            at = place.take(slot)
            flat_sa[at * np.intp(b) + own] = from_.take(fits)
            place[slot] = at + np.int32(step)


def suffix_arrays(t: np.ndarray) -> np.ndarray:
    """Suffix arrays [rank, lane] of the columns of t, each of which ends in its only 0."""
    n, b = t.shape
    if n == 1:
        return np.zeros((1, b), np.int64)
    s = _types(t)
    lms = np.zeros(t.shape, bool)
    lms[1:] = s[1:] & ~s[:-1]
    v = t * np.int32(2) + s
    if int(t.max()) < 1 << 14:
        v = v.astype(np.int16)
    buckets = _Buckets(t)

    # Sort the leftmost-smaller substrings: from any order of their starts, induction sorts them.
    at, lanes = np.nonzero(lms)
    sa = np.full((n, b), -1, np.int32)
    _place(sa, t, at, lanes, buckets)
    _induce(sa, v, buckets)

    # Name them in their order, lane by lane; equal substrings get one name.
    rank, who = np.nonzero(sa > 0)  # position 0 is never leftmost-smaller
    own = lms[sa[rank, who], who]
    rank, who = rank[own], who[own]
    order = np.argsort(who, kind="stable")
    who, start = who[order], sa[rank[order], who[order]]
    del sa, rank, own, order
    following = np.full((n + 1, b), n - 1, np.int32)
    for i in range(n - 1, -1, -1):
        following[i] = np.where(lms[i], i, following[i + 1])
    length = following[np.minimum(start + 1, n), who] - start + 1
    del following
    differ = np.ones(len(start), bool)
    open_ = np.flatnonzero((who[1:] == who[:-1]) & (length[1:] == length[:-1])) + 1
    differ[open_] = False
    d = 0
    while len(open_):
        x, y, lane = start[open_] + d, start[open_ - 1] + d, who[open_]
        unlike = v[x, lane] != v[y, lane]
        differ[open_[unlike]] = True
        open_ = open_[~unlike & (length[open_] > d + 1)]
        d += 1
    first = np.searchsorted(who, np.arange(b))
    total = np.cumsum(differ)
    name = total - total[first][who]
    many = np.diff(np.append(first, len(who)))
    names = np.zeros((b, n), np.int32)
    names[who, start] = name

    lane_at, text_at = np.nonzero(lms.T)  # in text order, lane by lane
    if np.array_equal(total[np.append(first[1:], len(who)) - 1] - total[first] + 1, many):
        order_lane, order_at = who, start  # all names differ: they are sorted already
    else:
        reduced = pack([x[:-1] - 1 for x in np.split(names[lane_at, text_at], first[1:])])
        below = suffix_arrays(reduced).T
        real = below < (many - 1)[:, None]
        order_lane, place = np.nonzero(real)
        order_at = text_at[first[order_lane] + below[order_lane, place]]
        # the end is the smallest of each lane
        order_lane = np.concatenate([np.arange(b), order_lane])
        order_at = np.concatenate([np.full(b, n - 1), order_at])
        order = np.argsort(order_lane, kind="stable")
        order_lane, order_at = order_lane[order], order_at[order]

    sa = np.full((n, b), -1, np.int32)
    _place(sa, t, order_at, order_lane, buckets)
    _induce(sa, v, buckets)
    return sa


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(plcp, phi), [position, lane]: the common prefix of each suffix with the one before it in order, and that one (-1: none).

    A prefix ends before a position where `stops` is true. Only irreducible values are compared symbol
    by symbol; each other one is its left neighbour's less one.
    """
    n, b = t.shape
    lane = np.arange(b)
    phi = np.full((n, b), -1, np.int32)
    phi[sa[1:], np.broadcast_to(lane, (n - 1, b))] = sa[:-1]
    plcp = np.zeros((n, b), np.int32)
    known = phi >= 0
    before = np.where(phi > 0, phi - 1, 0)
    fresh = known.copy()
    own = np.broadcast_to(lane, (n - 1, b))
    fresh[1:] &= (phi[1:] == 0) | stops[:-1] | stops[before[1:], own] | (t[:-1] != t[before[1:], own])
    x, who = np.nonzero(fresh)
    y = phi[x, who]
    length, open_ = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(open_):
        i, j, w = x[open_] + length[open_], y[open_] + length[open_], who[open_]
        ok = (i < n) & (j < n)
        i, j = np.minimum(i, n - 1), np.minimum(j, n - 1)
        ok &= (t[i, w] == t[j, w]) & ~stops[i, w] & ~stops[j, w]
        open_ = open_[ok]
        length[open_] += 1
    plcp[x, who] = length
    at = np.arange(n, dtype=np.int32)[:, None]
    base = np.maximum.accumulate(np.where(fresh, at, np.int32(-1)), axis=0)
    carried = plcp[np.maximum(base, 0), lane] - (at - base)
    plcp = np.where(known & ~fresh & (base >= 0), np.maximum(carried, 0), plcp)
    return plcp, phi
