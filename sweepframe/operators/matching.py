"""Greedy one-to-one matching inside a group (a frame and class), as a kernel over arrays.

Rows of equal footprints are one class: overlaps are computed between classes, each class keeps its rows in a queue, and a query takes the first row of the best
class that has any left. That gives what a search of all single pairs gives, and neither the pairs nor the copies of a footprint are ever rows of a shuffle.
Near classes are found by strips of places; a block of candidates has a bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd

#: Candidate pairs that are looked at together.
BLOCK = 1 << 16

Measure = Callable[[np.ndarray, np.ndarray], np.ndarray]


def classes(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's class of equal values, and each class's first row."""
    code = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        own, values = pd.factorize(c)
        code, _ = pd.factorize(code * (len(values) + 1) + own + 1)
    return code, np.unique(code, return_index=True)[1]


def candidate_blocks(a: np.ndarray, b: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of rows of a and b (centre, length, width) that may overlap by at least that intersection over union, each pair once.

    What two circles share is no wider than the smaller one and no longer than the sum of radii less their distance, which bounds the distance.
    """
    radius = [np.hypot(v[:, 2], v[:, 3]) / 2 for v in (a, b)]
    area = [v[:, 2] * v[:, 3] for v in (a, b)]
    sound = [np.isfinite(v[:, :4]).all(axis=1) & (v[:, 2] > 0) & (v[:, 3] > 0) for v in (a, b)]
    size = np.ceil(np.log2(np.where(sound[1], radius[1], 1.0)))
    for s in np.unique(size[sound[1]]):
        own = np.flatnonzero(sound[1] & (size == s))
        big = radius[1][own].max()
        ask = np.flatnonzero(sound[0])
        reach = radius[0][ask] + big - least * np.maximum(area[0][ask], area[1][own].min()) / (2 * np.minimum(radius[0][ask], big))
        ask, reach = ask[reach >= 0], reach[reach >= 0]
        if not len(ask):
            continue
        x0, y0, width = b[own, 0].min(), b[own, 1].min(), max(reach.max() / 4, 1e-9)
        strip = np.floor((b[own, 0] - x0) / width)
        span = b[own, 1].max() - y0 + 2 * reach.max() + 1
        place = strip * 2 * span + (b[own, 1] - y0)
        order = np.argsort(place, kind="stable")
        place, own = place[order], own[order]
        reach = reach * (1 + 1e-9) + 1e-9 + 1e-15 * np.abs(place).max()
        low = np.floor((a[ask, 0] - reach - x0) / width)
        high = np.floor((a[ask, 0] + reach - x0) / width)
        low, high = np.maximum(low, 0), np.minimum(high, strip.max())
        for k in range(int(max(0, (high - low).max() + 1))):
            at = low + k
            start, end = (np.searchsorted(place, at * 2 * span + np.clip(a[ask, 1] + sign * reach - y0, -span / 4, span * 1.25), side) for sign, side in ((-1, "left"), (1, "right")))
            n = np.where(at <= high, end - start, 0)
            total = np.cumsum(n)
            i = 0
            while i < len(n):
                j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + BLOCK, "right")))
                m = n[i:j]
                if m.sum():
                    offset = np.repeat(start[i:j] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                    yield np.repeat(ask[i:j], m), own[offset]
                i = j


def near_blocks(a: np.ndarray, b: np.ndarray, measure: Measure, least: float = 0.0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of a, row of b, overlap) of all pairs of overlap above 0 and at least `least`, a block of candidates at a time."""
    for i, j in candidate_blocks(a, b, least):
        keep = (np.abs(a[i, 0] - b[j, 0]) <= (np.hypot(a[i, 2], a[i, 3]) + np.hypot(b[j, 2], b[j, 3])) / 2) if a.shape[1] > 4 else slice(None)
        i, j = i[keep], j[keep]
        v = measure(a[i], b[j])
        keep = (v > 0) & (v >= least)
        yield i[keep], j[keep], v[keep]


def near_classes(a: np.ndarray, b: np.ndarray, measure: Measure, least: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """near_blocks together, by the row of a and falling overlap."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), *near_blocks(a, b, measure, least)]
    i, j, v = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((j, -v, i))
    return i[order], j[order], v[order]


def near_rows(a: np.ndarray, b: np.ndarray, measure: Measure) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of a, row of b, overlap) of all pairs of overlap above 0, in blocks of bounded size. Equal footprints are measured once."""
    kinds, own = classes(list(a.T))
    place, first = classes(list(b.T))
    members = [np.argsort(c, kind="stable") for c in (kinds, place)]
    size = [np.bincount(c, minlength=len(f)) for c, f in ((kinds, own), (place, first))]
    start = [np.cumsum(n) - n for n in size]
    for i, j, v in near_blocks(a[own], b[first], measure):
        n, wide = size[0][i] * size[1][j], size[1][j]
        ends = np.cumsum(n)
        for low in range(0, int(n.sum()), BLOCK):
            high = min(low + BLOCK, int(ends[-1]))
            p = np.arange(np.searchsorted(ends, low, "right"), np.searchsorted(ends, high - 1, "right") + 1)
            p = np.repeat(p, np.minimum(ends[p], high) - np.maximum(ends[p] - n[p], low))
            k = np.arange(low, high) - (ends - n)[p]
            yield members[0][start[0][i[p]] + k // wide[p]], members[1][start[1][j[p]] + k % wide[p]], v[p]


class Near:
    """Classes of queries and items of one group, with the overlaps of near ones; ranks order the items where overlaps are equal, the least first."""

    def __init__(self, queries: np.ndarray, items: np.ndarray, ranks: np.ndarray, measure: Measure, least: float = 0.0):
        """queries, items: rows of centre, length, width (and direction)."""
        self.kinds, own = classes(list(queries.T))
        place, first = classes(list(items.T))
        i, j, v = near_classes(queries[own], items[first], measure, least)
        self.first = np.searchsorted(i, np.arange(len(own) + 1)).tolist()
        self.places, self.overlaps = j.tolist(), v.tolist()
        self.queues: list[list[int]] = [[] for _ in first]
        order = np.argsort(-ranks, kind="stable")
        for p, r in zip(place[order].tolist(), ranks[order].tolist(), strict=True):
            self.queues[p].append(r)
        # An item that is there several times is taken everywhere at once.
        again = np.flatnonzero(np.isin(ranks, np.flatnonzero(np.bincount(ranks.astype(np.int64)) > 1))) if len(ranks) else []
        self.twins: dict[int, list[int]] = {}
        for k in again:
            self.twins.setdefault(int(ranks[k]), []).append(int(place[k]))

    def take(self, order: np.ndarray, least: float) -> tuple[list[int], list[float]]:
        """For queries in that order: the rank of the item that each takes, -1 without one of at least that overlap, and the overlap of its best free item, 0 without any."""
        at, ends, places, overlaps, twins = self.first[:-1], self.first[1:], self.places, self.overlaps, self.twins
        queues = [list(q) for q in self.queues]
        taken, best = [], []
        for k in self.kinds[order].tolist():
            p, end = at[k], ends[k]
            while p < end and not queues[places[p]]:
                p += 1
            at[k] = p
            if p == end:
                taken.append(-1)
                best.append(0.0)
                continue
            v, q = overlaps[p], queues[places[p]]
            p += 1
            while p < end and overlaps[p] == v:
                other = queues[places[p]]
                if other and other[-1] < q[-1]:
                    q = other
                p += 1
            best.append(v)
            if v < least:
                taken.append(-1)
                continue
            rank = q.pop()
            taken.append(rank)
            for twin in twins.get(rank, ()) if twins else ():
                queues[twin] = [r for r in queues[twin] if r != rank]
        return taken, best


def best_other(queries: np.ndarray, items: np.ndarray, kinds: np.ndarray, measure: Measure) -> tuple[np.ndarray, np.ndarray]:
    """The highest overlap of each query with any item, 0 without one, and the index of the item's kind (numbers in the order of their names), -1 without one."""
    code, own = classes(list(queries.T))
    place, first = classes([*items.T, kinds])
    i, j, v = near_classes(queries[own], items[first], measure)
    kind = kinds[first][j] if len(first) else j
    order = np.lexsort((kind, -v, i))
    i, v, kind = i[order], v[order], kind[order]
    top, at = np.unique(i, return_index=True)
    value, name = np.zeros(len(own)), np.full(len(own), -1)
    value[top], name[top] = v[at], kind[at]
    return value[code], name[code]
