"""Exact neighbors in memory: references in the order of a k-d tree, in boxes of boxes.

Leaves hold LEAF references, groups FAN leaves; both know the least and the largest value of each
dimension. A box whose nearest point is farther than a query's k-th neighbor so far is left out.
That bound is added up like the distance itself, dimension after dimension, and rounding is monotone,
so it never exceeds the distance of a reference inside, to the bit; boxes at the same distance are
searched, so ties go to the smaller ref_id.
"""

from __future__ import annotations

import numpy as np

LEAF, FAN = 64, 32
_QUERIES, _PAIRS = 512, 2_048


def ordered(x: np.ndarray, leaf: int = LEAF, fan: int = FAN) -> np.ndarray:
    """The order of a k-d tree: cut at the median of the dimension that spreads most, at whole groups first, then at whole leaves."""
    idx, todo = np.arange(len(x)), [(0, len(x))]
    while todo:
        a, b = todo.pop()
        if b - a <= leaf:
            continue
        unit = leaf * fan if b - a > leaf * fan else leaf
        mid = unit * max(1, round((b - a) / 2 / unit))
        own = idx[a:b]
        sub = x[own]
        idx[a:b] = own[np.argpartition(sub[:, sub.std(axis=0).argmax()], mid)]
        todo += [(a, a + mid), (a + mid, b)]
    return idx


def outside(metric: str, y: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least distance of y (n x dims) from boxes (dims x n x boxes, or dims x 1 x boxes)."""
    out = np.zeros((len(y), lo.shape[-1]))
    for i in range(len(lo)):
        v = y[:, i, None]
        d = np.maximum(np.maximum(lo[i] - v, v - hi[i]), 0.0)
        out += d * d if metric == "l2" else d
    return out


class Boxes:
    """References (finite vectors x, ref_id) to search. Arrays only, so it can be broadcast."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, metric: str = "l2"):
        if metric not in ("l2", "l1"):
            raise ValueError("boxes are for l2 and l1")
        n, dims = x.shape
        self.metric, self.n = metric, n
        order = ordered(x)
        groups = max(1, -(-n // (LEAF * FAN)))
        full = groups * FAN * LEAF
        # Padding is infinitely far away from everything, in the boxes too.
        points = np.full((dims, full), np.inf)
        for i in range(dims):
            points[i, :n] = x[order, i]
        self.points = points.reshape(dims, groups * FAN, LEAF)
        self.place = np.full(full, -1, np.int64)
        self.place[:n] = order
        self.ids = np.full(full, np.iinfo(np.int64).max)
        self.ids[:n] = ids[order]
        self.lo = self.points.min(axis=2)
        self.hi = np.where(np.isinf(self.points), -np.inf, self.points).max(axis=2)
        self.group_lo = self.lo.reshape(dims, groups, FAN).min(axis=2)
        self.group_hi = self.hi.reshape(dims, groups, FAN).max(axis=2)
        self.lo, self.hi = self.lo.reshape(dims, groups, FAN), self.hi.reshape(dims, groups, FAN)

    def search(self, y: np.ndarray, k: int, own: np.ndarray | None = None, most: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of y, row of x, distance) of the k nearest, ties to the smaller ref_id, in the order of y. own: ref_ids
        that aren't a query's neighbors; most: distances beyond which no neighbor is asked for."""
        found = ([], [], [])
        asked = np.flatnonzero(np.isfinite(y).all(axis=1))
        if self.n and len(asked):
            asked = asked[ordered(y[asked])]
            for at in range(0, len(asked), _QUERIES):
                rows = asked[at : at + _QUERIES]
                r, c, d = self._some(y[rows], k, None if own is None else own[rows], np.full(len(rows), np.inf) if most is None else most[rows].astype(float))
                for a, v in zip(found, (rows[r], c, d), strict=True):
                    a.append(v)
        row, col, d = (np.concatenate(v) if v else np.zeros(0, t) for v, t in zip(found, (np.int64, np.int64, float), strict=True))
        order = np.argsort(row, kind="stable")
        return row[order], col[order], d[order]

    def _some(self, y, k, own, kth):
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        far = outside(self.metric, y, self.group_lo[:, None], self.group_hi[:, None])
        # The nearest group's two nearest leaves give each query a first bound.
        row, group = np.arange(len(y)), far.argmin(axis=1)
        near = outside(self.metric, y, self.lo[:, group], self.hi[:, group])
        first = np.argsort(near, axis=1, kind="stable")[:, :2]
        tried = group[:, None] * FAN + first
        best, kth = self._leaves(y, k, own, kth, best, np.repeat(row, 2), tried.ravel())
        row, group = np.nonzero(far <= kth[:, None])
        rows, leaves, bounds = [], [], []
        for at in range(0, len(row), 8 * _PAIRS):
            r, g = row[at : at + 8 * _PAIRS], group[at : at + 8 * _PAIRS]
            d = outside(self.metric, y[r], self.lo[:, g], self.hi[:, g])
            i, j = np.nonzero((d <= kth[r][:, None]) & (d < np.inf))
            leaf = g[i] * FAN + j
            new = (leaf != tried[r[i], 0]) & (leaf != tried[r[i], 1])
            rows.append(r[i][new])
            leaves.append(leaf[new])
            bounds.append(d[i, j][new])
        if rows:
            row, leaf, bound = np.concatenate(rows), np.concatenate(leaves), np.concatenate(bounds)
            order = np.argsort(bound, kind="stable")
            row, leaf, bound = row[order], leaf[order], bound[order]
            while len(row):
                best, kth = self._leaves(y, k, own, kth, best, row[:_PAIRS], leaf[:_PAIRS])
                keep = bound[_PAIRS:] <= kth[row[_PAIRS:]]
                row, leaf, bound = row[_PAIRS:][keep], leaf[_PAIRS:][keep], bound[_PAIRS:][keep]
        row, col, d = best
        return row, self.place[col], d

    def _leaves(self, y, k, own, kth, best, row, leaf):
        """best (row, place, distance) and kth after these pairs of a query and a leaf."""
        out = np.zeros((len(row), LEAF))
        for i in range(len(self.points)):
            d = y[row, i][:, None] - self.points[i][leaf]
            out += d * d if self.metric == "l2" else np.abs(d)
        pair, slot = np.nonzero((out <= kth[row][:, None]) & (out < np.inf))
        r, c, d = row[pair], leaf[pair] * LEAF + slot, out[pair, slot]
        if own is not None:
            other = self.ids[c] != own[r]
            r, c, d = r[other], c[other], d[other]
        if not len(r):
            return best, kth
        r, c, d = np.concatenate((best[0], r)), np.concatenate((best[1], c)), np.concatenate((best[2], d))
        order = np.lexsort((self.ids[c], d, r))
        r, c, d = r[order], c[order], d[order]
        start = np.concatenate(([0], np.cumsum(np.bincount(r, minlength=len(y)))))
        nth = np.arange(len(r)) - start[r]
        keep = nth < k
        kth = kth.copy()
        kth[r[nth == k - 1]] = d[nth == k - 1]
        return (r[keep], c[keep], d[keep]), kth
