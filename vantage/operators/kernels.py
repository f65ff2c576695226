"""Dominance kernels over numpy arrays, one row per point; they run inside Arrow batches."""

from __future__ import annotations

import numpy as np

#: Pairs that are compared at once; bounds a kernel's memory.
PAIRS = 1 << 21


def order(x: np.ndarray) -> np.ndarray:
    """An order in which every point comes after all points that dominate it: by sum, then by coordinate.

    Sums are clipped, so infinities don't make NaN; ties and rounding are settled by the coordinates."""
    total = np.clip(x, -1e300, 1e300).sum(axis=1)
    return np.lexsort([*x.T[::-1], total])


def dominated_by(x: np.ndarray, others: np.ndarray) -> np.ndarray:
    """For each row of x, whether some row of others dominates it."""
    out = np.zeros(len(x), bool)
    step = 256  # the first others are the strongest, few rows outlive them
    left = np.arange(len(x))
    for start in range(0, len(others), step):
        if not len(left):
            break
        o = others[start : start + step]
        hit = np.zeros(len(left), bool)
        rows = max(1, PAIRS // len(o))
        for a in range(0, len(left), rows):
            part = x[left[a : a + rows]]
            weak = np.ones((len(part), len(o)), bool)
            strong = np.zeros((len(part), len(o)), bool)
            for k in range(x.shape[1]):
                weak &= o[None, :, k] <= part[:, None, k]
                strong |= o[None, :, k] < part[:, None, k]
            hit[a : a + rows] = (weak & strong).any(axis=1)
        out[left[hit]] = True
        left = left[~hit]
    return out


def local_skyline(x: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
    """Ascending indices of the rows that no row of x or of known dominates (sort-filter skyline)."""
    by = order(x)
    if known is not None and len(known):
        by = by[~dominated_by(x[by], known)]
    window = np.empty((0, x.shape[1]))
    kept: list[np.ndarray] = []
    start, size = 0, 512
    while start < len(by):
        block = by[start : start + size]
        start += size
        size = min(2 * size, 16_384)
        block = block[~dominated_by(x[block], window)]
        while len(block):  # within a block: the first rows are surely kept, and clear the rest
            head, block = block[:128], block[128:]
            head = head[~dominated_by(x[head], x[head])]
            kept.append(head)
            window = np.concatenate([window, x[head]])
            block = block[~dominated_by(x[block], x[head])]
    return np.sort(np.concatenate(kept)) if kept else np.empty(0, np.int64)


def count_in_slab(c: np.ndarray, x: np.ndarray, cb: np.ndarray | None, xb: np.ndarray | None, first: int) -> np.ndarray:
    """For each row of c, the number of rows of x that it dominates, all of them in one bucket of dimension `first`;
    rows that share a bucket of an earlier dimension too aren't counted. cb, xb: the buckets, if first isn't 0."""
    out = np.zeros(len(c), np.int64)
    d = c.shape[1]
    by = np.argsort(-x[:, first], kind="stable")  # a candidate looks at the points that aren't smaller there
    x, xb = x[by], xb[by] if xb is not None else None
    reach = len(x) - np.searchsorted(np.sort(x[:, first]), c[:, first])
    order_ = np.argsort(reach, kind="stable")
    at = 0
    while at < len(order_):
        size = 16
        while at + 2 * size < len(order_) and 2 * size * reach[order_[at + 2 * size]] <= PAIRS:
            size *= 2
        rows = order_[at : at + size]
        seen = int(reach[rows[-1]])
        at += len(rows)
        for a in range(0, seen, PAIRS // 16):
            part = slice(a, min(seen, a + PAIRS // 16))
            weak = np.ones((len(rows), part.stop - part.start), bool)
            for k in range(d):
                if k < first:  # strictly greater buckets, so strictly greater values
                    weak &= xb[part, k][None, :] > cb[rows, k][:, None]
                else:
                    weak &= x[part, k][None, :] >= c[rows, k][:, None]
            if not first:
                equal = np.ones_like(weak)
                for k in range(d):
                    equal &= x[part, k][None, :] == c[rows, k][:, None]
                weak &= ~equal
            out[rows] += weak.sum(axis=1)
    return out


def count_dominated(c: np.ndarray, x: np.ndarray, cb: np.ndarray | None = None, xb: np.ndarray | None = None) -> np.ndarray:
    """For each row of c, the number of rows of x that it dominates. With the buckets cb and xb of the
    coordinates, only of rows that share a bucket with it in some dimension."""
    out = np.zeros(len(c), np.int64)
    d = c.shape[1]
    if not len(c) or not len(x):
        return out

    def add(ci: np.ndarray, xi: np.ndarray, first: int) -> None:
        rows = max(1, PAIRS // max(1, len(xi)))
        for a in range(0, len(ci), rows):
            part = ci[a : a + rows]
            weak = np.ones((len(part), len(xi)), bool)
            strong = np.full((len(part), len(xi)), first > 0)
            for k in range(d):
                if k < first:  # strictly greater buckets, so strictly greater values
                    weak &= xb[xi, k][None, :] > cb[part, k][:, None]
                else:
                    weak &= x[xi, k][None, :] >= c[part, k][:, None]
                    if first == 0:
                        strong |= x[xi, k][None, :] > c[part, k][:, None]
            out[part] += (weak & strong).sum(axis=1)

    def chunks(ci: np.ndarray, xi: np.ndarray, first: int) -> None:
        for b in range(0, len(xi), PAIRS):
            add(ci, xi[b : b + PAIRS], first)

    if cb is None:
        chunks(np.arange(len(c)), np.arange(len(x)), 0)
        return out
    for k in range(d):  # pairs whose first shared bucket is that of dimension k
        co, xo = np.argsort(cb[:, k], kind="stable"), np.argsort(xb[:, k], kind="stable")
        for bucket in np.unique(cb[:, k]):
            ci = co[np.searchsorted(cb[co, k], bucket) : np.searchsorted(cb[co, k], bucket, "right")]
            xi = xo[np.searchsorted(xb[xo, k], bucket) : np.searchsorted(xb[xo, k], bucket, "right")]
            if len(xi):
                chunks(ci, xi, k)
    return out
