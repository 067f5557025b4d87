"""Close points in the plane, found cell by cell."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def cell_candidates(block: np.ndarray, p: np.ndarray, q: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of distinct points of one block whose cells, reach + 1 wide, are the same or touch;
    every pair that is within reach in both coordinates is among them, once. Points of a block must be
    distinct, so a cell has at most (reach + 1)**2 of them and each turn gives at most one partner."""
    width = reach + 1
    x, y = p // width, q // width
    x, y = x - x.min(initial=0) + 1, y - y.min(initial=0) + 1
    rows, columns = np.int64(x.max(initial=0) + 2), np.int64(y.max(initial=0) + 2)
    if float(block.max(initial=0) + 1) * float(rows) * float(columns) >= 2.0**62:
        raise ValueError("the points of one task span too large an area")
    cell = (block * rows + x) * columns + y
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    at = np.arange(len(cell))
    for step in (0, 1, columns - 1, columns, columns + 1):
        lo = at + 1 if step == 0 else np.searchsorted(cell, cell + step, "left")
        hi = np.searchsorted(cell, cell + step, "right")
        while True:
            i = at[lo < hi]
            if not len(i):
                break
            yield order[i], order[lo[i]]
            lo = lo + 1


def within(dp: np.ndarray, dq: np.ndarray, reach: int, method: str) -> np.ndarray:
    """max: both differences at most reach; sum: their sum at most reach."""
    dp, dq = np.abs(dp), np.abs(dq)
    return np.maximum(dp, dq) <= reach if method == "max" else dp + dq <= reach


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (a, b) replaced by links of each number with the least one of its component."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def block_numbers(*keys: np.ndarray) -> np.ndarray:
    """A number from 0 for each distinct combination of keys."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), np.int64)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def greedy_leaders(p: np.ndarray, q: np.ndarray, reach: int, method: str) -> np.ndarray:
    """For points of one group in the order of p: the place of the leader that removes each point, its own
    place for a leader. A point that is still there removes all later points near it; those are among the
    next ones by p, so dense groups are gone through once."""
    out = np.full(len(p), -1, np.int64)
    ends = np.searchsorted(p, p + reach, "right")
    for i, end in enumerate(ends.tolist()):
        if out[i] >= 0:
            continue
        out[i] = i
        near = within(p[i + 1 : end] - p[i], q[i + 1 : end] - q[i], reach, method) & (out[i + 1 : end] < 0)
        out[i + 1 : end][near] = i
    return out
