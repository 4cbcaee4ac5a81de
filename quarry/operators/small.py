"""Delaunay graphs of many small sets of points at once, in numpy arrays over (set, simplex): a simplex belongs to the mesh if no
point lies inside of its sphere; in the plane over (set, pair), as circles through two points are named by one number. Values within
their rounding bound are decided again in whole numbers."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import comb, factorial

import numpy as np

from quarry.operators.delaunay import _determinant, _whole

#: Most simplices of a set; values that are held at once; roundings of a value, in units of its largest terms.
SIMPLICES, TABLE, ROUNDINGS = 1 << 15, 1 << 17, 64


def fits(k: int, d: int) -> bool:
    return comb(k, d + 1) <= SIMPLICES


@lru_cache(maxsize=64)
def _simplices(k: int, n: int) -> np.ndarray:
    return np.array(list(combinations(range(k), n)), np.int64).reshape(-1, n)


def _normals(rows: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Vectors normal to d rows of d + 1 numbers, from the minors of the last rows up."""
    d = len(rows)
    minors = {(t,): rows[-1][t] for t in range(d + 1)}
    for r in range(2, d + 1):
        own = rows[d - r]
        found = {}
        for columns in combinations(range(d + 1), r):
            total = own[columns[0]] * minors[columns[1:]]
            for i in range(1, r):
                term = own[columns[i]] * minors[columns[:i] + columns[i + 1 :]]
                total = total - term if i % 2 else total + term
            found[columns] = total
        minors = found
    return [m if (t + d) % 2 == 0 else -m for t, m in ((t, minors[tuple(c for c in range(d + 1) if c != t)]) for t in range(d + 1))]


def _empty(x: list[list[int]], corner: list[int]) -> bool:
    """Whether the simplex is none of a hyperplane and no point lies inside of its sphere."""
    base = x[corner[-1]]
    lift = lambda v: [*(a - b for a, b in zip(v, base)), sum((a - b) ** 2 for a, b in zip(v, base))]
    rows = [lift(x[v]) for v in corner[:-1]]
    way = _determinant([r[:-1] for r in rows])
    return way != 0 and all(_determinant([*rows, lift(p)]) * way >= 0 for i, p in enumerate(x) if i not in corner)


def _mesh(x: np.ndarray, corners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sets (set, point, axis) the simplices of their meshes: numbers of sets and of simplices."""
    d = x.shape[2]
    low, high = x.min(axis=1, keepdims=True), x.max(axis=1, keepdims=True)
    c = x - np.floor((low + high) / 2)
    q = (c * c).sum(axis=2)
    far, square = np.abs(c).max(axis=(1, 2)), q.max(axis=1)
    largest = factorial(d + 2) * (2 * far) ** d * 2 * square
    whole = (largest < 2.0**53) & (x == np.floor(x)).all(axis=(1, 2))  # nothing is rounded
    unit = np.where(whole, 0.0, ROUNDINGS * 2.0**-53)
    bound, flat = unit * largest, unit * factorial(d + 2) * (2 * far) ** d
    axes = [*(c[:, :, t] for t in range(d)), q]
    last = [v.take(corners[:, d], axis=1) for v in axes]
    normal = _normals([[v.take(corners[:, i], axis=1) - b for v, b in zip(axes, last)] for i in range(d)])
    sign = np.where(np.abs(normal[d]) <= flat[:, None], 0.0, np.sign(normal[d]))
    weights = np.empty((len(x), d + 2, len(corners)))
    for t in range(d + 1):
        np.multiply(normal[t], sign, out=weights[:, t])
    weights[:, d + 1] = -sum(weights[:, t] * last[t] for t in range(d + 1))
    value = np.stack([*axes, np.ones_like(q)], axis=2) @ weights
    g, s = np.nonzero((value.min(axis=1) >= -bound[:, None]) & ((sign != 0) | ~whole[:, None]))
    doubt = ((sign[g, s] == 0) | ((np.abs(value[g, :, s]) <= bound[g, None]).sum(axis=1) > d + 1)) & ~whole[g]
    keep = np.ones(len(g), bool)
    for i in np.flatnonzero(doubt).tolist():
        keep[i] = _empty(_whole(x[g[i]]), corners[s[i]].tolist())
    return g[keep], s[keep]


def _by_simplices(x: np.ndarray) -> np.ndarray:
    """Which pairs of points of sets (set, point, axis) are corners of a simplex of the mesh."""
    count, k, d = x.shape
    corners = _simplices(k, d + 1)
    linked = np.zeros((count, k, k), bool)
    if not len(corners):
        return linked
    step = max(1, TABLE // (len(corners) * k))
    for low in range(0, count, step):
        g, s = _mesh(x[low : low + step], corners)
        for i, h in combinations(range(d + 1), 2):
            linked[low + g, corners[s, i], corners[s, h]] = linked[low + g, corners[s, h], corners[s, i]] = True
    return linked


def _by_circles(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In the plane, pairs as ``_by_simplices`` has them, and whether a set is decided.

    A circle through two points is named by how far along their bisector its centre lies. Each point on one side of their line bounds
    that from above, each on the other side from below, so that no point lies inside; between bounds that meet there is an
    edge. Whole numbers aren't rounded but in the quotient, which keeps their order: only equal quotients leave a set open."""
    count, k, _ = x.shape
    c = x - np.floor((x.min(axis=1, keepdims=True) + x.max(axis=1, keepdims=True)) / 2)
    known = (16 * np.abs(c).max(axis=(1, 2)) ** 2 < 2.0**53) & (x == np.floor(x)).all(axis=(1, 2))
    j, h = _simplices(k, 2).T
    (a0, a1), (b0, b1) = ((c[:, v, 0], c[:, v, 1]) for v in (j, h))
    point = np.stack([c[:, :, 0], c[:, :, 1], (c * c).sum(axis=2), np.ones((count, k))], axis=2)
    side = point @ np.stack([a1 - b1, b0 - a0, np.zeros_like(a0), (b1 - a1) * a0 - (b0 - a0) * a1], axis=1)
    power = point @ np.stack([-a0 - b0, -a1 - b1, np.ones_like(a0), a0 * b0 + a1 * b1], axis=1)
    between = ((side == 0) & (power < 0)).any(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        bound = power / side
    above = np.where(side > 0, bound, np.inf).min(axis=1)
    below = np.where(side < 0, bound, -np.inf).max(axis=1)
    edge = (below < above) & ((above < np.inf) | (below > -np.inf)) & ~between
    known &= ~((below == above) & ~between).any(axis=1)
    linked = np.zeros((count, k, k), bool)
    linked[:, j, h] = linked[:, h, j] = edge
    return linked, known


def edges(x: np.ndarray) -> np.ndarray:
    """Sorted numbers (set * k + j) * k + h of the edges j, h of sets (set, point, axis) of k points."""
    count, k, d = x.shape
    if d != 2:
        return np.flatnonzero(_by_simplices(x))
    step, found = max(1, TABLE // max(1, comb(k, 2) * k)), []
    for low in range(0, count, step):
        some = x[low : low + step]
        linked, known = _by_circles(some)
        if not known.all():
            linked[~known] = _by_simplices(some[~known])
        found.append(np.flatnonzero(linked) + low * k * k)
    return np.concatenate(found) if found else np.zeros(0, np.int64)
