"""Neighbour graphs over centroids. Tasks make them from the centroids, in numpy."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations

import numpy as np

from quarry.operators.delaunay import Mesh

#: Beyond four dimensions a triangulation has nearly all edges.
MOST_AXES = 4
#: Centroids that are compared with all others at once.
ROWS = 1024


def centroid_distances(c: np.ndarray) -> np.ndarray:
    """All pairs, with infinity on the diagonal."""
    total = np.zeros((len(c), len(c)))
    for t in range(c.shape[1]):
        gap = c[:, t][:, None] - c[:, t][None, :]
        total += gap * gap
    out = np.sqrt(total)
    np.fill_diagonal(out, np.inf)
    return out


def half_separation(c: np.ndarray) -> np.ndarray:
    """Half the distance to the nearest other centroid; a table of few rows at a time, so many centroids need little memory."""
    out = np.full(len(c), np.inf)
    for low in range(0, len(c), ROWS):
        some = c[low : low + ROWS]
        total = np.zeros((len(some), len(c)))
        for t in range(c.shape[1]):
            gap = some[:, t][:, None] - c[:, t][None, :]
            total += gap * gap
        total[np.arange(len(some)), low + np.arange(len(some))] = np.inf
        out[low : low + ROWS] = 0.5 * np.sqrt(total.min(axis=1, initial=np.inf))
    return out


@dataclass
class Graph:
    """Edges in compressed rows: the neighbours of j are ``neighbours[offsets[j]:offsets[j + 1]]``. ``complete`` stands for all
    pairs, which have no rows."""

    offsets: np.ndarray
    neighbours: np.ndarray
    lengths: np.ndarray
    complete: bool = False

    @property
    def k(self) -> int:
        return len(self.offsets) - 1

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.k), np.diff(self.offsets))

    def keys(self) -> np.ndarray:
        """A number of each edge, sorted."""
        return np.sort(self.rows() * self.k + self.neighbours)

    def within(self, at: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """For rows ``at`` of edges sorted by length the first edge that is longer than ``limit``."""
        low, high = self.offsets[at].copy(), self.offsets[at + 1].copy()
        while (low < high).any():
            mid = (low + high) // 2
            short = (low < high) & (self.lengths[np.minimum(mid, max(0, len(self.lengths) - 1))] <= limit)
            low, high = np.where(short, mid + 1, low), np.where(short | (low >= high), high, mid)
        return low


def least(values: np.ndarray, count: np.ndarray, none: float) -> np.ndarray:
    """The least of each stretch of ``count`` values."""
    out = np.full(len(count), none)
    some = count > 0
    if some.any():
        out[some] = np.minimum.reduceat(values, (np.cumsum(count) - count)[some])
    return out


def from_pairs(k: int, j: np.ndarray, h: np.ndarray) -> Graph:
    """Pairs in any order and number, without loops."""
    keys = np.unique(j[j != h] * k + h[j != h])
    return Graph(np.searchsorted(keys, np.arange(k + 1) * k), keys % k, np.zeros(0))


def complete(k: int) -> Graph:
    """All pairs; none is written down."""
    return Graph(np.zeros(k + 1, np.int64), np.zeros(0, np.int64), np.zeros(0), complete=True)


def edges(g: Graph) -> tuple[np.ndarray, np.ndarray]:
    if g.complete:
        j, h = np.divmod(np.arange(g.k * g.k), max(1, g.k))
        return j[j != h], h[j != h]
    return g.rows(), g.neighbours


class Triangulation:
    """The Delaunay graph for two to four dimensions. Simplices side by side on one sphere give all edges among their
    corners, so whichever way ties are cut, the graph has that edge; equal centroids are neighbours of each other
    and of each other's neighbours. Where centroids lie in a hyperplane, or are too few, or have one or more than
    MOST_AXES dimensions, the complete graph stands in, which keeps every walk exact. Near ties count as ties, as walks compare rounded
    distances; not so with ``exact``."""

    def __init__(self, c: np.ndarray, exact: bool = False) -> None:
        k, d = c.shape
        self.exact = exact
        self.graph, self.fallback, self.mesh = complete(k), True, None
        places, self.place = np.unique(c, axis=0, return_inverse=True)
        self.place = self.place.ravel()
        if not 2 <= d <= MOST_AXES or len(places) <= d + 1:
            return
        mesh = Mesh(places)
        if mesh.flat:
            return
        self.mesh, self.fallback = mesh, False
        self._from_mesh(k)

    def _from_mesh(self, k: int) -> None:
        corners = self.mesh.vertices[self.mesh.solid()]
        j, h = (np.concatenate([corners[:, p[t]] for p in permutations(range(corners.shape[1]), 2)]) for t in (0, 1))
        more = [np.array(list(permutations(own.tolist(), 2))) for own in self.mesh.cliques(self.exact)]
        if more:
            j, h = np.r_[j, np.concatenate(more)[:, 0]], np.r_[h, np.concatenate(more)[:, 1]]
        n = len(self.mesh.x)
        if n == k:
            name = np.argsort(self.place)
            self.graph = from_pairs(k, name[j], name[h])
            return
        order = np.argsort(self.place, kind="stable")  # equal centroids are one place
        first = np.searchsorted(self.place[order], np.arange(n + 1))
        j, h = np.r_[j, np.arange(n)], np.r_[h, np.arange(n)]
        size = np.diff(first)
        pairs = size[j] * size[h]
        row = np.repeat(np.arange(len(j)), pairs)
        at = np.arange(len(row)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        self.graph = from_pairs(k, order[first[j[row]] + at // size[h[row]]], order[first[h[row]] + at % size[h[row]]])

    def repair(self, c: np.ndarray) -> bool:
        """Become the triangulation of moved centroids. True if the old mesh was mended, False if a new one was made."""
        if not self.fallback and len(self.mesh.x) == len(c):
            places = c[np.argsort(self.place)]
            if len(np.unique(places, axis=0)) == len(c) and self.mesh.moved(places):
                self._from_mesh(len(c))
                return True
        self.__init__(c, self.exact)
        return False

    def still_valid(self, c: np.ndarray) -> bool:
        """Whether the graph holds for moved centroids; in doubt it doesn't."""
        return not self.fallback and len(self.mesh.x) == len(c) and self.mesh.still_valid(c[np.argsort(self.place)])


def by_length(c: np.ndarray, g: Graph) -> tuple[Graph, np.ndarray]:
    """Neighbours of each centroid by edge length (then index), and half of the shortest edge."""
    if g.complete:
        return g, half_separation(c)
    rows = g.rows()
    total = np.zeros(len(rows))
    for t in range(c.shape[1]):
        gap = c[rows, t] - c[g.neighbours, t]
        total += gap * gap
    length = np.sqrt(total)
    order = np.lexsort((g.neighbours, length, rows))
    return Graph(g.offsets, g.neighbours[order], length[order]), 0.5 * least(length, np.diff(g.offsets), np.inf)


def near(c: np.ndarray, limit: np.ndarray, strictly: bool = False) -> Graph:
    """For each centroid the others within ``limit``, by distance (then index). Centroids are sorted along their longest axis, and a
    few rows at a time meet the stretch that they can reach, so there is no table of all pairs."""
    k = len(c)
    axis = int((c.max(axis=0) - c.min(axis=0)).argmax())
    order = np.argsort(c[:, axis], kind="stable")
    along = c[order, axis]
    found = []
    low = 0
    while low < k:
        high = min(k, low + 64)
        reach = limit[order[low:high]]
        left = int(np.searchsorted(along, (along[low:high] - reach).min(), "left")) if np.isfinite(reach).all() else 0
        right = int(np.searchsorted(along, (along[low:high] + reach).max(), "right")) if np.isfinite(reach).all() else k
        rows, others = order[low:high], order[max(0, left - 1) : right + 1]
        total = np.zeros((len(rows), len(others)))
        for t in range(c.shape[1]):
            gap = c[rows, t][:, None] - c[others, t][None, :]
            total += gap * gap
        length = np.sqrt(total)
        inside = (length < reach[:, None]) if strictly else (length <= reach[:, None])
        r, o = np.nonzero(inside & (rows[:, None] != others[None, :]))
        found.append((rows[r], others[o], length[r, o]))
        low = high
    j, h, length = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    by = np.lexsort((h, length, j))
    return Graph(np.searchsorted(j[by], np.arange(k + 1)), h[by], length[by])


def stable_clusters(before: Graph, after: Graph, drift: np.ndarray) -> np.ndarray:
    """Neither the centroid nor a neighbour moved, and the neighbours are the same."""
    still = drift == 0
    if before.complete or after.complete:
        return still & (still.all() and before.complete == after.complete)
    out = still.copy()
    rows = after.rows()
    out[rows[~still[after.neighbours]]] = False
    out[np.setxor1d(before.keys(), after.keys(), assume_unique=True) // after.k] = False
    return out


def local_drift(c: np.ndarray, before: Graph, after: Graph, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid the largest drift of a kept neighbour, and the shortest edge to a new one."""
    k = len(c)
    kept, new = np.zeros(k), np.full(k, np.inf)
    if after.complete:  # all others are neighbours; as new ones if they weren't
        first, second = int(drift.argmax()), np.delete(drift, int(drift.argmax())).max(initial=0.0)
        if before.complete:
            return np.where(np.arange(k) == first, second, drift[first]), new
        return np.full(k, drift.max()), 2 * half_separation(c)
    keys = after.keys()
    old = np.ones(len(keys), bool) if before.complete else np.isin(keys, before.keys(), assume_unique=True)
    j, h = np.divmod(keys, k)
    np.maximum.at(kept, j[old], drift[h[old]])
    total = np.zeros((~old).sum())
    for t in range(c.shape[1]):
        gap = c[j[~old], t] - c[h[~old], t]
        total += gap * gap
    np.minimum.at(new, j[~old], np.sqrt(total))
    return kept, new


def group_count(k: int) -> int:
    return max(1, k // 10)


def groups(c: np.ndarray, rounds: int = 5) -> np.ndarray:
    """A group of each centroid: a few Lloyd rounds on the centroids from evenly spread ones; a tenth as many."""
    count = group_count(len(c))
    seeds = c[np.linspace(0, len(c) - 1, count).astype(int)].copy()
    for _ in range(rounds + 1):
        own = np.concatenate([((c[low : low + 256, None, :] - seeds[None, :, :]) ** 2).sum(-1).argmin(axis=1) for low in range(0, len(c), 256)])
        for g in range(count):
            if (own == g).any():
                seeds[g] = c[own == g].mean(axis=0)
    return own


def annuli(distance: np.ndarray, nearest: np.ndarray, count: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """For each distance to another centroid the inner radius of its annulus: annulus t reaches from m * 2**(t-1) to
    m * 2**t, m being the distance to the nearest other centroid; annulus 0 is all up to m."""
    nearest = np.maximum(nearest, 1e-300)
    ratio = np.where(np.isfinite(distance), distance, nearest) / nearest
    t = np.clip(np.ceil(np.log2(np.maximum(ratio, 1.0))), 0, count - 1)
    t = np.where((t > 0) & (ratio <= 2.0 ** (t - 1)), t - 1, t)
    t = np.where((t < count - 1) & (ratio > 2.0**t), t + 1, t)
    return t.astype(np.int64), np.where(t == 0, 0.0, nearest * 2.0 ** (t - 1))
