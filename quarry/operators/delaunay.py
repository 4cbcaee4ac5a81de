"""Delaunay triangulation of few points in two to four dimensions, by insertion.

Outside of the hull stand ghost simplices (a facet of the hull and vertex -1), so the mesh has no border.
Each simplex has one function of a point: above zero inside of its sphere (for a ghost: outside of its
facet). A new point removes all simplices whose function is above zero and joins the rim of the hole. The hole is found from
the simplices around the nearest point, so an insertion looks at few of them. A value within its rounding bound is decided
again in whole numbers, so the mesh is that of exact arithmetic, also for lattices and points on a sphere.

A point is taken out by triangulating the corners around it alone, and filling the hole with those simplices that lie
within its rim. So a mesh of points that move is mended where they make it fail (``moved``).
"""

from __future__ import annotations

import numpy as np

#: Rounding bound of a function, in products of row lengths; values up to so many bounds count as on the sphere.
ROUNDING, ON_SPHERE = 1e-13, 1e4


def _cross(rows: np.ndarray) -> np.ndarray:
    """Vectors normal to n - 1 rows of n numbers: signed minors."""
    n = rows.shape[-1]
    columns = [_minor(rows, [t for t in range(n) if t != j]) for j in range(n)]
    return np.stack([c if (j + n) % 2 else -c for j, c in enumerate(columns)], axis=-1)


def _minor(rows: np.ndarray, of: list[int], row: int = 0) -> np.ndarray:
    """The determinant of the columns ``of`` from ``row`` on, by its first row."""
    if not of:
        return np.ones(rows.shape[:-2])
    total = 0.0
    for i, t in enumerate(of):
        term = rows[..., row, t] * _minor(rows, of[:i] + of[i + 1 :], row + 1) if len(of) > 1 else rows[..., row, t]
        total = total - term if i % 2 else total + term
    return total


def _determinant(m: list[list[int]]) -> int:
    """Of whole numbers, without fractions."""
    m, sign, last = [row[:] for row in m], 1, 1
    for i in range(len(m) - 1):
        pivot = next((r for r in range(i, len(m)) if m[r][i]), None)
        if pivot is None:
            return 0
        if pivot != i:
            m[i], m[pivot], sign = m[pivot], m[i], -sign
        for r in range(i + 1, len(m)):
            for c in range(i + 1, len(m)):
                m[r][c] = (m[r][c] * m[i][i] - m[r][i] * m[i][c]) // last
        last = m[i][i]
    return sign * m[-1][-1]


def _whole(x: np.ndarray) -> list[list[int]]:
    """The same points as whole numbers, exactly, all times one factor (a multiple of d + 1)."""
    ratios = [[v.as_integer_ratio() for v in row] for row in x.tolist()]
    factor = max(den for row in ratios for _, den in row) * (x.shape[1] + 1)  # denominators are powers of two
    return [[num * (factor // den) for num, den in row] for row in ratios]


def functionals(x: np.ndarray, vertices: np.ndarray, ghost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each simplex the weights of (1, coordinates, square), without a sign, and the rounding bound.

    A ghost's -1 stands anywhere among its vertices; its facet has the others.
    """
    d = x.shape[1]
    out, bound = np.zeros((len(vertices), d + 2)), np.zeros(len(vertices))
    for kind in (False, True):
        own = np.flatnonzero(ghost == kind)
        if not len(own):
            continue
        corner = vertices[own]
        if kind:
            corner = corner[corner >= 0].reshape(len(own), d)
        base, rest = x[corner[:, -1]], x[corner[:, :-1]]
        rows = rest - base[:, None, :]
        if not kind:
            rows = np.concatenate([rows, (rows * (rest + base[:, None, :])).sum(-1, keepdims=True)], axis=-1)
        normal = _cross(rows)
        length = np.sqrt((rows**2).sum(-1)) + 1e-300
        bound[own] = ROUNDING * length.prod(axis=1) * (1 + (1 / length).sum(axis=1))
        out[own, 1 : 1 + d] = normal[:, :d]
        square = 0.0
        if not kind:
            out[own, -1] = normal[:, d]
            square = normal[:, d] * (base**2).sum(-1)
        out[own, 0] = -((normal[:, :d] * base).sum(-1) + square)
    return out, bound


def lifted(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(x), 1)), x, (x**2).sum(-1, keepdims=True)], axis=1)


class Mesh:
    """``simplices`` with their ``neighbours`` (opposite of each vertex; ghosts too), or ``flat`` if the
    points lie in a hyperplane. Points must differ."""

    def __init__(self, points: np.ndarray) -> None:
        self.d = points.shape[1]
        self.x = unit(points)
        self.exact = _whole(points)
        start = self._first_simplex()
        self.flat = start is None
        if self.flat:
            return
        self._build(start)

    def _build(self, start: list[int]) -> None:
        self.lift, size = lifted(self.x), 256
        self.vertices, self.neighbours = np.full((size, self.d + 1), -2, np.int64), np.zeros((size, self.d + 1), np.int64)
        self.f, self.bound, self.ghost, self.alive = np.zeros((size, self.d + 2)), np.zeros(size), np.zeros(size, bool), np.zeros(size, bool)
        self.inside, self.free, self.end = np.zeros(size, bool), [], 0
        self.member, self.known = np.full(len(self.x), -1, np.int64), 0
        self.among, self.where = np.zeros((len(self.x), self.d)), np.zeros(len(self.x), np.int64)
        self._begin(start)
        for p in self._order(start):
            self._insert(p)

    def _order(self, start: list[int]) -> list[int]:
        """Random points, each round twice as many as before; within a round along a Z-curve, so that near ones follow each other."""
        shuffled = [p for p in np.random.default_rng(0).permutation(len(self.x)).tolist() if p not in start]
        cell = (self.x * 1023.0).astype(np.int64)
        key = np.zeros(len(self.x), np.int64)
        for b in range(10):
            for t in range(self.d):
                key |= (cell[:, t] >> b & 1) << self.d * b + t
        out, low = [], 0
        while low < len(shuffled):
            some = np.array(shuffled[low : max(64, 2 * low)])
            out += some[np.argsort(key[some], kind="stable")].tolist()
            low += len(some)
        return out

    def _first_simplex(self) -> list[int] | None:
        chosen = [0]
        left = self.x - self.x[0]
        while len(chosen) <= self.d:
            far = (left**2).sum(-1)
            for p in np.argsort(-far)[:8].tolist():  # the farthest from the span so far; exactly outside of it
                if self._independent([*chosen, p]):
                    break
            else:
                p = next((q for q in range(len(self.x)) if self._independent([*chosen, q])), None)
                if p is None:
                    return None
            chosen.append(p)
            direction = left[p] / max(np.sqrt(far[p]), 1e-300)
            left = left - (left @ direction)[:, None] * direction[None, :]
        return chosen

    def _independent(self, corner: list[int]) -> bool:
        rows = [[a - b for a, b in zip(self.exact[v], self.exact[corner[0]])] for v in corner[1:]]
        gram = [[sum(a * b for a, b in zip(r, s)) for s in rows] for r in rows]
        return _determinant(gram) != 0

    def _begin(self, start: list[int]) -> None:
        n = self.d + 1
        self.end = n + 1
        for v in start:
            self._knows(v)
        self.vertices[0] = start
        self.neighbours[0] = np.arange(1, n + 1)
        for i in range(n):  # ghost 1 + i is opposite of vertex i
            self.vertices[1 + i] = [-1 if j == i else start[j] for j in range(n)]
            self.neighbours[1 + i] = [0 if j == i else 1 + j for j in range(n)]
        self._finish(np.arange(n + 1))

    def _knows(self, v: int) -> None:
        self.among[self.known], self.where[self.known] = self.x[v], v
        self.known += 1

    def _forgets(self, v: int) -> None:
        at = int(np.flatnonzero(self.where[: self.known] == v)[0])
        self.known -= 1
        self.among[at], self.where[at] = self.among[self.known], self.where[self.known]

    def _finish(self, slots: np.ndarray) -> None:
        """Functions of new simplices, signed."""
        self.ghost[slots] = (self.vertices[slots] == -1).any(axis=1)
        self.alive[slots] = True
        corners = self.vertices[slots]
        self.member[corners[corners >= 0]] = np.broadcast_to(slots[:, None], corners.shape)[corners >= 0]
        f, bound = functionals(self.x, self.vertices[slots], self.ghost[slots])
        value, ghosts = f[:, -1].copy(), np.flatnonzero(self.ghost[slots])
        value[ghosts] = (f[ghosts] * self.lift[self._apex(slots[ghosts])]).sum(-1)
        sign = np.sign(value)
        for i in np.flatnonzero(np.abs(value) <= bound):
            sign[i] = self._exact_sign(int(slots[i]), None)
        self.f[slots], self.bound[slots] = f * -sign[:, None], bound

    def _apex(self, ghosts: np.ndarray) -> np.ndarray:
        """The corner across from a ghost's facet, which lies within the hull."""
        corners = self.vertices[ghosts]
        behind = self.vertices[self.neighbours[ghosts][corners == -1]]
        return behind[~(behind[:, :, None] == corners[:, None, :]).any(axis=2)]

    def _exact_value(self, vertices: np.ndarray, p: list[int]) -> int:
        """The unsigned function at a point, up to a positive factor."""
        ghost = (vertices == -1).any()
        corner = [self.exact[v] for v in vertices.tolist() if v >= 0]
        base = corner[-1]
        rows = [[a - b for a, b in zip(v, base)] for v in [*corner[:-1], p]]
        if not ghost:
            for row, v in zip(rows, [*corner[:-1], p]):
                row.append(sum(r * (a + b) for r, a, b in zip(row, v, base)))
        return _determinant(rows)

    def _exact_sign(self, slot: int, p: int | None) -> int:
        """The signed function at point p; without p the sign that ``_finish`` asks for."""
        vertices = self.vertices[slot]
        if self.ghost[slot]:
            reference = self._exact_value(vertices, self.exact[int(self._apex(np.array([slot]))[0])])
        else:
            corner = [self.exact[v] for v in vertices.tolist()]
            reference = _determinant([[a - b for a, b in zip(v, corner[-1])] for v in corner[:-1]])
        if p is None:
            return (reference > 0) - (reference < 0)
        value = self._exact_value(vertices, self.exact[p])
        return ((value > 0) - (value < 0)) * (-1 if reference > 0 else 1)

    def signs(self, slots: np.ndarray, p: np.ndarray | int) -> np.ndarray:
        """Signs of the functions of ``slots`` at a point (or one point each)."""
        value = (self.f[slots] * self.lift[p]).sum(-1) if np.ndim(p) else self.f[slots] @ self.lift[p]
        out = np.sign(value)
        for i in np.flatnonzero(np.abs(value) <= self.bound[slots]):
            out[i] = self._exact_sign(int(slots[i]), int(p[i]) if np.ndim(p) else p)
        return out

    def star(self, v: int) -> np.ndarray:
        """The simplices around a point."""
        seen, front = {int(self.member[v])}, [int(self.member[v])]
        while front:
            around = self.neighbours[front]
            around = around[(self.vertices[front] != v)]  # across facets that hold v
            front = [s for s in set(around.tolist()) if s not in seen]
            seen.update(front)
        return np.array(sorted(seen))

    SCANNED = 4096

    def _hole(self, p: int) -> np.ndarray:
        """All simplices that a new point removes: they hang together, and some are around the nearest point. Few simplices are
        looked at all together, which takes fewer steps."""
        if self.end <= self.SCANNED:
            slots = np.flatnonzero(self.alive[: self.end])
            sign = self.signs(slots, p)
            self.inside[slots[sign > 0]] = True
            for g in slots[(sign == 0) & self.ghost[slots]]:
                self.inside[g] = self.inside[self.neighbours[g][self.vertices[g] == -1][0]]
            return np.flatnonzero(self.inside[: self.end])
        gap = self.among[: self.known] - self.x[p]
        nearest = int(self.where[(gap * gap).sum(axis=1).argmin()])
        slots = self.star(nearest)
        found = slots[self.signs(slots, p) > 0]
        if not len(found):  # only where points tie
            slots = np.flatnonzero(self.alive)
            found = slots[self.signs(slots, p) > 0]
        self.inside[found] = True
        out, seen, front = found.tolist(), set(found.tolist()), found
        while len(front):
            around = np.array([s for s in set(self.neighbours[front].ravel().tolist()) if s not in seen], np.int64)
            if not len(around):
                break
            sign = self.signs(around, p)
            flat = around[(sign == 0) & self.ghost[around]]  # in the facet's plane: as the solid simplex behind it
            behind = self.neighbours[flat][self.vertices[flat] == -1] if len(flat) else flat
            front = np.r_[around[sign > 0], flat[self.inside[behind]]]
            seen.update(around[(sign <= 0) & ~((sign == 0) & self.ghost[around])].tolist())
            seen.update(front.tolist())
            self.inside[front] = True
            out += front.tolist()
        return np.array(out, np.int64)

    def _slots(self, n: int, emptied: np.ndarray) -> np.ndarray:
        """``n`` free slots, those just emptied first."""
        self.free += emptied.tolist()
        while len(self.free) < n:
            if self.end == len(self.alive):
                self._grow()
            take = min(n - len(self.free), len(self.alive) - self.end)
            self.free += range(self.end, self.end + take)
            self.end += take
        taken, self.free = self.free[len(self.free) - n :], self.free[: len(self.free) - n]
        return np.array(taken, np.int64)

    def _insert(self, p: int) -> None:
        hole = self._hole(p)
        row, at = np.nonzero(~self.inside[self.neighbours[hole]])
        self.inside[hole] = False
        old, beyond = hole[row], self.neighbours[hole[row], at]
        vertices = self.vertices[old]
        vertices[np.arange(len(row)), at] = p
        back = (self.neighbours[beyond] == old[:, None]) & self._opposite(beyond, vertices, p)
        self.alive[hole] = False
        slots = self._slots(len(row), hole)
        neighbours = np.full((len(row), self.d + 1), -1, np.int64)
        neighbours[np.arange(len(row)), at] = beyond
        i, j = np.nonzero(np.arange(self.d + 1)[None, :] != at[:, None])
        rest = np.where((np.arange(self.d + 1)[None, :] == j[:, None]) | (np.arange(self.d + 1)[None, :] == at[i][:, None]), -2, vertices[i])
        rest = np.sort(rest, axis=1)[:, 2:] + 1
        key = np.zeros(len(rest), np.int64)
        for t in range(rest.shape[1]):
            key = key * (len(self.x) + 2) + rest[:, t]
        order = np.argsort(key, kind="stable")
        one, other = order[0::2], order[1::2]
        neighbours[i[one], j[one]] = slots[i[other]]
        neighbours[i[other], j[other]] = slots[i[one]]
        r, place = np.nonzero(back)
        self.neighbours[beyond[r], place] = slots[r]
        self.vertices[slots], self.neighbours[slots] = vertices, neighbours
        self._knows(p)
        self._finish(slots)

    def _remove(self, v: int) -> bool:
        """Take a point out; False if the corners around it leave open how, and the mesh is as before."""
        star = self.star(v)
        corners = np.unique(self.vertices[star])
        corners = corners[(corners >= 0) & (corners != v)]
        if len(corners) < self.d + 1:
            return False
        small = Mesh.__new__(Mesh)
        small._of([self.exact[c] for c in corners.tolist()], self.x[corners])
        if small.flat:
            return False
        names = np.r_[corners, -1]  # the last is the ghosts' vertex
        # the rim: facets across from v, with what lies beyond
        rim = {}
        for s in star.tolist():
            own = self.vertices[s].tolist()
            rim[frozenset(own) - {v}] = (s, int(self.neighbours[s][own.index(v)]))
        slots = np.flatnonzero(small.alive)
        named = names[small.vertices]
        facets: dict[frozenset, list[tuple[int, int]]] = {}
        for s in slots.tolist():
            own = named[s].tolist()
            for i in range(self.d + 1):
                facets.setdefault(frozenset(own[:i] + own[i + 1 :]), []).append((s, i))
        if any(f not in facets for f in rim):
            return False
        chosen = self._fill(v, rim, facets, small, named)
        if not chosen:
            return False
        self.alive[star] = False
        new = dict(zip(chosen, self._slots(len(chosen), star).tolist()))
        for s in chosen:
            slot = new[s]
            self.vertices[slot] = named[s]
            for i in range(self.d + 1):
                f = frozenset(named[s].tolist()) - {int(named[s][i])}
                if f in rim:
                    old, beyond = rim[f]
                    self.neighbours[slot, i] = beyond
                    theirs = self.vertices[beyond].tolist()
                    self.neighbours[beyond, next(t for t, c in enumerate(theirs) if c not in f)] = slot
                else:
                    self.neighbours[slot, i] = new[int(small.neighbours[s, i])]
        self._finish(np.array([new[s] for s in chosen]))
        self._forgets(v)
        self.member[v] = -1
        return True

    def _fill(self, v: int, rim: dict, facets: dict, small: Mesh, named: np.ndarray) -> list[int] | None:
        """Simplices of the small mesh within the rim: of a rim facet's two, the one on v's side; then all that they reach without crossing the rim."""
        chosen: set[int] = set()
        todo = []
        for f in rim:
            if -1 in f:  # a ridge of the hull and infinity: reached from the others
                continue
            real = [(s, int(named[s][i])) for s, i in facets[f] if named[s][i] >= 0]
            same = [s for s, corner in real if self._same_side(f, v, corner)]
            if len(same) > 1:
                return None
            todo += same or [s for s, i in facets[f] if named[s][i] < 0][:1]
        while todo:
            s = todo.pop()
            if s in chosen:
                continue
            chosen.add(s)
            for i in range(self.d + 1):
                f = frozenset(named[s].tolist()) - {int(named[s][i])}
                if f not in rim:
                    todo.append(int(small.neighbours[s, i]))
        # every rim facet bounds one chosen simplex, every other facet two
        for f, pair in facets.items():
            own = sum(s in chosen for s, _ in pair)
            if own != (1 if f in rim else 2 * (own > 0)):
                return None
        return sorted(chosen)

    def _same_side(self, facet: frozenset, v: int, other: int) -> bool:
        """Whether two points lie on one side of a facet of d points."""
        corner = [self.exact[c] for c in sorted(facet)]
        side = lambda p: _determinant([[a - b for a, b in zip(q, corner[0])] for q in [*corner[1:], self.exact[p]]])
        mine, theirs = side(v), side(other)
        return mine != 0 and (mine > 0) == (theirs > 0)

    def _of(self, exact: list[list[int]], x: np.ndarray) -> None:
        """A mesh of some points of another, with its coordinates."""
        self.d, self.x, self.exact = x.shape[1], x, exact
        start = self._first_simplex()
        self.flat = start is None
        if self.flat:
            return
        self._build(start)

    def _opposite(self, beyond: np.ndarray, vertices: np.ndarray, p: int) -> np.ndarray:
        """Vertices of the simplices beyond that are not in the facet they share."""
        theirs = self.vertices[beyond]
        return ~(theirs[:, :, None] == np.where(vertices == p, -3, vertices)[:, None, :]).any(axis=2)

    def _grow(self) -> None:
        for name in ("vertices", "neighbours", "f", "bound", "ghost", "alive", "inside"):
            own = getattr(self, name)
            setattr(self, name, np.concatenate([own, np.zeros_like(own)]))

    def solid(self) -> np.ndarray:
        return np.flatnonzero(self.alive & ~self.ghost)

    def cliques(self, exact: bool = False) -> list[np.ndarray]:
        """Corners of several simplices side by side on one sphere: up to rounding, or exactly."""
        slots = self.solid()
        one, at = np.nonzero(~self.ghost[self.neighbours[slots]])
        a, b = slots[one], self.neighbours[slots[one], at]
        far = self.vertices[b][~(self.vertices[b][:, :, None] == self.vertices[a][:, None, :]).any(axis=2)]
        on = np.abs((self.f[a] * self.lift[far]).sum(-1)) <= ON_SPHERE * self.bound[a]
        if exact:
            on[on] = [self._exact_sign(s, p) == 0 for s, p in zip(a[on].tolist(), far[on].tolist())]
        a, b = a[on], b[on]
        root = np.arange(len(self.alive))
        while True:
            low = root.copy()
            np.minimum.at(low, a, root[b])
            np.minimum.at(low, b, root[a])
            low = low[low]
            if (low == root).all():
                break
            root = low
        groups: dict[int, set[int]] = {}
        for s in np.unique(np.r_[a, b]).tolist():
            groups.setdefault(int(root[s]), set()).update(self.vertices[s].tolist())
        return [np.array(sorted(g)) for g in groups.values()]

    def _doubts(self, x: np.ndarray) -> np.ndarray:
        """Corners (rows; -1 where there are fewer) of the places where the same simplices are not surely the triangulation of
        points that have moved to ``x``: an orientation, the sphere of one of two simplices side by side, or a ridge of the hull."""
        lift = lifted(x)
        slots = np.flatnonzero(self.alive)
        number = np.zeros(len(self.alive), np.int64)
        number[slots] = np.arange(len(slots))
        vertices, ghost = self.vertices[slots], self.ghost[slots]
        f, bound = functionals(x, vertices, ghost)
        before, _ = functionals(self.x, vertices, ghost)
        apex = self._apex(slots[ghost])
        value, old = f[:, -1].copy(), before[:, -1].copy()
        value[ghost], old[ghost] = (f[ghost] * lift[apex]).sum(-1), (before[ghost] * self.lift[apex]).sum(-1)
        turned = (np.abs(value) <= bound) | (np.sign(value) != np.sign(old))
        f = f * -np.sign(value)[:, None]
        one, at = np.nonzero(ghost[number[self.neighbours[slots]]] == ghost[:, None])
        other = number[self.neighbours[slots[one], at]]
        far = vertices[other][~(vertices[other][:, :, None] == vertices[one][:, None, :]).any(axis=2)]
        bad = ((f[one] * lift[far]).sum(-1) >= -bound[one]) & ~turned[one]
        return np.concatenate([np.c_[vertices[turned], np.full(int(turned.sum()), -1)], np.c_[vertices[one[bad]], far[bad]]])

    def still_valid(self, points: np.ndarray) -> bool:
        """Whether the same simplices are the triangulation of moved points. In doubt they aren't."""
        return not len(self._doubts(unit(points)))

    #: Points that are taken out and put in again, as a part of all: beyond that a new mesh is made sooner.
    MOST_MOVED = 0.1

    def moved(self, points: np.ndarray) -> bool:
        """Mend the mesh for points that have moved. Points at places in doubt are taken out, until the rest of the mesh surely holds;
        then they are put in where they are now. False if that is more work than a new mesh, or leaves doubt; then the
        mesh is of no further use."""
        x, most = unit(points), max(1, int(self.MOST_MOVED * len(points)))
        went = (x != self.x).any(axis=1)
        out: list[int] = []
        while len(doubts := self._doubts(x)):
            weight = np.bincount(doubts[doubts >= 0], minlength=len(x)) * went
            chosen = []
            while len(doubts):  # the points that are in most doubts
                v = int(weight.argmax())
                if not weight[v]:
                    return False
                chosen.append(v)
                doubts = doubts[~(doubts == v).any(axis=1)]
                weight = np.bincount(doubts[doubts >= 0], minlength=len(x)) * went
            if len(out) + len(chosen) > most:
                return False
            for v in chosen:
                if not self._remove(v):
                    return False
            out += chosen
        self.x, self.lift, self.exact = x, lifted(x), _whole(points)
        self.among[: self.known] = x[self.where[: self.known]]
        self._finish(np.flatnonzero(self.alive))
        for v in out:
            self._insert(v)
        return not len(self._doubts(x))


def unit(points: np.ndarray) -> np.ndarray:
    """From 0 to 1 in the longest direction; each number is rounded once or twice, which the bounds allow for."""
    low = points.min(axis=0)
    return (points - low) / max(float((points.max(axis=0) - low).max()), 1e-300)
