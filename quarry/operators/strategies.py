"""Assignment strategies over batches of points. All give the same labels; they differ in how many
distances they evaluate.

One rule holds for every strategy: the first assignment takes the nearest centroid of lowest index;
afterwards a point moves only to a strictly nearer centroid, among equally near ones to the lowest index.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from quarry.operators import graph

INF = np.inf


def distance(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Row by row (or broadcast), summed in order of the axes; the root is compared, not the square."""
    total = 0.0
    for t in range(x.shape[-1]):
        gap = x[..., t] - c[..., t]
        total = total + gap * gap
    return np.sqrt(total)


def full(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All pairs; the same numbers as ``distance`` in fewer arrays."""
    total = np.subtract.outer(x[:, 0], c[:, 0])
    total *= total
    for t in range(1, x.shape[1]):
        gap = np.subtract.outer(x[:, t], c[:, t])
        gap *= gap
        total += gap
    return np.sqrt(total, out=total)


#: Distances that are held at once when points meet all centroids.
TABLE = 1 << 22


def pieces(at: np.ndarray, k: int) -> list[np.ndarray]:
    """``at`` in parts whose tables with ``k`` columns stay small."""
    step = max(1, TABLE // max(1, k))
    return [at[low : low + step] for low in range(0, len(at), step)]


@dataclass
class Batch:
    """The state of some points: coordinates, label, upper and lower bound, a strategy's own columns, and
    what the last pass did."""

    x: np.ndarray
    a: np.ndarray
    u: np.ndarray
    l: np.ndarray  # noqa: E741
    own: np.ndarray
    changed: np.ndarray = field(init=False)
    comps: np.ndarray = field(init=False)
    walks: np.ndarray = field(init=False)
    hops: np.ndarray = field(init=False)
    failed: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        for name in ("changed", "comps", "walks", "hops", "failed"):
            setattr(self, name, np.zeros(len(self.a), np.int64))

    def drop(self) -> None:
        """Counts are of use until they are added up."""
        for name in ("changed", "comps", "walks", "hops", "failed"):
            delattr(self, name)

    def move(self, at: np.ndarray, to: np.ndarray, u: np.ndarray, l: np.ndarray) -> None:  # noqa: E741
        self.changed[at] = to != self.a[at]
        self.a[at], self.u[at], self.l[at] = to, u, l


def nearest_two(d: np.ndarray, current: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label, its distance, and the least other distance."""
    row = np.arange(len(d))
    best = d.argmin(axis=1)
    if current is not None:
        best = np.where(d[row, current] <= d[row, best], current, best)
    first = d[row, best]
    if d.shape[1] == 1:
        return best, first, np.full(len(d), INF)
    d[row, best] = INF
    second = d.min(axis=1)
    d[row, best] = first
    return best, first, second


def choose(b: Batch, at: np.ndarray, d: np.ndarray, which: np.ndarray, beyond: np.ndarray | float = INF) -> None:
    """Move points to the best of some candidates (distances ``d``, infinite where none; labels ``which``);
    ``beyond`` bounds all other centroids from below."""
    u = b.u[at]
    if not d.shape[1]:
        b.l[at] = np.minimum(INF, beyond)
        return
    least = d.min(axis=1)
    moved = least < u
    to = np.where(moved, np.where(d == least[:, None], which, np.iinfo(np.int64).max).min(axis=1), b.a[at])
    others = np.where(which == to[:, None], INF, d).min(axis=1)
    second = np.where(moved, np.minimum(others, u), least)
    b.move(at, to, np.where(moved, least, u), np.minimum(second, beyond))


def tightened(b: Batch, c: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Points that the bound doesn't settle, even with the exact distance to their centroid."""
    at = np.flatnonzero(b.u > bound)
    b.u[at] = distance(b.x[at], c[b.a[at]])
    b.comps[at] += 1
    return at[b.u[at] > bound[at]]


def scan(b: Batch, at: np.ndarray, c: np.ndarray, own: bool = True) -> None:
    """All distances; ``own`` says that the one to the present centroid is known already."""
    for some in pieces(at, len(c)):
        b.comps[some] += len(c) - own
        b.move(some, *nearest_two(full(b.x[some], c), b.a[some]))


def walk(b: Batch, at: np.ndarray, c: np.ndarray, start: np.ndarray, d: np.ndarray, g: graph.Graph, stop: bool = False, keep: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy walks over a neighbour graph from ``start`` at distance ``d``: where they end, the distance there,
    and a bound on the rest. All walks take a step together: their frontier is the edges of where they stand. With ``stop``
    neighbours over twice the distance away are not evaluated."""
    cur, d = start.copy(), d.copy()
    second, rest = np.full(len(at), INF), np.full(len(at), INF)
    b.walks[at] += 1
    if g.complete:  # one step sees all
        for some in pieces(np.arange(len(at)), len(c)):
            now = b.a[at[some]] if keep else None
            b.comps[at[some]] += len(c) - 1
            end, d[some], second[some] = nearest_two(full(b.x[at[some]], c), now)
            b.hops[at[some]] += end != start[some]
            cur[some] = end
        return cur, d, second
    live = np.arange(len(at))
    while len(live):
        first, last = g.offsets[cur[live]], g.offsets[cur[live] + 1]
        if stop:
            first_far = g.within(cur[live], 2 * d[live])
            rest[live] = np.where(first_far < last, g.lengths[np.minimum(first_far, len(g.lengths) - 1)], INF) - d[live]
            last = first_far
        count = last - first
        owner = np.repeat(np.arange(len(live)), count)
        edge = np.arange(len(owner)) + np.repeat(first - (np.cumsum(count) - count), count)
        ids = g.neighbours[edge]
        dist = distance(b.x[at[live]][owner], c[ids])
        b.comps[at[live]] += count
        least = lambda values, none: graph.least(values, count, none)
        best = least(dist, INF)
        second[live] = best
        hop = best < d[live]
        tied = ~hop & (best == d[live]) & ((cur[live] != b.a[at[live]]) | (not keep))
        on = dist == best[owner]
        if tied.any():
            low = least(np.where(on, ids, len(c)), len(c))
            cur[live[tied]] = np.minimum(cur[live[tied]], low[tied])
        to = least(np.where(on, edge, len(g.neighbours)), len(g.neighbours))
        b.hops[at[live[hop]]] += 1
        cur[live[hop]] = g.neighbours[to[hop]]
        d[live[hop]] = best[hop]
        live = live[hop]
    return cur, d, np.minimum(second, rest)


class Context:
    """What the driver knows of a run: centroids now, first, and as far as rows still refer to them; their drift, and the graphs."""

    def __init__(self, c: np.ndarray) -> None:
        self.c, self.first, self.drift, self.dmax, self.it = c, c, np.zeros(len(c)), 0.0, 0
        self.snapshots, self.most_snapshots = {0: c}, 1
        self.cum, self.rebuilds, self.fallbacks, self.repairs = 0.0, 0, 0, 0
        self.way = np.zeros(len(c))  # of each centroid, step by step
        self.radius: np.ndarray | None = None
        self.reach: np.ndarray | None = None
        self.degrees: list[tuple[float, int]] = []
        self.read: list[int] = []
        self.drifts: list[float] = []

    def advance(self, c: np.ndarray) -> None:
        self.drift = distance(c, self.c)
        self.c, self.dmax, self.it = c, float(self.drift.max()), self.it + 1
        self.cum += self.dmax
        self.way = self.way + self.drift
        self.drifts.append(self.dmax)
        self.snapshots[self.it] = c

    def forget(self, referred: set[int]) -> None:
        """Snapshots stay while a row's bounds are as of them; the last one always does."""
        self.snapshots = {it: c for it, c in self.snapshots.items() if it in referred or it == self.it}
        self.most_snapshots = max(self.most_snapshots, len(self.snapshots))


class Strategy:
    """``tables`` makes the small arrays of an iteration; ``start`` and ``step`` run on batches."""

    own, needs_radius, needs_reach, in_z_order = 0, False, False, False
    #: Whether ``tables`` names clusters whose rows ``step`` leaves as they are (``stable``).
    skips = False
    #: Type of ``own``, and whether it goes with the points when the state is saved (without it the bounds start anew).
    kind: type = np.float64
    saved = True
    #: The column of ``own`` that names the snapshot a row refers to, if any.
    refers: int | None = None

    def own_width(self, k: int) -> int:
        """Numbers of its own that a strategy keeps for a point."""
        return self.own

    def held(self, k: int) -> float:
        """The memory of these, in numbers of eight bytes."""
        return self.own_width(k) * np.dtype(self.kind).itemsize / 8

    def references(self, own: np.ndarray) -> np.ndarray:
        return np.unique(own[:, self.refers].astype(np.int64))

    def tables(self, context: Context) -> dict:
        return {}

    def start(self, b: Batch, c: np.ndarray, t: dict) -> None:
        b.own = np.zeros((len(b.a), self.own_width(len(c))), self.kind)
        for some in pieces(np.arange(len(b.a)), len(c)):
            d = full(b.x[some], c)
            b.a[some], b.u[some], b.l[some] = nearest_two(d)
            b.comps[some] += len(c)
            b.own[some] = self.first_own(b, some, d, t)

    def first_own(self, b: Batch, at: np.ndarray, d: np.ndarray, t: dict) -> np.ndarray:
        return np.zeros((len(at), self.own))

    def step(self, b: Batch, c: np.ndarray, t: dict) -> None:
        raise NotImplementedError


class Lloyd(Strategy):
    #: Points whose distances are looked at together: they stay in the processor's cache.
    ROWS = 1024

    def tables(self, context):
        middle = context.c.mean(axis=0)
        y = context.c - middle
        square = (y * y).sum(axis=1)
        return {"middle": middle, "terms": np.column_stack([-2 * y, square]).T.copy(), "far": float(np.sqrt(square.max()))}

    def step(self, b, c, t):
        """Squares, less the point's own, as one product; points with more than one centroid within the rounding bound of the least
        are looked at again."""
        b.comps += len(c)
        rows = max(1, min(self.ROWS, TABLE // len(c)))
        z, table = np.ones((rows, c.shape[1] + 1)), np.empty((rows, len(c)))
        for low in range(0, len(b.a), rows):
            at = np.arange(low, min(low + rows, len(b.a)))
            own, d = z[: len(at)], table[: len(at)]
            np.subtract(b.x[low : low + rows], t["middle"], out=own[:, :-1])
            np.matmul(own, t["terms"], out=d)
            best = d.argmin(axis=1)
            reach = np.sqrt((own[:, :-1] ** 2).sum(axis=1)) + t["far"]
            limit = d[np.arange(len(at)), best] + (c.shape[1] + 8) * 2.0**-49 * reach * reach
            open_ = np.flatnonzero((d <= limit[:, None]).sum(axis=1) != 1)
            if len(open_):
                best[open_] = nearest_two(full(b.x[at[open_]], c), b.a[at[open_]])[0]
            b.move(at, best, distance(b.x[at], c[best]), b.l[at])


class Hamerly(Strategy):
    def __init__(self, separation: bool = True) -> None:
        self.separation = separation

    def tables(self, context):
        k = len(context.c)
        return {"drift": context.drift, "dmax": context.dmax, "s": graph.half_separation(context.c) if self.separation else np.zeros(k)}

    def step(self, b, c, t):
        b.u += t["drift"][b.a]
        b.l -= t["dmax"]
        scan(b, tightened(b, c, np.maximum(t["s"][b.a], b.l)), c)


class Elkan(Strategy):
    """A lower bound for each centroid in the state, in 16 bits: the distance when it was made and the way the centroid had
    come by then, so that it changes only when a distance is evaluated."""

    kind, saved = np.uint16, False
    #: Bits of a single that a bound leaves out, and powers of two below the centroids' extent at which bounds end.
    CUT, BELOW = 12, 24

    def own_width(self, k):
        return k

    def tables(self, context):
        extent = int(np.frexp(np.abs(context.first).max() + 1e-30)[1])
        return {"drift": context.drift, "way": context.way, "low": max(0, 127 + extent - self.BELOW) << 23, "s": graph.half_separation(context.c)}

    def _code(self, bound, low):
        """Rounded down; beyond the range the nearest lower one."""
        bits = np.minimum(bound * (1 - 2.0**-22), 2.0**127).astype(np.float32).view(np.int32)
        return np.clip(bits - low >> self.CUT, 0, (1 << 16) - 1).astype(np.uint16)

    def _bounds(self, code, t):
        bound = ((code.astype(np.int32) << self.CUT) + t["low"]).view(np.float32).astype(np.float64)
        bound[code == 0] = 0.0
        bound -= t["way"]
        return bound

    def first_own(self, b, at, d, t):
        return self._code(d + t["way"], t["low"])

    def step(self, b, c, t):
        if not b.own.shape[1]:
            b.own = np.zeros((len(b.a), len(c)), self.kind)
        b.own = b.own.astype(self.kind, copy=False)
        b.u += t["drift"][b.a]
        old = b.a.copy()
        every = np.flatnonzero(b.u > t["s"][b.a])
        for at in pieces(every, len(c)):
            self._settle(b, c, at, t)
        b.changed = (b.a != old).astype(np.int64)

    def _settle(self, b, c, at, t):
        labels, place = np.unique(b.a[at], return_inverse=True)
        bound = self._bounds(b.own[at], t)
        bar = np.maximum(bound, (0.5 * full(c[labels], c))[place])
        bar[np.arange(len(at)), b.a[at]] = INF
        some = np.flatnonzero((b.u[at][:, None] > bar).any(axis=1))
        at, bar, bound = at[some], bar[some], bound[some]
        b.u[at] = distance(b.x[at], c[b.a[at]])
        b.own[at, b.a[at]] = self._code(b.u[at] + t["way"][b.a[at]], t["low"])
        b.comps[at] += 1
        which, row = np.nonzero((b.u[at][:, None] > bar).T)  # what a bound settles now stays settled, as upper bounds only fall
        cuts = np.searchsorted(which, np.arange(len(c) + 1))
        for j in np.flatnonzero(np.diff(cuts)).tolist():
            own = row[cuts[j] : cuts[j + 1]]
            r = at[own]
            r = r[(b.u[r] > bound[own, j]) & (b.u[r] > 0.5 * distance(c[b.a[r]], c[j][None, :]))]
            d = distance(b.x[r], c[j][None, :])
            b.comps[r] += 1
            b.own[r, j] = self._code(d + t["way"][j], t["low"])
            closer = d < b.u[r]
            b.a[r[closer]], b.u[r[closer]] = j, d[closer]


class Yinyang(Strategy):
    """A lower bound for each group of centroids."""

    def own_width(self, k):
        return graph.group_count(k)

    def tables(self, context):
        if not hasattr(context, "groups"):
            context.groups = graph.groups(context.first)
        own, count = context.groups, self.own_width(len(context.c))
        return {"drift": context.drift, "group": own, "gd": np.array([context.drift[own == g].max() if (own == g).any() else 0.0 for g in range(count)])}

    def _group_least(self, d, a, group, count):
        other = d.copy()
        other[np.arange(len(d)), a] = INF
        return np.stack([other[:, group == g].min(axis=1) if (group == g).any() else np.full(len(d), INF) for g in range(count)], axis=1)

    def first_own(self, b, at, d, t):
        return self._group_least(d, b.a[at], t["group"], len(t["gd"]))

    def step(self, b, c, t):
        b.u += t["drift"][b.a]
        b.own = b.own - t["gd"][None, :]
        for at in pieces(tightened(b, c, b.own.min(axis=1)), len(c)):
            self._scan(b, c, t, at)

    def _scan(self, b, c, t, at):
        group, ut = t["group"], b.u[at].copy()
        scan = (ut[:, None] > b.own[at]) | (np.arange(len(t["gd"]))[None, :] == group[b.a[at]][:, None])
        look = scan[:, group] & (np.arange(len(c))[None, :] != b.a[at][:, None])
        d = np.where(look, full(b.x[at], c), INF)
        b.comps[at] += look.sum(axis=1)
        old = b.a[at].copy()
        choose(b, at, d, np.broadcast_to(np.arange(len(c)), d.shape))
        known = d.copy()
        known[np.arange(len(at)), old] = ut
        least = self._group_least(known, b.a[at], group, len(t["gd"]))
        b.own[at] = np.where(scan, least, b.own[at])


class Exponion(Strategy):
    """Candidates within twice the upper bound of the assigned centroid, by sorted distances or by annuli."""

    needs_reach = True

    def __init__(self, by_annuli: bool = False) -> None:
        self.by_annuli = by_annuli

    def tables(self, context):
        reach = context.reach if context.reach is not None else np.zeros(len(context.c))
        limit = 2 * (reach + context.drift) * (1 + 1e-9)
        near = graph.near(context.c, 2 * limit if self.by_annuli else limit)
        edge = near.lengths
        if self.by_annuli and len(edge):
            edge = graph.annuli(edge, np.repeat(2 * graph.half_separation(context.c), np.diff(near.offsets)))[1]
        return {"drift": context.drift, "dmax": context.dmax, "near": near, "edge": edge, "limit": limit}

    def step(self, b, c, t):
        b.u += t["drift"][b.a]
        b.l -= t["dmax"]
        candidates(b, tightened(b, c, b.l), c, t)


def candidates(b: Batch, at: np.ndarray, c: np.ndarray, t: dict) -> None:
    """Moves points to the best centroid whose ``edge`` is within twice their upper bound.

    Points sorted by (label, upper bound) meet edges sorted by (label, length) in one merge: a point's candidates are a
    first stretch of its label's edges. Points with like numbers of them are worked on together."""
    near, edge, k = t["near"], t["edge"], len(c)
    label, far = b.a[at], 2 * b.u[at]
    first, size = near.offsets[label], np.diff(near.offsets)[label]
    count = np.zeros(len(at), np.int64)
    order = np.lexsort((far, label))
    cuts = np.flatnonzero(np.r_[True, label[order][1:] != label[order][:-1]]) if len(at) else np.zeros(0, np.int64)
    for low, high in zip(cuts, np.r_[cuts[1:], len(order)]):
        own = order[low:high]
        j = label[own[0]]
        count[own] = np.searchsorted(edge[near.offsets[j] : near.offsets[j + 1]], far[own], "right")
    by_count = np.argsort(count, kind="stable")
    cuts = np.unique(np.searchsorted(count[by_count], [0, 1, 4, 8, 16, *(1 << p for p in range(5, 40))]))
    for low, high in zip(cuts[:-1], cuts[1:]):
        for some in pieces(by_count[low:high], max(1, int(count[by_count[high - 1]]))):
            rows, width = at[some], int(count[some].max())
            mine = np.arange(width)[None, :] < count[some][:, None]
            which = near.neighbours[np.minimum(first[some][:, None] + np.arange(width)[None, :], max(0, len(near.neighbours) - 1))] if width else np.zeros((len(some), 0), np.int64)
            d = np.where(mine, distance(b.x[rows][:, None, :], c[which]), INF)
            b.comps[rows] += count[some]
            following = edge[np.minimum(first[some] + count[some], len(edge) - 1)] if len(edge) else np.zeros(len(some))
            beyond = np.where(count[some] < size[some], following, np.where(size[some] == k - 1, INF, t["limit"][label[some]]))
            choose(b, rows, d, which, beyond - b.u[rows])


class Ball(Strategy):
    """Clusters nearer than twice the radius, and of those the ones nearer than twice the point's distance."""

    needs_radius = True

    def tables(self, context):
        radius = context.radius if context.radius is not None else np.zeros(len(context.c))
        near = graph.near(context.c, 2 * radius, strictly=True)
        # a candidate is strictly nearer than twice the distance
        return {"near": near, "edge": np.nextafter(near.lengths, INF), "limit": 2 * radius}

    def step(self, b, c, t):
        b.u = distance(b.x, c[b.a])
        b.comps += 1
        candidates(b, np.arange(len(b.a)), c, t)


class Walk(Strategy):
    """Walks on the neighbour graph from points that their bounds don't settle."""

    def __init__(self, separation: bool = False, stop: bool = False) -> None:
        self.separation, self.stop = separation, stop

    def _graph(self, context):
        triangulation = graph.Triangulation(context.c)
        context.rebuilds += 1
        self._measured(context, triangulation)
        return triangulation

    def _measured(self, context, triangulation):
        context.fallbacks += triangulation.fallback
        degree = np.diff(triangulation.graph.offsets) if not triangulation.graph.complete else np.full(len(context.c), len(context.c) - 1)
        context.degrees.append((float(degree.mean()), int(degree.max())))

    def tables(self, context):
        near, s = graph.by_length(context.c, self._graph(context).graph)
        return {"drift": context.drift, "dmax": context.dmax, "near": near, "s": s if self.separation else np.zeros(len(context.c))}

    def settle(self, b, c, t, at):
        b.move(at, *walk(b, at, c, b.a[at], b.u[at], t["near"], self.stop))

    def step(self, b, c, t):
        b.u += t["drift"][b.a]
        b.l -= t["dmax"]
        self.settle(b, c, t, tightened(b, c, np.maximum(t["s"][b.a], b.l)))


class StableWalk(Walk):
    """Skips clusters whose cell is unchanged; their bounds are corrected when they are next looked at."""

    own, skips = 1, True

    def __init__(self) -> None:
        super().__init__(separation=True, stop=True)

    def tables(self, context):
        after = self._graph(context).graph
        near, s = graph.by_length(context.c, after)
        stable = graph.stable_clusters(context.neighbours, after, context.drift) if context.it else np.zeros(len(context.c), bool)
        context.neighbours = after
        return {"drift": context.drift, "cum": context.cum, "near": near, "s": s, "stable": stable}

    def step(self, b, c, t):
        on = ~t["stable"][b.a]
        b.u[on] += t["drift"][b.a[on]]
        b.l[on] -= t["cum"] - b.own[on, 0]
        b.own[on, 0] = t["cum"]
        bound = np.where(on, np.maximum(t["s"][b.a], b.l), INF)
        self.settle(b, c, t, tightened(b, c, bound))


class HistoryWalk(StableWalk):
    """Bounds kept as of the iteration they were made in, and corrected by the way since then."""

    own, refers = 3, 2

    def tables(self, context):
        its = np.array(sorted(context.snapshots))
        moved = np.stack([distance(context.snapshots[it], context.c) for it in its.tolist()])
        return super().tables(context) | {"it": context.it, "its": its, "moved": moved, "most": moved.max(axis=1)}

    def first_own(self, b, at, d, t):
        return np.stack([b.u[at], b.l[at], np.zeros(len(at))], axis=1)

    def step(self, b, c, t):
        on = ~t["stable"][b.a]
        since = np.searchsorted(t["its"], b.own[:, 2].astype(np.int64))
        b.u = np.where(on, b.own[:, 0] + t["moved"][since, b.a], b.u)
        b.l = np.where(on, b.own[:, 1] - t["most"][since], b.l)
        loose = on & (b.u > np.maximum(t["s"][b.a], b.l))
        at = tightened(b, c, np.where(on, np.maximum(t["s"][b.a], b.l), INF))
        self.settle(b, c, t, at)
        b.own[loose] = np.stack([b.u[loose], b.l[loose], np.full(int(loose.sum()), t["it"])], axis=1)


class LocalWalk(Walk):
    """Bounds over the cell's neighbours only; starts by walks along a space-filling curve. With ``reuse`` a
    triangulation that still holds is kept, and one that doesn't is mended."""

    in_z_order = True

    def __init__(self, reuse: bool = False) -> None:
        super().__init__(separation=True, stop=True)
        self.reuse = reuse

    def tables(self, context):
        found = getattr(context, "triangulation", None)
        before = found.graph if found else None
        if not self.reuse or found is None:
            found = self._graph(context)
        elif not found.still_valid(context.c):
            mended = found.repair(context.c)
            context.repairs += mended
            context.rebuilds += not mended
            self._measured(context, found)
        context.triangulation, after = found, found.graph
        near, s = graph.by_length(context.c, after)
        kept, new = graph.local_drift(context.c, before or after, after, context.drift)
        return {"drift": context.drift, "near": near, "s": s, "kept": kept, "new": new}

    def start(self, b, c, t):
        """The first point meets all centroids. Then the points half way between those known set out from where the one before
        them ended, and so on down: neighbours on the curve are near each other."""
        b.own, b.a[:] = np.zeros((len(b.a), 0)), -1
        n = len(b.a)
        stride = 1 << max(0, n - 1).bit_length()
        b.a[:1] = full(b.x[:1], c).argmin(axis=1)
        b.comps[:1] += len(c)
        b.u[:1] = distance(b.x[:1], c[b.a[:1]])
        b.a[:1], b.u[:1], b.l[:1] = walk(b, np.arange(min(1, n)), c, b.a[:1], b.u[:1], t["near"], self.stop, keep=False)
        while stride > 1:
            at = np.arange(stride // 2, n, stride)
            lead = b.a[at - stride // 2]
            b.comps[at] += 1
            b.a[at], b.u[at], b.l[at] = walk(b, at, c, lead, distance(b.x[at], c[lead]), t["near"], self.stop, keep=False)
            stride //= 2

    def step(self, b, c, t):
        b.u += t["drift"][b.a]
        b.l = np.minimum(b.l - t["kept"][b.a], t["new"][b.a] - b.u)
        self.settle(b, c, t, tightened(b, c, np.maximum(t["s"][b.a], b.l)))


class LazyWalk(Walk):
    """Walks on a graph of earlier centroids; what the centroids' way since then leaves open is scanned in full."""

    REBUILD = 0.1

    def tables(self, context):
        if getattr(context, "snapshot", None) is None or context.open_share > self.REBUILD:
            context.snapshot, context.lazy = context.c, self._graph(context)
        context.open_share = 0.0
        near, _ = graph.by_length(context.snapshot, context.lazy.graph)
        return {"drift": context.drift, "dmax": context.dmax, "near": near, "old": context.snapshot, "way": float(distance(context.c, context.snapshot).max())}

    def step(self, b, c, t):
        b.u += t["drift"][b.a]
        b.l -= t["dmax"]
        at = tightened(b, c, b.l)
        b.comps[at] += t["way"] > 0
        end, _, second = walk(b, at, t["old"], b.a[at], distance(b.x[at], t["old"][b.a[at]]), t["near"])
        now = distance(b.x[at], c[end])
        b.comps[at] += end != b.a[at]
        sure = now < second - t["way"]
        b.move(at[sure], end[sure], now[sure], second[sure] - t["way"])
        at = at[~sure]
        b.failed[at] = 1
        scan(b, at, c)


STRATEGIES: dict[str, Strategy] = {
    "lloyd": Lloyd(),
    "hamerly": Hamerly(),
    "hamerly_no_separation": Hamerly(separation=False),
    "elkan": Elkan(),
    "yinyang": Yinyang(),
    "exponion": Exponion(),
    "exponion_annuli": Exponion(by_annuli=True),
    "ball": Ball(),
    "walk": Walk(),
    "walk_separation": Walk(separation=True),
    "walk_annulus": Walk(separation=True, stop=True),
    "walk_stable": StableWalk(),
    "walk_history": HistoryWalk(),
    "walk_local": LocalWalk(),
    "walk_reuse": LocalWalk(reuse=True),
    "walk_lazy": LazyWalk(),
}
