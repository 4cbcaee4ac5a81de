"""Every strategy against plain Lloyd, in process: mixtures of one to four dimensions and degenerate inputs."""

import numpy as np
import pytest

from quarry.operators import graph
from quarry.operators.strategies import STRATEGIES, Batch, Context, distance


def plain(x, c, most=300):
    """Lloyd's algorithm, point by point over centroids."""
    d = np.stack([np.sqrt(sum((x[:, t] - row[t]) ** 2 for t in range(x.shape[1]))) for row in c], axis=1)
    a, done = d.argmin(axis=1), 0
    for done in range(1, most + 1):
        c = np.array([[sum(map(float, x[a == j, t])) / (a == j).sum() for t in range(x.shape[1])] if (a == j).any() else c[j] for j in range(len(c))])
        d = np.stack([np.sqrt(sum((x[:, t] - row[t]) ** 2 for t in range(x.shape[1]))) for row in c], axis=1)
        new = np.where(d[np.arange(len(x)), a] <= d.min(axis=1), a, d.argmin(axis=1))
        if (new == a).all():
            break
        a = new
    return a, c, done


def engine(name, x, c, most=300):
    plan, context, n = STRATEGIES[name], Context(c.copy()), len(x)
    b = Batch(x, np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros((n, 0)))
    plan.start(b, c, plan.tables(context))
    comps, it = int(b.comps.sum()), 0
    if plan.refers:
        context.forget(set(plan.references(b.own).tolist()))
    for it in range(1, most + 1):
        mean = context.c.copy()
        for j in set(b.a.tolist()):
            mean[j] = [sum(map(float, x[b.a == j, t])) / (b.a == j).sum() for t in range(x.shape[1])]
        context.advance(mean)
        if plan.needs_radius:
            context.radius = np.zeros(len(c))
            np.maximum.at(context.radius, b.a, distance(x, mean[b.a]))
        context.reach = np.zeros(len(c))
        np.maximum.at(context.reach, b.a, b.u)
        tables = plan.tables(context)
        b.clear()
        plan.step(b, mean, tables)
        comps += int(b.comps.sum())
        context.open_share = b.failed.sum() / max(1, b.walks.sum())
        if plan.refers:
            context.forget(set(plan.references(b.own).tolist()))
        if not b.changed.any():
            break
    return b.a, context.c, it, comps


def cases():
    rng = np.random.default_rng(4)
    for d in (1, 2, 3, 4):
        for k in (9, 25):
            centres = rng.uniform(-10, 10, (12, d))
            x = centres[rng.integers(12, size=700)] + rng.normal(size=(700, d))
            yield f"mixture {d} {k}", x, x[rng.choice(700, k, False)]
    grid = np.array([(i, j) for i in range(20) for j in range(20)], float)
    yield "grid", grid, grid[rng.choice(400, 13, False)]
    yield "centroids in a row", grid, grid[:9].copy()
    line = np.arange(400.0)
    yield "collinear", np.c_[line, 2 * line + 1], np.c_[np.arange(6.0), 2 * np.arange(6) + 1]
    yield "repeated points and centroids", np.repeat(grid[:50], 3, 0), np.r_[grid[:5], grid[:2]]
    yield "one centroid", grid, grid[:1]
    yield "more centroids than points", grid[:4], np.r_[grid[:6], grid[100:104]]
    yield "a centroid far away", grid, np.r_[grid[:4], [[1e4, 1e4]]]
    angle = np.arange(500.0)
    yield "circle", np.c_[np.cos(angle), np.sin(angle)], np.c_[np.cos(np.arange(20) * 0.3), np.sin(np.arange(20) * 0.3)]
    for scale in (1e6, 1e-6):
        x = rng.normal(size=(600, 2)) * scale
        yield f"scale {scale}", x, x[:12].copy()


@pytest.mark.parametrize("case", list(cases()), ids=lambda c: c[0])
def test_all_strategies_agree_with_lloyd(case):
    _, x, c = case
    a, centroids, iterations = plain(x, c)
    for name in STRATEGIES:
        got = engine(name, x, c)
        assert (got[0] == a).all(), name
        assert np.array_equal(got[1], centroids), name
        assert got[2] == iterations, name
        if name == "lloyd":
            assert got[3] == len(x) * len(c) * (iterations + 1)


def test_two_way_tie_among_new_centroids_takes_the_lowest_index():
    x, now = np.array([[0.0, 0.0]]), np.array([[3.0, 0.0], [0.0, 1.0], [0.0, -1.0], [9.0, 9.0]])
    for name, plan in STRATEGIES.items():
        before = np.array([[0.5, 0.0], [0.0, 5.0], [0.0, -5.0], [9.0, 9.0]])
        context = Context(before)
        b = Batch(x, np.zeros(1, np.int64), np.zeros(1), np.zeros(1), np.zeros((1, 0)))
        plan.start(b, before, plan.tables(context))
        assert b.a[0] == 0
        context.advance(now)
        context.radius = context.reach = distance(now, now) + 3
        b.clear()
        plan.step(b, now, plan.tables(context))
        assert b.a[0] == 1, name


def dense(found):
    out = np.zeros((found.graph.k, found.graph.k), bool)
    out[graph.edges(found.graph)] = True
    return out


def test_triangulation_falls_back_where_a_centroid_is_left_out():
    assert graph.Triangulation(np.c_[np.arange(6.0), np.arange(6.0)]).fallback
    square = np.array([[0.0, 0], [1, 0], [0, 1], [1, 1]])
    assert dense(graph.Triangulation(np.r_[square, square[:1]])).sum(axis=1).min() >= 1
    assert (dense(graph.Triangulation(square)) == ~np.eye(4, dtype=bool)).all()  # ties on the circle are all kept


def test_a_triangulation_is_kept_only_while_it_holds():
    c = np.array([[0.0, 0], [4, 0], [0, 4], [4, 4.5], [2, 2.2]])
    held = graph.Triangulation(c)
    assert held.still_valid(c + 0.001)
    c[4] = [9, 9]
    assert not held.still_valid(c)


@pytest.mark.parametrize("d, k", [(2, 64), (3, 64), (4, 64)])
def test_walks_evaluate_fewer_distances_than_bounds_alone(d, k):
    rng = np.random.default_rng(d)
    centres = rng.uniform(-10, 10, (k, d))
    x = centres[rng.integers(k, size=6000)] + 0.6 * rng.normal(size=(6000, d))
    c = x[rng.choice(6000, k, False)]
    comps = {name: engine(name, x, c)[3] for name in ("hamerly", "walk", "walk_separation", "walk_annulus", "walk_stable", "walk_history", "walk_local", "walk_reuse")}
    assert all(n < comps["hamerly"] for name, n in comps.items() if name != "hamerly")


@pytest.mark.parametrize("d, k", [(2, 512), (3, 512), (4, 128)])
def test_large_triangulations_have_no_fallback(d, k):
    c = np.random.default_rng(k).normal(size=(k, d))
    found = graph.Triangulation(c)
    assert not found.fallback and found.still_valid(c) and found.still_valid(c + 100.0)
    between = graph.centroid_distances(c)
    assert dense(found)[np.arange(k), between.argmin(axis=1)].all()  # the nearest other one is always a neighbour
    q = np.random.default_rng(0).normal(size=(2000, d))
    near = np.sqrt(((q[:, None, :] - c[None]) ** 2).sum(-1))
    second = np.argsort(near, axis=1)
    assert dense(found)[second[:, 0], second[:, 1]].all()


@pytest.mark.parametrize("shape", [(5, 5), (3, 3, 3), (2, 3, 2, 2)])
def test_lattices_keep_all_edges_of_a_sphere(shape):
    c = np.stack([g.ravel() for g in np.meshgrid(*map(np.arange, shape), indexing="ij")], axis=1).astype(float)
    within_a_cell = (np.abs(c[:, None] - c[None]).max(-1) <= 1) & ~np.eye(len(c), dtype=bool)
    assert (dense(graph.Triangulation(c)) == within_a_cell).all()


@pytest.mark.parametrize("d", [2, 3, 4])
def test_a_mended_triangulation_is_that_of_the_moved_centroids(d):
    rng, mended = np.random.default_rng(d), 0
    for _ in range(60 if d < 4 else 15):
        k = int(rng.integers(12, 50))
        c = rng.normal(size=(k, d))
        found, now = graph.Triangulation(c), c.copy()
        some = rng.choice(k, int(rng.integers(1, 4)), False)
        now[some] += rng.normal(size=(len(some), d)) * rng.choice([0.05, 0.3, 2.0])
        mended += found.repair(now)
        assert np.array_equal(found.graph.keys(), graph.Triangulation(now).graph.keys())
    assert mended > 20 if d < 4 else mended > 3


def test_points_taken_out_leave_the_mesh_of_the_rest():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(80, 2))
    mesh = graph.Triangulation(x).mesh
    x = np.unique(x, axis=0)
    for v in rng.permutation(80)[:50].tolist():
        assert mesh._remove(v)
    left = np.flatnonzero(mesh.member >= 0)
    corners = mesh.vertices[mesh.solid()]
    got = {(i, j) for own in corners.tolist() for i in own for j in own if i != j}
    fresh = graph.Triangulation(x[left]).graph
    assert got == {(left[i], left[j]) for i, j in zip(*graph.edges(fresh))}


def test_large_meshes_find_their_holes_locally(monkeypatch):
    from quarry.operators.delaunay import Mesh

    for shape in ((9, 9), (4, 4, 4)):
        lattice = np.stack([g.ravel() for g in np.meshgrid(*map(np.arange, shape), indexing="ij")], axis=1).astype(float)
        for c in (lattice, np.random.default_rng(1).normal(size=(300, len(shape)))):
            want = graph.Triangulation(c).graph.keys()
            monkeypatch.setattr(Mesh, "SCANNED", 0)
            assert np.array_equal(graph.Triangulation(c).graph.keys(), want)
            monkeypatch.undo()
