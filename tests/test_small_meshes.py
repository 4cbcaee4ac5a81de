"""Graphs of many small sets at once."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.operators import graph, meshes, small


def _by_all_simplices(x):
    """In whole numbers, without any filter."""
    whole, linked = small._whole(x), np.zeros((len(x), len(x)), bool)
    for corner in small._simplices(len(x), x.shape[1] + 1).tolist():
        if small._empty(whole, corner):
            linked[np.ix_(corner, corner)] = True
    np.fill_diagonal(linked, False)
    return np.flatnonzero(linked)


@pytest.mark.parametrize("d", [2, 3, 4])
@pytest.mark.parametrize("step", [1.0, 0.37, 1e9 + 0.1])
def test_ties_equal_points_and_flat_sets(d, step):
    rng = np.random.default_rng(d)
    x = np.concatenate([rng.integers(0, 3, (8, 9, d)) * step, np.zeros((1, 9, d)), rng.normal(size=(4, 9, d))])
    x[0, :, 0] = 0.1  # in a hyperplane
    want = np.concatenate([_by_all_simplices(own) + i * 81 for i, own in enumerate(x)])
    assert np.array_equal(small.edges(x), want)
    assert np.array_equal(np.concatenate([meshes._large(own) + i * 81 for i, own in enumerate(x)]), want)


@pytest.mark.parametrize("d, k, most", [(2, 25, 4.0), (3, 20, 8.0), (4, 10, 2.0)])
def test_a_set_takes_few_milliseconds(d, k, most):
    x = np.random.default_rng(0).integers(-10000, 10000, (200, k, d)).astype(float)
    want = np.concatenate([graph.Triangulation(own, exact=True).graph.keys() + i * k * k for i, own in enumerate(x[:5])])
    found = small.edges(x)
    assert np.array_equal(found[found < 5 * k * k], want)
    began = time.process_time()
    small.edges(x)
    assert (time.process_time() - began) / len(x) * 1e3 < most


def test_a_set_in_the_plane_takes_pairs_not_simplices(monkeypatch):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(-10000, 10000, (60, 25, 2)), rng.integers(0, 40, (60, 25, 2))]).astype(float)
    x[0, 1], x[1, :3] = x[0, 0], [[0, 0], [50, 50], [100, 100]]
    want = np.concatenate([_by_all_simplices(own) + i * 625 for i, own in enumerate(x[::6])])
    assert np.array_equal(small.edges(x[::6]), want)
    mesh, seen = small._mesh, []
    monkeypatch.setattr(small, "_mesh", lambda some, corners: seen.append(len(some)) or mesh(some, corners))
    small.edges(x[:60])
    assert sum(seen) <= 3  # sets with circles through four points


def test_groups_over_several_batches():
    g = np.repeat(np.arange(6), [3, 1, 9, 2, 2, 1])
    table = pa.table({"g": g, "j": np.arange(len(g))})
    for rows in (1, 2, 4, 5, 18):
        parts = list(meshes._whole_groups(iter(table.to_batches(max_chunksize=rows))))
        assert pa.concat_tables(parts).equals(table)
        assert all(len(set(a["g"].to_pylist()) & set(b["g"].to_pylist())) == 0 for i, a in enumerate(parts) for b in parts[:i])


def test_groups_of_any_size_and_numbering(spark):
    rng = np.random.default_rng(1)
    rows = [(g, 7 + 2 * j, rng.integers(0, 50, 2).astype(float).tolist()) for g, k in enumerate([1, 3, 25, 70, 2]) for j in range(k)]
    sites = spark.createDataFrame(rows, "g long, j int, x array<double>").withColumn("y", F.transform("x", lambda v: v * 2))
    want = set()
    for g in range(5):
        x = np.array([r[2] for r in rows if r[0] == g])
        want |= {(g, 7 + 2 * int(e // len(x)), 7 + 2 * int(e % len(x))) for e in _by_all_simplices(x)}
    assert {(r["g"], r["j"], r["h"]) for r in meshes.delaunay(sites).collect()} == want
    assert {(r["g"], r["j"], r["h"]) for r in meshes.repaired(sites).collect()} == want
    assert all(r["valid"] for r in meshes.still_valid(sites).collect())
