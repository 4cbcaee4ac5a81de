"""Elkan's bounds in 16 bits, and what saving the state costs."""

import numpy as np
import pytest

from quarry.operators.strategies import STRATEGIES, Context
from quarry.plans import driver
from quarry.sources import mixture


@pytest.mark.parametrize("scale", [1e-30, 1e-6, 1.0, 1e6, 2.0**41])
def test_bounds_are_below_what_they_stand_for_and_near(scale):
    rng, plan = np.random.default_rng(3), STRATEGIES["elkan"]
    context = Context(rng.uniform(-scale, scale, (8, 3)))
    context.way = rng.uniform(0, scale, 8)
    t, d = plan.tables(context), rng.uniform(0, 4 * scale, (1000, 8))
    found = plan._bounds(plan._code(d + t["way"], t["low"]), t)
    assert (found <= d).all() and (d - found <= (d + t["way"]) / 1000).all()
    assert (plan._bounds(plan._code(np.array([[0.0] * 8, [1e300] * 8]), t["low"]), t) <= [[0.0] * 8, [1e300] * 8]).all()


def test_36_million_points_and_their_bounds_fit_three_executors():
    for name in STRATEGIES:
        assert driver.tasks_in_memory(12, 36_000_000, 64, 3, STRATEGIES[name].held(64)) == 12, name
    assert driver.seconds_between_saves(1000) == driver.SECONDS
    assert driver.seconds_between_saves(3_000_000) > 10 * driver.SECONDS


@pytest.mark.parametrize("more", [{"save": 3}, {"in_memory": False}])
def test_elkan_goes_on_from_a_saved_state(spark, sf_dir, more):
    table, c = mixture.mixture(spark, sf_dir, 3, 16), mixture.first_centroids(spark, sf_dir, 3, 16)
    one = driver.run(table, c, "elkan", max_iterations=8, **more)
    other = driver.run(table, c, "lloyd", max_iterations=8)
    assert np.array_equal(one.centroids, other.centroids) and one.iterations == other.iterations
    assert one.labels.select("id", "a").exceptAll(other.labels.select("id", "a")).isEmpty()
