"""How often the loop in memory saves its state, and that a run of walk_local goes on from there as if it had not."""

import pickle
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from quarry.operators.strategies import Context
from quarry.plans import driver

ROUNDS = 12


@pytest.fixture
def alone(monkeypatch):
    class Stage:
        partitionId = staticmethod(lambda: 0)
        getTaskInfos = staticmethod(lambda: [SimpleNamespace(address="localhost:1")])

    monkeypatch.setattr(driver.BarrierTaskContext, "get", lambda: Stage)
    monkeypatch.setattr(driver, "SECONDS", 1e-6)


def _run(name, x, k):
    """Stages of the run, its last context, and the labels."""
    column = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
    rows = [pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), column, pa.array(np.ones(len(x), np.int64))], ["id", "x", "w"])]
    context, stages = Context(x[:k]), 0
    while True:
        *rows, last = driver._iterations(name, context, not stages, driver.SAVE, ROUNDS - context.it)(iter(rows))
        context, _, converged = pickle.loads(last["rest"][0].as_py())
        stages += 1
        if converged or context.it >= ROUNDS:
            return stages, context, np.concatenate([r["a"].to_numpy() for r in rows])


def test_walk_local_is_saved_by_its_rows_and_goes_on_alike(alone, monkeypatch):
    x = np.random.default_rng(1).integers(-10_000, 10_000, (6000, 3)).astype(float)
    monkeypatch.setattr(driver, "SAVED_ROWS", 1e-6)  # 6000 seconds between saves
    stages, once, labels = _run("walk_local", x, 20)
    assert stages == 1 and once.it == ROUNDS
    monkeypatch.setattr(driver, "SAVED_ROWS", 1 << 18)  # a millionth of a second
    stages, often, again = _run("walk_local", x, 20)
    assert stages == 1 + ROUNDS and np.array_equal(labels, again) and np.array_equal(once.c, often.c)
    _, lloyd, want = _run("lloyd", x, 20)
    assert np.array_equal(labels, want) and np.array_equal(once.c, lloyd.c)
