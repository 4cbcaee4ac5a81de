"""What a task of the in-memory loop keeps for its points."""

import pickle
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from quarry.operators.strategies import STRATEGIES, Context
from quarry.plans import driver


def _bytes(part):
    arrays = [v for b in part.blocks for v in vars(b).values()] + [v for s in part.sums for v in vars(s).values()] + [v for kept in part.kept for v in kept]
    return sum({id(v): v.nbytes for v in arrays if isinstance(v, np.ndarray)}.values())


def test_a_part_keeps_little_more_than_its_points():
    n, x = 50_000, np.random.default_rng(0).uniform(0, 100, (50_000, 3))
    column = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 3).cast(pa.list_(pa.float64()))
    rows = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), column, pa.array(np.ones(n, np.int64))], ["id", "x", "w"])
    part = driver._Part(iter([rows.slice(0, 20_001), rows.slice(20_001)]), STRATEGIES["lloyd"], x[:8], True)
    table = part.passed(x[:8], {})
    assert _bytes(part) <= 80 * n and table[0].sum() == n
    assert np.array_equal(np.concatenate([r["id"].to_numpy() for r in part.rows(True)]), np.arange(n))


def test_a_task_of_many_rows_goes_on_beyond_the_seconds_of_few(monkeypatch):
    class Stage:
        partitionId = staticmethod(lambda: 0)
        getTaskInfos = staticmethod(lambda: [SimpleNamespace(address="localhost:1")])

    monkeypatch.setattr(driver.BarrierTaskContext, "get", lambda: Stage)
    x = np.random.default_rng(0).uniform(0, 100, (4000, 3))
    column = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 3).cast(pa.list_(pa.float64()))
    rows = pa.RecordBatch.from_arrays([pa.array(np.arange(4000)), column, pa.array(np.ones(4000, np.int64))], ["id", "x", "w"])
    monkeypatch.setattr(driver, "SECONDS", 1e-6)
    for saved_rows, most in ((1 << 18, 1), (1e-6, 6)):  # seconds between saves: a millionth, and 4000
        monkeypatch.setattr(driver, "SAVED_ROWS", saved_rows)
        *_, last = driver._iterations("walk", Context(x[:8]), True, 200, 5)(iter([rows]))
        assert len(pickle.loads(last["rest"][0].as_py())[1]) == most
