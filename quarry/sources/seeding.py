"""Initial centroids. Points are held by the tasks of a barrier stage, which draw one centroid after the other; each point keeps its
distance to the nearest centroid drawn so far, so a round evaluates one distance a point at most."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.geometry import distance
from quarry.model import validated
from quarry.operators.strategies import distance as row_distance
from quarry.plans.exchange import Exchange
from quarry.sources.generate import lcg
from quarry.storage import materialise, shared_folder

#: Rounds between two copies of the distances, where no barrier stage can hold the points; bytes of points that a task holds.
ROUNDS, HELD = 16, 1 << 30


class _Drawn:
    """A task's points, and for each the nearest centroid drawn so far."""

    def __init__(self, batches: Iterator[pa.RecordBatch], width: int) -> None:
        records = [r for r in batches if len(r)]
        join = lambda name, kind: np.concatenate([r[name].to_numpy(zero_copy_only=False) for r in records]).astype(kind) if records else np.zeros(0, kind)
        self.id, self.w = join("id", np.int64), join("w", np.float64)
        self.x = np.concatenate([r["x"].flatten().to_numpy().reshape(len(r), -1) for r in records]) if records else np.zeros((0, width))
        self.near, self.own, self.seen = np.full(len(self.id), np.inf), np.zeros(len(self.id), np.int64), 0

    def meet(self, c: np.ndarray) -> None:
        """The last of ``c`` is new. Points whose centroid is twice as near as it is to the new one keep it, without a look."""
        at = np.arange(len(self.id))
        if len(c) > 1:
            at = np.flatnonzero(row_distance(c[:-1], c[-1][None, :])[self.own] < 2 * self.near)
        d = row_distance(self.x[at], c[-1][None, :])
        self.seen += len(at)
        closer = d < self.near[at]
        self.near[at[closer]], self.own[at[closer]] = d[closer], len(c) - 1


def _uniform(id_: np.ndarray, r: int, seed: int) -> np.ndarray:
    """As ``lcg`` has it."""
    key = id_ * 31 + r * 7919
    step = lambda v: (v * 1103515245 + 12345) % (1 << 31)
    return (step((step(key % (1 << 31) + seed) >> 3) * 7 + key % (1 << 20)).astype(np.float64) + 0.5) / float(1 << 31)


def _rounds(width: int, k: int, seed: int | None):
    """Draws (``seed``) or farthest points (None), in order; row k holds the distances evaluated."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stage = BarrierTaskContext.get()
        own, peers, chosen = _Drawn(batches, width), Exchange(stage), np.zeros((0, width))

        def least(values: list) -> tuple | None:
            return min((v for v in values if v is not None), key=lambda v: v[:2], default=None)

        try:
            for r in range(k):
                if seed is None:  # by id at first, then the farthest
                    key = np.zeros(len(own.id)) if r == 0 else -own.near
                    at = np.arange(len(own.id))
                else:
                    weight = own.w * (own.near**2 if r else 1.0)
                    at = np.flatnonzero(weight > 0)
                    key = -np.log(_uniform(own.id[at], r, seed)) / weight[at]
                best = np.lexsort((own.id[at], key))[:1] if len(at) < 2 else np.flatnonzero(key == key.min())
                best = best[own.id[at][best].argmin()] if len(best) else None
                told = (float(key[best]), int(own.id[at][best]), own.x[at][best]) if best is not None else None
                first = peers.combined(told, least)
                if first is None:
                    break
                chosen = np.r_[chosen, first[2][None, :]]
                own.meet(chosen)
            seen = peers.combined(own.seen, sum)
        finally:
            peers.close()
        if stage.partitionId() == 0:
            yield pa.RecordBatch.from_pydict({"r": pa.array([*range(len(chosen)), -1], pa.int32()), "x": pa.array([*chosen.tolist(), [float(seen)]], pa.list_(pa.float64()))})

    return go


def _over_jobs(points: DataFrame, k: int, width: int, seed: int | None) -> list[list[float]]:
    """The same draws, a job a round; the least distances are written every ROUNDS rounds."""
    folder, chosen, late = shared_folder(points.sparkSession), [], 0
    state = points.withColumn("near", F.lit(float("inf")))
    axes = [F.col("x")[t] for t in range(width)]
    for r in range(k):
        near = F.least("near", *(distance(axes, c) for c in chosen[late:])) if len(chosen) > late else F.col("near")
        if len(chosen) - late == ROUNDS:
            state, late = materialise(state.withColumn("near", near), f"{folder}/{r}"), len(chosen)
            near = F.col("near")
        if seed is None:
            order, rows = (F.lit(0.0) if r == 0 else -near), state
        else:
            weight = F.col("w").cast("double") * (F.pow(near, F.lit(2.0)) if r else F.lit(1.0))
            u = (lcg(F.col("id") * 31 + r * 7919, seed).cast("double") + 0.5) / float(1 << 31)
            order, rows = -F.ln(u) / weight, state.filter(weight > 0)
        row = rows.select(order.alias("clock"), "id", "x").orderBy("clock", "id").first()
        if row is None:
            break
        chosen.append(list(row["x"]))
    return chosen


def _chosen(points: DataFrame, k: int, seed: int | None, in_memory: bool | None) -> np.ndarray:
    from quarry.plans.driver import slots

    spark = points.sparkSession
    first = points.select("x").first()
    if first is None:
        raise ValueError("there are no points")
    width = len(first["x"])
    table = materialise(validated(points.select("id", "x", "w"), width), f"{shared_folder(spark)}/points")
    tasks = slots(spark) if in_memory is not False else 0
    if tasks and (in_memory or table.count() * 8 * (width + 5) <= tasks * HELD):
        rows = table.repartition(tasks, "id").mapInArrow(_rounds(width, k, seed), "r int, x array<double>", barrier=True).repartition(1).orderBy("r").collect()  # k rows
        return np.array([r["x"] for r in rows if r["r"] >= 0]).reshape(-1, width)
    return np.array(_over_jobs(table, k, width, seed)).reshape(-1, width)


def farthest_first(points: DataFrame, k: int, in_memory: bool | None = None) -> np.ndarray:
    """From the point of least id, ever the point farthest from those chosen; ties go to the least id."""
    return _chosen(points, k, None, in_memory)


def plus_plus(points: DataFrame, k: int, seed: int = 0, in_memory: bool | None = None) -> np.ndarray:
    """k-means++: each round draws a point with chance in proportion to the square of its distance, as the
    least of exponential clocks -ln(U) / (w d**2). U is a hash of id, round and seed. Where fewer than k points
    differ, it says so."""
    chosen = _chosen(points, k, seed, in_memory)
    if len(chosen) < k:
        raise ValueError(f"only {len(chosen)} of the points differ, {k} centroids were asked for")
    return chosen


def box(points: DataFrame, width: int) -> tuple[list[float], list[float]]:
    """The least and the greatest coordinate of each axis."""
    row = points.agg(*(f(F.col("x")[t]) for f in (F.min, F.max) for t in range(width))).first()
    return list(row[:width]), list(row[width:])


def lattice(low: list[float], high: list[float], side: int) -> np.ndarray:
    """The centres of a regular lattice of cells over a box."""
    axes = [lo + (hi - lo) * (np.arange(side) + 0.5) / side for lo, hi in zip(low, high)]
    return np.stack([g.ravel() for g in np.meshgrid(*axes, indexing="ij")], axis=1)
