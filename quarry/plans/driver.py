"""The outer loop of every strategy: update centroids, prepare small tables, one pass over the points.

*In memory*: a barrier stage holds the points, a part in each of its tasks. After each pass the tasks add up their exact
sums by label (a few rows a centroid) and all compute the same centroids and tables. After SAVE iterations or SECONDS the state goes
to the shared folder, so that is what a lost executor costs. The tasks are as many as the cluster runs at once, fewer where
their exchange would be large.

*Streamed*: what memory can't hold, or a cluster of changing size, takes two jobs an iteration: a pass that reads the
state's partitions, runs the strategy on Arrow batches and writes the new state (no shuffle), and an aggregation to one row a
cluster.

*By label*: streamed, for strategies that skip stable clusters. The state's files are laid out by label; a pass reads the
files of labels that aren't stable and writes their rows anew. Rows that move to a stable label are added to its files and
merged when it is read again. Sums are kept for each file.

All add up the same whole numbers, so the result is the same to the last bit, however points are dealt.
"""

from __future__ import annotations

import pickle
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quarry.functions.geometry import z_order
from quarry.model import Result, exact_mean, exact_sums, validated
from quarry.operators.strategies import STRATEGIES, Batch, Context, Strategy, distance
from quarry.plans.exchange import Exchange
from quarry.storage import materialise, remove, shared_folder

#: Rows that a task works on at a time; iterations and seconds between two copies of the state in the shared folder.
BLOCK, SAVE, SECONDS = 1 << 14, 200, 60.0
#: Rows of a task that take about a tenth of SECONDS to save: with more of them the state is saved less often.
SAVED_ROWS = 1 << 18
#: Most parts of a state that is laid out by label.
LABEL_PARTS = 256
#: Bytes of state that a task holds, bytes that the tasks together send in an iteration, and most tasks of the stage.
HELD, EXCHANGED, MOST_TASKS = 1 << 30, 1 << 27, 1000
COUNTS = ("changed", "comps", "walks", "hops", "failed")
STATE = "id long, x array<double>, w long, a int, u double, l double, own array<double>, " + ", ".join(f"{c} long" for c in COUNTS)
SAVED = "id long, x array<double>, w long, a int, u double, l double, own array<double>, rest binary"


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, -1 if rows and len(flat) else 0).astype(np.float64)


def _batch(record: pa.RecordBatch, fresh: bool) -> Batch:
    n = len(record)
    x = _matrix(record["x"], n)
    if fresh:
        return Batch(x, np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros((n, 0)))
    take = lambda c: np.array(record[c])
    return Batch(x, take("a").astype(np.int64), take("u"), take("l"), _matrix(record["own"], n).copy())


def _own_column(b: Batch) -> pa.Array:
    width = b.own.shape[1]
    return pa.FixedSizeListArray.from_arrays(pa.array(b.own.ravel()), width).cast(pa.list_(pa.float64())) if width else pa.array([[]] * len(b.a), pa.list_(pa.float64()))


# --- sums ---


def updated(c: np.ndarray, summary: list[dict]) -> np.ndarray:
    """Means of the labels; a cluster without points keeps its centroid."""
    out = c.copy()
    for row in summary:
        for t in range(c.shape[1]):
            out[row["a"], t] = exact_mean(row[f"h{t}"], row[f"l{t}"], row["n"])
    return out


class LabelSums:
    """Exact sums by label of what ``exact_sums`` adds up: parts of 22 bits, whose weighted sums stay whole in a double.
    Sums of coordinates are kept, and corrected by the rows that change their label."""

    BITS = 22

    def __init__(self, x: np.ndarray, w: np.ndarray, k: int) -> None:
        self.x, self.w, self.width, self.k = x, w, x.shape[1], k
        self.whole = int(w.sum()) >= 1 << 31 or int(np.abs(w).max(initial=0)) >= 1 << 31
        self.label: np.ndarray | None = None

    def _weighted(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        return v.astype(object) * w.astype(object) if self.whole else (v * w).astype(np.float64)

    def _values(self, at: slice | np.ndarray) -> Iterator[np.ndarray]:
        """Weights and weighted parts of some rows, made when they are added up: a table of all would be larger than the points."""
        w = self.w[at]
        yield self._weighted(np.ones(len(w), np.int64), w)
        scaled = self.x[at] * float(1 << 20)
        high = np.floor(scaled)
        low = np.rint((scaled - high) * float(1 << 40)).astype(np.int64)
        for v in (*high.astype(np.int64).T, *low.T):
            for i in range(2):
                yield self._weighted((v >> self.BITS * i) & (1 << self.BITS) - 1, w)
            yield self._weighted(v >> self.BITS * 2, w)

    def _sum(self, label: np.ndarray, values: np.ndarray) -> np.ndarray:
        if not self.whole:
            return np.bincount(label, values, minlength=self.k).astype(np.int64)
        out = np.zeros(self.k, object)
        np.add.at(out, label, values)
        return out

    def table(self, label: np.ndarray, counts: list[np.ndarray]) -> np.ndarray:
        """For each label (columns) the number of rows, weights, parts of the coordinates' sums, and weighted counts."""
        return np.stack([*self.moved(label), *(self._sum(label, self._weighted(v, self.w)) for v in counts)])

    def moved(self, label: np.ndarray) -> list[np.ndarray]:
        if self.label is None:
            self.label, self.rows, self.sums = label.astype(np.int32), np.bincount(label, minlength=self.k), None
            for low in range(0, len(label), BLOCK):
                some = slice(low, low + BLOCK)
                found = [self._sum(label[some], v) for v in self._values(some)]
                self.sums = found if self.sums is None else [s + v for s, v in zip(self.sums, found)]
            if self.sums is None:
                self.sums = [self._sum(label, v) for v in self._values(slice(0, 0))]
        changed = np.flatnonzero(label != self.label)
        for low in range(0, len(changed), BLOCK):
            at = changed[low : low + BLOCK]
            before, after = self.label[at], label[at]
            self.rows = self.rows - np.bincount(before, minlength=self.k) + np.bincount(after, minlength=self.k)
            self.sums = [s - self._sum(before, v) + self._sum(after, v) for s, v in zip(self.sums, self._values(at))]
            self.label[at] = after
        return [self.rows, *self.sums]


def summarised(table: np.ndarray, width: int) -> list[dict]:
    """As ``_summary``, from added tables of ``LabelSums``."""
    out = []
    for j in np.flatnonzero(table[0] > 0).tolist():
        column = [int(v) for v in table[:, j]]
        whole = [sum(column[2 + 3 * s + i] << LabelSums.BITS * i for i in range(3)) for s in range(2 * width)]
        row = {"a": j, "n": column[1]} | {f"h{t}": whole[t] for t in range(width)} | {f"l{t}": whole[width + t] for t in range(width)}
        out.append(row | dict(zip(COUNTS, column[2 + 6 * width :])))
    return out


def _summary(state: DataFrame, width: int) -> list[dict]:
    """One row a cluster: weight, exact sums, and weighted counts."""
    sums = [c.alias(f"{part}{t}") for t in range(width) for part, c in zip(("h", "l"), exact_sums(F.col("x")[t], F.col("w")))]
    counts = [F.sum(F.col(n) * F.col("w")).alias(n) for n in COUNTS]
    return [r.asDict() for r in state.groupBy("a").agg(F.sum("w").alias("n"), F.count("*").alias("rows"), F.max("u").alias("reach"), *sums, *counts).collect()]


def _work(summary: list[dict]) -> list[dict]:
    return [{n: r[n] for n in ("a", "n", *COUNTS)} for r in summary]


def _open_share(summary: list[dict]) -> float:
    return sum(r["failed"] for r in summary) / max(1, sum(r["walks"] for r in summary))


# --- the loop in memory ---


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in blocks of BLOCK, so that no more than a block is held twice."""
    held, rows = [], 0
    for r in batches:
        while len(r):
            some = r.slice(0, BLOCK - rows)
            held, rows, r = [*held, some], rows + len(some), r.slice(len(some))
            if rows == BLOCK:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class _Part:
    """A task's points and their state, in blocks."""

    def __init__(self, batches: Iterator[pa.RecordBatch], plan: Strategy, c: np.ndarray, fresh: bool) -> None:
        self.plan, self.fresh = plan, fresh
        self.kept: list[tuple[np.ndarray, np.ndarray]] = []  # ids and weights; the points are in their blocks alone
        self.blocks: list[Batch] = []
        self.sums: list[LabelSums] = []
        self.none = LabelSums(np.zeros((0, c.shape[1])), np.zeros(0, np.int64), len(c))
        for r in _blocks(batches):
            b = _batch(r, fresh)
            b.x = b.x.copy()  # not a view of the batch, which goes
            self.blocks.append(b)
            self.kept.append((np.array(r["id"]), np.array(r["w"])))
            self.sums.append(LabelSums(b.x, self.kept[-1][1], len(c)))

    def passed(self, c: np.ndarray, tables: dict) -> np.ndarray:
        out = self.none.table(np.zeros(0, np.int64), [np.zeros(0, np.int64)] * len(COUNTS))
        for b, sums in zip(self.blocks, self.sums):
            b.clear()
            (self.plan.start if self.fresh else self.plan.step)(b, c, tables)
            out = out + sums.table(b.a, [getattr(b, n) for n in COUNTS])
            b.drop()
        self.fresh = False
        return out

    def size(self) -> int:
        return sum(len(w) for _, w in self.kept)

    def radius(self, c: np.ndarray) -> np.ndarray:
        out = np.zeros(len(c))
        for b in self.blocks:
            np.maximum.at(out, b.a, distance(b.x, c[b.a]))
        return out

    def reach(self, k: int) -> np.ndarray:
        """The largest upper bound of each label."""
        out = np.zeros(k)
        for b in self.blocks:
            np.maximum.at(out, b.a, b.u)
        return out

    def references(self) -> set[int]:
        return set().union(*(self.plan.references(b.own).tolist() for b in self.blocks))

    def rows(self, whole: bool) -> Iterator[pa.RecordBatch]:
        """The state; without ``whole`` the labels alone."""
        names = ["id", "x", "w", "a", "u", "l", "own", "rest"]
        for (id_, w), b in zip(self.kept, self.blocks):
            none = pa.nulls(len(w), pa.float64())
            if not self.plan.saved:
                b.own = b.own[:, :0]
            state = [pa.array(b.u), pa.array(b.l), _own_column(b)] if whole else [none, none, pa.nulls(len(w), pa.list_(pa.float64()))]
            x = pa.FixedSizeListArray.from_arrays(pa.array(b.x.ravel()), b.x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(id_), x, pa.array(w), pa.array(b.a.astype(np.int32)), *state, pa.nulls(len(w), pa.binary())], names)


def _iterations(name: str | Strategy, known: Context, fresh: bool, most: int, left: int):
    """Up to ``most`` iterations of ``left`` on the points of a barrier stage; one more row holds what the driver wants to know."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stage, plan, context = BarrierTaskContext.get(), _plan(name), pickle.loads(pickle.dumps(known))
        part, k, began = _Part(batches, plan, context.c, fresh), len(context.c), time.monotonic()
        seconds = seconds_between_saves(part.size())
        trace, converged, late, peers = [], False, False, Exchange(stage)

        def together(told: list[tuple]) -> tuple:
            tables, reach, referred = zip(*told)
            return sum(tables), np.maximum.reduce(reach) if plan.needs_reach else None, set().union(*referred), time.monotonic() - began > seconds

        def work() -> bool:
            table = part.passed(context.c, plan.tables(context))
            told = (table, part.reach(k) if plan.needs_reach else None, part.references() if plan.refers else ())
            table, context.reach, referred, late = peers.combined(told, together)
            context.summary = summarised(table, context.c.shape[1])
            context.open_share = _open_share(context.summary)
            trace.append(_work(context.summary))
            context.forget(referred)
            return late

        try:
            if fresh:
                late = work()
            done = 0
            while done < min(most, left) and not late and not converged:
                context.advance(updated(context.c, context.summary))
                if plan.needs_radius:
                    context.radius = peers.combined(part.radius(context.c), np.maximum.reduce)
                late = work()
                converged, done = not any(r["changed"] for r in trace[-1]), done + 1
        finally:
            peers.close()
        yield from part.rows(not converged and done < left)
        if stage.partitionId() == 0:
            rest = pickle.dumps((context, trace, converged))
            yield pa.RecordBatch.from_pydict({"id": pa.nulls(1, pa.int64()), "x": pa.nulls(1, pa.list_(pa.float64())), "w": pa.nulls(1, pa.int64()), "a": pa.nulls(1, pa.int32()), "u": pa.nulls(1, pa.float64()), "l": pa.nulls(1, pa.float64()), "own": pa.nulls(1, pa.list_(pa.float64())), "rest": [rest]})

    return go


def _in_memory(points: DataFrame, plan_name: str | Strategy, context: Context, most: int, folder: str, tasks: int, save: int) -> tuple[DataFrame, Context, bool, list]:
    spark, state, trace, fresh, before = points.sparkSession, points, [], True, None
    while True:
        left = most - context.it
        path = f"{folder}/{context.it}-{len(trace)}"
        run = state.mapInArrow(_iterations(plan_name, context, fresh, save, left), SAVED, barrier=True)
        found = materialise(run.repartition(tasks, "id"), path)  # Spark starts a barrier stage again only ahead of a shuffle
        context, more, converged = pickle.loads(found.filter("rest IS NOT NULL").select("rest").first()["rest"])
        trace += more
        if before:
            remove(spark, before)
        state, fresh, before = found.filter("rest IS NULL").drop("rest"), False, path
        if converged or context.it >= most:
            return state, context, converged, trace
        state = state.repartition(tasks, "id")


# --- the loop over jobs ---


def _pass(name: str | Strategy, c: np.ndarray, tables: dict, fresh: bool):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strategy = _plan(name)
        for record in batches:
            if not len(record):
                continue
            b = _batch(record, fresh)
            (strategy.start if fresh else strategy.step)(b, c, tables)
            columns = [record["id"], record["x"], record["w"], pa.array(b.a.astype(np.int32)), pa.array(b.u), pa.array(b.l), _own_column(b)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(getattr(b, n)) for n in COUNTS)], ["id", "x", "w", "a", "u", "l", "own", *COUNTS])

    return go


def _radius(state: DataFrame, c: np.ndarray) -> np.ndarray:
    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(len(c))
        for record in batches:
            a = record["a"].to_numpy()
            np.maximum.at(out, a, distance(_matrix(record["x"], len(record)), c[a]))
        yield pa.RecordBatch.from_pydict({"a": np.arange(len(c), dtype=np.int32), "r": out})

    out = np.zeros(len(c))
    for row in state.select("a", "x").mapInArrow(largest, "a int, r double").groupBy("a").agg(F.max("r").alias("r")).collect():
        out[row["a"]] = row["r"]
    return out


def _streamed(points: DataFrame, plan_name: str | Strategy, context: Context, most: int, folder: str) -> tuple[DataFrame, Context, bool, list]:
    spark, plan, width, trace, converged = points.sparkSession, _plan(plan_name), context.c.shape[1], [], False

    def work(state: DataFrame, fresh: bool) -> DataFrame:
        state = materialise(state.mapInArrow(_pass(plan_name, context.c, plan.tables(context), fresh), STATE), f"{folder}/{context.it}")
        context.summary = _summary(state, width)
        context.reach = np.zeros(len(context.c))
        for r in context.summary:
            context.reach[r["a"]] = r["reach"]
        trace.append(_work(context.summary))
        context.open_share = _open_share(context.summary)
        referred = state.select(F.col("own")[plan.refers].alias("since")).distinct().collect() if plan.refers else []  # at most one row an iteration
        context.forget({int(r["since"]) for r in referred})
        return state

    state = work(points, True)
    while context.it < most and not converged:
        context.advance(updated(context.c, context.summary))
        if plan.needs_radius:
            context.radius = _radius(state, context.c)
        state = work(state, False)
        remove(spark, f"{folder}/{context.it - 1}")
        converged = not any(r["changed"] for r in trace[-1])
    return state, context, converged, trace


def _by_label(points: DataFrame, plan_name: str | Strategy, context: Context, most: int, folder: str) -> tuple[DataFrame, Context, bool, list]:
    spark, plan, width, trace, converged = points.sparkSession, _plan(plan_name), context.c.shape[1], [], False
    parts = min(len(context.c), LABEL_PARTS)
    live: dict[int, list[str]] = {}  # the folders of each part
    sums: dict[str, list[dict]] = {}  # of each folder, by label
    referred: dict[str, set[int]] = {}
    part = F.pmod("a", F.lit(parts)).alias("part")

    def work(rows: DataFrame | None, tables: dict, read: list[int]) -> None:
        path, new = f"{folder}/{context.it}", []
        if rows is not None:
            state = rows.mapInArrow(_pass(plan_name, context.c, tables, not context.it), STATE).select("*", part)
            state.hint("rebalance", "part").write.partitionBy("part").option("compression", "zstd").parquet(path)
            written = spark.read.schema(STATE).parquet(path)
            new = _summary(written, width)
            seen = written.select(part, F.col("own")[plan.refers].alias("since")).distinct().collect() if plan.refers else []  # an iteration, a part
        for p in read:
            for old in live.pop(p, []):
                del sums[old]
                referred.pop(old, None)
                remove(spark, old)
        for r in new:
            own = f"{path}/part={r['a'] % parts}"
            if own not in sums:
                live.setdefault(r["a"] % parts, []).append(own)
            sums.setdefault(own, []).append(r)
        for r in seen if new else []:
            referred.setdefault(f"{path}/part={r['part']}", set()).add(int(r["since"]))
        context.summary = _merged([r for own in sums.values() for r in own])
        context.forget(set().union(*referred.values()))
        trace.append(_work(new))
        context.open_share = _open_share(new)

    work(points, plan.tables(context), [])
    while context.it < most and not converged:
        context.advance(updated(context.c, context.summary))
        tables = plan.tables(context)
        read = sorted({j % parts for j in np.flatnonzero(~tables["stable"]).tolist()} & set(live))
        paths = [path for p in read for path in live[p]]
        context.read.append(sum(r["rows"] for path in paths for r in sums[path]))
        work(spark.read.schema(STATE).parquet(*paths) if paths else None, tables, read)
        converged = not any(r["changed"] for r in trace[-1])
    state = spark.read.schema(STATE).parquet(*(path for own in live.values() for path in own)) if live else points.withColumn("a", F.lit(0))
    return state, context, converged, trace


def _merged(rows: list[dict]) -> list[dict]:
    """One row a cluster: the sums of its rows in all folders."""
    out: dict[int, dict] = {}
    for r in rows:
        own = out.setdefault(r["a"], {"a": r["a"]})
        for name, v in r.items():
            if name != "a":
                own[name] = own.get(name, 0) + v
    return list(out.values())


# --- runs ---


def _plan(name: str | Strategy) -> Strategy:
    return STRATEGIES[name] if isinstance(name, str) else name


def choose_strategy(k: int, d: int) -> str:
    """A default by what was fastest for 100,000 points of a mixture: one bound a point for some centroids, candidates
    around the assigned one for many. Walks evaluate the fewest distances but pay for their graphs."""
    if k < 8:
        return "lloyd"
    if k < 96:
        return "hamerly"
    return "exponion" if d <= 4 else "yinyang"


def slots(spark: SparkSession) -> int:
    """Tasks that run at once; 0 where the cluster's size may change, as a barrier stage must start as a whole."""
    if spark.conf.get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return 0
    context = spark.sparkContext._jsc.sc()
    return int(context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile()))


def seconds_between_saves(rows: int) -> float:
    """By the rows of a task, so that saving stays a small part of the run."""
    return SECONDS * max(1.0, rows / SAVED_ROWS)


def tasks_in_memory(available: int, rows: int, k: int, d: int, own: float) -> int:
    """Tasks of the barrier stage: as many as there are, as long as what they send stays within EXCHANGED; 0 if
    these can't hold the state."""
    message = 8 * k * (7 + 6 * d)
    tasks = min(available, MOST_TASKS, max(1, EXCHANGED // message))
    return tasks if rows * 8 * (12 + 2 * d + 1.25 * own) <= tasks * HELD else 0


def run(points: DataFrame, centroids: np.ndarray, strategy: str | Strategy = "auto", max_iterations: int = 500, in_memory: bool | None = None, save: int = SAVE) -> Result:
    """Exact k-means from given centroids over (id, x, w).

    Stops after the first pass without a change, which counts as an iteration. If ``max_iterations`` ends the
    run, the centroids are those of the last assignment. With 0, the labels are the first assignment. ``in_memory`` fixes the way
    of the loop, which otherwise depends on what fits; both give the same result. ``save`` iterations are run between
    two copies of the state.
    """
    c = np.ascontiguousarray(centroids, np.float64)
    if c.ndim != 2 or not len(c) or not np.isfinite(c).all():
        raise ValueError("centroids must be a finite matrix with at least one row")
    name = choose_strategy(*c.shape) if strategy == "auto" else strategy
    if isinstance(name, str) and name not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; there are {', '.join(STRATEGIES)}")
    spark, plan, context, width = points.sparkSession, _plan(name), Context(c), c.shape[1]
    folder, seen = shared_folder(spark), Observation()
    ends = [f(F.col("x")[t]).alias(f"{n}{t}") for t in range(min(2, width)) for n, f in (("low", F.min), ("high", F.max))]
    table = validated(points.select("id", "x", "w"), width).observe(seen, F.count(F.lit(1)).alias("rows"), *ends)
    table, box = materialise(table, f"{folder}/points"), seen.get
    tasks = tasks_in_memory(slots(spark), box["rows"], len(c), width, plan.held(len(c))) if in_memory is not False else 0
    if in_memory and not tasks:
        raise ValueError("the state does not fit in the memory of the tasks that run at once, or their number may change")
    parts = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = plan.in_z_order and width >= 2 and box["rows"]
    table = z_order(table, box, parts) if ordered else table.repartition(parts)
    if tasks:
        state, context, converged, trace = _in_memory(table, name, context, max_iterations, folder, tasks, save)
    else:
        state, context, converged, trace = (_by_label if plan.skips else _streamed)(table, name, context, max_iterations, folder)
    remove(spark, f"{folder}/points")
    metrics = {n: sum(int(r[n]) for rows in trace for r in rows) for n in COUNTS[1:]}
    metrics |= {"rebuilds": context.rebuilds, "fallbacks": context.fallbacks, "repairs": context.repairs, "tasks": parts, "snapshots": context.most_snapshots}
    if context.read:  # rows of each iteration, where stable clusters are skipped
        metrics |= {"rows_read": sum(context.read), "least_rows_read": min(context.read)}
    if context.degrees:  # of the graphs that the run built
        metrics |= {"mean_degree": sum(m for m, _ in context.degrees) / len(context.degrees), "most_degree": max(m for _, m in context.degrees), "graphs": len(context.degrees)}
    return Result(state.select("id", "x", "w", "a"), context.c, context.it, converged, metrics, trace, context.drifts)
