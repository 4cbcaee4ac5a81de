"""Hard negatives by inner product, found through a table of pivot distances.

1. Vectors become whole numbers. A vector x is augmented by sqrt(M - |x|^2), M being the largest square of a norm, and an
   anchor by 0; then the inner product is (|a|^2 + M - distance^2) / 2, and a triangle inequality over the stored distances to
   PIVOTS pivots brackets every score from both sides. Pivots are drawn from a bounded sample; they decide speed alone.
2. Rows are sorted by nearest pivot and distance into blocks of ROWS, each with the least and greatest distance to each pivot.
   Blocks are dealt to parts. Anchors are dealt to groups of about ANCHORS, and a group visits all parts: blocks of the query
   set against blocks of all rows, of which one block is held at a time.
3. First pass: an anchor's highest rows of its label. A block, then a row, is passed over if its bracket ends below what the
   anchor has found already; survivors are scored exactly. The parts' finds are merged by Spark.
4. Second pass: each positive's score gives a window, and its highest rows of other labels are sought alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import storage
from quarry.llm.common import bounded_batches, materialise, partitions, tidied

PIVOTS, SAMPLE, ROWS, ANCHORS = 8, 1000, 1024, 4096
#: Blocks that a part has at least; components are cut at this magnitude, so squares stay finite.
PART_BLOCKS, LARGEST = 4, float(1 << 40)
POSITIVES, NEGATIVES = 5, 10
#: A negative's score is at least and at most so many hundredths of the positive's.
LEAST, MOST = 30, 90

_FIELDS = ("row", "id", "none", "label", "q", "t")


def _choose(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows far apart: each the farthest from those before."""
    chosen, far = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(count, len(sample)):
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(far.argmax()))
    return sample[chosen]


def _whole(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as whole numbers; shorter ones are padded with zeros."""
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    flat = np.floor(256.0 * flat).clip(-LARGEST, LARGEST)
    size = np.diff(offsets)
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], size)] = flat[offsets[0] : offsets[-1]]
    return out


def _distances(q: np.ndarray, lift: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """From augmented vectors to augmented pivots."""
    own = np.concatenate([q, lift[:, None]], axis=1)
    return np.stack([np.sqrt(((own - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def _tabled(width: int, largest: float, pivots: np.ndarray):
    """Rows with their distances to the pivots, as rows and (``anchor_t``) as anchors."""

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            q = _whole(batch["x"], width)
            t = _distances(q, np.sqrt(np.maximum(largest - (q**2).sum(axis=1), 0.0)), pivots)
            as_anchor = _distances(q, np.zeros(len(q)), pivots)
            cell = t.argmin(axis=1)
            lists = lambda m: pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], pa.array(m.ravel()))
            columns = [batch["row"], batch["id"], batch["label"], lists(q.astype(np.int64)), lists(t), lists(as_anchor), pa.array(cell.astype(np.int32)), pa.array(t[np.arange(len(t)), cell])]
            yield pa.RecordBatch.from_arrays(columns, ["row", "id", "label", "q", "t", "anchor_t", "cell", "dist"])

    return table


_PACK = pa.schema([("row", pa.binary()), ("id", pa.binary()), ("none", pa.binary()), ("label", pa.binary()), ("q", pa.binary()), ("t", pa.binary()), ("windows", pa.binary()), ("wanted", pa.binary())])


def _packing(size: int):
    """``size`` successive rows (with positives, if there are) become one."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            for low in range(0, len(table), size):
                some = table.slice(low, size).combine_chunks()
                flat = lambda name, kind: np.asarray(some[name].combine_chunks().flatten(), kind).tobytes()
                ids = some["id"]
                windows = wanted = None
                if "positives" in some.column_names:
                    score, key = np.full((len(some), POSITIVES), -1, np.int64), np.zeros((len(some), POSITIVES, 2), np.int64)
                    for i, own in enumerate(some["positives"].to_pylist()):
                        for j, p in enumerate(own or []):
                            score[i, j], key[i, j] = p["score"], (p["id"] or 0, p["id"] is None)
                    windows, wanted = score.tobytes(), key.tobytes()
                values = [np.asarray(some["row"]).tobytes(), ids.fill_null(0).to_numpy().tobytes(), np.asarray(ids.is_null()).tobytes(), np.asarray(some["label"], np.int64).tobytes(), flat("q", np.int64), flat("t", np.float64), windows, wanted]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], schema=_PACK)

        count = 0
        for batch in batches:
            while len(batch):
                take = min(len(batch), size - count)
                held.append(batch.slice(0, take))
                batch, count = batch.slice(take), count + take
                if count == size:
                    yield from out()
                    count = 0
        if held:
            yield from out()

    return pack


def _packed(rows: DataFrame, size: int) -> DataFrame:
    return rows.mapInArrow(_packing(size), "row binary, id binary, none binary, label binary, q binary, t binary, windows binary, wanted binary")


class _Set:
    """Some packed rows as arrays."""

    def __init__(self, packs: list[dict]) -> None:
        join = lambda name, kind: np.frombuffer(b"".join(p[name] for p in packs), kind)
        self.row, self.id, self.none, self.label = join("row", np.int64), join("id", np.int64), join("none", bool), join("label", np.int64)
        n = len(self.row)
        self.q = join("q", np.int64).reshape(n, -1).astype(np.float64)
        self.t = join("t", np.float64).reshape(n, -1)
        if packs[0]["windows"] is not None:
            self.windows, self.wanted = join("windows", np.int64).reshape(n, -1), join("wanted", np.int64).reshape(n, -1, 2)


def brackets(square: np.ndarray, largest: float, a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the scores of anchors (distances ``a``, squares of norms) with rows whose distances lie from ``low`` to
    ``high``, a table of anchors and rows. Rounding is allowed for."""
    near, far = np.zeros((len(a), len(low))), np.full((len(a), len(low)), np.inf)
    for k in range(a.shape[1]):
        own = a[:, k][:, None]
        np.maximum(near, np.maximum(low[:, k][None, :] - own, own - high[:, k][None, :]), out=near)
        np.minimum(far, own + high[:, k][None, :], out=far)
    whole = square[:, None] + largest
    slack = 1e-9 * whole + 1
    return (whole - far**2) / 2 - slack, (whole - near**2) / 2 + slack


def _scores(a: np.ndarray, q: np.ndarray, small: bool) -> np.ndarray:
    """Exact inner products, at most as large as a long may be."""
    if small:
        return (a @ q.T).astype(np.int64)
    out = a.astype(np.int64).astype(object) @ q.astype(np.int64).astype(object).T
    edge = (1 << 63) - 1
    return np.array([[max(-edge, min(edge, v)) for v in row] for row in out.tolist()], np.int64).reshape(len(a), len(q))


class _Finder:
    """What a group of anchors has found in a part: for each anchor and window (from ``floor`` to ``ceiling``) the ``most``
    highest scores; ties go to the smaller id, null last."""

    def __init__(self, anchors: _Set, floor: np.ndarray, ceiling: np.ndarray, most: int, same: bool, largest: float, small: bool) -> None:
        self.a, self.floor, self.ceiling, self.most, self.same, self.largest, self.small = anchors, floor, ceiling, most, same, largest, small
        self.square = (anchors.q**2).sum(axis=1)
        self.bar = floor.copy()  # what a score must reach to be of use
        self.found = {}

    def see(self, b: _Set) -> None:
        low, high = brackets(self.square, self.largest, self.a.t, b.t.min(axis=0)[None, :], b.t.max(axis=0)[None, :])
        useful = ((high >= self.bar) & (low <= self.ceiling)).any(axis=1)
        for first in range(0, int(useful.sum()), 256):
            self._look(b, np.flatnonzero(useful)[first : first + 256])

    def _look(self, b: _Set, at: np.ndarray) -> None:
        low, high = brackets(self.square[at], self.largest, self.a.t[at], b.t, b.t)
        own = (self.a.label[at][:, None] == b.label[None, :]) == self.same
        own &= self.a.row[at][:, None] != b.row[None, :]
        may = own & (high >= self.bar[at].min(axis=1)[:, None]) & (low <= self.ceiling[at].max(axis=1)[:, None])
        rows = np.flatnonzero(may.any(axis=0))
        if not len(rows):
            return
        score = _scores(self.a.q[at], b.q[rows], self.small)
        may = may[:, rows]
        for i, a in enumerate(at.tolist()):
            hit = np.flatnonzero(may[i] & (score[i] >= self.bar[a].min()))
            for w in range(self.floor.shape[1]):
                s = score[i, hit]
                inside = (s >= self.bar[a, w]) & (s <= self.ceiling[a, w])
                if inside.any():
                    self._keep((a, w), s[inside], b, rows[hit[inside]])

    def _keep(self, key: tuple[int, int], score: np.ndarray, b: _Set, rows: np.ndarray) -> None:
        new = [score, b.none[rows].astype(np.int64), b.id[rows], b.row[rows]]
        if key in self.found:
            new = [np.concatenate(x) for x in zip(self.found[key], new)]
        best = np.lexsort((new[3], new[2], new[1], -new[0]))[: self.most]
        self.found[key] = [x[best] for x in new]
        if len(best) == self.most:
            self.bar[key] = max(self.bar[key], self.found[key][0][-1])

    def rows(self) -> Iterator[tuple]:
        for (a, w), own in self.found.items():
            for score, none, id_, row in zip(*(x.tolist() for x in own)):
                yield a, w, score, None if none else id_, row


def _searching(negatives: bool, largest: float, small: bool):
    names = ["anchor", "anchor_id", "place", "positive_id", "positive_score", "score", "id", "row"]
    schema = pa.schema([(n, pa.int64()) for n in names])

    @tidied
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, packs, finder = None, [], None

        def begin() -> _Finder:
            a, edge = _Set(packs), np.iinfo(np.int64).max
            if not negatives:
                return _Finder(a, np.full((len(a.row), 1), -edge), np.full((len(a.row), 1), edge), POSITIVES, True, largest, small)
            sound = a.windows > -1  # a positive of a negative score has an empty window
            floor = np.where(sound, -((-LEAST * a.windows.astype(object)) // 100), edge).astype(np.int64)
            return _Finder(a, floor, np.where(sound, (MOST * a.windows.astype(object)) // 100, -edge).astype(np.int64), NEGATIVES, False, largest, small)

        def done() -> Iterator[pa.RecordBatch]:
            out = [[] for _ in names]
            for a, w, score, id_, row in finder.rows():
                wanted = (None, None) if not negatives else (None if finder.a.wanted[a, w, 1] else int(finder.a.wanted[a, w, 0]), int(finder.a.windows[a, w]))
                for column, v in zip(out, (int(finder.a.row[a]), int(finder.a.id[a]), w, *wanted, score, id_, row)):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=schema)

        for batch in batches:
            for row in batch.to_pylist():
                if (row["group"], row["part"]) != key:
                    if finder:
                        yield from done()
                    key, packs, finder = (row["group"], row["part"]), [], None
                if row["role"] == 0:
                    packs.append(row)
                elif packs:
                    finder = finder or begin()
                    finder.see(_Set([row]))
        if finder:
            yield from done()

    return search


def _met(anchors: DataFrame, blocks: DataFrame, groups: int, parts: int, negatives: bool, largest: float, small: bool) -> DataFrame:
    """What each group of anchors finds in each part."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    both = anchors.withColumn("part", every(parts)).withColumn("role", F.lit(0)).unionByName(blocks.withColumn("group", every(groups)).withColumn("role", F.lit(1)))
    dealt = both.repartition(partitions(anchors.sparkSession), "group", "part").sortWithinPartitions("group", "part", "role")
    return dealt.mapInArrow(_searching(negatives, largest, small), "anchor long, anchor_id long, place long, positive_id long, positive_score long, score long, id long, row long")


def _best(found: DataFrame, by: list[str], most: int) -> DataFrame:
    """The parts' finds, merged: at most ``most`` a part."""
    order = f"row_number() OVER (PARTITION BY {', '.join(by)} ORDER BY score DESC, id ASC NULLS LAST, row)"
    return found.withColumn("rank", F.expr(order)).filter(F.col("rank") <= most)


def mined(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = 100, moved: int = 7, labels: int = 10, anchors: int = ANCHORS, block: int = ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows whose id is divisible by ``every``.

    Rows with a null label, a null vector, or a null, NaN or infinite component take no part. Where the id is divisible by ``moved`` the label
    first becomes (label + 1) % ``labels``. A component x becomes floor(256 * x), cut at 2**40; scores are exact, and cut to what
    a long holds. Ties go to the smaller id. A null id is no anchor, keeps its label and comes last in ties. Rows of one id are
    rows of their own: each is an anchor, and one can be the other's positive or negative. Vectors of unlike length are compared
    as if padded with zeros; an empty one scores 0. A positive of a score below zero has no negatives, one of zero those
    of zero. Without an anchor, or from an empty table, the result is empty. Further columns are not read.
    """
    spark = bounded_batches(vectors).sparkSession
    sound = F.col(vector_col).isNotNull() & F.col(label_col).isNotNull() & F.forall(vector_col, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    own = F.when(F.coalesce(F.col(id_col) % moved == 0, F.lit(False)), (F.col(label_col).cast("long") + 1) % labels).otherwise(F.col(label_col).cast("long"))
    rows = vectors.filter(sound).select(F.col(id_col).cast("long").alias("id"), own.alias("label"), F.transform(vector_col, lambda v: v.cast("double")).alias("x"))
    answer = storage.shared_folder(spark)
    with storage.scope(spark):
        rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
        whole = F.transform("x", lambda v: F.least(F.greatest(F.floor(v * 256.0).cast("double"), F.lit(-LARGEST)), F.lit(LARGEST)))
        measured = rows.select(whole.alias("q"), F.size("x").alias("d")).select("d", F.aggregate("q", F.lit(0.0), lambda s, v: s + v * v).alias("square"))
        size, width, largest = measured.agg(F.count("*"), F.max("d"), F.max("square")).first()
        width, largest = max(1, width or 0), largest or 0.0
        sample = rows.orderBy(F.xxhash64("id", "row")).limit(SAMPLE).select("x").toArrow()["x"].combine_chunks()  # SAMPLE rows
        q = _whole(sample, width) if len(sample) else np.zeros((1, width))
        pivots = _choose(np.concatenate([q, np.sqrt(np.maximum(largest - (q**2).sum(axis=1), 0.0))[:, None]], axis=1), PIVOTS)
        small = largest < 2.0**52  # then no partial sum of a product leaves the whole numbers of a double
        table = rows.mapInArrow(_tabled(width, largest, pivots), "row long, id long, label long, q array<long>, t array<double>, anchor_t array<double>, cell int, dist double")
        table = materialise(table, "pivots")
        order = ["cell", "dist", "row"]
        blocks = table.drop("anchor_t").repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
        parts = max(1, min(partitions(spark), -(-size // (block * PART_BLOCKS))))
        blocks = materialise(_packed(blocks.drop("cell", "dist"), block).withColumn("part", F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(parts)).cast("int")), "blocks")
        queries = materialise(table.filter(F.col("id") % every == 0).select("row", "id", "label", "q", F.col("anchor_t").alias("t")), "anchors")
        groups = max(1, -(-queries.count() // anchors))
        grouped = lambda df: df.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))

        def by_group(df: DataFrame) -> DataFrame:
            """Packed anchors of a group; a group's are few, so a task packs some whole groups."""
            columns = ["row", "id", "label", "q", "t", *(["positives"] if "positives" in df.columns else [])]
            items = grouped(df).groupBy("group").agg(F.collect_list(F.struct(*columns)).alias("items"))
            return _regrouped(items, columns)

        found = materialise(_met(by_group(queries), blocks, groups, parts, False, largest, small), "near")
        positives = _best(found, ["anchor"], POSITIVES).groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "id"))).alias("positives"))
        wanted = materialise(queries.join(positives.withColumnRenamed("anchor", "row"), "row"), "wanted")
        found = _met(by_group(wanted), blocks, groups, parts, True, largest, small)
        best = _best(found, ["anchor", "place"], NEGATIVES)
        best = best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        return storage.materialise(best, f"{answer}/negatives")


def _regrouped(items: DataFrame, columns: list[str]) -> DataFrame:
    """One packed row for each group's items."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                own = pa.RecordBatch.from_struct_array(batch["items"][k].values)
                for record in _packing(max(1, len(own)))(iter([own])):
                    yield pa.RecordBatch.from_arrays([batch["group"].slice(k, 1), *record.columns], ["group", *record.schema.names])

    return items.mapInArrow(pack, "group int, row binary, id binary, none binary, label binary, q binary, t binary, windows binary, wanted binary")


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 10
"""
