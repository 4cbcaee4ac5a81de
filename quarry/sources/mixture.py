"""A mixture of clusters on whole-number coordinates, from arithmetic that any SQL engine repeats.

For each part five points; each belongs to one of ``k`` centres in a box and lies around it by the sum of four
uniform numbers. Coordinates are in thousandths, so sums of them are exact everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.generate import lcg

POINTS, BOX, STEP = 5, 20_000, 1_040


def _numbers(key: np.ndarray, seed: int) -> np.ndarray:
    """As ``generate.lcg``: as columns the many draws of a point are a method too long for the compiler."""
    step = lambda v: (v * 1103515245 + 12345) & (1 << 31) - 1
    return step((step((key & (1 << 31) - 1) + seed) >> 3) * 7 + (key & (1 << 20) - 1))


def _draw(key: np.ndarray, stream: int, below: int) -> np.ndarray:
    return (_numbers(key * 64 + stream, stream * 7919 + 1) >> 11) % below


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("part"))
    rows = rows.repartition(spark.sparkContext.defaultParallelism, "part")  # keys of a small file are work for all tasks
    return rows.select(F.explode(F.array(*(F.col("part") * POINTS + i for i in range(POINTS)))).alias("id"))


def _vectors(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel().astype(np.float64)), x.shape[1]).cast(pa.list_(pa.float64()))


def _placed(rows: DataFrame, d: int, k: int, moved: bool = False) -> DataFrame:
    """(id, x, w) of ids; with ``moved`` also y, the place after a move."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            id_ = record["id"].to_numpy(zero_copy_only=not record["id"].null_count)
            if record["id"].null_count or (np.abs(id_) >= 1 << 56).any():
                raise ValueError("keys of parts must be there and below 2**53")
            label = _draw(id_, 63, k)
            x = np.stack([_draw(label, 40 + t, BOX) - BOX // 2 + sum(_draw(id_, 4 * t + i, STEP) for i in range(4)) - 2 * STEP for t in range(d)], axis=1)
            out = {"id": record["id"], "x": _vectors(x), "w": pa.array(np.ones(len(id_), np.int64))}
            if moved:
                by = np.stack([_draw(id_, 51 + t, 2 * SHIFT + 1) - SHIFT for t in range(d)], axis=1)
                out["y"] = _vectors(x + np.where(_draw(id_, 50, 3)[:, None] == 0, by, 0))
            yield pa.RecordBatch.from_pydict(out)

    return rows.mapInArrow(go, "id long, x array<double>, w long" + (", y array<double>" if moved else ""))


def mixture(spark: SparkSession, sf_dir: str, d: int, k: int) -> DataFrame:
    """(id, x, w), five rows a part."""
    return _placed(_ids(spark, sf_dir), d, k)


def drawn(spark: SparkSession, sf_dir: str, d: int, k: int) -> DataFrame:
    """The points of the ``k`` least hashes of the id; only these are made."""
    rows = _ids(spark, sf_dir).select("id", lcg(F.col("id"), 5).alias("draw")).orderBy("draw", "id").limit(k)
    return _placed(rows.select("id"), d, k)


def first_centroids(spark: SparkSession, sf_dir: str, d: int, k: int) -> np.ndarray:
    found = drawn(spark, sf_dir, d, k).withColumn("draw", lcg(F.col("id"), 5)).orderBy("draw", "id")
    return np.array([r["x"] for r in found.collect()], float)


def _lcg(key: str, seed: int) -> str:
    return f"((((({key} % 2147483648 + {seed}) * 1103515245 + 12345) % 2147483648 >> 3) * 7 + {key} % 1048576) * 1103515245 + 12345) % 2147483648"


def sql(d: int, k: int) -> str:
    """CTEs pts (id, x0 ..., w) and c0 (j, c0 ...)."""
    draw = lambda key, stream, below: f"((({_lcg(f'({key} * 64 + {stream})', stream * 7919 + 1)}) >> 11) % {below})"
    axis = lambda t: f"CAST({draw('label', 40 + t, BOX)} - {BOX // 2} + {' + '.join(draw('id', 4 * t + i, STEP) for i in range(4))} - {2 * STEP} AS BIGINT) AS x{t}"
    axes = [f"x{t}" for t in range(d)]
    return (
        f"ids AS (SELECT CAST(p_partkey AS BIGINT) * {POINTS} + i AS id FROM part, range({POINTS}) t(i)), labels AS (SELECT id, {draw('id', 63, k)} AS label FROM ids), "
        f"pts AS MATERIALIZED (SELECT id, {', '.join(map(axis, range(d)))}, 1 AS w FROM labels), "
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY draw, id) - 1 AS j, {', '.join(f'CAST({x} AS DOUBLE) AS c{t}' for t, x in enumerate(axes))} FROM (SELECT *, {_lcg('id', 5)} AS draw FROM pts) ORDER BY draw, id LIMIT {k})"
    )


#: Centroids of a group by dimension (the SQL looks at all simplices of a group), and how far they move.
GROUP, SHIFT = {2: 25, 3: 20, 4: 10}, 200


def sites(spark: SparkSession, sf_dir: str, d: int) -> DataFrame:
    """(g, j, x, y): the points in small groups, as sets of centroids; every third one has moved a little (y)."""
    rows = _placed(_ids(spark, sf_dir), d, 64, moved=True)
    return rows.select(F.floor(F.col("id") / GROUP[d]).alias("g"), F.pmod("id", F.lit(GROUP[d])).cast("int").alias("j"), "x", "y")


def sites_sql(d: int) -> str:
    """CTEs b (before) and c (after): g, j, c0 ..."""
    draw = lambda stream, below: f"((({_lcg(f'(id * 64 + {stream})', stream * 7919 + 1)}) >> 11) % {below})"
    place = f"id // {GROUP[d]} AS g, CAST(id % {GROUP[d]} AS INTEGER) AS j"
    now = ", ".join(f"x{t} + CASE WHEN {draw(50, 3)} = 0 THEN {draw(51 + t, 2 * SHIFT + 1)} - {SHIFT} ELSE 0 END AS c{t}" for t in range(d))
    return f"{sql(d, 64)}, b AS MATERIALIZED (SELECT {place}, {', '.join(f'x{t} AS c{t}' for t in range(d))} FROM pts), c AS MATERIALIZED (SELECT {place}, {now} FROM pts)"
