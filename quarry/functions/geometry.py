"""Geometry as column expressions: they stay in whole-stage code generation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distance(axes: list[Column], centroid: list[float] | list[Column]) -> Column:
    """Squares are products, summed in order; the root is what is compared."""
    total = None
    for x, c in zip(axes, centroid):
        gap = x - (c if isinstance(c, Column) else F.lit(float(c)))
        total = gap * gap if total is None else total + gap * gap
    return F.sqrt(total)


def nearest(df: DataFrame, axes: list[str], c: np.ndarray) -> DataFrame:
    """``df`` with label ``a``, ``u`` (nearest) and ``l`` (second nearest): unrolled, for few centroids.

    The least of the distances, then the first centroid that has it; no shuffle and no Python.
    """
    columns = [F.col(x) for x in axes]
    df = df.withColumns({f"_d{j}": distance(columns, row) for j, row in enumerate(c.tolist())})
    d = [F.col(f"_d{j}") for j in range(len(c))]
    u = F.least(*d) if len(d) > 1 else d[0]
    df = df.withColumn("u", u)
    df = df.withColumn("a", F.coalesce(*(F.when(x == F.col("u"), F.lit(j)) for j, x in enumerate(d))))
    second = F.array_min(F.array(*(F.when(F.col("a") != j, x) for j, x in enumerate(d)))) if len(d) > 1 else F.lit(None).cast("double")
    return df.withColumn("l", second).drop(*(f"_d{j}" for j in range(len(c))))


def z_key(x: Column, y: Column, bits: int = 16) -> Column:
    """The Z-order key of two whole numbers of ``bits`` bits."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        for shift, v in ((2 * b, x), (2 * b + 1, y)):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(v, b).bitwiseAND(F.lit(1).cast("long")), shift))
    return out


def z_order(df: DataFrame, box: dict, parts: int) -> DataFrame:
    """Points by range of their Z-order key over the first two axes of a box (low0, high0, low1, high1): one range shuffle."""
    scaled = [((F.col("x")[t] - box[f"low{t}"]) / F.lit(box[f"high{t}"] - box[f"low{t}"] + 1e-300) * 65535.0).cast("long") for t in (0, 1)]
    return df.withColumn("_z", z_key(*scaled)).repartitionByRange(parts, "_z", "id").sortWithinPartitions("_z").drop("_z")
