"""Generators. Random numbers come from (id, stream, seed) by plain arithmetic, so they don't depend on partitions and
any SQL engine repeats them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(key: Column, stream: int, seed: int) -> Column:
    """In (0, 1), of 31 bits."""
    return (lcg(key.cast("long") * 1024 + stream, seed * 7919 + stream * 104729 + 1).cast("double") + 0.5) / float(1 << 31)


def lcg(key: Column, seed: int) -> Column:
    """A whole number below 2**31 by plain arithmetic, which any SQL engine repeats."""
    step = lambda v: F.pmod(v * 1103515245 + 12345, F.lit(1 << 31))
    return step(F.shiftright(step(F.pmod(key, F.lit(1 << 31)) + seed), 3) * 7 + F.pmod(key, F.lit(1 << 20)))


def _ids(spark: SparkSession, n: int | DataFrame) -> DataFrame:
    """So many ids, or those of a table."""
    return spark.range(n) if isinstance(n, int) else n.select(F.col("id").cast("long").alias("id"))


def blobs(spark: SparkSession, n: int | DataFrame, d: int, k: int, seed: int = 0, spread: float = 0.6, box: float = 10.0) -> DataFrame:
    """A Gaussian mixture (id, x, w, label): uniform centres, a uniform label a point, Box-Muller noise. ``n`` here and below is a number
    or a table with ids."""
    label = F.floor(uniform(F.col("id"), 0, seed) * k).cast("int")
    def axis(t: int) -> Column:
        centre = (uniform(F.col("label"), 100 + t, seed) * 2 - 1) * box
        noise = F.sqrt(-2 * F.ln(uniform(F.col("id"), 1 + 2 * t, seed))) * F.cos(2 * math.pi * uniform(F.col("id"), 2 + 2 * t, seed))
        return centre + noise * spread
    return _ids(spark, n).withColumn("label", label).select("id", F.array(*map(axis, range(d))).alias("x"), F.lit(1).cast("long").alias("w"), "label")


def _points(df: DataFrame, *axes: Column) -> DataFrame:
    return df.select("id", F.array(*(a.cast("double") for a in axes)).alias("x"), F.lit(1).cast("long").alias("w"))


def grid(spark: SparkSession, side: int, n: int | DataFrame | None = None) -> DataFrame:
    return _points(_ids(spark, side * side if n is None else n), F.floor(F.col("id") / side), F.pmod("id", F.lit(side)))


def collinear(spark: SparkSession, n: int | DataFrame, seed: int = 0) -> DataFrame:
    t = uniform(F.col("id"), 0, seed)
    return _points(_ids(spark, n), t, 2 * t + 1)


def circle(spark: SparkSession, n: int | DataFrame, seed: int = 0) -> DataFrame:
    angle = 2 * math.pi * uniform(F.col("id"), 0, seed)
    return _points(_ids(spark, n), F.cos(angle), F.sin(angle))


def overlapping(spark: SparkSession, n: int | DataFrame, d: int, k: int, seed: int = 0) -> DataFrame:
    """A mixture whose clusters run into each other: deviations as wide as the box."""
    return blobs(spark, n, d, k, seed, spread=10.0).drop("label")


def repeated(points: DataFrame, times: int) -> DataFrame:
    """Each point so many times, under ids of its own."""
    copies = points.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return copies.withColumn("id", F.col("id") * times + F.col("copy")).drop("copy")


def scaled(points: DataFrame, by: float) -> DataFrame:
    return points.withColumn("x", F.transform("x", lambda v: v * by))
