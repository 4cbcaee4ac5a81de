"""Comparing clusterings (id, a)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.model import Result


def is_exact(one: DataFrame, other: DataFrame) -> DataFrame:
    """One row: rows only in the first, rows only in the second, and whether both agree."""
    left, right = one.select("id", "a"), other.select("id", "a")
    counts = left.exceptAll(right).agg(F.count("*").alias("only_first")).crossJoin(right.exceptAll(left).agg(F.count("*").alias("only_second")))  # one row each
    return counts.withColumn("exact", (F.col("only_first") == 0) & (F.col("only_second") == 0))


def runs_agree(one: Result, other: Result) -> DataFrame:
    """As ``is_exact`` of the labels, with iterations and centroids: ``exact`` asks for all three to be the same to the last bit."""
    same = one.iterations == other.iterations and np.array_equal(one.centroids, other.centroids)
    table = is_exact(one.labels, other.labels).withColumn("exact", F.col("exact") & F.lit(bool(same)))
    return table.withColumns({"iterations": F.lit(one.iterations), "centroid_gap": F.lit(centroid_gap(one.centroids, other.centroids))})


def centroid_gap(one: np.ndarray, other: np.ndarray) -> float:
    """The largest absolute difference of a coordinate; infinite if there are not as many centroids."""
    return float(np.abs(one - other).max()) if one.shape == other.shape else float("inf")


def same_partition(one: DataFrame, other: DataFrame) -> DataFrame:
    """Whether the labels are the same up to renaming: as many pairs as labels on either side."""
    pairs = one.select("id", F.col("a").alias("one")).join(other.select("id", F.col("a").alias("other")), "id").select("one", "other").distinct()
    counts = pairs.agg(F.count("*").alias("pairs"), F.countDistinct("one").alias("ones"), F.countDistinct("other").alias("others"))
    return counts.withColumn("same", (F.col("pairs") == F.col("ones")) & (F.col("pairs") == F.col("others")))


def label_differences(one: DataFrame, other: DataFrame) -> DataFrame:
    both = one.select("id", F.col("a").alias("one")).join(other.select("id", F.col("a").alias("other")), "id", "full_outer")
    return both.agg(F.count_if(~F.col("one").eqNullSafe(F.col("other"))).alias("different"), F.count("*").alias("rows"))


def confusion(labels: DataFrame, truth: DataFrame) -> DataFrame:
    return labels.select("id", "a").join(truth.select("id", "label"), "id").groupBy("label", "a").agg(F.count("*").alias("n"))
