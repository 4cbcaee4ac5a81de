"""Points, centroids and results."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Coordinates are summed exactly as fixed-point numbers; beyond this magnitude they would not fit.
LARGEST = float(1 << 41)


def points(df: DataFrame, id_col: str, axes: list[str], weight_col: str | None = None) -> DataFrame:
    """(id, x, w) from one column an axis. A weight stands for so many equal points."""
    weight = F.col(weight_col).cast("long") if weight_col else F.lit(1).cast("long")
    return df.select(F.col(id_col).cast("long").alias("id"), F.array(*(F.col(c).cast("double") for c in axes)).alias("x"), weight.alias("w"))


def validated(df: DataFrame, width: int) -> DataFrame:
    """``df`` with a check inside the plan: null, NaN, infinite, too large or ragged vectors fail the job."""
    sound = F.coalesce((F.size("x") == width) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= LARGEST)), F.lit(False))
    return df.withColumn("x", F.when(sound, F.col("x")).otherwise(F.raise_error(F.concat(F.lit("bad vector at id "), F.coalesce(F.col("id").cast("string"), F.lit("null"))))))


def exact_sums(axis: Column, weight: Column) -> tuple[Column, Column]:
    """Two whole numbers whose sums give the sum of ``axis`` to 2**-60 in any order of addition."""
    scaled = axis * float(1 << 20)
    high = F.floor(scaled)
    low = F.rint((scaled - high) * float(1 << 40))
    as_whole = lambda c: F.sum(c.cast("decimal(38,0)") * weight.cast("decimal(19,0)"))
    return as_whole(high.cast("decimal(20,0)")), as_whole(low.cast("decimal(20,0)"))


def exact_mean(high: int, low: int, count: int) -> float:
    return ((int(high) << 40) + int(low)) / (int(count) << 60)


@dataclass
class Result:
    """Labels (id, x, w, a), centroids, and counts of the work done."""

    labels: DataFrame
    centroids: np.ndarray
    iterations: int
    converged: bool
    metrics: dict[str, float] = field(default_factory=dict)
    trace: list[list[dict]] = field(default_factory=list)
    #: The farthest that a centroid went in each iteration.
    drifts: list[float] = field(default_factory=list)

    def sizes(self) -> DataFrame:
        """Points and coordinate sums of each cluster that has points."""
        width = self.centroids.shape[1]
        sums = [F.sum(F.col("x")[t] * F.col("w")).alias(f"sum_{t}") for t in range(width)]
        return self.labels.groupBy(F.col("a").alias("cluster")).agg(F.sum("w").alias("n_points"), *sums)
