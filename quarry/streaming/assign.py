"""Labels for a stream of points against fixed centroids: a projection, so the stream keeps no state."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.geometry import nearest


def assigned(stream: DataFrame, axes: list[str], centroids: np.ndarray) -> DataFrame:
    return nearest(stream, axes, centroids)


def sizes(stream: DataFrame, axes: list[str], centroids: np.ndarray, time_col: str, window: str, late: str) -> DataFrame:
    """Points of each cluster in each time window; rows later than ``late`` are dropped."""
    return assigned(stream, axes, centroids).withWatermark(time_col, late).groupBy(F.window(time_col, window), "a").count()
