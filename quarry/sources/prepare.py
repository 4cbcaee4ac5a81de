"""Scalings and samples. Extremes and moments are one aggregation whose single row stays in the plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources.generate import lcg, uniform


def _with(df: DataFrame, row: DataFrame) -> DataFrame:
    return df.crossJoin(F.broadcast(row))  # one row


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column from 0 to 1; a constant column becomes 0."""
    ends = df.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max))))
    out = {c: F.coalesce(F.try_divide(F.col(c) - F.col(f"_low_{c}"), (F.col(f"_high_{c}") - F.col(f"_low_{c}"))), F.lit(0.0)) for c in columns}
    return _with(df, ends).withColumns(out).select(*df.columns)


def z_score(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean 0 and population deviation 1."""
    moments = df.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("sd", F.stddev_pop))))
    return _with(df, moments).withColumns({c: F.try_divide(F.col(c) - F.col(f"_mean_{c}"), F.col(f"_sd_{c}")) for c in columns}).select(*df.columns)


def fixed_point(df: DataFrame, columns: list[str], bits: int = 20) -> DataFrame:
    """Whole multiples of 2**-bits: sums of these are exact."""
    return df.withColumns({c: F.floor(F.col(c) * float(1 << bits)).cast("long") for c in columns})


def jitter(df: DataFrame, columns: list[str], id_col: str, size: float = 1e-7, seed: int = 1) -> DataFrame:
    return df.withColumns({c: F.col(c) + (uniform(F.col(id_col), t, seed) * 2 - 1) * size for t, c in enumerate(columns)})


def sample(df: DataFrame, id_col: str, n: int, seed: int = 1) -> DataFrame:
    """``n`` rows without replacement: those of the least hash. A top-k, not a sort of all rows."""
    return df.withColumn("_draw", lcg(F.col(id_col), seed)).orderBy("_draw", id_col).limit(n).drop("_draw")


def every(df: DataFrame, id_col: str, step: int) -> DataFrame:
    return df.filter(F.pmod(F.col(id_col), F.lit(step)) == 0)
