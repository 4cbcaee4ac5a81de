"""Reporting over benchmark runs: (config, seed, algo, time_s, comps, exact)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["config", "seed"]


def gate(runs: DataFrame) -> DataFrame:
    """``runs`` if every one is exact; else the job fails. A filter, as a column could be pruned away with its check."""
    return runs.filter(F.when(F.coalesce("exact", F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit("a run is not exact")).cast("boolean")))


def with_baseline(runs: DataFrame, baseline: str) -> DataFrame:
    """Speed-up and saved distances of each run against the baseline of its config and seed."""
    base = runs.filter(F.col("algo") == baseline).select(*KEYS, F.col("time_s").alias("base_s"), F.col("comps").alias("base_comps"))
    return runs.join(base, KEYS).select(*runs.columns, F.try_divide("base_s", "time_s").alias("speedup"), F.try_divide(F.col("base_comps").cast("double"), F.col("comps").cast("double")).alias("saved"))


def summary(joined: DataFrame) -> DataFrame:
    """Means and sample deviations of each config and algorithm."""
    return joined.groupBy("config", "algo").agg(
        F.countDistinct("seed").alias("seeds"), F.avg("time_s").alias("mean_s"), F.stddev_samp("time_s").alias("sd_s"), F.avg("speedup").alias("mean_speedup"), F.min("comps").alias("least_comps"), F.every("exact").alias("all_exact"),
    )


def pivoted(runs: DataFrame, algorithms: list[str]) -> DataFrame:
    """Mean time of each config, one column an algorithm."""
    return runs.groupBy("config").pivot("algo", algorithms).agg(F.avg("time_s"))


def geometric_mean(runs: DataFrame, one: str, other: str) -> DataFrame:
    """Geometric mean of the time ratios of two algorithms over the pairs of runs, and how often the second wins."""
    left = runs.filter(F.col("algo") == one).select(*KEYS, F.col("time_s").alias("one"))
    right = runs.filter(F.col("algo") == other).select(*KEYS, F.col("time_s").alias("other"))
    ratio = F.col("one") / F.col("other")
    return left.join(right, KEYS).agg(F.exp(F.avg(F.ln(ratio))).alias("ratio"), F.count_if(ratio > 1).alias("wins"), F.count("*").alias("pairs"))


def complete_groups(runs: DataFrame, expected: int) -> DataFrame:
    """Runs of the config and seed pairs that have all algorithms; rows without a time don't count."""
    timed = runs.filter(F.col("time_s").isNotNull())
    return timed.join(timed.groupBy(*KEYS).agg(F.countDistinct("algo").alias("n")).filter(F.col("n") == expected), KEYS, "left_semi")


def pending(wanted: DataFrame, runs: DataFrame) -> DataFrame:
    """Work of ``wanted`` that ``runs`` doesn't have."""
    return wanted.join(runs.select("config", "seed", "algo").distinct(), ["config", "seed", "algo"], "left_anti")


def rates(runs: DataFrame) -> DataFrame:
    """Of each run: failed of examined points, hops a walk, the graphs' share of the time; null where there is nothing to divide by."""
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return runs.withColumns({"fail_rate": share("failed", "examined"), "hops_per_walk": share("hops", "walks"), "graph_share": share("graph_s", "time_s")})


def pooled_rates(runs: DataFrame) -> DataFrame:
    """The same of each config and algorithm, from sums over its runs."""
    names = ("failed", "examined", "hops", "walks", "graph_s", "time_s")
    return rates(runs.groupBy("config", "algo").agg(*(F.sum(n).alias(n) for n in names))).select("config", "algo", "fail_rate", "hops_per_walk", "graph_share")


def in_order(table: DataFrame, order: DataFrame, key: str) -> DataFrame:
    """Rows of ``order`` (key, place) with what ``table`` has for them, by place; null where it has none."""
    return order.join(table, key, "left").orderBy("place")


def described(runs: DataFrame, configs: DataFrame) -> DataFrame:
    """Runs with what is known of their config (n, d, k ...)."""
    return runs.join(configs, "config", "left")


def lookup(runs: DataFrame, config: str, seed: int, algo: str) -> DataFrame:
    return runs.filter((F.col("config") == config) & (F.col("seed") == seed) & (F.col("algo") == algo))


def best(runs: DataFrame) -> DataFrame:
    """The fastest algorithm of each config and seed; ties go to the first by name, and null and NaN times count as none."""
    order = Window.partitionBy(*KEYS).orderBy("time_s", "algo")
    return runs.filter(F.col("time_s").isNotNull() & ~F.isnan("time_s")).withColumn("place", F.row_number().over(order)).filter("place = 1").select(*KEYS, "algo", "time_s")


def united(*tables: DataFrame) -> DataFrame:
    """Result tables one below the other; missing columns are null."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out
