"""The points of the mixtures are made in tasks, many at once."""

import numpy as np
from pyspark.sql import functions as F

from quarry.sources import generate, mixture


def test_draws_are_those_of_the_column_expression(spark):
    keys = [0, 1, 5, 99_999, (1 << 31) + 7, (1 << 45) + 3, -12]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select(*(generate.lcg(F.col("k"), s) for s in (1, 5, 498_898))).collect()
    assert [list(map(int, mixture._numbers(np.array([k]), s))) for k in keys for s in (1, 5, 498_898)] == [[v] for r in rows for v in r]


def test_points_are_not_made_to_draw_centroids(spark, sf_dir, capsys):
    mixture.drawn(spark, sf_dir, 3, 64).explain()
    plan = capsys.readouterr().out
    assert plan.index("MapInArrow") < plan.index("TakeOrderedAndProject" if "TakeOrderedAndProject" in plan else "GlobalLimit")
    every = mixture.mixture(spark, sf_dir, 3, 64).withColumn("draw", generate.lcg(F.col("id"), 5)).orderBy("draw", "id").limit(64).collect()
    assert np.array_equal(mixture.first_centroids(spark, sf_dir, 3, 64), [r["x"] for r in every])
