"""Seeding, numbered lines, and results by groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.plans import driver
from quarry.sources import generate, lines, readers, results, seeding


def test_seeds_of_both_ways_agree(spark):
    points = generate.blobs(spark, 600, 2, 9, seed=4).drop("label").withColumn("w", F.col("id") % 3 + 1).cache()
    for k in (1, 20):  # more than ROUNDS, so distances are written in between
        assert np.array_equal(seeding.plus_plus(points, k, seed=2), seeding.plus_plus(points, k, seed=2, in_memory=False))
    assert np.array_equal(seeding.farthest_first(points, 6), seeding.farthest_first(points.repartition(7), 6, in_memory=False))


def test_five_hundred_seeds(spark):
    points = generate.blobs(spark, 4000, 2, 30, seed=1).drop("label")
    c = seeding.plus_plus(points, 512)
    assert len(np.unique(c, axis=0)) == 512
    table = points.repartition(2).mapInArrow(seeding._rounds(2, 512, 0), "r int, x array<double>", barrier=True).repartition(1).collect()
    (table,) = [r for r in table if r["r"] == -1]
    assert table["x"][0] < 4000 * 512 / 8  # most points are not near a new centroid
    assert driver.run(points, c, "exponion", 3).iterations == 3


def test_line_numbers_do_not_depend_on_splits(spark, tmp_path):
    for f, n in (("a", 3000), ("b", 1), ("c", 500)):
        (tmp_path / f"{f}.csv").write_text("h,Lat,Lon\n" + "".join(f"{f},{40 + i / n},{-70 - i / n}\n" for i in range(n)))
    before, found = spark.conf.get("spark.sql.files.maxPartitionBytes"), []
    try:
        for size in ("1m", "7k", "900"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "100")
            rows = sorted(tuple(r) for r in lines.numbered(spark, str(tmp_path), header=True).collect())
            drawn = sorted(tuple(r) for r in readers.latitude_longitude(spark, str(tmp_path), 50).collect())
            found.append((rows, drawn))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found[0] == found[1] == found[2]
    assert [i for i, _ in found[0][0]] == list(range(3501)) and found[0][0][0][1].startswith("a,40.0") and found[0][0][3000][1].startswith("b,")


def test_a_run_that_is_killed_between_groups_goes_on(spark, tmp_path, monkeypatch):
    rows = lambda g: spark.range(5).select(F.lit(g).alias("config"), "id")
    table = results.Results(spark, str(tmp_path / "r"))
    with pytest.raises(ValueError, match="no groups"):
        table.read()
    assert table.write({"config": "a", "seed": 1}, rows("a")) and not table.write({"seed": 1, "config": "a"}, rows("a"))
    with monkeypatch.context() as m:  # killed after the rows and before the commit
        m.setattr(results.Results, "_commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            table.write({"config": "b", "seed": 1}, rows("b"))
    again = results.Results(spark, str(tmp_path / "r"))
    assert again.read().count() == 5 and not again.has({"config": "b", "seed": 1})
    for g in ("a", "b", "c"):
        again.write({"config": g, "seed": 1}, rows(g))
    assert sorted((r["config"], r["n"]) for r in again.read().groupBy("config").agg(F.count("*").alias("n")).collect()) == [("a", 5), ("b", 5), ("c", 5)]
    assert again.clean() == 1 and again.read().count() == 15 and again.commits().count() == 3
    assert not again._commit({"config": "a", "seed": 1}, "late") and again.read().count() == 15
