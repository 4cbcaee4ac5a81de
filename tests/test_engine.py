"""The engine on Spark: partitions, weights, limits of iterations, bad input, sources, streaming."""

import os
import struct
import sys
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quarry import catalogue, model, storage
from quarry.functions import geometry
from quarry.operators import graph
from quarry.operators.strategies import STRATEGIES, Hamerly
from quarry.plans import driver, evaluate, report
from quarry.sources import generate, prepare, readers, seeding
from quarry.streaming import assign

from test_strategies import plain


@pytest.fixture(scope="module")
def blobs(spark):
    table = generate.blobs(spark, 1500, 2, 12, seed=3).drop("label").cache()
    rows = sorted(table.collect())
    return table, np.array([r["x"] for r in rows])


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_results_do_not_depend_on_partitions(spark, blobs, partitions):
    table, x = blobs
    a, c, iterations = plain(x, x[:8].copy(), 60)
    found = driver.run(table.repartition(partitions), x[:8], "walk_reuse")
    assert found.metrics["tasks"] == 4 and found.labels.rdd.getNumPartitions() > 1
    labels = [r["a"] for r in found.labels.orderBy("id").collect()]
    assert labels == a.tolist() and found.iterations == iterations and found.converged
    assert np.allclose(found.centroids, c, rtol=0, atol=1e-12)


def test_iteration_limits_and_weights(spark):
    points = spark.createDataFrame([(i, [float(i % 7), float(i % 3)], 1 + i % 2) for i in range(60)], "id long, x array<double>, w long")
    c = np.array([[0.0, 0], [3, 1], [6, 2]])
    assert driver.run(points, c, "lloyd", 0).iterations == 0
    full = driver.run(points, c, "hamerly")
    part = driver.run(points, c, "hamerly", 1)
    assert part.iterations == 1
    expanded = points.withColumn("x2", F.explode(F.array_repeat("x", F.col("w").cast("int")))).select(F.monotonically_increasing_id().alias("id"), F.col("x2").alias("x"), F.lit(1).cast("long").alias("w"))
    assert np.array_equal(driver.run(expanded, c, "lloyd").centroids, full.centroids)
    assert full.metrics["comps"] <= driver.run(points, c, "lloyd").metrics["comps"]


@pytest.mark.parametrize("bad", [None, [1.0], [float("nan"), 1.0], [None, 1.0], [float("inf"), 0.0]])
def test_bad_vectors_are_refused(spark, bad):
    points = spark.createDataFrame([(1, [0.0, 0.0], 1), (2, bad, 1)], "id long, x array<double>, w long")
    with pytest.raises(Exception, match="bad vector"):
        driver.run(points, np.zeros((1, 2)), "lloyd")


def test_no_points_and_unknown_strategies(spark):
    none = spark.createDataFrame([], "id long, x array<double>, w long")
    found = driver.run(none, np.array([[1.0, 2.0]]), "exponion")
    assert found.labels.count() == 0 and found.centroids.tolist() == [[1.0, 2.0]]
    with pytest.raises(ValueError, match="unknown strategy"):
        driver.run(none, np.zeros((1, 2)), "guess")
    with pytest.raises(ValueError):
        driver.run(none, np.array([[np.nan, 0]]), "lloyd")


def test_sums_are_exact_in_any_order(spark):
    values = [(0.1 * i, 1) for i in range(1000)]
    df = spark.createDataFrame(values, "v double, w long")
    got = {tuple(map(int, df.repartition(n).agg(*model.exact_sums(F.col("v"), F.col("w"))).first())) for n in (1, 3, 7)}
    assert len(got) == 1


def test_seeding(spark, blobs):
    table, _ = blobs
    c = seeding.plus_plus(table, 5, seed=2)
    assert len({tuple(r) for r in c.tolist()}) == 5
    assert np.array_equal(c, seeding.plus_plus(table.repartition(5), 5, seed=2))
    same = spark.createDataFrame([(i, [1.0, 1.0], 1) for i in range(5)], "id long, x array<double>, w long")
    with pytest.raises(ValueError, match="differ"):
        seeding.plus_plus(same, 2)
    assert len(seeding.farthest_first(table, 4)) == 4


def test_readers(spark, tmp_path):
    (tmp_path / "u.csv").write_text("Date,Lat,Lon\na,40.7,-73.9\nb,40.8,-74.0\nc,x,1\n")
    assert readers.latitude_longitude(spark, str(tmp_path / "u.csv")).count() == 2
    (tmp_path / "r.csv").write_text("1,9.0,57.0,3.5\n2,9.5,57.5,4.5\n")
    assert readers.road(spark, str(tmp_path / "r.csv")).agg(F.abs(F.sum("x")) < 1e-5).first()[0]
    with pytest.raises(ValueError, match="expected"):
        readers.road(spark, str(tmp_path / "r.csv"), "0" * 32)


def test_generators(spark):
    assert generate.repeated(generate.grid(spark, 4), 3).select("id").distinct().count() == 48
    assert generate.scaled(generate.circle(spark, 10), 2.0).filter(F.abs(F.hypot(F.col("x")[0], F.col("x")[1]) - 2) > 1e-9).count() == 0
    assert generate.collinear(spark, 10).filter("x[1] != 2 * x[0] + 1").count() == 0
    noisy = prepare.jitter(spark.range(5).withColumn("v", F.lit(1.0)), ["v"], "id")
    assert noisy.filter("abs(v - 1) > 1e-7").count() == 0


def test_nearest_stays_in_code_generation(spark, sf_dir):
    df = catalogue.QUERIES["nearest_centroid"](spark, sf_dir)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan and "Join" not in plan


def test_a_stream_gets_the_labels_of_the_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, float(i % 9), float(i % 5)) for i in range(200)], "id long, x0 double, x1 double")
    rows.write.parquet(str(tmp_path / "in"))
    c = np.array([[1.0, 1.0], [6.0, 3.0], [4.0, 0.0]])
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run = assign.assigned(stream, ["x0", "x1"], c).writeStream.format("memory").queryName("labels").outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    batch = geometry.nearest(rows, ["x0", "x1"], c)
    assert evaluate.is_exact(spark.table("labels"), batch).first()["exact"]


def test_the_gate_stops_runs_that_are_not_exact(spark):
    runs = spark.createDataFrame([("c", 1, "lloyd", 2.0, 10, True), ("c", 1, "ball", 1.0, 5, False)], "config string, seed long, algo string, time_s double, comps long, exact boolean")
    assert report.with_baseline(report.gate(runs.filter("exact")), "lloyd").select("speedup").count() == 1
    for bad in (runs, runs.withColumn("exact", F.lit(None).cast("boolean"))):
        with pytest.raises(Exception, match="not exact"):
            report.with_baseline(report.gate(bad), "lloyd").select("config", "speedup").collect()


@pytest.mark.parametrize("name", list(STRATEGIES))
def test_the_loops_in_memory_and_over_jobs_agree(spark, blobs, name):
    """Also over several copies of the state: the loop in memory saves it every seven iterations."""
    table, x = blobs
    weighted = table.withColumn("w", F.col("id") % 3 + 1)
    one, many = driver.run(weighted, x[:9], name, save=7), driver.run(weighted, x[:9], name, in_memory=False)
    agreed = evaluate.runs_agree(one, many).first()
    assert agreed["exact"] and agreed["centroid_gap"] == 0.0 and one.converged and many.converged and one.iterations > 7
    assert {r["a"]: r["n"] for r in one.trace[0]} == {r["a"]: r["n"] for r in many.trace[0]}
    assert one.metrics["tasks"] == 4 and len(one.labels.inputFiles()) >= 4


class _Killed(Hamerly):
    """Its task's process dies once, in the tenth pass."""

    def __init__(self, flag):
        super().__init__()
        self.flag = flag

    def tables(self, context):
        with open(f"{self.flag}-{context.it}", "a") as f:
            f.write("x")
        if context.it == 10 and not os.path.exists(self.flag):
            open(self.flag, "w").close()
            os._exit(1)
        return super().tables(context)


def test_a_lost_task_costs_the_iterations_since_the_last_copy(spark, blobs, tmp_path):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    table, x = blobs
    found = driver.run(table, x[:9], _Killed(str(tmp_path / "flag")), save=6)
    want = driver.run(table, x[:9], "lloyd")
    assert evaluate.runs_agree(found, want).first()["exact"] and (tmp_path / "flag").exists()
    passes = [len((tmp_path / f"flag-{it}").read_text()) for it in range(found.iterations + 1)]
    assert passes[0] == 4 and set(passes[:7]) == {4}  # what was saved was not done again
    assert max(passes) <= 8 and passes[10] > 4


def test_tasks_follow_what_memory_and_exchange_allow():
    assert driver.tasks_in_memory(8, 10**6, 64, 2, 0) == 8
    assert driver.tasks_in_memory(8, 10**9, 64, 2, 0) == 0
    assert driver.tasks_in_memory(4000, 10**6, 64, 2, 0) == driver.MOST_TASKS
    assert 1 <= driver.tasks_in_memory(4000, 10**6, 50_000, 2, 0) < 30
    assert driver.tasks_in_memory(0, 10, 2, 2, 0) == 0


def test_snapshots_go_when_no_row_refers_to_them(spark):
    """Rows far from all borders keep their first bounds for long; between them and now snapshots go."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(300, 2)) * 0.2 + [i * 50.0, 0] for i in range(3)] + [rng.uniform(0, 1, (900, 2)) + [0, 400]])
    points = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "id long, x array<double>, w long")
    c = np.r_[x[[0, 300, 600]], x[900:912]]
    found = driver.run(points, c, "walk_history")
    assert found.iterations > 12 and found.metrics["snapshots"] <= found.iterations
    assert evaluate.runs_agree(found, driver.run(points, c, "lloyd")).first()["exact"]


@pytest.mark.parametrize("name", ["walk_stable", "walk_history"])
def test_files_of_stable_clusters_are_neither_read_nor_written(spark, name, monkeypatch):
    """A far group of clusters settles at once, while the other one goes on."""
    rng = np.random.default_rng(5)
    far = np.concatenate([rng.normal(size=(40, 2)) * 0.1 + [1000 + 30 * (i % 4), 30 * (i // 4)] for i in range(12)])
    x = np.concatenate([far, rng.uniform(0, 10, (700, 2))])
    points = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "id long, x array<double>, w long")
    c = np.r_[far[::40], x[480:490]]
    removed = []
    real = driver.remove
    monkeypatch.setattr(driver, "remove", lambda s, path: (removed.append(path), real(s, path)))
    found = driver.run(points, c, name, in_memory=False)
    want = driver.run(points, c, "lloyd")
    assert evaluate.runs_agree(found, want).first()["exact"]
    assert found.iterations > 8 and found.metrics["least_rows_read"] < len(x) and found.metrics["rows_read"] < 0.8 * len(x) * found.iterations
    kept = {p.split("/")[-2] for p in found.labels.inputFiles()}
    written = {p.split("/")[-3] for p in found.labels.inputFiles()}
    assert len(kept) > 1 and len(written) > 1 and any("part=" in p for p in removed)  # files of several iterations, old ones of read parts gone


def test_label_sums_are_exact_for_large_weights():
    x, w = np.array([[1e6 + 0.1], [-3.7], [0.3]]), np.array([1 << 40, 3, 1 << 33])
    for weights in (w, np.array([2, 3, 4])):
        sums = driver.LabelSums(x, weights, 2)
        for label in (np.array([1, 0, 1]), np.zeros(3, np.int64)):  # corrected by the rows that changed
            rows = {r["a"]: r for r in driver.summarised(sums.table(label, [np.zeros(3, np.int64)] * 5), 1)}
            for a in set(label.tolist()):
                own = label == a
                want = sum(Fraction(v) * int(n) for v, n in zip(x[own, 0].tolist(), weights[own].tolist())) / int(weights[own].sum())
                assert abs(model.exact_mean(rows[a]["h0"], rows[a]["l0"], rows[a]["n"]) - float(want)) <= 2**-58 * 1e6


def test_results_for_other_programs(spark, tmp_path):
    points = spark.createDataFrame([(1, [0.1, 1e-300]), (0, [-1.5e10, 1 / 3])], "id long, x array<double>")
    readers.text_points(points, str(tmp_path / "t"))
    assert sorted(tuple(r["x"]) for r in readers.read_text_points(spark, str(tmp_path / "t")).collect()) == [(-1.5e10, 1 / 3), (0.1, 1e-300)]
    readers.json_record(points, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    for _ in range(2):
        readers.append_results(points, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 4


def test_windows_of_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i, float(i % 9), float(i % 5)) for i in range(120)], "id long, x0 double, x1 double").withColumn("ts", F.timestamp_seconds(F.col("id") * 10))
    rows.write.parquet(str(tmp_path / "in"))
    c = np.array([[1.0, 1.0], [6.0, 3.0]])
    stream = assign.sizes(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), ["x0", "x1"], c, "ts", "5 minutes", "1 minute")
    run = stream.writeStream.format("memory").queryName("sizes").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    want = {(r["w"]["start"], r["a"]): r["count"] for r in geometry.nearest(rows, ["x0", "x1"], c).groupBy(F.window("ts", "5 minutes").alias("w"), "a").count().collect()}
    assert {(r["window"]["start"], r["a"]): r["count"] for r in spark.table("sizes").collect()} == want


def test_intermediate_tables_need_a_shared_folder(spark):
    class Elsewhere:
        conf = {}

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError, match="checkpoint.dir"):
        storage.shared_folder(Elsewhere())
    with storage.scope(spark):
        path = storage.shared_folder(spark)
        assert storage.materialise(spark.range(3), f"{path}/t").count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(f"{path}/t")


def _png(path, width, height, grey, pixels):
    def part(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    line = width * (1 if grey else 3)
    raw = b"".join(b"\0" + bytes(pixels[k * line : (k + 1) * line]) for k in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 0 if grey else 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def test_pixels(spark, tmp_path):
    _png(tmp_path / "a.png", 2, 1, False, [255, 0, 51, 0, 102, 204])
    _png(tmp_path / "b.png", 1, 2, True, [51, 255])
    rows = readers.pixels(spark, str(tmp_path)).collect()
    got = sorted(tuple(round(r[c], 3) for c in "rgb") for r in rows)
    assert got == [(0.0, 0.4, 0.8), (0.2, 0.2, 0.2), (1.0, 0.0, 0.2), (1.0, 1.0, 1.0)] and len({r["id"] for r in rows}) == 4


@pytest.mark.parametrize("name", ["auto", "elkan", "walk_reuse", "ball"])
def test_thousands_of_centroids(spark, name):
    """No strategy has a table of all pairs of centroids."""
    c = np.random.default_rng(3).normal(size=(5000, 2))
    points = spark.createDataFrame([(i, c[i * 7].tolist(), 1) for i in range(50)], "id long, x array<double>, w long")
    found = driver.run(points, c, name)
    assert sorted((r["id"], r["a"]) for r in found.labels.collect()) == [(i, i * 7) for i in range(50)]
    assert np.allclose(graph.half_separation(c[:2000]), 0.5 * graph.centroid_distances(c[:2000]).min(axis=1))
