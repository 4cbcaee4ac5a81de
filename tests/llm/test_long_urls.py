"""Urls of very many segments."""

import time

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import url_filter


def test_urls_of_a_hundred_thousand_segments(spark):
    long = ["http://a.net/es/" + "/".join(f"s{i % 17}x" for i in range(100_000)), "http://a.net/pt/" + "/".join(f"s{i % 13}x" for i in range(100_000))]
    rows = [*enumerate(long), *((10 + i, f"http://h{i % 5}.net/{'es' if i % 2 else 'pt'}/page{i}") for i in range(60))]
    began = time.monotonic()
    found = {r["page_id"]: r for r in url_filter.judged(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert time.monotonic() - began < 240
    assert len(found) == len(rows) and found[0]["verdict"] == "block" and found[0]["rule"] == "net/es/"
    assert found[0]["path"].count("/") == 100_001 and found[1]["rule"] is None and found[1]["verdict"] in ("allow", "block")


def test_prefix_hashes_name_prefixes(spark):
    paths = [["", "a", "b"], ["", "a", "c", "b"], ["", "b", "a"], [""], [], ["", "a", "b", "b"]]
    df = spark.createDataFrame([(i, p, "x") for i, p in enumerate(paths)], "id long, shape array<string>, prefix string").repartition(2)
    got = {}
    for r in url_filter._with_prefixes(df, "shape").collect():
        assert len(r["prefixes"]) == len(r["shape"])
        for k, h in enumerate(r["prefixes"]):
            assert got.setdefault(tuple(r["shape"][: k + 1]), h) == h
    assert len(set(got.values())) == len(got)
    assert np.bitwise_xor.reduce([r["h"] for r in df.filter("id = 0").select(F.posexplode("shape").alias("i", "x")).select(F.xxhash64("i", "x").alias("h")).collect()]) == got["", "a", "b"]
