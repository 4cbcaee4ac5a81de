"""Hard negatives against brute force over all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(seed, n, d):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(6)]
    out = []
    for i in range(n):
        c = rng.choice(centres)
        x = [v + rng.gauss(0, 0.5) for v in c]
        norm = math.sqrt(sum(v * v for v in x))
        out.append((i, [float(np.float32(v / norm)) for v in x], rng.randrange(4)))
    return out


def by_force(rows):
    sound = []
    for k, (i, x, label) in enumerate(rows):
        if x is None or label is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        sound.append((k, i, [math.floor(256 * v) for v in x], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    out = []
    key = lambda s, i: (-s, i is None, i)
    for k, a, q, label in sound:
        if a is None or a % 100:
            continue
        scored = [(sum(u * v for u, v in zip(q, p)), i, other) for j, i, p, other in sound if j != k]
        for positive, pid, _ in sorted((r for r in scored if r[2] == label), key=lambda r: key(*r[:2]))[:5]:
            fit = sorted((r for r in scored if r[2] != label and 30 * positive <= 100 * r[0] <= 90 * positive), key=lambda r: key(*r[:2]))
            out += [(a, pid, n, i, positive, s) for n, (s, i, _) in enumerate(fit[:10], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


@pytest.mark.parametrize("anchors, block, parts", [(4096, 1024, 2), (3, 16, 5)])
def test_hard_negatives(spark, anchors, block, parts):
    rows = vectors(1, 700, 8)
    rows += [(700, None, 1), (800, [0.5] * 8, None), (900, [float("nan")] * 8, 1), (901, [None] + [0.1] * 7, 1), (1000, [float("inf")] * 8, 2), (None, [0.3] * 8, 1), (1001, None, None)]
    rows += [(1100, [0.0] * 8, 1), (1200, [], 2), (1300, [0.2] * 5, 0), (1400, [-x for x in rows[0][1]], rows[0][2])]
    rows += [(100, rows[100][1], rows[100][2]), (2000 + 7, rows[100][1], 3), *[(3000 + i, rows[5][1], rows[5][2]) for i in range(60)]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    want = by_force(rows)
    assert found(hard_negatives.mined(df, anchors=anchors, block=block)) == want and len(want) > 100


def test_large_components_are_scored_exactly(spark):
    rows = [(i, [x * 2e6 for x in v], label) for i, v, label in vectors(2, 150, 6)]
    assert found(hard_negatives.mined(spark.createDataFrame(rows, SCHEMA))) == by_force([(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows])


def test_hard_negatives_of_clashing_columns_and_no_rows(spark):
    df = spark.createDataFrame(vectors(3, 210, 4), SCHEMA)
    more = df.withColumns({n: F.lit("x") for n in ("id", "row", "x", "q", "t", "group", "part", "role", "score", "rank", "place", "cell", "dist")})
    assert found(hard_negatives.mined(more)) == found(hard_negatives.mined(df)) != []
    assert hard_negatives.mined(df.limit(0)).count() == 0
    assert hard_negatives.mined(df.filter("vec_id % 100 <> 0")).count() == 0


def test_brackets_hold_every_score():
    rng = np.random.default_rng(5)
    q = rng.integers(-256, 256, (400, 12)).astype(float)
    largest = (q**2).sum(axis=1).max()
    lift = np.sqrt(largest - (q**2).sum(axis=1))
    pivots = hard_negatives._choose(np.c_[q, lift][:50], 4)
    rows, a = hard_negatives._distances(q, lift, pivots), hard_negatives._distances(q[:40], np.zeros(40), pivots)
    low, high = hard_negatives.brackets((q[:40] ** 2).sum(axis=1), largest, a, rows, rows)
    score = q[:40] @ q.T
    assert (low <= score).all() and (score <= high).all()
    assert ((high < score.max()) | (low > score.min())).any()
