"""Hard negatives against a sort of all scores."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperlake.llm import negatives


def brute(rows, n_positives=5, n_negatives=5, low=80):
    one = {}
    for i, v, lab in rows:
        if i is None or lab is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(256 * x) for x in v]
        one[i] = min(one.get(i, (str(lab), w)), (str(lab), w))
    out = []
    bound = (1 << 63) - 1
    for a, (lab, x) in one.items():
        if a % 100:
            continue
        scored = sorted((-max(-bound, min(bound, sum(p * q for p, q in zip(x, y, strict=False)))), i, other)
                        for i, (other, y) in one.items() if i != a)
        for s, i, _ in [r for r in scored if r[2] == lab][:n_positives]:
            fit = [r for r in scored if r[2] != lab and low * -s <= 100 * -r[0] <= 100 * -s][:n_negatives]
            out += [(a, i, k + 1, j, -s, -t) for k, (t, j, _) in enumerate(fit)]
    return sorted(out)


def found(df, **options):
    return sorted(tuple(r) for r in negatives.hard_negatives(df, F.col("id") % 100 == 0, **options).collect())


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("seed", [1, 2])
def test_random_vectors(spark, seed, monkeypatch):
    rng = np.random.default_rng(seed)
    dims, n = (3, 900) if seed == 1 else (2, 500)
    # few distinct values: many ties of scores
    vectors = rng.integers(-3, 4, (n, dims)) / 16
    rows = [(i, [float(x) for x in v], int(rng.integers(0, 3))) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows)
    assert len(want) > 30 and found(df) == want
    monkeypatch.setattr(negatives, "ROWS", 37)
    monkeypatch.setattr(negatives, "ANCHORS", 2)
    assert found(df) == want
    assert found(df, n_positives=3, n_negatives=2, low=30) == brute(rows, 3, 2, 30)


def test_blocks_of_anchors(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(rng.integers(0, 9, (1200, 2)) / 8)]
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(negatives.blocks, "__defaults__", (600,))
    assert found(df) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 1), (1, [0.9, 0.4], 1), (2, [0.9, 0.4], 2), (3, [0.8], 2), (4, [0.9, 0.3, 7.0], 3), (5, [], 2),
        (6, None, 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 2), (9, [None, 1.0], 2), (10, [0.7, 0.4], None), (None, [1.0, 0.5], 2),
        (2, [0.9, 0.4], 2), (1, [0.1, 0.1], 2), (100, [-1.0, 0.0], 1), (200, [0.0, 0.0], 9), (300, [1.0, 0.5], 1),
        (11, [0.9, 0.4], 2), (12, [0.9, 0.4], 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("id", "score", "slot", "row", "a.b")})
    want = brute(rows)
    assert want and found(df) == want
    assert found(df.limit(0)) == []


def test_huge_components(spark):
    rows = [(0, [1e12, 3.0], 1), (1, [1e12, 5.0], 1), (2, [1e12 - 7, 5.0], 2), (3, [3e11, 1e300], 2), (4, [9e11, 0.1], 2), (5, [9e11, 0.2], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert found(df) == brute(rows)
