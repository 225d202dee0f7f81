import math
import random

import pytest

from spindrift.llm import topk


def brute(rows, k):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in sorted({(i, tuple(v)) for i, v in good if i % 50 == 0}):
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in good if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def rows():
    rng = random.Random(3)
    made = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(300)] + [(300 + i, [0.5] * 8) for i in range(100)]
    return made + [(900, None), (950, [None] * 8), (1000, [float("nan")] * 8), (1001, [float("inf")]), (1002, [0.1]), (1050, []), (None, [0.1] * 8), (7, [0.2] * 8), (7, [0.2] * 8)]


@pytest.mark.parametrize(("k", "block"), [(5, 4096), (5, 3), (500, 4096), (1, 4096)])
def test_equals_brute_force(spark, k, block):
    df = spark.createDataFrame(rows(), "vec_id long, embedding array<double>").repartition(5)
    got = sorted(map(tuple, topk.search(df, df.where("vec_id % 50 = 0"), k=k, block=block).collect()))
    assert got == brute(rows(), k)


@pytest.mark.parametrize("scale", [1e4, 1e6])
def test_wide_scores_stay_exact(spark, scale):
    rng = random.Random(4)
    made = [(i, [rng.gauss(0, 1) * scale for _ in range(4)]) for i in range(80)]
    df = spark.createDataFrame(made, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.search(df, df.where("vec_id % 50 = 0"), k=3).collect())) == brute(made, 3)


def test_empty_tables(spark):
    df = spark.createDataFrame(rows(), "vec_id long, embedding array<double>")
    assert topk.search(df.limit(0), df.limit(0)).count() == 0
    assert topk.search(df, df.limit(0)).count() == 0


def test_scores_beyond_64_bits_raise(spark):
    df = spark.createDataFrame([(0, [1e12] * 4), (1, [1e12] * 4)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        topk.search(df, df.where("vec_id % 50 = 0"), k=1).collect()
