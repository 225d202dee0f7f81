"""Distributed quantiles against numpy, by keys, with ties, nulls and one value."""

import random

import numpy as np
import pytest

from spindrift.operators import tables
from spindrift.plans.quantiles import quantile_row, quantiles


def test_quantiles_equal_numpy(spark):
    rng = random.Random(2)
    own = {"a": [rng.choice([1.0, 2.0, 2.5]) for _ in range(101)], "b": [rng.gauss(0, 9) for _ in range(200)], "c": [7.0], None: [3.0, 1.0]}
    rows = [(k, v) for k, vs in own.items() for v in vs] + [("a", None), ("d", None), ("b", float("nan"))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    points = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    got = {(r.k, r.p): r.value for r in quantiles(df, ["k"], "v", points).collect()}
    assert got.keys() == {(k, p) for k in own for p in points}
    for (k, p), value in got.items():
        assert value == pytest.approx(np.quantile(own[k], p))
    every = [v for vs in own.values() for v in vs]
    row = quantile_row(df, [], "v", {"q1": 0.25, "median": 0.5}).first()
    assert (row.q1, row.median) == (pytest.approx(np.quantile(every, 0.25)), pytest.approx(np.quantile(every, 0.5)))
    assert quantiles(df.limit(0), ["k"], "v", points).count() == 0


def test_description_and_fences(spark):
    df = spark.createDataFrame([(float(i), None if i % 3 else float(i * i)) for i in range(50)] + [(1000.0, None)], "x double, y double")
    got = {r.column: r for r in tables.describe(df, ["x", "y"], ["count", "median", "iqr", "p95", "mean"]).collect()}
    x = [float(i) for i in range(50)] + [1000.0]
    assert (got["x"]["count"], got["x"]["median"], got["x"].iqr) == (51, np.median(x), pytest.approx(np.quantile(x, 0.75) - np.quantile(x, 0.25)))
    assert got["y"].p95 == pytest.approx(np.quantile([float(i * i) for i in range(0, 50, 3)], 0.95)) and got["y"].__fields__ == ["column", "count", "median", "iqr", "p95", "mean"]
    assert [r.x for r in tables.outliers(df, "x").collect()] == [1000.0] and tables.outliers(df.limit(0), "x").count() == 0
    assert tables.normalized(df, "x", "robust").count() == 51
