"""Binned signal against a walk over bases."""

import random

import pytest

from spindrift.operators import profiles


def test_matrix_equals_a_walk(spark):
    rng = random.Random(5)
    track = [(rng.choice("cd"), a, a + rng.randint(1, 30), float(rng.randint(-3, 9))) for a in (rng.randrange(300) for _ in range(80))]
    regions = [(rng.choice("cde"), a, a + rng.randint(1, 60), rng.choice([None, "x", f"n{i}"]), rng.choice(["+", "-", ".", None])) for i, a in enumerate(rng.randrange(5, 250) for _ in range(25))]
    regions.append(regions[0])
    depth = {}
    for c, a, b, v in track:
        for p in range(a, b):
            depth[c, p] = depth.get((c, p), 0.0) + v
    want = []
    for c, a, b, name, strand in regions:
        back = strand == "-"
        spans = [(0, 4, a, b), (-2, 2, b if back else a - 12, b + 12 if back else a), (4, 2, a - 8 if back else b, a if back else b + 8)]
        for first, n, low, high in spans:
            for i in range(n):
                lo, hi = low + i * (high - low) // n, low + (i + 1) * (high - low) // n
                lo = max(lo, 0)
                if hi > lo:
                    want.append((name or "", first + (n - 1 - i if back else i), round(sum(depth.get((c, p), 0.0) for p in range(lo, hi)) / (hi - lo), 6)))
    df = spark.createDataFrame(regions, "chrom string, start long, stop long, name string, strand string")
    matrix = profiles.region_matrix(spark.createDataFrame(track, "chrom string, start long, stop long, value double"), df, 4, 12, 8, 2)
    got = [(r.name or "", r.bin, round(r.value, 6)) for r in matrix.collect()]
    assert sorted(got) == sorted(want)
    own = {}
    for _, b, v in want:
        own.setdefault(b, []).append(v)
    for r in profiles.profile(matrix).collect():
        assert r.n == len(own[r.bin]) and r.mean == pytest.approx(sum(own[r.bin]) / r.n, abs=1e-5)
    shares = {r.bin: r.share for r in profiles.body_coverage(matrix).collect()}
    assert max(shares.values()) == 1 and profiles.region_matrix(matrix.limit(0).selectExpr("'c' chrom", "1L start", "2L stop", "value"), df.limit(0), 4).count() == 0


def test_regions_meet_the_track_in_one_exchange(spark):
    """Regions of one tile and of many, with values that are not finite, and bins that are not sent one by one."""
    tile = 1 << 14
    track = [("c", 0, 3 * tile, 0.1), ("c", tile - 5, tile + 5, 2.0), ("c", 100, 110, float("nan")), ("c", 200, 210, float("inf")), ("c", 205, 220, float("-inf")), ("c", 5 * tile, 5 * tile + 4, None), ("d", -8, 8, 1.5), (None, 0, 9, 1.0)]
    regions = [("c", tile - 10, tile + 10, "edge", "-"), ("c", 0, 4 * tile, "long", "+"), ("c", 90, 190, "nan", "."), ("c", 200, 220, "inf", "+"), ("c", 5 * tile, 5 * tile + 8, "null", "+"), ("d", -8, 8, "before", "+"), (None, 0, 8, "nowhere", "+"), ("d", 9, 9, "empty", "+")]
    a = spark.createDataFrame(track, "chrom string, start long, stop long, value double")
    b = spark.createDataFrame(regions, "chrom string, start long, stop long, name string, strand string")
    matrix = profiles.region_matrix(a, b, 4)
    got = {(r.name, r.bin): r.value for r in matrix.collect()}
    assert len(got) == matrix.count() == 4 * 6 + 2
    near = lambda name, *want: [got[name, i] for i in range(4)] == [pytest.approx(w, abs=1e-9, nan_ok=True) for w in want]
    assert near("edge", 0.1, 2.1, 2.1, 0.1) and near("long", float("nan"), 0.1 + 10 / tile, 0.1, 0)
    assert near("nan", *[float("nan"), 0.1, 0.1, 0.1]) and near("inf", float("inf"), float("nan"), float("-inf"), float("-inf"))
    assert near("null", 0, 0, 0, 0) and got["nowhere", 0] == 0
    assert got["before", 2] == got["before", 3] == 1.5 and ("before", 0) not in got
    plan = profiles.profile(matrix)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
