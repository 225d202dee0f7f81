"""Neighbours on the globe against brute force: poles, the date line, many points at one place."""

import math
import random

from spindrift import catalog
from spindrift.operators import graphs
from spindrift.operators import omics as o


def km(p, q):
    a = math.sin(math.radians(q[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
    return 2 * o.EARTH_KM * math.asin(min(1.0, math.sqrt(a)))


def points():
    rng = random.Random(3)
    made = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(60)] + [(90.0, 0.0), (90.0, 120.0), (-90.0, 5.0), (10.0, 179.9), (10.0, -179.9), (0.0, 0.0), (-0.0, 0.0)] + [(48.0, 11.0)] * 9
    rng.shuffle(made)
    return [(i, *x) for i, x in enumerate(made)]


def test_pairs_within_a_distance_are_dealt_out(spark, monkeypatch):
    """Few rows of wide bands were put together into one task, which made all pairs of a band around the globe."""
    rows = points()
    monkeypatch.setattr(o, "SLICE", 20)
    made = o.neighbours_within(spark.createDataFrame([*rows, (900, None, 1.0)], "id long, lat double, lon double"), 2500)
    want = {(p[0], q[0]): km(p, q) for p in rows for q in rows if p[0] < q[0] and km(p, q) <= 2500}
    got = {(r.a, r.b): r.km for r in made.collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-6 for x in want) and made.count() == len(want)
    assert made.rdd.getNumPartitions() > 4


def test_all_pairs_have_a_distance(spark, monkeypatch):
    """Pairs beyond 1,500 km were left out."""
    rows = points()
    monkeypatch.setattr(o, "BLOCK", 20)
    made = o.all_distances(spark.createDataFrame([*rows, (900, None, 1.0)], "id long, lat double, lon double"))
    want = {(p[0], q[0]): km(p, q) for p in rows for q in rows if p[0] < q[0]}
    got = {(r.a, r.b): r.km for r in made.collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-6 for x in want) and made.count() == len(want)
    few = catalog.QUERIES["gis_station_distances"](spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").count()
    assert few.count() == n * (n - 1) // 2 and few.where("km > 1500").count() > 0


def test_copies_of_a_place_are_searched_once(spark, monkeypatch):
    """Each point was joined with all points of its bands, copies with all copies."""
    rows, seen = points(), []
    monkeypatch.setattr(graphs, "materialized", lambda df: seen.append(df.checkpoint()) or seen[-1])
    got = {}
    for r in graphs.nearest_points(spark.createDataFrame([*rows, (900, None, 1.0)], "id long, lat double, lon double"), 3).collect():
        got.setdefault(r.a, []).append((round(r.km, 6), r.b, r["rank"]))
    at = {p[0]: p for p in rows}
    for p in rows:
        near = sorted((round(km(p, q), 6), q[0]) for q in rows if q[0] != p[0])[:3]
        mine = sorted(got[p[0]], key=lambda x: x[2])
        assert [x[2] for x in mine] == [1, 2, 3] and [x[0] for x in mine] == [x[0] for x in near]
        assert all(abs(km(p, at[x[1]]) - x[0]) < 1e-5 for x in mine)
    assert len(got) == len(rows) and max(s.where("lat = 48.0").count() for s in seen if "lat" in s.columns) == 4
