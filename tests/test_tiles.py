"""Passes by tile against brute force, on places in many tiles."""

import random

from spindrift.operators import annotation as an
from spindrift.operators import intervals as iv


def forbidden(*_, **__):
    raise AssertionError("a table was written out")


def spread(n, seed, names=True):
    rng = random.Random(seed)
    at = lambda: rng.choice([rng.randrange(200), rng.randrange(16_300, 16_500), rng.randrange(3_000_000)])
    return [(rng.choice("cde"), s, s + rng.choice([1, 5, 90, 40_000]), f"n{i}" if names else None) for i, s in enumerate(at() for _ in range(n))]


def test_closest_sends_each_row_once(spark, monkeypatch):
    """Whole rows were keys, filed by bin, and range-partitioned and written out twice."""
    a, b, bodies = spread(150, 1, names=False), spread(90, 2) + [("f", 1, 2, "far")], spread(20, 3)
    a += [a[0], (None, 3, 9, None), ("z", 1, 2, "alone")]
    schema = "chrom string, start long, stop long, name string"
    left, right, others = (spark.createDataFrame(x, schema).repartition(3) for x in (a, b, bodies))
    monkeypatch.setattr(type(left), "checkpoint", forbidden)
    got = iv.closest(left, right, bodies=others)

    def nearest(c, s, e):
        near = [(max(0, s - y[2] + 1 if y[2] <= s else y[1] - e + 1 if y[1] >= e else 0), *y[1:]) for y in b if y[0] == c]
        return min(near) if near else (-1, None, None, None)

    want = [(*x, *nearest(*x[:3]), any(y[0] == x[0] and y[1] < x[2] and x[1] < y[2] for y in bodies)) for x in a]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    genes = spark.createDataFrame([(c, s + 1, e, "-", n) for c, s, e, n in b], "seqid string, start long, stop long, strand string, id string")
    assert an.nearest_genes(left, genes, 10).count() == len(a) and an.genes_nearby(left, genes).count() == len(a) - 2


def test_depth_in_one_pass_by_tile(spark, monkeypatch):
    """Events were range-partitioned, numbered, joined with themselves and written out (F35, F39), and places made for each interval."""
    rows = [r[:3] for r in spread(120, 4)] + [("c", 5, 5), ("z", 1, 3), ("z", 3, 4), (None, 1, 2), ("d", None, 9)]
    df = spark.createDataFrame(rows, "chrom string, start long, stop long").repartition(3)
    monkeypatch.setattr(type(df), "checkpoint", forbidden)
    want, whole = [], [r for r in rows if None not in r]
    for c in {r[0] for r in whole}:
        edges = sorted({x for r in whole if r[0] == c for x in r[1:]})
        for s, e in zip(edges, edges[1:], strict=False):
            depth = sum(r[0] == c and r[1] <= s and e <= r[2] for r in whole)
            want += [(c, s, e, depth)] if depth else []
    assert sorted(tuple(r) for r in iv.depth_segments(df).collect()) == sorted(want)
    places = iv.depth_by_place(df)
    assert places.count() == sum(e - s for _, s, e, _ in want) and places.where("chrom = 'z'").orderBy("at").collect() == [("z", 1, 1), ("z", 2, 1), ("z", 3, 1)]
