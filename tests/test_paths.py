"""Betweenness, weighted distances and pseudotime against serial algorithms."""

import heapq
import random
from collections import deque

import numpy as np
import pytest

from spindrift.operators import paths


def brute_betweenness(pairs, sources=None):
    near = {}
    for a, b in pairs:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    total = dict.fromkeys(near, 0.0)
    for s in near if sources is None else sources:
        order, before, count, depth = [], {v: [] for v in near}, {s: 1}, {s: 0}
        wait = deque([s])
        while wait:
            v = wait.popleft()
            order.append(v)
            for w in near[v]:
                if w not in depth:
                    depth[w] = depth[v] + 1
                    wait.append(w)
                if depth[w] == depth[v] + 1:
                    count[w] = count.get(w, 0) + count[v]
                    before[w].append(v)
        behind = dict.fromkeys(near, 0.0)
        for w in reversed(order):
            for v in before[w]:
                behind[v] += count[v] / count[w] * (1 + behind[w])
            if w != s:
                total[w] += behind[w]
    return {v: (len(near[v]), x / 2) for v, x in total.items()}


def test_betweenness_equals_a_serial_count(spark):
    rng = random.Random(7)
    pairs = [(rng.randrange(24), rng.randrange(24)) for _ in range(40)] + [(100, 101), (101, 102), (3, 3), (None, 4), (5, None), (1, 2), (2, 1)]
    pairs += [(200, 200 + i) for i in range(1, 9)]  # a hub
    df = spark.createDataFrame(pairs, "a long, b long")
    for samples in (None, 1000):
        got = {r.node: (r.degree, r.betweenness) for r in paths.betweenness(df, "a", "b", samples).collect()}
        want = brute_betweenness(pairs)
        assert got.keys() == want.keys()
        assert all(got[v][0] == want[v][0] and got[v][1] == pytest.approx(want[v][1]) for v in want)
    assert got[200][1] == 28 and got[101][1] == 1
    few = paths.betweenness(df, "a", "b", 5).collect()
    again = paths.betweenness(df.repartition(5), "a", "b", 5).collect()
    assert len(few) == len(want) and {(r.node, round(r.betweenness, 9)) for r in few} == {(r.node, round(r.betweenness, 9)) for r in again}
    assert paths.betweenness(df.where("a = 3 AND b = 3"), "a", "b").count() == 0


def dijkstra(edges, sources):
    near, done, wait = {}, {}, [(0.0, s) for s in sources]
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
    while wait:
        d, v = heapq.heappop(wait)
        if v not in done:
            done[v] = d
            for b, w in near.get(v, []):
                heapq.heappush(wait, (d + w, b))
    return done


def test_distances_equal_dijkstra(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(30), rng.randrange(30), float(rng.randint(0, 9))) for _ in range(80)] + [(50, 51, 1.0), (0, None, 1.0)]
    found = paths.distances(spark.createDataFrame(edges, "a long, b long, w double"), spark.createDataFrame([(0,), (7,)], "node long"))
    assert {r.node: r.distance for r in found.collect()} == dijkstra([e for e in edges if e[1] is not None], [0, 7])


def test_pseudotime_follows_the_graph_of_neighbours(spark):
    rng = np.random.default_rng(5)
    t = np.linspace(0, 3, 30)
    x = np.stack([np.cos(t), np.sin(t), 0.01 * rng.normal(size=30)], 1)
    far = np.array([[50.0, 50, 0], [50.1, 50, 0], [50.2, 50, 0]])
    points = np.concatenate([x, far])
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(points)], "id long, v array<double>")
    got = {r.id: r for r in paths.pseudotime(df, "id", "v", neighbours=2, components=None).collect()}
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    edges = []
    for i in range(len(points)):
        for j in sorted((j for j in range(len(points)) if j != i), key=lambda j: (d[i, j], j))[:2]:
            edges += [(i, j, d[i, j]), (j, i, d[i, j])]
    want = dijkstra(edges, [0])
    assert {i for i, r in got.items() if r.pseudotime is None} == {30, 31, 32} == set(range(33)) - want.keys()
    assert all(got[i].pseudotime == pytest.approx(v, abs=1e-6) for i, v in want.items())
    assert [i for i, r in sorted(got.items(), key=lambda x: x[1]["rank"] or 99)][:30] == sorted(want, key=lambda i: (want[i], i))
    own = spark.createDataFrame([(31,)], "id long")
    assert {r.id for r in paths.pseudotime(df, "id", "v", own, 2, None).collect() if r.pseudotime is not None} == {30, 31, 32}


def test_correlation_by_ranks(spark):
    long = spark.createDataFrame([("up", c, float(v)) for c, v in zip("abcd", (1, 5, 5, 90), strict=True)] + [("flat", c, 1.0) for c in "abcd"] + [("down", c, float(-i)) for i, c in enumerate("abcd")] + [("up", "z", 1.0)], "row string, column string, value double")
    time = spark.createDataFrame([(c, float(i * i)) for i, c in enumerate("abcd")], "column string, t double")
    got = {r.row: (r.n, round(r.correlation, 6)) for r in paths.correlated_with(long, time).collect()}
    assert got == {"up": (4, 0.948683), "down": (4, -1.0)}
    assert {r.row for r in paths.correlated_with(long, time, "pearson", 0.95).collect()} == {"down"}
