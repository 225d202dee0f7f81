"""Greedy clusters against the serial pass, and similar names against all pairs."""

import random
from collections import Counter
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from spindrift.operators import greedy


def test_mismatch_pairs_lose_none(spark):
    rng = random.Random(2)
    seqs = ["".join(rng.choice("ACG") for _ in range(rng.choice([0, 1, 5, 6, 7]))) for _ in range(150)] + [None]
    df = spark.createDataFrame(list(enumerate(seqs)), "id long, seq string")
    for allowed, column in ((0, F.lit(0)), (1, F.lit(1)), (3, F.lit(3)), (None, F.floor(F.col("n") * 0.34))):
        got = sorted(tuple(r) for r in greedy.mismatch_pairs(df, "id", "seq", column).collect())
        want = []
        for i, a in enumerate(seqs):
            for j in range(i + 1, len(seqs)):
                b = seqs[j]
                if a is not None and b is not None and len(a) == len(b):
                    d = sum(x != y for x, y in zip(a, b, strict=True))
                    if d <= (int(len(a) * 0.34) if allowed is None else allowed):
                        want.append((i, j, d))
        assert got == want


def serial(ranks, pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(max(a, b), set()).add(min(a, b))
    centre = {}
    for r in sorted(ranks):
        own = [c for c in sorted(near.get(r, ())) if centre[c] == c]
        centre[r] = own[0] if own else r
    return centre


def test_centres_equal_the_serial_pass(spark):
    rng = random.Random(11)
    for size, n in ((40, 60), (40, 15), (25, 0)):
        pairs = [tuple(rng.sample(range(size), 2)) for _ in range(n)]
        if n == 60:
            pairs += [(i, i + 1) for i in range(size - 1)]  # a long chain
        items = spark.createDataFrame([(i,) for i in range(size)], "rank long")
        got = {r.rank: r.centre for r in greedy.greedy_centres(items, spark.createDataFrame(pairs, "a long, b long")).collect()}
        assert got == serial(range(size), pairs)


def test_denoised_counts(spark):
    rows = ["ACGT"] * 5 + ["acgt"] + ["ACGA"] * 3 + ["ACCA"] * 2 + ["ACG", "", None, "TTTT"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "id long, seq string")
    got = sorted(tuple(r) for r in greedy.denoised(df).collect())
    assert got == [("ACCA", 2, "ACCA", 0, 1, 2), ("ACG", 1, "ACG", 0, 1, 1), ("ACGA", 3, "ACGT", 1, 2, 9), ("ACGT", 6, "ACGT", 0, 2, 9), ("TTTT", 1, "TTTT", 0, 1, 1)]
    assert {r.centre for r in greedy.denoised(df, min_size=3).collect()} == {"ACGT"}
    assert greedy.denoised(df.limit(0)).count() == 0


def test_name_clusters_equal_all_pairs(spark):
    rng = random.Random(4)
    base = ["alpha beta", "gamma ray", "delta wing", "omega", "zeta function", "é clair"]
    names = ["".join(c if rng.random() > 0.15 else rng.choice("abcxyz ") for c in rng.choice(base)) for _ in range(70)] + ["", "a", None, "omega", "omegaomegaomega"]
    rows = list(enumerate(names)) + [(99, "gamma ray"), (0, "zz")]
    df = spark.createDataFrame(rows, "k long, name string")
    first = {}
    for k, n in rows:
        if n is not None:
            first[n] = min(first.get(n, k), k)
    order = sorted(first, key=lambda n: (first[n], n))
    for threshold in (0.75, 0.9):
        label = {n: i for i, n in enumerate(order)}
        for i, a in enumerate(order):
            for b in order[i + 1 :]:
                if SequenceMatcher(None, a, b).ratio() >= threshold:
                    x, y = sorted((label[a], label[b]))
                    label = {n: x if v == y else v for n, v in label.items()}
        sizes = Counter(label.values())
        want = sorted((order[v], sizes[v], n) for n, v in label.items())
        assert sorted(tuple(r) for r in greedy.name_clusters(df, "name", "k", threshold).collect()) == want
