"""Permutation tests and enrichment against plain loops; the same at any partitioning."""

import math
from itertools import combinations

import numpy as np
import pytest

from spindrift.operators import permutations as p


def rows(seed, n=40, wide=6):
    rng = np.random.default_rng(seed)
    x = rng.normal(5, 2, (n, wide))
    x[:, wide // 2 :] += 0.8
    return x


def statistic(x, a, b, kind):
    if kind == "sum":
        return abs(x[:, b].sum() - x[:, a].sum())
    d = np.abs(x[:, b].mean(1) - x[:, a].mean(1))
    if kind == "mean_difference":
        return d.sum()
    v = (x[:, a].var(1) * len(a) + x[:, b].var(1) * len(b)) / (len(a) + len(b) - 2)
    return (d / np.sqrt(v * (1 / len(a) + 1 / len(b)))).sum()


@pytest.mark.parametrize("kind", ["mean_difference", "t", "sum"])
def test_exact_group_test_equals_all_divisions(spark, kind):
    x = rows(3)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x] + [(None, 1.0, 1.0, 1.0, 1.0, 1.0)], ", ".join(f"c{i} double" for i in range(6)))
    columns = [f"c{i}" for i in range(6)]
    for parts in (1, 5):
        r = p.group_test(df.repartition(parts), columns[:3], columns[3:], 20, kind).first()
        null = [statistic(x, list(a), [i for i in range(6) if i not in a], kind) for a in combinations(range(6), 3)]
        seen = statistic(x, [0, 1, 2], [3, 4, 5], kind)
        assert r.exact and r.permutations == 20
        assert r.observed == pytest.approx(seen) and r.null_mean == pytest.approx(np.mean(null)) and r.null_sd == pytest.approx(np.std(null))
        assert r.p == pytest.approx(sum(v >= seen - 1e-9 * seen for v in null) / 20)


def test_seeded_divisions_have_exact_sizes_and_any_partitioning(spark):
    choices, exact = p.splits(20, 9, 11, 50, seed=4)
    assert not exact and choices.shape == (50, 20) and all(len(set(c)) == 20 for c in choices)
    x = rows(5, 60, 20)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"c{i} double" for i in range(20)))
    c = [f"c{i}" for i in range(20)]
    one, two = (p.group_test(df.repartition(k), c[:9], c[9:], 99, seed=4).first() for k in (1, 7))
    assert one.p == two.p and one.observed == pytest.approx(two.observed)
    choices, _ = p.splits(20, 9, 11, 99, seed=4)
    null = [statistic(x, k[:9], k[9:], "mean_difference") for k in choices]
    assert one.p == pytest.approx((1 + sum(v >= one.observed * (1 - 1e-9) for v in null)) / 100)
    empty = p.group_test(df.limit(0), c[:9], c[9:], 19).first()
    assert (empty.observed, empty.p) == (0, 1)


def plain_score(ranks, weights, n):
    hit, up, missed, best = dict(zip(ranks, weights, strict=True)), 0.0, 0, (0.0, 0.0)
    total, m = sum(weights), len(ranks)
    values = [0.0]
    for i in range(1, n + 1):
        if i in hit:
            up += hit[i] / total
        else:
            missed += 1
        values.append(up - missed / (n - m))
    top, low = max(values), min(values)
    return top if top >= -low - 1e-12 else low


def test_enrichment_equals_the_plain_running_sum(spark):
    rng = np.random.default_rng(8)
    values = {f"g{i:02}": float(v) for i, v in enumerate(np.round(rng.normal(0, 2, 30), 2))}
    ranked = sorted(values, key=lambda g: (-values[g], g))
    sets = {"top": ranked[:5], "low": ranked[-4:], "mixed": [ranked[0], ranked[14], ranked[29]], "two": ranked[10:12], "one": ranked[:1], "other": ["x", "y", "z"]}
    features = spark.createDataFrame([*values.items(), ("g00", -99.0), (None, 1.0), ("n", None), ("m", float("nan"))], "name string, value double")
    members = spark.createDataFrame([(k, g) for k, own in sets.items() for g in [*own, own[0], "unknown"]], "gene_set string, member string")
    results = []
    for parts in (1, 6):
        found = {r.gene_set: r for r in p.enrichment(features.repartition(parts), members.repartition(parts), "name", "value", 500).collect()}
        results.append({k: (r.es, r.p) for k, r in found.items()})
        assert found.keys() == {"top", "low", "mixed", "two"}
        for k, r in found.items():
            at = sorted(ranked.index(g) + 1 for g in sets[k])
            want = plain_score(at, [abs(values[ranked[i - 1]]) for i in at], 30)
            assert r.es == pytest.approx(want) and r.normalised == pytest.approx(want / math.sqrt(len(at))) and r["size"] == len(at)
            assert r.leading == ",".join(ranked[i - 1] for i in at[:6]) and 0 < r.p <= 1 and r.exact == (len(at) == 2)
        null = [plain_score(list(c), [abs(values[ranked[i - 1]]) for i in c], 30) for c in combinations(range(1, 31), 2)]
        assert found["two"].p == pytest.approx(sum(abs(v) >= abs(found["two"].es) - 1e-9 for v in null) / len(null))
        assert found["top"].p < 0.05 and found["low"].es < 0
    assert results[0].keys() == results[1].keys() and all(results[0][k][1] == results[1][k][1] for k in results[0])
