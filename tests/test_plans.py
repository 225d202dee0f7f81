import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from spindrift.functions import pvalues as p
from spindrift.operators import intervals as iv
from spindrift.operators import learning
from spindrift.plans import ordinals
from spindrift.plans.islands import islands
from spindrift.plans.ranges import overlapping


def frame(n=400, seed=1):
    rng = random.Random(seed)
    return pd.DataFrame({"k": range(n), "v": [rng.choice([None, rng.randint(-50, 50)]) for _ in range(n)]}).sample(frac=1, random_state=seed)


@pytest.mark.parametrize("kind", ["sum", "min", "max", "count", "last"])
def test_running_values(spark, kind):
    pdf = frame()
    got = ordinals.running(spark.createDataFrame([(int(k), None if v != v else int(v)) for k, v in zip(pdf.k, pdf.v, strict=True)], "k long, v long").repartition(7), ["k"], "v", "r", kind).toPandas().sort_values("k").reset_index(drop=True)
    v = pdf.sort_values("k").v.reset_index(drop=True).astype(float)
    want = {"sum": v.fillna(0).cumsum(), "min": v.cummin().ffill(), "max": v.cummax().ffill(), "count": v.notna().cumsum(), "last": v.ffill()}[kind]
    first = v.first_valid_index()
    assert (got.r[first:].astype(float) == want[first:].astype(float)).all()


def test_ordinals_are_dense_and_previous_rows_follow(spark):
    df = spark.createDataFrame(frame()[["k"]])
    got = ordinals.previous(ordinals.ordinal(df, [F.desc("k")], "n"), ["n"], "k", "back").toPandas().sort_values("n")
    assert got.n.tolist() == list(range(1, 401)) and got.k.tolist() == list(range(399, -1, -1)) and got.back.tolist()[1:] == got.k.tolist()[:-1]
    assert ordinals.ordinal(df.limit(0), ["k"]).count() == 0


def random_intervals(n, seed):
    rng = random.Random(seed)
    rows = [("c" + str(rng.randint(1, 2)), a := rng.randint(0, 60_000), a + rng.choice([0, 1, 5, 300, 40_000 if rng.random() < 0.05 else 20]), f"i{seed}_{i}", 1.0, rng.choice("+-.")) for i in range(n)]
    return pd.DataFrame(rows, columns=["chrom", "start", "stop", "name", "score", "strand"])


def test_islands_by_brute_force(spark):
    pdf = random_intervals(300, 1)
    got = islands(spark.createDataFrame(pdf).repartition(5), ["chrom"], "start", "stop", 10, ["name"]).toPandas()
    number, last, want = 0, None, {}
    for r in pdf.sort_values(["chrom", "start", "stop", "name"]).itertuples():
        if last is None or last[0] != r.chrom or r.start > last[1] + 10:
            number += 1
            last = (r.chrom, r.stop)
        last = (r.chrom, max(last[1], r.stop))
        want[r.name] = number
    assert dict(zip(got.name, got.island, strict=True)) == want


@pytest.mark.parametrize("slack", [0, 7])
def test_bin_join_by_brute_force(spark, slack):
    a, b = random_intervals(150, 2), random_intervals(150, 3)
    got = overlapping(spark.createDataFrame(a), spark.createDataFrame(b), slack=slack).select("a_name", "b_name").collect()
    want = [(x.name, y.name) for x in a.itertuples() for y in b.itertuples() if x.chrom == y.chrom and x.start - slack < y.stop and y.start < x.stop + slack]
    assert sorted(map(tuple, got)) == sorted(want)


def test_closest_by_brute_force(spark):
    a, b = random_intervals(80, 4), random_intervals(60, 5)
    a, b = a[a.start < a.stop], b[b.start < b.stop]
    got = {r.name: (r.distance, r.b_name) for r in iv.closest(spark.createDataFrame(a), spark.createDataFrame(b[b.chrom == "c1"])).collect()}
    for x in a.itertuples():
        near = [(max(0, x.start - y.stop + 1 if y.stop <= x.start else y.start - x.stop + 1 if y.start >= x.stop else 0), y.start, y.stop, y.name) for y in b.itertuples() if y.chrom == x.chrom == "c1"]
        assert got[x.name] == ((min(near)[0], min(near)[3]) if near else (-1, None))


def test_greedy_selection_has_no_overlap(spark):
    pdf = random_intervals(200, 6)
    kept = iv.without_overlaps(spark.createDataFrame(pdf)).toPandas().sort_values(["chrom", "start", "stop"])
    back = kept.groupby("chrom").stop.cummax().groupby(kept.chrom).shift()
    assert (kept.start >= back.fillna(-1)).all() and len(kept) > 10


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9), (6, 5), (10, 20), (20, 30), (30, 40), (40, 50)], "a long, b long")
    assert {r.node: r.component for r in learning.components(edges, "a", "b").collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 10: 10, 20: 10, 30: 10, 40: 10, 50: 10}


def test_p_values(spark):
    row = spark.range(1).select(
        p.chi2_p(F.lit(3.841459), F.lit(1.0)).alias("chi"), p.chi2_p(F.lit(18.307038), F.lit(10.0)).alias("chi10"), p.t_p(F.lit(2.228139), F.lit(10.0)).alias("t"), p.t_p(F.lit(-12.7062), F.lit(1.0)).alias("t1"),
        p.f_p(F.lit(3.708265), F.lit(3.0), F.lit(10.0)).alias("f"), p.normal_p(F.lit(1.959964)).alias("z"), p.fisher_p(F.lit(3), F.lit(1), F.lit(1), F.lit(3)).alias("fisher"), p.chi2_p(F.lit(0.0), F.lit(3.0)).alias("one"),
    ).first()
    for name in ("chi", "chi10", "t", "t1", "f", "z"):
        assert row[name] == pytest.approx(0.05, abs=1e-5), name
    assert row.fisher == pytest.approx(0.4857142857) and row.one == 1


@pytest.mark.parametrize("method", ["bonferroni", "holm", "bh", "by"])
def test_adjusted_p_values(spark, method):
    ps = [0.01, 0.02, 0.02, 0.5, 0.9, 0.001, None]
    got = {(r.i): r.q for r in p.adjusted(spark.createDataFrame(list(enumerate(ps)), "i int, p double"), "p", method).collect()}
    known = sorted((v, i) for i, v in enumerate(ps) if v is not None)
    m, want = len(known), {}
    scale = sum(1 / k for k in range(1, m + 1)) if method == "by" else 1
    if method == "bonferroni":
        want = {i: min(1, v * m) for v, i in known}
    elif method == "holm":
        top = 0.0
        for k, (v, i) in enumerate(known):
            top = max(top, v * (m - k))
            want[i] = min(1, top)
    else:
        low = 1.0
        for k in range(m, 0, -1):
            low = min(low, known[k - 1][0] * m / k * scale)
            want[known[k - 1][1]] = low
    assert got[6] is None and all(got[i] == pytest.approx(w) for i, w in want.items())


def test_one_interval_as_long_as_a_chromosome(spark):
    rng = random.Random(8)
    draw = lambda n: [(rng.choice("cd"), s, s + rng.choice([0, 1, 5, 64, 65, 700]), f"n{i}") for i, s in enumerate(rng.randrange(20_000) for _ in range(n))]
    a, b = draw(80) + [("c", 0, 3_000_000, "whole")], draw(120) + [("d", 0, 1 << 40, "endless"), ("c", 5000, 5000, "none")]
    schema = "chrom string, start long, stop long, name string"
    left, right = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    for slack in (0, 30):
        want = sorted((x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] - slack < y[2] and y[1] < x[2] + slack)
        assert sorted((r.a_name, r.b_name) for r in overlapping(left, right, slack).collect()) == want
    assert {r.name for r in overlapping(left, right, how="left_anti").collect()} == {x[3] for x in a} - {x for x, _ in ((x[3], y) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])}
    assert overlapping(left.limit(0), right).count() == 0


def test_subtraction_carries_no_other_columns(spark):
    """Whole rows went through its shuffles, twice over."""
    from spindrift.operators import intervals

    a = spark.createDataFrame([("c", 0, 10, "x", 1.0, "p"), ("c", 0, 10, "x", 2.0, "q"), ("c", 5, 8, None, 1.0, "r"), ("d", 1, 2, "y", None, "s")], "chrom string, start long, stop long, name string, score double, payload string")
    b = spark.createDataFrame([("c", 2, 3, "u", 1.0), ("c", 5, 9, "v", 1.0)], "chrom string, start long, stop long, name string, score double")
    made = intervals.subtract(a, b)
    assert sorted(tuple(r) for r in made.collect()) == sorted([("c", 0, 2, "x"), ("c", 3, 5, "x"), ("c", 9, 10, "x")] * 2 + [("d", 1, 2, "y")])
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "payload, payload" not in plan and "score, score" not in plan


def test_coverage_carries_no_other_columns(spark):
    """Whole rows were the key of its joins."""
    from spindrift.operators import intervals

    a = spark.createDataFrame([("c", 0, 10, "x", "p"), ("c", 0, 10, "x", "p"), (None, 0, 4, "z", "q")], "chrom string, start long, stop long, name string, payload string")
    b = spark.createDataFrame([("c", 2, 4, "u", 1.0), ("c", 3, 5, "v", 1.0)], "chrom string, start long, stop long, name string, score double")
    made = intervals.coverage(a, b).select("name", "hits", "covered", "fraction")
    assert sorted(tuple(r) for r in made.collect()) == [("x", 2, 3, 0.3)] * 2 + [("z", 0, 0, 0.0)]
    assert "payload, payload" not in made._jdf.queryExecution().executedPlan().toString()
