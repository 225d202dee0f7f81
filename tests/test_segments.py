"""Segments against the serial recursion, and motifs planted in random sequences."""

import random

import numpy as np
import pytest

from spindrift.operators import motifs, segments


def serial(values, delta, margin=4, depth=12):
    x = np.array(values)

    def split(lo, hi, level):
        n = hi - lo
        if n >= 2 * margin and level < depth:
            base = ((x[lo:hi] - x[lo:hi].mean()) ** 2).sum()
            best = None
            for k in range(lo + margin, hi - margin):
                gain = base - ((x[lo:k] - x[lo:k].mean()) ** 2).sum() - ((x[k:hi] - x[k:hi].mean()) ** 2).sum()
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, k)
            if best and best[0] > delta * base / n:
                return split(lo, best[1], level + 1) + split(best[1], hi, level + 1)
        return [(lo, hi)]

    return split(0, len(x), 0)


def test_segments_equal_the_serial_recursion(spark):
    rng = np.random.default_rng(6)
    series = {"a": np.r_[rng.normal(0, 0.2, 40), rng.normal(1, 0.2, 25), rng.normal(-1, 0.2, 30)], "b": rng.normal(0, 1, 7), "c": np.r_[rng.normal(3, 0.1, 12), rng.normal(2, 0.1, 20)]}
    rows = [(c, i * 10, float(v)) for c, own in series.items() for i, v in enumerate(own)] + [("a", 5, None)]
    df = spark.createDataFrame(rows, "chrom string, pos long, value double").repartition(3)
    for delta in (5.0, 12.0):
        found = {}
        for r in segments.segmented(df, "chrom", ["pos"], "value", delta).collect():
            found.setdefault((r.chrom, r.segment), []).append(r.pos)
        for c, own in series.items():
            want = serial(own, delta)
            assert [(min(found[c, k]) // 10, max(found[c, k]) // 10 + 1) for k in range(len(want))] == want and (c, len(want)) not in found
    got = sorted(segments.copy_segments(df, delta=12.0).collect(), key=lambda r: (r.chrom, r.segment))
    assert [(r.chrom, r.state) for r in got] == [("a", "neutral"), ("a", "gain"), ("a", "loss"), ("b", got[3].state), ("c", "gain"), ("c", "gain")]
    assert got[1].copies == pytest.approx(2 * 2 ** got[1].mean) and got[0].n == 40
    assert segments.copy_segments(df.limit(0)).count() == 0


def planted(seed, n=120, share=0.8):
    rng = random.Random(seed)
    seqs = []
    for i in range(n):
        s = [rng.choice("ACGT") for _ in range(40)]
        if i < n * share:
            at = rng.randrange(32)
            s[at : at + 8] = [c if rng.random() < 0.92 else rng.choice("ACGT") for c in "TGACGTCA"]
        seqs.append("".join(s))
    return [*seqs, None, "ACG", "NNNNNNNNNNNN"]


@pytest.mark.parametrize("kind", ["zoops", "oops"])
def test_planted_motif_is_found_and_likelihood_never_falls(spark, kind):
    df = spark.createDataFrame(list(enumerate(planted(3))), "id long, seq string").repartition(4)
    found = motifs.discover(df, "id", "seq", 8, kind, 25, 16)
    assert any("TGACGTCA"[i : i + 6] in found.consensus for i in range(3)) and found.information > 6
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(found.history, found.history[1:], strict=False))
    assert kind == "oops" or 0.6 < found.share < 0.95
    rows = motifs.motif_rows(found, df).collect()
    assert len(rows) == 8 and all(r.a + r.c + r.g + r.t == pytest.approx(1) for r in rows)
    assert motifs.discover(df.limit(0), "id", "seq") is None and motifs.motif_rows(None, df).count() == 0


def test_one_round_equals_plain_sums():
    rng = np.random.default_rng(1)
    models = rng.dirichlet(np.ones(4), (2, 5))
    seqs, shares = ["ACGTACGTTGCA", "TTTTTTT", "ACN", "ACGNACGTA"], np.array([0.3, 0.9])
    counts, sites, likelihood, n = motifs.expected(seqs, models, shares)
    assert n == 3
    for m in range(2):
        want, many, total = np.zeros((5, 4)), 0.0, 0.0
        for s in seqs:
            w = [s[i : i + 5] for i in range(len(s) - 4) if "N" not in s[i : i + 5]]
            if not w:
                continue
            ratio = [np.prod([models[m, i, "ACGT".index(c)] / 0.25 for i, c in enumerate(x)]) * shares[m] / len(w) for x in w]
            all_ = sum(ratio) + 1 - shares[m]
            total += np.log(all_)
            for x, r in zip(w, ratio, strict=True):
                many += r / all_
                for i, c in enumerate(x):
                    want[i, "ACGT".index(c)] += r / all_
        assert np.allclose(counts[m], want) and sites[m] == pytest.approx(many) and likelihood[m] == pytest.approx(total)
