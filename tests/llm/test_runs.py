"""Runs against brute force over all periods, on words and on whole rows."""

import random

import pytest

from spindrift.llm.runs import factors, periodic_runs, runs


def brute(s, least):
    """All maximal repetitions by comparing at each distance."""
    found = {}
    for q in range(1, len(s) // 2 + 1):
        i = 0
        while i < len(s) - q:
            j = i
            while j < len(s) - q and s[j] == s[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def drawn(rng):
    s = [rng.randrange(rng.choice([1, 2, 3, 4])) for _ in range(rng.randrange(40))]
    if rng.random() < 0.5:
        unit, at = [rng.randrange(3) for _ in range(rng.randrange(1, 7))], rng.randrange(len(s) + 1)
        s = s[:at] + unit * rng.randrange(1, 6) + s[at:]
    return s + s[: rng.randrange(len(s) + 1)]


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_equal_brute_force(least):
    rng = random.Random(least)
    for _ in range(1500):
        s = drawn(rng)
        assert runs(s, least) == brute(s, least), s


def test_factors_are_longest_earlier_strings():
    rng = random.Random(4)
    for _ in range(300):
        s = drawn(rng)
        at = 0
        for start, size, earlier in factors(s):
            assert start == at
            if earlier >= 0:
                assert earlier < start and s[earlier : earlier + size] == s[start : start + size]
            longer = s[start : start + size + (earlier >= 0)]
            assert (earlier >= 0 and start + size == len(s)) or not any(s[i : i + len(longer)] == longer for i in range(start))
            at += size
        assert at == len(s)


def test_whole_rows(spark):
    rng = random.Random(9)
    texts = [None, "", "  \n ", "a " * 12, "a " * 11, "x y z " * 30 + "q " + "x y z " * 5]
    for _ in range(60):
        s = []
        for _ in range(rng.randrange(9)):
            s += [rng.choice("abcdefghé") for _ in range(rng.randrange(1, 9))] * rng.choice([1, 1, 2, 3])
        texts.append("\t".join(s))
    texts += texts[-2:]  # repeated rows stay
    rows = spark.createDataFrame([(i, t, "runs") for i, t in enumerate(texts)], "id long, text string, runs string")
    got = {r.id: r for r in periodic_runs(rows, least=12).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        words = (t or "").split()
        want = brute(words, 12)
        gone = {k for s, n, q in want for k in range(s + q, s + n)}
        assert [tuple(r) for r in got[i].runs] == want
        assert got[i].collapsed == " ".join(w for k, w in enumerate(words) if k not in gone)
        assert got[i].n_words == len(words)
    assert periodic_runs(rows.where("id < 0")).count() == 0


def test_long_and_very_periodic(spark):
    text = "la " * 50_000 + " ".join(f"w{i}" for i in range(20_000))
    row = periodic_runs(spark.createDataFrame([(1, text)], "id long, text string")).first()
    assert [tuple(r) for r in row.runs] == [(0, 50_000, 1)]
    assert row.n_words == 70_000 and row.collapsed.startswith("la w0 w1 ")
