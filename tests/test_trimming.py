"""Trimming and presence against brute force on small inputs, with nulls, empty texts and empty tables."""

import random

from spindrift.operators import trimming as o

READ = "id long, seq string, qual string"


def cut(q, threshold):
    sums, now = [], 0.0
    for x in q:
        now += sum(q) - threshold * len(q) - x * len(q)
        sums.append(now)
    return sums.index(max(sums)) + 1 if sums and max(sums) > 0 else 0


def test_worst_ends_go(spark):
    rng = random.Random(5)
    reads = [(i, "".join(rng.choices("acgt", k=n)), "".join(chr(33 + (rng.randrange(12) if min(j, n - 1 - j) < 6 else rng.randrange(20, 41))) for j in range(n))) for i, n in enumerate([0, 1, 2, 15, 30, 45, 60])]
    got = {r.id: (r.seq, r.qual) for r in o.mott_trimmed(spark.createDataFrame(reads + [(90, None, "I"), (91, "A", None)], READ), 1.0, 1).collect()}
    want = {}
    for i, s, t in reads:
        k = cut([ord(c) - 33 for c in t], 1.0)
        s, t = s[k:].upper(), t[k:]
        k = cut([ord(c) - 33 for c in t[::-1]], 1.0)
        s, t = s[: len(s) - k], t[: len(t) - k]
        if s:
            want[i] = (s, t)
    assert got == want and any(len(want[i][0]) < len(s) for i, s, _ in reads if i in want)
    assert o.mott_trimmed(spark.createDataFrame([], READ)).count() == 0


def test_adapters_are_located(spark):
    df = spark.createDataFrame([(1, "ttACGTaaaGCATccGCATc", ""), (2, "GGGG", ""), (3, "", ""), (4, None, "")], READ)
    got = {r.id: (r.adapter_5p, r.adapter_3p, r.trimmed_length, r.kept) for r in o.adapters_located(df, "ACGT", "GCAT", 4).where("id < 4").collect()}
    assert got == {1: (2, 15, 12, True), 2: (-1, -1, 4, True), 3: (-1, -1, 0, False)}


def test_gappy_columns_go(spark):
    df = spark.createDataFrame([(1, "A-C-G"), (2, "A--TG"), (3, "AG."), (4, None)], "id long, seq string")
    assert {r.id: r.seq for r in o.gap_trimmed(df, 0.5).collect()} == {1: "AG", 2: "AG", 3: "A"}
    assert o.gap_trimmed(df.limit(0)).count() == 0


def test_presence_in_two_groups(spark):
    rows = [("g", c, v) for c, v in zip("abcdef", [5.0, 5.0, 5.0, 0.0, 0.0, None], strict=True)] + [("h", c, 5.0) for c in "abcdef"]
    got = {r.row: (r.on_a, r.on_b, r.odds, round(r.p, 6)) for r in o.on_off(spark.createDataFrame(rows, "row string, column string, value double"), list("abc"), list("def")).collect()}
    assert got == {"g": (3, 0, None, 0.1), "h": (3, 3, None, 1.0)}


def test_adapters_and_low_ends(spark):
    rows = [(1, "ttACGTTgg", "IIIIIIIII"), (2, "TTTTTTTT", "IIIII!!!"), (3, "ACGTT", "IIIII"), (4, None, None), (5, "TTGGCATTACGTT", None), (6, "TTTT", "!!!!")]
    df = spark.createDataFrame(rows, "id long, seq string, qual string")
    got = {r.id: (r.seq, r.qual, r.length, r.removed, r.adapters, r.mean_quality, r.kept) for r in o.adapter_trimmed(df, ["ACGTT", "ggca"], 20, 2).collect()}
    assert got == {
        1: ("TT", "II", 9, 7, 1, 40.0, True), 2: ("TTTTT", "IIIII", 8, 3, 0, 40.0, True), 3: ("", "", 5, 5, 1, 0.0, False), 4: ("", None, 0, 0, 0, 0.0, False), 5: ("TT", None, 13, 11, 2, 0.0, True), 6: ("", "", 4, 4, 0, 0.0, False),
    }
    assert o.adapter_trimmed(df.limit(0), []).count() == 0


def test_primers(spark):
    # the reverse primer TAAC is read as GTTA
    rows = [(1, "xxACGmmmmGTTAyy"), (2, "ACGmmmm"), (3, "mmGTTA"), (4, "GTTAmmACG"), (5, None), (6, "acgGTTAgtta")]
    df = spark.createDataFrame(rows, "id long, seq string")
    got = {r.id: (r.status, r.start, r.stop, r.seq) for r in o.primers_trimmed(df, "ACG", "TAAC").collect()}
    lost = ("primer_not_found", -1, -1, None)
    assert got == {1: ("trimmed", 5, 9, "MMMM"), 2: lost, 3: lost, 4: ("trimmed", 9, 9, ""), 5: lost, 6: ("trimmed", 3, 7, "GTTA")}
    whole = {r.id: r.seq for r in o.primers_trimmed(df, "ACG", "TAAC", remove=False).collect()}
    assert whole[1] == "ACGMMMMGTTA" and {r.status for r in o.primers_trimmed(df).collect()} == {"kept"}


def test_worst_ends_take_one_pass_over_the_qualities(spark):
    plan = o.mott_trimmed(spark.createDataFrame([(1, "ACGT", "IIII")], READ), 5.0, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan  # running sums as nested expressions were made anew for each use of a cut
    long = [(1, "A" * 100_000, "#" * 300 + "I" * 99_400 + "#" * 300), (2, "C" * 30, "I" * 30)]
    assert {r.id: len(r.seq) for r in o.mott_trimmed(spark.createDataFrame(long, READ), 5.0, 1).collect()} == {1: 99_400, 2: 30}
