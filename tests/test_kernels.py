import itertools
import math
import random

import numpy as np
import pytest

from spindrift.operators import alignment, learning, trees


def brute(a, b, match=2, mismatch=-1, gap=-2, local=False):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i == 0 or j == 0:
                t[i][j] = 0 if local else gap * (i + j)
            else:
                t[i][j] = max(t[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch), t[i - 1][j] + gap, t[i][j - 1] + gap, *([0] if local else []))
    return max(map(max, t)) if local else t[-1][-1]


@pytest.mark.parametrize("local", [False, True])
def test_alignment_scores(local):
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choices("ACGT", k=rng.randint(0, 12))) for _ in range(2))
        assert alignment.scores(a, b, local=local) == brute(a, b, local=local)


def test_aligned_frames(spark):
    df = spark.createDataFrame([(1, "ACGT", "ACGT"), (2, None, "AC"), (3, "", "")], "id long, x string, y string")
    assert {r.id: r.score for r in alignment.aligned(df, "x", "y", ["id"]).collect()} == {1: 8, 2: -4, 3: 0}


def test_search_finds_what_shares_seeds(spark):
    rng = random.Random(2)
    subjects = [(f"s{i}", "".join(rng.choices("ACGT", k=80))) for i in range(10)]
    queries = [("q0", subjects[3][1][10:50]), ("q1", "".join(rng.choices("ACGT", k=40)))]
    found = alignment.searched(spark.createDataFrame(queries, "id string, seq string"), spark.createDataFrame(subjects, "id string, seq string")).collect()
    assert [(r["query"], r.subject, r.score) for r in found] == [("q0", "s3", 80)]


@pytest.mark.parametrize("text", ["(a:1,b:2);", "((a,b)x:0.5,(c,d):1,e)root;", "a;", "((((a,b),c),d),e);"])
def test_newick_round_trip(text):
    assert trees.render(trees.parse(text)) == text


@pytest.mark.parametrize("text", ["(a,b", "a,b", "(a))"])
def test_broken_newick_raises(text):
    with pytest.raises((ValueError, TypeError)):
        trees.parse(text)


def distances_of(newick):
    nodes = trees.parse(newick)
    up = {n[0]: (n[1], n[3] or 0.0) for n in nodes}
    name = {n[2]: n[0] for n in nodes if n[2]}

    def path(x):
        out, far = {}, 0.0
        while x is not None:
            out[x] = far
            far += up[x][1]
            x = up[x][0]
        return out

    return {(a, b): min(path(name[a])[k] + path(name[b])[k] for k in path(name[a]).keys() & path(name[b]).keys()) for a, b in itertools.combinations(sorted(name), 2)}


def test_neighbour_joining_recovers_an_additive_tree():
    want = distances_of("((a:2,b:3):1,(c:4,d:1):2,e:5);")
    names = sorted({x for pair in want for x in pair})
    d = np.zeros((5, 5))
    for (a, b), v in want.items():
        d[names.index(a), names.index(b)] = d[names.index(b), names.index(a)] = v
    made = trees.neighbour_joining(names, d)
    assert distances_of(made) == pytest.approx(want) and trees.splits(made) == trees.splits("((a,b),(c,d),e);")


def test_average_linkage_is_ultrametric():
    made = distances_of(trees.average_linkage(["a", "b", "c"], np.array([[0, 2, 6], [2, 0, 8], [6, 8, 0]])))
    assert made == pytest.approx({("a", "b"): 2, ("a", "c"): 7, ("b", "c"): 7})


def test_splits_differ():
    assert len(trees.splits("((a,b),(c,d),e);") ^ trees.splits("((a,c),(b,d),e);")) == 4


def test_density_clusters_by_brute_force(spark):
    rng = random.Random(3)
    points = [(i, rng.gauss(i % 3 * 6, 0.7), rng.gauss(0, 0.7)) for i in range(120)] + [(200, 30.0, 30.0), (201, 30.0, 30.4)]
    got = {r.id: (r.cluster, r.core) for r in learning.density_clusters(spark.createDataFrame(points, "id long, x double, y double"), 0.8, 4).collect()}
    near = {i: [j for j, u, v in points if (x - u) ** 2 + (y - v) ** 2 <= 0.64] for i, x, y in points}
    core = {i for i in near if len(near[i]) >= 4}
    label = {i: i for i in core}
    while True:
        new = {i: min(label[j] for j in near[i] if j in core) for i in core}
        if new == label:
            break
        label = new
    for i in near:
        cluster, is_core = got[i]
        assert is_core == (i in core)
        assert cluster == label[i] if i in core else (cluster in {label[j] for j in near[i] if j in core} or cluster is None and not core & set(near[i]))


def test_targets_found_by_pairs_are_those_of_all_kmers(spark):
    import random

    from spindrift.operators import alignment as al

    rng = random.Random(9)
    draw = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    targets = [(f"t{i}", draw(rng.randint(30, 90))) for i in range(60)] + [("genome", draw(3000)), ("short", "ACG"), ("none", None)]
    targets += [("copy", targets[0][1]), ("mixed", targets[1][1][:40] + targets[2][1][:40])]
    reads = [(f"r{i}", targets[i][1][: rng.randint(9, 60)] + draw(rng.randint(0, 40))) for i in range(60)]
    reads += [("inside", targets[60][1][500:560]), ("tiny", targets[5][1][:8]), ("void", ""), ("null", None), ("rep", "A" * 50)]
    back = lambda x: x[::-1].translate(str.maketrans("ACGT", "TGCA"))
    own = lambda x: {min(m, back(m)) for m in (x[i : i + 8] for i in range(len(x or "") - 7))}
    left, right = (spark.createDataFrame(x, "id string, seq string") for x in (reads, targets))
    for share in (0.3, 0.5, 0.9):
        want = {}
        for name, seq in reads:
            mine = own(seq)
            best = max(((len(mine & own(y)) / len(mine), t) for t, y in targets), default=None) if mine else None
            if best and best[0] >= share:
                want[name] = (best[1], best[0])
        got = {r.read: (r.target, r.share) for r in al.assigned_by_kmers(left, right, 8, share).collect()}
        assert got == want and len(want) >= 5
    keys = al._pair_keys(right.withColumnRenamed("id", "name"), 8, None, [3, 4])
    assert keys.where("name = 'genome'").count() == 0 and keys.count() < 60 * 85 * 8


def test_sketches_are_not_broadcast(spark):
    from spindrift.operators import alignment as al

    df = spark.createDataFrame([("a", "ACGTTGCATTACG"), ("b", "ACGTTGCATTACC")], "id string, seq string")
    found = al.mash_distances(df, df, 8, 50)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 4


def test_sketch_pairs_of_copies_and_repeated_ids(spark):
    from spindrift.operators import sequences as seq

    df = spark.createDataFrame([("c", ["1", "2"]), ("a", ["1", "2"]), ("b", ["2", "3"]), ("b", ["2", "3"]), ("d", []), ("e", ["9"])], "id string, hashes array<string>")
    got = sorted((r.a, r.b, r.shared, round(r.jaccard, 4)) for r in seq.sketch_pairs(df).collect())
    assert got == [("a", "b", 1, 0.3333), ("a", "b", 1, 0.3333), ("a", "c", 2, 1.0), ("b", "c", 1, 0.3333), ("b", "c", 1, 0.3333)]


@pytest.mark.parametrize("local", [True, False])
def test_many_scores_equal_single_ones(local):
    """Pairs of unlike lengths fill one table together."""
    rng = random.Random(3)
    a, b = (["".join(rng.choice("ACGTé") for _ in range(rng.randint(0, 30))) for _ in range(300)] for _ in range(2))
    for costs in ((2, -1, -2), (1, 1, 1), (3, -2, -4)):
        assert alignment.many_scores(a, b, *costs, local).tolist() == [alignment.scores(x, y, *costs, local) for x, y in zip(a, b, strict=True)]


def test_copies_of_points_are_paired_once(spark, monkeypatch):
    """Pairs of equal points grew with the square of their copies (F16)."""
    spots = {(0.0, 0.0): 40, (0.5, 0.0): 1, (5.0, 5.0): 30, (9.0, 9.0): 2, (None, 1.0): 3}
    rows = [(i, *p) for i, p in enumerate(p for p, n in spots.items() for _ in range(n))]
    sizes = []
    whole = learning.materialized
    monkeypatch.setattr(learning, "materialized", lambda df: [x := whole(df), sizes.append(x.count())][0])
    got = {r.id: (r.cluster, r.core) for r in learning.density_clusters(spark.createDataFrame(rows, "id long, x double, y double"), 1.0, 3).collect()}
    want = [(0, True)] * 41 + [(41, True)] * 30 + [(None, False)] * 5
    assert [got[i] for i in range(len(rows))] == want and max(sizes) <= 10


def test_motif_rounds_and_batches(spark, monkeypatch):
    """Each round is one pass, and sequences are weighed together as they are alone."""
    import numpy as np

    from spindrift.operators import motifs

    rng = random.Random(5)
    seqs = ["".join(rng.choice("ACGTN") for _ in range(rng.randint(3, 40))) for _ in range(60)]
    models = np.random.default_rng(1).dirichlet([1] * 4, (7, 5))
    shares = np.linspace(0.1, 0.9, 7)
    whole, alone = motifs.expected(seqs, models, shares), [motifs.expected([s], models, shares) for s in seqs]
    for got, each in zip(whole, zip(*alone, strict=True), strict=True):
        assert np.allclose(got, sum(each))
    monkeypatch.setattr(motifs, "CELLS", 100)
    assert all(np.allclose(x, y) for x, y in zip(motifs.expected(seqs, models, shares), whole, strict=True))
    calls = []
    once = motifs._round
    monkeypatch.setattr(motifs, "_round", lambda *x: [calls.append(1), once(*x)][1])
    motifs.discover(spark.createDataFrame(list(enumerate(seqs)), "id long, seq string"), "id", "seq", 5, iterations=3, starts=3)
    assert len(calls) == 3


def test_local_scores_with_affine_gaps():
    """Searches scored pairs with linear gaps and without a matrix."""
    rng = random.Random(4)
    for scheme, letters in ((alignment.NUCLEOTIDE, "ACGTN"), (alignment.PROTEIN, "ARNDCWXé")):
        a = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(120)]
        b = [x[: len(x) // 2] + "".join(rng.choice(letters) for _ in range(rng.randint(0, 6))) + x[len(x) // 2 :] for x in a]
        first, more = scheme.gap_open + scheme.gap_extend, scheme.gap_extend

        def plain(x, y):
            h, e, f, top = {}, {}, {}, 0
            for i in range(1, len(x) + 1):
                for j in range(1, len(y) + 1):
                    e[i, j] = max(h.get((i, j - 1), 0) - first, e.get((i, j - 1), -999) - more)
                    f[i, j] = max(h.get((i - 1, j), 0) - first, f.get((i - 1, j), -999) - more)
                    pair = h.get((i - 1, j - 1), 0) + int(scheme.points[min(ord(x[i - 1]), 127), min(ord(y[j - 1]), 127)])
                    h[i, j] = max(0, pair, e[i, j], f[i, j])
                    top = max(top, h[i, j])
            return top

        assert alignment.local_scores(a, b, scheme).tolist() == [plain(x, y) for x, y in zip(a, b, strict=True)]
    assert (alignment.PROTEIN.points == alignment.PROTEIN.points.T).all()


def test_search_extends_words_on_both_strands(spark):
    """Words were counted in pairs and not extended, the other strand was not searched, and nothing had an E-value (F16)."""
    rng = random.Random(9)
    draw = lambda n: "".join(rng.choices("ACGT", k=n))
    back = lambda x: x[::-1].translate(str.maketrans("ACGT", "TGCA"))
    x, y = draw(60), draw(60)
    subjects = [("s0", draw(30) + x[:30] + "GG" + x[30:]), ("s1", draw(5) + back(y) + draw(5)), ("s2", draw(20) + x[5:17] + draw(20)), ("poly", "A" * 50), ("void", ""), ("none", None)]
    queries = [("x", x), ("y", y), ("a", "A" * 40), ("short", "ACG"), ("none", None)]
    left, right = spark.createDataFrame(queries, "id string, seq string"), spark.createDataFrame(subjects, "id string, seq string")
    made = alignment.searched(left, right)
    assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()  # records went whole through the driver (F2, F3)
    got = {(r["query"], r.subject): r for r in made.collect()}
    assert set(got) == {("x", "s0"), ("y", "s1")}  # twelve letters are no match of weight, and words of one letter are masked
    assert (got["x", "s0"].strand, got["x", "s0"].score) == ("+", 120 - 9) and (got["y", "s1"].strand, got["y", "s1"].score) == ("-", 120)
    letters = sum(len(q or "") for _, q in subjects)
    assert got["y", "s1"].evalue == pytest.approx(letters * 60 * 2 ** -((0.625 * 120 - math.log(0.41)) / math.log(2)))


def test_protein_search_scores_by_the_matrix(spark):
    """Proteins were scored by equal letters alone."""
    p = "MKWVTFISLLFLFSSAYSRGVFRRDAHKSE"
    near = p[:14] + "TSYAK" + p[19:]
    df = spark.createDataFrame([("p", p), ("near", near), ("far", "GGGGGPPPPPDDDDDEEEEENNNNNQQQQQ")], "id string, seq string")
    got = {(r["query"], r.subject): r.score for r in alignment.searched(df, df, 6, 2, 10, alignment.PROTEIN, 10.0).collect()}
    own = lambda a, b: sum(int(alignment.PROTEIN.points[ord(i), ord(j)]) for i, j in zip(a, b, strict=True))
    assert got["p", "p"] == own(p, p) and got["p", "near"] == got["near", "p"] == own(p, near) and ("p", "far") not in got


def test_distances_come_from_ranks_of_common_hashes(spark):
    """Both whole sketches were sent to each pair that shares a hash (F1)."""
    rng = random.Random(6)
    draw = lambda n: "".join(rng.choices("AC", k=n))
    texts = {f"s{i}": draw(rng.randint(3, 40)) for i in range(30)} | {"void": "", "none": None}
    texts["copy"] = texts["s3"]
    df = spark.createDataFrame(list(texts.items()), "id string, seq string")
    held = {r.id: list(r.sketch or []) for r in alignment.sketches(df, 5, 8).collect()}
    want = {}
    for q, x in held.items():
        for t, y in held.items():
            least = sorted({*x, *y})[:8]
            shared = len({*least} & {*x} & {*y})
            if shared:
                want[q, t] = (shared, round(shared / len(least), 9))
    made = alignment.mash_distances(df, df, 5, 8)
    assert {(r["query"], r.target): (r.shared, round(r.jaccard, 9)) for r in made.collect()} == want
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    twice = alignment.mash_distances(spark.createDataFrame([("a", "ACACCAAC"), ("a", "ACACCAAC"), ("a", "CCCCCAAA")], "id string, seq string"), df, 5, 8).where("target = 's1'")
    assert twice.count() == twice.distinct().count()


def test_pairs_of_many_copies_are_dealt_to_tasks(spark, monkeypatch):
    """All pairs of the copies of a sketch were made in one task."""
    from pyspark.sql import functions as F

    from spindrift.operators import sequences as seq

    monkeypatch.setattr(seq, "BLOCK", 10)
    rows = [(f"a{i}", ["1", "2"]) for i in range(90)] + [(f"b{i}", ["2", "3"]) for i in range(40)] + [("b0", ["2", "3"]), ("c", ["9"])]
    made = seq.sketch_pairs(spark.createDataFrame(rows, "id string, hashes array<string>"))
    got = sorted((r.a, r.b, r.shared) for r in made.collect())
    want = sorted((min(x, y), max(x, y), len({*p} & {*q})) for i, (x, p) in enumerate(rows) for y, q in rows[:i] if x != y and {*p} & {*q})
    assert got == want
    tasks = [r["n"] for r in made.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(tasks) == 4 and max(tasks) < len(want) / 2
