"""Operators against brute force on small inputs: repeated rows, repeated keys, neighbours, label propagation."""

import math
import random
from statistics import median

import numpy as np

from spindrift.operators import annotation as an
from spindrift.operators import graphs
from spindrift.operators import intervals as iv
from spindrift.operators import statistics as st
from spindrift.sources import formats

BED = "chrom string, start long, stop long, name string, score double, strand string"


def test_repeated_rows_are_measured_once_and_stay(spark):
    a = spark.createDataFrame([("c", 0, 100, "a", 0.0, "+")] * 2 + [("c", 200, 210, "b", None, None)] * 2, BED)
    b = spark.createDataFrame([("c", 10, 20, "x", 0.0, "+")], BED)
    got = sorted((r.name, r.hits, r.covered, r.fraction) for r in iv.coverage(a, b).collect())
    assert got == [("a", 1, 10, 0.1)] * 2 + [("b", 0, 0, 0.0)] * 2
    left = sorted((r.name, r.start, r.stop) for r in iv.subtract(a, b).collect())
    assert left == [("a", 0, 10)] * 2 + [("a", 20, 100)] * 2 + [("b", 200, 210)] * 2


def test_of_a_repeated_key_the_last_counts(spark, tmp_path):
    (tmp_path / "x.gff").write_text("c\t.\tgene\t1\t9\t.\t+\t.\tID=a;Note=1;ID=b;Note=1\n")
    (tmp_path / "x.vcf").write_text("c\t1\t.\tA\tC\t.\tPASS\tDP=1;AF=2;DP=3\n")
    (tmp_path / "x.sam").write_text("q\t0\tc\t1\t9\t4M\t*\t0\t0\tACGT\t*\tNM:i:1\tNM:i:2\tXX:Z:y\n")
    assert formats.gff(spark, str(tmp_path / "x.gff")).first().attrs == {"ID": "b", "Note": "1"}
    assert formats.vcf(spark, str(tmp_path / "x.vcf")).first().info == {"AF": "2", "DP": "3"}
    assert formats.sam(spark, str(tmp_path / "x.sam")).first().tags == {"NM": "2", "XX": "y"}


def km(p, q):
    a, b, c, d = map(math.radians, (*p, *q))
    return 2 * 6371.0088 * math.asin(min(1, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))


def test_every_point_has_its_nearest(spark):
    rng = random.Random(3)
    points = [(i, rng.uniform(-3, 3), rng.uniform(-3, 3)) for i in range(40)] + [(40, 85.0, 10.0), (41, -85.0, -170.0)]
    got = {}
    for r in graphs.nearest_points(spark.createDataFrame(points, "id long, lat double, lon double"), 3, 100.0).collect():
        got.setdefault(r.a, []).append((r["rank"], r.b))
    for i, *p in points:
        want = sorted((km(p, q), j) for j, *q in points if j != i)[:3]
        assert [b for _, b in sorted(got[i])] == [j for _, j in want]
    two = spark.createDataFrame(points[:2], "id long, lat double, lon double")
    assert graphs.nearest_points(two, 3).count() == 2 and graphs.nearest_points(two.limit(0)).count() == 0


def test_nearest_vectors_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(graphs, "BLOCK", 16)
    v = np.random.default_rng(2).normal(size=(50, 4))
    got = {(r.a, r["rank"]): r.b for r in graphs.nearest_vectors(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>"), "id", "v", 4).collect()}
    for i in range(50):
        d = np.linalg.norm(v - v[i], axis=1)
        d[i] = np.inf
        assert [got[i, k + 1] for k in range(4)] == np.argsort(d)[:4].tolist()


def test_two_cliques_are_two_communities(spark):
    cliques = [(a + o, b + o) for o in (0, 10) for a in range(5) for b in range(a)] + [(0, 10), (3, 3), (None, 4)]
    found = {r.node: r.community for r in graphs.communities(spark.createDataFrame(cliques, "a long, b long"), "a", "b").collect()}
    assert len({found[i] for i in range(5)}) == 1 and len({found[i] for i in range(10, 15)}) == 1 and found[0] != found[10]
    rows = [(i, [float(i < 20) * 50 + math.sin(i), math.cos(i)]) for i in range(40)]
    groups = {r.node: r.community for r in graphs.knn_clusters(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v").collect()}
    assert len(groups) == 40 and not {groups[i] for i in range(20)} & {groups[i] for i in range(20, 40)}


def test_spliced_proteins_of_both_strands(spark):
    genome = spark.createDataFrame([("s", "ATGGCCxxxTAA".replace("x", "T"))], "id string, seq string")
    cds = [("s", 1, 6, "+", "m1"), ("s", 10, 12, "+", "m1"), ("s", 1, 3, "-", "m2"), ("s", 10, 12, "-", "m2"), ("s", 1, 3, "+", None)]
    df = spark.createDataFrame(cds, "seqid string, start long, stop long, strand string, parent string")
    assert {r.parent: r.protein for r in an.cds_proteins(df, genome, False, 1).collect()} == {"m1": "MA", "m2": "LH"}
    assert [r.parent for r in an.cds_proteins(df, genome, True, 2).collect()] == ["m1"]


def test_bootstrap_interval_covers_the_mean_at_any_partitioning(spark):
    rows = [(i, float(x)) for i, x in enumerate(np.random.default_rng(1).normal(5, 2, 400))] + [(400, None)]
    df = spark.createDataFrame(rows, "id long, x double")
    one, two = (st.bootstrap_means(df.repartition(n), "id", "x", 400).first() for n in (1, 5))
    assert one.n == 400 and np.allclose([one.low, one.high], [two.low, two.high])
    se = 2 / 20
    assert abs(one.low - (one["mean"] - 1.96 * se)) < 0.06 and abs(one.high - (one["mean"] + 1.96 * se)) < 0.06


def test_peaks_without_names_and_with_one_name_stay_apart(spark):
    genes = spark.createDataFrame([("c", "gene", 101, 200, "+", "g1"), ("c", "gene", 8001, 8100, "-", "g2")], "seqid string, type string, start long, stop long, strand string, id string")
    rows = [("c", 150, 160, None), ("c", 150, 160, None), ("c", 7000, 7010, "x"), ("c", 180, 190, "x"), ("z", 5, 9, None)]
    peaks = spark.createDataFrame(rows, "chrom string, start long, stop long, name string")
    got = sorted((tuple(r) for r in an.nearest_genes(peaks, genes, 20).collect()), key=str)
    assert got == [("c", 150, 160, None, "intragenic", 50, "g1")] * 2 + [("c", 180, 190, "x", "intragenic", 80, "g1"), ("c", 7000, 7010, "x", "distal", 1090, "g2"), ("z", 5, 9, None, "distal", None, None)]
    near = sorted((tuple(r) for r in an.genes_nearby(peaks, genes).collect()), key=str)
    assert near == [("c", 150, 160, None, "g1", 100, 200, 0, True)] * 2 + [("c", 180, 190, "x", "g1", 100, 200, 0, True), ("c", 7000, 7010, "x", "g2", 8000, 8100, 991, False)]
    assert an.genes_nearby(peaks, genes, 500).count() == 3


def test_coding_density_by_strand(spark):
    rows = [("a", "ATG" + "GCC" * 12 + "TAA"), ("a", "TTA" + "GGC" * 12 + "CAT"), ("e", ""), ("n", None)]
    got = sorted(tuple(round(x, 4) if isinstance(x, float) else x for x in r) for r in an.coding_density(spark.createDataFrame(rows, "id string, seq string"), "id", "seq").collect())
    assert [r[:5] for r in got] == [("a", 42, 0.0, 0.9286, 0.9286), ("a", 42, 0.9286, 0.0, 0.9286), ("e", 0, 0.0, 0.0, 0.0), ("n", 0, 0.0, 0.0, 0.0)]


def test_repeated_reads_stay_apart(spark):
    from spindrift.operators import sequences as sq

    reads = spark.createDataFrame([("a", "ACGTTTTT"), ("a", "ACGTTTTT"), ("a", "GGGTTTTT"), ("b", "AC"), ("c", None)], "id string, seq string")
    codes = spark.createDataFrame([("one", "ACG"), ("two", "GGG")], "name string, barcode string")
    got = sorted(tuple(r) for r in sq.barcoded(reads, codes, "seq", 1).collect())
    assert got == [("a", "one", 0), ("a", "one", 0), ("a", "two", 0), ("b", "one", 1)]
    depth = sorted(tuple(r) for r in sq.normalised(reads, 5, 2.5).collect())
    assert [d[0] for d in depth] == ["a", "a", "a", "b", "c"] and depth[3][1] == depth[4][1] == 0.0
    assert all(d[1] >= 2 for d in depth[:3])


def test_translation_takes_long_sequences_in_one_pass(spark):
    from pyspark.sql import functions as F

    from spindrift.functions import sequences as s

    c = F.col("seq")
    rows = spark.createDataFrame([("ATGGCN" * 20_000 + "TA",), (None,), ("AU",), ("augTAA\nGC",)], "seq string").select(s.translated(c).alias("p"), s.translated(c, 1).alias("q")).collect()
    assert [r.p for r in rows] == ["MX" * 20_000, "", "", "X*X"] and rows[0].q[:4] == "WXWX"


def test_equal_reads_are_cut_once(spark, monkeypatch):
    """Each copy of a read sent all its k-mers through two shuffles."""
    from spindrift.operators import sequences as sq

    cut = []
    monkeypatch.setattr(sq, "materialized", lambda df: cut.append(df.checkpoint()) or cut[-1])
    rows = [(f"r{i}", "acgtACGTAC" if i % 2 else "ACGTACGTAC") for i in range(40)] + [("s", "GGGGGTTT"), ("n", None), ("e", "")]
    got = sorted(tuple(r) for r in sq.normalised(spark.createDataFrame(rows, "id string, seq string"), 5, 120.0).collect())
    counts = {}
    canonical = lambda w: min(w, w[::-1].translate(str.maketrans("ACGT", "TGCA")))
    words = {i: [canonical(s.upper()[j : j + 5]) for j in range(len(s) - 4)] for i, s in ((i, s or "") for i, s in rows)}
    for w in (w for own in words.values() for w in own):
        counts[w] = counts.get(w, 0) + 1
    want = [(i, float(median(counts[w] for w in own)) if own else 0.0) for i, own in words.items()]
    assert got == sorted(x for x in want if x[1] <= 120) and cut[0].count() == 4
