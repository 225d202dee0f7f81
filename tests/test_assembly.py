"""Unitigs against a walk on one machine, and list ranking on lists and rings."""

import random

import pytest

from spindrift.operators import assembly


def rc(x):
    return x[::-1].translate(str.maketrans("ACGT", "TGCA"))


def walked(reads, k, least=1):
    """Unitigs by walks from each k-mer, both ways."""
    from collections import Counter

    n = Counter(min(w, rc(w)) for r in reads for i in range(len(r or "") - k + 1) for w in [r[i : i + k]] if set(w) <= set("ACGT"))
    nodes = {x for m, c in n.items() if c >= least for x in (m, rc(m))}
    after = lambda x: [x[1:] + c for c in "ACGT" if x[1:] + c in nodes]
    before = lambda x: [c + x[:-1] for c in "ACGT" if c + x[:-1] in nodes]

    def step(x):
        y = after(x)
        return y[0] if len(y) == 1 and len(before(y[0])) == 1 and y[0] != rc(x) else None

    def back(x):
        y = before(x)
        return y[0] if len(y) == 1 and step(y[0]) == x else None

    found = set()
    for x in nodes:
        start, seen = x, {x}
        while (b := back(start)) is not None and b not in seen:
            start = b
            seen.add(b)
        if back(start) is not None:  # a ring: cut before the least k-mer of both strands
            ring = [start]
            while (y := step(ring[-1])) != start:
                ring.append(y)
            least_node = min(ring)
            if least_node > min(map(rc, ring)):
                continue
            at = ring.index(least_node)
            path = ring[at:] + ring[:at]
        else:
            path = [start]
            while (y := step(path[-1])) is not None:
                path.append(y)
        seq = path[0] + "".join(p[-1] for p in path[1:])
        found.add((min(seq, rc(seq)), len(path), round(sum(n[min(p, rc(p))] for p in path) / len(path), 6)))
    return found


@pytest.mark.parametrize("k", [7])
def test_unitigs_equal_a_walk(spark, k):
    rng = random.Random(k)
    genome = "".join(rng.choice("ACGT") for _ in range(400))
    reads = [genome[i : i + 40] for i in rng.sample(range(360), 60)]
    reads = [rc(r) if i % 2 else r for i, r in enumerate(reads)]
    ring = "ACCGGTATTAGCATG"
    reads += [(ring * 3)[: 2 * len(ring)], "NNNN", None, "AC", "ACGTNACGTTGCANNN"]
    df = spark.createDataFrame([(r,) for r in reads], "seq string")
    for least in (1, 2):
        got = {(r.seq, r.kmers, round(r.coverage, 6)) for r in assembly.unitigs(df, k, least).collect()}
        assert got == walked(reads, k, least)
    assert assembly.unitigs(df.limit(0), k).count() == 0
    with pytest.raises(ValueError):
        assembly.unitigs(df, 4)


def test_a_genome_comes_back_whole_and_a_ring_is_cut(spark):
    rng = random.Random(1)
    genome, ring = ("".join(rng.choice("ACGT") for _ in range(n)) for n in (700, 100))
    reads = [genome[i : i + 70] for i in range(0, 631, 10)] + [(ring + ring)[i : i + 70] for i in range(0, 100, 10)]
    got = sorted(assembly.unitigs(spark.createDataFrame([(r,) for r in reads], "seq string"), 21).collect(), key=lambda r: r.length)
    assert [r.length for r in got] == [120, 700] and got[1].seq == min(genome, rc(genome))
    round_ = got[0].seq[:100]
    assert round_ in ring + ring or rc(round_) in ring + ring
    lines = assembly.contig_lines(spark.createDataFrame([tuple(r) for r in got], "seq string, length long, kmers long, coverage double")).orderBy("contig", "line").collect()
    assert lines[0].text.startswith(">contig_1 length=700 kmercov=") and "".join(r.text for r in lines if r.contig == 1 and r.line) == got[1].seq


def test_list_ranking(spark):
    links = [(f"a{i:03}", f"a{i + 1:03}") for i in range(100)] + [("x", "y")] + [(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)] + [("s", "s")]
    lists, rings = assembly.ranked_lists(spark.createDataFrame(links, "node string, next string"))
    assert {r.node: (r["last"], r.steps) for r in lists.collect()} == {f"a{i:03}": ("a100", 100 - i) for i in range(101)} | {"x": ("y", 1), "y": ("y", 0)}
    assert {r.node: r.least for r in rings.collect()} == {f"r{i}": "r0" for i in range(7)} | {"s": "s"}


def test_copies_of_a_read_are_cut_once(spark):
    """Each copy was cut into k-mers again."""
    reads = spark.createDataFrame([("acgta",), ("ACGTA",), ("ACGTN",), (None,), ("AC",)], "seq string")
    counts = assembly.kmer_counts(reads, 3)
    assert sorted(tuple(r) for r in counts.collect()) == [("ACG", 6), ("GTA", 2)]
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.rindex("Aggregate")  # reads are grouped before they are cut
