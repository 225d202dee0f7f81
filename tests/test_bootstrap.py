"""Bootstrap supports against replicates in a plain loop, and consensus trees of known splits."""

from collections import Counter

import numpy as np
import pytest

from spindrift.operators import trees

ROWS = [("a", "ACGTACGTACGTAAAA"), ("b", "ACGTACGTACGTAAAC"), ("c", "TTGTACCTACGAAGGA"), ("d", "TTGTACCTACGAAGGC"), ("e", "TTCCACCTAC-AAG.A"), ("f", "GGCCTCCTACTAAGGA")]


@pytest.mark.parametrize(("method", "model"), [("nj", "p"), ("upgma", "jc")])
def test_supports_equal_a_plain_loop(spark, method, model):
    want = Counter()
    weights = trees.column_weights(16, 20, 3)
    assert (weights.sum(1) == 16).all() and len({tuple(w) for w in weights}) > 10
    for w in weights:
        columns = np.repeat(np.arange(16), w)
        d = np.zeros((6, 6))
        for i in range(6):
            for j in range(6):
                x, y = ([ROWS[k][1].replace(".", "-")[c] for c in columns] for k in (i, j))
                both = [(p, q) for p, q in zip(x, y, strict=True) if "-" not in (p, q)]
                p = sum(p != q for p, q in both) / len(both) if both else 1.0
                d[i, j] = abs(p) if model == "p" else -0.75 * np.log(1 - 4 * p / 3) if p < 0.75 else 3.0
        tree = (trees.neighbour_joining if method == "nj" else trees.average_linkage)([r[0] for r in ROWS], np.abs(d))
        want.update(trees.split_name(s) for s in trees.splits(tree))
    for parts in (1, 4):
        df = spark.createDataFrame(ROWS, "id string, seq string").repartition(parts)
        got = {r.split: (r.n, r.support) for r in trees.bootstrap(df, replicates=20, method=method, seed=3, model=model).collect()}
        assert got == {k: (n, n / 20) for k, n in want.items()}
    assert got["c,d,e,f"][1] > 0.6


def test_consensus_of_known_trees(spark):
    rows = [(1, "((a,b),(c,d),e);"), (1, "((a,b),((c,d),e));"), (1, "((a,b),((c,e),d));"), (2, "((a,b),(c,d),e);"), (2, "((a,c),(b,d),e);"), (3, "(a,b,c,d,e);"), (None, "(x,y);")]
    df = spark.createDataFrame(rows, "g long, newick string")
    support = {(r.g, r.split): r.n for r in trees.support(df, group="g").collect()}
    assert support == {(1, "c,d,e"): 3, (1, "c,d"): 2, (1, "c,e"): 1, (2, "c,d,e"): 1, (2, "c,d"): 1, (2, "b,d,e"): 1, (2, "b,d"): 1}
    made = {r.g: r for r in trees.consensus(df, group="g").collect()}
    assert trees.splits(made[1].newick) == {frozenset("cde"), frozenset("cd")} and made[1].trees == 3
    names = {n[2] for n in trees.parse(made[1].newick)}
    assert {"1", "0.666667"} <= names and {"a", "b", "c", "d", "e"} <= names
    assert trees.splits(made[2].newick) == set() and trees.splits(made[3].newick) == set() and made[None].newick == "(x,y);"
    greedy = {r.g: r for r in trees.consensus(df, group="g", cutoff=0.2).collect()}
    assert trees.splits(greedy[2].newick) == {frozenset("bde"), frozenset("bd")}
    assert trees.consensus(df.limit(0), group="g").count() == 0
