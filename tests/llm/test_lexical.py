"""Ranked search against brute force: the tree alone, and whole tables."""

from collections import Counter

import numpy as np
import pytest

from spindrift.llm.lexical import Tree, search, weight
from spindrift.llm.words import split_words


@pytest.mark.parametrize("documents", [1, 2, 37, 300])
def test_tree_gives_the_best(documents):
    rng = np.random.default_rng(documents)
    for _ in range(20):
        terms = 12
        held = np.unique(rng.integers(0, documents * terms, rng.integers(1, documents * 4 + 2)))
        term, doc = held // documents, held % documents
        impact = rng.integers(1, 40, len(held))  # many ties
        tree = Tree(term, doc, impact, terms, documents)
        asked = rng.choice(terms, rng.integers(1, 9), replace=False)
        weights = rng.integers(1, 6, len(asked))
        scores = np.zeros(documents, np.int64)
        for t, w in zip(asked, weights, strict=True):
            scores[doc[term == t]] += w * impact[term == t]
        for k in (1, 5, 20):
            got_doc, got_score = tree.best(asked, weights, k)
            assert (scores[got_doc] == got_score).all() and len(set(got_doc.tolist())) == len(got_doc)
            got = sorted(zip((-got_score).tolist(), got_doc.tolist(), strict=True))[:k]
            assert got == sorted((-s, d) for d, s in enumerate(scores.tolist()) if s > 0)[:k]


def brute(documents, queries, k):
    """documents: (id, text) in order of ties."""
    words = [split_words(t) for _, t in documents]
    some = [i for i, w in enumerate(words) if w]
    n, total = len(some), sum(map(len, words))
    df = Counter(w for i in some for w in set(words[i]))
    found = []
    for q, text in queries:
        scores = []
        for i in some:
            tf, m = Counter(words[i]), 75 + (25 * len(words[i]) * n) // total
            score = sum(weight(n, df[w]) * (10**9 * tf[w] // (1000 * tf[w] + 12 * m)) for w in split_words(text) if tf[w])
            if score > 0:
                scores.append((-score, i))
        found += [(q, rank, documents[i][0], -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(found, key=str)


def test_whole_tables(spark):
    rng = np.random.default_rng(3)
    draw = lambda n: " ".join(rng.choice(["Ab", "c1", "d", "é", "f-g", "h", "i", "j", "rare"], n, p=[0.3, 0.2, 0.2, 0.1, 0.05, 0.05, 0.05, 0.04, 0.01]))
    documents = [(i, draw(rng.integers(0, 30))) for i in range(150)] + [(150, None), (151, ""), (152, "Ab " * 5000), (None, "ab c1 d")]
    documents += [(7, documents[7][1]), (153, documents[8][1])]  # a repeated row and a copy
    documents.sort(key=lambda x: (x[0] is None, x[0] or 0))
    queries = [(f"q{i}", draw(rng.integers(0, 9))) for i in range(12)] + [("none", None), ("empty", "-- "), ("absent", "zzz"), ("q1", "ab ab h"), (None, "rare j")]
    left = spark.createDataFrame(documents, "doc_id long, text string").selectExpr("*", "'x' AS score", "0 AS no", "'y' AS rank")
    right = spark.createDataFrame(queries, "item_id string, text string").selectExpr("*", "1 AS term", "2 AS doc_id")
    for options in ({}, {"block": 3, "postings": 60}):
        got = sorted([tuple(r) for r in search(left, right, k=7, **options).collect()], key=str)
        assert got == brute(documents, queries, 7)
    assert search(left.where("false"), right).count() == 0
    assert search(left, right.where("false")).count() == 0


def test_same_name_of_ids(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "b c")], "id long, text string")
    with pytest.raises(ValueError):
        search(rows, rows, id="id", query_id="id")
