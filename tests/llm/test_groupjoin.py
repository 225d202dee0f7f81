"""The token-group join against all pairs, with and without the groups of the first links."""

import random
from fractions import Fraction

import pytest

from spindrift.llm import groupjoin
from spindrift.llm.queries import QUERIES


def brute(texts, width=3, share=0.9):
    """(n, least index of the component) of each text, by all pairs of sets of words."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    label, least = list(range(len(texts))), Fraction(str(share))

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders[x] if j < i}:
            if len(s & sets[j]) >= least * len(s | sets[j]):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def planted(seed, groups=20):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(200))
    common, texts = [word() for _ in range(40)], []
    for k in range(groups):
        base = [word() for _ in range(rng.randint(30, 150))] + common * (k % 2 == 0)
        texts.append(base)
        for _ in range(rng.randint(0, 10)):
            own = list(rng.choice([base, texts[-1]]))
            for _ in range(rng.randint(1, 4)):
                own[rng.randrange(len(own))] = word()
            texts.append(own)
    rng.shuffle(texts)
    more = ["", None, " \n", "One two", "one TWO", "two one", "a b c", "A b c", "a b c d", "w " * 500, "w " * 3]
    return [" ".join(t) for t in texts] + more + [" ".join(texts[3])] * 3


def test_components_are_those_of_all_pairs(spark):
    texts = planted(1)
    rows = spark.createDataFrame([(i, t, i % 3) for i, t in enumerate(texts)], "doc_id long, text string, n long").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in groupjoin.similar_documents(rows).collect()}
    assert got == dict(enumerate(brute(texts)))
    assert groupjoin.similar_documents(rows.limit(0)).count() == 0


def test_the_matrix_alone_finds_all_links(spark, monkeypatch):
    texts = planted(2, 12)
    monkeypatch.setattr(groupjoin, "NEAREST", 1)
    monkeypatch.setattr(groupjoin, "SENT", 0)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marked, found, unique = groupjoin.classes(rows, "doc_id", "text", 3, 0.9, first=[])
    label = {bytes(r.node): r.label for r in found.collect()}
    want, least, got = brute(texts), {}, {}
    for r in marked.collect():
        got[r.id] = label.get(bytes(r.key), bytes(r.key)) if r.n else f'none {r.id}'
    for i, x in sorted(got.items()):
        least.setdefault(x, i)
    assert unique and {i: least[x] for i, x in got.items()} == {i: c for i, (_, c) in enumerate(want)}


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d"), (5, "A b c d"), (5, "x y z"), (None, "q r s"), (4, "x  y z"), (None, None)]
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in groupjoin.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(0, 0, 0), (0, 1, 0), (0, 2, 5), (4, 1, 4), (5, 1, 4), (5, 2, 5)]


@pytest.mark.parametrize("sf", ["0.001"])
def test_query(spark, sf):
    import pandas as pd

    docs = pd.read_parquet(f"/root/testdata/sf{sf}/documents.parquet").sort_values("doc_id")
    ids = docs.doc_id.tolist()
    want = {i: (n, ids[c]) for i, (n, c) in zip(ids, brute(docs.text.tolist()), strict=True)}
    got = QUERIES["op13_jaccard_join"](spark, f"/root/testdata/sf{sf}").collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
