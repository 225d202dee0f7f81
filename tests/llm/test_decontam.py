import math
import random
import re

import pytest

from spindrift.llm import decontam


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items, size):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        for win in {tuple(v[i : i + size]) for i in range(max(1, len(v) - size + 1))} if v else ():
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p : p + len(win)]) == win:
                    hit.update(range(p, p + len(win)))
                    found.add(item)
    return len(w), len(hit), sorted(found)


ITEMS = [("a", "one two three four five six"), ("b", "uno dos"), ("c", ""), ("d", None), ("e", "Été 7 x y z été"), ("a2", "one two three four five six")]
DOCS = [(1, "Start ONE two-three four. end one two three four five six"), (2, None), (3, ""), (4, "uno dos uno dos"), (4, "uno dos uno dos"), (5, "été 7 x y z"), (6, "uno"), (7, "ten " * 3000 + "three four five six")]


@pytest.mark.parametrize("block", [decontam.BLOCK, 2])
def test_equals_brute_force(spark, block):
    docs = spark.createDataFrame([(i, t, 9) for i, t in DOCS], "doc_id long, text string, n_words int")
    found = decontam.decontaminate(docs, spark.createDataFrame(ITEMS, "item_id string, text string"), size=4, keep=["doc_id"], block=block).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in found) == sorted((i, *brute(t, ITEMS, 4), brute(t, ITEMS, 4)[1] > 0) for i, t in DOCS)


def test_share_allows_replaced_words(spark):
    docs = spark.createDataFrame([(1, "one two XX four five"), (2, "one XX YY four five")], "doc_id long, text string")
    items = spark.createDataFrame([("a", "one two three four five")], "item_id string, text string")
    found = decontam.decontaminate(docs, items, size=5, share=0.8, keep=["doc_id"]).collect()
    assert {r.doc_id: (r.n_hit, r.hit_spans) for r in found} == {1: (5, [0, 5]), 2: (0, [])}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id string, text string")
    assert decontam.decontaminate(docs.limit(0), items).count() == 0
    assert decontam.decontaminate(docs, items.limit(0)).where("contaminated").count() == 0


@pytest.mark.parametrize("share", [1.0, 0.8, 0.6])
def test_any_share_equals_brute_force(spark, share):
    rng = random.Random(6)
    base = [[rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(25)] for _ in range(6)]
    texts = []
    for _ in range(40):
        own = list(rng.choice(base))[rng.randrange(10) :]
        for _ in range(rng.randrange(6)):
            own[rng.randrange(len(own))] = rng.choice(["zz", "a1", own[0]])
        texts.append(["x"] * rng.randrange(4) + own)
    items = [(str(i), " ".join(b)) for i, b in enumerate(base)] + [("short", " ".join(base[0][:4]))]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: (r.n_hit, r["items"]) for r in decontam.decontaminate(docs, spark.createDataFrame(items, "item_id string, text string"), share=share, keep=["doc_id"], block=20).collect()}
    for i, t in enumerate(texts):
        hit, names = set(), set()
        for name, text in items:
            v = text.split()
            for k in range(max(1, len(v) - 9)):
                w = v[k : k + 10]
                for p in range(len(t) - len(w) + 1):
                    if sum(x == y for x, y in zip(t[p:], w)) >= math.ceil(share * len(w)):
                        hit.update(range(p, p + len(w)))
                        names.add(name)
        assert found[i] == (len(hit), sorted(names))


def test_equal_windows_of_many_items_stay_within_a_block(spark):
    text = "one two three four five six seven eight nine ten"
    items = spark.createDataFrame([(f"i{k:03}", text) for k in range(200)], "item_id string, text string")
    blocks = decontam.window_blocks(decontam.item_windows(items, 10), 10).groupBy("block").count().collect()
    assert sorted(r.block for r in blocks) == list(range(20)) and {r["count"] for r in blocks} == {10}
    docs = spark.createDataFrame([(1, f"x {text} y"), (2, "none")], "doc_id long, text string")
    found = {r.doc_id: r for r in decontam.decontaminate(docs, items.limit(25), block=10).collect()}
    assert len(found[1]["items"]) == 25 and found[1].n_hit == 10 and found[2]["items"] == []
