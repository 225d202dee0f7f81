import re

import pytest

from spindrift.llm import licenses

DOCS = [
    (1, "All rights reserved. all rights. ALL RIGHTS RESERVED"), (2, None), (3, ""), (4, "Licensed under CC BY-NC 4.0."), (4, "Licensed under CC BY-NC 4.0."), (5, "x GNU General Public License, version 3"),
    (6, "Licensed under the brand new Apache License, Version 2.0 yes"), (7, "rights reserved all"), (8, "cc by cc by cc"), (9, "Released under a license " * 2000), (10, "Licensed Apache Version"),
    (11, "Released under the MIT License, MIT License, MIT License"), (13, "released under the new MIT license"), (14, "released under the new MIT license MIT license"), (12, "Licensed under the Apache License, Version 2.0, 2.0, 2.0"),
]


def base(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), sorted((i, t.label) for t in licenses.PHRASES for p in [[x.decode() for x in t.words]] for i in range(len(w)) if w[i : i + len(p)] == p)


def test_base_places_equal_brute_force(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "1 AS spans")
    got = sorted((r.doc_id, r.n_words, sorted((s.start, s.label) for s in r.spans if s.template < len(licenses.PHRASES))) for r in licenses.scan(df, keep=["doc_id"]).collect())
    assert got == sorted((i, *base(t)) for i, t in DOCS)
    assert licenses.scan(df.limit(0)).count() == 0


def test_notices_survive_words_put_in(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    labels = {r.doc_id: sorted({s.label for s in r.spans if s.template >= len(licenses.PHRASES)}) for r in licenses.scan(df, keep=["doc_id"]).collect()}
    assert labels[6] == ["apache-2.0"] and labels[4] == ["cc-by-nc"] and labels[10] == labels[9] == labels[1] == []
    assert labels[11] == labels[13] == labels[14] == ["mit"] and labels[12] == ["apache-2.0"]


def test_every_column_stays_and_one_hot_text_is_found_whole(spark):
    text = "cc by " * 30_000
    rows = [(1, text, 5, 6, 7), (1, text, 5, 6, 7), (None, None, None, None, None)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, _hits long, k long, template long")).orderBy("doc_id").collect()
    assert [(r.doc_id, r["_hits"], r.k, r.template, r.n_words, len(r.spans)) for r in got] == [(None, None, None, None, 0, 0)] + [(1, 5, 6, 7, 60_000, 30_000)] * 2


@pytest.mark.parametrize("k", [1, 2, 4])
def test_rolling_hashes_tell_runs_apart(k):
    import numpy as np

    h = np.array([1, 2, 3, 1, 2, 3, 4], np.uint64)
    r = licenses.rolling(h, k).tolist()
    assert len(r) == 8 - k and all((r[i] == r[j]) == (h[i : i + k].tolist() == h[j : j + k].tolist()) for i in range(len(r)) for j in range(len(r)))
