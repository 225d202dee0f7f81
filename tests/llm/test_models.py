import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spindrift.llm import langid, quality, toxicity
from spindrift.llm.common import table
from spindrift.llm.queries import QUERIES
from spindrift.llm.sample import fold, labelled_texts

SF = "/root/testdata/sf0.01"


def test_fold_is_crc32_of_the_id_as_text(spark):
    rows = spark.range(50).select("id", fold("id", 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in rows)


def test_sample_follows_no_partitioning(spark):
    labels, docs = table(spark, SF, "labels"), table(spark, SF, "documents")
    one = labelled_texts(docs, labels.repartition(3), "quality", fold("doc_id", 5) != 0, 40, 10_000)
    two = labelled_texts(docs.repartition(5), labels, "quality", fold("doc_id", 5) != 0, 40, 10_000)
    assert one.equals(two) and 30 < len(one) < 120 and one.text.str.len().max() <= 10_000


def test_language_filters_equal_sets_but_for_false_positives():
    rows = pd.DataFrame({"text": ["the cat sat on the mat"] * 3 + ["der hund und die katze"] * 3, "label": ["en"] * 3 + ["de"] * 3})
    filters = langid.learn(rows)
    assert filters.predict(["the cat", "der hund", None, "", "12 !", "the mat " * 60_000])[0] == ["en", "de", "und", "und", "und", "en"]
    assert all(0 <= s <= 1 for s in filters.predict(["the", "xyz"])[1])
    # a long text in pieces counts as the whole does
    text = " ".join(random.Random(1).choices(["the", "hund", "katze", "on", "q"], k=60_000))
    c = langid.codes_of(text)
    found, total = filters.counts(c, np.zeros(len(c), int), 1)
    right = np.maximum(found - total[:, None] * filters.false_positive, 0) / (1 - filters.false_positive)
    assert filters.predict([text])[1][0] == pytest.approx(right.max() / right.sum())


def test_no_language_to_learn():
    assert langid.learn(pd.DataFrame({"text": [], "label": []})).predict(["a"])[0] == ["und"]


def held(spark, name, column, labels):
    got = QUERIES[name](spark, SF).where("held_out").toPandas()
    return got.merge(labels, on="doc_id")


def test_language_on_held_out_rows(spark):
    got = held(spark, "op6_language_id", "lang", pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "lang"]])
    assert (got.lang == got.lang_pred).mean() > 0.97


def test_quality_on_held_out_rows(spark):
    got = held(spark, "op8_quality", "quality", pd.read_parquet(f"{SF}/labels.parquet"))
    assert (got.quality == got.predicted).mean() > 0.95


def test_quality_of_odd_texts():
    ranker = quality.fit(pd.DataFrame({"text": ["Some good words stand here."] * 5 + ["$$$ ### $$$ !!"] * 5, "label": [1] * 5 + [0] * 5}))
    scores = ranker.scores([None, "", "Some good words stand here.", "$$$ ### $$$ !!", "a" * 100_000])
    assert scores[2] >= quality.CUT > scores[3] and all(0 <= s <= 1 for s in scores) and scores[0] == scores[1]
    assert len(quality.features("x")) == len(quality.NAMES)
    assert quality.fit(pd.DataFrame({"text": ["a"], "label": [1]})).scores(["a"]) == [pytest.approx(quality.CUT)]


def test_gradients_equal_differences():
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    codes = toxicity.Codes.of([b"abc", b"defg", b"x", b"idiot"])
    rows, target, cost = np.array([[0, 1, 2, 3], [3, 3, -1, -1], [2, 0, 1, -1]]), np.array([1.0, 0, 1]), np.ones(3)
    grad, _ = net.gradients(codes, rows, target, cost)
    for k, g in grad.items():
        i = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        v, old = net.p[k], net.p[k][i]
        v[i] = old + 1e-3
        up = net.gradients(codes, rows, target, cost)[1]
        v[i] = old - 1e-3
        down = net.gradients(codes, rows, target, cost)[1]
        v[i] = old
        assert g[i] == pytest.approx((up - down) / 2e-3, rel=1e-3, abs=1e-6)


def test_windows_cover_every_word():
    for n in (1, 5, 16, 17, 40, 41):
        at = toxicity.windows_of(n)
        assert set(at[at >= 0].tolist()) == set(range(n)) and at.max() < n


def test_toxicity_finds_a_word_anywhere():
    rng = random.Random(2)
    clean = [" ".join(rng.choices([f"w{i}" for i in range(80)], k=60)) for _ in range(300)]
    toxic = [t[: len(t) // 2] + " moron " + t[len(t) // 2 :] for t in clean[:150]]
    net = toxicity.fit(pd.DataFrame({"text": toxic + clean[150:], "label": [1] * 150 + [0] * 150}))
    scores = toxicity.Scorer(net).scores([None, "", "!!", clean[200] * 20 + " moron " + clean[201] * 20, clean[202] * 40])
    assert scores[:3] == [0, 0, 0] and scores[3] >= 0.7 > scores[4]


def test_scorer_survives_a_full_memo(monkeypatch):
    net, texts = toxicity.Network(), [" ".join(f"a{i}x{j}" for j in range(30)) for i in range(20)]
    whole = toxicity.Scorer(net).scores(texts)
    monkeypatch.setattr(toxicity, "MEMO", 50)
    assert np.allclose(toxicity.Scorer(net).scores(texts), whole)


@pytest.mark.parametrize("name", ["op6_language_id", "op7_toxicity", "op8_quality"])
def test_every_row_is_judged(spark, name):
    got = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert got.count() == 200 and got.where((F.col("score") < 0) | (F.col("score") > 1) | F.col("score").isNull()).count() == 0


@pytest.mark.parametrize("labels", [[], [0, 0], [1, 1]])
def test_labels_of_one_kind_teach_nothing(spark, labels):
    sample = pd.DataFrame({"text": [f"some text {i}" for i in range(len(labels))], "label": labels})
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS label")
    assert [r.score for r in quality.score(docs, quality.fit(sample)).collect()] == [quality.CUT] * 3
    assert [r.score for r in toxicity.score(docs, toxicity.fit(sample)).collect()] == [0.0] * 3


def test_clashing_columns_repeated_rows_and_no_rows(spark):
    sample = pd.DataFrame({"text": ["good words here", "bad bad !!!"] * 20, "label": [1, 0] * 20})
    docs = spark.createDataFrame([(1, "a b", 5), (1, "a b", 5), (2, None, 6)], "doc_id long, text string, score long")
    for scored in (quality.score(docs, quality.fit(sample)), toxicity.score(docs, toxicity.fit(sample))):
        rows = scored.orderBy("doc_id").collect()
        assert len(rows) == 3 and rows[0] == rows[1] and scored.columns == ["doc_id", "text", "score"]
        assert all(0 <= r.score <= 1 for r in rows) and scored.limit(0).count() == 0


def test_samples_are_bounded_in_characters(spark):
    from spindrift.llm.sample import within

    rows = spark.range(400).selectExpr("id", "repeat('x', 100) AS text", "id % 2 AS label")
    assert within(rows, 40_000).count() == 400
    kept = within(rows, 20_000)
    assert 120 <= kept.count() <= 280 and kept.select("label").distinct().count() == 2
