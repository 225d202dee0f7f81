import random

import numpy as np
import pytest

from spindrift.llm import neardup
from spindrift.llm.groupjoin import cell_bits


def brute_kept(texts, width=5, share=0.8):
    """The least index of each component of all pairs, by sets of words."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    return sorted({min(j for j in range(len(texts)) if find(j) == find(i)) for i in range(len(texts))})


def planted(seed):
    """Texts with chains and groups of copies of similarity about 0.7 to 0.97, some with a common passage."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(300))
    common = [word() for _ in range(30)]
    texts = []
    for k in range(25):
        base = [word() for _ in range(rng.randint(40, 200))] + common * (k % 3 == 0)
        texts.append(base)
        for _ in range(rng.randint(0, 8)):
            own = list(rng.choice([base, texts[-1]]))
            for _ in range(max(1, round(len(own) * rng.uniform(0.005, 0.035)))):
                own[rng.randrange(len(own))] = word()
            texts.append(own)
    rng.shuffle(texts)
    return [" ".join(t) for t in texts] + ["", None, "One two", "one TWO", "a b c d", "a b c d e"]


@pytest.mark.parametrize("seed", [1, 2])
def test_kept_rows_are_those_of_all_pairs(spark, seed):
    texts = planted(seed)
    kept = neardup.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == brute_kept(texts) and len(kept) < 0.7 * len(texts)


def test_pipeline_stage_drops_planted_copies(spark):
    import corpus_pipeline

    texts = planted(3)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_deduplicated(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == brute_kept(texts)


def test_one_row_of_each_group_stays(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "A b c d"), (None, "q r s t"), (None, "q r  s t"), (None, None), (4, ""), (3, "zz yy xx"), (3, "other words here now")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = neardup.deduplicated(df).collect()
    assert sorted(((r.doc_id or 0), r.text or "") for r in kept) == [(0, "q r  s t"), (1, "a b c d"), (3, "other words here now"), (3, "zz yy xx"), (4, "")]
    assert neardup.deduplicated(df.limit(0)).count() == 0


@pytest.mark.parametrize("radius", [0, 3, 6])
def test_the_radius_of_the_fingerprints_changes_no_result(spark, radius):
    texts = planted(4)
    kept = neardup.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), radius=radius).collect()
    assert sorted(r.doc_id for r in kept) == brute_kept(texts)


def test_clashing_columns_stay(spark):
    df = spark.createDataFrame([(1, "a b c d", 5, 6), (2, "A b c d", 7, 8), (2, "x y z", 7, 8)], "doc_id long, text string, _kept long, _copy long")
    assert sorted(tuple(r) for r in neardup.deduplicated(df).collect()) == [(1, "a b c d", 5, 6), (2, "x y z", 7, 8)]


def test_parities_differ_in_no_more_places_than_the_sets():
    rng = np.random.default_rng(5)
    for n, m, both in ((0, 5, 0), (50, 40, 30), (5000, 4000, 3900)):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[:both], rng.integers(0, 1 << 63, m - both).astype(np.uint64)])
        differ = len(set(a.tolist()) ^ set(b.tolist()))
        assert int(np.bitwise_count(cell_bits(a)[1] ^ cell_bits(b)[1]).sum()) <= differ


def test_shuffle_files_go_with_their_jobs(spark):
    files = lambda: sum("shuffle_" in str(f) for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n"))
    texts = planted(3)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    key, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", files()
    kept = neardup.deduplicated(df)
    assert files() <= before + 20  # of hundreds
    assert spark.conf.get(key) == "false"
    for _ in range(2):
        assert sorted(r.doc_id for r in kept.collect()) == brute_kept(texts)
