import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spindrift.llm import simhash


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(fps, radius=3):
    values = sorted(set(fps))
    label = list(range(len(values)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= radius:
                label[find(i)] = find(j)
    return {v: find(i) for i, v in enumerate(values)}


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "One two", "A b C d e a b c", "É x y z É", "w " * 5000])
def test_fingerprints(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("shard", [2048, 40])
def test_components_are_those_of_all_links(spark, shard):
    rng = random.Random(shard)
    base, fps = [rng.getrandbits(64) for _ in range(4)], [0, 0, 7]
    for _ in range(500):
        v = rng.choice(base)
        for _ in range(rng.randint(0, 7)):
            v ^= 1 << rng.randrange(64)
        fps.append(v)
    fps += [rng.getrandbits(64) for _ in range(100)]
    df = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(fps)], "id long, fp long")
    want, least = classes(fps), {}
    for i, v in enumerate(fps):
        least[want[v]] = min(least.get(want[v], 1 << 60), i)
    got = {r.id: r.component_id for r in simhash.grouped(df, 3, shard).collect()}
    assert got == {i: least[want[v]] for i, v in enumerate(fps)}


def test_forest_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    values = (rng.integers(0, 1 << 12, 300) << 3).astype(np.uint64)
    q, node = simhash.Forest(values, np.zeros(300, int)).search(values, np.zeros(300, int), 3)
    want = {(i, j) for i in range(300) for j in range(300) if bin(int(values[i]) ^ int(values[j])).count("1") <= 3}
    assert set(zip(q.tolist(), node.tolist(), strict=True)) == want and len(q) == len(want)


def test_one_row_of_each_group_stays(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "A b c d"), (None, "q r s t"), (None, "q r  s t"), (None, None), (4, ""), (3, "zz yy xx"), (3, "other words here now")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.deduplicated(df).collect()
    assert sorted(((r.doc_id or 0), r.text or "") for r in kept) == [(0, "q r  s t"), (1, "a b c d"), (3, "other words here now"), (3, "zz yy xx"), (4, "")]
    unique = spark.createDataFrame([(1, "a b c d"), (2, "A b c d"), (3, "zz yy xx")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.deduplicated(unique).collect()) == [1, 3]
    assert simhash.deduplicated(df.limit(0)).count() == 0


def test_cells_are_bounded_and_each_two_values_of_a_bucket_meet(spark):
    rng = random.Random(9)
    low = random.Random(10).sample(range(1 << 16), 20_000)  # all in one bucket: they agree on all but 16 bits
    df = spark.createDataFrame([((7 << 40) + v,) for v in low], "fp long")
    cells = simhash.cells_of(df, 3, 2048, 5).checkpoint()
    largest = cells.groupBy("bucket").agg(F.countDistinct("fp").alias("n")).orderBy(F.desc("n")).first()
    assert largest.n == 20_000 and cells.groupBy("bucket", "cell").count().agg(F.max("count")).first()[0] < 2.3 * 2048
    met = cells.where(F.col("bucket") == largest.bucket)
    some = rng.sample(low, 40)
    rows = met.where(F.col("fp").isin([(7 << 40) + v for v in some])).collect()
    home, guest = {}, {}
    for r in rows:
        home.setdefault(r.fp, set()).update([r.cell] if r.home else [])
        guest.setdefault(r.fp, set()).update([r.cell] if r.guest else [])
    assert all(home[a] & guest[b] or home[b] & guest[a] for a in home for b in home)


def test_blocks_follow_the_number_of_values():
    assert simhash.blocks_for(10**6, 3) == 5 and simhash.blocks_for(10**11, 3) == 6 and simhash.blocks_for(0, 7) == 9
    assert all(bin(m).count("1") >= 24 for m in simhash._masks(3, 5))


def test_clashing_columns_stay(spark):
    df = spark.createDataFrame([(1, "a b c d", 5, 6), (2, "A b c d", 7, 8), (2, "x y z", 7, 8)], "doc_id long, text string, _kept long, _fp long")
    assert sorted(tuple(r) for r in simhash.deduplicated(df).collect()) == [(1, "a b c d", 5, 6), (2, "x y z", 7, 8)]
