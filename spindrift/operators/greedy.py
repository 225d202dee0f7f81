"""Greedy clustering in an order of priority, and clusters of similar names, by similarity joins that lose no pair."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import hamming
from ..plans.ordinals import materialized, ordinal
from .learning import components


def mismatch_pairs(df: DataFrame, id: str, seq: str, allowed: Column) -> DataFrame:
    """(a, b, distance), a < b: the rows with sequences of equal length that differ in at most ``allowed`` places, an
    expression of the sequence's length ``n``.

    Of allowed + 1 pieces one is the same in both, so rows meet in an equi-join on a piece, its place and the length; a
    pair is kept in the first piece that it shares. Null sequences meet none."""
    own = df.select(F.col(id).alias("id"), F.col(seq).alias("seq")).where("seq IS NOT NULL").withColumn("n", F.length("seq")).withColumn("k", F.least(allowed.cast("int"), F.col("n")) + 1)
    cut = lambda i: F.floor(i * F.col("n") / F.col("k")).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.substring("seq", cut(i) + 1, cut(i + 1) - cut(i)))
    filed = own.withColumn("pieces", pieces).select("id", "seq", "n", "pieces", F.posexplode("pieces").alias("at", "piece"))
    left = filed.select(F.col("id").alias("a"), F.col("seq").alias("x"), F.col("pieces").alias("p"), "n", "at", "piece")
    right = filed.select(F.col("id").alias("b"), F.col("seq").alias("y"), F.col("pieces").alias("q"), F.col("n").alias("m"), F.col("at").alias("to"), F.col("piece").alias("other"))
    met = left.join(right, (F.col("n") == F.col("m")) & (F.col("at") == F.col("to")) & (F.col("piece") == F.col("other")) & (F.col("a") < F.col("b")))
    first = F.array_position(F.zip_with("p", "q", lambda p, q: p == q), True) == F.col("at") + 1
    return met.where(first).withColumn("distance", hamming(F.col("x"), F.col("y"))).where(F.col("distance") <= allowed).select("a", "b", "distance")


def greedy_centres(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """(rank, centre): what a greedy pass in the order of ``rank`` (unique) gives: an item near an earlier centre belongs
    to the earliest such; any other is a centre itself. ``pairs`` (a, b) are ranks of items near each other, each once.

    In rounds, as a priority-ordered independent set: an undecided item with an earlier centre near it becomes a
    member, and one whose earlier neighbours are all members a centre. There are as many rounds as the longest
    chain of items that wait for each other, on written tables."""
    earlier = materialized(pairs.select(F.least("a", "b").alias("first"), F.greatest("a", "b").alias("rank")).where("first <> rank").distinct())
    waiting = earlier.select("rank").distinct()
    centres = materialized(items.select("rank").join(waiting, "rank", "left_anti"))
    new = centres
    links = earlier
    while True:
        # items near a new centre are members, and hold nobody back any more
        members = materialized(links.join(new.select(F.col("rank").alias("first")), "first", "left_semi").select("rank").distinct())
        open_ = links.join(members, "rank", "left_anti").join(members.select(F.col("rank").alias("first")), "first", "left_anti")
        left = materialized(links.join(members, "rank", "left_anti").select("rank").distinct())
        if left.isEmpty():
            break
        links = materialized(open_)
        new = materialized(left.join(links.select("rank").distinct(), "rank", "left_anti"))
        centres = centres.unionAll(new)
    centre = earlier.join(centres.select(F.col("rank").alias("first")), "first", "left_semi").groupBy("rank").agg(F.min("first").alias("_c"))
    return items.select("rank").join(centre, "rank", "left").select("rank", F.coalesce("_c", "rank").alias("centre"))


def denoised(records: DataFrame, id: str = "id", seq: str = "seq", mismatches: int = 1, rate: float | None = None, min_size: int = 1) -> DataFrame:
    """(seq, n, centre, distance, size, total): each distinct sequence with its count, its centre, its mismatches to it,
    and the centre's number of sequences and of records.

    Sequences are taken by falling count, then the sequence itself; one within ``mismatches`` (or the share ``rate`` of its
    length) of an earlier centre of the same length goes to the first such, any other is a centre. Centres of fewer
    than ``min_size`` records, and theirs, are left out. Case doesn't count; null and empty sequences are left out."""
    counts = records.select(F.upper(seq).alias("seq")).where("seq <> ''").groupBy("seq").agg(F.count("*").alias("n"))
    ranked = materialized(ordinal(counts, [F.desc("n"), "seq"], "rank").select("rank", "seq", "n"))
    allowed = F.lit(mismatches) if rate is None else F.floor(F.col("n") * rate + 1e-9)
    pairs = mismatch_pairs(ranked.select("rank", "seq"), "rank", "seq", allowed)
    found = greedy_centres(ranked, pairs)
    heads = ranked.select(F.col("rank").alias("centre"), F.col("seq").alias("_head"))
    each = materialized(ranked.join(found, "rank").join(heads, "centre"))
    sizes = each.groupBy("centre").agg(F.count("*").alias("size"), F.sum("n").alias("total")).where(F.col("total") >= min_size)
    return each.join(sizes, "centre").select("seq", "n", F.col("_head").alias("centre"), hamming(F.col("seq"), F.col("_head")).alias("distance"), "size", "total")


def _tokens(names: DataFrame) -> DataFrame:
    """(id, n, token): the letters of names, each with how many times it has come before."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, sizes, tokens = [], [], []
            for i, name in zip(frame["id"].tolist(), frame["name"], strict=True):
                seen: dict[str, int] = {}
                for c in name:
                    seen[c] = seen.get(c, 0) + 1
                    tokens.append(f"{c}{seen[c]}")
                ids += [i] * len(name)
                sizes += [len(name)] * len(name)
            yield pd.DataFrame({"id": ids, "n": sizes, "token": tokens})

    return names.select("id", "name").mapInPandas(run, "id long, n int, token string")


def similar_names(names: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(a, b, ratio): pairs of names (id, name), ids in order and names distinct, whose ratio of matching blocks, twice
    the matched letters by all letters, reaches the threshold. The earlier name is the first of the two.

    Matched letters are common ones, so only pairs that share enough letters are compared: of similar names with n and
    m letters at least threshold * (n + m) / 2 are common, and then the rarest n - threshold * n / (2 - threshold) + 1
    letters of each, counted with repeats, have one in common. Pairs meet on those, within the bound of lengths."""
    tokens = materialized(_tokens(names))
    uses = tokens.groupBy("token").agg(F.count("*").alias("uses"))
    listed = tokens.join(uses, "token").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("uses", "token"))).alias("own"))
    size = F.col("n") - F.ceil(F.col("n") * threshold / (2 - threshold) - 1e-9) + 1
    filed = materialized(listed.select("id", "n", F.explode(F.slice("own", F.lit(1), size.cast("int"))).alias("x")).select("id", "n", F.col("x.token").alias("token")))
    left, right = filed.toDF("a", "n", "token"), filed.toDF("b", "m", "other")
    near = F.least("n", "m") * 2 >= threshold * (F.col("n") + F.col("m")) - 1e-9
    pairs = left.join(right, (F.col("token") == F.col("other")) & (F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    both = pairs.join(names.select(F.col("id").alias("a"), F.col("name").alias("x")), "a").join(names.select(F.col("id").alias("b"), F.col("name").alias("y")), "b")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for a, b, x, y in zip(frame["a"].tolist(), frame["b"].tolist(), frame["x"], frame["y"], strict=True):
                match = SequenceMatcher(None, x, y)
                if match.quick_ratio() >= threshold and (ratio := match.ratio()) >= threshold:
                    found.append((a, b, ratio))
            yield pd.DataFrame(found, columns=["a", "b", "ratio"]).astype({"a": "int64", "b": "int64", "ratio": float})

    return both.mapInPandas(run, "a long, b long, ratio double")


def name_clusters(df: DataFrame, name: str, order: str, threshold: float = 0.75) -> DataFrame:
    """(cluster, size, name): each distinct name with its single-linkage cluster of ``similar_names``: the first name of
    it, by the least ``order`` of its rows, then the name; size counts distinct names. Null names are left out."""
    first = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.min(order).alias("_at"))
    names = materialized(ordinal(first, ["_at", "name"], "id").select("id", "name"))
    pairs = materialized(similar_names(names, threshold))
    groups = names.withColumn("component", F.col("id")) if pairs.isEmpty() else names.join(components(pairs, "a", "b"), F.col("id") == F.col("node"), "left").select("id", "name", F.coalesce("component", "id").alias("component"))
    heads = names.select(F.col("id").alias("_head"), F.col("name").alias("cluster"))
    sizes = groups.groupBy("component").agg(F.count("*").alias("size"))
    return groups.join(sizes, "component").join(heads, F.col("component") == F.col("_head")).select("cluster", "size", "name")
