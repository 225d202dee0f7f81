"""Permutation tests and enrichment: seeded permutations of exact group sizes, all of them at once in each task."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordinals import materialized, ordinal

#: Statistics that differ by less than this share of the observed one count as equal.
EQUAL = 1e-9


def splits(n: int, first: int, second: int, permutations: int, seed: int = 1) -> tuple[np.ndarray, bool]:
    """(choices, exact): rows of ``first`` + ``second`` distinct places out of n, those of the first group before those of
    the second. All divisions, if there are no more than ``permutations``; else as many random ones, by the seed."""
    total = math.comb(n, first) * math.comb(n - first, second)
    if total <= permutations:
        every = [(*a, *b) for a in combinations(range(n), first) for b in combinations([x for x in range(n) if x not in a], second)]
        return np.array(every, np.int64).reshape(-1, first + second), True
    rng = np.random.default_rng(seed)
    return np.stack([rng.permutation(n)[: first + second] for _ in range(permutations)]), False


def group_test(df: DataFrame, first: list[str], second: list[str], permutations: int = 500, statistic: str = "mean_difference", seed: int = 1) -> DataFrame:
    """One row (observed, null_mean, null_sd, permutations, exact, p): a permutation test between two groups of columns
    over the whole matrix.

    The statistic is the sum over rows of the absolute difference of the groups' means (``mean_difference``) or of the
    absolute t of equal variances (``t``; 0 without variance), or the absolute difference of the groups' sums (``sum``).
    Labels move among the columns of both groups. p is the share of all divisions that reach the observed value, if
    they are no more than ``permutations``; else (1 + those that do) / (1 + permutations) of as many seeded ones, the
    same at any partitioning. Rows with a null or NaN take no part; without rows all statistics are 0 and p is 1.
    Each task adds up one number a division.
    """
    columns = [*first, *second]
    if len(set(columns)) < len(columns) or not first or not second:
        raise ValueError("two groups of different columns are needed")
    choices, exact = splits(len(columns), len(first), len(second), permutations, seed)
    every = np.concatenate([np.arange(len(columns))[None, :], choices])  # row 0 is the observed division
    a, b = (np.zeros((len(columns), len(every))) for _ in range(2))
    np.put_along_axis(a, every[:, : len(first)].T, 1, 0)
    np.put_along_axis(b, every[:, len(first) :].T, 1, 0)
    n, m = len(first), len(second)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(len(every))
        for frame in frames:
            x = frame.to_numpy(float)
            x = x[np.isfinite(x).all(1)]
            for at in range(0, len(x), 512):
                part = x[at : at + 512]
                p, q = part @ a, part @ b
                if statistic == "sum":
                    sums += (q - p).sum(0)
                elif statistic == "mean_difference":
                    sums += np.abs(q / m - p / n).sum(0)
                else:
                    squares = part * part
                    within = np.maximum(squares @ a - p * p / n, 0) + np.maximum(squares @ b - q * q / m, 0)
                    error = np.sqrt(within / max(1, n + m - 2) * (1 / n + 1 / m))
                    sums += np.divide(np.abs(q / m - p / n), error, out=np.zeros_like(error), where=error > 0).sum(0)
        yield pd.DataFrame({"at": np.arange(len(every)), "value": sums})

    if statistic not in ("mean_difference", "t", "sum"):
        raise ValueError(statistic)
    parts = df.select(*[F.col(f"`{c}`").cast("double") for c in columns]).mapInPandas(run, "at long, value double")
    none = df.sparkSession.range(len(every)).select(F.col("id").alias("at"), F.lit(0.0).alias("value"))  # a matrix without rows has no tasks
    sums = parts.unionAll(none).groupBy("at").agg(F.sum("value").alias("value"))
    values = materialized(sums.select("at", (F.abs("value") if statistic == "sum" else F.col("value")).alias("value")))
    seen = values.agg(F.max(F.when(F.col("at") == 0, F.col("value"))).alias("observed"))
    null = values.where("at > 0").crossJoin(F.broadcast(seen))
    reach = F.sum((F.col("value") >= F.col("observed") - F.abs("observed") * EQUAL).cast("long"))
    p = reach / F.count("*") if exact else (1 + reach) / (1 + F.count("*"))
    made = null.agg(F.max("observed").alias("observed"), F.avg("value").alias("null_mean"), F.stddev_pop("value").alias("null_sd"), F.count("*").alias("permutations"), p.alias("p"))
    return made.select("observed", "null_mean", "null_sd", "permutations", F.lit(exact).alias("exact"), "p")


def running_score(ranks: np.ndarray, weights: np.ndarray, n: int) -> float:
    """The enrichment of ranks (from 1, rising) among n: the largest deviation, with its sign, of the share of weight that
    hits have up to a place from the share of the other places; of equal ones the positive."""
    m = len(ranks)
    if not m or m >= n:
        return 0.0
    total = weights.sum()
    up = np.cumsum(weights) / max(1e-9, total)
    missed = (ranks - np.arange(1, m + 1)) / (n - m)
    top = max(0.0, float((up - missed).max()))
    low = min(0.0, float((np.r_[0, up[:-1]] - missed).min()))
    return top if top >= -low else low


def _draws(n: int, size: int, permutations: int, seed: int) -> tuple[int, bool]:
    exact = math.comb(n, size) <= permutations
    return (math.comb(n, size) if exact else permutations), exact


def enrichment(features: DataFrame, sets: DataFrame, name: str, value: str, permutations: int = 200, min_size: int = 2, seed: int = 1) -> DataFrame:
    """(gene_set, size, es, normalised, null_mean, exact, p, leading) for sets (gene_set, member) over features ranked by
    falling value (then name).

    es is the ``running_score`` of the members, weighted by the absolute value; normalised is es / sqrt(size). The null
    takes random members of the same number: all choices, if there are no more than ``permutations``, and p is the share
    whose absolute score reaches that of the set; else as many seeded ones of exact size, and p is (1 + those that do) /
    (1 + permutations). Draws depend on the seed, the size and their number only. leading has the six members of best
    rank. Members that are no feature, and repeated ones, don't count; sets below ``min_size`` are left out. Features
    with a null name or value take no part; of a repeated name the greatest value does. A set's members meet in one row.
    """
    clean = features.select(F.col(name).alias("name"), F.col(value).cast("double").alias("value")).where("name IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)")
    ranked = materialized(ordinal(clean.groupBy("name").agg(F.max("value").alias("value")), [F.desc("value"), "name"], "rank").select("name", F.abs("value").alias("w"), "rank"))
    n = ranked.count()
    own = sets.select("gene_set", F.col("member").alias("name")).distinct().join(ranked, "name").groupBy("gene_set").agg(F.array_sort(F.collect_list(F.struct("rank", "w", "name"))).alias("hits"))
    own = materialized(own.where(F.size("hits") >= min_size))

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [running_score(np.array([h["rank"] for h in x]), np.array([h["w"] for h in x]), n) for x in frame["hits"]]
            yield frame.drop(columns=["hits"]).assign(es=np.array(made, float))

    keys = own.schema["gene_set"].dataType.simpleString()
    observed = own.select("gene_set", F.size("hits").alias("size"), "hits").mapInPandas(score, f"gene_set {keys}, size int, es double")
    # the null of each size: rows (size, draw, rank) join the weights, and each draw is scored
    sizes = own.select(F.size("hits").alias("size")).distinct()
    counted = F.udf(lambda size: _draws(n, size, permutations, seed)[0], "long")
    numbers = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), counted("size") - 1))).repartition("size", "draw")

    def drawn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        listed: dict[int, list] = {}
        for frame in frames:
            for size, draw in zip(frame["size"].tolist(), frame["draw"].tolist(), strict=True):
                if _draws(n, size, permutations, seed)[1]:
                    if size not in listed:
                        listed[size] = list(combinations(range(1, n + 1), size))
                    ranks = np.array(listed[size][draw])
                else:
                    ranks = np.sort(np.random.default_rng([seed, size, draw]).choice(n, size, replace=False)) + 1
                yield pd.DataFrame({"size": size, "draw": draw, "rank": ranks})

    draws = numbers.mapInPandas(drawn, "size int, draw long, rank long").join(ranked.select("rank", "w"), "rank").groupBy("size", "draw").agg(F.array_sort(F.collect_list(F.struct("rank", "w"))).alias("hits"))
    null = draws.select(F.col("size").alias("gene_set"), "size", "hits").mapInPandas(score, "gene_set int, size int, es double").select(F.col("size").alias("_size"), F.col("es").alias("v"))
    both = observed.join(null, F.col("size") == F.col("_size"))
    reach = F.sum((F.abs("v") >= F.abs("es") - EQUAL).cast("long"))
    exact = F.count("*") == F.max(F.col("_all"))
    every = F.udf(lambda size: float(math.comb(n, size)) if math.comb(n, size) <= permutations else -1.0, "double")
    made = both.withColumn("_all", every("size")).groupBy("gene_set", "size", "es").agg(F.avg("v").alias("null_mean"), exact.alias("exact"), F.when(exact, reach / F.count("*")).otherwise((1 + reach) / (1 + F.count("*"))).alias("p"))
    lead = own.select(F.col("gene_set").alias("_set"), F.array_join(F.transform(F.slice("hits", 1, 6), lambda h: h["name"]), ",").alias("leading"))
    return made.join(lead, F.col("gene_set").eqNullSafe(F.col("_set"))).select("gene_set", "size", "es", (F.col("es") / F.sqrt("size")).alias("normalised"), "null_mean", "exact", "p", "leading")
