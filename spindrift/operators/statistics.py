"""Tests, correlations, regressions and information measures on columns, groups and long matrices (row, column, value)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.pvalues import chi2_p, f_p, normal_p, t_p
from ..plans.ordinals import running


def long_matrix(df: DataFrame, row: str, columns: list[str]) -> DataFrame:
    return df.select(F.col(row).alias("row"), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot("row", columns, "column", "value")


def per_million(long: DataFrame, log: bool = False) -> DataFrame:
    """Counts per million of each column's total."""
    totals = long.groupBy("column").agg(F.sum("value").alias("_total"))
    v = F.col("value") * 1e6 / F.nullif(F.col("_total"), F.lit(0.0))
    return long.join(F.broadcast(totals), "column").select("row", "column", (F.log2(v + 1) if log else v).alias("value"))


def tpm(long: DataFrame, lengths: DataFrame) -> DataFrame:
    """Transcripts per million: rates by length (row, length in bases), scaled by column."""
    rate = long.join(lengths.withColumnRenamed("row", "_row"), F.col("row") == F.col("_row")).select("row", "column", (F.col("value") / F.col("length") * 1000).alias("value"))
    return per_million(rate)


def quantile_normalized(long: DataFrame) -> DataFrame:
    """Values replaced by the mean, over columns, of the values of their rank; columns are independent groups and
    ranks are dense within them by (value, row)."""
    rank = F.row_number().over(Window.partitionBy("column").orderBy("value", "row"))
    ranked = long.withColumn("_rank", rank)
    means = ranked.groupBy("_rank").agg(F.avg("value").alias("_mean"))
    return ranked.join(means, "_rank").select("row", "column", F.col("_mean").alias("value"))


def two_groups(long: DataFrame, first: list[str], second: list[str]) -> DataFrame:
    """(row, moments of both groups of columns)."""
    a, b = F.when(F.col("column").isin(*first), F.col("value")), F.when(F.col("column").isin(*second), F.col("value"))
    return long.groupBy("row").agg(F.count(a).alias("n_a"), F.count(b).alias("n_b"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.var_samp(a).alias("var_a"), F.var_samp(b).alias("var_b"))


def fold_change(long: DataFrame, first: list[str], second: list[str], pseudo: float = 1.0) -> DataFrame:
    g = two_groups(long, first, second)
    return g.select("row", "mean_a", "mean_b", F.log2((F.col("mean_b") + pseudo) / (F.col("mean_a") + pseudo)).alias("log2fc"))


def t_test(groups: DataFrame, welch: bool = False) -> DataFrame:
    """t, degrees of freedom, p and Cohen's d from the moments of two groups."""
    n, m, v, w = F.col("n_a"), F.col("n_b"), F.col("var_a"), F.col("var_b")
    d = F.col("mean_a") - F.col("mean_b")
    pooled = ((n - 1) * v + (m - 1) * w) / F.nullif(n + m - 2, F.lit(0))
    se = F.sqrt(v / n + w / m) if welch else F.sqrt(pooled * (1 / n + 1 / m))
    df = (F.pow(v / n + w / m, F.lit(2.0)) / F.nullif(F.pow(v / n, F.lit(2.0)) / (n - 1) + F.pow(w / m, F.lit(2.0)) / (m - 1), F.lit(0.0))) if welch else (n + m - 2).cast("double")
    made = groups.withColumns({"t": d / F.nullif(se, F.lit(0.0)), "df": df, "cohen_d": d / F.nullif(F.sqrt(pooled), F.lit(0.0))})
    return made.withColumn("p", t_p("t", "df"))


def moderated_t(groups: DataFrame, prior: float = 3.0) -> DataFrame:
    """t with variances shrunk to their mean by a prior number of degrees of freedom."""
    n, m = F.col("n_a"), F.col("n_b")
    pooled = ((n - 1) * F.col("var_a") + (m - 1) * F.col("var_b")) / F.nullif(n + m - 2, F.lit(0))
    own = groups.withColumn("pooled", pooled)
    both = own.crossJoin(F.broadcast(own.agg(F.avg("pooled").alias("_mean"))))
    shrunk = ((n + m - 2) * F.col("pooled") + prior * F.col("_mean")) / (n + m - 2 + prior)
    t = (F.col("mean_a") - F.col("mean_b")) / F.nullif(F.sqrt(shrunk * (1 / n + 1 / m)), F.lit(0.0))
    return both.withColumns({"t": t, "df": (n + m - 2 + prior)}).drop("_mean").withColumn("p", t_p("t", "df"))


def average_ranks(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``df`` with ``rank``, equal values sharing the mean of theirs, and ``ties``; counted by value first."""
    counts = df.groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("ties"))
    before = F.coalesce(F.sum("ties").over(Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.withColumn("rank", before + (F.col("ties") + 1) / 2)
    keys = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by]
    other = ranked.select(*[F.col(k).alias(f"_{k}") for k in by], F.col("_v"), "rank", "ties")
    on = F.col(value) == F.col("_v")
    for k in keys:
        on = on & k
    return df.join(other, on).drop("_v", *[f"_{k}" for k in by])


def rank_sum(long: DataFrame, first: list[str], second: list[str]) -> DataFrame:
    """Mann-Whitney U by row: normal approximation with ties, no continuity correction."""
    own = long.where(F.col("column").isin(*first, *second) & F.col("value").isNotNull())
    ranked = average_ranks(own, "value", ["row"])
    a = F.col("column").isin(*first)
    g = ranked.groupBy("row").agg(F.sum(a.cast("long")).alias("n"), F.sum((~a).cast("long")).alias("m"), F.sum(F.when(a, F.col("rank"))).alias("r"), F.sum(F.col("ties") * F.col("ties") - 1).alias("t"))
    n, m = F.col("n"), F.col("m")
    u = F.col("r") - n * (n + 1) / 2
    sd = F.sqrt(n * m / 12 * ((n + m + 1) - F.col("t") / ((n + m) * (n + m - 1))))
    return g.select("row", "n", "m", u.alias("u"), ((u - n * m / 2) / F.nullif(sd, F.lit(0.0))).alias("z")).withColumn("p", normal_p("z"))


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way analysis of variance from the moments of the groups."""
    v = F.col(value).cast("double")
    g = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.var_pop(v).alias("var"))
    all_n, mean = F.sum("n"), F.sum("s") / F.sum("n")
    facts = g.agg(all_n.alias("n"), F.count("*").alias("k"), mean.alias("mean"), F.sum(F.col("var") * F.col("n")).alias("within"))
    between = g.crossJoin(F.broadcast(facts.select(F.col("mean").alias("_m")))).agg(F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("_m"), F.lit(2.0))).alias("between"))
    both = facts.crossJoin(between)
    d1, d2 = (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")
    return both.select("n", "k", "between", "within", ((F.col("between") / d1) / (F.col("within") / d2)).alias("f"), d1.alias("df1"), d2.alias("df2")).withColumn("p", f_p("f", "df1", "df2"))


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """Kruskal-Wallis with ties: mean ranks over distinct values by range partitions."""
    own = df.where(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("v"))
    counts = own.groupBy("v").agg(F.count("*").alias("ties"))
    ranked = running(counts, ["v"], "ties", "upto").select(F.col("v").alias("_v"), "ties", (F.col("upto") - F.col("ties") + (F.col("ties") + 1) / 2).alias("rank"))
    g = own.groupBy(group, "v").count().join(ranked, F.col("v") == F.col("_v")).groupBy(group).agg(F.sum("count").alias("n"), F.sum(F.col("rank") * F.col("count")).alias("r"))
    t = counts.agg(F.sum(F.col("ties") * F.col("ties") * F.col("ties") - F.col("ties")).alias("t"))
    made = g.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("x")).crossJoin(F.broadcast(t))
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("x") - 3 * (n + 1)) / (1 - F.col("t") / (n * n * n - n))
    return made.select("n", "k", h.alias("h")).withColumn("p", chi2_p("h", (F.col("k") - 1).cast("double")))


def contingency(df: DataFrame, row: str, column: str) -> DataFrame:
    """Chi-square and G of a table of two columns, with expected counts from its margins."""
    cells = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(F.col(row).alias("r"), F.col(column).alias("c")).count()
    rows, columns, total = cells.groupBy("r").agg(F.sum("count").alias("rn")), cells.groupBy("c").agg(F.sum("count").alias("cn")), cells.agg(F.sum("count").alias("n"))
    # cells that don't occur add their expectation, which is what the expected counts have left
    both = cells.join(rows, "r").join(columns, "c").crossJoin(F.broadcast(total))
    e = F.col("rn") * F.col("cn") / F.col("n")
    seen = both.agg(F.max("n").alias("n"), F.sum((F.col("count") - e) * (F.col("count") - e) / e).alias("x"), F.sum(e).alias("e"), F.sum(2 * F.col("count") * F.log(F.col("count") / e)).alias("g"))
    sizes = rows.agg(F.count("*").alias("nr")).crossJoin(columns.agg(F.count("*").alias("nc")))
    made = seen.crossJoin(sizes)
    df_ = ((F.col("nr") - 1) * (F.col("nc") - 1)).cast("double")
    return made.select("n", (F.col("x") + F.col("n") - F.col("e")).alias("chi2"), "g", df_.alias("df")).withColumn("p", chi2_p("chi2", "df"))


def correlation(df: DataFrame, x: str, y: str, method: str = "pearson") -> DataFrame:
    """r, n, t and p of two columns; Spearman's is Pearson's of mean ranks."""
    own = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    if method == "spearman":
        for c in "xy":
            counts = own.groupBy(c).agg(F.count("*").alias("k"))
            ranks = running(counts, [c], "k", "upto").select(F.col(c).alias("_c"), (F.col("upto") - F.col("k") + (F.col("k") + 1) / 2).alias("_r"))
            own = own.join(ranks, F.col(c) == F.col("_c")).withColumn(c, F.col("_r")).drop("_c", "_r")
    made = own.agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"))
    r = F.greatest(F.least(F.col("r"), F.lit(0.999999)), F.lit(-0.999999))
    return made.withColumn("t", r * F.sqrt((F.col("n") - 2) / (1 - r * r))).withColumn("p", t_p("t", F.greatest(F.col("n") - 2, F.lit(1)).cast("double")))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r): all pairs of columns in one pass, each over the rows where both are there."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def regression(df: DataFrame, x: str, y: str) -> DataFrame:
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return df.agg(F.regr_count(b, a).alias("n"), F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.regr_r2(b, a).alias("r2"))


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, skewness, kurtosis, jarque_bera, p) from population moments."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value").where("value is not null")
    s, k, n = F.skewness("value"), F.kurtosis("value"), F.count("value")
    return long.groupBy("column").agg(n.alias("n"), s.alias("skewness"), k.alias("kurtosis"), (n / 6 * (s * s + k * k / 4)).alias("jarque_bera")).withColumn("p", chi2_p("jarque_bera", F.lit(2.0)))


def two_sample_ks(df: DataFrame, value: str, first: Column) -> DataFrame:
    """The greatest distance of two distribution functions, over distinct values by range partitions."""
    own = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.sum(first.cast("long")).alias("a"), F.sum((~first).cast("long")).alias("b"))
    total = own.agg(F.sum("a").alias("n"), F.sum("b").alias("m"))
    upto = running(running(own, ["v"], "a", "fa"), ["v"], "b", "fb").crossJoin(F.broadcast(total))
    return upto.agg(F.max("n").alias("n"), F.max("m").alias("m"), F.max(F.abs(F.col("fa") / F.col("n") - F.col("fb") / F.col("m"))).alias("d"))


def roc(df: DataFrame, score: str, truth: Column) -> DataFrame:
    """(threshold, tpr, fpr) of every distinct score, highest first."""
    own = df.groupBy(F.col(score).alias("threshold")).agg(F.sum(truth.cast("long")).alias("p"), F.sum((~truth).cast("long")).alias("f")).withColumn("_back", -F.col("threshold"))
    total = own.agg(F.sum("p").alias("_p"), F.sum("f").alias("_f"))
    upto = running(running(own, ["_back"], "p", "tp"), ["_back"], "f", "fp").crossJoin(F.broadcast(total))
    return upto.select("threshold", (F.col("tp") / F.col("_p")).alias("tpr"), (F.col("fp") / F.col("_f")).alias("fpr"), "p", "f", "_p", "_f", "fp")


def auc(df: DataFrame, score: str, truth: Column) -> DataFrame:
    """Area under the curve: pairs that are in order, ties half."""
    r = roc(df, score, truth)
    return r.agg((F.sum(F.col("p") * (F.col("_f") - F.col("fp") + F.col("f") / 2)) / (F.max("_p") * F.max("_f"))).alias("auc"))


def mutual_information(df: DataFrame, columns: list[str], target: str, bins: int = 10) -> DataFrame:
    """(column, mi): in nats, between equal-width bins of each column and of the target; the greatest value is in the
    last bin."""
    every = [*columns, target]
    ends = df.agg(*[F.min(c).cast("double").alias(f"lo_{c}") for c in every], *[F.max(c).cast("double").alias(f"hi_{c}") for c in every])
    at = lambda c: F.least(F.lit(bins - 1), F.floor((F.col(c) - F.col(f"lo_{c}")) / F.nullif((F.col(f"hi_{c}") - F.col(f"lo_{c}")) / bins, F.lit(0.0))))
    cut = df.crossJoin(F.broadcast(ends)).select(at(target).alias("t"), *[at(c).alias(c) for c in columns])
    cells = cut.unpivot("t", columns, "column", "v").where("t is not null and v is not null").groupBy("column", "t", "v").count()
    n = Window.partitionBy("column")
    total, row, col = F.sum("count").over(n), F.sum("count").over(n.partitionBy("column", "t")), F.sum("count").over(n.partitionBy("column", "v"))
    c = cells.withColumns({"n": total, "r": row, "k": col})  # at most bins * bins cells a column
    return c.groupBy("column").agg(F.sum(F.col("count") / F.col("n") * F.log(F.col("count") * F.col("n") / (F.col("r") * F.col("k")))).alias("mi"))


def transitions(df: DataFrame, first: str, second: str) -> DataFrame:
    counted = df.groupBy(F.col(first).alias("a"), F.col(second).alias("b")).agg(F.count("*").alias("n"))
    total = counted.groupBy(F.col("a").alias("_a")).agg(F.sum("n").alias("_n"))
    return counted.join(total, F.col("a").eqNullSafe(F.col("_a"))).select("a", "b", "n", (100 * F.col("n") / F.col("_n")).alias("percent"))


def degrees(edges: DataFrame, a: str, b: str, weight: str) -> DataFrame:
    """(node, degree, strength) of undirected edges, self-loops left out."""
    e = edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("x"), F.col(b).alias("y"), F.col(weight).alias("w"))
    both = e.unionAll(e.select("y", "x", "w"))
    pairs = both.groupBy("x", "y").agg(F.sum("w").alias("w"))
    return pairs.groupBy(F.col("x").alias("node")).agg(F.count("*").alias("degree"), F.sum("w").alias("strength"))


def set_combinations(df: DataFrame, member: str, group: str, groups: list) -> DataFrame:
    """(combination, n): members by exactly which of the listed groups they are in."""
    mask = sum((F.max(F.when(F.col(group) == g, 1 << i).otherwise(0)) for i, g in enumerate(groups)), F.lit(0))
    return df.groupBy(member).agg(mask.cast("long").alias("combination")).groupBy("combination").agg(F.count("*").alias("n"))


def highly_variable(long: DataFrame, bins: int = 6, top: int = 10) -> DataFrame:
    """(row, dispersion, bin, normalized, rank): variance over mean, less the median of the rows of similar mean (bins
    between quantiles of the means), best first, ties by row; rows without a positive mean are left out. Bins take the
    quantiles of as many values as there are rows of the matrix."""
    own = long.groupBy("row").agg(F.avg("value").alias("mean"), (F.var_samp("value") / F.nullif(F.avg("value"), F.lit(0.0))).alias("dispersion")).where("mean > 0 and dispersion is not null")
    edges = own.agg(*[F.percentile("mean", F.lit(i / bins)).alias(f"_e{i}") for i in range(1, bins)])
    at = sum(((F.col("mean") > F.col(f"_e{i}")).cast("int") for i in range(1, bins)), F.lit(0))
    binned = own.crossJoin(F.broadcast(edges)).withColumn("bin", at).drop(*[f"_e{i}" for i in range(1, bins)])
    medians = binned.groupBy(F.col("bin").alias("_bin")).agg(F.percentile("dispersion", F.lit(0.5)).alias("_median"))
    made = binned.join(F.broadcast(medians), F.col("bin") == F.col("_bin")).withColumn("normalized", F.col("dispersion") - F.col("_median"))
    return made.select("row", "dispersion", "bin", "normalized").orderBy(F.desc("normalized"), "row").limit(top)


def cross_correlations(a: DataFrame, b: DataFrame, key: str, first: list[str], second: list[str]) -> DataFrame:
    """(a, b, n, r): Pearson's r of each column of one table with each of another, rows joined by a key; one pass."""
    both = a.select(key, *[F.col(c).cast("double").alias(f"a_{c}") for c in first]).join(b.select(key, *[F.col(c).cast("double").alias(f"b_{c}") for c in second]), key)
    x = {(p, q): (F.col(f"a_{p}"), F.col(f"b_{q}")) for p in first for q in second}
    made = both.agg(F.array(*[F.struct(F.lit(p).alias("a"), F.lit(q).alias("b"), F.sum((u.isNotNull() & v.isNotNull()).cast("long")).alias("n"), F.corr(u, v).alias("r")) for (p, q), (u, v) in x.items()]).alias("x"))
    return made.select(F.inline("x"))


def prevalent(long: DataFrame, share: float = 0.5, least: float = 0.0) -> DataFrame:
    """(row, samples, prevalence): rows above ``least`` in at least a share of the columns."""
    n = long.select("column").distinct().agg(F.count("*").alias("_n"))
    made = long.groupBy("row").agg(F.sum((F.col("value") > least).cast("long")).alias("samples")).crossJoin(F.broadcast(n))
    return made.withColumn("prevalence", F.col("samples") / F.col("_n")).where(F.col("prevalence") >= share).drop("_n")


def set_score(long: DataFrame, first: list[str], second: list[str]) -> DataFrame:
    """(column, score_a, score_b, phase): the mean of two sets of rows in each column, and the greater of them."""
    a, b = F.when(F.col("row").isin(*first), F.col("value")), F.when(F.col("row").isin(*second), F.col("value"))
    made = long.groupBy("column").agg(F.avg(a).alias("score_a"), F.avg(b).alias("score_b"))
    return made.withColumn("phase", F.when(F.greatest("score_a", "score_b") <= 0, "none").when(F.col("score_a") >= F.col("score_b"), "a").otherwise("b"))


def bootstrap_means(df: DataFrame, id: str, value: str, resamples: int = 1000, level: float = 0.95, seed: int = 1) -> DataFrame:
    """(n, mean, low, high): the mean and the percentile interval of its Poisson bootstrap.

    Each row has, in each resample, a Poisson(1) weight that a hash of its id gives, so the result doesn't depend on
    the partitioning; a task sends one pair of sums for each resample. Null values take no part."""
    own = df.where(F.col(value).isNotNull()).select(F.xxhash64(id, F.lit(seed)).alias("h"), F.col(value).cast("double").alias("x"))
    cdf = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)])

    def run(frames):
        s, w = np.zeros(resamples), np.zeros(resamples)
        mix = np.random.default_rng(seed).integers(0, 1 << 63, resamples).astype(np.uint64) | np.uint64(1)
        for frame in frames:
            h, x = frame.h.to_numpy().view(np.uint64), frame.x.to_numpy()
            for at in range(0, len(h), 4096):
                z = h[at : at + 4096, None] ^ mix[None, :]
                z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                n = np.searchsorted(cdf, ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53))
                s += x[at : at + 4096] @ n
                w += n.sum(0)
        yield pd.DataFrame({"resample": np.arange(resamples), "s": s, "w": w})

    means = own.mapInPandas(run, "resample int, s double, w double").groupBy("resample").agg((F.sum("s") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    tail = (1 - level) / 2
    ends = means.agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"))
    return own.agg(F.count("*").alias("n"), F.avg("x").alias("mean")).crossJoin(ends)


def power_analysis(spark: SparkSession, effect: float = 0.5, alpha: float = 0.05, power: float = 0.8, n: int = 0) -> DataFrame:
    """(effect, alpha, power, n): rows of each of two groups that a two-sided test needs, or the power that n give
    (normal approximation)."""
    from statistics import NormalDist

    z = NormalDist()
    a = z.inv_cdf(1 - alpha / 2)
    if n:
        power = z.cdf(effect * math.sqrt(n / 2) - a)
    else:
        n = math.ceil(2 * ((a + z.inv_cdf(power)) / effect) ** 2)
    return spark.createDataFrame([(effect, alpha, power, n)], "effect double, alpha double, power double, n long")
