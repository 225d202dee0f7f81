"""p-values as vectorised functions, from series and continued fractions in numpy; no row-at-a-time Python."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def gamma_upper(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma function: by its series below a + 1, by Lentz's fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    safe = np.maximum(x, 1e-300)
    front = np.exp(a * np.log(safe) - safe - _lgamma(np.maximum(a, 1e-300)))
    term = total = 1 / np.maximum(a, 1e-300)
    for n in range(1, 400):
        term = term * safe / (a + n)
        total = total + term
    b = safe + 1 - a
    c, d = np.full_like(b, 1e300), 1 / np.where(b == 0, 1e-300, b)
    h = d.copy()
    for n in range(1, 400):
        an = -n * (n - a)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(d == 0, 1e-300, d)
        c = b + an / c
        c = np.where(c == 0, 1e-300, c)
        h = h * d * c
    with np.errstate(all="ignore"):
        out = np.where(safe < a + 1, 1 - front * total, front * h)
    return np.clip(np.where(x <= 0, 1.0, out), 0, 1)


def beta_lower(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by Lentz's fraction."""
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    inside = np.clip(y, 1e-300, 1 - 1e-16)
    front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(inside) + q * np.log1p(-inside)) / p
    c, d = np.ones_like(y), 1 / np.where(1 - (p + q) * y / (p + 1) == 0, 1e-300, 1 - (p + q) * y / (p + 1))
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / np.where(1 + num * d == 0, 1e-300, 1 + num * d)
            c = np.where(1 + num / c == 0, 1e-300, 1 + num / c)
            h = h * d * c
    out = np.where(y <= 0, 0.0, front * h)
    return np.clip(np.where(swap, 1 - out, out), 0, 1)


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail of the chi-square distribution."""
    v = gamma_upper(df.to_numpy(float) / 2, np.nan_to_num(x.to_numpy(float)) / 2)
    return pd.Series(v).where(x.notna().to_numpy() & df.notna().to_numpy())


@F.pandas_udf(T.DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided tail of Student's t distribution."""
    v, n = np.nan_to_num(t.to_numpy(float)), np.maximum(np.nan_to_num(df.to_numpy(float), nan=1.0), 1e-9)
    return pd.Series(beta_lower(n / 2, np.full_like(n, 0.5), n / (n + v * v))).where(t.notna().to_numpy() & df.notna().to_numpy())


@F.pandas_udf(T.DoubleType())
def f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Upper tail of the F distribution."""
    v, a, b = np.maximum(np.nan_to_num(f.to_numpy(float)), 0), d1.to_numpy(float), d2.to_numpy(float)
    return pd.Series(beta_lower(b / 2, a / 2, b / (b + a * v))).where(f.notna().to_numpy())


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided tail of the normal distribution."""
    return pd.Series(_erfc(np.abs(z.to_numpy(float)) / math.sqrt(2)))


@F.pandas_udf(T.DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided exact test of a 2x2 table: all tables of its margins no likelier than itself."""

    def one(a: int, b: int, c: int, d: int) -> float:
        row, column, n = a + b, a + c, a + b + c + d
        x = np.arange(max(0, row + column - n), min(row, column) + 1)
        log = -(_lgamma(x + 1) + _lgamma(row - x + 1) + _lgamma(column - x + 1) + _lgamma(n - row - column + x + 1))
        p = np.exp(log - log.max())
        own = p[a - x[0]]
        return float(min(1.0, p[p <= own * (1 + 1e-7)].sum() / p.sum()))

    return pd.Series([one(*map(int, v)) for v in zip(a, b, c, d, strict=True)], dtype=float)


def adjusted(df: DataFrame, p: str, method: str = "bh", out: str = "q") -> DataFrame:
    """p-values adjusted for the number of tests: bonferroni, holm, bh or by. Equal p-values share one adjusted
    value, so the cumulative pass is over distinct p-values by range partitions, not over one task's rows."""
    from ..plans.ordinals import running

    facts = df.where(F.col(p).isNotNull()).agg(F.count("*").alias("_m"))
    if method == "bonferroni":
        return df.crossJoin(F.broadcast(facts)).withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.col(p) * F.col("_m")))).drop("_m")
    each = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_k"))
    if method == "by":  # the sum of 1 / i once, not at every row
        facts = facts.withColumn("_h", F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest("_m", F.lit(1))), F.lit(0.0), lambda s, i: s + 1.0 / i))
    upto = running(each, ["_p"], "_k", "_rank").crossJoin(F.broadcast(facts))
    if method == "holm":
        made = running(upto.withColumn("_v", F.col("_p") * (F.col("_m") - F.col("_rank") + F.col("_k"))), ["_p"], "_v", "_q", "max")
    else:
        scale = F.col("_h") if method == "by" else F.lit(1.0)
        made = running(upto.withColumn("_v", F.col("_p") * F.col("_m") / F.col("_rank") * scale).withColumn("_back", -F.col("_p")), ["_back"], "_v", "_q", "min")
    values: Column = F.least(F.lit(1.0), F.col("_q"))
    return df.join(made.select("_p", values.alias(out)), F.col(p) == F.col("_p"), "left").drop("_p")


@F.pandas_udf(T.DoubleType())
def log_gamma(x: pd.Series) -> pd.Series:
    """The logarithm of the gamma function."""
    return pd.Series(_lgamma(x.to_numpy(float)))
