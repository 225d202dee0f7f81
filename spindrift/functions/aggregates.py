"""Named statistics as aggregate columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def statistic(name: str, c: Column) -> Column:
    """One of the named statistics of a column; nulls don't count, unknown names raise.

    Deviations are of samples; the variance of fewer than two values is 0. ``skewness`` and ``kurtosis`` standardise
    by the sample deviation and divide by n. ``cv`` is in percent.
    """
    v = c.cast("double")
    n = F.count(v)
    sd = F.coalesce(F.stddev_samp(v), F.when(n > 0, F.lit(0.0)))
    quantile = lambda p: F.percentile(v, F.lit(p))
    made = {
        "count": lambda: F.count(c), "sum": lambda: F.sum(v), "mean": lambda: F.avg(v), "median": lambda: quantile(0.5), "min": lambda: F.min(v), "max": lambda: F.max(v),
        "range": lambda: F.max(v) - F.min(v), "stdev": lambda: sd, "variance": lambda: sd * sd, "cv": lambda: 100 * sd / F.nullif(F.avg(v), F.lit(0.0)), "sem": lambda: sd / F.sqrt(n),
        "q1": lambda: quantile(0.25), "q3": lambda: quantile(0.75), "iqr": lambda: quantile(0.75) - quantile(0.25), "p5": lambda: quantile(0.05), "p95": lambda: quantile(0.95),
        "distinct": lambda: F.count_distinct(c), "unique": lambda: F.count_distinct(c), "mode": lambda: F.mode(v, True), "product": lambda: F.product(v),
        "geomean": lambda: F.exp(F.avg(F.log(F.when(v > 0, v)))), "rms": lambda: F.sqrt(F.avg(v * v)),
        "skewness": lambda: F.skewness(v) * F.pow((n - 1) / n, F.lit(1.5)), "kurtosis": lambda: (F.kurtosis(v) + 3) * F.pow((n - 1) / n, F.lit(2.0)) - 3,
    }
    if name not in made:
        raise ValueError(f"no statistic {name}")
    return made[name]()
