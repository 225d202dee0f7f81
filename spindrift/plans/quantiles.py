"""Exact quantiles without a task that holds a column: counts by value, and running counts over range partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordinals import materialized, running

#: Keys up to which their counts are broadcast.
SENT = 100_000


def quantiles(df: DataFrame, by: list[str], value: str, points: list[float]) -> DataFrame:
    """(by, p, value): the quantiles of a value by keys, interpolated between neighbouring values, for points from 0 to 1.

    Equal values are counted first, in each task before the exchange. A running count in the order of keys and values
    then gives each value the ranks that it takes up, and only values at a wanted rank go on: at most two for each key
    and point. Null and NaN values take no part; keys without values have no rows. Null keys are a key. Jobs run
    while this is called."""
    keys = F.struct(*[F.col(k) for k in by]) if by else F.struct(F.lit(1).alias("one"))
    v = F.col(value).cast("double")
    counts = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(keys.alias("_k"), v.alias("_v")).agg(F.count("*").alias("_n"))
    placed = materialized(running(counts, ["_k", "_v"], "_n", "_upto"))
    totals = materialized(placed.groupBy(F.col("_k").alias("_key")).agg(F.min(F.col("_upto") - F.col("_n")).alias("_before"), F.sum("_n").alias("_total")))
    few = F.broadcast(totals) if totals.count() <= SENT else totals
    own = placed.join(few, F.col("_k").eqNullSafe(F.col("_key"))).withColumn("_last", F.col("_upto") - F.col("_before") - 1)
    at = lambda p: (F.col("_total") - 1) * F.lit(float(p))
    holds = lambda rank: (rank <= F.col("_last")) & (rank > F.col("_last") - F.col("_n"))
    each = F.array(*[F.struct(F.lit(float(p)).alias("p"), at(p).alias("x"), F.when(holds(F.floor(at(p))), F.col("_v")).alias("low"), F.when(holds(F.ceil(at(p))), F.col("_v")).alias("high")) for p in points])
    wanted = own.select("_k", F.explode(F.filter(each, lambda q: q["low"].isNotNull() | q["high"].isNotNull())).alias("q"))
    made = wanted.groupBy("_k", "q.p").agg(F.max("q.low").alias("low"), F.max("q.high").alias("high"), F.max("q.x").alias("x"))
    return made.select(*[F.col("_k")[k].alias(k) for k in by], "p", (F.col("low") + (F.col("high") - F.col("low")) * (F.col("x") - F.floor("x"))).alias("value"))


def quantile_row(df: DataFrame, by: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """(by, name...): quantiles as columns."""
    found = quantiles(df, by, value, sorted(set(points.values())))
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(name) for name, p in points.items()])
