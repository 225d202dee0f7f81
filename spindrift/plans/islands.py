"""Gaps and islands over ordered intervals, without a task that holds a whole chromosome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordinals import RANGE, ranged


def islands(df: DataFrame, keys: list[str], start: str, stop: str, distance: int = 0, ties: list[str] | None = None, name: str = "island") -> DataFrame:
    """``df`` with a dense island number: a row starts a new island if it begins more than ``distance`` beyond the
    furthest stop of the rows before it with the same keys.

    Rows go by keys, start, stop and ``ties``. As keys never fall in that order, the greatest (keys..., stop) so far
    is that of the current keys: one running maximum over range partitions serves all of them, and only one row a
    range crosses into the next.
    """
    order = [*keys, start, stop, *(ties or [])]
    parts = ranged(df.withColumn("_reach", F.struct(*keys, F.col(stop).alias("_stop"))), order)
    by = Window.partitionBy(RANGE).orderBy(*order)
    tops = parts.groupBy(RANGE).agg(F.max("_reach").alias("_top"))
    before = tops.select(RANGE, F.max("_top").over(Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    own = parts.withColumn("_own", F.max("_reach").over(by.rowsBetween(Window.unboundedPreceding, -1))).join(F.broadcast(before), RANGE)
    last = F.when(F.col("_own").isNull() | (F.col("_carried") > F.col("_own")), F.col("_carried")).otherwise(F.col("_own"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"_last.{k}").eqNullSafe(F.col(k))
    flagged = own.withColumn("_last", last).withColumn("_new", F.when(F.col("_last").isNotNull() & same & (F.col(start) <= F.col("_last._stop") + distance), 0).otherwise(1))
    counts = flagged.groupBy(RANGE).agg(F.sum("_new").alias("_n"))
    offsets = counts.select(RANGE, F.coalesce(F.sum("_n").over(Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = flagged.withColumn("_nth", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).join(F.broadcast(offsets), RANGE)
    return numbered.withColumn(name, (F.col("_nth") + F.col("_before")).cast("long")).drop(RANGE, "_reach", "_own", "_carried", "_last", "_new", "_nth", "_before")


def gaps_before(df: DataFrame, keys: list[str], order: list[str], column: str, name: str) -> DataFrame:
    """``df`` with the column's value in the row before, null at the first row of its keys; by ordinals, not by key."""
    from .ordinals import materialized, ordinal

    numbered = materialized(ordinal(df, [*keys, *order], "_at"))
    back = numbered.select((F.col("_at") + 1).alias("_at"), F.struct(*keys).alias("_keys"), F.col(column).alias("_value"))
    same = F.struct(*keys) == F.col("_keys")
    return numbered.join(back, "_at", "left").withColumn(name, F.when(same, F.col("_value"))).drop("_at", "_keys", "_value")
