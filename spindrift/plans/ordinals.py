"""Dense global ordinals and running values without a single-task window.

Rows are range-partitioned by a total order and written out; what crosses from one range into the next is one row a
range, so the windows that carry it on are over as many rows as there are partitions, never over the data.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANGE = "_range"


def materialized(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, ``spark.checkpoint.dir``. Where that is unset a folder is made in
    local mode only: other executors of a cluster would not see it."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def ranged(df: DataFrame, order: list) -> DataFrame:
    """``df`` with ``_range``, the number of its range partition by ``order``; written out, as the bounds are sampled."""
    return materialized(df.repartitionByRange(*order).withColumn(RANGE, F.spark_partition_id()))


def ordinal(df: DataFrame, order: list, name: str = "ln", start: int = 1) -> DataFrame:
    """``df`` with the dense position of each row in ``order`` (equal keys: in any order)."""
    parts = ranged(df, order)
    before = F.sum("_n").over(Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.groupBy(RANGE).agg(F.count("*").alias("_n")).select(RANGE, F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(RANGE).orderBy(*order))
    return parts.withColumn("_own", own).join(F.broadcast(offsets), RANGE).withColumn(name, (F.col("_own") + F.col("_before") + (start - 1)).cast("long")).drop(RANGE, "_own", "_before")


def running(df: DataFrame, order: list, value: Column | str, name: str, kind: str = "sum") -> DataFrame:
    """``df`` with the running sum, min, max, count or last non-null of a value in a total ``order``."""
    f = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "last": lambda c: F.last(c, ignorenulls=True)}[kind]
    merge = {"count": F.sum}.get(kind, f)
    parts = ranged(df.withColumn("_value", value if isinstance(value, Column) else F.col(value)), order)
    inside = Window.partitionBy(RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    whole = parts.withColumn("_own", f("_value").over(inside))
    last = Window.partitionBy(RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = parts.select(RANGE, f("_value").over(last).alias("_n")).distinct() if kind == "last" else parts.groupBy(RANGE).agg(f("_value").alias("_n"))
    carried = ends.select(RANGE, merge("_n").over(Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    own, before = F.col("_own"), F.col("_before")
    both = {"sum": own + before, "count": own + before, "min": F.least(own, before), "max": F.greatest(own, before), "last": F.coalesce(own, before)}[kind]
    return whole.join(F.broadcast(carried), RANGE).withColumn(name, F.coalesce(both, own, before)).drop(RANGE, "_own", "_before", "_value")


def previous(df: DataFrame, order: list, value: str, name: str, steps: int = 1) -> DataFrame:
    """``df`` with the value ``steps`` rows earlier in a total ``order``, by an equi-join of ordinals."""
    numbered = materialized(ordinal(df, order, "_at"))
    back = numbered.select((F.col("_at") + steps).alias("_at"), F.col(value).alias(name))
    return numbered.join(back, "_at", "left").drop("_at")
