"""Joins of intervals: by chromosome and bin, so that neither a long chromosome nor a dense region meets in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The level of the narrowest bins, of 2 ^ LOWEST places.
LOWEST = 6


def level(length: Column) -> Column:
    """The level of an interval: bins of 2 ^ level places, of which it touches two at most, as a rule."""
    return F.greatest(F.lit(LOWEST), F.ceil(F.log2(F.greatest(length, F.lit(1)).cast("double")))).cast("int")


def _filed(df: DataFrame, low: str, high: str, own: str, at: str, bin: str, coarser: list[int]) -> DataFrame:
    """Rows in the bins of their own level, and of each coarser one of the list."""
    levels = F.concat(F.array(own), F.filter(F.array(*[F.lit(x) for x in coarser]).cast("array<int>"), lambda x: x > F.col(own)))
    each = df.withColumn(at, F.explode(levels))
    first, last = F.expr(f"shiftright(`{low}`, `{at}`)"), F.expr(f"shiftright(`{high}` - 1, `{at}`)")
    return each.withColumn(bin, F.explode(F.sequence(first, F.greatest(first, last))))


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def overlapping(a: DataFrame, b: DataFrame, slack: int = 0, strand: bool = False, how: str = "inner") -> DataFrame:
    """Pairs of half-open intervals (chrom, start, stop) that overlap once ``a`` is widened by ``slack``; columns are
    a_* and b_*.

    Each interval is filed by its own length, in bins of a level that it touches one or two of, and in the bins of the
    coarser levels that the other side has; so one interval as long as a chromosome widens no other's bins. A pair meets
    on the coarser of its two levels, in the first bin that it shares, so it comes once. ``strand``: strands are equal, or
    one is '.'. ``how``: inner, left_semi or left_anti. One pass over the lengths of both sides runs while this is called.
    """
    if how != "inner":
        rows = a.withColumn("_id", F.struct(*a.columns))
        hit = overlapping(rows, b, slack, strand).select(F.col("a__id").alias("_hit")).distinct()
        return rows.join(hit, F.col("_id").eqNullSafe(F.col("_hit")), how).drop("_id")
    left = prefixed(a, "a_").withColumns({"_low": F.col("a_start").cast("long") - slack, "_high": F.col("a_stop").cast("long") + slack})
    right = prefixed(b, "b_").withColumns({"_start": F.col("b_start").cast("long"), "_stop": F.col("b_stop").cast("long")})
    left, right = left.withColumn("_own", level(F.col("_high") - F.col("_low"))), right.withColumn("_their", level(F.col("_stop") - F.col("_start")))
    seen = left.select(F.lit(True).alias("a"), F.col("_own").alias("at")).distinct().unionAll(right.select(F.lit(False), "_their").distinct()).collect()  # tens of rows
    of = {side: sorted(r["at"] for r in seen if r.a == side and r["at"] is not None) for side in (True, False)}
    left = _filed(left, "_low", "_high", "_own", "_at", "_bin", of[False])
    right = _filed(right, "_start", "_stop", "_their", "_to", "_other", of[True])
    on = (F.col("a_chrom") == F.col("b_chrom")) & (F.col("_at") == F.col("_to")) & (F.col("_bin") == F.col("_other")) & (F.col("_low") < F.col("_stop")) & (F.col("_start") < F.col("_high"))
    on = on & (F.col("_at") == F.greatest("_own", "_their")) & (F.col("_bin") == F.greatest(F.expr("shiftright(_low, _at)"), F.expr("shiftright(_start, _at)")))
    if strand:
        on = on & ((F.col("a_strand") == F.col("b_strand")) | (F.col("a_strand") == ".") | (F.col("b_strand") == "."))
    return left.join(right, on).drop("_low", "_high", "_own", "_at", "_bin", "_start", "_stop", "_their", "_to", "_other")
