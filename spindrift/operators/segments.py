"""Segmentation of ordered series: binary segmentation of all open segments at once, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordinals import materialized, ordinal, running

#: Segments up to which their figures are broadcast to the rows.
SENT = 100_000


def segmented(df: DataFrame, key: str, order: list[str], value: str, delta: float = 0.01, margin: int = 4, depth: int = 12) -> DataFrame:
    """The rows of ``df`` with a value, with ``segment``, the number of their segment within the key, from 0 in order.

    A segment of n values is split where the sum of squares falls most (of equal places at the first), at least
    ``margin`` values from either end, if it falls by more than delta / n of itself; up to ``depth`` times. A level
    takes all open segments of all keys at once: sums up to each row are running sums over range partitions, computed
    once, a segment's figures are one aggregate, and each row is judged as the last one of the left part. Null values
    are left out; ties in the order are broken by the value."""
    own = df.where(F.col(value).isNotNull()).withColumn("_v", F.col(value).cast("double"))
    numbered = materialized(ordinal(own, [key, *order, "_v"], "_i"))
    mean = numbered.agg(F.avg("_v")).first()[0] or 0.0  # about zero, sums lose least
    centred = numbered.withColumn("_c", F.col("_v") - mean)
    summed = running(running(centred, ["_i"], "_c", "_sum"), ["_i"], F.col("_c") * F.col("_c"), "_squares")
    now = materialized(summed.withColumns({"_path": F.lit(1).cast("long"), "_open": F.lit(True)}))
    for level in range(depth + 1):
        last = F.max_by(F.struct("_sum", "_squares", "_c"), "_i")
        first = F.min_by(F.struct((F.col("_sum") - F.col("_c")).alias("_sum"), (F.col("_squares") - F.col("_c") * F.col("_c")).alias("_squares")), "_i")
        facts = now.where("_open").groupBy(key, "_path").agg(F.min("_i").alias("_lo"), F.count("*").alias("_n"), first.alias("_f"), last.alias("_l"))
        facts = facts.where(F.col("_n") >= 2 * margin).select(F.col(key).alias("_key"), F.col("_path").alias("_p"), "_lo", "_n", F.col("_f._sum").alias("_s0"), (F.col("_l._sum") - F.col("_f._sum")).alias("_s"), (F.col("_l._squares") - F.col("_f._squares")).alias("_q"))
        facts = materialized(facts)
        few = F.broadcast(facts) if facts.count() <= SENT else facts
        left, total = F.col("_i") - F.col("_lo") + 1, F.col("_n")
        share = F.col("_sum") - F.col("_s0")
        gain = share * share / left + (F.col("_s") - share) * (F.col("_s") - share) / (total - left) - F.col("_s") * F.col("_s") / total
        inside = now.join(few, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_path") == F.col("_p"))).where((left >= margin) & (left < total - margin))
        base = F.col("_q") - F.col("_s") * F.col("_s") / total
        best = inside.groupBy("_key", "_p").agg(F.max(F.struct(gain.alias("gain"), (-F.col("_i")).alias("at"))).alias("_b"), F.first(base).alias("_base"), F.first("_n").alias("_n"))
        cuts = materialized(best.where(F.col("_b.gain") > delta * F.col("_base") / F.col("_n")).select("_key", "_p", (-F.col("_b.at")).alias("_cut")))
        if level == depth or cuts.isEmpty():
            break
        sent = F.broadcast(cuts) if cuts.count() <= SENT else cuts
        both = now.join(sent, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_path") == F.col("_p")), "left")
        cut = F.col("_cut").isNotNull()
        # a path has a digit a level: a closed segment goes left from then on
        right = F.when(cut & (F.col("_i") > F.col("_cut")), 1).otherwise(0)
        now = materialized(both.withColumns({"_path": F.col("_path") * 2 + right, "_open": cut}).drop("_key", "_p", "_cut"))
    names = now.select(key, "_path").distinct()
    ranked = ordinal(names, [key, "_path"], "_s")
    starts = ranked.groupBy(key).agg(F.min("_s").alias("_least"))
    labels = ranked.withColumnRenamed(key, "_key").join(starts.withColumnRenamed(key, "_k"), F.col("_key").eqNullSafe(F.col("_k"))).select("_key", F.col("_path").alias("_p"), (F.col("_s") - F.col("_least")).alias("segment"))
    return now.join(labels, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_path") == F.col("_p"))).select(*df.columns, "segment")


def copy_segments(df: DataFrame, chrom: str = "chrom", pos: str = "pos", value: str = "value", ploidy: float = 2.0, delta: float = 0.01) -> DataFrame:
    """(chrom, segment, start, stop, n, mean, state, copies): segments of log2 ratios; a mean above 0.3 is a gain, below
    -0.3 a loss; copies is ploidy * 2 ^ mean."""
    made = segmented(df, chrom, [pos], value, delta).groupBy(chrom, "segment").agg(F.min(pos).alias("start"), F.max(pos).alias("stop"), F.count("*").alias("n"), F.avg(value).alias("mean"))
    state = F.when(F.col("mean") > 0.3, "gain").when(F.col("mean") < -0.3, "loss").otherwise("neutral")
    return made.select(F.col(chrom).alias("chrom"), "segment", "start", "stop", "n", "mean", state.alias("state"), (ploidy * F.pow(F.lit(2.0), "mean")).alias("copies"))
