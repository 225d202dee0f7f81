"""Trimming of reads and alignments, and presence of rows in two groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as s
from ..functions.pvalues import fisher_p

#: Cells (reads times length) whose qualities a task holds at once.
CELLS = 1 << 22


def _best_prefixes(quals: list[np.ndarray], threshold: float) -> np.ndarray:
    """How many leading bases to cut of each read: up to where the running sum of (mean - threshold - quality) is
    largest, the first such place; 0 if it never gets above 0. Sums are of whole numbers times the length, so they are
    exact; reads of a batch go place by place at once."""
    cut = np.zeros(len(quals), np.int64)
    order = sorted(range(len(quals)), key=lambda i: len(quals[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(quals[order[end]]) <= CELLS:
            end += 1
        rows = order[at:end]
        size = np.array([len(quals[i]) for i in rows])
        x = np.zeros((len(rows), size[-1]))
        for r, i in enumerate(rows):
            x[r, : size[r]] = quals[i]
        limit = x.sum(1) - float(threshold) * size  # all terms times the length: no rounding of the mean decides
        now, most, best = np.zeros(len(rows)), np.zeros(len(rows)), np.zeros(len(rows), np.int64)
        for j in range(x.shape[1]):
            now = now + limit - x[:, j] * size
            better = (now > most) & (j < size)
            best[better], most[better] = j + 1, now[better]
        cut[rows] = best
        at = end
    return cut


def mott_trimmed(reads: DataFrame, threshold: float = 5.0, least: int = 20, end: str = "both") -> DataFrame:
    """Reads (id, seq, qual) without their worst ends, of at least ``least`` bases and not empty.

    At each end asked for ("five_prime", "three_prime", "both"; the first one first) the bases go up to the place
    where the running sum of (mean quality - threshold - quality) is largest. Null sequences or qualities are no reads.
    """
    if end not in ("five_prime", "three_prime", "both"):
        raise ValueError(f"no such end: {end}")
    out = reads.where(F.col("seq").isNotNull() & F.col("qual").isNotNull()).withColumn("seq", F.upper("seq"))
    schema = out.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq, qual = batch.column("seq").to_pylist(), batch.column("qual").to_pylist()
            numbers = lambda back: [np.frombuffer(q.encode("utf-32-le"), "<u4")[::-1 if back else 1].astype(float) - 33 for q in qual]
            if end != "three_prime":
                cut = _best_prefixes(numbers(False), threshold)
                seq, qual = [x[c:] for x, c in zip(seq, cut, strict=True)], [x[c:] for x, c in zip(qual, cut, strict=True)]
            if end != "five_prime":
                cut = _best_prefixes(numbers(True), threshold)
                seq, qual = [x[: max(0, len(x) - c)] for x, c in zip(seq, cut, strict=True)], [x[: max(0, len(x) - c)] for x, c in zip(qual, cut, strict=True)]
            for name, made in (("seq", seq), ("qual", qual)):
                i = batch.schema.get_field_index(name)
                batch = batch.set_column(i, batch.schema.field(i), pa.array(made, batch.schema.field(i).type))
            yield batch.filter(pa.array([len(x) >= max(least, 1) for x in seq], pa.bool_()))

    return out.mapInArrow(run, schema)


def adapters_located(reads: DataFrame, five: str = "", three: str = "", least: int = 50, seed: int = 16) -> DataFrame:
    """(id, length, adapter_5p, adapter_3p, trimmed_length, kept): the first place (from 0) of the first ``seed`` bases
    of the 5' adapter and the last one of the 3' adapter's, -1 without; what is left lies behind the first base of
    the former and before the latter."""
    seq = F.upper("seq")
    first = F.locate(five[:seed], seq).cast("int") - 1 if five else F.lit(-1)
    behind = F.locate(three[:seed][::-1], F.reverse(seq)).cast("int")
    last = F.when(behind > 0, F.length(seq) - behind + 1 - len(three[:seed])).otherwise(-1) if three else F.lit(-1)
    found = reads.select("id", F.length("seq").alias("length"), first.alias("adapter_5p"), last.alias("adapter_3p"))
    stop = F.when(F.col("adapter_3p") > 0, F.col("adapter_3p")).otherwise(F.col("length"))
    left = F.greatest(stop - F.greatest(F.col("adapter_5p") + 1, F.lit(0)), F.lit(0))
    return found.withColumn("trimmed_length", left).withColumn("kept", F.col("trimmed_length") >= least)


def gap_trimmed(aligned: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(id, seq) of an alignment without the columns whose share of gaps is over ``threshold``.

    Places are counted by their number before the shuffle; the places kept, one number for each column of the
    alignment, go to all rows. Of rows of different lengths the missing places count as gaps and stay missing.
    """
    rows = aligned.where(F.col("seq").isNotNull())
    total = rows.agg(F.count("*").alias("n"))
    at = rows.select(F.posexplode(F.filter(F.split("seq", ""), lambda c: c != "")).alias("at", "c"))
    full = at.groupBy("at").agg(F.count_if(~F.col("c").isin("-", ".")).alias("bases")).join(F.broadcast(total))
    good = full.select("at", (F.col("n") - F.col("bases") <= threshold * F.col("n")).alias("good")).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "good"))), lambda x: x["good"]).alias("places"))
    letters = F.filter(F.split("seq", ""), lambda c: c != "")
    kept = F.array_join(F.filter(letters, lambda c, i: F.get("places", i)), "")
    return rows.join(F.broadcast(good)).select("id", kept.alias("seq"))


def on_off(long: DataFrame, a: list[str], b: list[str], cutoff: float = 1.0) -> DataFrame:
    """(row, on_a, on_b, odds, p) of a long matrix (row, column, value): in how many columns of either group a row's
    value is over ``cutoff``, the odds ratio of that (null if its denominator is 0) and Fisher's exact two-sided p."""
    on = lambda g: F.count_if(F.col("column").isin(g) & (F.col("value") > cutoff))
    made = long.groupBy("row").agg(on(a).alias("on_a"), on(b).alias("on_b"))
    x, y = F.col("on_a"), F.col("on_b")
    off_x, off_y = len(a) - x, len(b) - y
    odds = F.try_divide((x * off_y).cast("double"), (off_x * y).cast("double"))
    return made.withColumns({"odds": odds, "p": fisher_p(x, off_x, y, off_y)})


def adapter_trimmed(reads: DataFrame, adapters: list[str], quality: int = 20, least: int = 25) -> DataFrame:
    """(id, seq, qual, length, removed, adapters, mean_quality, kept) of reads (id, seq, qual): cut before the first place of
    each adapter in turn, then of the bases below ``quality`` at their end.

    adapters counts those found, mean_quality is that of what is left (0 of nothing), and kept says whether it has
    ``least`` bases. Case doesn't count; a null quality cuts nothing, and a null sequence is empty. Each read gives a row."""
    low = "".join("\\" + chr(c) if not chr(c).isalnum() else chr(c) for c in range(33, 33 + quality))
    out = reads.select("id", F.upper(F.coalesce("seq", F.lit(""))).alias("seq"), "qual").withColumns({"length": F.length("seq"), "adapters": F.lit(0)})
    for a in adapters:
        at = F.locate(a.upper(), "seq")
        out = out.withColumns({"seq": F.when(at > 0, F.substring("seq", F.lit(1), at - 1)).otherwise(F.col("seq")), "adapters": F.col("adapters") + (at > 0).cast("int")})
    own = F.substring("qual", F.lit(1), F.length("seq"))
    cut = F.coalesce(F.length(F.regexp_extract(own, f"[{low}]*$", 0)), F.lit(0)) if low else F.lit(0)
    out = out.withColumn("_left", F.length("seq") - cut)
    out = out.withColumns({"seq": F.substring("seq", F.lit(1), F.col("_left")), "qual": F.substring("qual", F.lit(1), F.col("_left"))})
    mean = F.when(F.length("qual") > 0, s.mean_quality(F.col("qual"))).otherwise(F.lit(0.0))
    return out.select("id", "seq", "qual", "length", (F.col("length") - F.col("_left")).alias("removed"), "adapters", mean.alias("mean_quality"), (F.col("_left") >= least).alias("kept"))


def primers_trimmed(reads: DataFrame, forward: str = "", reverse: str = "", remove: bool = True) -> DataFrame:
    """(id, status, start, stop, seq) of reads (id, seq): what lies from the first place of the forward primer to the last
    one of the reverse complement of the reverse primer, without the two if ``remove``; half-open, from 0.

    A read without a primer that is asked for is primer_not_found, with -1, -1 and no sequence; others are trimmed, or
    kept without a forward primer. A part that would end before it begins is empty. Null sequences are empty."""
    back = str(reverse).upper()[::-1].translate(str.maketrans("ACGTURYKMBDHV", "TGCAAYRMKVHDB"))
    seq = F.upper(F.coalesce("seq", F.lit("")))
    i = F.locate(forward.upper(), seq) - 1 if forward else F.lit(0)
    behind = F.locate(back[::-1], F.reverse(seq)) if reverse else F.lit(1)
    j = F.when(behind > 0, F.length(seq) - behind + 1 - len(back)).otherwise(-1) if reverse else F.length(seq)
    start = i + len(forward) if remove else i
    stop = j if remove else j + len(back)
    lost = (i < 0) | (j < 0)
    stop = F.greatest(start, F.least(stop, F.length(seq)))
    part = F.substring(seq, (start + 1).cast("int"), (stop - start).cast("int"))
    return reads.select("id", F.when(lost, "primer_not_found").when(F.lit(bool(forward)), "trimmed").otherwise("kept").alias("status"), F.when(lost, -1).otherwise(start).alias("start"), F.when(lost, -1).otherwise(stop).alias("stop"), F.when(~lost, part).alias("seq"))
