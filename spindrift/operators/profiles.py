"""Signal over regions: each region cut into bins along its strand, the mean of a track in every bin, and their profile."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordinals import materialized
from ..plans.tiles import KEYS, TILE

#: Edges of bins that a task holds at once.
HELD = 1 << 18
_PARTS = "region long, name string, low long, high long, first int, n int, back boolean, at int, sums array<double>"


def _spans(regions: DataFrame, bins: int, upstream: int, downstream: int, flank_bins: int) -> DataFrame:
    """(region, name, chrom, back, low, high, first, n): each region, numbered, and its flanks on the region's strand, to be
    cut into n pieces from bin ``first`` on."""
    own = materialized(regions.select(F.monotonically_increasing_id().alias("region"), "name", "chrom", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), (F.coalesce("strand", F.lit(".")) == "-").alias("back")))
    parts = own.select("region", "name", "chrom", "back", F.col("start").alias("low"), F.col("stop").alias("high"), F.lit(0).alias("first"), F.lit(bins).alias("n"))
    if flank_bins:
        before = (F.when(F.col("back"), F.col("stop")).otherwise(F.col("start") - upstream), F.when(F.col("back"), F.col("stop") + upstream).otherwise(F.col("start")))
        behind = (F.when(F.col("back"), F.col("start") - downstream).otherwise(F.col("stop")), F.when(F.col("back"), F.col("start")).otherwise(F.col("stop") + downstream))
        for first, (low, high) in ((-flank_bins, before), (bins, behind)):
            parts = parts.unionAll(own.select("region", "name", "chrom", "back", low.alias("low"), high.alias("high"), F.lit(first), F.lit(flank_bins)))
    return parts.where(F.col("high") > F.greatest("low", F.lit(0)))


def _cut(i: Column) -> Column:
    return F.greatest(F.col("low") + F.floor(i * (F.col("high") - F.col("low")) / F.col("n")), F.lit(0))


def _pieces(parts: DataFrame) -> DataFrame:
    """(region, name, bin, size, sum) of rows with ``sums`` of the pieces from number ``at`` on; pieces without a base are left out."""
    each = parts.select("*", F.posexplode("sums").alias("_k", "sum")).withColumn("_i", F.col("at") + F.col("_k"))
    bin = F.col("first") + F.when(F.col("back"), F.col("n") - 1 - F.col("_i")).otherwise(F.col("_i"))
    return each.select("region", "name", bin.cast("int").alias("bin"), (_cut(F.col("_i") + 1) - _cut(F.col("_i"))).alias("size"), "sum").where("size > 0")


class _Tile:
    """The running sums of a track along one tile, by place from its start on."""

    def __init__(self):
        self.steps: dict[str, np.ndarray] = {}
        self.sums: dict[str, np.ndarray] | None = None

    def add(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> None:
        finite = np.isfinite(value)
        kinds = {"value": np.where(finite, value, 0.0), "n": np.ones(len(value))}
        if not finite.all():
            kinds |= {"nan": np.isnan(value) * 1.0, "up": (value == np.inf) * 1.0, "down": (value == -np.inf) * 1.0}
        for kind, x in kinds.items():
            own = self.steps.setdefault(kind, np.zeros((1 << TILE) + 1))
            own += np.bincount(low, x, len(own)) - np.bincount(high, x, len(own))

    def between(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The sums over the places from ``low`` to below ``high``; exactly 0 where no segment lies."""
        if self.sums is None:
            depth = {kind: np.cumsum(x[:-1]) for kind, x in self.steps.items()}
            if depth:
                depth["value"][depth["n"] == 0] = 0.0
            self.sums = {kind: np.concatenate([[0.0], np.cumsum(x)]) for kind, x in depth.items()}
        if not self.sums:
            return np.zeros(low.shape)
        found = {kind: x[high] - x[low] for kind, x in self.sums.items()}
        made = np.where(found["n"] > 0, found["value"], 0.0)
        if "nan" in found:
            made = np.where(found["up"] > 0, np.inf, np.where(found["down"] > 0, -np.inf, made))
            made = np.where((found["nan"] > 0) | ((found["up"] > 0) & (found["down"] > 0)), np.nan, made)
        return made


def _summed(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Sums of the pieces of spans in a tile, from rows sorted by tile, segments first; of spans that lie in one tile, or
    of all others."""
    now, held = None, _Tile()
    for batch in batches:
        if not batch.num_rows:
            continue
        chrom, tile = batch.column("chrom"), batch.column("tile").to_numpy(zero_copy_only=False)
        segment = batch.column("n").is_null().to_numpy(zero_copy_only=False)
        marks = (chrom.dictionary_encode("encode").indices.to_numpy(), tile, segment)
        edges = [0, *(np.flatnonzero(np.any([x[1:] != x[:-1] for x in marks], axis=0)) + 1).tolist(), len(tile)]
        for a, b in zip(edges, edges[1:], strict=False):
            if (chrom[a].as_py(), tile[a]) != now:
                now, held = (chrom[a].as_py(), tile[a]), _Tile()
            base, own = int(tile[a]) << TILE, batch.slice(a, b - a)
            low, high = (own.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("low", "high"))
            if segment[a]:
                held.add(np.maximum(low - base, 0), np.minimum(high - base, 1 << TILE), own.column("value").to_numpy(zero_copy_only=False))
                continue
            inside = (np.maximum(low, 0) >> TILE) == ((high - 1) >> TILE)
            n = own.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
            for size in np.unique(n).tolist():
                chosen = np.flatnonzero((n == size) & (inside == whole))
                step = max(1, HELD // (size + 1))
                for at in range(0, len(chosen), step):
                    rows = chosen[at : at + step]
                    cuts = low[rows][:, None] + np.arange(size + 1) * (high[rows] - low[rows])[:, None] // size
                    cuts = np.clip(cuts - base, 0, 1 << TILE) if base else np.clip(cuts, 0, 1 << TILE)
                    sums = held.between(cuts[:, :-1], cuts[:, 1:])
                    full = cuts[:, 1:] > cuts[:, :-1]
                    first, last = full.argmax(1), size - full[:, ::-1].argmax(1)
                    kept = (np.arange(size) >= first[:, None]) & (np.arange(size) < last[:, None])
                    taken = own.take(pa.array(rows))
                    lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(last - first)]).astype(np.int32), sums[kept])
                    columns = [taken.column(c) for c in ("region", "name", "low", "high", "first", "n", "back")]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(first, pa.int32()), lists], names=["region", "name", "low", "high", "first", "n", "back", "at", "sums"])


def region_matrix(track: DataFrame, regions: DataFrame, bins: int = 50, upstream: int = 0, downstream: int = 0, flank_bins: int = 0) -> DataFrame:
    """(region, name, bin, value): the mean over the bases of each bin of a track (chrom, start, stop, value), whose segments
    add up where they overlap; bases without one count 0.

    Regions (chrom, start, stop, name, strand) are numbered and cut into ``bins`` pieces as equal as whole bases allow, bin 0
    first on the region's strand; negative bins lie upstream and bins from ``bins`` on downstream, in ``flank_bins`` pieces of
    each flank. Pieces without a base, or before the chromosome, are left out. Names may be missing or repeat.

    Segments and whole regions meet in one exchange by tile of the chromosome, and are cut there from running sums of the
    tile; only regions that reach into several tiles have their bins added up again. A task holds one tile's sums."""
    spans = _spans(regions, bins, upstream, downstream, flank_bins)
    reach = lambda low, high: F.explode(F.sequence(F.shiftright(low, TILE), F.shiftright(high - 1, TILE))).alias("tile")
    segments = track.select("chrom", F.col("start").cast("long").alias("low"), F.col("stop").cast("long").alias("high"), F.col("value").cast("double").alias("value"))
    segments = segments.where("chrom IS NOT NULL AND value IS NOT NULL AND high > greatest(low, 0)").withColumn("low", F.greatest("low", F.lit(0)))
    rows = spans.select("chrom", reach(F.greatest("low", F.lit(0)), F.col("high")), "region", "name", "low", "high", "first", "n", "back")
    both = rows.unionByName(segments.select("chrom", reach(F.col("low"), F.col("high")), "low", "high", "value"), allowMissingColumns=True)
    dealt = both.repartition(*KEYS).sortWithinPartitions(*KEYS, F.col("n").isNotNull())
    inside = _pieces(dealt.mapInArrow(lambda batches: _summed(batches, True), _PARTS))
    across = _pieces(dealt.mapInArrow(lambda batches: _summed(batches, False), _PARTS)).groupBy("region", "bin").agg(F.first("name").alias("name"), F.first("size").alias("size"), F.sum("sum").alias("sum"))
    return inside.unionByName(across).select("region", "name", "bin", (F.col("sum") / F.col("size")).alias("value"))


def profile(matrix: DataFrame) -> DataFrame:
    """(bin, n, mean, sem): over all regions with the bin; sem is null for one region."""
    made = matrix.groupBy("bin").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    return made.select("bin", "n", "mean", (F.col("sd") / F.sqrt("n")).alias("sem"))


def body_coverage(matrix: DataFrame) -> DataFrame:
    """(bin, total, share): the summed means of each bin, and the part of the greatest one."""
    sums = materialized(matrix.groupBy("bin").agg(F.sum("value").alias("total")))
    most = sums.agg(F.max("total").alias("_most"))
    return sums.crossJoin(F.broadcast(most)).select("bin", "total", (F.col("total") / F.nullif("_most", F.lit(0.0))).alias("share"))
