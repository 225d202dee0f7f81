"""Operators on genomic intervals: 0-based, half-open (chrom, start, stop, name, score, strand)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.islands import gaps_before, islands
from ..plans.ordinals import running
from ..plans.ranges import overlapping
from ..plans.tiles import KEYS, inside, others, tiled, with_tiles
from .tables import first_of

KEY = ["chrom", "start", "stop"]
_low, _high = F.greatest, F.least


def clip(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({"start": _low("a_start", "b_start"), "stop": _high("a_stop", "b_stop")})


def intersect(a: DataFrame, b: DataFrame, strand: bool = False) -> DataFrame:
    """The shared part of every overlapping pair."""
    return clip(overlapping(a, b, strand=strand)).select(F.col("a_chrom").alias("chrom"), "start", "stop", F.col("a_name").alias("name"), F.col("b_name").alias("b_name"))


def merge(df: DataFrame, distance: int = 0, stranded: bool = False) -> DataFrame:
    """Islands of intervals at most ``distance`` apart: their span, number and greatest score."""
    keys = ["chrom", "strand"] if stranded else ["chrom"]
    found = islands(df, keys, "start", "stop", distance, ["name"])
    return found.groupBy("island", *keys).agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("n"), F.max("score").alias("score")).drop("island")


def cluster(df: DataFrame, distance: int = 0) -> DataFrame:
    """Every interval with the bounds and size of its island."""
    found = islands(df, ["chrom"], "start", "stop", distance, ["name"])
    spans = found.groupBy(F.col("island").alias("_island")).agg(F.min("start").alias("island_start"), F.max("stop").alias("island_stop"), F.count("*").alias("n"))
    return found.join(spans, F.col("island") == F.col("_island")).drop("_island")


def links(df: DataFrame, distance: int = 0) -> DataFrame:
    """Neighbours within an island: each interval and the one before it in the same island. A chain of links holds an
    island together without its square of pairs."""
    found = islands(df, ["chrom"], "start", "stop", distance, ["name"])
    back = gaps_before(found, ["island"], ["start", "stop", "name"], "name", "before")
    return back.where("before is not null").select("chrom", "before", "name")


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """What of each interval of ``a`` no interval of ``b`` covers.

    ``b`` is merged first, so that the pieces beside each a are bounded by consecutive merged intervals.
    """
    flat = merge(b)
    own = [*KEY, "name"]
    each = a.groupBy(*own).agg(F.count("*").alias("times"))  # repeated rows are cut once, and come as often
    hits = overlapping(each, flat.select(*KEY)).select(*[F.col(f"a_{c}").alias(c) for c in [*own, "times"]], F.col("b_start").alias("s"), F.col("b_stop").alias("e"))
    by = Window.partitionBy(*own).orderBy("s")
    beside = hits.withColumns({"_before": F.coalesce(F.lag("e").over(by), F.col("start")), "_last": F.lead("e").over(by).isNull()})
    gaps = F.array(F.struct(F.col("_before").alias("start"), F.col("s").alias("stop")), F.when(F.col("_last"), F.struct(F.col("e").alias("start"), F.col("stop").alias("stop"))))
    cut = beside.withColumn("_g", F.explode(gaps)).where("_g.start < _g.stop").select("chrom", "_g.start", "_g.stop", "name", "times")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in own]
    free = each.join(hits.select(*[F.col(c).alias(f"_{c}") for c in own]).distinct(), same, "left_anti").select(*own, "times")
    return cut.unionAll(free).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times")))).select(*own)


def coverage(a: DataFrame, b: DataFrame) -> DataFrame:
    """For each interval of ``a``: intervals of ``b`` that overlap it, bases that they cover, and their share."""
    each = a.select(*KEY).distinct()  # intervals at the same place are measured once
    here = [F.col(f"a_{c}").alias(f"_{c}") for c in KEY]
    hits = overlapping(each, b.select(*KEY)).groupBy(*here).agg(F.count("*").alias("hits"))
    bases = clip(overlapping(each, merge(b).select(*KEY))).groupBy(*here).agg(F.sum(F.col("stop") - F.col("start")).alias("covered"))
    found = hits.join(bases, [f"_{c}" for c in KEY], "left")
    both = a.join(found, [F.col(c) == F.col(f"_{c}") for c in KEY], "left")
    covered = F.coalesce("covered", F.lit(0))
    return both.select(*KEY, "name", F.coalesce("hits", F.lit(0)).alias("hits"), covered.alias("covered"), (covered / F.greatest(F.col("stop") - F.col("start"), F.lit(1))).alias("fraction"))


def span(df: DataFrame) -> Column:
    return F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0))


def jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bases of both merged sets, their intersection, union and ratio."""
    x, y = merge(a).select(*KEY), merge(b).select(*KEY)
    both = clip(overlapping(x, y)).agg(span(x).alias("intersection"))
    sizes = x.agg(span(x).alias("bases_a")).crossJoin(y.agg(span(y).alias("bases_b"))).crossJoin(both)
    union = F.col("bases_a") + F.col("bases_b") - F.col("intersection")
    return sizes.withColumns({"union": union, "jaccard": F.col("intersection") / F.greatest(union, F.lit(1))})


def complement(df: DataFrame, genome: DataFrame) -> DataFrame:
    """Gaps between merged intervals, up to the size of each chromosome (chrom, size)."""
    flat = merge(df).select(*KEY)
    sizes = genome.select(F.col("chrom").alias("_chrom"), "size")
    ends = genome.select("chrom", F.col("size").alias("start"), F.col("size").alias("stop"))
    inside = flat.join(sizes, F.col("chrom") == F.col("_chrom")).where("start < size").select("chrom", "start", F.least("stop", "size").alias("stop"))
    back = gaps_before(inside.unionAll(ends), ["chrom"], ["start", "stop"], "stop", "before")
    return back.select("chrom", F.coalesce("before", F.lit(0)).alias("start"), F.col("start").alias("stop")).where("start < stop")


def closest(a: DataFrame, b: DataFrame, bodies: DataFrame | None = None) -> DataFrame:
    """The nearest interval of ``b`` on the same chromosome: distance 0 on overlap, else the bases between plus one;
    -1 without any. Ties go to the smallest (start, stop, name). With ``bodies``, ``inside`` tells whether an interval
    overlaps any of these. Each row of ``a`` comes once, whatever its name.

    Starts of ``a`` and stops of the others go along the chromosome by tile. What lies before is the greatest stop up to
    the start. Of the intervals that stop beyond the start, the one that starts first overlaps if any does, else it is
    the nearest behind.
    """
    own = a.select("chrom", F.col("start").cast("long").alias("at"), F.lit(1).alias("side"), F.col("stop").cast("long").alias("far"), "name")
    marks = lambda df, side, name: df.where("chrom is not null and start is not null and stop is not null").select("chrom", F.col("stop").cast("long").alias("at"), F.lit(side).alias("side"), F.col("start").cast("long").alias("far"), name.alias("name"))
    rows = own.unionAll(marks(b, 0, F.col("name")))
    if bodies is not None:
        rows = rows.unionAll(marks(bodies, -1, F.lit(None).cast("string")))
    parts = tiled(rows)
    before = F.min(F.when(F.col("side") == 0, F.struct((-F.col("at")).alias("back"), F.col("far").alias("start"), "name")))
    behind = F.min(F.when(F.col("side") == 0, F.struct(F.col("far").alias("start"), F.col("at").alias("stop"), "name")))
    body = F.min(F.when(F.col("side") == -1, F.col("far")))
    ahead, back = inside("at", "side"), inside(F.desc("at"), F.desc("side"))
    here = parts.withColumn("_before", before.over(ahead)).withColumns({"_behind": behind.over(back), "_body": body.over(back)}).where("side = 1")
    sums = parts.groupBy(*KEYS).agg(before.alias("b"), behind.alias("f"), body.alias("i"))
    carried = sums.select(*KEYS, F.min("b").over(others()).alias("_b"), F.min("f").over(others(back=True)).alias("_f"), F.min("i").over(others(back=True)).alias("_i"))
    both = with_tiles(here, carried).withColumns({"_before": F.least("_before", "_b"), "_behind": F.least("_behind", "_f"), "_body": F.least("_body", "_i")})
    near = lambda distance, x, stop: F.when(x.isNotNull() & distance.isNotNull(), F.struct(distance.alias("distance"), x["start"].alias("start"), stop.alias("stop"), x["name"].alias("name")))
    x, y = F.col("_before"), F.col("_behind")
    first = near(F.col("at") + x["back"] + 1, x, -x["back"])
    second = near(F.when(y["start"] < F.col("far"), F.lit(0).cast("long")).otherwise(y["start"] - F.col("far") + 1), y, y["stop"])
    found = both.withColumn("_near", F.least(first, second))
    columns = [] if bodies is None else [F.coalesce(F.col("_body") < F.col("far"), F.lit(False)).alias("inside")]
    return found.select("chrom", F.col("at").alias("start"), F.col("far").alias("stop"), "name", F.coalesce("_near.distance", F.lit(-1)).alias("distance"), F.col("_near.start").alias("b_start"), F.col("_near.stop").alias("b_stop"), F.col("_near.name").alias("b_name"), *columns)


def slop(df: DataFrame, bp: int = 100, fraction: float = 0.0, direction: str = "both", genome: DataFrame | None = None) -> DataFrame:
    """Intervals widened by bases or a fraction of their length, kept within their chromosome."""
    by = F.lit(bp) if not fraction else F.floor((F.col("stop") - F.col("start")) * fraction).cast("long")
    made = df.withColumns({"start": F.greatest(F.lit(0), F.col("start") - (by if direction != "right" else 0)), "stop": F.col("stop") + (by if direction != "left" else 0)})
    if genome is None:
        return made
    sizes = genome.select(F.col("chrom").alias("_chrom"), "size")
    return made.join(sizes, F.col("chrom") == F.col("_chrom"), "left").withColumn("stop", F.least("stop", "size")).drop("_chrom", "size")


def flank(df: DataFrame, left: int = 100, right: int = 100) -> DataFrame:
    """The regions beside each interval (left, right)."""
    sides = F.array(F.struct(F.greatest(F.lit(0), F.col("start") - left).alias("start"), F.col("start").alias("stop"), F.lit("left").alias("side")), F.struct(F.col("stop").alias("start"), (F.col("stop") + right).alias("stop"), F.lit("right").alias("side")))
    return df.withColumn("_x", F.explode(sides)).select("chrom", "_x.start", "_x.stop", "name", "_x.side").where("start < stop")


def shift(df: DataFrame, by: int = 100, stranded: bool = True) -> DataFrame:
    """Intervals moved, against the strand's direction if stranded, not below 0."""
    step = F.when(F.col("strand") == "-", -by).otherwise(by) if stranded else F.lit(by)
    return df.withColumns({"start": F.greatest(F.lit(0), F.col("start") + step), "stop": F.greatest(F.lit(0), F.col("stop") + step)})


def scale(df: DataFrame, genome: DataFrame, factor: float = 1.5) -> DataFrame:
    """Intervals resized around their midpoint and clipped to the chromosome."""
    middle, half = (F.col("start") + F.col("stop")) / 2, (F.col("stop") - F.col("start")) * factor / 2
    sizes = genome.select(F.col("chrom").alias("_chrom"), "size")
    made = df.join(F.broadcast(sizes), F.col("chrom") == F.col("_chrom"), "left")
    return made.withColumns({"start": F.greatest(F.lit(0), F.floor(middle - half)).cast("long"), "stop": F.least(F.coalesce("size", F.lit(1 << 60)), F.floor(middle + half)).cast("long")}).drop("_chrom", "size")


def relocated(df: DataFrame, genome: DataFrame, key: list[str], seed: int = 42) -> DataFrame:
    """Intervals at seeded places of their chromosome, lengths kept."""
    sizes = genome.select(F.col("chrom").alias("_chrom"), "size")
    length = F.col("stop") - F.col("start")
    at = F.pmod(F.xxhash64(F.lit(seed), *key), F.greatest(F.col("size") - length + 1, F.lit(1)))
    return df.join(F.broadcast(sizes), F.col("chrom") == F.col("_chrom")).withColumn("_n", length).withColumn("start", at).withColumn("stop", F.col("start") + F.col("_n")).drop("_n", "_chrom", "size")


def random_intervals(genome: DataFrame, n: int = 10, length: int = 200, seed: int = 1) -> DataFrame:
    """n seeded intervals a chromosome."""
    drawn = genome.select("chrom", "size", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("i"))
    at = F.pmod(F.xxhash64(F.lit(seed), "chrom", "i"), F.greatest(F.col("size") - length + 1, F.lit(1)))
    return drawn.select("chrom", at.alias("start"), F.least(at + length, F.col("size")).alias("stop"))


def binnify(genome: DataFrame, size: int = 1000) -> DataFrame:
    made = genome.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(size).cast("long"))))
    return made.select("chrom", "start", F.least(F.col("start") + size, F.col("size")).alias("stop"))


def tidy(df: DataFrame) -> DataFrame:
    """Coordinates in order and not below 0."""
    return df.withColumns({"start": F.greatest(F.lit(0), F.least("start", "stop")), "stop": F.greatest(F.lit(0), F.greatest("start", "stop"))})


def negative(a: DataFrame, b: DataFrame) -> DataFrame:
    """Intervals of ``a`` that aren't, as they are, a shared part of some pair."""
    parts = clip(overlapping(a, b)).select(F.col("a_chrom").alias("_c"), F.col("start").alias("_s"), F.col("stop").alias("_e")).distinct()
    return a.join(parts, (F.col("chrom") == F.col("_c")) & (F.col("start") == F.col("_s")) & (F.col("stop") == F.col("_e")), "left_anti")


def overlap_totals(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs, bases shared by pairs, and bases of the merged shared parts."""
    parts = intersect(a, b)
    whole = parts.agg(F.count("*").alias("pairs"), span(parts).alias("pair_bases"))
    flat = merge(parts.withColumn("score", F.lit(0)))
    return whole.crossJoin(flat.agg(span(flat).alias("merged_bases")))


def depth_segments(df: DataFrame) -> DataFrame:
    """(chrom, start, stop, depth): elementary segments of positive depth, from +1 and -1 events summed by place, then in
    one ordered pass by tile."""
    own = df.select("chrom", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop")).where("chrom is not null and start is not null and stop is not null")
    events = own.select("chrom", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("stop").alias("at"), F.lit(-1).alias("d")))).alias("x"))
    steps = tiled(events.groupBy("chrom", F.col("x.at").alias("at")).agg(F.sum("x.d").alias("d")))
    here = steps.withColumns({"_own": F.sum("d").over(inside("at")), "_next": F.lead("at").over(Window.partitionBy(*KEYS).orderBy("at"))})
    sums = steps.groupBy(*KEYS).agg(F.sum("d").alias("d"), F.min("at").alias("first"))
    carried = sums.select(*KEYS, F.sum("d").over(others()).alias("_before"), F.lead("first").over(Window.partitionBy("chrom").orderBy("tile")).alias("_following"))
    deep = with_tiles(here, carried).withColumns({"depth": F.col("_own") + F.coalesce("_before", F.lit(0)), "next": F.coalesce("_next", "_following")})
    return deep.where("depth > 0 and next is not null").select("chrom", F.col("at").alias("start"), F.col("next").alias("stop"), "depth")


def depth_by_place(df: DataFrame) -> DataFrame:
    """(chrom, at, depth): the places that intervals cover, from segments of equal depth; no row for each place of each
    interval."""
    return depth_segments(df).select("chrom", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("at"), "depth")


def rebinned(df: DataFrame, size: int = 1000, value: str = "value") -> DataFrame:
    """(chrom, start, covered, mean, low, high): a track in fixed bins, weighted by overlapped bases."""
    bins = F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("stop") - 1) / size)))
    cut = df.where("start < stop").withColumn("_bin", bins)
    n = F.least("stop", (F.col("_bin") + 1) * size) - F.greatest("start", F.col("_bin") * size)
    v = F.col(value)
    return cut.withColumn("_n", n).groupBy("chrom", (F.col("_bin") * size).alias("start")).agg(F.sum("_n").alias("covered"), (F.sum(v * F.col("_n")) / F.sum("_n")).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"))


def mean_depth(df: DataFrame, size: int = 500, value: str = "value") -> DataFrame:
    """(chrom, start, depth): summed value times bases over the width of the bin."""
    return rebinned(df, size, value).select("chrom", "start", (F.col("mean") * F.col("covered") / size).alias("depth"))


def length_summary(df: DataFrame) -> DataFrame:
    """Per chromosome: intervals, bases, least, mean and greatest length."""
    n = F.col("stop") - F.col("start")
    return df.groupBy("chrom").agg(F.count("*").alias("n"), F.sum(n).alias("bases"), F.min(n).alias("shortest"), F.avg(n).alias("mean"), F.max(n).alias("longest"))


def window_counts(df: DataFrame, size: int = 1000) -> DataFrame:
    """Intervals that begin in each fixed window."""
    return df.groupBy("chrom", (F.floor(F.col("start") / size) * size).alias("start")).agg(F.count("*").alias("n"))


def touch_counts(df: DataFrame, size: int = 1000) -> DataFrame:
    """Intervals that touch each fixed bin."""
    bins = F.explode(F.sequence(F.floor(F.col("start") / size), F.greatest(F.floor(F.col("start") / size), F.floor((F.col("stop") - 1) / size))))
    return df.withColumn("_bin", bins).groupBy("chrom", (F.col("_bin") * size).alias("start")).agg(F.count("*").alias("n"))


def blacklisted(df: DataFrame, black: DataFrame, most: float = 0.5) -> DataFrame:
    """Intervals of which at most a share is covered by the list."""
    return coverage(df, black).where(F.col("fraction") <= most).select(*KEY, "name")


def counts_by_name(a: DataFrame, b: DataFrame) -> DataFrame:
    """Overlaps of each name, none included."""
    hits = overlapping(a, b).groupBy(F.col("a_name").alias("_name")).agg(F.count("*").alias("_n"))
    return a.select("name").distinct().join(hits, F.col("name") == F.col("_name"), "left").select("name", F.coalesce("_n", F.lit(0)).alias("n"))


def promoters(df: DataFrame, upstream: int = 1000, downstream: int = 1000) -> DataFrame:
    """Windows around each start of transcription: the first base on the strand."""
    tss = F.when(F.col("strand") == "-", F.col("stop") - 1).otherwise(F.col("start"))
    up, down = F.when(F.col("strand") == "-", downstream).otherwise(upstream), F.when(F.col("strand") == "-", upstream).otherwise(downstream)
    return df.select("chrom", F.greatest(F.lit(0), tss - up).alias("start"), (tss + down).alias("stop"), "name", "strand")


def metagene(df: DataFrame, genes: DataFrame, size: int = 100, around: int = 2000) -> DataFrame:
    """(bin, n): midpoints by signed distance from each gene's first base."""
    tss = F.when(F.col("strand") == "-", F.col("stop") - 1).otherwise(F.col("start"))
    at = genes.select("chrom", tss.alias("start"), (tss + 1).alias("stop"), "strand")
    middle = F.floor((F.col("start") + F.col("stop")) / 2)
    mids = df.select("chrom", middle.alias("start"), (middle + 1).alias("stop"))
    near = overlapping(at, mids, slack=around)
    far = (F.col("b_start") - F.col("a_start")) * F.when(F.col("a_strand") == "-", -1).otherwise(1)
    return near.groupBy((F.floor(far / size) * size).alias("bin")).agg(F.count("*").alias("n"))


def lifted(df: DataFrame, chains: DataFrame) -> DataFrame:
    """Coordinates moved by the first chain (chrom, t_start, t_stop, offset) that holds the start; others unchanged,
    with ``lifted`` false."""
    c = chains.select(F.col("chrom").alias("_c"), "t_start", "t_stop", "offset")
    hit = (F.col("chrom") == F.col("_c")) & (F.col("start") >= F.col("t_start")) & (F.col("start") < F.col("t_stop"))
    rows = df.withColumn("_id", F.struct(*df.columns))
    best = rows.join(F.broadcast(c), hit).groupBy("_id").agg(F.min_by("offset", "t_start").alias("offset")).withColumnRenamed("_id", "_hit")
    both = rows.join(best, F.col("_id").eqNullSafe(F.col("_hit")), "left")
    by = F.coalesce("offset", F.lit(0))
    return both.select("chrom", (F.col("start") + by).alias("start"), (F.col("stop") + by).alias("stop"), "name", F.col("offset").isNotNull().alias("lifted"))


def first_lines(df: DataFrame) -> DataFrame:
    """One interval of equal coordinates, the first by name."""
    return first_of(df, KEY, ["name"])


def n50(df: DataFrame) -> DataFrame:
    """Total length, and the length at which half of it is reached, longest first."""
    n = df.select((F.col("stop") - F.col("start")).alias("n")).groupBy("n").agg(F.sum("n").alias("bases"))
    total = n.agg(F.sum("bases").alias("total"))
    reached = n.crossJoin(F.broadcast(total)).withColumn("so_far", F.sum("bases").over(Window.orderBy(F.desc("n"))))  # as many rows as there are lengths
    return reached.where(F.col("so_far") >= F.col("total") / 2).agg(F.max("total").alias("total"), F.max("n").alias("n50"))


def without_overlaps(df: DataFrame) -> DataFrame:
    """Greedy selection by stop: the most intervals that don't overlap. Islands are independent of each other; each
    task streams through whole islands in order of their stops, and holds no more than the last stop kept."""
    found = islands(df, ["chrom"], "start", "stop", -1, ["name"]).select("island", *KEY, "name")

    def scan(frames):
        island, last = None, -1
        for frame in frames:
            kept = []
            for i, (own, s, e) in enumerate(zip(frame.island.tolist(), frame.start.tolist(), frame.stop.tolist(), strict=True)):
                if own != island:
                    island, last = own, -1
                if s >= last:
                    kept.append(i)
                    last = e
            yield frame.iloc[kept]

    return found.repartition("island").sortWithinPartitions("island", "stop", "start", "name").mapInPandas(scan, found.schema).drop("island")


def pair_distances(a: DataFrame, b: DataFrame, window: int) -> DataFrame:
    """Signed distances of all pairs within a window: 0 on overlap, negative where b lies before a."""
    near = overlapping(a, b, slack=window)
    d = F.when(F.col("b_stop") <= F.col("a_start"), F.col("b_stop") - F.col("a_start") - 1).when(F.col("b_start") >= F.col("a_stop"), F.col("b_start") - F.col("a_stop") + 1).otherwise(0)
    return near.select("a_name", "b_name", d.cast("long").alias("distance"))


def segments(named: dict[str, DataFrame]) -> DataFrame:
    """(chrom, start, stop, depth of each file): elementary segments over the breakpoints of several files."""
    parts = None
    for name, df in named.items():
        flat = merge(df)
        for at, d in (("start", 1), ("stop", -1)):
            one = flat.select("chrom", F.col(at).alias("at"), *[F.lit(d if n == name else 0).alias(n) for n in named])
            parts = one if parts is None else parts.unionAll(one)
    steps = parts.groupBy("chrom", "at").agg(*[F.sum(n).alias(n) for n in named])
    for n in named:
        steps = running(steps, ["chrom", "at"], n, f"in_{n}").drop(n)
    ahead = gaps_before(steps.withColumn("_back", -F.col("at")), ["chrom"], ["_back"], "at", "next")
    inside = sum((F.col(f"in_{n}") for n in named), F.lit(0))
    return ahead.where((inside > 0) & F.col("next").isNotNull()).select("chrom", F.col("at").alias("start"), F.col("next").alias("stop"), *[F.col(f"in_{n}").alias(n) for n in named])
