"""Operators of ecology, proteomics, chemistry, pharmacology, geography and climate on long tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.pvalues import log_gamma
from ..plans.islands import islands

#: Monoisotopic residue masses, and pK values of ionisable groups.
MASS = {
    "G": 57.02146, "A": 71.03711, "S": 87.03203, "P": 97.05276, "V": 99.06841, "T": 101.04768, "C": 103.00919, "L": 113.08406, "I": 113.08406, "N": 114.04293,
    "D": 115.02694, "Q": 128.05858, "K": 128.09496, "E": 129.04259, "M": 131.04049, "H": 137.05891, "F": 147.06841, "R": 156.10111, "Y": 163.06333, "W": 186.07931,
}
WATER, PROTON = 18.010565, 1.007276
#: Kyte-Doolittle hydropathy.
HYDROPATHY = {"I": 4.5, "V": 4.2, "L": 3.8, "F": 2.8, "C": 2.5, "M": 1.9, "A": 1.8, "G": -0.4, "T": -0.7, "S": -0.8, "W": -0.9, "Y": -1.3, "P": -1.6, "H": -3.2, "E": -3.5, "Q": -3.5, "D": -3.5, "N": -3.5, "K": -3.9, "R": -4.5}
EARTH_KM = 6371.0088


def residue_sum(seq: Column, table: dict[str, float]) -> Column:
    """Sum of a value over residues, by counts of letters."""
    total = F.lit(0.0)
    for letter, value in table.items():
        total = total + F.regexp_count(seq, F.lit(letter)) * F.lit(value)
    return total


def peptide_mass(seq: Column) -> Column:
    return residue_sum(seq, MASS) + F.lit(WATER)


def digested(df: DataFrame, id: str, seq: str, cut: str = "(?<=[KR])(?!P)", missed: int = 0) -> DataFrame:
    """(id, peptide, missed): all spans of up to ``missed`` + 1 pieces between cuts."""
    pieces = F.filter(F.split(F.col(seq), cut), lambda x: x != "")
    own = df.select(id, pieces.alias("_p"))
    spans = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(missed)), lambda k: F.transform(F.when(F.size("_p") > k, F.sequence(F.lit(0), F.size("_p") - 1 - k)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.array_join(F.slice(F.col("_p"), i + 1, k + 1), "").alias("peptide"), k.alias("missed")))))
    return own.select(id, F.explode(spans).alias("x")).select(id, "x.peptide", F.col("x.missed").cast("long").alias("missed"))


def alpha_diversity(long: DataFrame, sample: str = "column", value: str = "value") -> DataFrame:
    """Richness, Shannon (nats), Simpson, evenness and Chao1 of each sample."""
    v = F.col(value)
    total = long.groupBy(F.col(sample).alias("_s")).agg(F.sum(v).alias("_n"))
    p = v / F.col("_n")
    g = long.where(v > 0).join(F.broadcast(total), F.col(sample) == F.col("_s")).groupBy(sample).agg(
        F.count("*").alias("richness"), F.sum(-p * F.log(p)).alias("shannon"), (1 - F.sum(p * p)).alias("simpson"), F.sum((v == 1).cast("long")).alias("f1"), F.sum((v == 2).cast("long")).alias("f2")
    )
    return g.select(sample, "richness", "shannon", "simpson", (F.col("shannon") / F.nullif(F.log("richness"), F.lit(0.0))).alias("evenness"), (F.col("richness") + F.col("f1") * (F.col("f1") - 1) / (2 * (F.col("f2") + 1))).alias("chao1"))


def beta_diversity(long: DataFrame, row: str = "row", sample: str = "column", value: str = "value") -> DataFrame:
    """Bray-Curtis and Jaccard dissimilarity of sample pairs; samples are few beside features."""
    a = long.select(F.col(row).alias("r"), F.col(sample).alias("a"), F.col(value).alias("x"))
    b = long.select(F.col(row).alias("r"), F.col(sample).alias("b"), F.col(value).alias("y"))
    both = F.sum(((F.col("x") > 0) & (F.col("y") > 0)).cast("long"))
    either = F.sum(((F.col("x") > 0) | (F.col("y") > 0)).cast("long"))
    return a.join(b, "r").where("a < b").groupBy("a", "b").agg((F.sum(F.abs(F.col("x") - F.col("y"))) / F.sum(F.col("x") + F.col("y"))).alias("bray_curtis"), (1 - both / either).alias("jaccard"))


def at_rank(df: DataFrame, lineage: str, rank: str, value: Column | None = None) -> DataFrame:
    """(taxon, n): totals at a rank (k, p, c, o, f, g, s) of lineages like k__a;p__b; unranked rows are unclassified."""
    found = F.get(F.filter(F.split(F.col(lineage), ";"), lambda x: F.trim(x).startswith(f"{rank}__")), 0)
    name = F.coalesce(F.nullif(F.regexp_replace(F.trim(found), "^[a-z]__", ""), F.lit("")), F.lit("unclassified"))
    return df.groupBy(name.alias("taxon")).agg((F.count("*") if value is None else F.sum(value)).alias("n"))


def rank_report(df: DataFrame, lineage: str) -> DataFrame:
    """(rank, taxon, n, percent) at every rank."""
    total = df.agg(F.count("*").alias("_all"))
    each = df.select(F.explode(F.split(F.col(lineage), ";")).alias("x")).groupBy(F.substring("x", 1, 1).alias("rank"), F.substring("x", 4, 1 << 20).alias("taxon")).agg(F.count("*").alias("n"))
    return each.crossJoin(F.broadcast(total)).select("rank", "taxon", "n", (100 * F.col("n") / F.col("_all")).alias("percent"))


def lowest_common(df: DataFrame, by: str, lineage: str) -> DataFrame:
    """(by, lineage): the ranks that all rows of a group share from the root. Prefixes are counted, so no group's
    lineages are gathered."""
    parts = F.split(F.col(lineage), ";")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), ";"))
    counted = df.select(by, F.posexplode(prefixes).alias("depth", "prefix")).groupBy(by, "depth", "prefix").agg(F.count("*").alias("n"))
    size = df.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_n"))
    whole = counted.join(size, F.col(by) == F.col("_by")).where("n = _n").groupBy(by).agg(F.max_by("prefix", "depth").alias("lineage"))
    return size.join(whole, F.col("_by") == F.col(by), "left").select(F.col("_by").alias(by), F.coalesce("lineage", F.lit("root")).alias("lineage"))


def decoy_fdr(df: DataFrame, score: str, decoy: Column) -> DataFrame:
    """(score, targets, decoys, fdr) at every distinct score, best first."""
    from ..plans.ordinals import running

    own = df.groupBy(F.col(score).alias("score")).agg(F.sum((~decoy).cast("long")).alias("t"), F.sum(decoy.cast("long")).alias("d")).withColumn("_back", -F.col("score"))
    upto = running(running(own, ["_back"], "t", "targets"), ["_back"], "d", "decoys")
    return upto.select("score", "targets", "decoys", F.least(F.lit(1.0), F.col("decoys") / F.greatest(F.col("targets"), F.lit(1))).alias("fdr"))


def protein_quant(df: DataFrame, protein: str, peptide: str, intensity: str) -> DataFrame:
    """Peptides, those of one protein only, and intensity by protein."""
    pairs = df.groupBy(F.col(protein).alias("protein"), F.col(peptide).alias("peptide")).agg(F.sum(intensity).alias("x"))
    owners = pairs.groupBy(F.col("peptide").alias("_p")).agg(F.count("*").alias("k"))
    return pairs.join(owners, F.col("peptide") == F.col("_p")).groupBy("protein").agg(F.count("*").alias("peptides"), F.sum((F.col("k") == 1).cast("long")).alias("unique_peptides"), F.sum("x").alias("intensity"))


def trapezoid(df: DataFrame, by: str, time: str, value: str) -> DataFrame:
    """(by, n, peak, peak_time, auc): linear trapezoids between consecutive times of each group."""
    w = Window.partitionBy(by).orderBy(time, value)
    steps = df.withColumns({"_t": F.lag(time).over(w), "_v": F.lag(value).over(w)})
    area = (F.col(time) - F.col("_t")) * (F.col(value) + F.col("_v")) / 2
    return steps.groupBy(by).agg(F.count("*").alias("n"), F.max(value).alias("peak"), F.max_by(time, value).alias("peak_time"), F.coalesce(F.sum(area), F.lit(0.0)).alias("auc"))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


#: Points of a slice of a cell, in the mean.
SLICE = 8192
#: Points of a block of all pairs, in the mean.
BLOCK = 1024


def on_sphere(points: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """``points`` with their place on the unit sphere, as x, y and z; those without a place are left out."""
    la, lo = F.radians(lat), F.radians(lon)
    made = points.withColumns({"x": F.cos(la) * F.cos(lo), "y": F.cos(la) * F.sin(lo), "z": F.sin(la)})
    return made.where(F.col("x").isNotNull() & ~F.isnan("x") & ~F.isnan("z"))


def chord(km: float) -> float:
    """The straight line between points of the unit sphere that are ``km`` apart on the globe, with room for rounding."""
    return 2 * math.sin(min(km / EARTH_KM, math.pi) / 2) + 1e-9


def cubes(edge: float, all_sides: bool) -> tuple[Column, Column]:
    """The cube of that edge that holds (x, y, z), and those beside it with itself: all, or itself and the half that comes
    after it in order, so that each two neighbours meet once."""
    at = [F.floor(F.col(c) / edge) for c in "xyz"]
    steps = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if all_sides or (i, j, k) >= (0, 0, 0)]
    cube = lambda d: F.struct(*[(a + i).alias(c) for a, i, c in zip(at, d, "xyz", strict=True)])
    return cube((0, 0, 0)), F.array(*[cube(d) for d in steps])


def neighbours_within(points: DataFrame, km: float) -> DataFrame:
    """(a, b, km): pairs of points (id, lat, lon) within a distance, a < b: filed in cubes as wide as that, each joined with
    those beside it; no pair of all. One side of a cube is dealt to slices, as many as the points ask for, so that a
    task holds a bounded part of a crowded cube's pairs. One count runs while this is called."""
    edge = chord(km)
    here, beside = cubes(edge, False)
    own = on_sphere(points.select("id", "lat", "lon"))
    slices = 1 + points.count() // SLICE
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")) * min(slices, 8)
    side = lambda n: [F.col(c).alias(f"{c}{n}") for c in ("id", "lat", "lon", "x", "y", "z")]
    # a number of partitions is given, as few rows make many pairs: partitions are not to be put together by their size
    a = own.select(*side(1), here.alias("home"), F.explode(beside).alias("cube"), F.pmod(F.xxhash64("id"), F.lit(slices)).alias("slice")).repartition(tasks, "cube", "slice")
    b = own.select(*side(2), here.alias("_cube"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("_slice")).repartition(tasks, "_cube", "_slice")
    apart = sum(((F.col(f"{c}1") - F.col(f"{c}2")) * (F.col(f"{c}1") - F.col(f"{c}2")) for c in "xyz"), F.lit(0.0))
    met = a.hint("merge").join(b, (F.col("cube") == F.col("_cube")) & (F.col("slice") == F.col("_slice")) & (apart <= edge * edge) & F.when(F.col("home") == F.col("cube"), F.col("id1") < F.col("id2")).otherwise(F.col("id1") != F.col("id2")))
    found = met.withColumn("km", haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))).where(F.col("km") <= km)
    return found.select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b"), "km")


def all_distances(points: DataFrame) -> DataFrame:
    """(a, b, km): all pairs of points (id, lat, lon), a < b; points without a place are left out. Points are dealt to blocks,
    and each two blocks meet in one cell of at most some BLOCK * BLOCK pairs. One count runs while this is called."""
    own = on_sphere(points.select("id", "lat", "lon")).drop("x", "y", "z")
    blocks = 1 + points.count() // BLOCK
    cells = min(blocks * (blocks + 1) // 2, 64 * int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    block, all_blocks = F.pmod(F.xxhash64("id"), F.lit(blocks)), F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))
    side = lambda n, other: own.select(*[F.col(c).alias(f"{c}{n}") for c in ("id", "lat", "lon")], block.alias(f"block{n}"), F.explode(other).alias(f"other{n}")).repartition(cells, *[f"{c}{n}" for c in (("block", "other") if n == 1 else ("other", "block"))])
    a, b = side(1, F.filter(all_blocks, lambda x: x >= block)), side(2, F.filter(all_blocks, lambda x: x <= block))
    met = a.hint("merge").join(b, (F.col("block1") == F.col("other2")) & (F.col("other1") == F.col("block2")) & F.when(F.col("block1") == F.col("block2"), F.col("id1") < F.col("id2")).otherwise(F.col("id1") != F.col("id2")))
    return met.select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b"), haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")).alias("km"))


def web_mercator(points: DataFrame) -> DataFrame:
    r = 6378137.0
    return points.select("id", (F.radians("lon") * r).alias("x"), (F.log(F.tan(F.lit(math.pi / 4) + F.radians("lat") / 2)) * r).alias("y"))


def runs(df: DataFrame, by: str, at: str, good: Column, gap: int = 1) -> DataFrame:
    """(by, start, stop, n): runs of rows that hold a condition, at most ``gap`` apart."""
    kept = df.where(good).select(by, F.col(at).alias("start"), F.col(at).alias("stop"))
    return islands(kept, [by], "start", "stop", gap).groupBy("island", by).agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("n")).drop("island")


def contact_matrix(pairs: DataFrame, size: int) -> DataFrame:
    """(chrom, a, b, n): contacts (chrom, pos1, pos2) within a chromosome by bins, the lesser first."""
    x, y = F.floor(F.col("pos1") / size) * size, F.floor(F.col("pos2") / size) * size
    return pairs.groupBy("chrom", F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).agg(F.count("*").alias("n"))


def by_separation(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("chrom", (F.col("b") - F.col("a")).alias("separation")).agg(F.sum("n").alias("contacts"), F.count("*").alias("cells"))


def coverage_normalized(matrix: DataFrame) -> DataFrame:
    """Contacts over the root of both bins' coverages, by chromosome."""
    ends = matrix.select("chrom", F.col("a").alias("bin"), "n").unionAll(matrix.where("a <> b").select("chrom", F.col("b").alias("bin"), "n"))
    cover = ends.groupBy("chrom", "bin").agg(F.sum("n").alias("c"))
    left, right = cover.select(F.col("chrom"), F.col("bin").alias("a"), F.col("c").alias("ca")), cover.select(F.col("chrom"), F.col("bin").alias("b"), F.col("c").alias("cb"))
    return matrix.join(left, ["chrom", "a"]).join(right, ["chrom", "b"]).select("chrom", "a", "b", (F.col("n") / F.sqrt(F.col("ca") * F.col("cb"))).alias("value"))


def insulation(matrix: DataFrame, size: int, window: int) -> DataFrame:
    """(chrom, bin, score): contacts across each bin within a window of bins; each contact is dealt to the bins that it
    crosses."""
    near = matrix.where((F.col("b") > F.col("a")) & (F.col("b") - F.col("a") <= 2 * window * size))
    crossed = near.withColumn("bin", F.explode(F.sequence(F.col("a") + size, F.col("b"), F.lit(size).cast("long"))))
    inside = crossed.where((F.col("bin") - F.col("a") <= window * size) & (F.col("b") - F.col("bin") < window * size))
    return inside.groupBy("chrom", "bin").agg(F.sum("n").alias("score"))


def profile_classes(alleles: DataFrame, first: str, second: str, tolerance: int = 1) -> DataFrame:
    """(class, loci): the loci of two samples (locus, sample, size) by their least and greatest allele: match, off by
    at most ``tolerance``, discordant, or missing in one of them."""
    own = alleles.where(F.col("sample").isin(first, second) & F.col("size").isNotNull()).groupBy("locus", "sample").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    side = lambda name, which: F.max(F.when(F.col("sample") == which, F.col(name)))
    both = own.groupBy("locus").agg(side("low", first).alias("a"), side("high", first).alias("b"), side("low", second).alias("c"), side("high", second).alias("d"))
    apart = F.greatest(F.abs(F.col("a") - F.col("c")), F.abs(F.col("b") - F.col("d")))
    kind = F.when(F.col("a").isNull() | F.col("c").isNull(), "missing").when(apart == 0, "match").when(apart <= tolerance, "off by tolerance").otherwise("discordant")
    return both.groupBy(kind.alias("class")).agg(F.count("*").alias("loci"))


def terrain(cells: DataFrame, value: str, size: float = 1.0) -> DataFrame:
    """(x, y, slope, aspect): degrees, by central differences of a raster (x, y, value); cells that lack one of their
    four neighbours are left out."""
    beside = lambda dx, dy, name: cells.select((F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.col(value).cast("double").alias(name))
    both = cells.select("x", "y")
    for dx, dy, name in ((1, 0, "e"), (-1, 0, "w"), (0, 1, "s"), (0, -1, "n")):
        both = both.join(beside(dx, dy, name), ["x", "y"])
    p, q = (F.col("e") - F.col("w")) / (2 * size), (F.col("s") - F.col("n")) / (2 * size)
    return both.select("x", "y", F.degrees(F.atan(F.sqrt(p * p + q * q))).alias("slope"), F.pmod(F.degrees(F.atan2(q, p)) + 450, F.lit(360.0)).alias("aspect"))


def rarefied(counts: DataFrame, sample: str, count: str, depth: int) -> DataFrame:
    """(sample, n, observed, expected): species of each sample, and those expected in ``depth`` reads drawn without
    replacement; the depth is at most the sample's reads."""
    own = counts.where(F.col(count) > 0)
    total = own.groupBy(sample).agg(F.sum(count).cast("long").alias("n"), F.count("*").alias("observed"))
    both = own.join(total, sample).withColumn("d", F.least("n", F.lit(depth)).cast("double"))
    none = _log_choose(F.col("n") - F.col(count), F.col("d")) - _log_choose(F.col("n").cast("double"), F.col("d"))
    gone = F.when(F.col("n") - F.col(count) < F.col("d"), F.lit(0.0)).otherwise(F.exp(none))
    return both.withColumn("_p", 1 - gone).groupBy(sample).agg(F.max("n").alias("n"), F.max("observed").alias("observed"), F.sum("_p").alias("expected"))


def _log_choose(n: Column, k: Column) -> Column:
    return log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(F.greatest(n - k, F.lit(0.0)) + 1)


def per_read(track: DataFrame, reads: DataFrame, scale: float = 1.0) -> DataFrame:
    """A track (chrom, start, stop, value) per million of the rows of ``reads``."""
    n = reads.agg(F.count("*").alias("_n"))
    return track.crossJoin(F.broadcast(n)).select("chrom", "start", "stop", (F.col("value") * 1e6 * scale / F.nullif("_n", F.lit(0))).alias("value"))
