"""Operators on variant sites (chrom, pos, ref, alt, qual, filter, dp) and long genotypes (site, sample, gt, dp, gq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.pvalues import chi2_p

SITE = ["chrom", "pos", "ref", "alt"]


def is_snv() -> Column:
    return (F.length("ref") == 1) & (F.length("alt") == 1)


def is_transition() -> Column:
    return is_snv() & F.concat("ref", "alt").isin("AG", "GA", "CT", "TC")


def site_stats(sites: DataFrame) -> DataFrame:
    """Records, SNVs, indels, transitions, transversions, their ratio and the mean quality."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    made = sites.agg(F.count("*").alias("records"), n(is_snv()).alias("snvs"), n(~is_snv()).alias("indels"), n(is_transition()).alias("ti"), n(is_snv() & ~is_transition()).alias("tv"), F.avg("qual").alias("qual"))
    return made.withColumn("ti_tv", F.col("ti") / F.nullif(F.col("tv"), F.lit(0)))


def spectrum(sites: DataFrame) -> DataFrame:
    """(change, n): substitutions by their pyrimidine."""
    flip = F.col("ref").isin("A", "G")
    base = lambda c: F.when(flip, F.translate(c, "ACGT", "TGCA")).otherwise(F.col(c))
    return sites.where(is_snv()).groupBy(F.concat(base("ref"), F.lit(">"), base("alt")).alias("change")).agg(F.count("*").alias("n"))


def alt_alleles(gt: Column) -> Column:
    return F.regexp_count(gt, F.lit("[1-9]")).cast("long")


def called_alleles(gt: Column) -> Column:
    return F.regexp_count(gt, F.lit("[0-9]")).cast("long")


def allele_counts(genotypes: DataFrame) -> DataFrame:
    """(site, ac, an, af, het, hom_ref, hom_alt, missing): counts over the samples of each site."""
    gt = F.col("gt")
    ac, an = alt_alleles(gt), called_alleles(gt)
    n = lambda c: F.sum(c.cast("long"))
    made = genotypes.groupBy(*SITE).agg(F.sum(ac).alias("ac"), F.sum(an).alias("an"), n((ac == 1) & (an == 2)).alias("het"), n((ac == 0) & (an == 2)).alias("hom_ref"), n((ac == 2) & (an == 2)).alias("hom_alt"), n(an == 0).alias("missing"), F.sum("dp").alias("dp"))
    return made.withColumn("af", F.col("ac") / F.nullif(F.col("an"), F.lit(0)))


def hwe(genotypes: DataFrame) -> DataFrame:
    """Chi-square test of Hardy-Weinberg proportions by site."""
    c = allele_counts(genotypes)
    n = F.col("het") + F.col("hom_ref") + F.col("hom_alt")
    p = (2 * F.col("hom_alt") + F.col("het")) / F.nullif(2 * n, F.lit(0))
    term = lambda seen, want: F.coalesce((seen - want) * (seen - want) / F.nullif(want, F.lit(0.0)), F.lit(0.0))
    x = term(F.col("hom_alt"), n * p * p) + term(F.col("het"), 2 * n * p * (1 - p)) + term(F.col("hom_ref"), n * (1 - p) * (1 - p))
    return c.select(*SITE, (2 * p * (1 - p)).alias("expected_het"), (F.col("het") / F.nullif(n, F.lit(0))).alias("observed_het"), x.alias("chi2")).withColumn("p", chi2_p("chi2", F.lit(1.0)))


def sample_qc(genotypes: DataFrame) -> DataFrame:
    """By sample: calls, heterozygotes, homozygous alternatives, missing share, mean depth."""
    ac, an = alt_alleles(F.col("gt")), called_alleles(F.col("gt"))
    n = lambda c: F.sum(c.cast("long"))
    return genotypes.groupBy("sample").agg(n(an > 0).alias("called"), n((ac == 1) & (an == 2)).alias("het"), n((ac == 2) & (an == 2)).alias("hom_alt"), F.avg((an == 0).cast("double")).alias("missing"), F.avg("dp").alias("depth"))


def frequency_spectrum(genotypes: DataFrame, fold: bool = False) -> DataFrame:
    c = allele_counts(genotypes)
    k = F.least("ac", F.col("an") - F.col("ac")) if fold else F.col("ac")
    return c.groupBy(k.alias("ac")).agg(F.count("*").alias("sites"))


def isec(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sites of either file as both, a or b."""
    k = keys or SITE
    one = lambda df, x, y: df.select(*k, F.lit(x).alias("x"), F.lit(y).alias("y"))
    both = one(a, 1, 0).unionAll(one(b, 0, 1)).groupBy(*k).agg(F.max("x").alias("x"), F.max("y").alias("y"))
    return both.select(*k, F.when((F.col("x") == 1) & (F.col("y") == 1), "both").when(F.col("x") == 1, "a").otherwise("b").alias("found"))


def merged_sites(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sites of both files once each, with the best quality."""
    return a.select(*SITE, "qual").unionAll(b.select(*SITE, "qual")).groupBy(*SITE).agg(F.max("qual").alias("qual"), F.count("*").alias("files"))


def diversity(genotypes: DataFrame, window: int) -> DataFrame:
    """(chrom, start, sites, segregating, pi, tajima_d): nucleotide diversity and Tajima's D by window."""
    c = allele_counts(genotypes)
    an, ac = F.col("an"), F.col("ac")
    c = c.withColumn("own", F.coalesce(2.0 * ac * (an - ac) / F.nullif((an * (an - 1)).cast("double"), F.lit(0.0)), F.lit(0.0)))
    w = c.groupBy("chrom", (F.floor((F.col("pos") - 1) / window) * window).alias("start")).agg(F.count("*").alias("sites"), F.sum(((ac > 0) & (ac < an)).cast("long")).alias("s"), F.sum("own").alias("pi"), F.max("an").alias("n"))
    steps = F.when(F.col("n") > 1, F.sequence(F.lit(1).cast("long"), F.col("n") - 1)).otherwise(F.array().cast("array<bigint>"))
    a1, a2 = F.aggregate(steps, F.lit(0.0), lambda t, i: t + 1.0 / i), F.aggregate(steps, F.lit(0.0), lambda t, i: t + 1.0 / (i * i))
    w = w.withColumns({"a1": a1, "a2": a2})
    n, s = F.col("n"), F.col("s")
    b1, b2 = (n + 1) / (3 * (n - 1)), 2 * (n * n + n + 3) / (9 * n * (n - 1))
    c1, c2 = b1 - 1 / F.col("a1"), b2 - (n + 2) / (F.col("a1") * n) + F.col("a2") / (F.col("a1") * F.col("a1"))
    e1, e2 = c1 / F.col("a1"), c2 / (F.col("a1") * F.col("a1") + F.col("a2"))
    d = (F.col("pi") - s / F.col("a1")) / F.sqrt(e1 * s + e2 * s * (s - 1))
    return w.select("chrom", "start", "sites", F.col("s").alias("segregating"), "pi", F.when((s > 0) & (n > 2), d).alias("tajima_d"))


def population_frequencies(genotypes: DataFrame, groups: Column) -> DataFrame:
    """(site, population, ac, an, af)."""
    made = genotypes.groupBy(*SITE, groups.alias("population")).agg(F.sum(alt_alleles(F.col("gt"))).alias("ac"), F.sum(called_alleles(F.col("gt"))).alias("an"))
    return made.withColumn("af", F.col("ac") / F.nullif(F.col("an"), F.lit(0)))


def population_pairs(frequencies: DataFrame) -> DataFrame:
    """Sites with the frequencies of two populations side by side."""
    a = frequencies.select(*SITE, F.col("population").alias("a"), F.col("af").alias("p"), F.col("an").alias("n"))
    b = frequencies.select(*SITE, F.col("population").alias("b"), F.col("af").alias("q"), F.col("an").alias("m"))
    return a.join(b, SITE).where("a < b and p is not null and q is not null")


def fst(frequencies: DataFrame) -> DataFrame:
    """Hudson's Fst of each pair of populations, a ratio of sums over sites."""
    p, q, n, m = (F.col(c) for c in "pqnm")
    num = (p - q) * (p - q) - p * (1 - p) / F.nullif(n - 1, F.lit(0)) - q * (1 - q) / F.nullif(m - 1, F.lit(0))
    return population_pairs(frequencies).groupBy("a", "b").agg((F.sum(num) / F.sum(p * (1 - q) + q * (1 - p))).alias("fst"))


def nei_distance(frequencies: DataFrame) -> DataFrame:
    p, q = F.col("p"), F.col("q")
    return population_pairs(frequencies).groupBy("a", "b").agg((-F.log(F.sum(p * q + (1 - p) * (1 - q)) / F.sqrt(F.sum(p * p + (1 - p) * (1 - p)) * F.sum(q * q + (1 - q) * (1 - q))))).alias("nei_d"))


def private_alleles(frequencies: DataFrame, least: float = 0.05) -> DataFrame:
    """By population: sites whose alternative is at least so frequent there and absent elsewhere."""
    seen = frequencies.where("ac > 0").groupBy(*SITE).agg(F.count("*").alias("k"), F.max(F.struct("af", "population")).alias("x"))
    return seen.where((F.col("k") == 1) & (F.col("x.af") >= least)).groupBy("x.population").agg(F.count("*").alias("private"))


def kinship(genotypes: DataFrame) -> DataFrame:
    """KING-robust kinship and concordance of sample pairs; pairs meet at sites, samples are few beside sites."""
    g = genotypes.where(called_alleles(F.col("gt")) == 2).select(*SITE, "sample", alt_alleles(F.col("gt")).alias("d"))
    other = g.select(*SITE, F.col("sample").alias("b"), F.col("d").alias("e"))
    both = g.join(other, SITE).where("sample < b")
    n = lambda c: F.sum(c.cast("long"))
    d, e = F.col("d"), F.col("e")
    made = both.groupBy(F.col("sample").alias("a"), "b").agg(F.count("*").alias("sites"), n((d == 1) & (e == 1)).alias("hets"), n(F.abs(d - e) == 2).alias("opposite"), n(d == 1).alias("het_a"), n(e == 1).alias("het_b"), F.avg((d == e).cast("double")).alias("concordance"))
    return made.select("a", "b", "sites", "concordance", ((F.col("hets") - 2 * F.col("opposite")) / F.nullif(F.col("het_a") + F.col("het_b"), F.lit(0))).alias("kinship"))


def ld_pairs(genotypes: DataFrame, window: int) -> DataFrame:
    """r2 of dosages for site pairs within a window, over samples called at both."""
    g = genotypes.where(called_alleles(F.col("gt")) == 2).select("chrom", "pos", "sample", alt_alleles(F.col("gt")).alias("d"))
    g = g.withColumn("bin", F.floor(F.col("pos") / window))
    near = g.select("chrom", F.explode(F.array(F.col("bin"), F.col("bin") - 1)).alias("bin"), "sample", F.col("pos").alias("pos2"), F.col("d").alias("e"))
    pairs = g.join(near, ["chrom", "bin", "sample"]).where((F.col("pos2") > F.col("pos")) & (F.col("pos2") - F.col("pos") <= window))
    x, y, n = F.sum("d"), F.sum("e"), F.count("*")
    cov, vx, vy = n * F.sum(F.col("d") * F.col("e")) - x * y, n * F.sum(F.col("d") * F.col("d")) - x * x, n * F.sum(F.col("e") * F.col("e")) - y * y
    return pairs.groupBy("chrom", "pos", "pos2").agg(n.alias("n"), (cov * cov / F.nullif((vx * vy).cast("double"), F.lit(0.0))).alias("r2"))


def association(genotypes: DataFrame, traits: DataFrame) -> DataFrame:
    """Slope, R2 and samples of a trait (sample, value) on the dosage, by site."""
    g = genotypes.where(called_alleles(F.col("gt")) == 2).select(*SITE, "sample", alt_alleles(F.col("gt")).cast("double").alias("d"))
    return g.join(traits, "sample").groupBy(*SITE).agg(F.count("*").alias("n"), F.regr_slope("value", "d").alias("slope"), F.regr_r2("value", "d").alias("r2"))


def case_control(genotypes: DataFrame, case: Column) -> DataFrame:
    """Alternative and reference alleles of cases and controls by site."""
    ac, an = alt_alleles(F.col("gt")), called_alleles(F.col("gt"))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return genotypes.groupBy(*SITE).agg(n(F.when(case, ac)).alias("case_alt"), n(F.when(case, an - ac)).alias("case_ref"), n(F.when(~case, ac)).alias("control_alt"), n(F.when(~case, an - ac)).alias("control_ref"))


def mendelian_errors(genotypes: DataFrame, father: str, mother: str, child: str) -> DataFrame:
    """Sites at which a child's alleles can't come one from each parent."""
    d = {who: F.max(F.when((F.col("sample") == who) & (called_alleles(F.col("gt")) == 2), alt_alleles(F.col("gt")))) for who in (father, mother, child)}
    trio = genotypes.where(F.col("sample").isin(father, mother, child)).groupBy(*SITE).agg(d[father].alias("f"), d[mother].alias("m"), d[child].alias("c")).where("f is not null and m is not null and c is not null")
    low = (F.col("f") == 2).cast("int") + (F.col("m") == 2).cast("int")
    high = (F.col("f") > 0).cast("int") + (F.col("m") > 0).cast("int")
    return trio.where((F.col("c") < low) | (F.col("c") > high))


def haplotypes(genotypes: DataFrame, window: int) -> DataFrame:
    """(chrom, start, sample, haplotype): first alleles in order, by window, so that a value stays bounded."""
    first = F.split_part("gt", F.lit("/"), F.lit(1))
    return genotypes.groupBy("chrom", (F.floor((F.col("pos") - 1) / window) * window).alias("start"), "sample").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", first.alias("a")))), lambda x: x["a"]), "").alias("haplotype"))


def dosage_matrix(genotypes: DataFrame, samples: list[str]) -> DataFrame:
    d = F.when(called_alleles(F.col("gt")) == 2, alt_alleles(F.col("gt")))
    return genotypes.groupBy(*SITE).agg(*[F.max(F.when(F.col("sample") == x, d)).alias(x) for x in samples])


def best_per_site(sites: DataFrame) -> DataFrame:
    return sites.withColumn("_n", F.row_number().over(Window.partitionBy("chrom", "pos").orderBy(F.desc("qual"), "ref", "alt"))).where("_n = 1").drop("_n")
