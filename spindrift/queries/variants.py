"""Queries of the variant operators: orders as sites, genotyped in six samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import FIXTURES
from ..catalog import register as add
from ..functions.pvalues import adjusted, fisher_p
from ..operators import tables as tab
from ..operators import variants as o
from .tables import rounded

FIXTURES["sites"] = "SELECT 'chr' || CAST(1 + o_custkey % 5 AS STRING) AS chrom, o_orderkey * 20 + 1 AS pos, substr('ACGT', CAST(1 + o_orderkey % 4 AS INT), 1) AS ref, CASE WHEN o_custkey % 9 = 0 THEN substr('ACGTACGT', CAST(1 + o_orderkey % 4 AS INT), CAST(2 + o_custkey % 3 AS INT)) ELSE substr('ACGTACGT', CAST(2 + o_orderkey % 4 + o_custkey % 3 AS INT), 1) END AS alt, o_totalprice / 1000 AS qual, CASE WHEN o_totalprice > 20000 THEN 'PASS' ELSE 'LOW' END AS filter, CAST(o_custkey % 60 AS BIGINT) AS dp, o_orderkey AS k, o_custkey AS c FROM orders"
FIXTURES["other_sites"] = "SELECT chrom, pos, ref, alt, qual + 1 AS qual, filter, dp FROM sites WHERE c % 3 > 0"
FIXTURES["genotypes"] = "SELECT chrom, pos, ref, alt, 's' || CAST(n_nationkey AS STRING) AS sample, CASE WHEN r < 5 THEN '0/0' WHEN r < 8 THEN '0/1' WHEN r < 9 THEN '1/1' ELSE './.' END AS gt, CAST((c + n_nationkey * 7) % 40 AS BIGINT) AS dp, CAST((k + n_nationkey * 11) % 99 AS BIGINT) AS gq FROM (SELECT chrom, pos, ref, alt, k, c, n_nationkey, (k * (n_nationkey + 3) + c * 7 + n_nationkey * n_nationkey) % 10 AS r FROM sites CROSS JOIN nation WHERE n_nationkey < 6)"
SAMPLES = [f"s{i}" for i in range(6)]
_S = "chrom, pos, ref, alt"
_SNV = "length(ref) = 1 AND length(alt) = 1"
_TI = f"{_SNV} AND ref || alt IN ('AG', 'GA', 'CT', 'TC')"
_AC, _AN = "CAST(len(regexp_extract_all(gt, '[1-9]')) AS BIGINT)", "CAST(len(regexp_extract_all(gt, '[0-9]')) AS BIGINT)"
_N = lambda c, n: f"count(*) FILTER (WHERE {c}) AS {n}"
_COUNTS = f"(SELECT {_S}, CAST(sum({_AC}) AS BIGINT) AS ac, CAST(sum({_AN}) AS BIGINT) AS an, {_N(f'{_AC} = 1 AND {_AN} = 2', 'het')}, {_N(f'{_AC} = 0 AND {_AN} = 2', 'hom_ref')}, {_N(f'{_AC} = 2 AND {_AN} = 2', 'hom_alt')}, {_N(f'{_AN} = 0', 'missing')}, CAST(sum(dp) AS BIGINT) AS dp FROM genotypes GROUP BY {_S})"
_STATS = f"SELECT count(*) AS records, {_N(_SNV, 'snvs')}, {_N(f'NOT ({_SNV})', 'indels')}, {_N(_TI, 'ti')}, {_N(f'{_SNV} AND NOT ({_TI})', 'tv')}, round(avg(qual), 4) AS qual FROM {{t}}"
_WITH_RATIO = f"SELECT *, round(ti / nullif(tv, 0), 6) AS ti_tv FROM ({_STATS})"

add("bcftools_view", lambda t: t.sites.where("chrom = 'chr2' and qual > 30").select(*o.SITE), f"SELECT {_S} FROM sites WHERE chrom = 'chr2' AND qual > 30")
add("bcftools_query", lambda t: t.genotypes.select("chrom", "pos", "sample", "gt", "dp", "gq"), "SELECT chrom, pos, sample, gt, dp, gq FROM genotypes")
add("bcftools_stats", lambda t: rounded(rounded(o.site_stats(t.sites), "qual"), "ti_tv", n=6), _WITH_RATIO.format(t="sites"))
add("bcftools_isec", lambda t: o.isec(t.sites.where("c % 4 > 0"), t.other_sites), f"SELECT coalesce(a.chrom, b.chrom) AS chrom, coalesce(a.pos, b.pos) AS pos, coalesce(a.ref, b.ref) AS ref, coalesce(a.alt, b.alt) AS alt, CASE WHEN a.pos IS NULL THEN 'b' WHEN b.pos IS NULL THEN 'a' ELSE 'both' END AS found FROM (SELECT * FROM sites WHERE c % 4 > 0) a FULL JOIN other_sites b ON a.chrom = b.chrom AND a.pos = b.pos AND a.ref = b.ref AND a.alt = b.alt")
add("bcftools_merge", lambda t: o.merged_sites(t.sites, t.other_sites), f"SELECT {_S}, max(qual) AS qual, count(*) AS files FROM (SELECT {_S}, qual FROM sites UNION ALL SELECT {_S}, qual FROM other_sites) GROUP BY {_S}")
add("vcf_filter_records", lambda t: t.sites.select(*o.SITE, F.when((F.col("qual") < 10) | (F.col("dp") < 5), "low").otherwise("PASS").alias("filter")), f"SELECT {_S}, CASE WHEN qual < 10 OR dp < 5 THEN 'low' ELSE 'PASS' END AS filter FROM sites")
add("vcf_apply_vqsr", lambda t: t.sites.crossJoin(F.broadcast(t.sites.agg(F.percentile("qual", F.lit(0.1)).alias("cut")))).select(*o.SITE, F.when((F.col("qual") >= F.col("cut")) & (F.col("dp") >= 3), "PASS").otherwise("LOWQUAL").alias("filter")), f"SELECT {_S}, CASE WHEN qual >= (SELECT quantile_cont(qual, 0.1) FROM sites) AND dp >= 3 THEN 'PASS' ELSE 'LOWQUAL' END AS filter FROM sites")
add("vcf_somatic_pair", lambda t: t.genotypes.where("sample in ('s0', 's1')").groupBy(*o.SITE).agg(F.max(F.when(F.col("sample") == "s0", o.alt_alleles(F.col("gt")))).alias("tumour"), F.max(F.when(F.col("sample") == "s1", o.alt_alleles(F.col("gt")))).alias("normal")).where("tumour > 0 and normal = 0"), f"SELECT * FROM (SELECT {_S}, max(CASE WHEN sample = 's0' THEN {_AC} END) AS tumour, max(CASE WHEN sample = 's1' THEN {_AC} END) AS normal FROM genotypes GROUP BY {_S}) WHERE tumour > 0 AND normal = 0")
add("vcf_genotype_refinement", lambda t: t.genotypes.select(*o.SITE, "sample", F.when(F.col("gq") < 20, "./.").otherwise(F.col("gt")).alias("gt")), f"SELECT {_S}, sample, CASE WHEN gq < 20 THEN './.' ELSE gt END AS gt FROM genotypes")
add("vcf_haploidize", lambda t: t.genotypes.select(*o.SITE, "sample", F.split_part("gt", F.lit("/"), F.lit(1)).alias("gt")), f"SELECT {_S}, sample, split_part(gt, '/', 1) AS gt FROM genotypes")
add("vcf_allele_frequencies", lambda t: o.allele_counts(t.genotypes).where("af > 0").select(*o.SITE, "af"), f"SELECT {_S}, ac / an AS af FROM {_COUNTS} WHERE ac > 0")
add("vcf_allele_counts", lambda t: o.allele_counts(t.genotypes).select(*o.SITE, "ac", "an"), f"SELECT {_S}, ac, an FROM {_COUNTS}")
add("vcf_add_info_tags", lambda t: o.allele_counts(t.genotypes).select(*o.SITE, "ac", "an", "dp", "missing"), f"SELECT {_S}, ac, an, dp, missing FROM {_COUNTS}")
add("vcf_ts_tv", lambda t: rounded(o.site_stats(t.sites.where("filter = 'PASS'")).select("ti", "tv", "ti_tv"), "ti_tv", n=6), f"SELECT ti, tv, ti_tv FROM ({_WITH_RATIO.format(t='(SELECT * FROM sites WHERE filter = ' + chr(39) + 'PASS' + chr(39) + ')')})")
_BASE = lambda c: f"CASE WHEN ref IN ('A', 'G') THEN translate({c}, 'ACGT', 'TGCA') ELSE {c} END"
add("vcf_mutation_spectrum", lambda t: o.spectrum(t.sites), f"SELECT {_BASE('ref')} || '>' || {_BASE('alt')} AS change, count(*) AS n FROM sites WHERE {_SNV} GROUP BY 1")
add("vcf_indel_spectrum", lambda t: t.sites.where(~o.is_snv()).groupBy((F.length("alt") - F.length("ref")).cast("long").alias("size")).agg(F.count("*").alias("n")), f"SELECT length(alt) - length(ref) AS size, count(*) AS n FROM sites WHERE NOT ({_SNV}) GROUP BY 1")
add("vcf_sfs", lambda t: o.frequency_spectrum(t.genotypes, True), f"SELECT least(ac, an - ac) AS ac, count(*) AS sites FROM {_COUNTS} GROUP BY 1")
_QC = f"SELECT sample, {_N(f'{_AN} > 0', 'called')}, {_N(f'{_AC} = 1 AND {_AN} = 2', 'het')}, {_N(f'{_AC} = 2 AND {_AN} = 2', 'hom_alt')}, round(avg(CAST({_AN} = 0 AS DOUBLE)), 6) AS missing, round(avg(dp), 6) AS depth FROM genotypes GROUP BY 1"
add("vcf_sample_qc", lambda t: rounded(o.sample_qc(t.genotypes), "missing", "depth", n=6), _QC)
add("vcf_heterozygosity", lambda t: o.sample_qc(t.genotypes).select("sample", "called", "het", "hom_alt"), f"SELECT sample, called, het, hom_alt FROM ({_QC})")
add("vcf_missingness", lambda t: rounded(o.sample_qc(t.genotypes).select("sample", "missing"), "missing", n=6), f"SELECT sample, missing FROM ({_QC})")
_E = lambda seen, want: f"coalesce(pow({seen} - {want}, 2) / nullif({want}, 0), 0)"
_HWE = f"SELECT {_S}, round(2 * p * (1 - p), 6) AS expected_het, round(het / n, 6) AS observed_het, round({_E('hom_alt', 'n * p * p')} + {_E('het', '2 * n * p * (1 - p)')} + {_E('hom_ref', 'n * (1 - p) * (1 - p)')}, 6) AS chi2 FROM (SELECT *, (2 * hom_alt + het) / nullif(2 * n, 0) AS p FROM (SELECT *, het + hom_ref + hom_alt AS n FROM {_COUNTS}))"
add("vcf_hwe", lambda t: rounded(o.hwe(t.genotypes).drop("p"), "expected_het", "observed_het", "chi2", n=6), _HWE)
add("vcf_hwe_summary", lambda t: rounded(o.hwe(t.genotypes).agg(F.count("*").alias("sites"), F.avg("expected_het").alias("expected"), F.avg("observed_het").alias("observed"), F.sum((F.col("p") < 0.05).cast("long")).alias("departing")), "expected", "observed"), f"SELECT count(*) AS sites, round(avg(expected_het), 4) AS expected, round(avg(observed_het), 4) AS observed, count(*) FILTER (WHERE chi2 > 3.8414588) AS departing FROM ({_HWE})")
add("vcf_quality_bins", lambda t: rounded(tab.histogram(t.sites, "qual", 10), "low", "high"), "WITH e AS (SELECT min(qual) AS lo, max(qual) AS hi FROM sites), c AS (SELECT CAST(least(floor((qual - lo) / ((hi - lo) / 10)), 9) AS BIGINT) AS bin, count(*) AS n FROM sites, e GROUP BY 1) SELECT r.bin, round(lo + r.bin * ((hi - lo) / 10), 4) AS low, round(lo + (r.bin + 1) * ((hi - lo) / 10), 4) AS high, coalesce(n, 0) AS n FROM e, (SELECT unnest(range(0, 10)) AS bin) r LEFT JOIN c ON c.bin = r.bin")
add("vcf_convert_to_bed", lambda t: t.sites.where(o.is_snv()).select("chrom", (F.col("pos") - 1).alias("start"), (F.col("pos") - 1 + F.length("ref")).alias("stop")), f"SELECT chrom, pos - 1 AS start, pos - 1 + length(ref) AS stop FROM sites WHERE {_SNV}")
_MATRIX = f"SELECT {_S}, " + ", ".join(f"max(CASE WHEN sample = '{s}' AND {_AN} = 2 THEN {_AC} END) AS {s}" for s in SAMPLES) + f" FROM genotypes GROUP BY {_S}"
add("vcf_convert_to_tsv", lambda t: t.sites.join(o.dosage_matrix(t.genotypes, SAMPLES), o.SITE).select(*o.SITE, "qual", "filter", *SAMPLES), f"SELECT {_S}, qual, filter, {', '.join(SAMPLES)} FROM sites JOIN ({_MATRIX}) USING ({_S})")
add("vcf_to_genotypes_tsv", lambda t: o.dosage_matrix(t.genotypes, SAMPLES), _MATRIX)
add("vcf_set_gt_ploidy", lambda t: t.genotypes.groupBy(F.size(F.split("gt", "[/|]")).cast("long").alias("ploidy")).agg(F.count("*").alias("n")), "SELECT CAST(len(string_split_regex(gt, '[/|]')) AS BIGINT) AS ploidy, count(*) AS n FROM genotypes GROUP BY 1")
add("vcf_subsample_samples", lambda t: t.genotypes.where(F.col("sample").isin("s1", "s3", "s5")).select(*o.SITE, "sample", "gt"), f"SELECT {_S}, sample, gt FROM genotypes WHERE sample IN ('s1', 's3', 's5')")
_WIN = "SELECT chrom, CAST(floor((pos - 1) / 1000) AS BIGINT) * 1000 AS start, count(*) AS n FROM sites GROUP BY 1, 2"
for _name in ("vcf_region_index", "vcf_variant_density_plot"):
    add(_name, lambda t: t.sites.groupBy("chrom", (F.floor((F.col("pos") - 1) / 1000) * 1000).alias("start")).agg(F.count("*").alias("n")), _WIN)
add("vcf_manhattan", lambda t: t.sites.select("chrom", "pos", F.round(F.col("qual") / 10, 6).alias("score")), "SELECT chrom, pos, round(qual / 10, 6) AS score FROM sites")
_DIV = f"(SELECT chrom, CAST(floor((pos - 1) / 2000) AS BIGINT) * 2000 AS start, count(*) AS sites, count(*) FILTER (WHERE ac > 0 AND ac < an) AS s, sum(coalesce(2.0 * ac * (an - ac) / nullif(an * (an - 1), 0), 0)) AS pi, max(an) AS n FROM {_COUNTS} GROUP BY 1, 2)"
_TAJ = f"SELECT chrom, start, sites, s AS segregating, round(pi, 6) AS pi, CASE WHEN s > 0 AND n > 2 THEN round((pi - s / a1) / sqrt(((n + 1) / (3 * (n - 1)) - 1 / a1) / a1 * s + (2 * (n * n + n + 3) / (9 * n * (n - 1)) - (n + 2) / (a1 * n) + a2 / (a1 * a1)) / (a1 * a1 + a2) * s * (s - 1)), 6) END AS tajima_d FROM (SELECT *, list_sum([1.0 / i for i in range(1, n)]) AS a1, list_sum([1.0 / (i * i) for i in range(1, n)]) AS a2 FROM {_DIV})".replace("1.0 /", "CAST(1 AS DOUBLE) /")
add("vcf_tajima_d", lambda t: rounded(o.diversity(t.genotypes, 2000), "pi", "tajima_d", n=6), _TAJ)
add("vcf_nucleotide_diversity", lambda t: rounded(o.diversity(t.genotypes, 2000).select("chrom", "start", "segregating", "pi"), "pi", n=6), f"SELECT chrom, start, segregating, pi FROM ({_TAJ})")
_POP = "CASE WHEN sample IN ('s0', 's1') THEN 'x' WHEN sample IN ('s2', 's3') THEN 'y' ELSE 'z' END"
_FREQ = f"(SELECT {_S}, {_POP} AS population, sum({_AC}) AS ac, sum({_AN}) AS an, sum({_AC}) / nullif(sum({_AN}), 0) AS af FROM genotypes GROUP BY {_S}, 5)"
_PAIRS = f"(SELECT a.population AS a, b.population AS b, a.af AS p, b.af AS q, a.an AS n, b.an AS m FROM {_FREQ} a JOIN {_FREQ} b ON a.chrom = b.chrom AND a.pos = b.pos AND a.ref = b.ref AND a.alt = b.alt WHERE a.population < b.population AND a.af IS NOT NULL AND b.af IS NOT NULL)"


def _populations(t):
    c = F.col("sample")
    return o.population_frequencies(t.genotypes, F.when(c.isin("s0", "s1"), "x").when(c.isin("s2", "s3"), "y").otherwise("z"))


add("vcf_fst_pairwise", lambda t: rounded(o.fst(_populations(t)), "fst", n=6), f"SELECT a, b, round(sum(pow(p - q, 2) - p * (1 - p) / nullif(n - 1, 0) - q * (1 - q) / nullif(m - 1, 0)) / sum(p * (1 - q) + q * (1 - p)), 6) AS fst FROM {_PAIRS} GROUP BY 1, 2")
add("vcf_genetic_distance", lambda t: rounded(o.nei_distance(_populations(t)), "nei_d", n=6), f"SELECT a, b, round(-ln(sum(p * q + (1 - p) * (1 - q)) / sqrt(sum(p * p + (1 - p) * (1 - p)) * sum(q * q + (1 - q) * (1 - q)))), 6) AS nei_d FROM {_PAIRS} GROUP BY 1, 2")
add("vcf_priv_alleles", lambda t: o.private_alleles(_populations(t)), f"SELECT population, count(*) AS private FROM (SELECT {_S}, count(*) AS k, arg_max(population, af) AS population, max(af) AS af FROM {_FREQ} WHERE ac > 0 GROUP BY {_S}) WHERE k = 1 AND af >= 0.05 GROUP BY 1")
_DOS = f"(SELECT {_S}, sample, {_AC} AS d FROM genotypes WHERE {_AN} = 2)"
_KIN = f"SELECT a.sample AS a, b.sample AS b, count(*) AS sites, round(avg(CAST(a.d = b.d AS DOUBLE)), 6) AS concordance, round((count(*) FILTER (WHERE a.d = 1 AND b.d = 1) - 2 * count(*) FILTER (WHERE abs(a.d - b.d) = 2)) / nullif(count(*) FILTER (WHERE a.d = 1) + count(*) FILTER (WHERE b.d = 1), 0), 6) AS kinship FROM {_DOS} a JOIN {_DOS} b ON a.chrom = b.chrom AND a.pos = b.pos AND a.ref = b.ref AND a.alt = b.alt AND a.sample < b.sample GROUP BY 1, 2"
add("vcf_relatedness", lambda t: rounded(o.kinship(t.genotypes), "concordance", "kinship", n=6), _KIN)
add("vcf_relatedness_pairs", lambda t: rounded(o.kinship(t.genotypes).where("kinship > 0.0").select("a", "b", "kinship"), "kinship", n=6), f"SELECT a, b, kinship FROM ({_KIN}) WHERE kinship > 0.0")
add("vcf_ld_pruning", lambda t: rounded(o.ld_pairs(t.genotypes, 200), "r2", n=6), f"SELECT chrom, pos, pos2, n, round(cov * cov / nullif(vx * vy, 0), 6) AS r2 FROM (SELECT a.chrom, a.pos, b.pos AS pos2, count(*) AS n, count(*) * sum(a.d * b.d) - sum(a.d) * sum(b.d) AS cov, count(*) * sum(a.d * a.d) - sum(a.d) * sum(a.d) AS vx, count(*) * sum(b.d * b.d) - sum(b.d) * sum(b.d) AS vy FROM {_DOS} a JOIN {_DOS} b ON a.chrom = b.chrom AND a.sample = b.sample AND b.pos > a.pos AND b.pos - a.pos <= 200 GROUP BY 1, 2, 3)")
add("vcf_haplotype_table", lambda t: o.haplotypes(t.genotypes, 5000), "SELECT chrom, CAST(floor((pos - 1) / 5000) AS BIGINT) * 5000 AS start, sample, string_agg(split_part(gt, '/', 1), '' ORDER BY pos) AS haplotype FROM genotypes GROUP BY 1, 2, 3")
add("vcf_polymorphism_info", lambda t: rounded(o.allele_counts(t.genotypes).select(*o.SITE, F.least("af", 1 - F.col("af")).alias("maf"), (2 * F.col("af") * (1 - F.col("af"))).alias("het")), "maf", "het", n=6), f"SELECT {_S}, round(least(ac / an, 1 - ac / an), 6) AS maf, round(2 * (ac / an) * (1 - ac / an), 6) AS het FROM {_COUNTS}")
add("vcf_shannon_diversity", lambda t: rounded(o.allele_counts(t.genotypes).where("af > 0").groupBy("chrom", (F.floor((F.col("pos") - 1) / 5000) * 5000).alias("start")).agg(F.sum(-F.col("af") * F.log("af")).alias("shannon")), "shannon", n=6), f"SELECT chrom, CAST(floor((pos - 1) / 5000) AS BIGINT) * 5000 AS start, round(sum(-(ac / an) * ln(ac / an)), 6) AS shannon FROM {_COUNTS} WHERE ac > 0 GROUP BY 1, 2")
_CC = f"SELECT {_S}, " + ", ".join(f"CAST(coalesce(sum({v}) FILTER (WHERE {w}), 0) AS BIGINT) AS {n}" for n, v, w in (("case_alt", _AC, "sample < 's3'"), ("case_ref", f"{_AN} - {_AC}", "sample < 's3'"), ("control_alt", _AC, "NOT sample < 's3'"), ("control_ref", f"{_AN} - {_AC}", "NOT sample < 's3'"))) + f" FROM genotypes GROUP BY {_S}"
add("vcf_fisher_case_control", lambda t: adjusted(o.case_control(t.genotypes, F.col("sample") < "s3").withColumn("p", fisher_p("case_alt", "case_ref", "control_alt", "control_ref")), "p").select(*o.SITE, "case_alt", "case_ref", "control_alt", "control_ref"), _CC)
add("vcf_linear_association", lambda t: rounded(o.association(t.genotypes, t.nation.select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("sample"), (F.col("n_nationkey") * 1.5).alias("value"))), "slope", "r2", n=6), f"SELECT {_S}, count(*) AS n, round(regr_slope(n_nationkey * CAST(1.5 AS DOUBLE), d), 6) + 0.0 AS slope, round(regr_r2(n_nationkey * CAST(1.5 AS DOUBLE), d), 6) AS r2 FROM {_DOS} JOIN nation ON sample = 's' || CAST(n_nationkey AS VARCHAR) GROUP BY {_S}")
add("vcf_mendelian_errors", lambda t: o.mendelian_errors(t.genotypes, "s0", "s1", "s2").select(*o.SITE), f"SELECT {_S} FROM ({_MATRIX}) WHERE s0 IS NOT NULL AND s1 IS NOT NULL AND s2 IS NOT NULL AND (s2 < CAST(s0 = 2 AS INT) + CAST(s1 = 2 AS INT) OR s2 > CAST(s0 > 0 AS INT) + CAST(s1 > 0 AS INT))")
add("vcf_create_background", lambda t: t.sites.join(t.other_sites.select(F.col("chrom").alias("_c"), F.col("pos").alias("_p"), F.col("qual").alias("panel")), (F.col("chrom") == F.col("_c")) & (F.col("pos") == F.col("_p"))).where(F.abs(F.col("qual") - F.col("panel")) >= 0.1).select("chrom", "pos", "panel"), "SELECT s.chrom, s.pos, o.qual AS panel FROM sites s JOIN other_sites o ON s.chrom = o.chrom AND s.pos = o.pos WHERE abs(s.qual - o.qual) >= 0.1")
add("vcf_gene_based_association", lambda t: t.sites.groupBy("chrom", F.floor(F.col("pos") / 10000).alias("gene")).agg(F.count("*").alias("n"), F.max("qual").alias("best")), "SELECT chrom, CAST(floor(pos / 10000) AS BIGINT) AS gene, count(*) AS n, max(qual) AS best FROM sites GROUP BY 1, 2")
