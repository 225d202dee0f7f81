"""Queries of ecology, proteomics, pharmacology, contact maps, geography and climate on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import FIXTURES
from ..catalog import register as add
from ..functions import sequences as s
from ..operators import intervals as iv
from ..operators import omics as o
from ..operators import sequences as sq
from ..operators import statistics as st
from ..operators import tables as tab
from .intervals import islands as island_sql
from .sequences import gc, kmers, n_of, rc
from .statistics import _CPM, _L, L, S
from .tables import rounded

_AA = "'0123456789abcdef', 'ACDEFGHIKLMNPQRS'"
FIXTURES["proteins"] = f"SELECT p_partkey AS ln, 'p' || CAST(p_partkey AS STRING) AS id, translate(md5(CAST(p_partkey AS STRING)), {_AA}) || substr(translate(md5(CAST(p_partkey AS STRING) || 'x'), {_AA}), 1, CAST(p_size AS INT)) AS seq FROM part"
FIXTURES["lineages"] = "SELECT c_custkey AS id, c_custkey % 40 AS query, 'k__' || r_name || ';p__' || n_name || ';s__' || c_mktsegment AS lineage, c_acctbal AS weight FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
FIXTURES["peptides"] = "SELECT l_partkey AS peptide, l_suppkey AS protein, l_extendedprice AS intensity, l_discount * 100 AS score, l_linenumber % 3 = 0 AS decoy FROM lineitem"
FIXTURES["doses"] = "SELECT user_id AS subject, CAST(event_id AS DOUBLE) AS t, value AS v, event_type AS kind FROM events"
FIXTURES["stations"] = "SELECT s_suppkey AS id, (s_suppkey * 37 % 1400) / CAST(10 AS DOUBLE) - 70 AS lat, (s_suppkey * 91 % 3500) / CAST(10 AS DOUBLE) - 175 AS lon FROM supplier"
FIXTURES["contacts"] = "SELECT 'chr' || CAST(1 + l_suppkey % 3 AS STRING) AS chrom, l_orderkey * 10 AS pos1, l_orderkey * 10 + l_partkey * 7 AS pos2 FROM lineitem"
FIXTURES["cytosines"] = "SELECT chrom, start AS pos, CASE name WHEN 'x' THEN 'CHH' ELSE CASE WHEN start % 3 = 0 THEN 'CG' WHEN start % 3 = 1 THEN 'CHG' ELSE 'CHH' END END AS context, CAST(start % 11 AS DOUBLE) / 10 AS fraction FROM bed_b"
FIXTURES["alleles"] = "SELECT 'l' || CAST(l_partkey % 50 AS STRING) AS locus, 's' || CAST(l_suppkey % 6 AS STRING) AS sample, CAST(l_quantity AS BIGINT) AS size FROM lineitem"
FIXTURES["daily"] = "SELECT o_custkey % 7 AS site, o_orderkey AS day, o_totalprice / 10000 AS rain, o_custkey % 35 - 5 AS low, o_custkey % 35 + o_orderkey % 12 - 5 AS high FROM orders"
FIXTURES["pixels"] = "SELECT CAST(p_partkey % 64 AS BIGINT) AS x, CAST(p_partkey // 64 AS BIGINT) AS y, p_size AS red, p_retailprice / 100 AS nir FROM part".replace("p_partkey // 64", "floor(p_partkey / 64)")

# ecology
add("meta_count_table_summary", lambda t: rounded(L(t).groupBy("column").agg(F.sum("value").alias("size"), F.sum((F.col("value") > 0).cast("long")).alias("features"), F.sum((F.col("value") == 1).cast("long")).alias("singletons")), "size"), f"SELECT \"column\", round(sum(value), 4) AS size, count(*) FILTER (WHERE value > 0) AS features, count(*) FILTER (WHERE value = 1) AS singletons FROM {_L} GROUP BY 1")
_ALPHA = f"SELECT \"column\", richness, round(shannon, 6) AS shannon, round(simpson, 6) AS simpson, round(shannon / ln(richness), 6) AS evenness, round(richness + f1 * (f1 - 1) / (2 * (f2 + 1)), 6) AS chao1 FROM (SELECT \"column\", count(*) AS richness, sum(-p * ln(p)) AS shannon, 1 - sum(p * p) AS simpson, count(*) FILTER (WHERE value = 1) AS f1, count(*) FILTER (WHERE value = 2) AS f2 FROM (SELECT \"column\", value, value / sum(value) OVER (PARTITION BY \"column\") AS p FROM {_L}) WHERE value > 0 GROUP BY 1)"
add("meta_alpha_diversity", lambda t: rounded(o.alpha_diversity(L(t)), "shannon", "simpson", "evenness", "chao1", n=6), _ALPHA)
add("meta_beta_brays", lambda t: rounded(o.beta_diversity(L(t)), "bray_curtis", "jaccard", n=6), f"SELECT a.\"column\" AS a, b.\"column\" AS b, round(sum(abs(a.value - b.value)) / sum(a.value + b.value), 6) AS bray_curtis, round(1 - count(*) FILTER (WHERE a.value > 0 AND b.value > 0) / count(*) FILTER (WHERE a.value > 0 OR b.value > 0), 6) AS jaccard FROM {_L} a JOIN {_L} b ON a.\"row\" = b.\"row\" AND a.\"column\" < b.\"column\" GROUP BY 1, 2")
for _name, _rank, _i in (("meta_taxa_summary_by_rank", "p", 2), ("biodiv_checklist", "s", 3)):
    add(_name, lambda t, r=_rank: o.at_rank(t.lineages, "lineage", r), f"SELECT substr(split_part(lineage, ';', {_i}), 4) AS taxon, count(*) AS n FROM lineages GROUP BY 1")
add("meta_abundance_at_rank", lambda t: rounded(o.at_rank(t.lineages, "lineage", "k", F.col("weight")), "n", n=2), "SELECT substr(split_part(lineage, ';', 1), 4) AS taxon, round(sum(weight), 2) AS n FROM lineages GROUP BY 1")
add("meta_filter_by_lineage", lambda t: t.lineages.where(F.col("lineage").contains("k__ASIA")).select("id"), "SELECT id FROM lineages WHERE contains(lineage, 'k__ASIA')")
add("meta_kraken_report", lambda t: rounded(o.rank_report(t.lineages, "lineage"), "percent"), "SELECT substr(x, 1, 1) AS rank, substr(x, 4) AS taxon, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM lineages), 4) AS percent FROM (SELECT unnest(string_split(lineage, ';')) AS x FROM lineages) GROUP BY 1, 2")
_LCA = "SELECT query, CASE WHEN count(DISTINCT lineage) = 1 THEN min(lineage) WHEN count(DISTINCT split_part(lineage, ';', 1) || ';' || split_part(lineage, ';', 2)) = 1 THEN min(split_part(lineage, ';', 1) || ';' || split_part(lineage, ';', 2)) WHEN count(DISTINCT split_part(lineage, ';', 1)) = 1 THEN min(split_part(lineage, ';', 1)) ELSE 'root' END AS lineage FROM lineages GROUP BY 1"
for _name in ("meta_lca_of_hits", "blast_lca_taxonomy"):
    add(_name, lambda t: o.lowest_common(t.lineages, "query", "lineage"), _LCA)
add("qiime_filter_features", lambda t: L(t).groupBy("row").agg(F.sum((F.col("value") > 0).cast("long")).alias("samples"), F.sum("value").alias("total")).where("samples >= 5 and total >= 100"), f"SELECT * FROM (SELECT \"row\", count(*) FILTER (WHERE value > 0) AS samples, sum(value) AS total FROM {_L} GROUP BY 1) WHERE samples >= 5 AND total >= 100")
add("qiime_merge_metadata", lambda t: tab.join_tables(t.customer.select("c_custkey", "c_nationkey"), t.nation.select("n_nationkey", "n_name"), "c_nationkey", "n_nationkey", "left").select("c_custkey", "n_name"), "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
add("qiime_taxa_barplot", lambda t: rounded(o.at_rank(t.lineages, "lineage", "p").crossJoin(F.broadcast(t.lineages.agg(F.count("*").alias("all")))).select("taxon", (F.col("n") / F.col("all")).alias("share")), "share", n=6), "SELECT substr(split_part(lineage, ';', 2), 4) AS taxon, round(count(*) / (SELECT count(*) FROM lineages), 6) AS share FROM lineages GROUP BY 1")
add("biodiv_endemism_score", lambda t: rounded(t.lineages.groupBy("lineage").agg(F.count_distinct("query").alias("k")).select("lineage", (1 / F.col("k")).alias("score")), "score", n=6), "SELECT lineage, round(1 / count(DISTINCT query), 6) AS score FROM lineages GROUP BY 1")
_UNI = "SELECT upper(seq) AS key, count(*) AS copies, arg_min(id, ln) AS id FROM reads GROUP BY 1"
for _name in ("mothur_get_current", "qiime_dereplicate", "dereplicate_sequences"):
    add(_name, lambda t: sq.deduplicated(t.reads, "ln", "folded"), _UNI)
add("mothur_count_seqs", lambda t: rounded(sq.composition(t.reads).groupBy("length").agg(F.count("*").alias("reads"), F.avg("gc").alias("gc"), F.sum("n").alias("ambiguous")), "gc"), f"SELECT length(seq) AS length, count(*) AS reads, round(avg({gc()}), 4) AS gc, CAST(sum({n_of('N')}) AS BIGINT) AS ambiguous FROM reads GROUP BY 1")
add("mothur_trim_seqs", lambda t: t.aligned.select("id", F.substring("seq", 6, 20).alias("seq")), "SELECT id, substr(seq, 6, 20) AS seq FROM aligned")
add("mothur_screen_seqs", lambda t: t.reads.groupBy(F.when(F.length("seq") < 45, "short").when(F.col("seq").contains("N"), "ambiguous").otherwise("kept").alias("reason")).agg(F.count("*").alias("n")), "SELECT CASE WHEN length(seq) < 45 THEN 'short' WHEN contains(seq, 'N') THEN 'ambiguous' ELSE 'kept' END AS reason, count(*) AS n FROM reads GROUP BY 1")
add("qiime_fastq_stats", lambda t: rounded(t.reads.agg(F.count("*").alias("reads"), F.avg(F.length("seq")).alias("length"), F.avg(s.mean_quality(F.col("qual"))).alias("quality")), "length", "quality"), "SELECT count(*) AS reads, round(avg(length(seq)), 4) AS length, round(avg(list_sum([ord(c) - 33 for c in string_split(qual, '')]) / length(qual)), 4) AS quality FROM reads")
add("planttribes_enzyme_cuts", lambda t: t.records.select("id", *[F.regexp_count("seq", F.lit(x)).cast("long").alias(n) for n, x in (("ecori", "GAATTC"), ("hindiii", "AAGCTT"), ("alui", "AGCT"), ("haeiii", "GGCC"))]), "SELECT id, " + ", ".join(f"CAST(len(regexp_extract_all(seq, '{x}')) AS BIGINT) AS {n}" for n, x in (("ecori", "GAATTC"), ("hindiii", "AAGCTT"), ("alui", "AGCT"), ("haeiii", "GGCC"))) + " FROM records")
add("sccaf_split_contigs", lambda t: sq.chopped(t.records, "id", "seq", 20), "SELECT id || '_' || CAST(i + 1 AS VARCHAR) AS id, substr(seq, i * 20 + 1, 20) AS seq FROM (SELECT id, seq, unnest(range(0, CAST(ceil(length(seq) / 20) AS BIGINT))) AS i FROM records)")
add("kmer_spectrum", lambda t: sq.kmer_counts(t.records, 6, canonical=True).groupBy(F.col("n").alias("multiplicity")).agg(F.count("*").alias("kmers")), f"SELECT n AS multiplicity, count(*) AS kmers FROM (SELECT count(*) AS n FROM {kmers('records', 6)} GROUP BY least(kmer, {rc('kmer')})) GROUP BY 1")
add("bwa_index_summary", lambda t: sq.kmer_counts(t.records, 8).agg(F.count("*").alias("kmers"), F.max("n").alias("most"), F.sum("n").alias("places")), f"SELECT count(*) AS kmers, max(n) AS most, CAST(sum(n) AS BIGINT) AS places FROM (SELECT kmer, count(*) AS n FROM {kmers('records', 8)} GROUP BY 1)")
add("assembly_metrics", lambda t: rounded(sq.n50(t.records), "mean", "gc").select("records", "bases", "n50", "l50"), "WITH l AS (SELECT length(seq) AS n, row_number() OVER (ORDER BY length(seq) DESC, ln) AS k, sum(length(seq)) OVER (ORDER BY length(seq) DESC, ln) AS c, sum(length(seq)) OVER () AS total FROM records) SELECT count(*) AS records, CAST(sum(n) AS BIGINT) AS bases, max(n) FILTER (WHERE c >= total / 2) AS n50, min(k) FILTER (WHERE c >= total / 2) AS l50 FROM l")
add("contig_nuc_content", lambda t: sq.composition(t.records).select("id", "a", "c", "g", "t"), "SELECT id, " + ", ".join(f"{n_of(b.upper())} AS {b}" for b in "acgt") + " FROM records")
_COL = "(SELECT i - 1 AS position, substr(seq, i, 1) AS base, count(*) AS n FROM (SELECT seq, unnest(range(1, length(seq) + 1)) AS i FROM aligned) GROUP BY 1, 2)"


def columns(t):
    return t.aligned.select(F.posexplode(F.filter(F.split("seq", ""), lambda c: c != "")).alias("position", "base")).groupBy(F.col("position").cast("long").alias("position"), "base").agg(F.count("*").alias("n"))


add("msa_column_frequencies", columns, f"SELECT position, base, n FROM {_COL}")
for _name in ("msa_consensus", "ancestral_parsimony"):
    add(_name, lambda t: sq.consensus(t.aligned), f"SELECT position, base, n FROM (SELECT *, row_number() OVER (PARTITION BY position ORDER BY n DESC, base) AS k FROM {_COL}) WHERE k = 1")
_ENT = f"SELECT position, round(-sum(p * log2(p)), 6) + 0.0 AS entropy, count(*) AS bases FROM (SELECT position, n / sum(n) OVER (PARTITION BY position) AS p FROM {_COL}) GROUP BY 1"


def entropy(t):
    c = columns(t)
    total = c.groupBy(F.col("position").alias("_p")).agg(F.sum("n").alias("_n"))
    p = F.col("n") / F.col("_n")
    return rounded(c.join(total, F.col("position") == F.col("_p")).groupBy("position").agg((-F.sum(p * F.log2(p))).alias("entropy"), F.count("*").alias("bases")), "entropy", n=6)


add("msa_entropy_profile", entropy, _ENT)
add("msa_stats", lambda t: entropy(t).select("position", "entropy"), f"SELECT position, entropy FROM ({_ENT})")
add("msa_variable_sites", lambda t: entropy(t).where("bases > 1"), f"SELECT * FROM ({_ENT}) WHERE bases > 1")
# methylation, markers
add("epi_methylation_context_summary", lambda t: rounded(t.cytosines.groupBy("context").agg(F.count("*").alias("n"), F.avg("fraction").alias("mean")), "mean", n=6), "SELECT context, count(*) AS n, round(avg(fraction), 6) AS mean FROM cytosines GROUP BY 1")
add("epi_methylation_per_region", lambda t: rounded(t.cytosines.groupBy("chrom", (F.floor(F.col("pos") / 10000) * 10000).alias("start")).agg(F.count("*").alias("n"), F.avg("fraction").alias("mean")), "mean", n=6), "SELECT chrom, CAST(floor(pos / 10000) AS BIGINT) * 10000 AS start, count(*) AS n, round(avg(fraction), 6) AS mean FROM cytosines GROUP BY 1, 2")
add("epi_bisulfite_extractor", lambda t: t.cytosines.where("context = 'CG'").select("chrom", "pos", F.when(F.col("fraction") >= 0.5, "methylated").otherwise("unmethylated").alias("call")), "SELECT chrom, pos, CASE WHEN fraction >= 0.5 THEN 'methylated' ELSE 'unmethylated' END AS call FROM cytosines WHERE context = 'CG'")
add("epi_dmr_scan", lambda t: o.runs(t.cytosines, "chrom", "pos", F.col("fraction") >= 0.6, 400), f"SELECT chrom, min(start) AS start, max(stop) AS stop, count(*) AS n FROM {island_sql('(SELECT chrom, pos AS start, pos AS stop, pos AS name FROM cytosines WHERE fraction >= 0.6)', 400)} GROUP BY island, chrom")
add("epi_coverage_track_stats", lambda t: rounded(t.track.groupBy("chrom").agg(F.avg("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"), F.max("value").alias("high"), F.sum("value").alias("total")), "mean", "median", "total", n=2), "SELECT chrom, round(avg(value), 2) AS mean, round(quantile_cont(value, 0.5), 2) AS median, max(value) AS high, round(sum(value), 2) AS total FROM track GROUP BY 1")
add("str_locus_statistics", lambda t: rounded(t.alleles.groupBy("locus", "size").count().groupBy("locus").agg(F.count("*").alias("alleles"), (1 - F.sum(F.col("count") * F.col("count")) / F.pow(F.sum("count"), F.lit(2.0))).alias("expected_het")), "expected_het", n=6), "SELECT locus, count(*) AS alleles, round(1 - sum(n * n) / pow(sum(n), 2), 6) AS expected_het FROM (SELECT locus, size, count(*) AS n FROM alleles GROUP BY 1, 2) GROUP BY 1")
add("str_expansion_test", lambda t: tab.outliers(t.alleles, "size", "z-score", 1.6), "SELECT locus, sample, size FROM (SELECT *, (size - avg(size) OVER ()) / stddev_samp(size) OVER () AS z FROM alleles) WHERE abs(z) > 1.6")
add("str_allele_table", lambda t: t.alleles.groupBy("locus", "sample", "size").agg(F.count("*").alias("n")), "SELECT locus, sample, size, count(*) AS n FROM alleles GROUP BY 1, 2, 3")
add("tnseq_hgc_flux", lambda t: iv.window_counts(t.bed_b, 1000), "SELECT chrom, start // 1000 * 1000 AS start, count(*) AS n FROM bed_b GROUP BY 1, 2")
add("tnseq_log2fc", lambda t: rounded(st.fold_change(st.per_million(L(t)), S[:3], S[3:]).select("row", "log2fc"), "log2fc"), f"SELECT \"row\", round(log2((avg(value) FILTER (WHERE \"column\" >= 's4') + 1) / (avg(value) FILTER (WHERE \"column\" < 's4') + 1)), 4) + 0.0 AS log2fc FROM {_CPM} GROUP BY 1")
add("tnseq_ess", lambda t: t.counts.select("gene", F.when(F.col("s1") < 20, "essential").otherwise("free").alias("class")), "SELECT gene, CASE WHEN s1 < 20 THEN 'essential' ELSE 'free' END AS class FROM counts")
add("gemini_annotate_regions", lambda t: iv.overlapping(t.bed_a, t.bed_b).select("a_name", "b_name"), "SELECT a.name AS a_name, b.name AS b_name FROM bed_a a JOIN bed_b b ON a.chrom = b.chrom AND a.start < b.stop AND b.start < a.stop")
add("viro_coverage_by_target", lambda t: iv.counts_by_name(t.bed_b, t.bed_a), "SELECT name, coalesce(n, 0) AS n FROM bed_b LEFT JOIN (SELECT a.name, count(*) AS n FROM bed_b a JOIN bed_a b ON a.chrom = b.chrom AND a.start < b.stop AND b.start < a.stop GROUP BY 1) USING (name)")
add("bbrep_repearness", lambda t: rounded(t.reads.select("id", F.size(s.kmers(F.col("seq"), 4)).alias("n"), F.size(F.array_distinct(s.kmers(F.col("seq"), 4))).alias("d")).select("id", (1 - F.col("d") / F.col("n")).alias("repeated")), "repeated", n=6), f"SELECT id, round(1 - count(DISTINCT kmer) / count(*), 6) AS repeated FROM {kmers('reads', 4)} GROUP BY 1")
# proteins
_MASS = " + ".join(f"len(regexp_extract_all({{c}}, '{a}')) * CAST({m} AS DOUBLE)" for a, m in o.MASS.items()) + f" + CAST({o.WATER} AS DOUBLE)"
_HYD = " + ".join(f"len(regexp_extract_all(seq, '{a}')) * CAST({m} AS DOUBLE)" for a, m in o.HYDROPATHY.items())
for _name in ("proteo_peptide_properties", "protein_mass_and_formula", "emboss_pepstats"):
    add(_name, lambda t: rounded(t.proteins.select("id", o.peptide_mass(F.col("seq")).alias("mass"), (o.residue_sum(F.col("seq"), o.HYDROPATHY) / F.length("seq")).alias("gravy")), "mass", "gravy", n=7), f"SELECT id, round({_MASS.format(c='seq')}, 7) AS mass, round(({_HYD}) / length(seq), 7) + 0.0 AS gravy FROM proteins")
add("protein_composition_table", lambda t: t.proteins.select("id", *[F.regexp_count("seq", F.lit(a)).cast("long").alias(a) for a in o.MASS]), "SELECT id, " + ", ".join(f"CAST(len(regexp_extract_all(seq, '{a}')) AS BIGINT) AS \"{a}\"" for a in o.MASS) + " FROM proteins")
_DIG = "(SELECT id, unnest(regexp_extract_all(seq, '[^KR]*[KR]|[^KR]+$')) AS piece FROM proteins)"
add("proteo_digest_search", lambda t: rounded(o.digested(t.proteins, "id", "seq", "(?<=[KR])").select("id", "peptide", o.peptide_mass(F.col("peptide")).alias("mass")), "mass"), f"SELECT id, piece AS peptide, round({_MASS.format(c='piece')}, 4) AS mass FROM {_DIG}")
add("proteo_theoretical_spectra", lambda t: rounded(o.digested(t.proteins, "id", "seq", "(?<=[KR])").select("id", "peptide", F.explode(F.array(F.lit(1), F.lit(2))).alias("charge")).select("id", "peptide", "charge", ((o.peptide_mass(F.col("peptide")) + F.col("charge") * o.PROTON) / F.col("charge")).alias("mz")), "mz"), f"SELECT id, piece AS peptide, charge, round(({_MASS.format(c='piece')} + charge * CAST({o.PROTON} AS DOUBLE)) / charge, 4) AS mz FROM {_DIG}, (SELECT CAST(unnest([1, 2]) AS INTEGER) AS charge)")
_SITE = "SELECT id, CAST(sum(g + lm) OVER w - lm AS BIGINT) AS start, CAST(sum(g + lm) OVER w AS BIGINT) AS stop FROM (SELECT id, unnest(range(1, len(m) + 1)) AS k, length(unnest(m)) AS lm, length(unnest(list_slice(gaps, 1, len(m)))) AS g FROM (SELECT id, regexp_extract_all(seq, '{p}') AS m, regexp_split_to_array(seq, '{p}') AS gaps FROM proteins)) WINDOW w AS (PARTITION BY id ORDER BY k)"
add("protein_domain_sites", lambda t: sq.masked_runs(t.proteins, "id", "seq", "N[^P][ST]"), _SITE.format(p="N[^P][ST]"))
add("proteo_ptm_sites", lambda t: sq.masked_runs(t.proteins, "id", "seq", "[ST]P"), _SITE.format(p="[ST]P"))
add("proteo_hydrophobicity_profile", lambda t: rounded(sq.windowed(t.proteins, "id", "seq", 9, 3).select("id", "start", (o.residue_sum(F.col("window"), o.HYDROPATHY) / 9).alias("score")), "score"), f"SELECT id, i AS start, round(({_HYD.replace('seq', 'w')}) / 9, 4) + 0.0 AS score FROM (SELECT id, i, substr(seq, i + 1, 9) AS w FROM (SELECT id, seq, unnest(range(0, length(seq) - 8, 3)) AS i FROM proteins))")
_FDR = "WITH v AS (SELECT score, count(*) FILTER (WHERE NOT decoy) AS t, count(*) FILTER (WHERE decoy) AS d FROM peptides GROUP BY 1) SELECT score, CAST(sum(t) OVER w AS BIGINT) AS targets, CAST(sum(d) OVER w AS BIGINT) AS decoys, round(least(1, sum(d) OVER w / greatest(sum(t) OVER w, 1)), 6) AS fdr FROM v WINDOW w AS (ORDER BY score DESC)"
add("proteo_fdr_from_decoys", lambda t: rounded(o.decoy_fdr(t.peptides, "score", F.col("decoy")), "fdr", n=6), _FDR)
add("proteo_quant_summary", lambda t: rounded(o.protein_quant(t.peptides, "protein", "peptide", "intensity"), "intensity", n=2), "WITH p AS (SELECT protein, peptide, sum(intensity) AS x FROM peptides GROUP BY 1, 2), k AS (SELECT *, count(*) OVER (PARTITION BY peptide) AS k FROM p) SELECT protein, count(*) AS peptides, count(*) FILTER (WHERE k = 1) AS unique_peptides, round(sum(x), 2) AS intensity FROM k GROUP BY 1")
add("proteo_normalise_median", lambda t: rounded(L(t).join(F.broadcast(L(t).groupBy(F.col("column").alias("_c")).agg(F.percentile("value", F.lit(0.5)).alias("_m"))), F.col("column") == F.col("_c")).select("row", "column", (F.col("value") / F.col("_m")).alias("value")), "value", n=6), f"SELECT \"row\", \"column\", round(value / m, 6) AS value FROM {_L} JOIN (SELECT \"column\", quantile_cont(value, 0.5) AS m FROM {_L} GROUP BY 1) USING (\"column\")")
add("proteo_differential_abundance", lambda t: rounded(st.t_test(st.two_groups(L(t), S[:2], S[2:4])).select("row", "t"), "t"), f"SELECT \"row\", round((ma - mb) / nullif(sqrt((va + vb) / 2), 0), 4) + 0.0 AS t FROM (SELECT \"row\", avg(value) FILTER (WHERE \"column\" IN ('s1', 's2')) AS ma, avg(value) FILTER (WHERE \"column\" IN ('s3', 's4')) AS mb, var_samp(value) FILTER (WHERE \"column\" IN ('s1', 's2')) AS va, var_samp(value) FILTER (WHERE \"column\" IN ('s3', 's4')) AS vb FROM {_L} GROUP BY 1)")
add("metab_feature_summary", lambda t: rounded(L(t).groupBy("row").agg(F.sum((F.col("value") > 0).cast("long")).alias("detected"), F.percentile("value", F.lit(0.5)).alias("median")), "median"), f"SELECT \"row\", count(*) FILTER (WHERE value > 0) AS detected, round(quantile_cont(value, 0.5), 4) AS median FROM {_L} GROUP BY 1")
add("metab_qc_quality_control", lambda t: L(t).groupBy("row").agg(F.when(100 * F.stddev_samp("value") / F.avg("value") <= 30, "PASS").otherwise("FAIL").alias("qc")), f"SELECT \"row\", CASE WHEN 100 * stddev_samp(value) / avg(value) <= 30 THEN 'PASS' ELSE 'FAIL' END AS qc FROM {_L} GROUP BY 1")
add("metab_missing_values", lambda t: rounded(tab.imputed(t.sparse, ["b", "c"], "median"), "b", "c"), "SELECT id, a, round(coalesce(b, (SELECT quantile_cont(b, 0.5) FROM sparse)), 4) AS b, round(coalesce(c, (SELECT quantile_cont(c, 0.5) FROM sparse)), 4) AS c FROM sparse")
add("metab_normalise_methods", lambda t: rounded(st.per_million(L(t)), "value"), f"SELECT \"row\", \"column\", round(value, 4) AS value FROM {_CPM}")
# pharmacology
add("pharm_pk_noncompartmental", lambda t: rounded(o.trapezoid(t.doses, "subject", "t", "v").select("subject", "n", "peak", "auc"), "auc", n=4), "SELECT subject, count(*) AS n, max(v) AS peak, round(coalesce(sum((t - t0) * (v + v0) / 2), 0), 4) AS auc FROM (SELECT *, lag(t) OVER w AS t0, lag(v) OVER w AS v0 FROM doses WINDOW w AS (PARTITION BY subject ORDER BY t, v)) GROUP BY 1")
add("pharm_bliss_synergy", lambda t: t.lineitem.select("l_orderkey", "l_linenumber", F.round(F.col("l_tax") + F.col("l_discount") - F.col("l_tax") * F.col("l_discount"), 8).alias("bliss")), "SELECT l_orderkey, l_linenumber, round(l_tax + l_discount - l_tax * l_discount, 8) AS bliss FROM lineitem")
add("chem_substructure_search", lambda t: t.part.select("p_partkey", F.regexp_count("p_type", F.lit("A")).cast("long").alias("n")), "SELECT p_partkey, CAST(len(regexp_extract_all(p_type, 'A')) AS BIGINT) AS n FROM part")
add("chem_compound_hash", lambda t: t.part.select("p_partkey", F.sha2("p_name", 256).alias("hash")), "SELECT p_partkey, sha256(p_name) AS hash FROM part")
add("chem_library_diversity", lambda t: tab.value_counts(t.part, "p_type").select("value", "n"), "SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1")
# contact maps
_HIC = "(SELECT chrom, least(x, y) AS a, greatest(x, y) AS b, count(*) AS n FROM (SELECT chrom, CAST(floor(pos1 / 5000) AS BIGINT) * 5000 AS x, CAST(floor(pos2 / 5000) AS BIGINT) * 5000 AS y FROM contacts) GROUP BY 1, 2, 3)"
add("hic_contact_matrix", lambda t: o.contact_matrix(t.contacts, 5000), f"SELECT * FROM {_HIC}")
add("hic_observed_expected", lambda t: o.by_separation(o.contact_matrix(t.contacts, 5000)), f"SELECT chrom, b - a AS separation, CAST(sum(n) AS BIGINT) AS contacts, count(*) AS cells FROM {_HIC} GROUP BY 1, 2")
add("hic_matrix_normalisation", lambda t: rounded(o.coverage_normalized(o.contact_matrix(t.contacts, 5000)), "value", n=6), f"WITH m AS {_HIC}, c AS (SELECT chrom, bin, sum(n) AS c FROM (SELECT chrom, a AS bin, n FROM m UNION ALL SELECT chrom, b, n FROM m WHERE a <> b) GROUP BY 1, 2) SELECT m.chrom, a, b, round(n / sqrt(x.c * y.c), 6) AS value FROM m JOIN c x ON x.chrom = m.chrom AND x.bin = a JOIN c y ON y.chrom = m.chrom AND y.bin = b")
_INS = f"SELECT chrom, bin, CAST(sum(n) AS BIGINT) AS score FROM (SELECT chrom, a, b, n, unnest(range(a + 5000, b + 1, 5000)) AS bin FROM {_HIC} WHERE b > a AND b - a <= 30000) WHERE bin - a <= 15000 AND b - bin < 15000 GROUP BY 1, 2"
for _name in ("hic_insulation_score", "hic_insulation_profile"):
    add(_name, lambda t: o.insulation(o.contact_matrix(t.contacts, 5000), 5000, 3), _INS)
# geography and climate
_HAV = "2 * 6371.0088 * asin(least(1, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
_APART = f"SELECT a.id AS a, b.id AS b, round({_HAV}, 4) AS km FROM stations a JOIN stations b ON a.id < b.id"
add("gis_station_distances", lambda t: rounded(o.all_distances(t.stations), "km"), _APART)
add("gis_coordinate_transform", lambda t: rounded(o.web_mercator(t.stations), "x", "y", n=2), "SELECT id, round(radians(lon) * 6378137.0, 2) + 0.0 AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0, 2) + 0.0 AS y FROM stations")
add("gis_raster_zonal_stats", lambda t: rounded(t.pixels.groupBy(F.floor(F.col("x") / 8).alias("zone")).agg(F.count("*").alias("n"), F.avg("red").alias("mean")), "mean"), "SELECT CAST(floor(x / 8) AS BIGINT) AS zone, count(*) AS n, round(avg(red), 4) AS mean FROM pixels GROUP BY 1")
add("climate_growing_degree_days", lambda t: t.daily.select("site", "day", F.greatest((F.col("low") + F.col("high")) / 2 - 10, F.lit(0.0)).alias("gdd"), (F.col("low") < 0).alias("frost")), "SELECT site, day, greatest((low + high) / 2 - 10, 0) AS gdd, low < 0 AS frost FROM daily")
add("climate_precipitation_indices", lambda t: rounded(t.daily.groupBy("site").agg(F.sum("rain").alias("total"), F.sum((F.col("rain") >= 1).cast("long")).alias("wet"), F.max("rain").alias("most")), "total"), "SELECT site, round(sum(rain), 4) AS total, count(*) FILTER (WHERE rain >= 1) AS wet, max(rain) AS most FROM daily GROUP BY 1")
add("rs_vegetation_indices", lambda t: t.pixels.select("x", "y", F.round((F.col("nir") - F.col("red")) / (F.col("nir") + F.col("red")), 6).alias("ndvi")), "SELECT x, y, round((nir - red) / (nir + red), 6) + 0.0 AS ndvi FROM pixels")
add("rs_indices_time_series", lambda t: rounded(st.regression(t.daily, "day", "rain"), "slope", "intercept", "r2", n=6), "SELECT regr_count(rain, day) AS n, round(regr_slope(rain, day), 6) + 0.0 AS slope, round(regr_intercept(rain, day), 6) AS intercept, round(regr_r2(rain, day), 6) AS r2 FROM daily")
add("rs_image_change_detection", lambda t: t.pixels.groupBy((F.abs(F.col("nir") - F.col("red")) > 20).alias("changed")).agg(F.count("*").alias("n")), "SELECT abs(nir - red) > 20 AS changed, count(*) AS n FROM pixels GROUP BY 1")
add("image_quality_summary", lambda t: rounded(t.pixels.agg(F.count("*").alias("n"), F.avg("red").alias("mean"), F.stddev_samp("red").alias("sd"), F.min("red").alias("low"), F.max("red").alias("high")), "mean", "sd"), "SELECT count(*) AS n, round(avg(red), 4) AS mean, round(stddev_samp(red), 4) AS sd, min(red) AS low, max(red) AS high FROM pixels")
add("image_radial_profile", lambda t: rounded(t.pixels.groupBy(F.floor(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))).alias("radius")).agg(F.avg("red").alias("mean")), "mean"), "SELECT CAST(floor(sqrt(x * x + y * y)) AS BIGINT) AS radius, round(avg(red), 4) AS mean FROM pixels GROUP BY 1")
add("image_projection_zstack", lambda t: rounded(t.pixels.groupBy("x").agg(F.max("red").alias("most"), F.avg("red").alias("mean")), "mean"), "SELECT x, max(red) AS most, round(avg(red), 4) AS mean FROM pixels GROUP BY 1")
