"""Queries of the annotation, expression-language, single-cell and learning operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import FIXTURES
from ..catalog import register as add
from ..functions import sequences as s
from ..functions.expressions import expression
from ..operators import alignments as al
from ..operators import annotation as o
from ..operators import intervals as iv
from ..operators import omics as om
from ..operators import sequences as sq
from ..operators import statistics as st
from ..operators import tables as tab
from .intervals import _TSS, merged
from .sequences import _CODE, gc, n_of, protein, rc
from .statistics import _L, L
from .tables import rounded

FIXTURES["genes"] = "SELECT 'chr' || CAST(1 + o_custkey % 7 AS STRING) AS seqid, 'gene' AS type, o_orderkey * 10 + 6 AS start, o_orderkey * 10 + 6 + o_custkey % 30 AS stop, CASE o_orderstatus WHEN 'O' THEN '-' ELSE '+' END AS strand, 'g' || CAST(o_orderkey AS STRING) AS id, CAST(NULL AS STRING) AS parent, o_orderpriority AS biotype FROM orders"
FIXTURES["exons"] = "SELECT 'chr' || CAST(l_linenumber AS STRING) AS seqid, 'exon' AS type, l_orderkey * 10 + l_linenumber AS start, l_orderkey * 10 + l_linenumber + CAST(l_quantity AS BIGINT) AS stop, '+' AS strand, 'e' || CAST(l_orderkey AS STRING) || '_' || CAST(l_partkey AS STRING) AS id, 'g' || CAST(l_orderkey AS STRING) AS parent, l_shipdate AS day FROM lineitem"
FIXTURES["slices"] = "SELECT id AS chrom, ln % 10 AS start, ln % 10 + 20 AS stop, 'x' || id AS name, CASE WHEN ln % 2 = 0 THEN '-' ELSE '+' END AS strand FROM records"
FIXTURES["sites10"] = "SELECT ln, id, substr(seq, 1, 10) AS seq FROM records"
FIXTURES["hits"] = "SELECT o_custkey AS query, 'b' || CAST(o_orderkey % 50 AS STRING) AS subject, o_totalprice / 1000 AS bits, o_orderkey % 100 AS identity, o_orderkey AS k FROM orders"
FIXTURES["small_alignment"] = "SELECT n_nationkey AS ln, n_name AS id, substr(translate(md5(n_name), '0123456789abcdef', 'ACGTACGTTGCAACGT'), 1, 30) AS seq FROM nation"

add("filter_by_expression", lambda t: t.lineitem.where(expression("l_quantity > 45 and (l_discount * 100 >= 9 or not l_returnflag in ['A', 'N'])", t.lineitem.columns)).select("l_orderkey", "l_linenumber", "l_partkey"), "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity > 45 AND (l_discount * 100 >= 9 OR l_returnflag NOT IN ('A', 'N'))")
add("compute_expression_column", lambda t: t.part.select("p_partkey", F.round(expression("log2(p_retailprice + 1) / p_size - 2 ** 2 % 3", t.part.columns), 6).alias("value")), "SELECT p_partkey, round(log2(p_retailprice + 1) / p_size - pow(2, 2) % 3, 6) AS value FROM part")
add("get_data_create_dataset", lambda t: t.lines.agg(F.count("*").alias("n"), F.max(F.size(F.split("line", " "))).cast("long").alias("fields")), "SELECT count(*) AS n, CAST(max(len(string_split(line, ' '))) AS BIGINT) AS fields FROM lines")
add("get_data_format_probe", lambda t: t.lines.orderBy("ln").limit(1).select(F.when(F.col("line").startswith(">"), "fasta").when(F.col("line").startswith("@"), "fastq").when(F.col("line").startswith("##fileformat=VCF"), "vcf").otherwise("text").alias("format")), "SELECT 'text' AS format")
# features
add("gff3_check", lambda t: o.faults(t.genes.drop("biotype").unionByName(t.exons.drop("day"))), "WITH f AS (SELECT id, parent, start, stop FROM genes UNION ALL SELECT id, parent, start, stop FROM exons) SELECT * FROM (SELECT 'repeated id' AS fault, count(*) AS n FROM (SELECT id FROM f GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'missing parent', count(*) FROM f WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM f) UNION ALL SELECT 'coordinates', count(*) FROM f WHERE start > stop OR start < 1) WHERE n > 0")
add("gff3_feature_counts", lambda t: rounded(t.exons.groupBy("seqid").agg(F.count("*").alias("n"), F.sum(F.col("stop") - F.col("start") + 1).alias("bases"), F.avg(F.col("stop") - F.col("start") + 1).alias("mean")), "mean"), "SELECT seqid, count(*) AS n, CAST(sum(stop - start + 1) AS BIGINT) AS bases, round(avg(stop - start + 1), 4) AS mean FROM exons GROUP BY 1")
add("gff3_filter_attributes", lambda t: t.genes.where(F.col("biotype").rlike("URGENT")).select("id"), "SELECT id FROM genes WHERE regexp_matches(biotype, 'URGENT')")
add("gff3_to_bed", lambda t: o.to_bed(t.genes).drop("score"), "SELECT seqid AS chrom, start - 1 AS start, stop, id AS name, strand FROM genes")
add("bedtools_gff_to_bed", lambda t: o.to_bed(t.exons).select("chrom", "start", "stop"), "SELECT seqid AS chrom, start - 1 AS start, stop FROM exons")
add("gff3_gtf_convert", lambda t: o.line(t.genes, gtf=True), "SELECT seqid || chr(9) || 'spindrift' || chr(9) || type || chr(9) || CAST(start AS VARCHAR) || chr(9) || CAST(stop AS VARCHAR) || chr(9) || '.' || chr(9) || strand || chr(9) || '.' || chr(9) || 'gene_id \"' || id || '\";' AS line FROM genes")
add("gff3_infer_transcripts", lambda t: o.transcripts(t.exons), "SELECT parent, min(start) AS start, max(stop) AS stop, count(*) AS exons, CAST(sum(stop - start + 1) AS BIGINT) AS length FROM exons GROUP BY 1")
add("gff3_children_table", lambda t: t.genes.select(F.col("id").alias("gene")).join(t.exons.select("parent", F.col("id").alias("exon")), F.col("gene") == F.col("parent"), "left").select("gene", "exon"), "SELECT g.id AS gene, e.id AS exon FROM genes g LEFT JOIN exons e ON g.id = e.parent")
add("gff3_summary", lambda t: iv.merge(o.to_bed(t.genes)).agg(F.count("*").alias("loci"), F.sum(F.col("stop") - F.col("start")).alias("bases")), f"SELECT count(*) AS loci, CAST(sum(stop - start) AS BIGINT) AS bases FROM {merged('(SELECT seqid AS chrom, start - 1 AS start, stop, id AS name, 0 AS score FROM genes)')}")
for _name in ("gff3_tss_bed", "bedtools_genes_from_gff"):
    add(_name, lambda t: iv.promoters(t.bed_b, 1000, 500), _TSS)
add("gff3_biotype_table", lambda t: rounded(t.genes.groupBy("biotype").agg(F.count_distinct("id").alias("genes"), F.avg(F.col("stop") - F.col("start") + 1).alias("length")), "length"), "SELECT biotype, count(DISTINCT id) AS genes, round(avg(stop - start + 1), 4) AS length FROM genes GROUP BY 1")
add("gff3_compare", lambda t: iv.jaccard(o.to_bed(t.genes), o.to_bed(t.exons)).select("bases_a", "bases_b", "intersection"), f"WITH x AS {merged('(SELECT seqid AS chrom, start - 1 AS start, stop, id AS name, 0 AS score FROM genes)')}, y AS {merged('(SELECT seqid AS chrom, start - 1 AS start, stop, id AS name, 0 AS score FROM exons)')} SELECT CAST((SELECT sum(stop - start) FROM x) AS BIGINT) AS bases_a, CAST((SELECT sum(stop - start) FROM y) AS BIGINT) AS bases_b, CAST((SELECT sum(least(a.stop, b.stop) - greatest(a.start, b.start)) FROM x a JOIN y b ON a.chrom = b.chrom AND a.start < b.stop AND b.start < a.stop) AS BIGINT) AS intersection")
add("gff3_add_locus_tags", lambda t: tab.ordinal(t.genes.select("seqid", "start", "id"), ["seqid", "start", "id"], "n").select("id", F.concat(F.lit("L"), F.lpad(F.col("n").cast("string"), 8, "0")).alias("tag")), "SELECT id, 'L' || lpad(CAST(row_number() OVER (ORDER BY seqid, start, id) AS VARCHAR), 8, '0') AS tag FROM genes")
add("bedgraph_per_gene_signal", lambda t: rounded(iv.overlapping(o.to_bed(t.genes), t.track).groupBy(F.col("a_name").alias("gene")).agg(F.avg("b_value").alias("mean"), F.max("b_value").alias("high")), "mean", n=6), "SELECT g.id AS gene, round(avg(t.value), 6) AS mean, max(t.value) AS high FROM genes g JOIN track t ON g.seqid = t.chrom AND g.start - 1 < t.stop AND t.start < g.stop GROUP BY 1")
add("peak_grouper", lambda t: iv.merge(t.bed_a, 20).select(*iv.KEY, "n"), f"SELECT chrom, start, stop, n FROM {merged('bed_a', 20)}")
add("macs2_callpeak_lite", lambda t: iv.merge(iv.depth_segments(al.blocks(t.records_sam)).where("depth >= 5").select("chrom", "start", "stop", F.lit("p").alias("name"), F.col("depth").alias("score")), 30).select(*iv.KEY, "score"))
add("chipseq_qc_metrics", lambda t: rounded(al.duplicate_rate(t.records_sam).select("mapped", "rate"), "rate", n=6), "SELECT count(*) AS mapped, round(1 - count(DISTINCT (rname, pos, flag & 16 <> 0)) / count(*), 6) AS rate FROM records_sam WHERE flag & 4 = 0")
# slices of sequences
_CUT = f"CASE WHEN strand = '-' THEN {rc('substr(r.seq, start + 1, 20)')} ELSE substr(r.seq, start + 1, 20) END"
for _name in ("bedtools_getfasta", "convert_bed_to_fasta", "gff3_loci_to_fasta", "bedtools_getfasta_split"):
    add(_name, lambda t: o.slices(t.slices, t.records), f"SELECT name, {_CUT} AS seq FROM slices x JOIN records r ON x.chrom = r.id")
add("bedtools_nuc_content", lambda t: sq.composition(o.slices(t.slices, t.records)).select("name", "a", "c", "g", "t"), "SELECT name, " + ", ".join(f"{n_of(b.upper())} AS {b}" for b in "acgt") + f" FROM (SELECT name, {_CUT} AS seq FROM slices x JOIN records r ON x.chrom = r.id)")
add("bedtools_mask_from_genome", lambda t: t.slices.join(t.records.select("id", "seq"), F.col("chrom") == F.col("id")).select("id", F.overlay("seq", F.repeat(F.lit("N"), F.lit(20)), F.col("start").cast("int") + 1, F.lit(20)).alias("seq")), "SELECT id, substr(seq, 1, start) || repeat('N', 20) || substr(seq, start + 21) AS seq FROM slices JOIN records ON chrom = id")
FIXTURES["edits"] = "SELECT id, CAST(1 + ln % 30 AS INT) AS pos, substr('ACGT', CAST(1 + ln % 4 AS INT), 1) AS alt FROM records WHERE ln % 3 = 0"
add("viro_consensus_from_variants", lambda t: t.records.select("id", "seq").join(t.edits.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").select("id", F.when(F.col("pos").isNull(), F.col("seq")).otherwise(F.overlay("seq", "alt", "pos", F.lit(1))).alias("seq")), "SELECT r.id, CASE WHEN pos IS NULL THEN seq ELSE substr(seq, 1, pos - 1) || alt || substr(seq, pos + 1) END AS seq FROM records r LEFT JOIN edits e ON r.id = e.id")
add("emboss_transeq", lambda t: t.records.select("id", s.translated(F.col("seq")).alias("protein")), f"SELECT id, {protein('seq')} AS protein FROM records")
add("codon_usage_table", lambda t: rounded(o.codon_usage(t.records), "rscu", n=6),
    f"WITH c AS (SELECT substr(seq, i * 3 + 1, 3) AS codon FROM (SELECT seq, unnest(range(0, length(seq) // 3)) AS i FROM records)), n AS (SELECT codon, {_CODE}[codon] AS aa, count(*) AS n FROM c GROUP BY 1, 2) SELECT codon, aa, n, round(n * CASE " + " ".join(f"WHEN aa IN ({', '.join(repr(a) for a in sorted(set(s.CODE)) if s.CODE.count(a) == k)}) THEN {k}" for k in sorted({s.CODE.count(a) for a in set(s.CODE)})) + " END / sum(n) OVER (PARTITION BY aa), 6) AS rscu FROM n")
add("gc3_profile", lambda t: rounded(t.records.select("id", (100 * F.size(F.filter(s.windows(F.col("seq"), 3, 3), lambda i: F.substring(F.col("seq"), i + 3, F.lit(1)).isin("G", "C"))) / F.greatest(F.size(s.windows(F.col("seq"), 3, 3)), F.lit(1))).alias("gc3")), "gc3"), "SELECT id, round(100 * len(list_filter(range(0, length(seq) // 3), lambda i: substr(seq, i * 3 + 3, 1) IN ('G', 'C'))) / (length(seq) // 3), 4) AS gc3 FROM records")
for _name in ("motif_from_aligned_sites", "motif_summary"):
    add(_name, lambda t: o.position_matrix(t.sites10), "SELECT i - 1 AS position, " + ", ".join(f"count(*) FILTER (WHERE b = '{b}') AS {b.lower()}" for b in "ACGT") + " FROM (SELECT i, substr(seq, i, 1) AS b FROM (SELECT seq, unnest(range(1, length(seq) + 1)) AS i FROM sites10)) GROUP BY 1")
_PFM = [[8, 1, 1, 0], [0, 9, 0, 1], [1, 0, 9, 0], [0, 1, 0, 9]]
_LOG = " + ".join("CASE substr(w, {i}, 1) ".format(i=i + 1) + " ".join(f"WHEN '{b}' THEN log2(CAST({x + 0.5} AS DOUBLE) / {sum(row) + 2} / 0.25)" for b, x in zip("ACGT", row, strict=True)) + " END" for i, row in enumerate(_PFM))
_BESTW = " + ".join(f"log2(CAST({max(row) + 0.5} AS DOUBLE) / {sum(row) + 2} / 0.25)" for row in _PFM)
for _name in ("motif_scan_sequence", "motif_fimo_sites"):
    add(_name, lambda t: rounded(o.pwm_hits(t.records, "id", "seq", _PFM, 0.6), "score"), f"SELECT id, start, round(score, 4) AS score FROM (SELECT id, i AS start, {_LOG} AS score FROM (SELECT id, i, substr(seq, i + 1, 4) AS w FROM (SELECT id, seq, unnest(range(0, length(seq) - 3)) AS i FROM records))) WHERE score >= 0.6 * ({_BESTW})")
add("motif_count_degenerate", lambda t: t.records.select("id", F.regexp_count("seq", F.lit("[AG]CG[CT]")).cast("long").alias("n")), "SELECT id, CAST(len(regexp_extract_all(seq, '[AG]CG[CT]')) AS BIGINT) AS n FROM records")
_GUIDE = f"SELECT id, strand, substr(site, 1, 20) AS guide, round({gc('substr(site, 1, 20)')}, 4) AS gc FROM (SELECT id, strand, substr(dna, i, 23) AS site FROM (SELECT *, unnest(range(1, length(dna) - 21)) AS i FROM (SELECT id, '+' AS strand, seq AS dna FROM records UNION ALL SELECT id, '-', {rc('seq')} FROM records))) WHERE suffix(site, 'GG')"
add("crispr_find_targets", lambda t: rounded(o.guides(t.records, "id", "seq"), "gc"), _GUIDE)
add("crispr_grna_quality", lambda t: o.guides(t.records, "id", "seq").where("gc between 40 and 70 and not guide rlike 'TTTT'").select("id", "guide"), f"SELECT id, guide FROM ({_GUIDE}) WHERE gc BETWEEN 40 AND 70 AND NOT contains(guide, 'TTTT')")
add("base_editor_targets", lambda t: o.guides(t.records, "id", "seq").select("id", "guide", F.regexp_count(F.substring("guide", 4, 5), F.lit("C")).cast("long").alias("editable")).where("editable > 0"), f"SELECT * FROM (SELECT id, guide, CAST(len(regexp_extract_all(substr(guide, 4, 5), 'C')) AS BIGINT) AS editable FROM ({_GUIDE})) WHERE editable > 0")
for _name in ("genome_predict_orfs", "emboss_getorf"):
    add(_name, lambda t: sq.orfs(t.records, "id", "seq", 45).groupBy("id").agg(F.count("*").alias("n"), F.max(F.length("dna")).cast("long").alias("longest")))
# distances of small alignments
_D = " + ".join(f"CAST(substr(a.seq, {i}, 1) <> substr(b.seq, {i}, 1) AS INT)" for i in range(1, 31))
for _name in ("phylo_pairwise_distances", "mothur_dist_seqs", "viro_drift_distances", "convert_matrix_to_dist", "pairwise_identity_matrix"):
    add(_name, lambda t: rounded(o.distances(t.small_alignment), "p", "jc", n=6), f"SELECT a, b, round(p, 6) AS p, CASE WHEN p < 0.75 THEN round(-0.75 * ln(1 - 4 * p / 3), 6) END AS jc FROM (SELECT a.id AS a, b.id AS b, ({_D}) / 30 AS p FROM small_alignment a JOIN small_alignment b ON a.id < b.id)")
add("edit_distance_report", lambda t: t.nation.select(F.col("n_name").alias("a")).join(t.nation.select(F.col("n_name").alias("b")), F.col("a") < F.col("b")).select("a", "b", F.levenshtein("a", "b").cast("long").alias("d")), "SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name) AS d FROM nation a JOIN nation b ON a.n_name < b.n_name")
add("msa_format_convert", lambda t: t.small_alignment.select(F.concat(F.rpad("id", 16, " "), "seq").alias("line")), "SELECT rpad(id, 16, ' ') || seq AS line FROM small_alignment")
# hit tables
add("blast_best_hit_per_query", lambda t: t.hits.groupBy("query").agg(F.max(F.struct("bits", "k")).alias("x")).select("query", F.col("x.bits").alias("bits"), F.col("x.k").alias("k")), "SELECT query, max(bits) AS bits, arg_max(k, struct_pack(b := bits, k := k)) AS k FROM hits GROUP BY 1")
for _name in ("blast_identity_histogram", "identity_histogram"):
    add(_name, lambda t: t.hits.groupBy((F.floor(F.col("identity") / 5) * 5).alias("bin")).agg(F.count("*").alias("n")), "SELECT identity // 5 * 5 AS bin, count(*) AS n FROM hits GROUP BY 1")
add("blast_tabular_normalise", lambda t: t.hits.where("bits >= 50 and identity >= 30").select("query", "subject", "bits"), "SELECT query, subject, bits FROM hits WHERE bits >= 50 AND identity >= 30")
add("blast_make_database", lambda t: t.records.agg(F.count("*").alias("records"), F.sum(F.length("seq")).alias("letters")), "SELECT count(*) AS records, CAST(sum(length(seq)) AS BIGINT) AS letters FROM records")
add("insert_size_stats", lambda t: rounded(al.fragment_summary(t.records_sam), "mean", "sd"), "SELECT count(*) AS n, round(avg(tlen), 4) AS mean, round(stddev_samp(tlen), 4) AS sd, quantile_cont(tlen, 0.5) AS median, min(tlen) AS low, max(tlen) AS high FROM records_sam WHERE tlen > 0")
add("softclip_report", lambda t: t.records_sam.select("qname", "flag", al.span(F.col("cigar"), "S").alias("clip")).where("clip >= 5"), "SELECT qname, flag, CAST(regexp_extract(cigar, '([0-9]+)S', 1) AS BIGINT) AS clip FROM records_sam WHERE contains(cigar, 'S')")
add("unmapped_to_fastq", lambda t: t.records_sam.where(al.has("unmapped")).select(F.concat(F.lit("@"), "qname", F.lit("\n"), "seq").alias("record")), "SELECT '@' || qname || chr(10) || seq AS record FROM records_sam WHERE flag & 4 <> 0")
add("samtools_stats_lite", lambda t: al.flagstat(t.records_sam).select("total", "mapped", "duplicate"), "SELECT count(*) AS total, count(*) FILTER (WHERE flag & 4 = 0) AS mapped, count(*) FILTER (WHERE flag & 1024 <> 0) AS duplicate FROM records_sam")
add("rna_seq_mapping_qc", lambda t: al.flagstat(t.records_sam).select("total", "mapped", "proper", "secondary"), "SELECT count(*) AS total, count(*) FILTER (WHERE flag & 4 = 0) AS mapped, count(*) FILTER (WHERE flag & 2 <> 0) AS proper, count(*) FILTER (WHERE flag & 256 <> 0) AS secondary FROM records_sam")
add("rseqc_inner_distance", lambda t: t.records_sam.where("tlen <> 0").groupBy((F.floor(F.abs("tlen") / 25) * 25).alias("bin")).agg(F.count("*").alias("n")), "SELECT abs(tlen) // 25 * 25 AS bin, count(*) AS n FROM records_sam WHERE tlen <> 0 GROUP BY 1")
add("nanopore_run_stats", lambda t: rounded(sq.n50(t.reads), "mean", "gc").select("records", "bases", "n50"), "WITH l AS (SELECT length(seq) AS n, sum(length(seq)) OVER (ORDER BY length(seq) DESC, ln) AS c, sum(length(seq)) OVER () AS total FROM reads) SELECT count(*) AS records, CAST(sum(n) AS BIGINT) AS bases, max(n) FILTER (WHERE c >= total / 2) AS n50 FROM l")
add("nanopore_quality_profile", lambda t: rounded(sq.cycles(t.reads).groupBy("cycle").agg(F.avg("value").alias("quality")), "quality", n=6), "SELECT i AS cycle, round(avg(ord(substr(qual, i, 1)) - 33), 6) AS quality FROM (SELECT qual, unnest(range(1, length(qual) + 1)) AS i FROM reads) GROUP BY 1")
# single cells and scores
add("scanpy_qc_metrics", lambda t: rounded(L(t).groupBy("column").agg(F.sum("value").alias("umi"), F.sum((F.col("value") > 0).cast("long")).alias("genes")), "umi"), f"SELECT \"column\", round(sum(value), 4) AS umi, count(*) FILTER (WHERE value > 0) AS genes FROM {_L} GROUP BY 1")
add("scanpy_score_genes", lambda t: rounded(L(t).groupBy("column").agg((F.avg(F.when(F.col("row").startswith("g1"), F.col("value"))) - F.avg(F.when(~F.col("row").startswith("g1"), F.col("value")))).alias("score")), "score"), f"SELECT \"column\", round(avg(value) FILTER (WHERE prefix(\"row\", 'g1')) - avg(value) FILTER (WHERE NOT prefix(\"row\", 'g1')), 4) + 0.0 AS score FROM {_L} GROUP BY 1")
add("multiomics_rank_product", lambda t: rounded(tab.ordinal(tab.ordinal(t.part.select("p_partkey", "p_size", "p_retailprice"), [F.desc("p_retailprice"), "p_partkey"], "r1"), [F.desc("p_size"), "p_partkey"], "r2").select("p_partkey", F.sqrt(F.col("r1") * F.col("r2")).alias("rank")), "rank"), "SELECT p_partkey, round(sqrt(r1 * r2), 4) AS rank FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r1, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS r2 FROM part)")
add("multiomics_integrated_score", lambda t: t.part.select("p_partkey", F.round(F.col("p_size") * 0.3 + F.col("p_retailprice") * 0.7, 6).alias("score")), "SELECT p_partkey, round(p_size * 0.3 + p_retailprice * 0.7, 6) AS score FROM part".replace("0.3", "CAST(0.3 AS DOUBLE)").replace("0.7", "CAST(0.7 AS DOUBLE)"))
add("sc_collate_samples", lambda t: t.nation.select(F.lit("nation").alias("source"), F.col("n_name").alias("name")).unionAll(t.region.select(F.lit("region"), "r_name")), "SELECT 'nation' AS source, n_name AS name FROM nation UNION ALL SELECT 'region', r_name FROM region")
add("metab_adduct_annotate", lambda t: t.part.select("p_partkey", F.explode(F.array(*[F.struct(F.lit(n).alias("adduct"), F.lit(m).alias("shift")) for n, m in (("H", 1.007276), ("Na", 22.989218), ("K", 38.963158))])).alias("x"), "p_retailprice").select("p_partkey", "x.adduct", F.round(F.col("p_retailprice") - F.col("x.shift"), 6).alias("mass")), "SELECT p_partkey, adduct, round(p_retailprice - shift, 6) AS mass FROM part, (VALUES ('H', CAST(1.007276 AS DOUBLE)), ('Na', CAST(22.989218 AS DOUBLE)), ('K', CAST(38.963158 AS DOUBLE))) AS x(adduct, shift)")
add("metab_rt_alignment", lambda t: rounded(st.regression(t.lineitem, "l_quantity", "l_extendedprice").select("slope", "intercept"), "slope", "intercept"), "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem")
add("metab_blank_subtraction", lambda t: t.counts.select("gene", F.greatest(F.col("s1") - (F.col("s5") + F.col("s6")) / 2, F.lit(0.0)).alias("value")), "SELECT gene, greatest(s1 - (s5 + s6) / 2, 0) AS value FROM counts")
add("proteo_disulfide_pairs", lambda t: sq.masked_runs(t.proteins, "id", "seq", "C").select("id", "start", (F.col("start") - F.lag("start").over(Window.partitionBy("id").orderBy("start"))).alias("spacing")).where("spacing >= 3"), "SELECT id, start, spacing FROM (SELECT id, i - 1 AS start, i - lag(i) OVER (PARTITION BY id ORDER BY i) AS spacing FROM (SELECT id, seq, unnest(range(1, length(seq) + 1)) AS i FROM proteins) WHERE substr(seq, i, 1) = 'C') WHERE spacing >= 3")
add("fasta_encode_aa_props", lambda t: rounded(sq.windowed(t.proteins, "id", "seq", 5, 1).select("id", "start", (om.residue_sum(F.col("window"), om.HYDROPATHY) / 5).alias("score")), "score"), "SELECT id, i AS start, round((" + " + ".join(f"len(regexp_extract_all(w, '{a}')) * CAST({m} AS DOUBLE)" for a, m in om.HYDROPATHY.items()) + ") / 5, 4) + 0.0 AS score FROM (SELECT id, i, substr(seq, i + 1, 5) AS w FROM (SELECT id, seq, unnest(range(0, length(seq) - 4)) AS i FROM proteins))")
_PAIR = "SELECT DISTINCT locus, size FROM alleles WHERE sample = '{s}'"
add("lift_over_chain", lambda t: iv.lifted(t.bed_a, t.chains.withColumnRenamed("moved", "offset")), "SELECT b.chrom, start + coalesce(moved, 0) AS start, stop + coalesce(moved, 0) AS stop, name, moved IS NOT NULL AS lifted FROM bed_a b LEFT JOIN chains c ON b.chrom = c.chrom AND start >= t_start AND start < t_stop")
add("liftover_pdb_chain", lambda t: iv.lifted(t.sites.select("chrom", F.col("pos").alias("start"), F.col("pos").alias("stop"), F.col("k").cast("string").alias("name")), t.chains.withColumnRenamed("moved", "offset")).select("chrom", F.col("start").alias("pos"), "name", F.when(F.col("lifted"), "lifted").otherwise("kept").alias("status")), "SELECT s.chrom, pos + coalesce(moved, 0) AS pos, CAST(k AS VARCHAR) AS name, CASE WHEN moved IS NULL THEN 'kept' ELSE 'lifted' END AS status FROM sites s LEFT JOIN chains c ON s.chrom = c.chrom AND pos >= t_start AND pos < t_stop")
add("fastq_convert_illumina18", lambda t: t.reads.select("id", F.array_join(F.transform(s.phred(F.col("qual")), lambda q: F.char(F.least(q, F.lit(41)) + 64)), "").alias("qual")), "SELECT id, array_to_string([chr(CAST(least(ord(c) - 33, 41) + 64 AS INT)) for c in string_split(qual, '')], '') AS qual FROM reads")
add("fastq_to_sam_like", lambda t: t.reads.select(F.concat_ws("\t", "id", F.lit("4"), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"), F.lit("0"), F.lit("0"), "seq", "qual").alias("line")), "SELECT id || chr(9) || '4' || chr(9) || '*' || chr(9) || '0' || chr(9) || '0' || chr(9) || '*' || chr(9) || '*' || chr(9) || '0' || chr(9) || '0' || chr(9) || seq || chr(9) || qual AS line FROM reads")
