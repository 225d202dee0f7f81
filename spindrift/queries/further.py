"""Queries of neighbourhoods, sketches, spliced features, samples and terrain on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import FIXTURES
from ..catalog import register as add
from ..functions import sequences as s
from ..operators import alignment as seek
from ..operators import alignments as al
from ..operators import annotation as an
from ..operators import graphs as g
from ..operators import omics as o
from ..operators import statistics as st
from .omics import _HAV
from .sequences import _ORF, kmers, n_of, protein, rc
from .statistics import _L, _MW, A, B, L, S
from .tables import rounded

add("gis_nearest_neighbour", lambda t: rounded(g.nearest_points(t.stations, 3), "km"), f"SELECT a, rank, b, round(km, 4) AS km FROM (SELECT a.id AS a, b.id AS b, {_HAV} AS km, row_number() OVER (PARTITION BY a.id ORDER BY {_HAV}, b.id) AS rank FROM stations a JOIN stations b ON a.id <> b.id) WHERE rank <= 3")
add("climate_spatial_autocorrelation", lambda t: rounded(g.morans_i(t.stations.join(t.supplier.select("s_suppkey", "s_acctbal"), F.col("id") == F.col("s_suppkey")), "s_acctbal"), "i", n=6),
    f"WITH p AS (SELECT a.id AS a, b.id AS b, row_number() OVER (PARTITION BY a.id ORDER BY {_HAV}, b.id) AS rank FROM stations a JOIN stations b ON a.id <> b.id), m AS (SELECT avg(s_acctbal) AS m, count(*) AS n, var_pop(s_acctbal) AS v FROM supplier) SELECT any_value(n) AS n, round(avg((x.s_acctbal - m) * (y.s_acctbal - m)) / any_value(v), 6) AS i FROM p JOIN supplier x ON a = x.s_suppkey JOIN supplier y ON b = y.s_suppkey, m WHERE rank <= 3")


def propagated(rounds: int) -> str:
    """Label propagation by as many rounds of common table expressions."""
    parts = ["e AS MATERIALIZED (SELECT a AS x, b AS y FROM edges WHERE a <> b UNION ALL SELECT b, a FROM edges WHERE a <> b)", "l0 AS MATERIALIZED (SELECT DISTINCT x AS node, x AS label FROM e)"]
    for i in range(rounds):
        parts.append(f"l{i + 1} AS MATERIALIZED (SELECT node, label FROM (SELECT node, label, row_number() OVER (PARTITION BY node ORDER BY count(*) DESC, label) AS k FROM (SELECT x AS node, label FROM e JOIN l{i} ON y = node UNION ALL SELECT node, label FROM l{i}) GROUP BY node, label) WHERE k = 1)")
    return "WITH " + ", ".join(parts) + f" SELECT node, label AS community FROM l{rounds}"


add("network_communities", lambda t: g.communities(t.edges, "a", "b", 20), propagated(20))
add("scanpy_cluster_knn_graph", lambda t: g.knn_clusters(t.counts.select("gene", F.array(*S).alias("v")), "gene", "v", 5))
_SKETCH = f"(SELECT id, list_slice(list_sort(list(DISTINCT md5(least(kmer, {rc('kmer')})))), 1, 50) AS sketch FROM {kmers('records', 12)} GROUP BY id)"
add("mash_screen", lambda t: rounded(seek.mash_distances(t.records, t.records, 12, 50), "jaccard", "distance", n=6),
    f"WITH k AS {_SKETCH}, h AS (SELECT id, sketch, unnest(sketch) AS h FROM k), p AS (SELECT DISTINCT a.id AS query, b.id AS target, a.sketch AS x, b.sketch AS y FROM h a JOIN h b USING (h)), u AS (SELECT *, list_slice(list_sort(list_distinct(list_concat(x, y))), 1, 50) AS u FROM p), c AS (SELECT query, target, len(list_intersect(list_intersect(u, x), y)) AS shared, len(u) AS n FROM u) SELECT query, target, shared, round(shared / n, 6) AS jaccard, round(-ln(2 * (shared / n) / (1 + shared / n)) / 12, 6) + 0.0 AS distance FROM c WHERE shared > 0")
add("contamination_filter", lambda t: rounded(seek.screened(t.records, t.targets.where("ln % 3 = 0"), 12, 0.5), "share", n=6),
    f"WITH own AS (SELECT id, kmer, count(*) OVER (PARTITION BY id) AS n FROM (SELECT DISTINCT id, least(kmer, {rc('kmer')}) AS kmer FROM {kmers('records', 12)})), host AS (SELECT 't' || substr(id, 2) AS id, kmer FROM own WHERE CAST(substr(id, 2) AS BIGINT) % 3 = 0), x AS (SELECT a.id, b.id AS target, count(*) / any_value(a.n) AS share FROM own a JOIN host b USING (kmer) GROUP BY 1, 2), best AS (SELECT id, arg_max(target, struct_pack(s := share, t := target)) AS target, max(share) AS share FROM x GROUP BY 1 HAVING max(share) >= 0.5) SELECT r.id, CASE WHEN target IS NULL THEN 'kept' ELSE 'removed' END AS status, target, round(share, 6) AS share FROM records r LEFT JOIN best USING (id)")

#: Intervals of which many have no name, or one that others have.
FIXTURES["peaks"] = "SELECT chrom, start, stop, CASE WHEN start % 50 = 0 THEN NULL WHEN start % 70 = 0 THEN 'again' ELSE name END AS name FROM bed_a"
_TSS = "(SELECT seqid AS chrom, CASE WHEN strand = '-' THEN stop - 1 ELSE start - 1 END AS tss, min(id) AS gene FROM genes GROUP BY 1, 2)"
_NEAREST = f"""WITH p AS (SELECT row_number() OVER () AS r, * FROM peaks), s AS {_TSS}, l AS (SELECT p.r, p.start, p.stop, s.tss, s.gene FROM p ASOF JOIN s ON p.chrom = s.chrom AND p.start >= s.tss + 1),
r AS (SELECT p.r, p.start, p.stop, s.tss, s.gene FROM p ASOF JOIN s ON p.chrom = s.chrom AND p.stop <= s.tss), i AS (SELECT p.r, min(struct_pack(t := s.tss, g := s.gene)) AS x FROM p JOIN s ON p.chrom = s.chrom AND s.tss >= p.start AND s.tss < p.stop GROUP BY 1),
every AS (SELECT r, 0 AS d, x.t AS tss, x.g AS gene FROM i UNION ALL SELECT r, start - tss, tss, gene FROM l UNION ALL SELECT r, tss - stop + 1, tss, gene FROM r),
best AS (SELECT r, arg_min(gene, struct_pack(d := d, t := tss, g := gene)) AS gene, min(d) AS distance FROM every GROUP BY 1),
inside AS (SELECT DISTINCT p.r FROM p JOIN genes g ON g.seqid = p.chrom AND g.start - 1 < p.stop AND p.start < g.stop)
SELECT p.chrom, p.start, p.stop, p.name, CASE WHEN distance <= 10 THEN 'promoter' WHEN inside.r IS NOT NULL THEN 'intragenic' ELSE 'distal' END AS class, CAST(distance AS BIGINT) AS distance, gene FROM p LEFT JOIN best ON best.r = p.r LEFT JOIN inside ON inside.r = p.r"""
add("peak_gene_annotation", lambda t: an.nearest_genes(t.peaks, t.genes, 10), _NEAREST)
_GENES = """WITH p AS (SELECT row_number() OVER () AS r, * FROM peaks), g AS (SELECT seqid AS chrom, start - 1 AS s, stop AS e, id FROM genes),
o AS (SELECT r, 0 AS d, s, e, id FROM p JOIN g ON p.chrom = g.chrom AND s < p.stop AND p.start < e),
lo AS (SELECT chrom, e, min(struct_pack(s := s, e := e, id := id)) AS x FROM g GROUP BY 1, 2), hi AS (SELECT chrom, s, min(struct_pack(s := s, e := e, id := id)) AS x FROM g GROUP BY 1, 2),
l AS (SELECT r, p.start - lo.e + 1 AS d, x.s AS s, x.e AS e, x.id AS id FROM p ASOF JOIN lo ON p.chrom = lo.chrom AND p.start >= lo.e), h AS (SELECT r, hi.s - p.stop + 1 AS d, x.s AS s, x.e AS e, x.id AS id FROM p ASOF JOIN hi ON p.chrom = hi.chrom AND p.stop <= hi.s),
every AS (SELECT * FROM o UNION ALL SELECT * FROM l UNION ALL SELECT * FROM h), best AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, s, e, id) AS k FROM every)
SELECT p.chrom, p.start, p.stop, p.name, best.id AS gene, best.s AS gene_start, best.e AS gene_stop, CAST(d AS BIGINT) AS distance, d = 0 AS overlaps FROM p JOIN best ON best.r = p.r AND k = 1 WHERE d <= 30"""
add("gff3_nearest_gene", lambda t: an.genes_nearby(t.peaks, t.genes, 30), _GENES)
_B12 = "(SELECT seqid AS chrom, min(start) - 1 AS start, max(stop) AS stop, parent AS name, strand, count(*) AS blocks, string_agg(CAST(stop - start + 1 AS VARCHAR), ',' ORDER BY start, stop) AS sizes, string_agg(CAST(start AS VARCHAR), ',' ORDER BY start, stop) AS ends FROM exons WHERE parent IS NOT NULL GROUP BY seqid, parent, strand)"
add("convert_gff_to_bed", lambda t: an.bed12(t.exons), f"SELECT chrom, start, stop, name, strand, blocks, sizes, array_to_string(list_transform(string_split(ends, ','), lambda x: CAST(CAST(x AS BIGINT) - 1 - start AS VARCHAR)), ',') AS starts FROM {_B12}")
add("bedtools_bed12_blocks", lambda t: an.bed12_blocks(an.bed12(t.exons)), "SELECT seqid AS chrom, start - 1 AS start, stop, parent AS name, strand, row_number() OVER (PARTITION BY seqid, parent, strand ORDER BY start, stop) AS block FROM exons WHERE parent IS NOT NULL")
FIXTURES["coding"] = "SELECT id AS seqid, 'CDS' AS type, CAST(k * 24 + 1 AS BIGINT) AS start, CAST(k * 24 + 14 AS BIGINT) AS stop, CASE WHEN ln % 2 = 0 THEN '-' ELSE '+' END AS strand, id || '_' || CAST(k AS STRING) AS id, 'm' || id AS parent FROM records CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) x"
_SPLICED = "CASE WHEN ln % 2 = 0 THEN " + rc("(substr(seq, 1, 14) || substr(seq, 25, 14))") + " ELSE substr(seq, 1, 14) || substr(seq, 25, 14) END"
add("gff3_cds_translation", lambda t: an.cds_proteins(t.coding, t.records, False, 2), f"SELECT parent, length(protein) AS length, protein FROM (SELECT 'm' || id AS parent, regexp_replace({protein('spliced')}, '[*].*$', '') AS protein FROM (SELECT id, {_SPLICED} AS spliced FROM records)) WHERE length(protein) >= 2")

_DISP = f"WITH d AS (SELECT \"row\", avg(value) AS mean, var_samp(value) / avg(value) AS dispersion FROM {_L} GROUP BY 1 HAVING avg(value) > 0), e AS (SELECT " + ", ".join(f"quantile_cont(mean, {i} / 6.0) AS e{i}" for i in range(1, 6)) + " FROM d), b AS (SELECT d.*, " + " + ".join(f"CAST(mean > e{i} AS INT)" for i in range(1, 6)) + " AS bin FROM d, e), n AS (SELECT *, dispersion - quantile_cont(dispersion, 0.5) OVER (PARTITION BY bin) AS normalized FROM b) "
add("scanpy_highly_variable", lambda t: rounded(st.highly_variable(L(t), 6, 10), "dispersion", "normalized"), _DISP + "SELECT \"row\", round(dispersion, 4) AS dispersion, bin, round(normalized, 4) + 0.0 AS normalized FROM n ORDER BY n.normalized DESC, \"row\" LIMIT 10")
add("deeptools_normalize_per_read", lambda t: rounded(o.per_read(t.track, t.records_sam.where(~al.has("unmapped"))), "value", n=6), "SELECT chrom, start, stop, round(value * 1e6 / (SELECT count(*) FROM records_sam WHERE flag & 4 = 0), 6) AS value FROM track")
_SIZES = "(SELECT locus, max(low) FILTER (WHERE sample = 's0') AS a, max(high) FILTER (WHERE sample = 's0') AS b, max(low) FILTER (WHERE sample = 's1') AS c, max(high) FILTER (WHERE sample = 's1') AS d FROM (SELECT locus, sample, min(size) AS low, max(size) AS high FROM alleles WHERE sample IN ('s0', 's1') GROUP BY 1, 2) GROUP BY 1)"
add("str_profile_match", lambda t: o.profile_classes(t.alleles, "s0", "s1"), f"SELECT CASE WHEN a IS NULL OR c IS NULL THEN 'missing' WHEN a = c AND b = d THEN 'match' WHEN abs(a - c) <= 1 AND abs(b - d) <= 1 THEN 'off by tolerance' ELSE 'discordant' END AS class, count(*) AS loci FROM {_SIZES} GROUP BY 1")
add("presto_marker_auc", lambda t: rounded(st.rank_sum(L(t), A, B).select("row", (F.col("u") / (F.col("n") * F.col("m"))).alias("auc")), "auc", n=6), f"SELECT \"row\", round(u / 9, 6) AS auc FROM ({_MW.replace('round(u, 4) AS u', 'u AS u')})")
add("multiomics_cross_correlation", lambda t: rounded(st.cross_correlations(t.customer, t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("spent"), F.count("*").alias("n")), "c_custkey", ["c_acctbal", "c_nationkey"], ["spent", "n"]), "r", n=6),
    "WITH x AS (SELECT c_acctbal, c_nationkey, spent, n FROM customer JOIN (SELECT o_custkey, sum(o_totalprice) AS spent, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr({a}, {b}), 6) AS r FROM x" for a in ("c_acctbal", "c_nationkey") for b in ("spent", "n")))
add("meta_prevalence_filter", lambda t: rounded(st.prevalent(L(t), 0.6, 15.0), "prevalence", n=6), f"SELECT \"row\", count(*) FILTER (WHERE value > 15) AS samples, round(count(*) FILTER (WHERE value > 15) / 6, 6) AS prevalence FROM {_L} GROUP BY 1 HAVING count(*) FILTER (WHERE value > 15) / 6 >= 0.6")
_G = lambda p: "avg(value) FILTER (WHERE \"row\" IN (" + ", ".join(f"'g{i}'" for i in p) + "))"
add("scanpy_cell_cycle_score", lambda t: rounded(st.set_score(L(t), [f"g{i}" for i in range(1, 9)], [f"g{i}" for i in range(20, 27)]), "score_a", "score_b"), f"SELECT *, CASE WHEN greatest(score_a, score_b) <= 0 THEN 'none' WHEN score_a >= score_b THEN 'a' ELSE 'b' END AS phase FROM (SELECT \"column\", round({_G(range(1, 9))}, 4) AS score_a, round({_G(range(20, 27))}, 4) AS score_b FROM {_L} GROUP BY 1)")
add("rs_terrain_from_raster", lambda t: rounded(o.terrain(t.pixels, "red"), "slope", "aspect"), "WITH c AS (SELECT p.x, p.y, (e.red - w.red) / 2 AS p, (s.red - n.red) / 2 AS q FROM pixels p JOIN pixels e ON e.x = p.x + 1 AND e.y = p.y JOIN pixels w ON w.x = p.x - 1 AND w.y = p.y JOIN pixels s ON s.x = p.x AND s.y = p.y + 1 JOIN pixels n ON n.x = p.x AND n.y = p.y - 1) SELECT x, y, round(degrees(atan(sqrt(p * p + q * q))), 4) AS slope, round((degrees(atan2(q, p)) + 450) % 360, 4) AS aspect FROM c")
_CH = lambda n, k: f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"
add("meta_rarefaction", lambda t: rounded(o.rarefied(t.orders.groupBy("o_orderpriority", "o_custkey").agg(F.count("*").alias("c")), "o_orderpriority", "c", 50), "expected", n=3),
    f"WITH c AS (SELECT o_orderpriority, o_custkey, count(*) AS c FROM orders GROUP BY 1, 2), n AS (SELECT *, sum(c) OVER (PARTITION BY o_orderpriority) AS n, least(50, sum(c) OVER (PARTITION BY o_orderpriority)) AS d FROM c) SELECT o_orderpriority, CAST(max(n) AS BIGINT) AS n, count(*) AS observed, round(sum(1 - CASE WHEN n - c < d THEN 0 ELSE exp({_CH('(n - c)', 'd')} - {_CH('n', 'd')}) END), 3) AS expected FROM n GROUP BY 1")
add("stats_bootstrap_ci", lambda t: rounded(st.bootstrap_means(t.customer, "c_custkey", "c_acctbal", 500), "mean", "low", "high", n=3))
add("stats_power_analysis", lambda t: st.power_analysis(t.spark), "SELECT CAST(0.5 AS DOUBLE) AS effect, CAST(0.05 AS DOUBLE) AS alpha, CAST(0.8 AS DOUBLE) AS power, CAST(ceil(2 * pow((1.959963984540054 + 0.8416212335729143) / 0.5, 2)) AS BIGINT) AS n")
_LETTERS = "(SELECT id, CAST(sum(length(dna)) FILTER (WHERE strand = '+') AS BIGINT) AS f, CAST(sum(length(dna)) FILTER (WHERE strand = '-') AS BIGINT) AS b FROM (" + _ORF.replace(">= 30", ">= 33") + ") GROUP BY 1)"
add("emboss_geece", lambda t: rounded(an.coding_density(t.records, "id", "seq"), "forward", "reverse", "combined", "gt", "gc", n=6),
    f"SELECT r.id, length(seq) AS length, round(coalesce(f, 0) / length(seq), 6) AS forward, round(coalesce(b, 0) / length(seq), 6) AS reverse, round(least(coalesce(f, 0) + coalesce(b, 0), length(seq)) / length(seq), 6) AS combined, round({n_of('GT')} / length(seq), 6) AS gt, round({n_of('GC')} / length(seq), 6) AS gc FROM records r LEFT JOIN {_LETTERS} o ON o.id = r.id")
add("sc_matrix_to_long", lambda t: L(t).where("value <> 0").select(F.col("row").alias("gene"), F.col("column").alias("cell"), F.col("value").alias("count")), f"SELECT \"row\" AS gene, \"column\" AS cell, value AS count FROM {_L} WHERE value <> 0")
