"""Queries of path, assembly, permutation and greedy operators; most have no SQL and are held by brute-force tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import FIXTURES
from ..catalog import register as add
from ..operators import alignments as al
from ..operators import assembly, greedy, images, motifs, paths, profiles, segments, trees
from ..operators import permutations as p
from .alignments import _BLOCKS
from .sequences import _HEX, rc
from .statistics import A, B, L, S, _L
from .tables import rounded

# unitigs: a walk by recursion, which ends as the reads make no ring
add("debruijn_unitigs", lambda t: rounded(assembly.unitigs(t.reads, 15, 1, 40), "coverage"), f"""
WITH RECURSIVE each AS (SELECT least(kmer, {rc('kmer')}) AS kmer FROM (SELECT substr(upper(seq), CAST(i AS INT), 15) AS kmer FROM (SELECT seq, unnest(range(1, length(seq) - 13)) AS i FROM reads)) WHERE regexp_full_match(kmer, '[ACGT]+')),
kc AS (SELECT kmer, count(*) AS n FROM each GROUP BY 1), nodes AS (SELECT kmer AS node, n FROM kc UNION ALL SELECT {rc('kmer')}, n FROM kc),
pre AS (SELECT substr(node, 1, 14) AS lap, min(node) AS nxt FROM nodes GROUP BY 1 HAVING count(*) = 1), suf AS (SELECT substr(node, 2, 14) AS lap, min(node) AS node FROM nodes GROUP BY 1 HAVING count(*) = 1),
links AS (SELECT node, nxt FROM pre JOIN suf USING (lap) WHERE nxt <> {rc('node')}),
walk AS (
  SELECT node AS first, node AS last, node AS seq, n AS total, 1 AS kmers FROM nodes WHERE node NOT IN (SELECT nxt FROM links)
  UNION ALL SELECT first, links.nxt, seq || substr(links.nxt, 15, 1), total + nodes.n, kmers + 1 FROM walk JOIN links ON last = links.node JOIN nodes ON nodes.node = links.nxt
), whole AS (SELECT *, row_number() OVER (PARTITION BY first ORDER BY kmers DESC) AS nth FROM walk)
SELECT least(seq, {rc('seq')}) AS seq, length(seq) AS length, kmers, round(total / kmers, 4) AS coverage FROM whole WHERE nth = 1 AND first <= {rc('last')} AND length(seq) >= 40
""")
add("assembly_contigs_fasta", lambda t: assembly.contig_lines(assembly.unitigs(t.reads, 15, 1, 40)))
# exact permutations: twenty divisions of six samples
_SPLITS = "(SELECT m FROM (SELECT unnest(range(64)) AS m) WHERE bit_count(m) = 3)"
_VALUE = "(SELECT m, sum(abs(" + " - ".join("(" + " + ".join(f"CASE WHEN (m >> {i}) & 1 = {side} THEN CAST({s} AS DOUBLE) ELSE 0 END" for i, s in enumerate(S)) + ") / 3" for side in (0, 1)) + f")) AS v FROM counts, {_SPLITS} GROUP BY m)"
add("permutation_group_test", lambda t: rounded(p.group_test(t.counts, A, B, 500).select("observed", "null_mean", "null_sd", "permutations", "p"), "observed", "null_mean", "null_sd", "p", n=6),
    f"WITH v AS {_VALUE}, o AS (SELECT v AS seen FROM v WHERE m = 7) SELECT round(any_value(seen), 6) AS observed, round(avg(v), 6) AS null_mean, round(stddev_pop(v), 6) AS null_sd, count(*) AS permutations, round(count(*) FILTER (WHERE v >= seen - abs(seen) * 1e-9) / count(*), 6) AS p FROM v, o")
FIXTURES["gene_sets"] = "SELECT 'set' || CAST(l_suppkey % 5 AS STRING) AS gene_set, 'g' || CAST(l_partkey % 300 AS STRING) AS member FROM lineitem WHERE l_partkey % 300 % (l_suppkey % 5 + 3) = 0"
add("gsea_lite", lambda t: rounded(p.enrichment(t.counts.select("gene", (F.col("s1") - F.col("s4")).cast("double").alias("fold")), t.gene_sets, "gene", "fold"), "es", "normalised", "null_mean", "p", n=6))
# graphs
FIXTURES["trade"] = "SELECT 'c' || CAST(c_nationkey AS STRING) || c_mktsegment AS a, 's' || CAST(o_orderkey % 50 AS STRING) AS b FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderkey % 7 < 3"
add("network_betweenness", lambda t: rounded(paths.betweenness(t.trade, "a", "b", 200), "betweenness", "normalised", n=6))
add("monocle3_pseudotime", lambda t: rounded(paths.pseudotime(t.embeddings, "vec_id", "embedding"), "pseudotime", n=6))
_TIME = "(SELECT \"column\" AS c, sum(value) AS t FROM {L} GROUP BY 1)".replace("{L}", _L)
add("monocle3_correlated_genes", lambda t: rounded(paths.correlated_with(L(t), L(t).groupBy("column").agg(F.sum("value").alias("t"))), "correlation", n=6),
    f"WITH j AS (SELECT \"row\", value, t FROM {_L} JOIN {_TIME} ON \"column\" = c), r AS (SELECT \"row\", rank() OVER (PARTITION BY \"row\" ORDER BY value) + (count(*) OVER (PARTITION BY \"row\", value) - 1) / 2.0 AS x, rank() OVER (PARTITION BY \"row\" ORDER BY t) + (count(*) OVER (PARTITION BY \"row\", t) - 1) / 2.0 AS y FROM j), c AS (SELECT \"row\", count(*) AS n, CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END AS correlation FROM r GROUP BY 1) SELECT \"row\", n, round(correlation, 6) AS correlation FROM c WHERE correlation IS NOT NULL")
# greedy clusters of short tags, many of them one letter apart
FIXTURES["tags"] = f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN substr(t, 1, 5) || translate(substr(t, 6, 1), 'ACGT', 'CGTA') || substr(t, 7, 10) ELSE t END AS seq FROM (SELECT o_orderkey, substr(translate(md5(CAST(o_custkey % 211 AS STRING)), {_HEX}), 1, CAST(10 + o_custkey % 211 % 3 AS INT)) AS t FROM orders) x"
#: Centres by recursion in the order of counts.
_GREEDY = """
WITH RECURSIVE kc AS (SELECT upper(seq) AS seq, count(*) AS n FROM tags GROUP BY 1), ranked AS (SELECT row_number() OVER (ORDER BY n DESC, seq) AS rank, seq, n FROM kc),
near AS (SELECT a.rank AS first, b.rank AS rank FROM ranked a JOIN ranked b ON a.rank < b.rank AND length(a.seq) = length(b.seq) AND hamming(a.seq, b.seq) <= {allowed}),
lists AS (SELECT r.rank, list(near.first) FILTER (WHERE near.first IS NOT NULL) AS firsts FROM ranked r LEFT JOIN near USING (rank) GROUP BY 1),
pass AS (SELECT CAST(0 AS BIGINT) AS step, CAST([] AS BIGINT[]) AS centres UNION ALL SELECT step + 1, CASE WHEN list_has_any(centres, coalesce(firsts, [])) THEN centres ELSE list_append(centres, rank) END FROM pass JOIN lists ON rank = step + 1),
done AS (SELECT unnest(centres) AS centre FROM pass WHERE step = (SELECT max(step) FROM pass)),
of AS (SELECT r.rank, r.seq, r.n, coalesce((SELECT min(first) FROM near JOIN done ON first = centre WHERE near.rank = r.rank), r.rank) AS head FROM ranked r)
SELECT of.seq, of.n, c.seq AS centre, hamming(of.seq, c.seq) AS distance, size, CAST(total AS BIGINT) AS total FROM of JOIN ranked c ON c.rank = head JOIN (SELECT head, count(*) AS size, sum(n) AS total FROM of GROUP BY 1) s USING (head) WHERE total >= {least}
"""
add("meta_denoise_asvs", lambda t: greedy.denoised(t.tags, mismatches=1), _GREEDY.format(allowed=1, least=1))
add("sc_barcode_whitelist", lambda t: greedy.denoised(t.tags, mismatches=1, min_size=10), _GREEDY.format(allowed=1, least=10))
add("mothur_pre_cluster", lambda t: greedy.denoised(t.tags, rate=0.1), _GREEDY.format(allowed="floor(length(a.seq) * 0.1 + 1e-9)", least=1))
FIXTURES["mixed_names"] = "SELECT p_partkey AS k, p_name AS name FROM part UNION ALL SELECT n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region UNION ALL SELECT c_custkey, c_mktsegment FROM customer"
add("relaxed_cluster_rows", lambda t: greedy.name_clusters(t.mixed_names, "name", "k"))
# trees, segments and motifs
FIXTURES["nation_alignment"] = f"SELECT n_name AS id, translate(md5(n_name), {_HEX}) AS seq FROM nation"
add("phylo_bootstrap", lambda t: trees.bootstrap(t.nation_alignment, replicates=100))
add("phylo_consensus_tree", lambda t: trees.consensus(trees.bootstrap_trees(t.nation_alignment, replicates=100, method="upgma").select(F.lit("nations").alias("tree_group"), "newick")))
FIXTURES["depth_ratios"] = "SELECT a.chrom, a.pos, log2((a.dp + 1) / CAST(b.dp + 1 AS DOUBLE)) AS value FROM genotypes a JOIN genotypes b ON a.chrom = b.chrom AND a.pos = b.pos AND a.ref = b.ref AND a.alt = b.alt WHERE a.sample = 's0' AND b.sample = 's1'"
add("vcf_cnv_segmentation", lambda t: rounded(segments.copy_segments(t.depth_ratios), "mean", "copies"))
add("meme_discover_motifs", lambda t: rounded(motifs.motif_rows(motifs.discover(t.records, "id", "seq", 8), t.records), "a", "c", "g", "t", "information", "share", "objective"))
# images: a grid of bright spots, many of which touch at corners
FIXTURES["spots"] = "SELECT 'm' || CAST(CAST(floor(o_orderkey / 8192) AS INT) AS STRING) AS image, CAST(floor(o_orderkey / 128) % 64 AS BIGINT) AS y, CAST(o_orderkey % 128 AS BIGINT) AS x, floor(100 * sin((o_orderkey % 128) / CAST(3 AS DOUBLE)) * sin(floor(o_orderkey / 128) / CAST(3 AS DOUBLE))) + o_custkey % 7 AS value FROM orders"


def _cells(t):
    return images.measured(images.objects(images.foreground(t.spots), diagonal=False, min_area=5))


add("image_threshold_cells", lambda t: rounded(_cells(t).select("image", "object", "area", "y", "x", "mean", "solidity", "diameter"), "y", "x", "mean", "solidity", "diameter"))
add("image_measure_objects", lambda t: rounded(images.measured(images.objects(images.foreground(t.spots), diagonal=False, min_area=8)).select("image", "object", "area", "top", "left", "bottom", "right", "perimeter", "solidity", "eccentricity"), "solidity", "eccentricity"))
add("image_watershed_split", lambda t: rounded(images.watershed(images.foreground(t.spots)).groupBy("image", "basin").agg(F.count("*").alias("area"), F.max("distance").alias("height"), F.avg("y").alias("y"), F.avg("x").alias("x")), "y", "x"))
# signal over regions
_PIECES = "(SELECT r, name, CASE WHEN strand = '-' THEN {n} - 1 - i ELSE i END AS bin, chrom, start + (i * (stop - start)) // {n} AS start, start + ((i + 1) * (stop - start)) // {n} AS stop FROM (SELECT row_number() OVER () AS r, *, unnest(range({n})) AS i FROM {regions}))"
_MATRIX = "(SELECT p.r, p.name, p.bin, coalesce(sum((least(p.stop, t.stop) - greatest(p.start, t.start)) * t.value), 0) / (p.stop - p.start) AS value FROM " + _PIECES + " p LEFT JOIN {track} t ON p.chrom = t.chrom AND p.start < t.stop AND t.start < p.stop WHERE p.stop > p.start GROUP BY p.r, p.name, p.bin, p.start, p.stop)"
_COVER = f"(SELECT chrom, start, stop, CAST(1 AS DOUBLE) AS value FROM {_BLOCKS})"
FIXTURES["loci"] = "SELECT seqid AS chrom, start - 1 AS start, stop + 60 AS stop, id AS name, strand FROM genes"


def _covered(t):
    return al.blocks(t.records_sam).select("chrom", "start", "stop", F.lit(1.0).alias("value"))


add("deeptools_computeMatrix", lambda t: rounded(profiles.region_matrix(t.track, t.loci, 10).select("name", "bin", "value"), "value", n=6), "SELECT name, bin, round(value, 6) AS value FROM " + _MATRIX.format(n=10, regions="loci", track="track"))
add("deeptools_plotprofile", lambda t: rounded(profiles.profile(profiles.region_matrix(t.track, t.loci, 20)), "mean", "sem", n=3), "SELECT bin, count(*) AS n, round(avg(value), 3) AS mean, round(stddev_samp(value) / sqrt(count(*)), 3) AS sem FROM " + _MATRIX.format(n=20, regions="loci", track="track") + " GROUP BY 1")
add("samtools_metagene", lambda t: rounded(profiles.profile(profiles.region_matrix(_covered(t), t.loci, 20)), "mean", "sem", n=6), "SELECT bin, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value) / sqrt(count(*)), 6) AS sem FROM " + _MATRIX.format(n=20, regions="loci", track=_COVER) + " GROUP BY 1")
add("rseqc_gene_body_coverage", lambda t: rounded(profiles.body_coverage(profiles.region_matrix(_covered(t), t.loci, 50)), "total", "share"), "SELECT bin, round(total, 4) AS total, round(total / max(total) OVER (), 4) AS share FROM (SELECT bin, sum(value) AS total FROM " + _MATRIX.format(n=50, regions="loci", track=_COVER) + " GROUP BY 1)")
