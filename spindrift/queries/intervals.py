"""Queries of the interval operators: lineitem and orders as intervals on seven chromosomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import FIXTURES
from ..catalog import register as add
from ..operators import intervals as o
from ..operators.tables import ranked_lines
from .tables import rounded

FIXTURES["bed_a"] = "SELECT 'chr' || CAST(l_linenumber AS STRING) AS chrom, l_orderkey * 10 AS start, l_orderkey * 10 + CAST(l_quantity AS BIGINT) AS stop, 'a' || CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) || '_' || CAST(l_partkey AS STRING) || '_' || CAST(l_suppkey AS STRING) || '_' || CAST(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS STRING) AS name, l_extendedprice AS score, CASE l_returnflag WHEN 'A' THEN '+' WHEN 'R' THEN '-' ELSE '.' END AS strand FROM lineitem"
FIXTURES["bed_b"] = "SELECT 'chr' || CAST(1 + o_custkey % 7 AS STRING) AS chrom, o_orderkey * 10 + 5 AS start, o_orderkey * 10 + 6 + o_custkey % 30 AS stop, 'b' || CAST(o_orderkey AS STRING) AS name, o_totalprice AS score, CASE o_orderstatus WHEN 'F' THEN '+' WHEN 'O' THEN '-' ELSE '.' END AS strand FROM orders"
FIXTURES["genome"] = "SELECT chrom, max(stop) + 1000 AS size FROM bed_a GROUP BY chrom"
FIXTURES["track"] = "SELECT chrom, start, stop, name, score AS value, score, strand FROM bed_b"
FIXTURES["chains"] = "SELECT chrom, CAST(0 AS BIGINT) AS t_start, CAST(floor(size / 2) AS BIGINT) AS t_stop, size AS offset FROM genome"
_ON = "a.chrom = b.chrom AND a.start < b.stop AND b.start < a.stop"
_PART = f"SELECT a.chrom, greatest(a.start, b.start) AS start, least(a.stop, b.stop) AS stop, a.name, b.name AS b_name FROM bed_a a JOIN bed_b b ON {_ON}"


def islands(table: str, d: int, keys: str = "chrom") -> str:
    return f"(SELECT *, sum(fresh) OVER (ORDER BY {keys}, start, stop, name ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY {keys} ORDER BY start, stop, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {d} THEN 0 ELSE 1 END AS fresh FROM {table}))"


def merged(table: str, d: int = 0, keys: str = "chrom") -> str:
    return f"(SELECT {keys}, min(start) AS start, max(stop) AS stop, count(*) AS n, max(score) AS score FROM {islands(table, d, keys)} GROUP BY island, {keys})"


add("bedtools_intersect", lambda t: o.intersect(t.bed_a, t.bed_b), _PART)
add("bedtools_intersect_intervals_only", lambda t: o.overlapping(t.bed_a, t.bed_b, how="left_semi").select(*o.KEY, "name"), f"SELECT chrom, start, stop, name FROM bed_a a WHERE EXISTS (SELECT 1 FROM bed_b b WHERE {_ON})")
add("bedtools_intersect_v", lambda t: o.overlapping(t.bed_a, t.bed_b, how="left_anti").select(*o.KEY, "name"), f"SELECT chrom, start, stop, name FROM bed_a a WHERE NOT EXISTS (SELECT 1 FROM bed_b b WHERE {_ON})")
_SEG = """WITH p AS (SELECT chrom, start AS pos, 1 AS a, 0 AS b FROM {a} UNION ALL SELECT chrom, stop, -1, 0 FROM {a} UNION ALL SELECT chrom, start, 0, 1 FROM {b} UNION ALL SELECT chrom, stop, 0, -1 FROM {b}),
q AS (SELECT chrom, pos, sum(a) AS a, sum(b) AS b FROM p GROUP BY ALL),
r AS (SELECT chrom, pos AS start, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS stop, CAST(sum(a) OVER (PARTITION BY chrom ORDER BY pos) AS BIGINT) AS a, CAST(sum(b) OVER (PARTITION BY chrom ORDER BY pos) AS BIGINT) AS b FROM q)
SELECT * FROM r WHERE a + b > 0 AND stop IS NOT NULL"""
add("bedtools_multiinter", lambda t: o.segments({"a": t.bed_a, "b": t.bed_b}), _SEG.format(a=merged("bed_a"), b=merged("bed_b")))
add("bedtools_union_bed_graphs", lambda t: o.segments({"b": t.track, "c": t.bed_a.where("strand = '+'").withColumn("value", F.col("score"))}).withColumnRenamed("c", "a").select("chrom", "start", "stop", "a", "b"), _SEG.format(a=merged("(SELECT * FROM bed_a WHERE strand = '+')"), b=merged("bed_b")))
_CUT = f"""WITH m AS {merged("bed_b")}, h AS (SELECT DISTINCT a.chrom, a.start AS s0, a.stop AS e0, a.name, b.start AS s, b.stop AS e FROM bed_a a JOIN m b ON {_ON}),
pieces AS (SELECT chrom, coalesce(lag(e) OVER (PARTITION BY name ORDER BY s), s0) AS start, s AS stop, name FROM h UNION ALL SELECT chrom, max(e), e0, name FROM h GROUP BY chrom, name, e0)
SELECT * FROM pieces WHERE start < stop UNION ALL SELECT chrom, start, stop, name FROM bed_a WHERE name NOT IN (SELECT name FROM h)"""
add("bedtools_subtract", lambda t: o.subtract(t.bed_a, t.bed_b), _CUT)
add("bedtools_merge", lambda t: o.merge(t.bed_a), f"SELECT * FROM {merged('bed_a')}")
add("bedtools_cluster", lambda t: o.cluster(t.bed_b, 1).select("chrom", "name", "island_start", "island_stop", "n"), f"SELECT chrom, name, min(start) OVER (PARTITION BY island) AS island_start, max(stop) OVER (PARTITION BY island) AS island_stop, count(*) OVER (PARTITION BY island) AS n FROM {islands('bed_b', 1)}")
add("bedtools_links", lambda t: o.links(t.bed_b, 1), f"SELECT * FROM (SELECT chrom, lag(name) OVER (PARTITION BY island ORDER BY start, stop, name) AS before, name FROM {islands('bed_b', 1)}) WHERE before IS NOT NULL")
add("bedtools_window", lambda t: o.overlapping(t.bed_b, t.bed_a, slack=20).select("a_name", "b_name"), "SELECT a.name AS a_name, b.name AS b_name FROM bed_b a JOIN bed_a b ON a.chrom = b.chrom AND a.start - 20 < b.stop AND b.start < a.stop + 20")
_NEAR = """WITH o AS (SELECT a.name, 0 AS d, b.start AS s, b.stop AS e, b.name AS n FROM bed_b a JOIN bed_a b ON a.chrom = b.chrom AND a.start < b.stop AND b.start < a.stop),
l AS (SELECT a.name, a.start - b.stop + 1 AS d, b.start AS s, b.stop AS e, b.name AS n FROM bed_b a JOIN bed_a b ON a.chrom = b.chrom AND b.stop <= a.start AND b.stop > a.start - 400),
r AS (SELECT a.name, b.start - a.stop + 1 AS d, b.start AS s, b.stop AS e, b.name AS n FROM bed_b a JOIN bed_a b ON a.chrom = b.chrom AND b.start >= a.stop AND b.start < a.stop + 400),
every AS (SELECT * FROM o UNION ALL SELECT * FROM l UNION ALL SELECT * FROM r), best AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY d, s, e, n) AS k FROM every)
SELECT b.chrom, b.start, b.stop, b.name, coalesce(d, -1) AS distance, s AS b_start, e AS b_stop, n AS b_name FROM bed_b b LEFT JOIN best ON best.name = b.name AND k = 1"""
add("bedtools_closest", lambda t: o.closest(t.bed_b, t.bed_a), _NEAR)
add("bedtools_distance", lambda t: o.pair_distances(t.bed_b, t.bed_a, 25), "SELECT a.name AS a_name, b.name AS b_name, CASE WHEN b.stop <= a.start THEN b.stop - a.start - 1 WHEN b.start >= a.stop THEN b.start - a.stop + 1 ELSE 0 END AS distance FROM bed_b a JOIN bed_a b ON a.chrom = b.chrom AND a.start - 25 < b.stop AND b.start < a.stop + 25")
add("bedtools_complement", lambda t: o.complement(t.bed_b, t.genome),
    f"WITH m AS {merged('bed_b')}, x AS (SELECT m.chrom, start, least(stop, size) AS stop FROM m JOIN genome USING (chrom) WHERE start < size UNION ALL SELECT chrom, size, size FROM genome), y AS (SELECT chrom, coalesce(lag(stop) OVER (PARTITION BY chrom ORDER BY start, stop), 0) AS start, start AS stop FROM x) SELECT * FROM y WHERE start < stop")
_COVER = f"WITH m AS {merged('bed_a')}, h AS (SELECT a.name, count(*) AS hits FROM bed_b a JOIN bed_a b ON {_ON} GROUP BY 1), c AS (SELECT a.name, sum(least(a.stop, b.stop) - greatest(a.start, b.start)) AS covered FROM bed_b a JOIN m b ON {_ON} GROUP BY 1) SELECT a.chrom, a.start, a.stop, a.name, coalesce(hits, 0) AS hits, CAST(coalesce(covered, 0) AS BIGINT) AS covered, coalesce(covered, 0) / (a.stop - a.start) AS fraction FROM bed_b a LEFT JOIN h USING (name) LEFT JOIN c USING (name)"
add("bedtools_coverage", lambda t: o.coverage(t.bed_b, t.bed_a), _COVER)
add("bedtools_jaccard", lambda t: o.jaccard(t.bed_a, t.bed_b),
    f"WITH x AS {merged('bed_a')}, y AS {merged('bed_b')}, s AS (SELECT (SELECT sum(stop - start) FROM x) AS bases_a, (SELECT sum(stop - start) FROM y) AS bases_b, (SELECT sum(least(a.stop, b.stop) - greatest(a.start, b.start)) FROM x a JOIN y b ON {_ON}) AS intersection) SELECT CAST(bases_a AS BIGINT) AS bases_a, CAST(bases_b AS BIGINT) AS bases_b, CAST(intersection AS BIGINT) AS intersection, CAST(bases_a + bases_b - intersection AS BIGINT) AS \"union\", intersection / (bases_a + bases_b - intersection) AS jaccard FROM s")
add("bedtools_slop", lambda t: o.slop(t.bed_b, 100, genome=t.genome).select("chrom", "start", "stop", "name"), "SELECT b.chrom, greatest(0, start - 100) AS start, least(stop + 100, size) AS stop, name FROM bed_b b LEFT JOIN genome USING (chrom)")
add("bedtools_flank", lambda t: o.flank(t.bed_b, 50, 70), "SELECT * FROM (SELECT chrom, greatest(0, start - 50) AS start, start AS stop, name, 'left' AS side FROM bed_b UNION ALL SELECT chrom, stop, stop + 70, name, 'right' FROM bed_b) WHERE start < stop")
add("bedtools_shift", lambda t: o.shift(t.bed_b, 100).select("chrom", "start", "stop", "name"), "SELECT chrom, greatest(0, start + CASE WHEN strand = '-' THEN -100 ELSE 100 END) AS start, greatest(0, stop + CASE WHEN strand = '-' THEN -100 ELSE 100 END) AS stop, name FROM bed_b")
add("bedtools_scale", lambda t: o.scale(t.bed_b, t.genome, 1.5).select("chrom", "start", "stop", "name"), "SELECT b.chrom, CAST(greatest(0, floor((start + stop) / 2 - (stop - start) * 1.5 / 2)) AS BIGINT) AS start, CAST(least(size, floor((start + stop) / 2 + (stop - start) * 1.5 / 2)) AS BIGINT) AS stop, name FROM bed_b b LEFT JOIN genome USING (chrom)")
add("bedtools_shuffle", lambda t: o.relocated(t.bed_b, t.genome, ["name"]))
add("bedtools_random", lambda t: o.random_intervals(t.genome, 10, 200))
add("bedtools_binnify", lambda t: o.binnify(t.genome, 1000), "SELECT chrom, start, least(start + 1000, size) AS stop FROM (SELECT chrom, size, unnest(range(0, size, 1000)) AS start FROM genome)")
add("bedtools_tidy", lambda t: o.tidy(t.bed_b.select("chrom", F.col("stop").alias("start"), (F.col("start") - 100).alias("stop"), "name")), "SELECT chrom, greatest(0, start - 100) AS start, stop, name FROM bed_b")
add("bedtools_negativeb", lambda t: o.negative(t.bed_a, t.bed_b).select(*o.KEY, "name"), f"SELECT chrom, start, stop, name FROM bed_a WHERE (chrom, start, stop) NOT IN (SELECT (chrom, start, stop) FROM ({_PART}))")
add("bedtools_remove_overlaps", lambda t: o.without_overlaps(t.bed_b))
add("bedtools_intersect_bp", lambda t: o.overlap_totals(t.bed_a, t.bed_b), f"WITH p AS (SELECT chrom, start, stop, name || b_name AS name, 0 AS score FROM ({_PART})) SELECT count(*) AS pairs, CAST(sum(stop - start) AS BIGINT) AS pair_bases, (SELECT CAST(sum(stop - start) AS BIGINT) FROM {merged('p')}) AS merged_bases FROM p")
add("bedtools_bed_graph_to_bag", lambda t: rounded(o.rebinned(t.track, 1000), "mean"),
    "SELECT chrom, bin * 1000 AS start, CAST(sum(n) AS BIGINT) AS covered, round(sum(value * n) / sum(n), 4) AS mean, min(value) AS low, max(value) AS high FROM (SELECT chrom, bin, value, least(stop, (bin + 1) * 1000) - greatest(start, bin * 1000) AS n FROM (SELECT *, unnest(range(start // 1000, (stop - 1) // 1000 + 1)) AS bin FROM track)) GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY chrom, bin"))
add("bedtools_genomecov_binned", lambda t: rounded(o.mean_depth(t.track, 500), "depth", n=4),
    "SELECT chrom, bin * 500 AS start, round(sum(value * n) / 500, 4) AS depth FROM (SELECT chrom, bin, value, least(stop, (bin + 1) * 500) - greatest(start, bin * 500) AS n FROM (SELECT *, unnest(range(start // 500, (stop - 1) // 500 + 1)) AS bin FROM track)) GROUP BY chrom, bin")
add("bedtools_summarize", lambda t: rounded(o.length_summary(t.bed_a), "mean"), "SELECT chrom, count(*) AS n, CAST(sum(stop - start) AS BIGINT) AS bases, min(stop - start) AS shortest, round(avg(stop - start), 4) AS mean, max(stop - start) AS longest FROM bed_a GROUP BY 1")
add("bedtools_window_counts", lambda t: o.window_counts(t.bed_a, 1000), "SELECT chrom, start // 1000 * 1000 AS start, count(*) AS n FROM bed_a GROUP BY 1, 2")
add("bedtools_merge_counts", lambda t: o.touch_counts(t.bed_a, 1000), "SELECT chrom, bin * 1000 AS start, count(*) AS n FROM (SELECT chrom, unnest(range(start // 1000, greatest(start // 1000, (stop - 1) // 1000) + 1)) AS bin FROM bed_a) GROUP BY chrom, bin")
add("bedtools_blacklist_filter", lambda t: o.blacklisted(t.bed_b, t.bed_a, 0.5), f"SELECT chrom, start, stop, name FROM ({_COVER}) WHERE fraction <= 0.5")
add("bedtools_intersect_with_counts_by_name", lambda t: o.counts_by_name(t.bed_a, t.bed_b), f"SELECT name, coalesce(n, 0) AS n FROM (SELECT DISTINCT name FROM bed_a) LEFT JOIN (SELECT a.name, count(*) AS n FROM bed_a a JOIN bed_b b ON {_ON} GROUP BY 1) USING (name)")
add("bedtools_intersect_fractions", lambda t: o.coverage(t.bed_a, t.bed_b).select("name", "hits", "fraction"), f"WITH m AS {merged('bed_b')}, h AS (SELECT a.name, count(*) AS hits FROM bed_a a JOIN bed_b b ON {_ON} GROUP BY 1), c AS (SELECT a.name, sum(least(a.stop, b.stop) - greatest(a.start, b.start)) AS covered FROM bed_a a JOIN m b ON {_ON} GROUP BY 1) SELECT a.name, coalesce(hits, 0) AS hits, coalesce(covered, 0) / (a.stop - a.start) AS fraction FROM bed_a a LEFT JOIN h USING (name) LEFT JOIN c USING (name)")
add("bedtools_restrict_to", lambda t: o.overlapping(t.bed_b, t.bed_a, how="left_semi").select(*o.KEY, "name"), f"SELECT chrom, start, stop, name FROM bed_b a WHERE EXISTS (SELECT 1 FROM bed_a b WHERE {_ON})")
_TSS = "SELECT chrom, greatest(0, CASE WHEN strand = '-' THEN stop - 1 - 500 ELSE start - 1000 END) AS start, CASE WHEN strand = '-' THEN stop - 1 + 1000 ELSE start + 500 END AS stop, name, strand FROM bed_b"
add("bedtools_tss_list", lambda t: o.promoters(t.bed_b, 1000, 500), _TSS)
add("bedtools_metagene_profile", lambda t: o.metagene(t.bed_a, t.bed_b, 10, 50),
    "WITH g AS (SELECT chrom, CASE WHEN strand = '-' THEN stop - 1 ELSE start END AS tss, strand FROM bed_b), m AS (SELECT chrom, (start + stop) // 2 AS mid FROM bed_a) SELECT CAST(floor((mid - tss) * CASE WHEN strand = '-' THEN -1 ELSE 1 END / 10) AS BIGINT) * 10 AS bin, count(*) AS n FROM g JOIN m ON g.chrom = m.chrom AND tss - 50 < mid + 1 AND mid < tss + 1 + 50 GROUP BY 1")
_LIFT = "SELECT b.chrom, start + coalesce(\"offset\", 0) AS start, stop + coalesce(\"offset\", 0) AS stop, name, \"offset\" IS NOT NULL AS lifted FROM bed_b b LEFT JOIN chains c ON b.chrom = c.chrom AND start >= t_start AND start < t_stop"
FIXTURES["chains"] = "SELECT chrom, CAST(0 AS BIGINT) AS t_start, CAST(floor(size / 2) AS BIGINT) AS t_stop, size AS moved FROM genome"
_LIFT = _LIFT.replace('"offset"', "moved")
add("liftover_chain_bed", lambda t: o.lifted(t.bed_b, t.chains.withColumnRenamed("moved", "offset")), _LIFT)
add("liftover_chain_summary", lambda t: t.chains.groupBy("chrom").agg(F.count("*").alias("blocks"), F.sum(F.col("t_stop") - F.col("t_start")).alias("bases")), "SELECT chrom, count(*) AS blocks, CAST(sum(t_stop - t_start) AS BIGINT) AS bases FROM chains GROUP BY 1")
add("bedtools_firstline", lambda t: o.first_lines(t.bed_b.unionAll(t.bed_b.withColumn("name", F.concat("name", F.lit("_2"))))).select(*o.KEY, "name"), "SELECT chrom, start, stop, min(name) AS name FROM bed_b GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY chrom, start, stop"))
add("bedtools_zero_removal", lambda t: o.merge(t.track.where("value > 50000")).select(*o.KEY, "n"), f"SELECT chrom, start, stop, n FROM {merged('(SELECT * FROM track WHERE value > 50000)')}")
add("sort_genomic_ranges", lambda t: ranked_lines(t.bed_b.select(*o.KEY, "name"), [*o.KEY, "name"]), "SELECT chrom, start, stop, name, row_number() OVER (ORDER BY chrom, start, stop, name) AS position FROM bed_b")
