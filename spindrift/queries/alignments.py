"""Queries of the alignment operators: line items as records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import FIXTURES
from ..catalog import register as add
from ..operators import alignments as o
from ..operators import intervals as iv
from ..operators import tables as tab
from .sequences import _HEX, gc
from .tables import rounded

FIXTURES["records_sam"] = (
    "SELECT 'q' || CAST(l_orderkey AS STRING) || '_' || CAST(l_partkey AS STRING) AS qname, CASE l_linenumber WHEN 1 THEN 99 WHEN 2 THEN 147 WHEN 3 THEN 16 WHEN 4 THEN 4 WHEN 5 THEN 1040 WHEN 6 THEN 256 ELSE 193 END AS flag, CASE WHEN l_linenumber = 4 THEN '*' ELSE 'chr' || CAST(1 + l_suppkey % 5 AS STRING) END AS rname, "
    "CASE WHEN l_linenumber = 4 THEN CAST(0 AS BIGINT) ELSE l_orderkey * 3 + 1 END AS pos, CAST(l_quantity AS INT) AS mapq, CASE WHEN l_linenumber = 4 THEN '*' WHEN l_partkey % 4 = 0 THEN '32M' WHEN l_partkey % 4 = 1 THEN '7S25M' WHEN l_partkey % 4 = 2 THEN '12M2D20M' ELSE '10M50N8M3I11M' END AS cigar, "
    f"CASE l_linenumber WHEN 1 THEN 100 + l_partkey % 300 WHEN 2 THEN -100 - l_partkey % 300 ELSE CAST(0 AS BIGINT) END AS tlen, translate(md5(CAST(l_partkey AS STRING)), {_HEX}) AS seq, l_partkey % 5 AS nm, 'rg' || CAST(l_suppkey % 3 AS STRING) AS rg FROM lineitem"
)
_OPS = "(SELECT *, CAST(regexp_extract(o, '[0-9]+') AS BIGINT) AS n, right(o, 1) AS op FROM (SELECT *, unnest(m) AS o, unnest(range(1, len(m) + 1)) AS k FROM (SELECT row_number() OVER () AS r, *, regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]') AS m FROM records_sam WHERE flag & 4 = 0)))"
_AT = f"(SELECT *, pos - 1 + coalesce(sum(CASE WHEN op IN ('M', 'D', 'N', '=', 'X') THEN n ELSE 0 END) OVER (PARTITION BY r ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM {_OPS})"
_BLOCKS = f"(SELECT qname, rname AS chrom, CAST(start AS BIGINT) AS start, CAST(start + n AS BIGINT) AS stop, CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END AS strand FROM {_AT} WHERE op IN ('M', '=', 'X'))"
_FLAGS = ", ".join(f"count(*) FILTER (WHERE flag & {v} <> 0) AS {k}" for k, v in o.BITS.items())

add("samtools_flagstat", lambda t: o.flagstat(t.records_sam), f"SELECT count(*) AS total, count(*) FILTER (WHERE flag & 4 = 0) AS mapped, {_FLAGS} FROM records_sam")
add("samtools_idxstats", lambda t: t.records_sam.groupBy("rname").agg(F.sum((~o.has("unmapped")).cast("long")).alias("mapped"), F.sum(o.has("unmapped").cast("long")).alias("unmapped")), "SELECT rname, count(*) FILTER (WHERE flag & 4 = 0) AS mapped, count(*) FILTER (WHERE flag & 4 <> 0) AS unmapped FROM records_sam GROUP BY 1")
add("samtools_depth", lambda t: iv.depth_by_place(o.blocks(t.records_sam)), f"SELECT chrom, p AS \"at\", count(*) AS depth FROM (SELECT chrom, unnest(range(start, stop)) AS p FROM {_BLOCKS}) GROUP BY 1, 2")
add("samtools_view", lambda t: o.view(t.records_sam, 20, 0, 1024, "chr2").select("qname", "flag", "pos"), "SELECT qname, flag, pos FROM records_sam WHERE mapq >= 20 AND flag & 1024 = 0 AND rname = 'chr2'")
add("samtools_view_count", lambda t: t.records_sam.groupBy("rname").agg(F.count("*").alias("n")), "SELECT rname, count(*) AS n FROM records_sam GROUP BY 1")
add("samtools_sort", lambda t: tab.ranked_lines(t.records_sam.select("rname", "pos", "qname", "flag", "cigar"), ["rname", "pos", "qname", "flag", "cigar"]), "SELECT *, row_number() OVER (ORDER BY rname, pos, qname, flag, cigar) AS position FROM (SELECT rname, pos, qname, flag, cigar FROM records_sam)")
add("samtools_merge", lambda t: tab.concatenate(t.records_sam.where("rg = 'rg0'"), t.records_sam.where("rg = 'rg1'")).select("qname", "flag", "rg"), "SELECT qname, flag, rg FROM records_sam WHERE rg IN ('rg0', 'rg1')")
_BEST = "SELECT rname, pos, flag & 16 <> 0 AS rev, min(struct_pack(q := -mapq, qname := qname, flag := flag)) AS best FROM records_sam WHERE flag & 4 = 0 GROUP BY 1, 2, 3"
add("samtools_markdup", lambda t: o.marked(t.records_sam).groupBy("duplicate").agg(F.count("*").alias("n")), f"SELECT dup AS duplicate, count(*) AS n FROM (SELECT a.flag & 4 = 0 AND struct_pack(q := -mapq, qname := qname, flag := a.flag) <> best AS dup FROM records_sam a LEFT JOIN ({_BEST}) b ON a.rname = b.rname AND a.pos = b.pos AND (a.flag & 16 <> 0) = rev) GROUP BY 1".replace("a.flag & 4 = 0 AND struct", "coalesce(a.flag & 4 = 0 AND struct").replace("<> best AS", "<> best, false) AS"))
add("samtools_rmdup_position", lambda t: t.records_sam.where(~o.has("unmapped")).groupBy("rname", "pos", o.has("reverse").alias("rev")).agg(F.max("mapq").alias("mapq")), "SELECT rname, pos, flag & 16 <> 0 AS rev, max(mapq) AS mapq FROM records_sam WHERE flag & 4 = 0 GROUP BY 1, 2, 3")
add("samtools_stats", lambda t: rounded(t.records_sam.agg(F.count("*").alias("records"), F.avg("mapq").alias("mapq"), F.avg(F.length("seq")).alias("length"), F.sum(o.span(F.col("cigar"), "M")).alias("matched")), "mapq", "length"), f"SELECT count(*) AS records, round(avg(mapq), 4) AS mapq, round(avg(length(seq)), 4) AS length, (SELECT CAST(sum(n) AS BIGINT) FROM {_OPS} WHERE op = 'M') AS matched FROM records_sam")
add("samtools_nm_distribution", lambda t: t.records_sam.groupBy("nm").agg(F.count("*").alias("n")), "SELECT nm, count(*) AS n FROM records_sam GROUP BY 1")
add("samtools_mapq_hist", lambda t: rounded(o.percent_by(t.records_sam, F.floor(F.col("mapq") / 10) * 10, "mapq"), "percent"), "SELECT mapq // 10 * 10 AS mapq, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM records_sam), 4) AS percent FROM records_sam GROUP BY 1")
add("samtools_tag_summary", lambda t: t.records_sam.groupBy(F.col("rg").alias("value")).agg(F.count("*").alias("n")), "SELECT rg AS value, count(*) AS n FROM records_sam GROUP BY 1")
add("samtools_addreplacerg", lambda t: t.records_sam.select("qname", "flag", F.lit("run1").alias("rg")), "SELECT qname, flag, 'run1' AS rg FROM records_sam")
add("samtools_fastq", lambda t: t.records_sam.where(~o.has("unmapped")).select(F.concat(F.lit("@"), "qname", F.lit("\n"), "seq").alias("record")), "SELECT '@' || qname || chr(10) || seq AS record FROM records_sam WHERE flag & 4 = 0")
add("samtools_downsample", lambda t: tab.sample(t.records_sam.select("qname", "flag"), ["qname"], fraction=0.5, seed=42))
_SEG = f"WITH e AS (SELECT chrom, start AS p, 1 AS d FROM {_BLOCKS} UNION ALL SELECT chrom, stop, -1 FROM {_BLOCKS}), s AS (SELECT chrom, p, sum(d) AS d FROM e GROUP BY 1, 2), r AS (SELECT chrom, p AS start, lead(p) OVER w AS stop, CAST(sum(d) OVER w AS BIGINT) AS depth FROM s WINDOW w AS (PARTITION BY chrom ORDER BY p)) SELECT * FROM r WHERE depth > 0 AND stop IS NOT NULL"
add("samtools_bedgraph", lambda t: iv.depth_segments(o.blocks(t.records_sam)), _SEG)
add("samtools_coverage_bed", lambda t: iv.depth_segments(o.blocks(t.records_sam)).where("depth between 2 and 10"), f"SELECT * FROM ({_SEG}) WHERE depth BETWEEN 2 AND 10")
_BIN = f"(SELECT chrom, bin * {{s}} AS start, sum(least(stop, (bin + 1) * {{s}}) - greatest(start, bin * {{s}})) / {{s}} AS depth FROM (SELECT *, unnest(range(start // {{s}}, (stop - 1) // {{s}} + 1)) AS bin FROM {_BLOCKS}) GROUP BY chrom, bin)"
add("samtools_coverage_histogram", lambda t: rounded(o.depth_bins(t.records_sam, 500), "depth"), f"SELECT chrom, start, round(depth, 4) AS depth FROM {_BIN.format(s=500)}")
add("deeptools_bamcoverage", lambda t: rounded(o.depth_bins(t.records_sam, 1000).crossJoin(F.broadcast(t.records_sam.where(~o.has("unmapped")).agg(F.count("*").alias("all")))).select("chrom", "start", (F.col("depth") * 1e6 / F.col("all")).alias("depth")), "depth"), f"SELECT chrom, start, round(depth * 1e6 / (SELECT count(*) FROM records_sam WHERE flag & 4 = 0), 4) AS depth FROM {_BIN.format(s=1000)}")
_GROUP = lambda g: _BIN.format(s=1000).replace("records_sam", f"(SELECT * FROM records_sam WHERE rg = '{g}')")
add("deeptools_bamcompare", lambda t: rounded(o.compared(o.depth_bins(t.records_sam.where("rg = 'rg0'"), 1000), o.depth_bins(t.records_sam.where("rg = 'rg1'"), 1000)), "log2"), f"SELECT coalesce(a.chrom, b.chrom) AS chrom, coalesce(a.start, b.start) AS start, round(log2((coalesce(a.depth, 0) + 1) / (coalesce(b.depth, 0) + 1)), 4) + 0.0 AS log2 FROM {_GROUP('rg0')} a FULL JOIN {_GROUP('rg1')} b ON a.chrom = b.chrom AND a.start = b.start")
add("deeptools_multibamsummary", lambda t: o.blocks(t.records_sam.withColumn("qname", F.col("rg"))).groupBy("chrom", (F.floor(F.col("start") / 1000) * 1000).alias("start")).agg(*[F.sum(F.when(F.col("qname") == g, F.col("stop") - F.col("start")).otherwise(0)).alias(g) for g in ("rg0", "rg1", "rg2")]), "SELECT chrom, start // 1000 * 1000 AS start, " + ", ".join(f"CAST(sum(CASE WHEN qname = '{g}' THEN stop - start ELSE 0 END) AS BIGINT) AS {g}" for g in ("rg0", "rg1", "rg2")) + f" FROM {_BLOCKS.replace('SELECT qname,', 'SELECT rg AS qname,', 1)} GROUP BY 1, 2")
add("samtools_insert_size_hist", lambda t: t.records_sam.where("tlen > 0").groupBy((F.floor(F.col("tlen") / 25) * 25).alias("bin")).agg(F.count("*").alias("n")), "SELECT tlen // 25 * 25 AS bin, count(*) AS n FROM records_sam WHERE tlen > 0 GROUP BY 1")
_FRAG = "SELECT count(*) AS n, round(avg(tlen), 4) AS mean, round(stddev_samp(tlen), 4) AS sd, quantile_cont(tlen, 0.5) AS median, min(tlen) AS low, max(tlen) AS high FROM records_sam WHERE tlen > 0"
for _name in ("deeptools_bam_fragmentsize", "fastq_bbinsert_check"):
    add(_name, lambda t: rounded(o.fragment_summary(t.records_sam), "mean", "sd"), _FRAG)
add("samtools_tlen_scatter", lambda t: t.records_sam.where("tlen > 0").select("rname", "pos", "tlen"), "SELECT rname, pos, tlen FROM records_sam WHERE tlen > 0")
add("samtools_softclip_stats", lambda t: t.records_sam.withColumn("x", F.explode(o.operations(F.col("cigar")))).where("x.op = 'S' and x.n >= 5").groupBy("rname").agg(F.count("*").alias("n"), F.sum("x.n").alias("bases")), f"SELECT rname, count(*) AS n, CAST(sum(n) AS BIGINT) AS bases FROM {_OPS} WHERE op = 'S' AND n >= 5 GROUP BY 1")
add("samtools_cigar_summary", lambda t: t.records_sam.select(F.explode(o.operations(F.col("cigar"))).alias("x")).groupBy("x.op").agg(F.sum("x.n").alias("bases"), F.count("*").alias("n")), f"SELECT op, CAST(sum(n) AS BIGINT) AS bases, count(*) AS n FROM {_OPS} GROUP BY 1")
add("samtools_junctions", lambda t: o.gaps(t.records_sam), f"SELECT rname AS chrom, CAST(start AS BIGINT) AS start, CAST(start + n AS BIGINT) AS stop, CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END AS strand, count(*) AS n FROM {_AT} WHERE op = 'N' GROUP BY 1, 2, 3, 4")
FIXTURES["features"] = "SELECT chrom, start, stop + 200 AS stop, name FROM bed_b"
add("samtools_feature_counts", lambda t: o.assigned(t.records_sam, t.features), f"WITH h AS (SELECT a.qname, min(b.name) AS lo, max(b.name) AS hi FROM {_BLOCKS} a JOIN features b ON a.chrom = b.chrom AND a.start < b.stop AND b.start < a.stop GROUP BY 1) SELECT CASE WHEN lo IS NULL THEN '__none' WHEN lo <> hi THEN '__ambiguous' ELSE lo END AS feature, count(*) AS n FROM (SELECT DISTINCT qname FROM records_sam WHERE flag & 4 = 0) LEFT JOIN h USING (qname) GROUP BY 1")
add("samtools_read_distribution", lambda t: o.assigned(t.records_sam, t.features).groupBy(F.when(F.col("feature").startswith("__"), F.col("feature")).otherwise("feature").alias("class")).agg(F.sum("n").alias("n")), f"WITH h AS (SELECT a.qname, min(b.name) AS lo, max(b.name) AS hi FROM {_BLOCKS} a JOIN features b ON a.chrom = b.chrom AND a.start < b.stop AND b.start < a.stop GROUP BY 1) SELECT CASE WHEN lo IS NULL THEN '__none' WHEN lo <> hi THEN '__ambiguous' ELSE 'feature' END AS class, count(*) AS n FROM (SELECT DISTINCT qname FROM records_sam WHERE flag & 4 = 0) LEFT JOIN h USING (qname) GROUP BY 1")
add("samtools_inner_distance", lambda t: rounded(t.records_sam.where("tlen > 0").groupBy("rname").agg(F.avg("tlen").alias("mean"), F.stddev_samp("tlen").alias("sd")), "mean", "sd"), "SELECT rname, round(avg(tlen), 4) AS mean, round(stddev_samp(tlen), 4) AS sd FROM records_sam WHERE tlen > 0 GROUP BY 1")
add("samtools_gc_bias", lambda t: t.records_sam.groupBy(F.floor(F.regexp_count("seq", F.lit("[GC]")) * 100 / F.length("seq") / 10).alias("bin")).agg(F.count("*").alias("n")), f"SELECT CAST(floor({gc()} / 10) AS BIGINT) AS bin, count(*) AS n FROM records_sam GROUP BY 1")
add("samtools_alignment_summary", lambda t: rounded(t.records_sam.groupBy(F.when(o.has("read1"), "first").when(o.has("read2"), "second").otherwise("unpaired").alias("category")).agg(F.count("*").alias("n"), F.avg("nm").alias("nm")), "nm"), "SELECT CASE WHEN flag & 64 <> 0 THEN 'first' WHEN flag & 128 <> 0 THEN 'second' ELSE 'unpaired' END AS category, count(*) AS n, round(avg(nm), 4) AS nm FROM records_sam GROUP BY 1")
add("samtools_library_complexity", lambda t: rounded(o.duplicate_rate(t.records_sam), "rate", n=6), "SELECT mapped, places, mapped - places AS duplicates, round(1 - places / mapped, 6) AS rate FROM (SELECT count(*) AS mapped, count(DISTINCT (rname, pos, flag & 16 <> 0)) AS places FROM records_sam WHERE flag & 4 = 0)")
add("samtools_validate", lambda t: o.problems(t.records_sam), f"WITH l AS (SELECT r, any_value(length(seq)) AS w, sum(n) FILTER (WHERE op IN ('M', 'I', 'S', '=', 'X')) AS n FROM {_OPS} GROUP BY 1) SELECT * FROM (SELECT 'unmapped with quality' AS problem, count(*) AS n FROM records_sam WHERE flag & 4 <> 0 AND mapq > 0 UNION ALL SELECT 'cigar and sequence differ', count(*) FROM l WHERE n <> w UNION ALL SELECT 'both mates', count(*) FROM records_sam WHERE flag & 64 <> 0 AND flag & 128 <> 0) WHERE n > 0")
add("samtools_fingerprint", lambda t: rounded(o.cumulative_shares(t.records_sam.where(~o.has("unmapped")).groupBy("rname", F.floor(F.col("pos") / 1000).alias("bin")).agg(F.count("*").alias("depth")), "depth"), "share", n=6), "WITH b AS (SELECT rname, pos // 1000 AS bin, count(*) AS depth FROM records_sam WHERE flag & 4 = 0 GROUP BY 1, 2), e AS (SELECT depth, count(*) AS n FROM b GROUP BY 1) SELECT depth, n, round(sum(depth * n) OVER (ORDER BY depth) / (SELECT sum(depth) FROM b), 6) AS share FROM e")
add("samtools_fixmate", lambda t: o.mates(t.records_sam), "SELECT qname, a.rname AS rname, a.pos AS pos, b.rname AS mate_rname, b.pos AS mate_pos FROM (SELECT qname, min(struct_pack(rname := rname, pos := pos)) FILTER (WHERE flag & 64 <> 0) AS a, min(struct_pack(rname := rname, pos := pos)) FILTER (WHERE flag & 128 <> 0) AS b FROM records_sam WHERE flag & 1 <> 0 GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL")
add("samtools_read_bam_nx", lambda t: t.records_sam.where(~o.has("unmapped")).select("qname", "flag", "rname", "pos", o.span(F.col("cigar")).alias("span")), f"SELECT qname, flag, rname, pos, CAST(sum(CASE WHEN op IN ('M', 'D', 'N', '=', 'X') THEN n ELSE 0 END) AS BIGINT) AS span FROM {_OPS} GROUP BY r, qname, flag, rname, pos")
add("bedtools_bamtobed", lambda t: o.blocks(o.view(t.records_sam, 20, 0, 1796)), f"SELECT * FROM {_BLOCKS.replace('records_sam WHERE', 'records_sam WHERE mapq >= 20 AND flag & 1796 = 0 AND')}")
add("samtools_bam_sanity", lambda t: t.records_sam.agg(F.when(F.avg(o.has("unmapped").cast("double")) <= 0.5, "PASS").otherwise("FAIL").alias("unmapped"), F.when(F.avg(o.has("proper").cast("double")) >= 0.2, "PASS").otherwise("FAIL").alias("proper")), "SELECT CASE WHEN avg(CAST(flag & 4 <> 0 AS DOUBLE)) <= 0.5 THEN 'PASS' ELSE 'FAIL' END AS unmapped, CASE WHEN avg(CAST(flag & 2 <> 0 AS DOUBLE)) >= 0.2 THEN 'PASS' ELSE 'FAIL' END AS proper FROM records_sam")
add("mapq_filter", lambda t: o.view(t.records_sam, 30).select("qname", "flag", "mapq"), "SELECT qname, flag, mapq FROM records_sam WHERE mapq >= 30")
