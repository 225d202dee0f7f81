"""Queries of the read operators: orders as reads, with duplicates by customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import FIXTURES
from ..catalog import register as add
from ..functions import sequences as s
from ..operators import sequences as o
from ..operators import tables as tab
from .sequences import _HEX, _N50, gc, kmers, n_of, rc
from .tables import rounded

_Q = "'0123456789abcdef', '#(-37:=@BCDEFGHI'"
FIXTURES["reads"] = (
    f"SELECT o_orderkey AS ln, 'r' || CAST(o_orderkey AS STRING) || ':' || CAST(o_custkey % 5 AS STRING) AS id, CASE WHEN o_custkey % 11 = 0 THEN 'N' ELSE '' END || substr(translate(md5(CAST(o_custkey AS STRING)), {_HEX}) || translate(md5(CAST(o_custkey % 13 AS STRING)), {_HEX}), 1, 40 + CAST(o_custkey % 20 AS INT)) AS seq, "
    f"CASE WHEN o_custkey % 11 = 0 THEN '#' ELSE '' END || substr(translate(md5(CAST(o_orderkey AS STRING)), {_Q}) || translate(md5(o_orderpriority), {_Q}), 1, 40 + CAST(o_custkey % 20 AS INT)) AS qual FROM orders"
)
FIXTURES["mates"] = "SELECT ln, id, reverse(translate(substr(seq, 20, 100) || 'ACGTACGTAC', 'ACGT', 'TGCA')) AS seq FROM reads"
_P = "[ord(c) - 33 for c in string_split(qual, '')]"
_MQ = f"(list_sum({_P}) / greatest(len({_P}), 1))"
_CYC = f"(SELECT id, i AS cycle, ord(substr(qual, i, 1)) - 33 AS v, substr(seq, i, 1) AS b FROM (SELECT *, unnest(range(1, length(qual) + 1)) AS i FROM reads))"
_QUALITY = f"SELECT cycle, count(*) AS n, round(avg(v), 6) AS mean, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, min(v) AS low, max(v) AS high FROM {_CYC} GROUP BY 1"


def mq():
    return s.mean_quality(F.col("qual"))



add("fastq_to_fasta", lambda t: t.reads.select(F.concat(F.lit(">"), "id", F.lit("\n"), "seq").alias("record")), "SELECT '>' || id || chr(10) || seq AS record FROM reads")
add("fastq_filter", lambda t: o.filtered(t.reads, 45, 58, 28.0, 0.01).select("id"), f"SELECT id FROM reads WHERE length(seq) BETWEEN 45 AND 58 AND {_MQ} >= 28.0 AND {n_of('N')} <= 0.01 * length(seq)")
add("fastq_trim_length", lambda t: o.trimmed(t.reads, F.lit(3), F.lit(30)).select("id", "seq", "qual"), "SELECT id, substr(seq, 4, 30) AS seq, substr(qual, 4, 30) AS qual FROM reads")
add("fastq_reverse_complement", lambda t: t.reads.select("id", s.revcomp(F.col("seq")).alias("seq"), F.reverse("qual").alias("qual")), f"SELECT id, {rc('seq')} AS seq, reverse(qual) AS qual FROM reads")
add("fastq_sort", lambda t: tab.ranked_lines(t.reads.select("id", "seq"), ["seq", "id"]), "SELECT id, seq, row_number() OVER (ORDER BY seq, id) AS position FROM reads")
add("fastq_split_pairs", lambda t: t.reads.groupBy(F.when(F.col("id").endswith(":1"), 1).when(F.col("id").endswith(":2"), 2).otherwise(0).alias("mate")).agg(F.count("*").alias("n")), "SELECT CASE WHEN suffix(id, ':1') THEN 1 WHEN suffix(id, ':2') THEN 2 ELSE 0 END AS mate, count(*) AS n FROM reads GROUP BY 1")
_JOIN = f"SELECT id, k AS overlap, seq || substr(m, k + 1) AS merged FROM (SELECT id, seq, m, max(k) AS k FROM (SELECT id, seq, m, unnest(range(11, least(length(seq), length(m)) + 1)) AS k FROM (SELECT reads.id, reads.seq, {rc('mates.seq')} AS m FROM reads JOIN mates USING (id))) WHERE right(seq, k) = left(m, k) GROUP BY ALL)".replace("GROUP BY ALL", "GROUP BY id, seq, m")
add("fastq_join_paired", lambda t: o.joined_pairs(t.reads, t.mates, 11), _JOIN)
add("fastq_bbmerge_report", lambda t: rounded(o.joined_pairs(t.reads, t.mates, 11).agg(F.count("*").alias("merged"), F.avg("overlap").alias("overlap"), F.avg(F.length("merged")).alias("insert")), "overlap", "insert"), f"SELECT count(*) AS merged, round(avg(overlap), 4) AS overlap, round(avg(length(merged)), 4) AS \"insert\" FROM ({_JOIN})")
add("fastqc_summary", lambda t: rounded(t.reads.agg(F.count("*").alias("reads"), F.sum(F.length("seq")).alias("bases"), F.min(F.length("seq")).cast("long").alias("shortest"), F.max(F.length("seq")).cast("long").alias("longest"), F.avg(mq()).alias("quality"), (100 * F.sum(s.count(F.col("seq"), "GC")) / F.sum(F.length("seq"))).alias("gc"), F.sum(s.count(F.col("seq"), "N")).alias("n")), "quality", "gc"),
    f"SELECT count(*) AS reads, CAST(sum(length(seq)) AS BIGINT) AS bases, min(length(seq)) AS shortest, max(length(seq)) AS longest, round(avg({_MQ}), 4) AS quality, round(100 * sum({n_of('GC')}) / sum(length(seq)), 4) AS gc, CAST(sum({n_of('N')}) AS BIGINT) AS n FROM reads")
add("fastq_per_base_quality", lambda t: rounded(o.cycle_quality(t.reads), "mean", n=6), _QUALITY)
add("fastq_fastx_toolkit_qc", lambda t: rounded(o.cycle_quality(t.reads), "mean", n=6).select("cycle", "n", "mean"), f"SELECT cycle, n, mean FROM ({_QUALITY})")
add("fastq_quality_hist", lambda t: o.cycles(t.reads).groupBy(F.col("value").alias("quality")).agg(F.count("*").alias("n")), f"SELECT v AS quality, count(*) AS n FROM {_CYC} GROUP BY 1")
add("fastq_n_stats", lambda t: o.cycles(t.reads, "seq").groupBy("cycle").agg(F.sum((F.col("value") == "N").cast("long")).alias("n")), f"SELECT cycle, count(*) FILTER (WHERE b = 'N') AS n FROM {_CYC} GROUP BY 1")
add("fastq_gc_distribution", lambda t: t.reads.groupBy(F.floor(s.percent(F.col("seq"), "GC") / 5).alias("bin")).agg(F.count("*").alias("n")), f"SELECT CAST(floor({gc()} / 5) AS BIGINT) AS bin, count(*) AS n FROM reads GROUP BY 1")
add("fastq_per_sequence_quality", lambda t: t.reads.groupBy(F.floor(mq()).alias("quality")).agg(F.count("*").alias("n")), f"SELECT CAST(floor({_MQ}) AS BIGINT) AS quality, count(*) AS n FROM reads GROUP BY 1")
add("fastq_bbnorm_qc", lambda t: t.reads.groupBy((F.floor(mq() / 5) * 5).alias("bin")).agg(F.count("*").alias("n")), f"SELECT CAST(floor({_MQ} / 5) AS BIGINT) * 5 AS bin, count(*) AS n FROM reads GROUP BY 1")
add("fastq_duplication_levels", lambda t: o.duplication(t.reads, 10), "SELECT least(n, 10) AS level, count(*) AS sequences, CAST(sum(n) AS BIGINT) AS reads FROM (SELECT count(*) AS n FROM reads GROUP BY upper(seq)) GROUP BY 1")
add("fastq_overrepresented", lambda t: rounded(o.overrepresented(t.reads, 0.1), "percent"), "SELECT upper(seq) AS seq, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM reads), 4) AS percent FROM reads GROUP BY 1 HAVING 100 * count(*) / (SELECT count(*) FROM reads) >= 0.1")
add("fastq_kmer_content", lambda t: t.reads.groupBy(F.substring("seq", 1, 5).alias("kmer")).agg(F.count("*").alias("n")), "SELECT substr(seq, 1, 5) AS kmer, count(*) AS n FROM reads GROUP BY 1")
add("fastq_encoding", lambda t: o.cycles(t.reads).agg((F.min("value") + 33).alias("low"), (F.max("value") + 33).alias("high")), f"SELECT min(v) + 33 AS low, max(v) + 33 AS high FROM {_CYC}")
add("fastq_tile_stats", lambda t: rounded(t.reads.groupBy(F.split_part("id", F.lit(":"), F.lit(2)).alias("tile")).agg(F.count("*").alias("n"), F.avg(mq()).alias("quality")), "quality"), f"SELECT split_part(id, ':', 2) AS tile, count(*) AS n, round(avg({_MQ}), 4) AS quality FROM reads GROUP BY 1")
add("fastq_read_length_distribution", lambda t: t.reads.groupBy(F.length("seq").cast("long").alias("length")).agg(F.count("*").alias("n")), "SELECT length(seq) AS length, count(*) AS n FROM reads GROUP BY 1")
_LOW = "[!-4]"
_CUTQ = f"(SELECT id, seq, qual, length(regexp_extract(qual, '^{_LOW}*')) AS l, length(regexp_extract(qual, '{_LOW}*$')) AS r FROM reads)"
_ENDS = lambda t: o.trimmed(t.reads, *s.good_ends(F.col("qual"), 20))
add("fastq_sliding_trim", lambda t: _ENDS(t).where(F.length("seq") >= 25).select("id", "seq", "qual"), f"SELECT id, substr(seq, l + 1, length(seq) - l - r) AS seq, substr(qual, l + 1, length(qual) - l - r) AS qual FROM {_CUTQ} WHERE length(seq) - l - r >= 25")
add("seqtk_trim_qual", lambda t: _ENDS(t).where(F.length("seq") >= 20).select("id", "seq"), f"SELECT id, substr(seq, l + 1, length(seq) - l - r) AS seq FROM {_CUTQ} WHERE length(seq) - l - r >= 20")
add("fastq_trim_ns", lambda t: o.trimmed(t.reads, F.length(F.regexp_extract("seq", "^N*", 0)), F.length(F.regexp_replace("seq", "^N+|N+$", ""))).select("id", "seq", "qual"), "SELECT id, regexp_replace(seq, '^N+|N+$', '', 'g') AS seq, substr(qual, length(regexp_extract(seq, '^N*')) + 1, length(regexp_replace(seq, '^N+|N+$', '', 'g'))) AS qual FROM reads")
add("fastq_trim_by_length", lambda t: o.filtered(t.reads, 45, 50).select("id"), "SELECT id FROM reads WHERE length(seq) BETWEEN 45 AND 50")
_AD = "AGATC"
_AT = "CASE WHEN instr(seq, 'AGATC') > 0 THEN instr(seq, 'AGATC') - 1 WHEN suffix(seq, 'AGAT') THEN length(seq) - 4 WHEN suffix(seq, 'AGA') THEN length(seq) - 3 ELSE length(seq) END"
add("fastq_cutadapt", lambda t: o.adapter_clipped(t.reads, _AD, 3).select("id", "clipped", "seq", "qual"), f"SELECT id, c < length(seq) AS clipped, substr(seq, 1, c) AS seq, substr(qual, 1, c) AS qual FROM (SELECT *, {_AT} AS c FROM reads)")
add("fastq_polyx_trim", lambda t: o.trimmed(t.reads, F.lit(0), F.length(F.regexp_replace("seq", "A{2,}$", ""))).select("id", "seq", "qual"), "SELECT id, regexp_replace(seq, 'AA+$', '') AS seq, substr(qual, 1, length(regexp_replace(seq, 'AA+$', ''))) AS qual FROM reads")
add("fastq_rrbs_trim", lambda t: t.reads.select("id", F.when(F.locate("CTAG", F.col("seq")) > 0, F.substring("seq", F.lit(1), F.locate("CTAG", F.col("seq")) - 1)).otherwise(F.col("seq")).alias("seq")), "SELECT id, CASE WHEN instr(seq, 'CTAG') > 0 THEN substr(seq, 1, instr(seq, 'CTAG') - 1) ELSE seq END AS seq FROM reads")
add("fastq_sortbylength", lambda t: tab.ranked_lines(t.reads.select("id", F.length("seq").cast("long").alias("length")), [F.desc("length"), "id"]), "SELECT id, length(seq) AS length, row_number() OVER (ORDER BY length(seq) DESC, id) AS position FROM reads")
add("fastq_collapser", lambda t: rounded(o.collapsed(t.reads, "ln"), "quality"), f"SELECT upper(seq) AS seq, count(*) AS n, round(avg({_MQ}), 4) AS quality, arg_min(id, ln) AS id FROM reads GROUP BY 1")
add("fastq_randomize", lambda t: tab.shuffled(t.reads.select("id"), ["id"]))
add("fastq_subsample", lambda t: tab.sample(t.reads.select("id"), ["id"], fraction=0.1))
_KC = f"(SELECT id, least(kmer, {rc('kmer')}) AS kmer FROM {kmers('reads', 21)})"
add("fastq_normalise", lambda t: o.normalised(t.reads, 21, 20.0), f"SELECT id, quantile_cont(n, 0.5) AS depth FROM {_KC} JOIN (SELECT kmer, count(*) AS n FROM {_KC} GROUP BY 1) USING (kmer) GROUP BY 1 HAVING quantile_cont(n, 0.5) <= 20")
add("fastq_error_rate", lambda t: rounded(t.reads.select("id", s.expected_errors(F.col("qual")).alias("errors")), "errors"), f"SELECT id, round(sum(pow(10, -v / 10)), 4) AS errors FROM {_CYC} GROUP BY 1")
add("fastq_prinseq", lambda t: o.collapsed(o.filtered(t.reads, 42, 0, 25.0, 0.0), "ln").select("id", "n"), f"SELECT arg_min(id, ln) AS id, count(*) AS n FROM reads WHERE length(seq) >= 42 AND {_MQ} >= 25 AND {n_of('N')} = 0 GROUP BY upper(seq)")
add("fastq_fastp", lambda t: o.filtered(o.adapter_clipped(t.reads, _AD, 3), 30, 0, 20.0).agg(F.count("*").alias("kept"), F.sum(F.col("clipped").cast("long")).alias("clipped")), f"SELECT count(*) AS kept, count(*) FILTER (WHERE cut) AS clipped FROM (SELECT c < length(seq) AS cut, substr(seq, 1, c) AS seq, substr(qual, 1, c) AS qual FROM (SELECT *, {_AT} AS c FROM reads)) WHERE length(seq) >= 30 AND {_MQ} >= 20")
add("fastq_qc_duplicate_report", lambda t: t.reads.groupBy(F.substring("seq", 1, 20).alias("key")).count().agg(F.count("*").alias("unique_keys"), F.sum("count").alias("reads")), "SELECT count(*) AS unique_keys, CAST(sum(n) AS BIGINT) AS reads FROM (SELECT count(*) AS n FROM reads GROUP BY substr(seq, 1, 20))")
add("fastq_bbsim_shard", lambda t: tab.ordinal(t.reads.select("id", "ln"), ["ln"], "nth").groupBy((F.col("nth") % 4).alias("shard")).agg(F.count("*").alias("n")), "SELECT nth % 4 AS shard, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY ln) AS nth FROM reads) GROUP BY 1")
add("fastq_bblearn_errors", lambda t: t.reads.select(F.explode(F.arrays_zip(s.phred(F.col("qual")).alias("q"), F.filter(F.split("seq", ""), lambda c: c != "").alias("b"))).alias("x")).groupBy("x.q").agg(F.count("*").alias("n"), F.sum((F.col("x.b") == "N").cast("long")).alias("ambiguous")), f"SELECT v AS q, count(*) AS n, count(*) FILTER (WHERE b = 'N') AS ambiguous FROM {_CYC} GROUP BY 1")
add("fastq_bbduk_contaminant", lambda t: o.contaminated(t.reads, t.repeated, 8), f"SELECT DISTINCT id FROM (SELECT id, least(kmer, {rc('kmer')}) AS kmer FROM {kmers('reads', 8)}) WHERE kmer IN (SELECT least(kmer, {rc('kmer')}) FROM {kmers('repeated', 8)})")
add("nanopore_stats", lambda t: rounded(o.n50(t.reads), "mean", "gc"), _N50.format(gc=n_of("GC"), t="reads"))
add("nanopore_filter", lambda t: o.filtered(t.reads, 50, 0, 27.0).select("id"), f"SELECT id FROM reads WHERE length(seq) >= 50 AND {_MQ} >= 27")
add("nanopore_read_table", lambda t: rounded(t.reads.select("id", F.length("seq").cast("long").alias("length"), mq().alias("quality"), s.percent(F.col("seq"), "GC").alias("gc")), "quality", "gc"), f"SELECT id, length(seq) AS length, round({_MQ}, 4) AS quality, round({gc()}, 4) AS gc FROM reads")
add("nanopore_quality_by_length", lambda t: rounded(t.reads.groupBy((F.floor(F.length("seq") / 5) * 5).alias("bin")).agg(F.count("*").alias("n"), F.avg(mq()).alias("quality")), "quality"), f"SELECT length(seq) // 5 * 5 AS bin, count(*) AS n, round(avg({_MQ}), 4) AS quality FROM reads GROUP BY 1")
add("nanopore_kmer_quals", lambda t: rounded(t.reads.select("qual", F.posexplode(s.kmers(F.col("seq"), 3)).alias("i", "kmer")).groupBy("kmer").agg(F.count("*").alias("n"), F.avg(s.mean_quality(F.substring("qual", F.col("i") + 1, F.lit(3)))).alias("quality")), "quality"), "SELECT substr(seq, i, 3) AS kmer, count(*) AS n, round(avg((ord(substr(qual, i, 1)) + ord(substr(qual, i + 1, 1)) + ord(substr(qual, i + 2, 1)) - 99) / 3), 4) AS quality FROM (SELECT *, unnest(range(1, length(seq) - 1)) AS i FROM reads) GROUP BY 1")
add("nanopore_fast5_proxy", lambda t: rounded(t.reads.select("id", F.explode(s.windows(F.col("qual"), 20, 20)).alias("start"), "qual").select("id", F.col("start").cast("long").alias("start"), s.mean_quality(F.substring("qual", F.col("start") + 1, F.lit(20))).alias("quality")), "quality"), f"SELECT id, start, round({_MQ}, 4) AS quality FROM (SELECT id, i AS start, substr(qual, i + 1, 20) AS qual FROM (SELECT id, qual, unnest(range(0, length(qual) - 19, 20)) AS i FROM reads))")
