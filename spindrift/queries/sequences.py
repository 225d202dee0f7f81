"""Queries of the sequence operators: parts as records, with sequences spelled from digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import FIXTURES
from ..catalog import register as add
from ..functions import sequences as s
from ..operators import sequences as o
from ..operators import tables as tab
from .tables import rounded

_HEX = "'0123456789abcdef', 'ACGTACGTTGCAACGT'"
_DNA = " || ".join(f"translate(md5(CAST({{key}} AS STRING) || '{i}'), {_HEX})" for i in range(4))
FIXTURES["records"] = f"SELECT p_partkey AS ln, 'p' || CAST(p_partkey AS STRING) AS id, substr({_DNA.format(key='p_partkey')}, 1, 40 + CAST(p_size AS INT)) AS seq, p_name AS description FROM part"
FIXTURES["gapped"] = "SELECT ln, id, CASE WHEN ln % 3 = 0 THEN 'NN' || substr(seq, 1, 10) || 'NNN' || substr(seq, 11, 30) || 'N' WHEN ln % 3 = 1 THEN substr(seq, 1, 8) || '--' || lower(substr(seq, 9, 30)) ELSE seq END AS seq FROM records"
FIXTURES["aligned"] = "SELECT ln, id, substr(seq, 1, 30) AS seq FROM records"
FIXTURES["repeated"] = "SELECT s_suppkey AS ln, 's' || CAST(s_suppkey AS STRING) AS id, substr(translate(md5(CAST(s_nationkey AS STRING)), " + _HEX + "), 1, 20) AS seq FROM supplier"
FIXTURES["barcodes"] = "SELECT r_name AS name, substr(translate(md5(CAST(r_regionkey AS STRING)), " + _HEX + "), 1, 3) AS barcode FROM region"


def n_of(letters: str, c: str = "seq") -> str:
    return f"CAST(len(regexp_extract_all({c}, '(?i)[{letters}]')) AS BIGINT)"


def gc(c: str = "seq") -> str:
    return f"100.0 * {n_of('GC', c)} / greatest(length({c}), 1)"


def rc(c: str) -> str:
    return f"reverse(translate({c}, 'ACGTUacgtuRYKMBDHVrykmbdhv', 'TGCAAtgcaaYRMKVHDByrmkvhdb'))"


def kmers(table: str, k: int, c: str = "seq", extra: str = "id") -> str:
    return f"(SELECT {extra}, substr({c}, i, {k}) AS kmer FROM (SELECT *, unnest(range(1, length({c}) - {k} + 2)) AS i FROM {table}))"


add("fasta_filter_by_length", lambda t: t.records.where(F.length("seq").between(50, 80)).select("id"), "SELECT id FROM records WHERE length(seq) BETWEEN 50 AND 80")
add("fasta_head", lambda t: tab.head(t.records.select("ln", "id"), ["ln"], 5), "SELECT ln, id FROM records ORDER BY ln LIMIT 5")
add("fasta_tail", lambda t: tab.tail(t.records.select("ln", "id"), ["ln"], 5), "SELECT ln, id FROM records ORDER BY ln DESC LIMIT 5")
add("fasta_get_ids", lambda t: t.records.select("id", "description"), "SELECT id, description FROM records")
add("fasta_extract_by_ids", lambda t: tab.by_ids(t.records.select("ln", "id"), t.lineitem.where("l_quantity = 50").select("l_partkey"), "ln", "l_partkey"), "SELECT ln, id FROM records WHERE ln IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")
add("fasta_sort", lambda t: tab.ranked_lines(t.records.select("id", "seq"), [F.length("seq"), "id"]), "SELECT id, seq, row_number() OVER (ORDER BY length(seq), id) AS position FROM records")
add("fasta_gc_content", lambda t: rounded(o.composition(t.records).select("id", "length", "gc", "gc_skew", "at_skew"), "gc", "gc_skew", "at_skew", n=6),
    f"SELECT id, length(seq) AS length, round({gc()}, 6) AS gc, round(coalesce(({n_of('G')} - {n_of('C')}) / nullif({n_of('GC')}, 0), 0), 6) AS gc_skew, round(coalesce(({n_of('A')} - {n_of('T')}) / nullif({n_of('AT')}, 0), 0), 6) AS at_skew FROM records")
add("fasta_count_nucleotides", lambda t: o.composition(t.gapped).select("id", "a", "c", "g", "t", "n"), "SELECT id, " + ", ".join(f"{n_of(b.upper())} AS {b}" for b in "acgtn") + " FROM gapped")
add("fasta_nucleotide_frequencies", lambda t: o.base_totals(t.gapped), " UNION ALL ".join(f"SELECT '{b}' AS base, CAST(sum({n_of(b)}) AS BIGINT) AS n FROM gapped" for b in "ACGTN"))
add("fasta_complement", lambda t: t.gapped.select("id", s.revcomp(F.col("seq")).alias("seq")), f"SELECT id, {rc('seq')} AS seq FROM gapped")
add("fasta_uppercase", lambda t: tab.change_case(t.gapped.select("id", "seq"), "seq", "upper"), "SELECT id, upper(seq) AS seq FROM gapped")
add("fasta_replace_ids", lambda t: tab.renamed_values(t.records, "id", "x_", "_1"), "SELECT DISTINCT id AS old, 'x_' || id || '_1' AS new FROM records")
add("fasta_wrap", lambda t: tab.wrap(t.records, "id", "seq", 30), "SELECT id, CAST(i AS INT) AS piece, substr(seq, i * 30 + 1, 30) AS line FROM (SELECT id, seq, unnest(range(0, CAST(ceil(length(seq) / 30) AS BIGINT))) AS i FROM records)")
add("fasta_chop", lambda t: o.chopped(t.records, "id", "seq", 25, True), "SELECT id || '_' || CAST(i + 1 AS VARCHAR) AS id, substr(seq, i * 25 + 1, 25) AS seq FROM (SELECT id, seq, unnest(range(0, length(seq) // 25)) AS i FROM records)")
add("fasta_split_on_cases", lambda t: t.records.groupBy((F.col("ln") % 4).alias("part")).agg(F.count("*").alias("n"), F.min_by("id", "ln").alias("first")), "SELECT ln % 4 AS part, count(*) AS n, arg_min(id, ln) AS first FROM records GROUP BY 1")
add("fasta_split_by_size", lambda t: tab.ordinal(t.records.select("id", "ln"), ["ln"], "nth").select("id", F.floor((F.col("nth") - 1) / 3).alias("file")), "SELECT id, (row_number() OVER (ORDER BY ln) - 1) // 3 AS file FROM records")
add("fasta_get_length", lambda t: o.cumulative_length(t.records, "ln").select("id", "length", "cumulative"), "SELECT id, length(seq) AS length, CAST(sum(length(seq)) OVER (ORDER BY ln) AS BIGINT) AS cumulative FROM records")
_N50 = "WITH l AS (SELECT length(seq) AS n, {gc} AS g, row_number() OVER (ORDER BY length(seq) DESC, ln) AS k, sum(length(seq)) OVER (ORDER BY length(seq) DESC, ln) AS c, sum(length(seq)) OVER () AS total FROM {t}) SELECT count(*) AS records, CAST(sum(n) AS BIGINT) AS bases, min(n) AS shortest, max(n) AS longest, round(avg(n), 4) AS mean, round(100 * sum(g) / sum(n), 4) AS gc, max(n) FILTER (WHERE c >= total / 2) AS n50, min(k) FILTER (WHERE c >= total / 2) AS l50 FROM l"
add("fasta_statistics", lambda t: rounded(o.n50(t.records), "mean", "gc"), _N50.format(gc=n_of("GC"), t="records"))
add("fasta_to_table", lambda t: t.records.select("id", F.length("seq").cast("long").alias("length"), F.sha1("seq").alias("sha1")), "SELECT id, length(seq) AS length, sha1(seq) AS sha1 FROM records")
add("table_to_fasta", lambda t: t.records.select(F.concat(F.lit(">"), "id", F.lit(" "), "description", F.lit("\n"), "seq").alias("record")), "SELECT '>' || id || ' ' || description || chr(10) || seq AS record FROM records")
add("fasta_remove_gaps", lambda t: t.gapped.select("id", F.translate("seq", "-.", "").alias("seq")), "SELECT id, replace(replace(seq, '-', ''), '.', '') AS seq FROM gapped")
add("fasta_clean_n", lambda t: t.gapped.select("id", F.regexp_replace("seq", "^N+|N+$", "").alias("seq")), "SELECT id, regexp_replace(seq, '^N+|N+$', '', 'g') AS seq FROM gapped")
add("fasta_trim", lambda t: t.records.select("id", F.substring("seq", F.lit(6), F.length("seq") - 8).alias("seq")), "SELECT id, substr(seq, 6, length(seq) - 8) AS seq FROM records")
add("fasta_reverse_sequences", lambda t: tab.ordinal(t.records.select("id", "ln", F.reverse("seq").alias("seq")), [F.desc("ln")], "position").drop("ln"), "SELECT id, reverse(seq) AS seq, row_number() OVER (ORDER BY ln DESC) AS position FROM records")
add("fasta_dedupe", lambda t: o.deduplicated(t.repeated, "ln", "canonical"), f"SELECT least(upper(seq), {rc('upper(seq)')}) AS key, count(*) AS copies, arg_min(id, ln) AS id FROM repeated GROUP BY 1")
_CODE = "MAP {" + ", ".join(f"'{c}': '{a}'" for c, a in s.CODONS.items()) + "}"



def protein(c: str) -> str:
    return f"array_to_string([coalesce({_CODE}[substr({c}, i * 3 + 1, 3)], 'X') for i in range(0, length({c}) // 3)], '')"


add("fasta_dna_to_protein", lambda t: t.records.select("id", s.translated(F.col("seq")).alias("protein")), f"SELECT id, {protein('seq')} AS protein FROM records")
add("fasta_translate", lambda t: t.records.select("id", *[s.translated(x, f).alias(f"{n}{f}") for n, x in (("f", F.col("seq")), ("r", s.revcomp(F.col("seq")))) for f in range(3)]),
    "SELECT id, " + ", ".join(f"{protein(f'substr({x}, {f + 1})')} AS {n}{f}" for n, x in (("f", "seq"), ("r", rc("seq"))) for f in range(3)) + " FROM records")
_ORF = f"""WITH d AS (SELECT id, strand, frame, substr(dna, frame + 1) AS dna FROM (SELECT id, '+' AS strand, seq AS dna FROM records UNION ALL SELECT id, '-', {rc('seq')} FROM records), (SELECT unnest([0, 1, 2]) AS frame)),
c AS (SELECT id, strand, frame, array_to_string([substr(dna, i * 3 + 1, 3) for i in range(0, length(dna) // 3)], ' ') || ' ' AS codons FROM d),
p AS (SELECT id, strand, frame, unnest(regexp_split_to_array(codons, 'TAA |TAG |TGA ')) AS piece FROM c),
f AS (SELECT id, strand, frame, replace(regexp_extract(' ' || piece, ' (ATG( [ACGT][ACGT][ACGT])*)', 1), ' ', '') AS dna FROM p)
SELECT id, strand, CAST(frame AS INT) AS frame, dna, {protein('dna')} AS protein FROM f WHERE length(dna) >= 30"""
add("fasta_get_orfs", lambda t: o.orfs(t.records, "id", "seq", 30), _ORF)
add("fasta_longest_orf", lambda t: o.orfs(t.records, "id", "seq", 3).agg(F.max(F.length("protein")).cast("long").alias("longest")), f"SELECT max(length(protein)) AS longest FROM ({_ORF.replace('>= 30', '>= 3')})")
add("fasta_get_hsp", lambda t: o.consensus(t.aligned), "SELECT position, base, n FROM (SELECT *, row_number() OVER (PARTITION BY position ORDER BY n DESC, base) AS k FROM (SELECT i - 1 AS position, substr(seq, i, 1) AS base, count(*) AS n FROM (SELECT seq, unnest(range(1, length(seq) + 1)) AS i FROM aligned) GROUP BY ALL)) WHERE k = 1")
_WIN = "(SELECT id, i AS start, substr(seq, i + 1, 20) AS w FROM (SELECT id, seq, unnest(range(0, length(seq) - 19, 10)) AS i FROM records))"
add("fasta_nucleotide_percentage", lambda t: rounded(o.windowed(t.records, "id", "seq", 20, 10).select("id", "start", s.percent(F.col("window"), "GC").alias("gc")), "gc"), f"SELECT id, start, round({gc('w')}, 4) AS gc FROM {_WIN}")
_CPG = "coalesce(len(regexp_extract_all(w, 'CG')) * length(w) / nullif({c} * {g}, 0), 0)".format(c=n_of("C", "w"), g=n_of("G", "w"))
add("fasta_cpg_report", lambda t: rounded(o.windowed(t.records, "id", "seq", 20, 10).select("id", "start", o.cpg(F.col("window")).alias("ratio"), s.percent(F.col("window"), "GC").alias("gc")).where("gc >= 40 and ratio >= 0.6").drop("gc"), "ratio"), f"SELECT id, start, round({_CPG}, 4) AS ratio FROM {_WIN} WHERE {gc('w')} >= 40 AND {_CPG} >= 0.6")
add("fasta_fasta_stats_of_records", lambda t: t.records.select("id", F.repeat(F.lit("!"), F.length("seq")).alias("qual")), "SELECT id, repeat('!', length(seq)) AS qual FROM records")
add("fasta_barcode_split", lambda t: o.barcoded(t.records, t.barcodes, "seq", 1),
    "SELECT id, name AS barcode, d AS mismatches FROM (SELECT id, name, d, row_number() OVER (PARTITION BY id ORDER BY d, name) AS k FROM (SELECT id, name, " + " + ".join(f"CAST(substr(seq, {i}, 1) <> substr(barcode, {i}, 1) AS BIGINT)" for i in (1, 2, 3)) + " AS d FROM records, barcodes) WHERE d <= 1) WHERE k = 1")
add("fasta_random_subset", lambda t: tab.sample(t.records.select("id"), ["id"], fraction=0.5))
add("fasta_extract_region", lambda t: t.records.select("id", s.revcomp(F.substring("seq", 11, 20)).alias("seq")), f"SELECT id, {rc('substr(seq, 11, 20)')} AS seq FROM records")
add("fasta_search_loop", lambda t: o.masked_runs(t.records, "id", "seq", "A[CT]G+"), "SELECT id, CAST(sum(g + lm) OVER w - lm AS BIGINT) AS start, CAST(sum(g + lm) OVER w AS BIGINT) AS stop FROM (SELECT id, unnest(range(1, len(m) + 1)) AS k, length(unnest(m)) AS lm, length(unnest(list_slice(gaps, 1, len(m)))) AS g FROM (SELECT id, regexp_extract_all(seq, 'A[CT]G+') AS m, regexp_split_to_array(seq, 'A[CT]G+') AS gaps FROM records)) WINDOW w AS (PARTITION BY id ORDER BY k)")
add("fasta_kmer_count", lambda t: o.kmer_counts(t.records, 4, canonical=True), f"SELECT least(kmer, {rc('kmer')}) AS kmer, count(*) AS n FROM {kmers('records', 4)} GROUP BY 1")
add("fasta_profile_vector", lambda t: rounded(o.kmer_counts(t.records.select("seq"), 2).crossJoin(F.broadcast(t.records.agg(F.sum(F.length("seq") - 1).alias("all")))).select("kmer", (F.col("n") / F.col("all")).alias("share")), "share", n=6), f"SELECT kmer, round(count(*) / (SELECT sum(length(seq) - 1) FROM records), 6) AS share FROM {kmers('records', 2)} GROUP BY 1")
_SK = f"(SELECT id, list_slice(list_sort(list(DISTINCT md5(least(kmer, {rc('kmer')})))), 1, 20) AS h FROM {kmers('repeated', 8)} GROUP BY id)"
add("fasta_mash_compare", lambda t: rounded(o.sketch_pairs(o.sketch(t.repeated, "id", "seq", 8, 20)), "jaccard", n=6), f"SELECT a.id AS a, b.id AS b, len(list_intersect(a.h, b.h)) AS shared, round(len(list_intersect(a.h, b.h)) / (len(a.h) + len(b.h) - len(list_intersect(a.h, b.h))), 6) AS jaccard FROM {_SK} a JOIN {_SK} b ON a.id < b.id WHERE len(list_intersect(a.h, b.h)) > 0")
add("fasta_md5", lambda t: t.records.select("id", F.md5("seq").alias("md5")), "SELECT id, md5(seq) AS md5 FROM records")
add("fasta_filter_on_description", lambda t: tab.grep(t.records.select("id", "description"), "description", "^a"), "SELECT id, description FROM records WHERE regexp_matches(description, '(?i)^a')")
add("fasta_to_fastq_convert", lambda t: t.records.select(F.concat(F.lit("@"), "id", F.lit("\n"), "seq", F.lit("\n+\n"), F.repeat(F.lit("I"), F.length("seq"))).alias("record")), "SELECT '@' || id || chr(10) || seq || chr(10) || '+' || chr(10) || repeat('I', length(seq)) AS record FROM records")
add("seqtk_seq_subsample", lambda t: tab.sample(t.records.select("id"), ["id"], fraction=0.25, seed=100))
add("seqtk_comp", lambda t: rounded(o.composition(t.gapped).select("id", "length", "a", "c", "g", "t", "gc"), "gc"), "SELECT id, length(seq) AS length, " + ", ".join(f"{n_of(b.upper())} AS {b}" for b in "acgt") + f", round({gc()}, 4) AS gc FROM gapped")
add("seqtk_listheads", lambda t: t.records.select(F.concat(F.lit(">"), "id", F.lit(" "), "description").alias("head")), "SELECT '>' || id || ' ' || description AS head FROM records")
add("seqtk_fixhead", lambda t: o.numbered(t.records.select("ln", "id"), "ln").select("id", "new_id"), "SELECT id, 'seq' || CAST(row_number() OVER (ORDER BY ln) AS VARCHAR) AS new_id FROM records")
add("seqtk_mut", lambda t: t.records.select("id", F.overlay("seq", F.lit("N"), F.lit(5), F.lit(1)).alias("seq")), "SELECT id, substr(seq, 1, 4) || 'N' || substr(seq, 6) AS seq FROM records")
add("seqtk_gapidx", lambda t: o.masked_runs(t.gapped, "id", "seq", "N+"), "SELECT id, CAST(sum(g + lm) OVER w - lm AS BIGINT) AS start, CAST(sum(g + lm) OVER w AS BIGINT) AS stop FROM (SELECT id, unnest(range(1, len(m) + 1)) AS k, length(unnest(m)) AS lm, length(unnest(list_slice(gaps, 1, len(m)))) AS g FROM (SELECT id, regexp_extract_all(seq, 'N+') AS m, regexp_split_to_array(seq, 'N+') AS gaps FROM gapped)) WINDOW w AS (PARTITION BY id ORDER BY k)")
add("convert_bed_to_gff", lambda t: t.bed_b.select(F.concat_ws("\t", "chrom", F.lit("spindrift"), F.lit("region"), (F.col("start") + 1).cast("string"), F.col("stop").cast("string"), F.lit("."), "strand", F.lit("."), F.concat(F.lit("ID="), "name")).alias("line")), "SELECT chrom || chr(9) || 'spindrift' || chr(9) || 'region' || chr(9) || CAST(start + 1 AS VARCHAR) || chr(9) || CAST(stop AS VARCHAR) || chr(9) || '.' || chr(9) || strand || chr(9) || '.' || chr(9) || 'ID=' || name AS line FROM bed_b")
add("convert_table_to_bed", lambda t: t.orders.select(F.lit("chr1").alias("chrom"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + 10).alias("stop"), F.col("o_orderpriority").alias("name")), "SELECT 'chr1' AS chrom, o_orderkey AS start, o_orderkey + 10 AS stop, o_orderpriority AS name FROM orders")
