"""Operators on sequence records (id, seq, desc) and reads (id, seq, qual)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import sequences as s
from ..plans.ordinals import materialized, ordinal, running



def composition(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Length, base counts, GC percent and skews of each record."""
    c = F.col(seq)
    a, t, g, cc = (s.count(c, x) for x in "ATGC")
    return df.withColumns({
        "length": F.length(c).cast("long"), "a": a, "c": cc, "g": g, "t": t, "n": s.count(c, "N"), "gc": s.percent(c, "GC"),
        "gc_skew": F.coalesce((g - cc) / F.nullif(g + cc, F.lit(0)), F.lit(0.0)), "at_skew": F.coalesce((a - t) / F.nullif(a + t, F.lit(0)), F.lit(0.0)),
    })


def base_totals(df: DataFrame, seq: str = "seq") -> DataFrame:
    """(base, n): letters over all records; counted within records first."""
    per = df.select(F.explode(F.array(*[F.struct(F.lit(b).alias("base"), s.count(F.col(seq), b).alias("n")) for b in "ACGTN"])).alias("x"))
    return per.groupBy("x.base").agg(F.sum("x.n").alias("n"))


def chopped(df: DataFrame, id: str, seq: str, size: int, whole_only: bool = False) -> DataFrame:
    """Chunks with numbered ids."""
    cut = df.select(id, F.posexplode(s.chunks(F.col(seq), size)).alias("_i", "chunk"))
    cut = cut.select(F.concat(F.col(id), F.lit("_"), (F.col("_i") + 1).cast("string")).alias("id"), F.col("chunk").alias("seq"))
    return cut.where(F.length("seq") == size) if whole_only else cut


def n50(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Records, bases, lengths, N50, L50 and GC; the cumulative pass is over distinct lengths only."""
    n = df.select(F.length(seq).cast("long").alias("n"), s.count(F.col(seq), "GC").alias("gc"))
    facts = n.agg(F.count("*").alias("records"), F.sum("n").alias("bases"), F.min("n").alias("shortest"), F.max("n").alias("longest"), F.avg("n").alias("mean"), (100 * F.sum("gc") / F.sum("n")).alias("gc"))
    lengths = n.groupBy("n").agg(F.count("*").alias("k")).crossJoin(F.broadcast(facts.select(F.col("bases").alias("_all"))))
    by = Window.orderBy(F.desc("n"))
    reached = lengths.withColumns({"so_far": F.sum(F.col("n") * F.col("k")).over(by), "rank": F.sum("k").over(by)}).where(F.col("so_far") >= F.col("_all") / 2)
    half = reached.agg(F.max("n").alias("n50"), F.min(F.struct("so_far", "n", "k", "rank", "_all")).alias("x"))
    # the first record at which half is reached
    short = F.col("x._all") / 2 - (F.col("x.so_far") - F.col("x.n") * F.col("x.k"))
    return facts.crossJoin(half.select("n50", (F.col("x.rank") - F.col("x.k") + F.ceil(short / F.col("x.n"))).cast("long").alias("l50")))


def deduplicated(df: DataFrame, order: str, key: str = "sequence", seq: str = "seq", id: str = "id") -> DataFrame:
    """The first record of each key: id, sequence, folded (any case) or canonical (either strand), with its copies."""
    c = F.upper(F.col(seq))
    made = {"id": F.col(id), "sequence": F.col(seq), "folded": c, "canonical": F.least(c, s.revcomp(c))}[key]
    return df.groupBy(made.alias("key")).agg(F.count("*").alias("copies"), F.min_by(id, order).alias("id"))


def kmer_counts(df: DataFrame, k: int, seq: str = "seq", canonical: bool = False) -> DataFrame:
    return df.select(F.explode(s.kmers(F.upper(F.col(seq)), k, canonical)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


def windowed(df: DataFrame, id: str, seq: str, width: int, step: int) -> DataFrame:
    """(id, start, window): all whole windows."""
    return df.select(id, F.explode(s.windows(F.col(seq), width, step)).alias("start"), F.col(seq).alias("_seq")).select(id, F.col("start").cast("long").alias("start"), F.substring("_seq", F.col("start") + 1, F.lit(width)).alias("window"))


def cpg(c: Column) -> Column:
    """Observed over expected CpG: hits * length / (C * G)."""
    hits = F.regexp_count(c, F.lit("(?i)CG"))
    return F.coalesce(hits * F.length(c) / F.nullif((s.count(c, "C") * s.count(c, "G")).cast("double"), F.lit(0.0)), F.lit(0.0))


def orfs(df: DataFrame, id: str, seq: str, least: int = 30, starts: str = "ATG") -> DataFrame:
    """(id, strand, frame, start, protein): open reading frames from a start codon to a stop or the end, on both strands."""
    frames = [F.struct(F.lit(sign).alias("strand"), F.lit(f).alias("frame"), (F.upper(F.col(seq)) if sign == "+" else s.revcomp(F.upper(F.col(seq)))).alias("dna")) for sign in "+-" for f in range(3)]
    each = df.select(id, F.explode(F.array(*frames)).alias("x")).select(id, "x.strand", "x.frame", F.array_join(F.transform(s.windows(F.substring("x.dna", F.col("x.frame") + 1, F.lit(1 << 30)), 3, 3), lambda i: F.substring(F.col("x.dna"), F.col("x.frame") + i + 1, F.lit(3))), " ").alias("codons"))
    pattern = rf"(?:{starts})(?: (?!TAA|TAG|TGA)[ACGTN]{{3}})*"
    found = each.select(id, "strand", "frame", F.explode(F.regexp_extract_all("codons", F.lit(pattern), F.lit(0))).alias("orf"))
    dna = F.replace("orf", F.lit(" "), F.lit(""))
    return found.where(F.length(dna) >= least).select(id, "strand", "frame", dna.alias("dna"), s.translated(dna).alias("protein"))


def consensus(df: DataFrame, seq: str = "seq") -> DataFrame:
    """(position, base, n): the most frequent letter of each column, ties to the lesser letter."""
    cells = df.select(F.posexplode(F.filter(F.split(F.upper(F.col(seq)), ""), lambda c: c != "")).alias("position", "base")).groupBy("position", "base").count()
    best = F.row_number().over(Window.partitionBy("position").orderBy(F.desc("count"), "base"))
    return cells.withColumn("_n", best).where("_n = 1").select(F.col("position").cast("long").alias("position"), "base", F.col("count").alias("n"))


def barcoded(df: DataFrame, barcodes: DataFrame, seq: str = "seq", mismatches: int = 0) -> DataFrame:
    """Reads with the nearest barcode (name, barcode) at their start, if within the mismatches; ties to the name.

    The barcodes are a short list of fixed size. Repeated reads, and reads that share an id, give a row each.
    """
    head = F.substring(F.col(seq), F.lit(1), F.length("barcode"))
    rows = materialized(df.select(F.monotonically_increasing_id().alias("_row"), "id", seq))
    tried = rows.crossJoin(F.broadcast(barcodes)).withColumn("d", s.hamming(F.upper(head), F.upper("barcode")))
    return tried.where(F.col("d") <= mismatches).groupBy("_row", "id").agg(F.min(F.struct("d", "name")).alias("best")).select("id", F.col("best.name").alias("barcode"), F.col("best.d").cast("long").alias("mismatches"))


def cumulative_length(df: DataFrame, order: str, seq: str = "seq") -> DataFrame:
    return running(df.withColumn("length", F.length(seq).cast("long")), [order], "length", "cumulative")


#: Records of a block of a sketch's copies, in the mean, and the most salts that blocks are dealt to.
BLOCK, SALTS = 1024, 16


def sketch(df: DataFrame, id: str, seq: str, k: int = 8, size: int = 50) -> DataFrame:
    """(id, hashes): the smallest hashes of canonical k-mers of each record."""
    return df.select(id, F.slice(F.array_sort(F.array_distinct(F.transform(s.kmers(F.upper(F.col(seq)), k, True), lambda m: F.md5(m)))), 1, size).alias("hashes"))


def sketch_pairs(sketches: DataFrame, id: str = "id") -> DataFrame:
    """(a, b, shared, jaccard): records that share a hash. Distinct sketches meet by an equi-join on hashes; records of
    equal sketches are put in afterwards, so copies are not compared."""
    rows = sketches.select(F.col(id).alias("_id"), "hashes", F.sha2(F.array_join("hashes", ","), 256).alias("_g"))
    kinds = rows.groupBy("_g").agg(F.first("hashes").alias("hashes"), (1 + F.floor(F.count("*") / BLOCK)).alias("_blocks"))
    flat = kinds.select(F.explode("hashes").alias("hash"), "_g", F.size("hashes").alias("n"), F.col("_blocks").alias("_k"))
    other = flat.select(F.col("hash").alias("_hash"), F.col("_g").alias("_h"), F.col("n").alias("m"), F.col("_k").alias("_l"))
    shared = flat.join(other, (F.col("hash") == F.col("_hash")) & (F.col("_g") <= F.col("_h"))).groupBy("_g", "_h", "n", "m", "_k", "_l").agg(F.count("*").alias("shared"))
    # members of a sketch meet in blocks, and the blocks of another are dealt to as many salts as it has blocks: few sketches with
    # many copies make many pairs, so a number of partitions is given
    parts = int(sketches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = rows.join(kinds.select("_g", "_blocks"), "_g").select("_id", "_g", F.pmod(F.xxhash64("_id"), F.col("_blocks")).alias("_block"), F.least("_blocks", F.lit(SALTS)).alias("_salts"))
    x = dealt.select(F.col("_id").alias("_x"), "_g", F.col("_block").alias("_i"))
    y = dealt.withColumn("_salt", upto("_salts")).select(F.col("_id").alias("_y"), F.col("_g").alias("_h"), F.col("_block").alias("_j"), "_salt").repartition(parts, "_h", "_j", "_salt")
    cells = shared.withColumn("_i", upto("_k")).withColumn("_j", upto("_l")).withColumn("_salt", F.pmod(F.xxhash64("_g", "_i"), F.least("_l", F.lit(SALTS))))
    left = cells.join(x.hint("merge"), ["_g", "_i"]).select("_x", "_g", "_h", "_j", "_salt", "n", "m", "shared").repartition(parts, "_h", "_j", "_salt")
    both = left.join(y.hint("merge"), ["_h", "_j", "_salt"]).where(F.when(F.col("_g") == F.col("_h"), F.col("_x") < F.col("_y")).otherwise(F.col("_x") != F.col("_y")))
    return both.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"), "shared", (F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))).alias("jaccard"))


# reads


def trimmed(df: DataFrame, start: Column, length: Column) -> DataFrame:
    """Reads cut to (start from 0, length), bases and qualities alike."""
    return df.withColumns({"seq": F.substring("seq", start + 1, length), "qual": F.substring("qual", start + 1, length)})


def filtered(df: DataFrame, shortest: int = 0, longest: int = 0, quality: float = 0.0, most_n: float = 1.0) -> DataFrame:
    n = F.length("seq")
    kept = (n >= shortest) & (s.mean_quality(F.col("qual")) >= quality) & (s.count(F.col("seq"), "N") <= most_n * n)
    return df.where(kept & (n <= longest) if longest else kept)


def cycles(df: DataFrame, column: str = "qual") -> DataFrame:
    """(cycle, value): one row a base, cycles from 1."""
    cells = s.phred(F.col("qual")) if column == "qual" else F.filter(F.split(F.col("seq"), ""), lambda c: c != "")
    return df.select(F.posexplode(cells).alias("_i", "value")).select((F.col("_i") + 1).cast("long").alias("cycle"), "value")


def cycle_quality(df: DataFrame) -> DataFrame:
    """Qualities by cycle: counted by value before the quartiles, so what meets is bounded by the values there are."""
    counted = cycles(df).groupBy("cycle", "value").count()
    q = lambda p: F.percentile(F.col("value"), F.lit(p), F.col("count"))
    return counted.groupBy("cycle").agg(F.sum("count").alias("n"), (F.sum(F.col("value") * F.col("count")) / F.sum("count")).alias("mean"), q(0.5).alias("median"), q(0.25).alias("q1"), q(0.75).alias("q3"), F.min("value").alias("low"), F.max("value").alias("high"))


def collapsed(df: DataFrame, order: str) -> DataFrame:
    """Unique sequences: reads, mean quality, first id."""
    return df.groupBy(F.upper("seq").alias("seq")).agg(F.count("*").alias("n"), F.avg(s.mean_quality(F.col("qual"))).alias("quality"), F.min_by("id", order).alias("id"))


def duplication(df: DataFrame, most: int = 10) -> DataFrame:
    """(level, sequences, reads): sequences by how many reads they have, the last level open."""
    return df.groupBy(F.upper("seq").alias("seq")).count().groupBy(F.least("count", F.lit(most)).alias("level")).agg(F.count("*").alias("sequences"), F.sum("count").alias("reads"))


def overrepresented(df: DataFrame, percent: float = 0.1) -> DataFrame:
    total = df.agg(F.count("*").alias("_all"))
    counted = df.groupBy(F.upper("seq").alias("seq")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))
    return counted.where(100 * F.col("n") / F.col("_all") >= percent).select("seq", "n", (100 * F.col("n") / F.col("_all")).alias("percent"))


def adapter_clipped(df: DataFrame, adapter: str, least: int = 3) -> DataFrame:
    """Reads cut before the adapter, or before its longest prefix (of at least so many bases) at the end of the read."""
    inside = F.locate(adapter, F.col("seq"))
    tails = [F.when(F.col("seq").endswith(adapter[:k]), F.length("seq") - k) for k in range(len(adapter) - 1, least - 1, -1)]
    at = F.when(inside > 0, inside - 1).otherwise(F.coalesce(*tails, F.length("seq")))
    return trimmed(df.withColumn("clipped", at < F.length("seq")), F.lit(0), at)


def joined_pairs(left: DataFrame, right: DataFrame, least: int = 11) -> DataFrame:
    """Mates of equal id whose ends overlap exactly: the longest overlap of the first with the reverse complement of
    the second."""
    b = right.select(F.col("id").alias("_id"), s.revcomp(F.col("seq")).alias("_mate"))
    both = left.select("id", "seq").join(b, F.col("id") == F.col("_id"))
    n = F.least(F.length("seq"), F.length("_mate"))
    sizes = F.when(n >= least, F.sequence(n, F.lit(least), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    fits = F.filter(sizes, lambda k: F.right(F.col("seq"), k) == F.left(F.col("_mate"), k))
    k = F.get(fits, 0)
    return both.withColumn("overlap", k.cast("long")).where("overlap is not null").select("id", "overlap", F.concat("seq", F.substring("_mate", F.col("overlap").cast("int") + 1, F.lit(1 << 30))).alias("merged"))


def contaminated(df: DataFrame, contaminants: DataFrame, k: int = 16) -> DataFrame:
    """Ids of reads that share a k-mer with a contaminant, on either strand: an equi-join of distinct k-mers."""
    bad = contaminants.select(F.explode(s.kmers(F.upper(F.col("seq")), k, True)).alias("_kmer")).distinct()
    own = df.select("id", F.explode(F.array_distinct(s.kmers(F.upper(F.col("seq")), k, True))).alias("kmer"))
    return own.join(bad, F.col("kmer") == F.col("_kmer"), "left_semi").select("id").distinct()


def masked_runs(df: DataFrame, id: str, seq: str, pattern: str) -> DataFrame:
    """(id, start, stop): places of a pattern, from the gaps between its matches."""
    found, gaps = F.regexp_extract_all(F.col(seq), F.lit(pattern), F.lit(0)), F.split(F.col(seq), pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: bigint, stop: bigint>>").alias("spans"))
    parts = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["g"]
        return F.struct((start + x["m"]).alias("at"), F.concat(a["spans"], F.array(F.struct(start.cast("long").alias("start"), (start + x["m"]).cast("long").alias("stop")))).alias("spans"))

    return df.select(id, F.explode(F.aggregate(parts, zero, step, lambda a: a["spans"])).alias("x")).select(id, "x.start", "x.stop")


def numbered(df: DataFrame, order: str, prefix: str = "seq", start: int = 1) -> DataFrame:
    return ordinal(df, [order], "_n", start).withColumn("new_id", F.concat(F.lit(prefix), F.col("_n").cast("string"))).drop("_n")


def normalised(df: DataFrame, k: int, depth: float) -> DataFrame:
    """(id, depth) of the reads whose median k-mer count is at most the target depth; a read without a k-mer has 0.
    Reads that share an id stay apart. Equal reads are cut into k-mers once, which count as often as the read comes."""
    rows = df.select("id", F.upper("seq").alias("_seq"))
    texts = materialized(rows.groupBy("_seq").agg(F.count("*").alias("_times")).withColumn("_text", F.monotonically_increasing_id()))
    own = texts.select("_text", "_times", F.explode(s.kmers(F.col("_seq"), k, True)).alias("kmer"))
    counts = own.groupBy("kmer").agg(F.sum("_times").alias("n")).withColumnRenamed("kmer", "_kmer")
    each = own.select("_text", "kmer").join(counts, F.col("kmer") == F.col("_kmer")).select("_text", "n").repartition("_text")
    median = each.groupBy(F.col("_text").alias("_t")).agg(F.percentile("n", F.lit(0.5)).alias("_depth"))
    found = texts.join(median, F.col("_text") == F.col("_t"), "left").select(F.col("_seq").alias("_s"), F.coalesce("_depth", F.lit(0.0)).alias("depth")).where(F.col("depth") <= depth)
    return rows.join(found, F.col("_seq").eqNullSafe(F.col("_s"))).select("id", "depth")
