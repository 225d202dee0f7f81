"""Operators on features (seqid, type, start, stop, strand, id, parent): 1-based and closed; and on their sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as s
from ..plans.ordinals import materialized
from .intervals import closest
from .sequences import orfs


def to_bed(features: DataFrame) -> DataFrame:
    """0-based, half-open intervals."""
    return features.select(F.col("seqid").alias("chrom"), (F.col("start") - 1).alias("start"), "stop", F.col("id").alias("name"), F.lit(0.0).alias("score"), "strand")


def line(features: DataFrame, gtf: bool = False) -> DataFrame:
    """GFF3 or GTF lines."""
    attributes = F.concat(F.lit('gene_id "'), "id", F.lit('";')) if gtf else F.concat(F.lit("ID="), "id", F.when(F.col("parent").isNotNull(), F.concat(F.lit(";Parent="), "parent")).otherwise(""))
    return features.select(F.concat_ws("\t", "seqid", F.lit("spindrift"), "type", F.col("start").cast("string"), F.col("stop").cast("string"), F.lit("."), "strand", F.lit("."), attributes).alias("line"))


def transcripts(exons: DataFrame) -> DataFrame:
    """Span, exons and spliced length by parent."""
    return exons.groupBy("parent").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("exons"), F.sum(F.col("stop") - F.col("start") + 1).alias("length"))


def faults(features: DataFrame) -> DataFrame:
    """(fault, n): reversed or non-positive coordinates, repeated ids, missing parents."""
    ids = features.select(F.col("id").alias("_id")).distinct()
    again = features.groupBy("id").count().where("id is not null and count > 1").agg(F.count("*").alias("n")).select(F.lit("repeated id").alias("fault"), "n")
    lost = features.where("parent is not null").join(ids, F.col("parent") == F.col("_id"), "left_anti").agg(F.count("*").alias("n")).select(F.lit("missing parent").alias("fault"), "n")
    bad = features.where("start > stop or start < 1").agg(F.count("*").alias("n")).select(F.lit("coordinates").alias("fault"), "n")
    return again.unionAll(lost).unionAll(bad).where("n > 0")


def slices(intervals: DataFrame, genome: DataFrame, stranded: bool = True) -> DataFrame:
    """(name, seq): the sequence of each interval of a sequence (id, seq), reverse-complemented on the minus strand."""
    g = genome.select(F.col("id").alias("_id"), F.col("seq").alias("_seq"))
    cut = F.substring("_seq", F.col("start").cast("int") + 1, (F.col("stop") - F.col("start")).cast("int"))
    seq: Column = F.when(F.col("strand") == "-", s.revcomp(cut)).otherwise(cut) if stranded else cut
    return intervals.join(g, F.col("chrom") == F.col("_id")).select("name", seq.alias("seq"))


def codon_usage(df: DataFrame, seq: str = "seq") -> DataFrame:
    """(codon, aa, n, rscu): codons of frame 0, relative to the mean of their amino acid."""
    table = F.create_map(*[F.lit(x) for pair in s.CODONS.items() for x in pair])
    c = F.upper(F.col(seq))
    used = df.select(F.explode(F.transform(s.windows(c, 3, 3), lambda i: F.substring(c, i + 1, F.lit(3)))).alias("codon")).groupBy("codon").agg(F.count("*").alias("n"))
    known = used.withColumn("aa", F.try_element_at(table, F.col("codon"))).where("aa is not null")
    families = {}
    for aa in s.CODONS.values():
        families[aa] = families.get(aa, 0) + 1
    size = F.element_at(F.create_map(*[F.lit(x) for pair in families.items() for x in pair]), F.col("aa"))
    totals = known.groupBy(F.col("aa").alias("_aa")).agg(F.sum("n").alias("_n"))
    return known.join(F.broadcast(totals), F.col("aa") == F.col("_aa")).select("codon", "aa", "n", (F.col("n") * size / F.col("_n")).alias("rscu"))


def pwm_hits(df: DataFrame, id: str, seq: str, counts: list[list[int]], share: float = 0.8, pseudo: float = 0.5) -> DataFrame:
    """(id, start, score): windows whose log-odds (bits, uniform background) reach a share of the best possible.

    ``counts`` has a row of A, C, G, T counts for each position: a matrix of fixed size, written into the plan.
    """
    from math import log2

    rows = [[log2((x + pseudo) / (sum(row) + 4 * pseudo) / 0.25) for x in row] for row in counts]
    best = sum(map(max, rows))
    score = sum((F.element_at(F.create_map(*[F.lit(x) for pair in zip("ACGT", row, strict=True) for x in pair]), F.upper(F.substring("window", i + 1, 1))) for i, row in enumerate(rows)), F.lit(0.0))
    from .sequences import windowed

    made = windowed(df, id, seq, len(rows), 1).where(F.upper("window").rlike("^[ACGT]+$"))
    return made.withColumn("score", score).where(F.col("score") >= share * best).select(id, "start", "score")


def guides(df: DataFrame, id: str, seq: str, size: int = 20) -> DataFrame:
    """(id, strand, guide, gc): sites of ``size`` bases before NGG, on both strands, overlapping ones included."""
    each = df.select(id, F.explode(F.array(F.struct(F.lit("+").alias("strand"), F.upper(F.col(seq)).alias("dna")), F.struct(F.lit("-").alias("strand"), s.revcomp(F.upper(F.col(seq))).alias("dna")))).alias("x")).select(id, "x.strand", "x.dna")
    found = each.select(id, "strand", F.explode(s.kmers(F.col("dna"), size + 3)).alias("site")).where(F.col("site").rlike("^[ACGT]{%d}[ACGT]GG$" % size))
    return found.select(id, "strand", F.substring("site", 1, size).alias("guide"), s.percent(F.substring("site", 1, size), "GC").alias("gc"))


def position_matrix(df: DataFrame, seq: str = "seq") -> DataFrame:
    """(position, a, c, g, t): counts of aligned sites."""
    cells = df.select(F.posexplode(F.filter(F.split(F.upper(F.col(seq)), ""), lambda c: c != "")).alias("position", "base"))
    return cells.groupBy(F.col("position").cast("long").alias("position")).agg(*[F.sum((F.col("base") == b).cast("long")).alias(b.lower()) for b in "ACGT"])


def distances(df: DataFrame, id: str = "id", seq: str = "seq") -> DataFrame:
    """(a, b, p, jc): p-distance and Jukes-Cantor distance of all pairs of aligned records. An alignment is small: its
    square is the result that is asked for."""
    a, b = df.select(F.col(id).alias("a"), F.col(seq).alias("x")), df.select(F.col(id).alias("b"), F.col(seq).alias("y"))
    pairs = a.join(b, F.col("a") < F.col("b"))
    p = s.hamming(F.col("x"), F.col("y")) / F.greatest(F.length("x"), F.length("y"))
    made = pairs.select("a", "b", p.alias("p"))
    return made.withColumn("jc", F.when(F.col("p") < 0.75, -0.75 * F.log(1 - 4 * F.col("p") / 3)))


def bed12(features: DataFrame) -> DataFrame:
    """(chrom, start, stop, name, strand, blocks, sizes, starts): the features (seqid, start, stop 1-based and closed,
    strand, parent) of each parent on a sequence as blocks of one row, in order; features without a parent are left
    out."""
    bed = features.where("parent is not null").select(F.col("seqid").alias("chrom"), (F.col("start") - 1).alias("start"), "stop", F.col("parent").alias("name"), "strand")
    made = bed.groupBy("chrom", "name", "strand").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("_b"))
    listed = lambda f: F.array_join(F.transform("_b", lambda x: f(x).cast("string")), ",")
    return made.select("chrom", "start", "stop", "name", "strand", F.size("_b").alias("blocks"), listed(lambda x: x["stop"] - x["start"]).alias("sizes"), listed(lambda x: x["start"] - F.col("start")).alias("starts"))


def bed12_blocks(df: DataFrame) -> DataFrame:
    """(chrom, start, stop, name, strand, block): the blocks of BED12 rows, numbered from 1."""
    numbers = lambda c: F.transform(F.split(F.regexp_replace(c, ",$", ""), ","), lambda x: x.cast("bigint"))
    each = df.select("chrom", F.col("start").alias("_at"), "name", "strand", F.posexplode(F.arrays_zip(numbers("starts").alias("a"), numbers("sizes").alias("n"))).alias("_i", "_b"))
    return each.select("chrom", (F.col("_at") + F.col("_b.a")).alias("start"), (F.col("_at") + F.col("_b.a") + F.col("_b.n")).alias("stop"), "name", "strand", (F.col("_i") + 1).alias("block"))


def cds_proteins(cds: DataFrame, genome: DataFrame, require_start: bool = True, min_length: int = 20) -> DataFrame:
    """(parent, length, protein): the coding parts (seqid, start, stop 1-based and closed, strand, parent) of each
    transcript spliced in order from the sequences (id, seq), on the minus strand from the far end, and translated up
    to the first stop; proteins below the least length, or without a first M if one is required, are left out."""
    g = genome.select(F.col("id").alias("_id"), F.col("seq").alias("_seq"))
    part = F.substring("_seq", F.col("start").cast("int"), (F.col("stop") - F.col("start") + 1).cast("int"))
    parts = cds.where("parent is not null").join(g, F.col("seqid") == F.col("_id")).select("parent", "strand", F.struct("start", part.alias("part")).alias("_p"))
    whole = parts.groupBy("parent", "strand").agg(F.array_join(F.transform(F.array_sort(F.collect_list("_p")), lambda x: x["part"]), "").alias("_s"))
    read = F.when(F.col("strand") == "-", s.revcomp(F.col("_s"))).otherwise(F.col("_s"))
    protein = F.regexp_replace(s.translated(read), r"[*].*$", "")
    made = whole.select("parent", F.length(protein).alias("length"), protein.alias("protein")).where(F.col("length") >= min_length)
    return made.where(F.col("protein").startswith("M")) if require_start else made


def nearest_genes(peaks: DataFrame, genes: DataFrame, tss_distance: int = 2000) -> DataFrame:
    """(chrom, start, stop, name, class, distance, gene): each interval by the nearest start of transcription (of features
    seqid, start, stop 1-based, strand, id): promoter within ``tss_distance``, else intragenic if it overlaps a gene,
    else distal; the distance is 0 on overlap, else the bases between plus one, and null without a gene on the
    chromosome. Each interval gives one row, whatever its name."""
    bed = to_bed(genes)
    tss = F.when(F.col("strand") == "-", F.col("stop") - 1).otherwise(F.col("start"))
    near = closest(peaks, bed.select("chrom", tss.alias("start"), (tss + 1).alias("stop"), "name"), bodies=bed)
    at = F.when(F.col("distance") >= 0, F.col("distance"))
    kind = F.when(at <= tss_distance, "promoter").when(F.col("inside"), "intragenic").otherwise("distal")
    return near.select("chrom", "start", "stop", "name", kind.alias("class"), at.alias("distance"), F.col("b_name").alias("gene"))


def genes_nearby(peaks: DataFrame, genes: DataFrame, max_distance: int | None = None) -> DataFrame:
    """(chrom, start, stop, name, gene, gene_start, gene_stop, distance, overlaps): each interval with the nearest gene
    (features seqid, start, stop 1-based, strand, id), from its first to its last base: distance 0 on overlap, else the
    bases between plus one; of equally near ones the smallest (start, stop, id). Intervals without a gene on the
    chromosome, or none within ``max_distance``, are left out; each other one gives one row, whatever its name."""
    near = closest(peaks, to_bed(genes)).where("distance >= 0")
    if max_distance is not None:
        near = near.where(F.col("distance") <= max_distance)
    return near.select("chrom", "start", "stop", "name", F.col("b_name").alias("gene"), F.col("b_start").alias("gene_start"), F.col("b_stop").alias("gene_stop"), "distance", (F.col("distance") == 0).alias("overlaps"))


def coding_density(df: DataFrame, id: str, seq: str, min_length: int = 33) -> DataFrame:
    """(id, length, forward, reverse, combined, gt, gc): letters of open reading frames of ``min_length`` or more on either
    strand, as shares of the sequence (frames may overlap; combined is 1 at most), and the shares of G and T, and of G and
    C. Repeated ids are sequences of their own; empty and null ones have 0."""
    own = materialized(df.select(F.monotonically_increasing_id().alias("_row"), F.col(id).alias("_id"), F.upper(F.coalesce(F.col(seq), F.lit(""))).alias("_seq")))
    each = orfs(own, "_row", "_seq", min_length).groupBy(F.col("_row").alias("_r"), "strand").agg(F.sum(F.length("dna")).alias("n"))
    sums = each.groupBy("_r").agg(F.sum(F.when(F.col("strand") == "+", F.col("n"))).alias("f"), F.sum(F.when(F.col("strand") == "-", F.col("n"))).alias("b"))
    both = own.join(sums, F.col("_row") == F.col("_r"), "left")
    n, f, b = F.greatest(F.length("_seq"), F.lit(1)), F.coalesce("f", F.lit(0)), F.coalesce("b", F.lit(0))
    return both.select(F.col("_id").alias(id), F.length("_seq").cast("long").alias("length"), (f / n).alias("forward"), (b / n).alias("reverse"), (F.least(f + b, n) / n).alias("combined"), (s.count(F.col("_seq"), "GT") / n).alias("gt"), (s.count(F.col("_seq"), "GC") / n).alias("gc"))
