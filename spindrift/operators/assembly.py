"""Assembly of reads: unitigs of the de Bruijn graph, by list ranking instead of a walk on one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as s
from ..plans.ordinals import materialized


def kmer_counts(reads: DataFrame, k: int, min_coverage: int = 1) -> DataFrame:
    """(kmer, n): canonical k-mers of reads (seq), of A, C, G and T only, that occur ``min_coverage`` times or more. Equal
    reads are cut once, and count as often as they come."""
    texts = reads.groupBy(F.upper("seq").alias("_seq")).agg(F.count("*").alias("_times"))
    each = texts.select("_times", F.explode(s.kmers(F.col("_seq"), k, True)).alias("kmer")).where(F.col("kmer").rlike("^[ACGT]+$"))
    counts = each.groupBy("kmer").agg(F.sum("_times").alias("n"))
    return counts.where(F.col("n") >= min_coverage) if min_coverage > 1 else counts


def ranked_lists(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lists and rings of a graph (node, next) where a node has at most one next and is that of one node at most.

    Returns (node, last, steps) for the nodes of lists, with the last node and the links up to it, and (node, least)
    for those of rings, with the ring's least node. By pointer doubling: each round joins every node with the one that
    it points to, and points it to where that one points, so there are as many rounds as the length of the longest
    list has binary digits. Rounds work on written tables.
    """
    ends = links.select(F.col("next").alias("node")).join(links.select("node"), "node", "left_anti")
    begun = links.select("node", F.col("next").alias("to"), F.lit(1).cast("long").alias("steps"), F.least("node", "next").alias("least"), F.lit(False).alias("ended"))
    now = materialized(begun.unionAll(ends.select("node", F.col("node").alias("to"), F.lit(0).cast("long"), F.col("node").alias("least"), F.lit(True))))
    count, span = now.where("NOT ended").count(), 1
    while count:
        ahead = now.select(F.col("node").alias("_n"), F.col("to").alias("_to"), F.col("steps").alias("_steps"), F.col("least").alias("_least"), F.col("ended").alias("_ended"))
        now = materialized(now.join(ahead, F.col("to") == F.col("_n")).select("node", F.col("_to").alias("to"), (F.col("steps") + F.col("_steps")).alias("steps"), F.least("least", "_least").alias("least"), F.col("_ended").alias("ended")))
        span *= 2
        left = now.where("NOT ended").count()
        # every round ends some node of a list, as long as one is open; a ring's nodes know its least one once their
        # pointers span as many nodes as are open
        if left == count and span >= count:
            break
        count = left
    return now.where("ended").select("node", F.col("to").alias("last"), "steps"), now.where("NOT ended").select("node", "least")


def unitigs(reads: DataFrame, k: int = 15, min_coverage: int = 1, min_length: int = 0) -> DataFrame:
    """(seq, length, kmers, coverage): the unitigs of reads (seq), maximal paths of k-mers without a branch, as the lesser
    of a sequence and its reverse complement; coverage is the mean count of its k-mers.

    Both strands are one graph: each k-mer stands for itself and its reverse complement, and k is odd, so that none is
    its own. Two k-mers lie on a path if they overlap by k - 1 letters and each is the other's only neighbour on that
    side; a k-mer never follows its own reverse complement. A ring is cut before its least k-mer. A unitig is one
    value, so its k-mers meet in one row. Null and short reads add nothing; no reads give no rows.
    """
    if k % 2 == 0:
        raise ValueError("k must be odd")
    counts = materialized(kmer_counts(reads, k, min_coverage))
    node = materialized(counts.select("kmer", "n").unionAll(counts.select(s.revcomp(F.col("kmer")), "n")).toDF("node", "n"))
    before = node.groupBy(F.substring("node", 1, k - 1).alias("lap")).agg(F.count("*").alias("_b"), F.min("node").alias("next"))
    after = node.groupBy(F.substring("node", 2, k - 1).alias("_lap")).agg(F.count("*").alias("_a"), F.min("node").alias("node"))
    links = before.where("_b = 1").join(after.where("_a = 1"), F.col("lap") == F.col("_lap")).select("node", "next")
    links = materialized(links.where(F.col("next") != s.revcomp(F.col("node"))))
    lists, rings = ranked_lists(links)
    rings = materialized(rings)
    if not rings.isEmpty():  # a ring becomes a list that begins at its least node
        cut = links.join(rings, "node").where("next <> least")
        more, _ = ranked_lists(cut.select("node", "next"))
        lists = lists.unionAll(more)
    alone = node.select("node").join(lists.select("node"), "node", "left_anti")
    placed = lists.select("node", "last", "steps").unionAll(alone.select("node", F.col("node").alias("last"), F.lit(0).cast("long")))
    # of a path and its reverse complement the one with the lesser first k-mer stays; a ring's other strand has another cut
    first = placed.groupBy("last").agg(F.max(F.struct("steps", "node")).alias("x"), F.min("node").alias("least"), F.min(s.revcomp(F.col("node"))).alias("back")).select("last", F.col("x.node").alias("first"), "least", "back")
    ring = rings.select("least").distinct().withColumnRenamed("least", "_ring")
    of = first.join(ring, F.col("first") == F.col("_ring"), "left")
    kept = of.where(F.when(F.col("_ring").isNotNull(), F.col("least") <= F.col("back")).otherwise(F.col("first") <= s.revcomp(F.col("last")))).select(F.col("last").alias("_last"), "first")
    rows = placed.join(kept, F.col("last") == F.col("_last")).join(node.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"))
    spelled = rows.groupBy("last", "first").agg(F.array_sort(F.collect_list(F.struct((-F.col("steps")).alias("at"), F.substring("node", k, 1).alias("c")))).alias("letters"), F.count("*").alias("kmers"), F.avg("n").alias("coverage"))
    whole = F.concat("first", F.array_join(F.transform(F.slice("letters", F.lit(2), F.greatest(F.size("letters") - 1, F.lit(0))), lambda x: x["c"]), ""))
    made = spelled.select(whole.alias("_seq"), "kmers", "coverage").select(F.least("_seq", s.revcomp(F.col("_seq"))).alias("seq"), "kmers", "coverage")
    return made.select("seq", F.length("seq").cast("long").alias("length"), "kmers", "coverage").where(F.col("length") >= min_length)


def contig_lines(contigs: DataFrame, width: int = 60) -> DataFrame:
    """(contig, line, text): contigs (seq, length, coverage) as FASTA, numbered from 1 by falling length, then sequence;
    line 0 is the header."""
    from ..plans.ordinals import ordinal

    numbered = ordinal(contigs, [F.desc("length"), "seq"], "contig")
    header = F.concat(F.lit(">contig_"), F.col("contig").cast("string"), F.lit(" length="), F.col("length").cast("string"), F.lit(" kmercov="), F.format_string("%.4f", "coverage"))
    return numbered.select("contig", F.posexplode(F.concat(F.array(header), s.chunks(F.col("seq"), width))).alias("line", "text"))
