"""Operators on alignments (qname, flag, rname, pos, mapq, cigar, tlen, seq, tags): 1-based positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.quantiles import quantile_row
from ..plans.ranges import overlapping

#: The flag bits.
BITS = {"paired": 1, "proper": 2, "unmapped": 4, "mate_unmapped": 8, "reverse": 16, "read1": 64, "read2": 128, "secondary": 256, "qcfail": 512, "duplicate": 1024, "supplementary": 2048}


def has(bit: str) -> Column:
    return F.col("flag").bitwiseAND(BITS[bit]) != 0


def operations(cigar: Column) -> Column:
    """array<struct<n, op>> of a CIGAR string."""
    return F.transform(F.regexp_extract_all(cigar, F.lit(r"\d+[MIDNSHP=X]"), F.lit(0)), lambda x: F.struct(F.left(x, F.length(x) - 1).cast("long").alias("n"), F.right(x, F.lit(1)).alias("op")))


def span(cigar: Column, ops: str = "MDN=X") -> Column:
    """Bases that the operations take up (of the reference, by default)."""
    return F.aggregate(F.filter(operations(cigar), lambda x: x["op"].isin(*ops)), F.lit(0).cast("long"), lambda s, x: s + x["n"])


def blocks(df: DataFrame) -> DataFrame:
    """(qname, chrom, start, stop, strand): the aligned blocks of each mapped record, 0-based half-open."""
    zero = F.struct((F.col("pos") - 1).alias("at"), F.array().cast("array<struct<start: bigint, stop: bigint>>").alias("found"))

    def step(s: Column, x: Column) -> Column:
        stop = s["at"] + F.when(x["op"].isin("M", "=", "X", "D", "N"), x["n"]).otherwise(0)
        own = F.array(F.struct(s["at"].alias("start"), stop.alias("stop")))
        return F.struct(stop.alias("at"), F.when(x["op"].isin("M", "=", "X"), F.concat(s["found"], own)).otherwise(s["found"]).alias("found"))

    made = df.where(~has("unmapped")).select("qname", F.col("rname").alias("chrom"), F.when(has("reverse"), "-").otherwise("+").alias("strand"), F.explode(F.aggregate(operations(F.col("cigar")), zero, step, lambda s: s["found"])).alias("x"))
    return made.select("qname", "chrom", "x.start", "x.stop", "strand")


def gaps(df: DataFrame, op: str = "N") -> DataFrame:
    """(chrom, start, stop, strand, n): gaps of one operation, with the records that hold them."""
    zero = F.struct((F.col("pos") - 1).alias("at"), F.array().cast("array<struct<start: bigint, stop: bigint>>").alias("found"))

    def step(s: Column, x: Column) -> Column:
        stop = s["at"] + F.when(x["op"].isin("M", "=", "X", "D", "N"), x["n"]).otherwise(0)
        return F.struct(stop.alias("at"), F.when(x["op"] == op, F.concat(s["found"], F.array(F.struct(s["at"].alias("start"), stop.alias("stop"))))).otherwise(s["found"]).alias("found"))

    made = df.where(~has("unmapped")).select(F.col("rname").alias("chrom"), F.when(has("reverse"), "-").otherwise("+").alias("strand"), F.explode(F.aggregate(operations(F.col("cigar")), zero, step, lambda s: s["found"])).alias("x"))
    return made.groupBy("chrom", "x.start", "x.stop", "strand").agg(F.count("*").alias("n"))


def flagstat(df: DataFrame) -> DataFrame:
    """Records, and those with each flag bit."""
    return df.agg(F.count("*").alias("total"), F.sum((~has("unmapped")).cast("long")).alias("mapped"), *[F.sum(has(b).cast("long")).alias(b) for b in BITS])


def view(df: DataFrame, mapq: int = 0, require: int = 0, exclude: int = 0, chrom: str | None = None) -> DataFrame:
    f = F.col("flag")
    kept = (F.col("mapq") >= mapq) & (f.bitwiseAND(require) == require) & (f.bitwiseAND(exclude) == 0)
    return df.where(kept & (F.col("rname") == chrom) if chrom else kept)


def start_key() -> list[Column]:
    return [F.col("rname"), F.col("pos"), has("reverse")]


def marked(df: DataFrame) -> DataFrame:
    """``df`` with ``duplicate``: all but the record of highest mapping quality (then name, then flag) at a place on
    a strand. The best of a place is found by a combining minimum, so a place of any depth stays small."""
    own = F.struct((-F.col("mapq")).alias("q"), "qname", "flag")
    best = df.where(~has("unmapped")).groupBy(F.col("rname").alias("_r"), F.col("pos").alias("_p"), has("reverse").alias("_s")).agg(F.min(own).alias("_best"))
    both = df.join(best, (F.col("rname") == F.col("_r")) & (F.col("pos") == F.col("_p")) & (has("reverse") == F.col("_s")), "left")
    return both.withColumn("duplicate", ~has("unmapped") & (own != F.col("_best"))).drop("_r", "_p", "_s", "_best")


def duplicate_rate(df: DataFrame) -> DataFrame:
    """Mapped records, duplicates among them, and the estimated size of the library."""
    n, d = F.count("*"), F.count_distinct(*start_key())
    made = df.where(~has("unmapped")).agg(n.alias("mapped"), d.alias("places"))
    rate = 1 - F.col("places") / F.col("mapped")
    return made.withColumns({"duplicates": F.col("mapped") - F.col("places"), "rate": rate})


def depth_bins(df: DataFrame, size: int = 500) -> DataFrame:
    """(chrom, start, depth): mean depth of aligned bases by bin."""
    cut = blocks(df).withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("stop") - 1) / size))))
    n = F.least("stop", (F.col("_bin") + 1) * size) - F.greatest("start", F.col("_bin") * size)
    return cut.groupBy("chrom", (F.col("_bin") * size).alias("start")).agg((F.sum(n) / size).alias("depth"))


def compared(a: DataFrame, b: DataFrame, pseudo: float = 1.0) -> DataFrame:
    """log2 ratio of two binned depths."""
    other = b.select(F.col("chrom").alias("_c"), F.col("start").alias("_s"), F.col("depth").alias("other"))
    both = a.join(other, (F.col("chrom") == F.col("_c")) & (F.col("start") == F.col("_s")), "full")
    x, y = F.coalesce("depth", F.lit(0.0)), F.coalesce("other", F.lit(0.0))
    return both.select(F.coalesce("chrom", "_c").alias("chrom"), F.coalesce("start", "_s").alias("start"), F.log2((x + pseudo) / (y + pseudo)).alias("log2"))


def assigned(df: DataFrame, features: DataFrame) -> DataFrame:
    """(feature, n): records by the one feature that their blocks touch; those of several are ambiguous, others have
    none."""
    hits = overlapping(blocks(df).withColumn("name", F.col("qname")), features).groupBy("a_qname").agg(F.min("b_name").alias("low"), F.max("b_name").alias("high"))
    names = df.where(~has("unmapped")).select("qname").distinct()
    both = names.join(hits, F.col("qname") == F.col("a_qname"), "left")
    return both.groupBy(F.when(F.col("low").isNull(), "__none").when(F.col("low") != F.col("high"), "__ambiguous").otherwise(F.col("low")).alias("feature")).agg(F.count("*").alias("n"))


def fragment_summary(df: DataFrame) -> DataFrame:
    t = df.where("tlen > 0")
    facts = t.agg(F.count("*").alias("n"), F.avg("tlen").alias("mean"), F.stddev_samp("tlen").alias("sd"), F.min("tlen").alias("low"), F.max("tlen").alias("high"))
    return facts.join(F.broadcast(quantile_row(t, [], "tlen", {"median": 0.5})), how="left").select("n", "mean", "sd", "median", "low", "high")


def problems(df: DataFrame) -> DataFrame:
    """(problem, n): structural faults of records."""
    length = span(F.col("cigar"), "MIS=X")
    found = F.array_compact(F.array(
        F.when(~has("unmapped") & (F.col("pos") < 1), "mapped without position"), F.when(has("unmapped") & (F.col("mapq") > 0), "unmapped with quality"),
        F.when(~has("unmapped") & (length != F.length("seq")), "cigar and sequence differ"), F.when(has("read1") & has("read2"), "both mates"),
    ))
    return df.select(F.explode(found).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


def mates(df: DataFrame) -> DataFrame:
    """Pairs of equal names: the places of the first and the second."""
    one = lambda bit: F.min(F.when(has(bit), F.struct("rname", "pos")))
    return df.where(has("paired")).groupBy("qname").agg(one("read1").alias("a"), one("read2").alias("b")).where("a is not null and b is not null").select("qname", F.col("a.rname").alias("rname"), F.col("a.pos").alias("pos"), F.col("b.rname").alias("mate_rname"), F.col("b.pos").alias("mate_pos"))


def percent_by(df: DataFrame, key: Column, name: str) -> DataFrame:
    total = df.agg(F.count("*").alias("_all"))
    return df.groupBy(key.alias(name)).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select(name, "n", (100 * F.col("n") / F.col("_all")).alias("percent"))


def cumulative_shares(df: DataFrame, value: str) -> DataFrame:
    """(value, n, share): the share of all that the bins of at most each value hold; over distinct values."""
    each = df.groupBy(value).agg(F.count("*").alias("n"))
    total = df.agg(F.sum(value).alias("_all"))
    by = Window.orderBy(value)
    return each.crossJoin(F.broadcast(total)).select(value, "n", (F.sum(F.col(value) * F.col("n")).over(by) / F.col("_all")).alias("share"))
