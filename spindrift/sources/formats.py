"""Readers of text formats of genomics on ``spark.read.text``: whole records in parallel, no driver-side parsing.

FASTA and FASTQ records span lines, so those files are read with a record delimiter; line formats are read as lines.
Paths may be globs, folders or compressed files, as Spark reads them. Empty lines and comments are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ordinals import materialized, ordinal


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, description, seq): records between '>' marks; an empty record has an empty sequence."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    body = F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "")
    head, rest = F.split_part(body, F.lit("\n"), F.lit(1)), F.regexp_replace(F.substring_index(body, "\n", -(1 << 20)), "^[^\n]*\n?", "")
    made = raw.select(head.alias("head"), F.regexp_replace(rest, r"\s", "").alias("seq")).where("head <> ''")
    return made.select(F.regexp_extract("head", r"^\S+", 0).alias("id"), F.trim(F.regexp_extract("head", r"^\S+\s*(.*)$", 1)).alias("description"), "seq")


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """(id, description, seq, qual): four lines a record. Quality lines may begin with '@', so records are told by
    their position in the file: lines are numbered over splits of any number, and meet by file and record."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r", "").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    numbered = materialized(ordinal(lines, ["file", "block", "row"], "n", 0))
    first = numbered.groupBy(F.col("file").alias("_file")).agg(F.min("n").alias("_first"))
    at = numbered.join(first, F.col("file") == F.col("_file")).withColumn("n", F.col("n") - F.col("_first"))
    part = lambda k: F.max(F.when(F.col("n") % 4 == k, F.col("line")))
    rows = at.groupBy("file", F.floor(F.col("n") / 4).alias("record")).agg(part(0).alias("h"), part(1).alias("seq"), part(3).alias("qual")).where("qual is not null")
    return rows.select(F.regexp_extract("h", r"^@(\S+)", 1).alias("id"), F.trim(F.regexp_extract("h", r"^@\S+\s*(.*)$", 1)).alias("description"), "seq", "qual")


def _fields(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    return spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith(comment)).select(F.split(F.regexp_replace("value", "\r", ""), "\t").alias("f"))


def _text(i: int) -> Column:
    return F.nullif(F.get(F.col("f"), F.lit(i)), F.lit("."))


def _number(i: int, kind: str) -> Column:
    return F.expr(f"try_cast(get(f, {i}) as {kind})")


def bed(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, stop, name, score, strand, extra); reversed coordinates are put in order, other lines left out."""
    rows = _fields(spark, path).where(~F.get(F.col("f"), F.lit(0)).rlike("^(track|browser)"))
    a, b = _number(1, "bigint"), _number(2, "bigint")
    made = rows.select(_text(0).alias("chrom"), F.least(a, b).alias("start"), F.greatest(a, b).alias("stop"), _text(3).alias("name"), _number(4, "double").alias("score"), F.coalesce(_text(5), F.lit(".")).alias("strand"), F.slice("f", 7, 1 << 20).alias("extra"))
    return made.where("start is not null and stop is not null")


def _mapped(entries: Column) -> Column:
    """A map of (key, value) entries; of a repeated key the last one counts."""
    back = F.reverse(F.transform(entries, lambda e: e["key"]))
    return F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(back, e["key"]) == F.size(entries) - i))


def gff(spark: SparkSession, path: str) -> DataFrame:
    """Features of GFF3 or GTF, 1-based and closed, with their attributes as a map."""
    pairs = F.filter(F.transform(F.split(F.get(F.col("f"), F.lit(8)), ";"), lambda x: F.trim(x)), lambda x: x != "")
    entries = F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, r"^([^=\s]+)", 1).alias("key"), F.regexp_replace(F.regexp_extract(x, r"^[^=\s]+[=\s]\s*(.*)$", 1), '"', "").alias("value")))
    attributes = _mapped(entries)
    return _fields(spark, path).where(F.size("f") >= 9).select(
        _text(0).alias("seqid"), _text(1).alias("source"), _text(2).alias("type"), _number(3, "bigint").alias("start"), _number(4, "bigint").alias("stop"), _number(5, "double").alias("score"), F.coalesce(_text(6), F.lit(".")).alias("strand"), _text(7).alias("phase"), attributes.alias("attrs")
    )


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, id, ref, alt, qual, filter, info, fmt, samples): missing values are null."""
    info = F.transform(F.filter(F.split(F.get(F.col("f"), F.lit(7)), ";"), lambda x: (x != "") & (x != ".")), lambda x: F.struct(F.split_part(x, F.lit("="), F.lit(1)).alias("key"), F.split_part(x, F.lit("="), F.lit(2)).alias("value")))
    return _fields(spark, path).where(F.size("f") >= 8).select(
        _text(0).alias("chrom"), _number(1, "bigint").alias("pos"), _text(2).alias("id"), _text(3).alias("ref"), _text(4).alias("alt"), _number(5, "double").alias("qual"), _text(6).alias("filter"), _mapped(info).alias("info"), F.split(F.get(F.col("f"), F.lit(8)), ":").alias("fmt"), F.slice("f", 10, 1 << 20).alias("samples")
    )


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment lines with their tags as a map from name to value."""
    tags = F.transform(F.slice("f", 12, 1 << 20), lambda x: F.struct(F.substring(x, 1, 2).alias("key"), F.substring(x, 6, 1 << 20).alias("value")))
    return _fields(spark, path, "@").where(F.size("f") >= 11).select(
        F.get(F.col("f"), F.lit(0)).alias("qname"), _number(1, "int").alias("flag"), F.get(F.col("f"), F.lit(2)).alias("rname"), _number(3, "bigint").alias("pos"), _number(4, "int").alias("mapq"), F.get(F.col("f"), F.lit(5)).alias("cigar"),
        F.get(F.col("f"), F.lit(6)).alias("rnext"), _number(7, "bigint").alias("pnext"), _number(8, "bigint").alias("tlen"), F.get(F.col("f"), F.lit(9)).alias("seq"), F.get(F.col("f"), F.lit(10)).alias("qual"), _mapped(tags).alias("tags"),
    )


def delimited(spark: SparkSession, path: str, sep: str = "\t", header: bool = True) -> DataFrame:
    """A table of strings; ``typed`` turns columns that are mostly numbers into doubles."""
    return spark.read.option("sep", sep).option("header", header).option("mode", "PERMISSIVE").csv(path)


def typed(df: DataFrame, share: float = 0.6) -> DataFrame:
    """Columns of which at least a share of the cells (and one) are numbers become double; other cells are null."""
    good = lambda c: F.sum(F.expr(f"try_cast(`{c}` as double)").isNotNull().cast("long"))
    facts = df.agg(F.count("*").alias("n"), *[good(c).alias(c) for c in df.columns]).first()
    numeric = [c for c in df.columns if facts["n"] and facts[c] >= max(1, int(share * facts["n"]))]
    return df.withColumns({c: F.expr(f"try_cast(`{c}` as double)") for c in numeric})
