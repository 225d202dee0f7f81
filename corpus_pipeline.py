"""A corpus from documents to token ids, in five stages over whole tables.

Each stage works on all rows that the one before it kept. Written as Parquet and read again between the stages, any
of them can be started anew.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import bpe, decontam, neardup, quality, secrets
from spindrift.llm.common import checkpointed, table
from spindrift.llm.queries import quality_ranker


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the cut; the ranker learns from the labels table."""
    scored = quality.score(docs, quality_ranker(spark, sf_dir), out="_quality")
    return scored.where(F.col("_quality") >= quality.CUT).drop("_quality")


def near_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: similarity 0.8 or more of their sets of five-word shingles, found by
    SimHash (operator 3) and, where fingerprints are too far apart, by an exact join."""
    return neardup.deduplicated(docs, width=5, share=0.8)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window."""
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret, and their new lengths."""
    hidden = secrets.masked(secrets.scan(docs, out="_secrets"), spans="_secrets")
    changed = F.when(F.size("_secrets") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return hidden.withColumn("n_chars", changed).select(docs.columns)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents (packed), and a digest of what they decode to."""
    vocab = bpe.vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    back = bpe.round_trip(docs, vocab, keep=["doc_id", "lang", "source"])
    return back.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", near_deduplicated),
    ("benchmark decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("byte-level BPE", tokenized),
]

#: SQL can't express the trained ranking, the components and the merges; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each on a checkpoint of the one before."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else checkpointed(docs), sf_dir)
    return docs
