"""License scans by diagonal voting (operator 9).

All rolling word k-gram hashes of a document are joined to the positions of the same k-grams in license templates.
Each joined pair votes for a diagonal, document position less template position; votes are summed by diagonal,
neighbouring diagonals merge (words put in or left out), and a span is verified by the share of template words that
its matched k-grams cover; a diagonal's state is a mask of those words and its ends. The join compares the words of the k-grams too, so covered words are equal words, not
equal hashes. A bitmap of the template hashes drops, before the join, k-grams that no template has.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import checkpointed, map_texts, unused
from .words import split_words


@dataclass(frozen=True)
class Template:
    """A license text; ``share`` of its words must be covered, over diagonals at most ``drift`` apart."""

    label: str
    text: str
    share: float = 0.8
    drift: int = 2

    @property
    def words(self) -> list[bytes]:
        return split_words(self.text)

    @property
    def k(self) -> int:
        return 2 if len(self.words) < 12 else 4


#: Phrases that count wherever their words stand consecutively.
PHRASES = (
    Template("cc-by", "cc by", 1.0, 0),
    Template("gpl", "general public license", 1.0, 0),
    Template("reserved", "all rights reserved", 1.0, 0),
)
#: Notices of well-known public licenses.
NOTICES = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    Template("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("mit", "Released under the MIT License"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3"),
    Template("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Word hashes that a worker keeps.
MEMO = 100_000
HIT = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("hash", T.LongType()), T.StructField("gram", T.StringType())])
#: Template words in one mask of covered words.
BITS = 62


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of all runs of k word hashes, modulo 2^64."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = hashes[:n]
    for i in range(1, k):
        h = h * _STEP + hashes[i : i + n]
    return h ^ (h >> np.uint64(31))


def template_positions(templates: tuple[Template, ...]) -> list[tuple]:
    """(k, hash, gram, template, place, masks) of every k-gram of every template; the masks have the bits of the
    template words that the k-gram covers, BITS words each."""
    rows, n = [], masks(templates)
    for i, t in enumerate(templates):
        words, k = t.words, t.k
        h = rolling(np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64), k).view(np.int64).tolist()
        for p in range(len(h)):
            covered = ((1 << k) - 1) << p
            rows.append((k, h[p], b" ".join(words[p : p + k]).decode(), i, p, [covered >> m * BITS & (1 << BITS) - 1 for m in range(n)]))
    return rows


def masks(templates: tuple[Template, ...]) -> int:
    return max([1, *(-(-len(t.words) // BITS) for t in templates)])


def _hits(df: DataFrame, templates: tuple[Template, ...], text: str, keep: list[str] | None, out: str) -> DataFrame:
    """``df`` with n_words and, in ``out``, the k-grams of each text that may be in a template."""
    positions = template_positions(templates)
    maps = {k: np.zeros(1 << 16, bool) for k in sorted({p[0] for p in positions})}
    for k, h, *_ in positions:
        maps[k][h & 0xFFFF] = True

    def start():
        word_hash = _Hashes()

        def run(texts):
            sizes, ends, parts, grams = [], [0], [], []
            for text in texts:
                words = split_words(text)
                sizes.append(len(words))
                hashes = np.fromiter(map(word_hash.__getitem__, words), np.uint64, len(words))
                for k, bits in maps.items():
                    h = rolling(hashes, k)
                    at = np.flatnonzero(bits[(h & np.uint64(0xFFFF)).astype(np.intp)])
                    parts.append((np.full(len(at), k, np.int32), at, h[at].view(np.int64)))
                    grams += [b" ".join(words[p : p + k]).decode() for p in at.tolist()]
                ends.append(len(grams))
            flat = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3)]
            arrays = [pa.array(flat[0], pa.int32()), pa.array(flat[1], pa.int64()), pa.array(flat[2], pa.int64()), pa.array(grams, pa.string())]
            return sizes, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(arrays, HIT.names))

        return run

    return map_texts(df, text, {"n_words": T.LongType(), out: T.ArrayType(HIT)}, start, keep)


def scan(df: DataFrame, templates: tuple[Template, ...] = PHRASES + NOTICES, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` with n_words and spans: array<struct<start, end, template, label, share>> of verified license spans in
    words [start, end), by start.

    Null and empty texts have no words. Repeated rows are scanned each; columns named like an output are replaced.
    The rows that are kept are written out once with their k-grams and a number each, so that the numbers hold when
    executors are lost. The template positions, of fixed size, are broadcast to the join. Votes are shuffled by row;
    the state of a diagonal is its masks, its first and its last place, whatever the number of votes.
    """
    spark = df.sparkSession
    stay = [c for c in (df.columns if keep is None else keep) if c not in ("n_words", "spans")]
    row, own = unused(df.columns, "_row", "_hits")
    hits = checkpointed(_hits(df, templates, text, stay, own).withColumn(row, F.monotonically_increasing_id()))
    grams = spark.createDataFrame(template_positions(templates), "t_k int, t_hash long, t_gram string, template int, place long, covers array<long>")
    grams = grams.select("t_k", "t_hash", "t_gram", "template", "place", *[F.col("covers")[m].alias(f"m{m}") for m in range(masks(templates))])
    one = hits.where(F.size(own) > 0).select(F.col(row).alias("_row"), F.inline(own))
    votes = one.join(F.broadcast(grams), (F.col("k") == F.col("t_k")) & (F.col("hash") == F.col("t_hash")) & (F.col("gram") == F.col("t_gram")))
    found = _spans(votes, templates).groupBy("_row").agg(F.sort_array(F.collect_list("span")).alias("spans"))
    at, made = unused([*hits.columns, row], "_of", "_spans")
    whole = hits.drop(own).join(found.select(F.col("_row").alias(at), F.col("spans").alias(made)), F.col(row) == F.col(at), "left")
    none = F.array().cast("array<struct<start: bigint, end: bigint, template: int, label: string, share: double>>")
    return whole.select(*[F.col(f"`{c}`") for c in stay], "n_words", F.coalesce(made, none).alias("spans"))


def _facts(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    rows = [(i, t.label, t.share, t.drift, t.k, len(t.words)) for i, t in enumerate(templates)]
    return spark.createDataFrame(rows, "of int, label string, least double, drift int, t_words int, size int")


def _spans(votes: DataFrame, templates: tuple[Template, ...]) -> DataFrame:
    """(_row, span) of the verified spans of votes (_row, template, place, at, masks).

    Diagonals at most ``drift`` apart merge. A merged group that is too long for one template (several occurrences
    on near diagonals) is cut: from each of its diagonals on, those that an occurrence of the greatest length can lie
    on are verified together, and a verified cut stays if no overlapping one has a larger share (or the same one and
    an earlier diagonal).
    """
    names = [f"m{m}" for m in range(masks(templates))]
    diagonals = votes.groupBy("_row", "template", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        *[F.bit_or(m).alias(m) for m in names], F.min("at").alias("first"), F.max("at").alias("last")
    )
    known = diagonals.join(F.broadcast(_facts(votes.sparkSession, templates)), F.col("template") == F.col("of"))
    by = Window.partitionBy("_row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > F.col("drift"), F.lit(False)).cast("int")
    grouped = known.withColumn("apart", apart).withColumn("group", F.sum("apart").over(by))
    group = Window.partitionBy("_row", "template", "group")
    merged = {f"all_{m}": F.bit_or(m).over(group) for m in names} | {"all_first": F.min("first").over(group), "all_last": F.max("last").over(group), "least_diagonal": F.min("diagonal").over(group)}
    longest = F.ceil(F.col("size") / F.col("least"))
    judged = grouped.withColumns(merged).withColumn("whole", F.col("all_last") + F.col("t_words") - F.col("all_first") <= longest)
    whole = judged.where(F.col("whole") & (F.col("diagonal") == F.col("least_diagonal")))
    made = lambda df, of, first, last: df.withColumns({"share": sum((F.bit_count(of(m)) for m in names), F.lit(0)) / F.col("size"), "start": F.col(first), "end": F.col(last) + F.col("t_words")}).where(F.col("share") >= F.col("least"))
    kept = [made(whole, lambda m: F.col(f"all_{m}"), "all_first", "all_last")]
    for slack in sorted({math.ceil(len(t.words) / t.share) - len(t.words) for t in templates}):
        ahead = Window.partitionBy("_row", "template", "group").orderBy("diagonal").rangeBetween(0, slack)
        around = Window.partitionBy("_row", "template", "group").orderBy("diagonal").rangeBetween(-slack, slack)
        open_ = judged.where(~F.col("whole") & (longest - F.col("size") == slack))
        cuts = open_.withColumns({f"cut_{m}": F.bit_or(m).over(ahead) for m in names} | {"cut_first": F.min("first").over(ahead), "cut_last": F.max("last").over(ahead)})
        best = F.max(F.struct("share", (-F.col("diagonal")).alias("earlier"))).over(around)
        kept.append(made(cuts, lambda m: F.col(f"cut_{m}"), "cut_first", "cut_last").withColumn("best", best).where(F.col("best.earlier") == -F.col("diagonal")))
    found = None
    for part in kept:
        own = part.select("_row", F.struct(F.col("start"), F.col("end"), "template", "label", "share").alias("span"))
        found = own if found is None else found.unionAll(own)
    return found
