"""Pairwise alignment by dynamic programming, vectorised over batches of pairs of equal shape."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as s

#: Most k-mers of a target that is found by pairs of them, and the finest classes (powers of 2) in which pairs are made.
LONG, FINEST = 256, 7
#: Cells of a row of the tables that pairs fill together.
CELLS = 1 << 16


def scores(a: str, b: str, match: int = 2, mismatch: int = -1, gap: int = -2, local: bool = False) -> int:
    """Best score of a global (or local) alignment with linear gaps; a row of the table at a time, the gaps within a
    row by a running maximum."""
    x, y = np.frombuffer(a.encode("utf-32-le"), "<u4"), np.frombuffer(b.encode("utf-32-le"), "<u4")
    steps = gap * np.arange(len(y) + 1)
    row = np.zeros(len(y) + 1, np.int64) if local else steps.copy()
    best = 0
    for i, c in enumerate(x):
        new = np.empty_like(row)
        new[0] = 0 if local else gap * (i + 1)
        new[1:] = np.maximum(row[:-1] + np.where(y == c, match, mismatch), row[1:] + gap)
        if local:
            new = np.maximum(new, 0)
        new = np.maximum.accumulate(new - steps) + steps
        row = new
        best = max(best, int(row.max()))
    return best if local else int(row[-1])


def _padded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Texts as columns of letters, and their lengths."""
    size = np.array([len(x) for x in texts], np.int64)
    made = np.zeros((len(texts), int(size.max(initial=0))), np.uint32)
    made[np.arange(made.shape[1]) < size[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return np.ascontiguousarray(made.T), size


def many_scores(a: list[str], b: list[str], match: int = 2, mismatch: int = -1, gap: int = -2, local: bool = False) -> np.ndarray:
    """``scores`` of many pairs: pairs of similar lengths fill a table of CELLS together, a row of all of them at a time.
    What lies beyond a text's end comes after all of its own cells, and counts nowhere."""
    found = np.zeros(len(a), np.int64)
    order = sorted(range(len(a)), key=lambda i: (len(b[i]), len(a[i])))
    low = 0
    while low < len(order):
        high = low + 1
        while high < len(order) and (high - low + 1) * (len(b[order[high]]) + 1) <= CELLS:
            high += 1
        own, low = order[low:high], high
        (x, n), (y, m) = _padded([a[i] for i in own]), _padded([b[i] for i in own])
        number = np.int32 if (x.shape[0] + y.shape[0] + 2) * max(abs(match), abs(mismatch), abs(gap)) < 1 << 30 else np.int64
        steps = np.arange(y.shape[0] + 1, dtype=number)[:, None] * number(gap)
        row = np.zeros((y.shape[0] + 1, len(own)), number) + (number(0) if local else steps)
        best = np.zeros(len(own), np.int64) if local else m * gap
        beyond = np.arange(y.shape[0] + 1)[:, None] > m
        for i in range(x.shape[0]):
            new = np.empty_like(row)
            new[0] = 0 if local else gap * (i + 1)
            np.maximum(row[:-1] + np.where(y == x[i], number(match), number(mismatch)), row[1:] + number(gap), out=new[1:])
            if local:
                np.maximum(new, 0, out=new)
            new -= steps
            if len(own) < 64:
                np.maximum.accumulate(new, axis=0, out=new)
            else:
                for j in range(1, len(new)):
                    np.maximum(new[j], new[j - 1], out=new[j])
            new += steps
            row = new
            if local:
                best = np.where(i < n, np.maximum(best, np.where(beyond, 0, row).max(0)), best)
            else:
                best = np.where(i == n - 1, row[m, np.arange(len(own))], best)
        found[own] = best
    return found


def aligned(pairs: DataFrame, a: str, b: str, keep: list[str], match: int = 2, mismatch: int = -1, gap: int = -2, local: bool = False) -> DataFrame:
    """``keep`` columns and the score of each pair of texts (null: empty)."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields if f.name in keep) + ", score long"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = many_scores([x or "" for x in frame["_a"]], [y or "" for y in frame["_b"]], match, mismatch, gap, local)
            yield frame.drop(columns=["_a", "_b"]).assign(score=made)

    ordered = [f.name for f in pairs.schema.fields if f.name in keep]
    return pairs.select(*ordered, F.col(a).alias("_a"), F.col(b).alias("_b")).mapInPandas(run, schema)


#: BLOSUM62, rows and columns in this order; other letters: -1, and their own kind too.
_RESIDUES = "ARNDCQEGHILKMFPSTWYV"
_BLOSUM62 = """4 -1 -2 -2 0 -1 -1 0 -2 -1 -1 -1 -1 -2 -1 1 0 -3 -2 0
-1 5 0 -2 -3 1 0 -2 0 -3 -2 2 -1 -3 -2 -1 -1 -3 -2 -3
-2 0 6 1 -3 0 0 0 1 -3 -3 0 -2 -3 -2 1 0 -4 -2 -3
-2 -2 1 6 -3 0 2 -1 -1 -3 -4 -1 -3 -3 -1 0 -1 -4 -3 -3
0 -3 -3 -3 9 -3 -4 -3 -3 -1 -1 -3 -1 -2 -3 -1 -1 -2 -2 -1
-1 1 0 0 -3 5 2 -2 0 -3 -2 1 0 -3 -1 0 -1 -2 -1 -2
-1 0 0 2 -4 2 5 -2 0 -3 -3 1 -2 -3 -1 0 -1 -3 -2 -2
0 -2 0 -1 -3 -2 -2 6 -2 -4 -4 -2 -3 -3 -2 0 -2 -2 -3 -3
-2 0 1 -1 -3 0 0 -2 8 -3 -3 -1 -2 -1 -2 -1 -2 -2 2 -3
-1 -3 -3 -3 -1 -3 -3 -4 -3 4 2 -3 1 0 -3 -2 -1 -3 -1 3
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4 -2 2 0 -3 -2 -1 -2 -1 1
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5 -1 -3 -1 0 -1 -3 -2 -2
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5 0 -2 -1 -1 -1 -1 1
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6 -4 -2 -2 1 3 -1
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7 -1 -1 -4 -3 -2
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4 1 -3 -2 -2
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5 -2 -2 0
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11 2 -3
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7 -1
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4"""


def _letters(alphabet: str, rows: list[list[int]], other: int) -> np.ndarray:
    """Points of two letters by their codes; all others, the padding (0) too, have ``other``."""
    made = np.full((128, 128), other, np.int16)
    at = [ord(x) for x in alphabet]
    made[np.ix_(at, at)] = rows
    return made


@dataclass(frozen=True)
class Search:
    """Points and statistics of a search: of letters, of a gap of n (opening and n times extension), lambda and K of
    ungapped and gapped scores, the bits that an ungapped extension needs, how far it may fall below its best, and
    whether the other strand is searched and words of three or fewer letter triples are masked."""

    points: np.ndarray
    gap_open: int
    gap_extend: int
    ungapped: tuple[float, float]
    gapped: tuple[float, float]
    trigger: float
    drop: int
    strands: bool

    def bits(self, score: Column) -> Column:
        return (score * self.gapped[0] - math.log(self.gapped[1])) / math.log(2)


#: The published values of these schemes, and the defaults of blastn and blastp.
NUCLEOTIDE = Search(_letters("ACGT", [[2 if i == j else -3 for j in range(4)] for i in range(4)], -3), 5, 2, (0.634, 0.408), (0.625, 0.41), 27.0, 22, True)
PROTEIN = Search(_letters(_RESIDUES, [[int(x) for x in row.split()] for row in _BLOSUM62.split("\n")], -1), 11, 1, (0.3176, 0.134), (0.267, 0.041), 22.0, 16, False)
#: Letters on either side of a word that its ungapped extension reaches: what meets the bits that are asked for is shorter.
FLANK = 32


def local_scores(a: list[str], b: list[str], scheme: Search) -> np.ndarray:
    """Best local scores of pairs of texts with affine gaps; tables are filled as in ``many_scores``."""
    found = np.zeros(len(a), np.int64)
    order = sorted(range(len(a)), key=lambda i: (len(b[i]), len(a[i])))
    low, first = 0, np.int32(scheme.gap_open + scheme.gap_extend)
    while low < len(order):
        high = low + 1
        while high < len(order) and (high - low + 1) * (len(b[order[high]]) + 1) <= CELLS:
            high += 1
        own, low = order[low:high], high
        (x, _), (y, _) = _padded([a[i] for i in own]), _padded([b[i] for i in own])
        x, y = np.minimum(x, 127), np.minimum(y, 127)
        points = scheme.points.astype(np.int32)
        points[0] = points[:, 0] = -(1 << 20)  # what lies beyond a text's end pairs with nothing
        x, points = x.astype(np.int32) << 7, points.ravel()
        y = y.astype(np.int32)
        steps = np.arange(y.shape[0] + 1, dtype=np.int32)[:, None] * np.int32(scheme.gap_extend)
        row = np.zeros((y.shape[0] + 1, len(own)), np.int32)
        gap, best = np.full_like(row, -(1 << 20)), np.zeros(len(own), np.int32)
        for i in range(x.shape[0]):
            gap = np.maximum(row - first, gap - np.int32(scheme.gap_extend))
            new = np.maximum(gap, 0)
            np.maximum(new[1:], row[:-1] + points.take(y + x[i]), out=new[1:])
            run = new + steps
            if len(own) < 64:
                np.maximum.accumulate(run, axis=0, out=run)
            else:
                for j in range(1, len(run)):
                    np.maximum(run[j], run[j - 1], out=run[j])
            np.maximum(new[1:], run[:-1] - steps[1:] - np.int32(scheme.gap_open), out=new[1:])
            row = new
            np.maximum(best, row.max(0), out=best)
        found[own] = best
    return found


def _rows(texts: pa.Array, width: int) -> np.ndarray:
    """Texts of ``width`` ASCII letters as columns of codes, read where Arrow holds them."""
    first = np.frombuffer(texts.buffers()[1], np.int32, 1, 4 * texts.offset)[0]
    return np.ascontiguousarray(np.frombuffer(texts.buffers()[2], np.uint8, width * len(texts), first).reshape(-1, width).T)


def extended(x: np.ndarray, y: np.ndarray, k: int, scheme: Search) -> np.ndarray:
    """Scores of the ungapped extension of words of ``k`` letters between FLANK others of two texts, to either side as far
    as the score falls no further than ``drop`` below its best; letters are rows, 0 lies beyond a text."""
    table = scheme.points.astype(np.int16)
    table[0] = table[:, 0] = -512  # far below any drop; 64 of them fit the type
    points = table.ravel()[x.astype(np.int16) << 7 | y]
    total = points[FLANK : FLANK + k].sum(0, dtype=np.int32)
    for side in (points[:FLANK][::-1], points[FLANK + k :]):
        now, best, on = np.zeros_like(side[0]), np.zeros_like(side[0]), np.ones(side.shape[1], bool)
        for row in side:
            now = now + row
            on &= best - now <= scheme.drop
            best = np.where(on, np.maximum(best, now), best)
        total = total + best
    return total


def _words(df: DataFrame, k: int, mask: bool) -> DataFrame:
    """(id, strand, size, word, at, context) of records (id, strand, seq): words with FLANK letters on either side."""
    each = df.select("id", "strand", F.length("seq").alias("size"), F.concat(F.repeat(F.lit("\0"), F.lit(FLANK)), "seq", F.repeat(F.lit("\0"), F.lit(FLANK))).alias("_s"))
    at = each.where(F.col("size") >= k).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - (k - 1))))
    words = at.select("id", "strand", "size", F.substring("_s", F.col("at") + FLANK, F.lit(k)).alias("word"), "at", F.substring("_s", F.col("at"), F.lit(k + 2 * FLANK)).alias("context"))
    if not mask:
        return words
    triples = F.transform(F.sequence(F.lit(1), F.lit(k - 2)), lambda i: F.substring("word", i, F.lit(3)))
    return words.where(F.size(F.array_distinct(triples)) > 3)


def hits(queries: DataFrame, subjects: DataFrame, k: int, scheme: Search, least: int = 2) -> DataFrame:
    """(query, subject, strand, seeds): pairs of records (id, seq) with ``least`` words of the query or more whose ungapped
    extension in the subject reaches the scheme's trigger. Words meet in a merge join, and each hit is extended where
    it is found, by the letters that words carry along; only what was extended well is sent on."""
    forward = lambda df: df.select("id", F.lit("+").alias("strand"), F.regexp_replace(F.upper("seq"), "[^\\x00-\\x7F]", "?").alias("seq"))
    there = forward(subjects)
    if scheme.strands:
        there = there.unionAll(there.select("id", F.lit("-").alias("strand"), s.revcomp(F.col("seq")).alias("seq")))
    q = _words(forward(queries), k, scheme.strands).select(F.col("id").alias("query"), "word", F.col("at").alias("at"), F.col("context").alias("_x"))
    t = _words(there, k, False).select(F.col("id").alias("subject"), "strand", F.col("word").alias("_word"), F.col("context").alias("_y"))
    # numbers sort faster than words; words are compared where numbers are equal (not as keys: those would be sorted too)
    q, t = q.withColumn("key", F.xxhash64("word")), t.withColumn("_key", F.xxhash64("_word"))
    met = q.join(t.hint("merge"), (F.col("key") == F.col("_key")) & (F.col("word") <= F.col("_word")) & (F.col("word") >= F.col("_word"))).select("query", "subject", "strand", "at", "_x", "_y")
    needed = (scheme.trigger * math.log(2) + math.log(scheme.ungapped[1])) / scheme.ungapped[0]
    kind = {f.name: f.dataType.simpleString() for f in met.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                good = extended(*(_rows(batch.column(c), k + 2 * FLANK) for c in ("_x", "_y")), k, scheme) >= needed
                yield batch.select(["query", "subject", "strand", "at"]).filter(pa.array(good))

    good = met.mapInArrow(run, f"query {kind['query']}, subject {kind['subject']}, strand string, at int")
    return good.groupBy("query", "subject", "strand").agg(F.count_distinct("at").alias("seeds")).where(F.col("seeds") >= least)


def searched(queries: DataFrame, subjects: DataFrame, k: int = 11, seeds: int = 2, best: int | None = 5, scheme: Search = NUCLEOTIDE, evalue: float = 1e-5) -> DataFrame:
    """(query, subject, strand, seeds, score, bits, evalue): hits of words, extended without gaps and then scored by local
    alignment with affine gaps, whose E-value (for the letters of all subjects) is ``evalue`` or less; the ``best``
    subjects of each query by score, then name. One sum of the subjects' letters runs while this is called."""
    from pyspark.sql.window import Window

    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # pairs are few bytes and much work
    letters = subjects.agg(F.sum(F.length("seq"))).first()[0] or 0
    found = hits(queries.repartition(parts), subjects.repartition(parts), k, scheme, seeds)
    # records grow with the tables, whatever the planner takes their size for: merged, never sent whole through the driver
    t = subjects.select(F.col("id").alias("_t"), F.upper("seq").alias("t"))
    q = queries.select(F.col("id").alias("_q"), F.upper("seq").alias("q"))
    near = found.join(t.hint("merge"), F.col("subject") == F.col("_t")).drop("_t")
    both = near.repartition(parts, "query").join(q.hint("merge"), F.col("query") == F.col("_q")).drop("_q")
    if scheme.strands:
        both = both.withColumn("t", F.when(F.col("strand") == "-", s.revcomp(F.col("t"))).otherwise(F.col("t")))
    kind = {f.name: f.dataType.simpleString() for f in both.schema.fields}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[["query", "subject", "strand", "seeds"]].assign(size=frame["q"].str.len(), score=local_scores(list(frame["q"]), list(frame["t"]), scheme))

    scored = both.select("query", "subject", "strand", "seeds", "q", "t").mapInPandas(run, f"query {kind['query']}, subject {kind['subject']}, strand string, seeds long, size long, score long")
    top = scored.groupBy("query", "subject").agg(F.max_by(F.struct("strand", "seeds", "size"), F.struct("score", F.col("strand") == "+")).alias("x"), F.max("score").alias("score"))
    kept = top.select("query", "subject", "x.strand", "x.seeds", "score", scheme.bits(F.col("score")).alias("bits"), "x.size")
    kept = kept.withColumn("evalue", F.lit(float(letters)) * F.col("size") * F.pow(F.lit(2.0), -F.col("bits"))).where(F.col("evalue") <= evalue).drop("size")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "subject"))
    return kept if best is None else kept.withColumn("_n", rank).where(F.col("_n") <= best).drop("_n")


def _pair_keys(df: DataFrame, k: int, share: float | None, levels: list[int], only_levels: bool = False) -> DataFrame:
    """(name, key) of records (name, seq): pairs of distinct canonical k-mers of the same class, one of 2 ^ level by hash.

    Of reads (``share``): at the finest level with fewer classes in use than k-mers that a target must share, so two of
    those lie in one class; level -1, without keys, where one is enough. Of targets: at each of ``levels``; none of
    those with over LONG k-mers. ``only_levels``: the levels of reads instead, as keys."""
    kind = df.schema["name"].dataType.simpleString()
    hashes = F.transform(F.array_distinct(s.kmers(F.col("_seq"), k, True)), lambda m: F.xxhash64(m))

    def filed(row: np.ndarray, x: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        of = (x & ((np.uint64(1) << level.astype(np.uint64)) - np.uint64(1))).astype(np.int64)
        order = np.lexsort((x, of, level, row))
        row, x, of, level = row[order], x[order], of[order], level[order]
        rows, keys = [row[:0]], [x[:0]]
        for d in range(1, len(x)):
            both = np.flatnonzero((row[d:] == row[:-d]) & (of[d:] == of[:-d]) & (level[d:] == level[:-d]))
            if not len(both):
                break
            rows.append(row[both])
            keys.append(x[both] * np.uint64(0x9E3779B97F4A7C15) ^ (x[both + d] + level[both].astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F))
        return np.concatenate(rows), np.concatenate(keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for low in range(0, len(whole), 1000):
                frame = whole.iloc[low : low + 1000]
                sizes = np.array([len(x) for x in frame["_h"]])
                if not sizes.sum():
                    continue
                row, x = np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.asarray(h, np.int64) for h in frame["_h"]]).view(np.uint64)
                if share is None:
                    fits = sizes[row] <= LONG
                    row, x = np.tile(row[fits], len(levels)), np.tile(x[fits], len(levels))
                    level = np.repeat(np.array(levels, np.int64), len(row) // max(1, len(levels)))
                else:
                    need = np.ceil(share * sizes - 1e-9)
                    own = np.where(need >= 2, 0, -1)
                    for n in range(1, FINEST + 1):
                        used = np.bincount(np.unique(row << FINEST | (x & np.uint64((1 << n) - 1)).astype(np.int64)) >> FINEST, minlength=len(sizes))
                        own = np.where(used < need, n, own)
                    if only_levels:
                        yield pd.DataFrame({"name": frame["name"].to_numpy()[sizes > 0], "key": own[sizes > 0]}).drop_duplicates("key")
                        continue
                    taken = own[row] >= 0
                    row, x = row[taken], x[taken]
                    level = own[row]
                row, key = filed(row, x, level)
                yield pd.DataFrame({"name": frame["name"].to_numpy()[row], "key": key.view(np.int64)})

    return df.withColumn("_seq", F.upper("seq")).select("name", hashes.alias("_h")).mapInPandas(run, f"name {kind}, key long")


def assigned_by_kmers(reads: DataFrame, targets: DataFrame, k: int = 15, share: float = 0.5) -> DataFrame:
    """(read, target, share): the target with the greatest share of a read's canonical k-mers, if it reaches the cut;
    of equal ones the greatest name.

    Reads and targets meet by pairs of k-mers (see ``_pair_keys``), which hardly meet by chance where single ones do, and
    lose no target that reaches the cut. Targets of over LONG k-mers, and reads for which one k-mer is enough, meet by
    single ones. What meets is counted exactly. Small jobs that look for these cases run while this is called."""
    parts = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # short rows in few files are much work
    r = reads.select(F.col("id").alias("name"), "seq").repartition(parts)
    t = targets.groupBy("id", "seq").agg(F.lit(1).alias("_one")).select(F.col("id").alias("name"), "seq").repartition(parts)
    levels = [x["key"] for x in _pair_keys(r, k, share, [], True).select("key").distinct().collect()]  # FINEST + 2 at most
    kmers = lambda c: F.array_distinct(s.kmers(F.upper(c), k, True))
    left = _pair_keys(r, k, share, []).select(F.col("name").alias("read"), "key")
    right = _pair_keys(t, k, None, sorted(x for x in levels if x >= 0)).select(F.col("name").alias("target"), "key")
    met = left.join(right.hint("merge"), "key").select("read", "target")
    size = F.length("seq") - k + 1
    singles = lambda df, name: df.select(F.col("name").alias(name), F.explode(kmers("seq")).alias("kmer"))
    if not t.where(size > LONG).isEmpty():
        met = met.unionAll(singles(r, "read").join(singles(t.where(size > LONG), "target").hint("merge"), "kmer").select("read", "target"))
    if -1 in levels:
        few = r.where(F.ceil(share * F.size(kmers("seq")) - 1e-9) < 2)
        met = met.unionAll(singles(few, "read").join(singles(t, "target").hint("merge"), "kmer").select("read", "target"))
    both = met.distinct().join(r.select(F.col("name").alias("read"), F.col("seq").alias("_x")).hint("merge"), "read").join(t.select(F.col("name").alias("target"), F.col("seq").alias("_y")).hint("merge"), "target")
    own = both.withColumn("_own", kmers("_x"))
    hits = own.select("read", "target", (F.size(F.array_intersect("_own", kmers("_y"))) / F.size("_own")).alias("share"))
    top = hits.where(F.col("share") >= share).groupBy("read").agg(F.max(F.struct("share", "target")).alias("x"))
    return top.select("read", "x.target", "x.share")


def sketches(df: DataFrame, k: int = 21, num: int = 500) -> DataFrame:
    """(id, sketch): the ``num`` least hashes of each record's canonical k-mers, sorted."""
    hashes = F.sort_array(F.transform(F.array_distinct(s.kmers(F.upper("seq"), k, True)), lambda x: F.md5(x.cast("binary"))))
    return df.select("id", F.slice(hashes, 1, num).alias("sketch"))


def mash_distances(queries: DataFrame, database: DataFrame, k: int = 21, num: int = 500) -> DataFrame:
    """(query, target, shared, jaccard, distance): MinHash estimates for all pairs whose sketches share a hash; the
    distance of all others is 1. Of both sketches' union the ``num`` least hashes count; that they are among these follows
    from their ranks in both, so each common hash sends two numbers, not the sketches. Equal records of an id count once."""
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # short rows in few files are much work

    def side(df: DataFrame, name: str, n: str) -> DataFrame:
        own = F.shiftleft(F.xxhash64("sketch"), 16).bitwiseOR(F.size("sketch").cast("long"))  # tells records of one id apart
        each = sketches(df.select("id", "seq").repartition(parts), k, num).select(F.col("id").alias(name), own.alias(f"_own{n}"), "sketch")
        each = each.select(name, f"_own{n}", F.posexplode("sketch").alias(f"_rank{n}", "_hash"))  # no sketch goes along with its hashes
        return each.withColumn("_hash", F.unhex("_hash")).withColumn(f"_rank{n}", F.col(f"_rank{n}").cast("short"))

    # rows are far more than the planner takes them for: merged, never sent whole through the driver
    met = side(queries, "query", "1").join(side(database, "target", "2").hint("merge"), "_hash")
    common = met.groupBy("query", "target", "_own1", "_own2").agg(F.sort_array(F.collect_set(F.struct("_rank1", "_rank2"))).alias("_c"))
    # before the i-th common hash, from 0, the union has as many hashes as both sketches together, less i
    shared = F.size(F.filter("_c", lambda x, i: x["_rank1"] + x["_rank2"] - i < num))
    sizes = sum((F.col(c).bitwiseAND(F.lit(65535)) for c in ("_own1", "_own2")), F.lit(0)).cast("int")
    counted = common.select("query", "target", shared.alias("shared"), F.least(F.lit(num), sizes - F.size("_c")).alias("_n"))
    made = counted.where("shared > 0").withColumn("jaccard", F.col("shared") / F.col("_n"))
    return made.select("query", "target", "shared", "jaccard", (-F.log(2 * F.col("jaccard") / (1 + F.col("jaccard"))) / k).alias("distance"))


def screened(reads: DataFrame, hosts: DataFrame, k: int = 11, share: float = 0.9) -> DataFrame:
    """(id, status, target, share): every read removed or kept by its best host, that with the greatest share of its
    canonical k-mers; without a host that reaches the cut a read is kept."""
    hits = assigned_by_kmers(reads, hosts, k, share)
    both = reads.select("id").join(hits, F.col("id") == F.col("read"), "left")
    return both.select("id", F.when(F.col("target").isNotNull(), "removed").otherwise("kept").alias("status"), "target", "share")
