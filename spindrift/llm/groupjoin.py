"""N-gram Jaccard join by a token-group matrix (operator 13).

A text is the set of the 64-bit hashes of its word shingles, its tokens; equal sets are one set. Sets link if their
Jaccard similarity reaches ``share``, and the join gives the components of all links.

All tokens have one global order, from rare to common by the cells of a counting sketch; of two similar sets, the
first n - ceil(share * n) + 1 tokens of each, its prefix, have one in common. So only prefixes travel, packed by task,
and only sets whose prefix has a token of another set of similar size go on. With each set goes a row of bits by cell
of its tokens; two sets differ in as many tokens at least as these rows differ in places, which decides most pairs.

Similar sets are first put into groups: sets with the same least token under a seeded permutation (or what the caller
adds) are tied to the most ordinary of them, if the bits allow a similarity a quarter lower. The matrix then stores,
for each group, the union of its members' tokens: the prefix tokens as rows (token, group) with the least and the
largest member, and all tokens as bits by cell. A set meets, as a query, its own group, and the groups in the rows of
its own prefix. It has at most as many tokens in a group's union as it has tokens, less one for each of its cells that
the group lacks; a group with a smaller bound than ``share`` of the set, or without a member of similar size, holds no
partner and stays closed. In groups that are opened, the bits are compared with members of other components, and
what they leave is checked exactly on whole sets, the nearest pairs first; once a link joins two components, their
other pairs need no check.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, slices, tidied
from .simhash import SEED, components, majority

#: Cells of the counting sketch, and those in one row of it.
CELLS, PART = 1 << 20, 1 << 16
#: Rows of 16 to 40 bytes up to which a table of keys or pairs is broadcast.
SENT = 500_000
#: 64-bit words of a set's bits by cell.
WORDS = 16
#: Tokens from which a set has a second row of odd bits, and the 64-bit words of that.
LARGE, WIDE = 1024, 128
#: Prefix tokens that a task holds at once; parts by hash that they are packed in, at least, and tokens of a part (about).
HELD, PARTS, PART_TOKENS = 1 << 20, 256, 1 << 18
#: Sets of a task up to which a token's owners travel packed.
MANY = 16
#: Words whose hashes a worker remembers.
KNOWN = 1 << 17
#: Members of opened groups that a set meets in the first round.
NEAREST = 4
#: Share of ``share`` that ties a set to the leader of its group.
LOOSE = Fraction(3, 4)

_C, _D = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_FLAG = np.uint32(1 << 31)


class _Hashes(dict):
    """The hash of each word."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word, SEED)
        return h


def mixed(h: np.ndarray, seed: int = 0) -> np.ndarray:
    h = (h ^ np.uint64(seed)) * _D
    h = (h ^ (h >> np.uint64(32))) * _C
    return h ^ (h >> np.uint64(29))


def sets_of(texts: list[str | None], width: int, known: _Hashes | None = None) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word shingles; all of a shorter text is one; no words have none."""
    known = _Hashes() if known is None else known
    if len(known) > KNOWN:
        known.clear()
    split = [(t or "").encode().lower().split() for t in texts]  # bytes: only A-Z change, only ASCII white space splits
    sizes = np.array([len(w) for w in split], np.int64)
    words = np.fromiter(map(known.__getitem__, itertools.chain.from_iterable(split)), np.uint64, int(sizes.sum()))
    n = max(0, len(words) - width + 1)
    h = np.full(n, width, np.uint64)
    for j in range(width):
        h = (h + words[j : j + n]) * _C
    h = mixed(h)
    found, at = [], 0
    for size in sizes.tolist():
        if size >= width:
            found.append(np.unique(h[at : at + size - width + 1]))
        elif size:
            whole = size
            for w in words[at : at + size].tolist():
                whole = (whole + w) * int(_C) & (1 << 64) - 1
            found.append(mixed(np.array([whole], np.uint64)))
        else:
            found.append(np.zeros(0, np.uint64))
        at += size
    return found


def set_key(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.astype("<u8").tobytes())


def cell_bits(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of 64 * WORDS cells, as bits, whether a token falls in it, and whether an odd number of them do. Two
    sets' odd bits differ in no more places than the sets do."""
    n = np.bincount((own >> np.uint64(32)).astype(np.int64) % (64 * WORDS), minlength=64 * WORDS)
    pack = lambda x: np.packbits(x.astype(np.uint8), bitorder="little").view("<i8")
    return pack(n > 0), pack(n & 1)


def wide_bits(own: np.ndarray) -> np.ndarray | None:
    """The odd bits by 64 * WIDE cells of a set of more than LARGE tokens, which would fill the others."""
    if len(own) <= LARGE:
        return None
    odd = np.bincount((own >> np.uint64(32)).astype(np.int64) % (64 * WIDE), minlength=64 * WIDE) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def prefix_size(n: int, share: Fraction) -> int:
    return n - math.ceil(share * n) + 1 if n else 0


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list]]:
    for at, n in slices(batch.column(column)):
        yield at, n, batch.column(column).slice(at, n).to_pylist()


def marked(df: DataFrame, id: str, text: str, width: int) -> DataFrame:
    """(id, key, n) of each row (n: tokens of its set), and, in rows of their own, the parts of each task's sketch
    (part, cells)."""
    taken = df.select(F.col(id).alias("id"), F.col(text).alias("text"))

    def run(batches):
        cells, known, kind = np.zeros(CELLS, np.uint8), _Hashes(), None
        names = ["id", "key", "n", "part", "cells"]
        for batch in batches:
            kind = batch.column(0).type
            for at, n, texts in _texts(batch, 1):
                found = sets_of(texts, width, known)
                for own in found:
                    c = (own % np.uint64(CELLS)).astype(np.int64)
                    cells[c] += cells[c] < 255
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(map(set_key, found), pa.binary()), pa.array([len(x) for x in found], pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        used = [p for p in range(CELLS // PART) if cells[p * PART : (p + 1) * PART].any()]
        if used:
            parts = [cells[p * PART : (p + 1) * PART].tobytes() for p in used]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(used), kind), pa.nulls(len(used), pa.binary()), pa.nulls(len(used), pa.int64()), pa.array(used, pa.int32()), pa.array(parts, pa.binary())], names=names)

    return taken.mapInArrow(run, f"id {taken.schema['id'].dataType.simpleString()}, key binary, n long, part int, cells binary")


def ranks(parts: DataFrame) -> np.ndarray:
    """The rank of each cell by its count, summed over the tasks' sketches (part, cells), from 0 to 65,535.

    The sketch has a fixed size. In a corpus of far more tokens than cells, rare tokens' cells hold about as many and
    come in any order, but a token more frequent than the spread of these counts still ranks above nearly all others;
    so hot tokens stay out of prefixes at any size."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums.setdefault(p, np.zeros(PART, np.int64))
                sums[p] += np.frombuffer(own, np.uint8)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["part", "cells"])

    count = np.zeros(CELLS, np.int64)
    for r in parts.repartition("part").mapInArrow(run, "part int, cells binary").collect():
        count[r.part * PART : (r.part + 1) * PART] = np.frombuffer(r.cells, np.int64)
    values, at, n = np.unique(count, return_inverse=True, return_counts=True)
    return ((np.cumsum(n) - n) * 65_535 // max(1, CELLS)).astype(np.uint16)[at]


def _packed(tokens: np.ndarray, owner: np.ndarray, size: np.ndarray, base: int, parts: int):
    """Rows (p, hs, ss, ns) and (h, u): tokens for their parts, with the owners' numbers in the task and set sizes; of a
    token that more than MANY sets of the task have, one flagged entry, and all the sets as rows of their own."""
    order = np.lexsort((owner, tokens))
    tokens, owner, size = tokens[order], owner[order], size[order]
    lead = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
    times = np.diff(np.r_[lead, len(tokens)])
    hot = np.repeat(times > MANY, times)
    kept = ~hot
    kept[lead] = True
    flag = np.where(hot[kept], _FLAG, np.uint32(0))
    one, who, n = tokens[kept], owner[kept].astype(np.uint32) | flag, size[kept].astype(np.uint32)
    part = (one >> np.uint64(33)).astype(np.int64) % parts
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    rows = [(p, one[order[a:b]].astype("<u8").tobytes(), who[order[a:b]].astype("<u4").tobytes(), n[order[a:b]].astype("<u4").tobytes()) for p, (a, b) in enumerate(itertools.pairwise(edges.tolist())) if b > a]
    return rows, tokens[hot].view(np.int64), base + owner[hot].astype(np.int64)


def prefixes(df: DataFrame, text: str, width: int, share: Fraction, rank: np.ndarray, parts: int, fingerprints: bool = False) -> DataFrame:
    """Rows (u, key, n, bits, odd, wide, first, second, rank, fp) for each set, numbered, once in a task: ``first`` and
    ``second`` are the least tokens under two permutations, ``rank`` the mean rank of the tokens' cells, fp the
    fingerprint, if asked for. Packed prefix tokens (p, u, hs, ss, ns), u the task's first number; and (h, u) for tokens
    that many sets of a task have."""
    sent = df.sparkSession.sparkContext.broadcast(rank)
    longs = pa.list_(pa.int64())
    schema = {"u": pa.int64(), "key": pa.binary(), "n": pa.int64(), "bits": longs, "odd": longs, "wide": longs, "first": pa.int64(), "second": pa.int64(), "rank": pa.float64(), "fp": pa.int64(), "p": pa.int64(), "hs": pa.binary(), "ss": pa.binary(), "ns": pa.binary(), "h": pa.int64()}
    own_names = list(schema)[:10]

    def made(rows, **given):
        return pa.RecordBatch.from_arrays([pa.array(given[c], k) if c in given else pa.nulls(rows, k) for c, k in schema.items()], names=list(schema))

    def run(batches):
        task = TaskContext.get()
        known, seen, level = _Hashes(), {}, sent.value
        base, count, size = (task.partitionId() if task else 0) << 31, 0, 0
        held: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        widths: list[int] = []

        def flushed():
            sizes = np.concatenate([np.full(len(x), n) for x, n in zip(held, widths, strict=True)])
            rows, h, u = _packed(np.concatenate(held), np.concatenate(owners), sizes, base, parts)
            widths.clear()
            held.clear(), owners.clear()
            for at in range(0, len(rows), 64):
                own = rows[at : at + 64]
                yield made(len(own), u=[base] * len(own), p=[r[0] for r in own], hs=[r[1] for r in own], ss=[r[2] for r in own], ns=[r[3] for r in own])
            if len(h):
                yield made(len(h), u=u, h=h)

        for batch in batches:
            for _, _, texts in _texts(batch, 0):
                rows = []
                for own in sets_of(texts, width, known):
                    key = set_key(own)
                    if not len(own) or key in seen:
                        continue
                    if len(seen) >= HELD:
                        seen.clear()
                    seen[key] = None
                    k, levels = prefix_size(len(own), share), level[(own % np.uint64(CELLS)).astype(np.int64)]
                    held.append(own[np.lexsort((own, levels))[:k]])
                    owners.append(np.full(k, count, np.int64))
                    widths.append(len(own))
                    least = [int(mixed(own, seed).min().view(np.int64)) for seed in (1, 2)]
                    rows.append((base + count, key, len(own), *cell_bits(own), wide_bits(own), *least, float(levels.mean()), int(majority(own).view(np.int64)) if fingerprints else None))
                    count, size = count + 1, size + k
                if rows:
                    yield made(len(rows), **dict(zip(own_names, zip(*rows, strict=True), strict=True)))
                if size >= HELD:
                    yield from flushed()
                    size = 0
        if held:
            yield from flushed()

    return df.select(F.col(text)).mapInArrow(run, "u long, key binary, n long, bits array<long>, odd array<long>, wide array<long>, first long, second long, rank double, fp long, p long, hs binary, ss binary, ns binary, h long")


def met(made: DataFrame, share: Fraction) -> DataFrame:
    """(h, u): the sets with each prefix token of which, over all tasks, another set of similar size has it, too (or
    many sets have)."""

    def run(batches):
        part, held = None, []
        for batch in batches:
            for p, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part:
                    if held:
                        yield from shared(held)
                    part, held = p, []
                held.append(row)
        if held:
            yield from shared(held)

    def shared(held):
        h = np.concatenate([np.frombuffer(hs, "<u8") for _, hs, _, _ in held])
        s = np.concatenate([np.frombuffer(ss, "<u4") for _, _, ss, _ in held])
        n = np.concatenate([np.frombuffer(ns, "<u4") for *_, ns in held]).astype(np.int64)
        base = np.repeat([b for b, *_ in held], [len(ss) // 4 for _, _, ss, _ in held])
        flagged = s & _FLAG != 0
        order = np.lexsort((n, ~flagged, h))  # a token's flagged entries first, then by size
        h, s, n, base, flagged = h[order], s[order], n[order], base[order], flagged[order]
        lead = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        hot = np.repeat(flagged[lead], np.diff(np.r_[lead, len(h)]))
        near = (h[1:] == h[:-1]) & (np.minimum(n[1:], n[:-1]) * share.denominator >= np.maximum(n[1:], n[:-1]) * share.numerator)
        own = np.flatnonzero(~flagged & (hot | np.r_[False, near] | np.r_[near, False]))  # the rows of flagged ones are there
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array(h[own].view(np.int64)), pa.array(base[own] + s[own].astype(np.int64))], names=["h", "u"])

    packed = made.where("p IS NOT NULL").select("p", "u", "hs", "ss", "ns").repartition("p").sortWithinPartitions("p")
    return packed.mapInArrow(run, "h long, u long").unionAll(made.where("h IS NOT NULL").select("h", "u"))


def _small(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it is small."""
    return F.broadcast(df) if df.count() <= SENT else df


def read_whole(ends: DataFrame, names: DataFrame, rows: DataFrame, df: DataFrame, id: str, text: str, width: int, unique: bool) -> DataFrame:
    """(u, own): the whole sets of the numbers ``ends`` (u), each from one text; ``names`` has their keys, ``rows`` those of all ids."""
    keys = names.join(ends, "u", "left_semi").select("key", F.col("u").alias("_u"))
    least = rows.join(keys.select("key"), "key", "left_semi").groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("of"))
    of = checkpointed(least.join(keys, "key").select(F.col("key").alias("_key"), "_u", F.col("of.id").alias("_id")))
    texts = df.select(F.col(id).alias("id"), F.col(text).alias("text")).join(_small(of), F.col("id").eqNullSafe(F.col("_id"))).select("_u", "_key", "text")

    def run(batches):
        known = _Hashes()
        for batch in batches:
            for at, n, own in _texts(batch, 2):
                keys, us = batch.column(1).slice(at, n).to_pylist(), batch.column(0).slice(at, n).to_pylist()
                found = [(u, x.view(np.int64)) for u, k, x in zip(us, keys, sets_of(own, width, known), strict=True) if set_key(x) == k]  # ids may repeat
                yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.int64()))], names=["u", "own"])

    own = texts.mapInArrow(run, "u long, own array<long>")
    return checkpointed(own if unique else own.dropDuplicates(["u"]))


def _differ(x: str, y: str) -> Column:
    """Places where two rows of bits differ."""
    return sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(WORDS)), F.lit(0))


def _outside(x: str, y: str) -> Column:
    """Bits of one row that another lacks."""
    return sum((F.bit_count(F.col(x)[i].bitwiseAND(F.bitwise_not(F.col(y)[i]))) for i in range(WORDS)), F.lit(0))


def _sizes(share: Fraction) -> Column:
    """Whether sets of n and m tokens may be similar."""
    return F.least("n", "m") * share.denominator >= F.greatest("n", "m") * share.numerator


def _near(share: Fraction) -> Column:
    """Whether sets of n and m tokens, the odd bits of which are x and y, and xw and yw if they are large, may be similar."""
    may = lambda differ: differ * (share.denominator + share.numerator) <= (F.col("n") + F.col("m")) * (share.denominator - share.numerator)
    wide = F.aggregate(F.zip_with("xw", "yw", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, n: s + n)
    return _sizes(share) & may(_differ("x", "y")) & (F.col("xw").isNull() | F.col("yw").isNull() | may(wide))


def to_leaders(sets: DataFrame, column: str) -> DataFrame:
    """Pairs (a, b) of each set and the leader, the most ordinary (the highest rank), of those with the same value in a
    column."""
    leaders = sets.groupBy(column).agg(F.max(F.struct("rank", "u")).alias("leader"), F.count("*").alias("sets")).where("sets > 1")
    return sets.select(column, F.col("u").alias("a")).join(leaders.select(column, F.col("leader.u").alias("b")), column).where("a <> b").select("a", "b")


def similar(pairs: DataFrame, whole: DataFrame, share: Fraction) -> DataFrame:
    """The pairs (a, b) whose whole sets (u, own) are similar; each set of ``a`` goes to its b."""
    ends = checkpointed(pairs.select("b").distinct())
    sent = whole.select(F.col("u").alias("a"), F.col("own").alias("x")).join(_small(pairs), "a")
    kept = whole.select(F.col("u").alias("b"), F.col("own").alias("y")).join(_small(ends), "b", "left_semi")
    common = F.size(F.array_intersect("x", "y"))
    either = F.size("x") + F.size("y") - common
    return checkpointed(sent.join(kept, "b").where(common * share.denominator >= either * share.numerator).select("a", "b"))


def _labelled(sets: DataFrame, found: DataFrame | None, name: str) -> DataFrame:
    """``sets`` with the label of their component of ``found``, or their own number."""
    if found is None:
        return sets.withColumn(name, F.col("u"))
    return sets.join(_small(found.select(F.col("node").alias("u"), F.col("label").alias(name))), "u", "left").withColumn(name, F.coalesce(name, "u"))


def opened(tokens: DataFrame, members: DataFrame, share: Fraction) -> DataFrame:
    """(a, b, nth): sets and the members of other components that they meet in opened groups, from near to far.

    ``tokens`` has the prefix tokens (h, u), ``members`` the sets (u, n, bits, odd, wide, g, l) with group and component."""
    bits = F.array(*[f"w{i}" for i in range(WORDS)])
    groups = members.groupBy("g").agg(F.count("*").alias("size"), F.min("l").alias("one"), F.max("l").alias("other"), *[F.bit_or(F.col("bits")[i]).alias(f"w{i}") for i in range(WORDS)])
    groups = checkpointed(groups.select("g", "size", (F.col("one") != F.col("other")).alias("mixed"), bits.alias("union")))
    size = checkpointed(members.groupBy("g", "l").agg(F.count("*").alias("have")))
    most = size.groupBy("g").agg(F.max(F.struct("have", "l")).alias("most")).select("g", F.col("most.l").alias("most"))
    right = members.select(F.col("u").alias("b"), F.col("n").alias("m"), F.col("odd").alias("y"), F.col("wide").alias("yw"), F.col("l").alias("r"), "g")
    # within the own group: sets outside its largest component ask, of two others the one with the lesser label
    open_groups = groups.where("mixed").select("g")
    asks = members.join(open_groups, "g", "left_semi").join(most, "g").where("l <> most").select(F.col("u").alias("a"), "n", F.col("odd").alias("x"), F.col("wide").alias("xw"), "l", "most", F.col("g").alias("_g"))
    inside = asks.join(right.join(open_groups, "g", "left_semi"), (F.col("_g") == F.col("g")) & ((F.col("r") == F.col("most")) | (F.col("l") < F.col("r"))) & (F.col("l") != F.col("r")) & _near(share))
    # other groups: by the matrix, the sets of the smaller group ask
    of = tokens.join(members.select("u", "n", "g"), "u")
    matrix = of.groupBy("h", "g").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    several = _small(checkpointed(matrix.groupBy("h").agg(F.count("*").alias("groups")).where("groups > 1").select("h")))
    sizes = _small(groups.select("g", "size"))
    asking = of.join(several, "h", "left_semi").join(sizes, "g").select("h", "u", "n", F.col("g").alias("mine"), F.col("size").alias("my_size"))
    rows = matrix.join(several, "h", "left_semi").join(sizes, "g")
    fits = (F.col("low") * share.numerator <= F.col("n") * share.denominator) & (F.col("high") * share.denominator >= F.col("n") * share.numerator)
    smaller = (F.col("g") != F.col("mine")) & (F.struct("my_size", "mine") < F.struct("size", "g"))
    asked = asking.join(rows, "h").where(smaller & fits).select("u", "g").distinct()
    bounded = asked.join(members.select("u", "n", "bits", F.col("odd").alias("x"), F.col("wide").alias("xw"), "l"), "u").join(groups.select(F.col("g").alias("_g"), "union"), F.col("g") == F.col("_g"))
    open_ = bounded.where((F.col("n") - _outside("bits", "union")) * share.denominator >= F.col("n") * share.numerator).select(F.col("u").alias("a"), "n", "x", "xw", "l", "_g")
    across = open_.join(right, (F.col("_g") == F.col("g")) & (F.col("l") != F.col("r")) & _near(share))
    take = lambda df: df.select("a", "b", _differ("x", "y").alias("far"))
    nearest = F.row_number().over(Window.partitionBy("a").orderBy("far", "b"))
    return checkpointed(take(inside).unionAll(take(across)).withColumn("nth", nearest).select("a", "b", "nth"))


def linked(tokens: DataFrame, sets: DataFrame, share: Fraction, first: list[Callable[[DataFrame], DataFrame]], read: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """(node, label) of the sets that are similar to another, label being the least number of the component; None if
    there are none. ``first`` propose pairs for the groups; ``read`` gives whole sets."""
    loose, short = share * LOOSE, sets.select("u", "n", "odd", "wide")
    found = links = whole = groups = None

    def more(pairs: DataFrame) -> None:
        nonlocal links, found, whole
        if found is not None:  # pairs that are in one component need no check
            of = _small(found)
            ends = pairs.join(of.toDF("a", "l"), "a", "left").join(of.toDF("b", "r"), "b", "left")
            pairs = checkpointed(ends.where(F.coalesce("l", "a") != F.coalesce("r", "b")).select("a", "b"))
        ends = pairs.select(F.col("a").alias("u")).unionAll(pairs.select("b")).distinct()
        ends = checkpointed(ends if whole is None else ends.join(whole.select("u"), "u", "left_anti"))
        if not ends.isEmpty():
            new = read(ends)
            whole = new if whole is None else whole.unionAll(new)
        if whole is not None and not pairs.isEmpty():
            new = similar(pairs, whole, share)
            if not new.isEmpty():
                links = new if links is None else links.unionAll(new)
                found = checkpointed(components(links))

    if first:
        pairs = first[0](sets)
        for propose in first[1:]:
            pairs = pairs.unionAll(propose(sets))
        left, right = short.toDF("a", "n", "x", "xw"), short.toDF("b", "m", "y", "yw")
        ties = checkpointed(pairs.distinct().join(left, "a").join(right, "b").where(_near(loose)).select("a", "b", _near(share).alias("strict")))
        groups = checkpointed(components(ties))
        more(ties.where("strict").select("a", "b"))
    members = checkpointed(_labelled(_labelled(sets.select("u", "n", "bits", "odd", "wide"), groups, "g"), found, "l"))
    pairs = opened(tokens, members, share)
    for nth in (F.col("nth") <= NEAREST, F.col("nth") > NEAREST):
        rest = pairs.where(nth)
        if not rest.isEmpty():
            more(rest.select("a", "b"))
    return found


def classes(df: DataFrame, id: str, text: str, width: int, share: float, first: list[Callable[[DataFrame], DataFrame]] | None = None, fingerprints: bool = False) -> tuple[DataFrame, DataFrame | None, bool]:
    """The rows' sets (id, key, n), written out; the components of similar keys (node, label), None if there are none;
    and whether ids are unique and none null."""
    with tidied(df.sparkSession):
        return _classes(df, id, text, width, Fraction(str(share)), first, fingerprints)


def _classes(df: DataFrame, id: str, text: str, width: int, exact: Fraction, first: list[Callable[[DataFrame], DataFrame]] | None, fingerprints: bool) -> tuple[DataFrame, DataFrame | None, bool]:
    made = checkpointed(marked(df, id, text, width))
    rows = made.where("key IS NOT NULL").select("id", "key", "n")
    unique = rows.groupBy("id").count().where((F.col("count") > 1) | F.col("id").isNull()).isEmpty()
    size = rows.agg(F.sum(F.col("n") - F.ceil(F.col("n") * exact.numerator / exact.denominator) + 1)).first()[0] or 0
    rank = ranks(made.where("part IS NOT NULL").select("part", "cells"))
    packed = checkpointed(prefixes(df, text, width, exact, rank, max(PARTS, int(size) // PART_TOKENS), fingerprints))
    sets = packed.where("key IS NOT NULL").drop("p", "hs", "ss", "ns", "h")
    # a set that several tasks have goes by its least number
    again = sets.groupBy("key").agg(F.min("u").alias("least"), F.count("*").alias("times")).where("times > 1").select(F.col("key").alias("_key"), "least")
    other = checkpointed(sets.join(again, F.col("key") == F.col("_key")).where("u <> least").select(F.col("u").alias("_u"), "least"))
    of = met(packed, exact).join(_small(other), F.col("u") == F.col("_u"), "left").select("h", F.coalesce("least", "u").alias("u"))
    every = checkpointed(of.distinct())
    several = every.groupBy("h").agg(F.min("u").alias("low"), F.max("u").alias("high")).where("low <> high").select("h")
    tokens = checkpointed(every.join(_small(checkpointed(several)), "h", "left_semi"))
    used = checkpointed(tokens.select("u").distinct())
    if used.isEmpty():
        return rows, None, unique
    few = checkpointed(sets.join(_small(used), "u", "left_semi"))
    names = few.select("u", "key")
    read = lambda ends: read_whole(ends, names, rows, df, id, text, width, unique)
    if first is None:
        first = [lambda sets: to_leaders(sets, "first"), lambda sets: to_leaders(sets, "second")]
    found = linked(tokens, few, exact, first, read)
    if found is None:
        return rows, None, unique
    named = found.join(_small(names), F.col("node") == F.col("u")).select(F.col("key").alias("node"), "label")
    return rows, checkpointed(named), unique


def similar_documents(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3, share: float = 0.9) -> DataFrame:
    """(id, n_shingles, component_id) for each row: the size of its set of ``width``-word shingles, and the smallest id
    reachable by links of Jaccard similarity ``share`` or more, its own included.

    ASCII white space separates words, and only A-Z are folded. A text of fewer words is one shingle; null and empty
    texts have no set and link with nothing. Repeated rows and copies stay as rows of one component. Null ids are no
    candidates for the smallest (a component of null ids only has a null component_id). Only the two columns are read;
    no rows give no rows. Jobs run while this is called.
    """
    rows, found, _ = classes(df, id, text, width, share)
    none = F.col("n") == 0
    least = rows.where(~none).groupBy("key").agg(F.min("id").alias("least"))
    if found is not None:
        least = least.join(found, F.col("key") == F.col("node"), "left").select("key", "least", F.coalesce(F.col("label").cast("string"), F.hex("key")).alias("label"))
        names = least.groupBy("label").agg(F.min("least").alias("component_id"))
        least = least.join(names, "label").select("key", "component_id")
    else:
        least = least.withColumnRenamed("least", "component_id")
    joined = rows.where(~none).join(least, "key").select("id", "n", "component_id").unionAll(rows.where(none).select("id", "n", F.col("id").alias("component_id")))
    return joined.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), "component_id")
