"""SimHash near-dedup with BK-trees (operator 3).

Fingerprints are computed once for each whole text and collapse to distinct values before anything is compared. Two
fingerprints within ``radius`` bits agree on at least ``blocks - radius`` blocks of bits, so each distinct value is
filed under every choice of that many blocks; only values in the same bucket can be links. There are the more blocks,
the more values there are, so that buckets stay small; one that is large all the same is dealt to shards, each two of
which meet in one cell. Within a cell, BK-trees (children keyed by their Hamming distance to the parent) are searched
along the edges within the radius, and the links found are reduced to a spanning set. Components follow by
alternating large-star and small-star steps on distributed tables.

A shard's tree goes to the cells that search it by the shuffle, not by a broadcast: the trees of all shards are as
large as the corpus, and to broadcast them would collect the fingerprints of all documents on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, map_texts, unused

SEED = 42
#: Values that a bucket has on average at most, if they are random.
BUCKET = 256
#: Shingles hashed at once, and pairs of query and tree node in one step of a search: both bound a worker's memory.
CHUNK, FRONTIER = 1 << 16, 1 << 21


def majority(h: np.ndarray) -> np.uint64:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), CHUNK):
        ones += np.unpackbits(h[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0]


def fingerprint(text: str | None, width: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles; 0 for a text without words."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, and only ASCII white space splits
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : min(at + CHUNK, n) + width - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
        h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], "<u8")
        set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", out: str = "fp", width: int = 3, keep: list[str] | None = None) -> DataFrame:
    """``df`` with the fingerprint of each whole text, as the long of the same 64 bits (null or no words: 0)."""

    def start():
        return lambda texts: (np.array([fingerprint(t, width) for t in texts], "u8").view("i8"),)

    return map_texts(df, text, {out: T.LongType()}, start, keep)


def blocks_for(n: int, radius: int) -> int:
    """The least number of blocks of the 64 bits at which the buckets of n random values have BUCKET at most: the
    blocks on which two values must agree have the more bits, the more blocks there are."""
    blocks = radius + 2
    while blocks < 64 and n >> 64 * (blocks - radius) // blocks > BUCKET:
        blocks += 1
    return blocks


def _masks(radius: int, blocks: int) -> list[int]:
    """For each choice of blocks on which two values within the radius must agree, the mask of their bits."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(own) for own in combinations(parts, blocks - radius)]


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Forest:
    """One BK-tree for each run of equal ``cell``, over values in their order; all are built and searched together.

    The first value of a cell is its root. A child is the first of its parent's values at its distance from the
    parent; the others at that distance descend to it.
    """

    def __init__(self, values: np.ndarray, cell: np.ndarray):
        n = len(values)
        self.values = values
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        self.root_of_cell = dict(zip(cell[first].tolist(), first.tolist(), strict=True))
        self.parent, self.edge = np.full(n, -1), np.zeros(n, np.int64)
        at = np.repeat(first, np.diff(np.r_[first, n]))  # the node that each value stands at
        left = np.setdiff1d(np.arange(n), first, assume_unique=True)
        while len(left):
            d = distance(values[left], values[at[left]]).astype(np.int64)
            _, lead, group = np.unique(at[left] * 65 + d, return_index=True, return_inverse=True)
            child = left[lead]
            self.parent[child], self.edge[child] = at[child], d[lead]
            at[left] = child[group]
            left = np.delete(left, lead)
        #: Children by parent, then edge: what lies within a range of edges is one slice.
        self.order = np.lexsort((self.edge, self.parent))
        self.keys = self.parent[self.order] * 65 + self.edge[self.order]

    def search(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of query, index of value) of all values within the radius."""
        found = []
        waiting = [(np.arange(len(queries)), roots)]
        while waiting:
            q, node = waiting.pop()
            if len(q) > FRONTIER:
                waiting += [(q[: len(q) // 2], node[: len(q) // 2]), (q[len(q) // 2 :], node[len(q) // 2 :])]
                continue
            d = distance(queries[q], self.values[node]).astype(np.int64)
            near = d <= radius
            found.append((q[near], node[near]))
            low = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0))
            n = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), "right") - low
            if total := int(n.sum()):
                step = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
                waiting.append((np.repeat(q, n), self.order[np.repeat(low, n) + step]))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def least_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _cell_links(bucket: np.ndarray, cell: np.ndarray, home: np.ndarray, guest: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of whole cells, rows sorted by bucket and cell; the tree has those at home, and the guests
    (in a shard's cell with itself, its own values) search it."""
    of = np.cumsum(np.r_[0, (bucket[1:] != bucket[:-1]) | (cell[1:] != cell[:-1])])
    size = np.bincount(of)
    some = size[of] > 1
    of, home, guest, fp = of[some], home[some], guest[some], fp[some]
    if not home.any():
        return fp[:0], fp[:0]
    forest = Forest(fp[home], of[home])
    roots = np.array([forest.root_of_cell.get(c, -1) for c in of.tolist()])
    asked = np.flatnonzero((roots >= 0) & guest)
    q, node = forest.search(fp[asked], roots[asked], radius)
    a, b = asked[q], np.flatnonzero(home)[node]
    label = least_reachable(len(fp), a, b)
    linked = np.flatnonzero(label != np.arange(len(fp)))
    return fp[linked], fp[label[linked]]


def cells_of(distinct: DataFrame, radius: int = 3, shard: int = 2048, blocks: int | None = None) -> DataFrame:
    """(bucket, cell, home, guest, fp): where distinct fingerprints (column fp) meet.

    A value is filed in the bucket of each choice of blocks, and a bucket's values are dealt to shards of about
    ``shard``. A cell is a pair of shards, the first at home in its tree and the second its guests, so it has two
    shards' values at most however large the bucket; each two values of a bucket meet in one cell."""
    blocks = blocks or blocks_for(distinct.count(), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in _masks(radius, blocks)]
    filed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("choice", "part"))
    filed = filed.select("fp", F.xxhash64("choice", "part").alias("bucket"))
    large = filed.groupBy("bucket").count().where(F.col("count") > 1).select("bucket", F.ceil(F.col("count") / shard).alias("shards"))
    near = filed.join(large, "bucket").withColumn("own", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("shards")))
    met = near.select("fp", "bucket", "own", "shards", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1)).alias("other"))
    return met.select(
        "bucket", (F.least("own", "other") * F.col("shards") + F.greatest("own", "other")).alias("cell"), (F.col("own") <= F.col("other")).alias("home"), (F.col("own") >= F.col("other")).alias("guest"), "fp"
    )


def links(distinct: DataFrame, radius: int = 3, shard: int = 2048, blocks: int | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) whose components are those of all links within the
    radius; each is itself a chain of such links. They are searched for in cells of bounded size (``cells_of``)."""
    dealt = cells_of(distinct, radius, shard, blocks).repartition("bucket", "cell").sortWithinPartitions("bucket", "cell", "fp")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for frame in frames:
            if not len(frame):
                continue
            rest.append(frame)
            held = pd.concat(rest, ignore_index=True)
            last = (held.bucket == held.bucket.iat[-1]) & (held.cell == held.cell.iat[-1])
            whole = held[~last]
            rest = [held[last]]  # the last cell may go on
            if len(whole):
                yield made(whole)
        if rest:
            yield made(rest[0] if len(rest) == 1 else pd.concat(rest, ignore_index=True))

    def made(frame: pd.DataFrame) -> pd.DataFrame:
        a, b = _cell_links(frame.bucket.to_numpy(), frame.cell.to_numpy(), frame.home.to_numpy(bool), frame.guest.to_numpy(bool), frame.fp.to_numpy(np.int64).view(np.uint64), radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return dealt.mapInPandas(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for all nodes of the edges (a, b): label is the least node reachable.

    Alternates large-star and small-star steps until a round changes nothing; each round works on as many
    rows as there are edges, on tables that are checkpointed. Stars of any size are split by the skew join.
    """
    now = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        # large star: each larger neighbour of u goes to the least node around u
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: u and its smaller neighbours go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(low, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        after = checkpointed(small)
        if after.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() == now.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first():
            break
        now = after
    return after.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(after.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", radius: int = 3, width: int = 3, shard: int = 2048) -> DataFrame:
    """(id, fp, component_id): for each row of ``df``, its fingerprint and the smallest id of its component.

    Rows link if their fingerprints differ in at most ``radius`` bits. Null and empty texts have fingerprint 0 and
    link like any others; repeated rows and ids stay as many rows. Null ids count as no candidates for the smallest
    (a component of null ids only has a null component_id). No rows give no rows.
    """
    marked = checkpointed(fingerprints(df, text, "fp", width, [id]).select(F.col(id).alias("id"), "fp"))
    return grouped(marked, radius, shard).select(F.col("id").alias(id), "fp", "component_id")


def deduplicated(df: DataFrame, id: str = "doc_id", text: str = "text", radius: int = 3, width: int = 3, shard: int = 2048) -> DataFrame:
    """``df`` with one row of each component: that of the smallest id (then fingerprint, then all columns).

    Null ids come last; a component of null ids only keeps one of its rows. Repeated rows are copies like others.
    Where ids are unique, the texts are fingerprinted once and meet the kept ids in one join; only where ids repeat
    or are null are the fingerprints, which then help to tell rows apart, computed again.
    """
    columns = df.columns
    marked = checkpointed(fingerprints(df, text, "fp", width, [id]).select(F.col(id).alias("id"), "fp"))
    repeated = not marked.groupBy("id").count().where((F.col("count") > 1) | F.col("id").isNull()).isEmpty()
    found = grouped(marked, radius, shard)
    kept_id, kept_fp, own_fp = unused(columns, "_kept", "_kept_fp", "_fp")
    if not repeated:
        kept = found.where(F.col("id") == F.col("component_id")).select(F.col("id").alias(kept_id))
        return df.join(kept, F.col(id) == F.col(kept_id), "left_semi")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp"))
    kept = checkpointed(found.groupBy("label").agg(first.alias("kept")).select(F.col("kept.id").alias(kept_id), F.col("kept.fp").alias(kept_fp)))
    rows = fingerprints(df, text, own_fp, width).join(kept, F.col(id).eqNullSafe(F.col(kept_id)) & (F.col(own_fp) == F.col(kept_fp)))
    first = rows.groupBy(kept_id, own_fp).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("row"))
    return first.select(*[F.col("row").getField(c).alias(c) for c in columns])


def grouped(marked: DataFrame, radius: int = 3, shard: int = 2048) -> DataFrame:
    """(id, fp, label, component_id) of fingerprinted rows (id, fp) that were written out; label is the least
    fingerprint of the component."""
    least = checkpointed(marked.groupBy("fp").agg(F.min("id").alias("least")))
    label = components(links(least.select("fp"), radius, shard))
    classes = least.join(label, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("value"), F.coalesce("label", "fp").alias("label"), "least")
    names = classes.groupBy("label").agg(F.min("least").alias("component_id")).withColumnRenamed("label", "class")
    of = classes.join(names, F.col("label") == F.col("class")).select("value", "label", "component_id")
    return marked.join(of, F.col("fp") == F.col("value")).select("id", "fp", "label", "component_id")
