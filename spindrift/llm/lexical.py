"""Ranked lexical search by dual-sorted wavelet trees (operator 12).

The documents are dealt to shards of bounded size. In a shard, the postings of each term follow each other by falling
impact, and a wavelet tree over their document numbers is built on this order. A node of the tree stands for a range
of documents; as the tree keeps the order within each node, the first posting of a term in a node has the largest
impact of the term there, and the weighted sum of those is a bound for all documents below. Nodes are opened best
first, each into its two halves, a term staying only where it has postings; a leaf is one document, and its bound is
its score. What lies below the k-th score so far is never opened, so the k best are exact.

Queries are taken in blocks of bounded size; each block reads the documents once, for the terms of its queries.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, slices, unused
from .words import split_words

#: Queries and characters of queries in a block (about), and postings in a shard (about).
BLOCK, BLOCK_CHARS, POSTINGS = 4096, 4 << 20, 1 << 19
#: Nodes opened at once, at least; and the part of the waiting ones that is.
NODES, PART = 64, 4


def weight(documents: int, df: int) -> int:
    """The weight of a term that ``df`` of the documents hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, size: np.ndarray, documents: int, words: int) -> np.ndarray:
    """The impact of each posting: of tf occurrences in a document of ``size`` words."""
    m = 100 - 25 + 25 * size * documents // words
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


class Tree:
    """The dual-sorted wavelet tree of a shard. ``term``, ``doc`` (from 0) and ``impact`` describe the postings."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, terms: int, documents: int):
        order = np.lexsort((doc, -impact, term))
        self.starts = np.r_[0, np.cumsum(np.bincount(term, minlength=terms))]
        self.depth = max(1, (documents - 1).bit_length())
        n = len(order)
        doc, impact = doc[order], impact[order]
        #: By level: zeros before each place (one row a level), their number, and the impacts in the level's order.
        self.zeros = np.zeros((self.depth, n + 1), np.int32)
        self.total = np.zeros(self.depth, np.int64)
        self.impact = np.empty((self.depth + 1, n), np.int32)
        self.impact[0] = impact
        for level in range(self.depth):
            zero = (doc >> (self.depth - 1 - level)) & 1 == 0
            np.cumsum(zero, out=self.zeros[level, 1:])
            self.total[level] = self.zeros[level, -1]
            moved = np.r_[np.flatnonzero(zero), np.flatnonzero(~zero)]
            doc, impact = doc[moved], impact[moved]
            self.impact[level + 1] = impact

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of all documents that may be among the k best: no score is below the k-th best, or floor."""
        begin, end = self.starts[terms], self.starts[terms + 1]
        some = end > begin
        found_doc, found_score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if not some.any():
            return found_doc[0], found_score[0]
        w, a, b = weights[some], begin[some], end[some]
        # waiting nodes: level, document number's leading bits, bound, and a slice of the terms' ranges (w, a, b)
        level, head = np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound, size = np.array([(w * self.impact[0, a]).sum()]), np.array([len(w)])
        held = 0
        while len(bound):
            take = max(NODES, len(bound) // PART)
            if take < len(bound):
                chosen = np.zeros(len(bound), bool)
                chosen[np.argpartition(bound, -take)[-take:]] = True
            else:
                chosen = np.ones(len(bound), bool)
            pair = np.repeat(chosen, size)
            at = np.repeat(level[chosen], size[chosen])
            pw, pa_, pb = w[pair], a[pair], b[pair]
            za, zb, nz = self.zeros[at, pa_].astype(np.int64), self.zeros[at, pb].astype(np.int64), self.total[at]
            node = np.repeat(np.arange(len(size[chosen])), size[chosen])
            children = len(size[chosen])
            to = np.r_[node, node + children]
            nw, na, nb, nl = np.r_[pw, pw], np.r_[za, nz + pa_ - za], np.r_[zb, nz + pb - zb], np.r_[at, at] + 1
            live = nb > na
            to, nw, na, nb, nl = to[live], nw[live], na[live], nb[live], nl[live]
            lead = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            new_bound = np.add.reduceat(nw * self.impact[nl, na], lead)
            new_size = np.diff(np.r_[lead, len(to)])
            new_level = nl[lead]
            new_head = np.r_[head[chosen] * 2, head[chosen] * 2 + 1][to[lead]]
            leaf = new_level == self.depth
            if leaf.any():
                good = leaf & (new_bound >= floor)
                found_doc.append(new_head[good])
                found_score.append(new_bound[good])
                held += int(good.sum())
                if held >= k:
                    scores = np.concatenate(found_score)
                    floor = max(floor, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                    keep = scores >= floor
                    found_doc, found_score, held = [np.concatenate(found_doc)[keep]], [scores[keep]], int(keep.sum())
            stay, go = ~chosen & (bound >= floor), ~leaf & (new_bound >= floor)
            old_pair, new_pair = np.repeat(stay, size), np.repeat(go, new_size)
            w, a, b = np.r_[w[old_pair], nw[new_pair]], np.r_[a[old_pair], na[new_pair]], np.r_[b[old_pair], nb[new_pair]]
            level, head = np.r_[level[stay], new_level[go]], np.r_[head[stay], new_head[go]]
            bound, size = np.r_[bound[stay], new_bound[go]], np.r_[size[stay], new_size[go]]
        return np.concatenate(found_doc), np.concatenate(found_score)


def _forward(df: DataFrame, id: str, text: str, vocabulary) -> DataFrame:
    """(id, n, term, tf) of the rows with words: n counts all words, term and tf (lists) those of the vocabulary."""
    taken = df.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        width = max(1, len(number))
        for batch in batches:
            for at, n in slices(batch.column(1)):
                split = [split_words(t) for t in batch.column(1).slice(at, n).to_pylist()]
                sizes = np.array([len(x) for x in split], np.int64)
                flat = np.fromiter(map(number.get, itertools.chain.from_iterable(split), itertools.repeat(-1)), np.int64, int(sizes.sum()))
                doc = np.repeat(np.arange(n), sizes)[flat >= 0]
                key, tf = np.unique(doc * width + flat[flat >= 0], return_counts=True)
                offsets = np.searchsorted(key, np.arange(n + 1) * width).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32))) for x in (key % width, tf)]
                made = pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(sizes), *lists], names=["id", "n", "term", "tf"])
                yield made.filter(pa.array(sizes > 0))

    return taken.mapInArrow(run, "id long, n long, term array<int>, tf array<int>")


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids (0 if null), and whether each is null."""
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch.column(2).flatten())
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _searched(forward: DataFrame, asked, k: int, documents: int, words: int, shards: int, postings: int) -> DataFrame:
    """(no, id, score): of each query in each task, the k best documents of the task's shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, queries = asked.value
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for shard in _shards(batches, postings):
            shard = shard.combine_chunks()
            ids, none = _ids(shard.column("id").combine_chunks())
            order = np.lexsort((ids, none))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            lists = shard.column("term").combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            term, tf = lists.flatten().to_numpy().astype(np.int64), shard.column("tf").combine_chunks().flatten().to_numpy().astype(np.int64)
            impact = impacts(tf, np.repeat(shard.column("n").to_numpy(), sizes), documents, words)
            tree = Tree(term, np.repeat(rank, sizes), impact, width, len(order))
            ids, none = ids[order], none[order]
            for no, terms, weights in queries:
                old = best.get(no)
                floor = int(old[2].min()) if old is not None and len(old[2]) >= k else 1
                doc, score = tree.best(terms, weights, k, floor)
                if len(doc):
                    new = (ids[doc], none[doc], score)
                    if old is not None:
                        new = tuple(np.r_[x, y] for x, y in zip(old, new, strict=True))
                    top = np.lexsort((new[0], new[1], -new[2]))[:k]
                    best[no] = tuple(x[top] for x in new)
        for no, (own, none, score) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), no)), pa.array(own, mask=none), pa.array(score)], names=["no", "id", "score"])

    return forward.where(F.size("term") > 0).repartition(shards).mapInArrow(run, "no long, id long, score long")


def search(documents: DataFrame, queries: DataFrame, k: int = 20, id: str = "doc_id", text: str = "text", query_id: str = "item_id", query_text: str = "text", block: int = BLOCK, postings: int = POSTINGS) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` documents that score highest for each query, equal scores by smaller id.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. A document's score
    sums ``weight`` times ``impacts`` over the query's words, repeats included; documents of score 0 are left out.
    Ids of documents are integers; null ids come last among equal scores. Null and empty texts have no words: such
    documents aren't counted, such queries get no rows. Repeated rows are documents and queries of their own. No
    documents or no queries give no rows. Only the named columns are read.
    """
    spark = documents.sparkSession
    no = unused([query_id, id, "rank", "score"], "_no")[0]
    if query_id == id:
        raise ValueError("the ids of queries and documents need different names")
    asked = checkpointed(queries.select(F.col(query_id), F.col(query_text).alias("text")).withColumn(no, F.monotonically_increasing_id()))
    count, chars = asked.agg(F.count("*"), F.sum(F.length("text"))).first()
    blocks = max(1, -(-count // block), -(-(chars or 0) // BLOCK_CHARS))
    found = []
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64(no), F.lit(blocks)) == b).select(no, "text").collect()
        words = {r[0]: Counter(split_words(r.text)) for r in rows}
        number = {w: i for i, w in enumerate(sorted({w for own in words.values() for w in own}))}
        vocabulary = spark.sparkContext.broadcast(number)
        forward = checkpointed(_forward(documents, id, text, vocabulary))
        vocabulary.unpersist()
        n, total, held = forward.agg(F.count("*"), F.sum("n"), F.sum(F.size("term"))).first()
        if not held:
            continue
        df = {r.term: r["count"] for r in forward.select(F.explode("term").alias("term")).groupBy("term").count().collect()}
        plans = []
        for q, own in words.items():
            terms = [(number[w], times * weight(n, df[number[w]])) for w, times in own.items() if number[w] in df]
            terms = [x for x in terms if x[1] > 0]
            if terms:
                plans.append((q, *(np.array(x, np.int64) for x in zip(*terms, strict=True))))
        sent = spark.sparkContext.broadcast((len(number), plans))
        own = _searched(forward, sent, k, n, total, max(1, -(-held // postings)), 2 * postings)
        found.append(checkpointed(_top(own, k)))
        sent.unpersist()
    if not found:
        none = asked.select(query_id).limit(0)
        return none.select(query_id, F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias(id), F.lit(0).cast("bigint").alias("score"))
    every = found[0]
    for more in found[1:]:
        every = every.unionAll(more)
    return every.withColumnRenamed("no", no).join(asked.select(no, query_id), no).select(query_id, "rank", F.col("id").alias(id), "score")


def _top(rows: DataFrame, k: int) -> DataFrame:
    """The k best of each query, with their ranks; Spark keeps k of each task's before the exchange."""
    order = Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
