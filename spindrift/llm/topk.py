"""Exact top-k search by distributed histogram selection (operator 10).

Queries are taken in blocks of bounded size; each block is broadcast and meets all candidates. A pass scores every
candidate and adds up, over all tasks, a histogram of each query's scores within its current range; the bin that
holds the k-th score becomes the next range, until it is one score wide or few scores are left. A last pass keeps
the scores from that bound on, and orders equal scores by id. In each task only the bins from the task's own k-th
score upwards are sent, and only k rows a query: a bin further down can't hold the k-th score of all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed

#: Queries in a block (about), bins of a histogram, and candidates scored at once.
BLOCK, BINS, CANDIDATES = 4096, 256, 512
#: A range is narrow enough once it and what lies above hold so many scores for each of the k.
SPARE = 4


def vectors(df: DataFrame, id: str, vector: str, scale: float) -> DataFrame:
    """(id, v): ids and floor(scale * x) of each component, of the rows that take part."""
    whole = df.select(F.col(id).alias("id"), F.col(vector).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return whole.where(finite).select("id", F.transform("v", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def _matrix(column: pa.Array, width: int, kind: str) -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()]
    if (sizes == width).all():
        return flat.reshape(-1, width).astype(kind)
    out = np.zeros((len(sizes), width), kind)
    for i, part in enumerate(np.split(flat, np.cumsum(sizes)[:-1])):
        out[i, : len(part)] = part
    return out


def _scored(batches: Iterator[pa.RecordBatch], ids: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(candidate ids, scores by query, whether the pair counts) of some candidates at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, CANDIDATES):
            part = batch.slice(at, CANDIDATES)
            c = part.column(0).to_numpy(zero_copy_only=False)
            yield c, q @ _matrix(part.column(1), q.shape[1], q.dtype.str).T, ids[:, None] != c[None, :]


def _kind(most_query: int, most_candidate: int, width: int) -> str:
    """The cheapest type whose sums of products are exact."""
    bound = max(1, most_query) * max(1, most_candidate) * max(1, width)
    return "f4" if bound < 1 << 24 else "f8" if bound < 1 << 53 else "O"


def _histogram(candidates: DataFrame, sent, k: int) -> DataFrame:
    """(query, bin, n): counts of scores by bin of each query's range; bin BINS is all above the range."""

    def run(batches):
        ids, q, low, width = sent.value
        n = len(ids)
        counts = np.zeros((n, BINS + 1), np.int64)
        bound = low.copy()  # nothing below can be among the k best of this task
        for _, s, other in _scored(batches, ids, q):
            i, j = np.nonzero((s >= bound[:, None]) & other)
            if not len(i):
                continue
            at = np.minimum((s[i, j] - low[i]) // width[i], BINS).astype(np.int64)
            counts += np.bincount(i * (BINS + 1) + at, minlength=n * (BINS + 1)).reshape(n, BINS + 1)
            above = counts[:, ::-1].cumsum(1)
            first = (above >= k).argmax(1)
            known = above[:, -1] >= k
            bound = np.where(known & (first > 0), low + (BINS - first) * width, low)
        kept = counts[:, ::-1].cumsum(1)[:, ::-1]  # scores in this bin or above
        i, at = np.nonzero((counts > 0) & (kept - counts < k))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(at, pa.int32()), pa.array(counts[i, at], pa.int64())], names=["query", "bin", "n"])

    return candidates.mapInArrow(run, "query int, bin int, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))


def _best(candidates: DataFrame, sent, k: int) -> DataFrame:
    """(query, id, score): in each task, the k best candidates of each query from its bound on."""

    def run(batches):
        ids, q, low, _ = sent.value
        held = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, q.dtype)]
        for c, s, other in _scored(batches, ids, q):
            i, j = np.nonzero((s >= low[:, None]) & other)
            held = [np.concatenate(x) for x in zip(held, (i, c[j], s[i, j]), strict=True)]
            if len(held[0]) > 4 * k * len(ids):
                held = pruned(held)
        i, c, s = pruned(held)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(c, pa.int64()), pa.array([int(x) for x in s.tolist()], pa.int64())], names=["query", "id", "score"])

    def pruned(held):
        i, c, s = held
        order = np.lexsort((c, -s, i))
        i = i[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        return [i[nth < k], c[order][nth < k], s[order][nth < k]]

    return candidates.mapInArrow(run, "query int, id long, score long")


def search(df: DataFrame, queries: DataFrame, k: int = 5, id: str = "vec_id", vector: str = "embedding", scale: float = 256.0, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, id, score): the k rows of ``df`` of highest inner product with each row of ``queries``.

    Components are floor(scale * x), so scores are integers, and exact. Equal scores go to the smaller id. A row
    whose id is the query's is its own row and no candidate; other rows may repeat ids and vectors, and each
    counts. Equal rows of ``queries`` are one query. Rows with a null id or vector, or a null, NaN or infinite component, take no
    part; a shorter vector is filled up with zeros. A query without candidates has no rows. Scores beyond 64 bits
    raise an error. ``queries`` has the columns of ``df``; blocks of queries are passes over ``df``, each
    written out before the next is sent.
    """
    spark = df.sparkSession
    candidates, asked = vectors(df, id, vector, scale), checkpointed(vectors(queries, id, vector, scale).distinct())
    size = lambda: F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    facts = candidates.agg(F.max(F.size("v")).alias("width"), F.max(size()).alias("most"), F.max(square).alias("square")).first()
    n, blocks = asked.count(), 1
    if n > block:
        blocks = math.ceil(n / (0.8 * block))
    parts = []
    for b in range(blocks if facts.width is not None else 0):
        rows = asked.where(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)) == b).orderBy("id", "v").collect()
        if not rows:
            continue
        width = max(facts.width, *(len(r.v) for r in rows), 1)
        most = max((abs(x) for r in rows for x in r.v), default=0)
        kind = _kind(most, facts.most, width)
        q = np.zeros((len(rows), width), kind)
        for i, r in enumerate(rows):
            q[i, : len(r.v)] = r.v
        ids = np.array([r.id for r in rows], np.int64)
        norm = np.array([math.sqrt(sum(float(x) * x for x in r.v)) for r in rows])
        reach = [math.ceil(x * math.sqrt(facts.square) * 1.000001) + 1 for x in norm.tolist()]
        low = np.array([-x for x in reach], q.dtype if kind == "O" else "f8")
        span = np.array([2 * x + 1 for x in reach], low.dtype)
        while True:
            step = -(-span // BINS)
            sent = spark.sparkContext.broadcast((ids, q, low, step))
            by = Window.partitionBy("query").orderBy(F.desc("bin"))
            summed = _histogram(candidates, sent, k).withColumn("above", F.sum("n").over(by))
            found = summed.where((F.col("above") >= k) & (F.col("above") - F.col("n") < k)).collect()  # a row a query
            sent.unpersist()
            wide = 0
            for r in found:
                if r.bin < BINS:
                    low[r.query] = low[r.query] + r.bin * step[r.query]
                span[r.query] = 1 if r.above <= SPARE * k or r.bin == BINS else step[r.query]
                wide += span[r.query] > 1
            few = np.setdiff1d(np.arange(len(rows)), [r.query for r in found])
            span[few] = 1  # fewer than k candidates: all are kept
            if not wide:
                break
        names = spark.createDataFrame([(i, int(x)) for i, x in enumerate(ids)], "number int, query_id long")
        sent = spark.sparkContext.broadcast((ids, q, low, step))
        best = _best(candidates, sent, k)
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
        top = best.withColumn("rank", rank).where(F.col("rank") <= k).join(F.broadcast(names), F.col("query") == F.col("number"))
        parts.append(checkpointed(top.select("query_id", "rank", F.col("id").alias(id), "score")))
        sent.unpersist()  # a block's queries live until its rows are written
    if not parts:
        return spark.createDataFrame([], f"query_id long, rank int, `{id}` long, score long")
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionAll(p)
    return whole
