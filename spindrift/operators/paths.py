"""Shortest paths on edge tables: betweenness by levels of breadth-first search, and weighted distances by relaxation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordinals import materialized, ordinal
from .graphs import nearest_vectors
from .learning import pca


def betweenness(edges: DataFrame, a: str, b: str, samples: int | None = 200, seed: int = 1) -> DataFrame:
    """(node, degree, betweenness, normalised) of every node of an undirected graph (columns a, b).

    betweenness counts, for all pairs of other nodes, the share of their shortest paths that a node lies on. It is exact
    if ``samples`` is None or no less than the number of nodes; else it is scaled from the paths of that many source nodes,
    chosen by a seeded hash. normalised divides by the number of pairs of other nodes. Repeated edges count once, loops
    and edges with a null end not at all.

    The paths from all sources go on together, level by level, as joins with the edges on written tables: forward with
    the numbers of paths, back with the shares that lie behind each node. A level of an undirected graph only
    borders on its two neighbours, so a level is told from the two before it alone. A hub is a key of the edges' side
    that the skew join splits.
    """
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).alias("x"), F.col(b).alias("y"))
    links = materialized(pairs.unionAll(pairs.select("y", "x")).distinct())
    nodes = materialized(links.groupBy(F.col("x").alias("node")).agg(F.count("*").alias("degree")))
    n = nodes.count()
    chosen = nodes.select("node") if samples is None or samples >= n else nodes.select("node").orderBy(F.xxhash64(F.lit(seed), "node"), "node").limit(samples)
    levels = [materialized(chosen.select(F.col("node").alias("s"), "node", F.lit(1.0).alias("paths")))]
    while True:
        now = levels[-1]
        seen = now.select("s", "node")
        for earlier in levels[-2:-1]:
            seen = seen.unionAll(earlier.select("s", "node"))
        reached = now.join(links, F.col("node") == F.col("x")).groupBy("s", F.col("y").alias("node")).agg(F.sum("paths").alias("paths"))
        after = materialized(reached.join(seen, ["s", "node"], "left_anti"))
        if after.isEmpty():
            break
        levels.append(after)
    behind = levels[-1].select("s", "node", "paths", F.lit(0.0).alias("behind"))
    total = None
    for level in reversed(levels[:-1]):
        share = behind.join(links, F.col("node") == F.col("x")).groupBy(F.col("s").alias("_s"), F.col("y").alias("_node")).agg(F.sum((1 + F.col("behind")) / F.col("paths")).alias("share"))
        both = level.join(share, (F.col("s") == F.col("_s")) & (F.col("node") == F.col("_node")), "left")
        behind = materialized(both.select("s", "node", "paths", (F.col("paths") * F.coalesce("share", F.lit(0.0))).alias("behind")))
        own = behind.where("s <> node").groupBy("node").agg(F.sum("behind").alias("v"))
        total = own if total is None else total.unionAll(own)
    if total is None:
        return nodes.select("node", "degree", F.lit(0.0).alias("betweenness"), F.lit(0.0).alias("normalised"))
    scale = n / 2 / max(1, min(n, samples or n))
    summed = total.groupBy(F.col("node").alias("_n")).agg((F.sum("v") * scale).alias("v"))
    made = nodes.join(summed, F.col("node") == F.col("_n"), "left").withColumn("betweenness", F.coalesce("v", F.lit(0.0)))
    return made.select("node", "degree", "betweenness", (F.col("betweenness") / max(1.0, (n - 1) * (n - 2) / 2)).alias("normalised"))


def distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, distance): the least sum of weights from any source (node) along directed edges (a, b, w), w not negative,
    of the nodes that can be reached.

    Rounds of relaxation: only nodes whose distance fell in a round send it on in the next; tables are written out in
    each round."""
    own = materialized(edges.where("a IS NOT NULL AND b IS NOT NULL AND w IS NOT NULL").groupBy("a", "b").agg(F.min("w").alias("w")))
    known = materialized(sources.select("node", F.lit(0.0).alias("distance")).distinct())
    fallen = known
    while True:
        offers = fallen.join(own, F.col("node") == F.col("a")).groupBy("b").agg(F.min(F.col("distance") + F.col("w")).alias("offer"))
        better = offers.join(known, F.col("b") == F.col("node"), "left").where(F.col("distance").isNull() | (F.col("offer") < F.col("distance")))
        fallen = materialized(better.select(F.col("b").alias("node"), F.col("offer").alias("distance")))
        if fallen.isEmpty():
            return known
        known = materialized(known.join(fallen.select("node"), "node", "left_anti").unionAll(fallen))


def pseudotime(cells: DataFrame, id: str, vector: str, start: DataFrame | None = None, neighbours: int = 4, components: int | None = 2) -> DataFrame:
    """(id, pseudotime, rank): the distance of each cell from the start cells (column id; the smallest id, if None) along
    the graph of nearest neighbours, on the scores of ``components`` principal components (None: on the vectors).

    Two cells are joined if one is among the ``neighbours`` nearest of the other, by their Euclidean distance. rank goes
    by pseudotime, then id; cells that can't be reached have nulls. Ids are unique."""
    space = cells.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    if components is not None:
        space = pca(space, "id", "v", components).select("id", F.col("scores").alias("v"))
    space = materialized(space)
    near = nearest_vectors(space, "id", "v", neighbours).select("a", "b", F.col("distance").alias("w"))
    links = near.unionAll(near.select(F.col("b"), F.col("a"), "w"))
    begin = space.agg(F.min("id").alias("node")).where("node IS NOT NULL") if start is None else start.select(F.col(id).alias("node"))
    found = distances(links, begin)
    placed = ordinal(found, ["distance", "node"], "rank")
    return space.select("id").join(placed, F.col("id") == F.col("node"), "left").select(F.col("id").alias(id), F.col("distance").alias("pseudotime"), "rank")


def correlated_with(long: DataFrame, time: DataFrame, method: str = "spearman", least: float = 0.0) -> DataFrame:
    """(row, n, correlation): of each row of a long matrix (row, column, value) with a value (column, t) of its columns,
    by ranks (equal values share their mean rank) or values; those of ``least`` absolute correlation or more. Nulls take
    no part; a row without spread has none."""
    from .statistics import average_ranks

    both = long.join(time.select(F.col("column").alias("_c"), "t"), F.col("column") == F.col("_c")).where("value IS NOT NULL AND t IS NOT NULL").select("row", "column", "value", "t")
    if method == "spearman":
        both = average_ranks(both, "value", ["row"]).withColumn("value", F.col("rank")).drop("rank", "ties")
        both = average_ranks(both, "t", ["row"]).withColumn("t", F.col("rank")).drop("rank", "ties")
    made = both.groupBy("row").agg(F.count("*").alias("n"), (F.covar_pop("value", "t") / F.nullif(F.stddev_pop("value") * F.stddev_pop("t"), F.lit(0.0))).alias("correlation"))
    return made.where(F.col("correlation").isNotNull() & (F.abs("correlation") >= least))
