"""Neighbourhoods: nearest points on the globe, nearest vectors, label propagation, spatial autocorrelation."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..plans.ordinals import materialized
from .omics import EARTH_KM, chord, cubes, haversine, on_sphere

#: Rows of a block of vectors that meets another block in one task.
BLOCK = 2048


def nearest_points(points: DataFrame, k: int = 3, km: float | None = None) -> DataFrame:
    """(a, rank, b, km): the k nearest other points (id, lat, lon) of each point, all if there are fewer; ties to the
    smaller id. Points without a place have none.

    Points at one place have the same neighbours but for themselves, so places are searched: each offers its k + 1
    smallest ids, keeps the k + 1 nearest, and each of its points takes k of these. The search widens from ``km`` (None:
    as the number of places suggests): places meet those in cubes beside their own, and those that find fewer than
    k + 1 within that distance go on with twice the distance, up to half the globe's girth. Jobs run while this is called.
    """
    own = on_sphere(points.select("id", (F.col("lat") + 0.0).alias("lat"), (F.col("lon") + 0.0).alias("lon")))
    nth = F.row_number().over(Window.partitionBy("lat", "lon").orderBy("id"))
    offers = materialized(own.withColumn("nth", nth).where(F.col("nth") <= k + 1))
    places = materialized(offers.where("nth = 1").select("x", "y", "z", "lat", "lon"))
    half = EARTH_KM * math.pi
    # some 4 (k + 1) places within the first distance, if they lay evenly
    km = km or min(half, 4 * EARTH_KM * math.sqrt((k + 1) / max(1, places.count())))
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = offers.select(F.col("id").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), "x", "y", "z")
    waiting, done = places, []
    while True:
        last = km >= half
        here, beside = cubes(chord(km), True)
        a = waiting.select(F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.explode(beside).alias("cube")).repartition(tasks, "cube")
        b = every.select("b", "lat2", "lon2", here.alias("_cube")).repartition(tasks, "_cube")
        both = a.hint("merge").join(b, F.col("cube") == F.col("_cube")).select("lat1", "lon1", "b", haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")).alias("km"))
        rank = F.row_number().over(Window.partitionBy("lat1", "lon1").orderBy("km", "b"))
        near = materialized((both if last else both.where(F.col("km") <= km)).withColumn("rank", rank).where(F.col("rank") <= k + 1))
        if last:
            done.append(near)
            break
        full = near.where(F.col("rank") == k + 1).select(F.col("lat1").alias("_lat"), F.col("lon1").alias("_lon"))
        done.append(near.join(full, (F.col("lat1") == F.col("_lat")) & (F.col("lon1") == F.col("_lon")), "left_semi"))
        waiting = materialized(waiting.join(full, (F.col("lat") == F.col("_lat")) & (F.col("lon") == F.col("_lon")), "left_anti"))
        if waiting.isEmpty():
            break
        km *= 2
    lists = reduce(DataFrame.unionByName, done)
    each = own.select(F.col("id").alias("a"), "lat", "lon").join(lists, (F.col("lat") == F.col("lat1")) & (F.col("lon") == F.col("lon1"))).where("a <> b")
    rank = F.row_number().over(Window.partitionBy("a").orderBy("km", "b"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("a", "rank", "b", "km")


def communities(edges: DataFrame, a: str, b: str, iterations: int = 20) -> DataFrame:
    """(node, community): label propagation. Each node starts with its own label; at each round all nodes take the
    label of most votes at once, ties to the smallest: one vote of each edge's other end, and one of its own. Ends
    when no label changes, or after ``iterations`` rounds. Loops and edges with a null end don't count."""
    own = edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("x"), F.col(b).alias("y"))
    votes = materialized(own.unionAll(own.select("y", "x")).groupBy("x", "y").agg(F.count("*").alias("n")))
    now = votes.select(F.col("x").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(iterations):
        cast = votes.join(now, F.col("y") == F.col("node")).select("x", "label", "n").unionAll(now.select("node", "label", F.lit(1).cast("long")))
        counted = cast.groupBy("x", "label").agg(F.sum("n").alias("n"))
        after = materialized(counted.groupBy("x").agg(F.max("n").alias("most"), F.min(F.struct(-F.col("n"), "label")).alias("top")).select(F.col("x").alias("node"), F.col("top.label").alias("label")))
        same = after.join(now.select(F.col("node").alias("_node"), F.col("label").alias("_label")), F.col("node") == F.col("_node")).where(F.col("label") != F.col("_label")).isEmpty()
        now = after
        if same:
            break
    return now.select("node", F.col("label").alias("community"))


def nearest_vectors(df: DataFrame, id: str, vector: str, k: int = 5) -> DataFrame:
    """(a, rank, b, distance): the k nearest other vectors of each by Euclidean distance, ties to the smaller id.

    Rows are dealt to blocks of about BLOCK; each two blocks meet in one task, which keeps the k best of each row, so
    tasks and their memory are bounded whatever the number of rows.
    """
    rows = materialized(df.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v")))
    blocks = max(1, math.ceil(rows.count() / BLOCK))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    every = F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))
    left, right = dealt.withColumn("other", F.explode(every)), dealt.withColumnRenamed("block", "other").withColumn("block", F.explode(every))
    schema = T.StructType([T.StructField("a", rows.schema["id"].dataType), T.StructField("b", rows.schema["id"].dataType), T.StructField("distance", T.DoubleType())])

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"a": x.id[:0], "b": x.id[:0], "distance": np.zeros(0)})
        y = y.sort_values("id", ignore_index=True)
        p, q = np.stack(x.v.to_numpy()), np.stack(y.v.to_numpy())
        d = np.sqrt(np.maximum((p * p).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * p @ q.T, 0))
        d[x.id.to_numpy()[:, None] == y.id.to_numpy()[None, :]] = np.inf
        best = np.argsort(d, axis=1, kind="stable")[:, :k]
        made = pd.DataFrame({"a": np.repeat(x.id.to_numpy(), best.shape[1]), "b": y.id.to_numpy()[best.ravel()], "distance": np.take_along_axis(d, best, 1).ravel()})
        return made[np.isfinite(made.distance)]

    near = left.groupBy("block", "other").cogroup(right.groupBy("block", "other")).applyInPandas(run, schema)
    rank = F.row_number().over(Window.partitionBy("a").orderBy("distance", "b"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("a", "rank", "b", "distance")


def knn_clusters(df: DataFrame, id: str, vector: str, k: int = 5, iterations: int = 20) -> DataFrame:
    """(node, community): label propagation over the graph of shared nearest neighbours: rows are joined if one is
    among the k nearest of the other, as often as they share neighbours, and once for the link itself."""
    near = materialized(nearest_vectors(df, id, vector, k).select("a", "b"))
    pairs = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    of = near.groupBy("a").agg(F.collect_set("b").alias("own"))
    both = pairs.join(of, "a").join(of.select(F.col("a").alias("b"), F.col("own").alias("other")), "b")
    weight = F.size(F.array_intersect("own", "other")) + 1
    return communities(both.withColumn("_i", F.explode(F.sequence(F.lit(1), weight))), "a", "b", iterations)


def morans_i(points: DataFrame, value: str, k: int = 3) -> DataFrame:
    """(n, i): Moran's I of a value over points (id, lat, lon) with each point's k nearest as its neighbours, of equal
    weights. Null values take no part."""
    own = points.where(F.col(value).isNotNull())
    near = nearest_points(own, k)
    mean = own.agg(F.avg(value).alias("m"), F.count("*").alias("n"), F.var_pop(value).alias("v"))
    x = own.select("id", F.col(value).cast("double").alias("x"))
    both = near.join(x, F.col("a") == F.col("id")).select("b", F.col("x").alias("p")).join(x, F.col("b") == F.col("id")).select("p", F.col("x").alias("q")).crossJoin(F.broadcast(mean))
    made = both.agg(F.max("n").alias("n"), (F.sum((F.col("p") - F.col("m")) * (F.col("q") - F.col("m"))) / F.count("*")).alias("c"), F.max("v").alias("v"))
    return made.select("n", (F.col("c") / F.nullif("v", F.lit(0.0))).alias("i"))
