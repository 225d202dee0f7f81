"""Images as pixel tables (image, y, x, value): thresholds, objects, distances to the background, and watersheds.

Pixels meet in tiles of bounded size; what crosses a tile's border goes through joins of border pixels, so an object may
lie on any number of tiles, and no task holds an image.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.ordinals import materialized, ordinal
from .learning import components

#: Rows and columns of a tile.
TILE = 256
_FAR = 1 << 30
#: Half of a pixel's neighbours: each pair of neighbours is met from one side.
_AHEAD = [(0, 1), (1, 0)], [(0, 1), (1, 0), (1, 1), (1, -1)]


def otsu(pixels: DataFrame, bins: int = 256) -> DataFrame:
    """(image, threshold): the cut between values that separates the two sides' means best (the greatest variance between
    them), on a histogram of each image's range. Pixels of the threshold or more are foreground. Of equally good cuts the
    lowest; null for an image of one value. Null values take no part."""
    own = pixels.where("value IS NOT NULL").select("image", F.col("value").cast("double").alias("v"))
    edges = own.groupBy(F.col("image").alias("_i")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    counts = own.join(edges, F.col("image").eqNullSafe(F.col("_i"))).where("hi > lo").groupBy("image", "lo", "hi", at.alias("bin")).agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    upto = Window.partitionBy("image").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("image")
    split = counts.withColumns({"w": F.sum("n").over(upto), "m": F.sum("s").over(upto), "all_n": F.sum("n").over(every), "all_s": F.sum("s").over(every)}).where("w < all_n")
    apart = F.col("m") / F.col("w") - (F.col("all_s") - F.col("m")) / (F.col("all_n") - F.col("w"))
    between = F.col("w").cast("double") * (F.col("all_n") - F.col("w")) * apart * apart
    best = split.groupBy("image").agg(F.max(F.struct(between.alias("b"), (-F.col("bin")).alias("at"), "lo", "hi")).alias("x"))
    cut = best.select("image", (F.col("x.lo") + (1 - F.col("x.at")) * (F.col("x.hi") - F.col("x.lo")) / bins).alias("threshold"))
    return edges.select("_i").join(cut, F.col("_i").eqNullSafe(F.col("image")), "left").select(F.col("_i").alias("image"), "threshold")


def foreground(pixels: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """The pixels that reach their image's threshold (image, threshold), Otsu's if none are given."""
    cuts = (otsu(pixels) if thresholds is None else thresholds).select(F.col("image").alias("_i"), "threshold")
    return pixels.join(cuts, F.col("image").eqNullSafe(F.col("_i"))).where(F.col("value") >= F.col("threshold")).drop("_i", "threshold")


def _code():
    return F.shiftleft(F.col("y").cast("long"), 31) + F.col("x")


def _least(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index reachable from each of n nodes."""
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


def _neighbours(pixels: DataFrame, steps: list[tuple[int, int]], *more: str) -> DataFrame:
    """Pairs of pixels one of the steps apart: columns, and those of the other as o_*."""
    moved = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps]))
    left = pixels.withColumn("_s", moved).withColumns({"_y": F.col("y") + F.col("_s.dy"), "_x": F.col("x") + F.col("_s.dx")}).drop("_s")
    right = pixels.select(F.col("image").alias("_i"), F.col("y").alias("o_y"), F.col("x").alias("o_x"), *[F.col(c).alias(f"o_{c}") for c in more])
    return left.join(right, F.col("image").eqNullSafe(F.col("_i")) & (F.col("_y") == F.col("o_y")) & (F.col("_x") == F.col("o_x"))).drop("_i", "_y", "_x")


def objects(pixels: DataFrame, diagonal: bool = True, min_area: int = 1, tile: int = TILE) -> DataFrame:
    """The pixels with ``object``, the number from 1 of their connected group in the image, by its first pixel in rows;
    groups of fewer than ``min_area`` pixels are left out. Pixels touch at sides, and at corners if ``diagonal``.

    A tile's pixels are labelled in one task; labels of neighbouring tiles are tied by pixels on their borders, and the
    components of these ties are the objects. Pixels (image, y, x) are unique, y and x not negative."""
    steps = _AHEAD[diagonal]
    own = materialized(pixels.withColumns({"_ty": F.floor(F.col("y") / tile), "_tx": F.floor(F.col("x") / tile)}))
    keys = own.select("image", "y", "x", "_ty", "_tx")
    kind = keys.schema["image"].dataType.simpleString()

    def label(frame: pd.DataFrame) -> pd.DataFrame:
        y, x = frame["y"].to_numpy(np.int64), frame["x"].to_numpy(np.int64)
        order = np.lexsort((x, y))
        y, x = y[order], x[order]
        grid = np.full((tile + 2, tile + 2), -1, np.int64)
        oy, ox = y - y // tile * tile + 1, x - x // tile * tile + 1
        grid[oy, ox] = np.arange(len(y))
        ends = [(np.arange(len(y)), grid[oy + dy, ox + dx]) for dy, dx in steps]
        a, b = (np.concatenate([e[k][e[1] >= 0] for e in ends]) for k in (0, 1))
        first = _least(len(y), a, b)
        return pd.DataFrame({"image": frame["image"].iat[0], "y": y, "x": x, "root": (y[first] << 31) + x[first]})

    rooted = materialized(keys.groupBy("image", "_ty", "_tx").applyInPandas(label, f"image {kind}, y long, x long, root long"))
    border = rooted.where((F.pmod("y", F.lit(tile)).isin(0, tile - 1)) | (F.pmod("x", F.lit(tile)).isin(0, tile - 1)))
    ties = _neighbours(border, steps, "root").where("root <> o_root").select(F.struct("image", "root").alias("a"), F.struct("image", F.col("o_root").alias("root")).alias("b"))
    ties = materialized(ties.distinct())
    if ties.isEmpty():
        found = rooted.withColumn("group", F.col("root"))
    else:
        tied = components(ties, "a", "b")
        found = rooted.join(tied, F.struct("image", "root") == F.col("node"), "left").withColumn("group", F.coalesce("component.root", "root")).drop("node", "component")
    sizes = materialized(found.groupBy("image", "group").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_area))
    numbers = ordinal(sizes, ["image", "group"], "_at")
    before = numbers.groupBy("image").agg(F.min("_at").alias("_first")).withColumnRenamed("image", "_im")
    numbers = numbers.join(before, F.col("image").eqNullSafe(F.col("_im"))).select(F.col("image").alias("_i"), F.col("group").alias("_g"), (F.col("_at") - F.col("_first") + 1).alias("object"))
    named = found.join(numbers, F.col("image").eqNullSafe(F.col("_i")) & (F.col("group") == F.col("_g"))).select(F.col("image").alias("_i"), F.col("y").alias("_y"), F.col("x").alias("_x"), "object")
    return own.join(named, F.col("image").eqNullSafe(F.col("_i")) & (F.col("y") == F.col("_y")) & (F.col("x") == F.col("_x"))).select(*pixels.columns, "object")


def measured(labelled: DataFrame) -> DataFrame:
    """(image, object, area, y, x, top, left, bottom, right, mean, diameter, major, minor, eccentricity, solidity,
    perimeter) of objects (image, y, x, value, object): centre, box, mean value, the diameter of a circle of that area,
    the axes of the ellipse of the pixels' sample covariance, the share of the box, and the sides of pixels that border
    on no other pixel of the object."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    facts = labelled.groupBy("image", "object").agg(
        F.count("*").alias("area"), F.avg(y).alias("cy"), F.avg(x).alias("cx"), F.min("y").alias("top"), F.min("x").alias("left"), F.max("y").alias("bottom"), F.max("x").alias("right"), F.avg("value").alias("mean"),
        F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("vxy"),
    )
    inner = _neighbours(labelled.select("image", "y", "x", "object"), _AHEAD[0], "object").where("object = o_object").groupBy(F.col("image").alias("_i"), F.col("object").alias("_o")).agg(F.count("*").alias("touching"))
    both = facts.join(inner, F.col("image").eqNullSafe(F.col("_i")) & (F.col("object") == F.col("_o")), "left")
    n = F.col("area")
    scale = F.when(n > 1, n / (n - 1)).otherwise(F.lit(0.0))
    half, root = (F.col("vx") + F.col("vy")) / 2, F.sqrt(F.pow((F.col("vx") - F.col("vy")) / 2, F.lit(2.0)) + F.col("vxy") * F.col("vxy"))
    both = both.withColumns({"major": 2 * F.sqrt(F.greatest(scale * (half + root), F.lit(0.0))), "minor": 2 * F.sqrt(F.greatest(scale * (half - root), F.lit(0.0)))})
    eccentricity = F.when(F.col("major") > 0, F.sqrt(F.greatest(1 - F.pow(F.col("minor") / F.col("major"), F.lit(2.0)), F.lit(0.0)))).otherwise(0.0)
    box = (F.col("bottom") - F.col("top") + 1) * (F.col("right") - F.col("left") + 1)
    return both.select(
        "image", "object", "area", F.col("cy").alias("y"), F.col("cx").alias("x"), "top", "left", "bottom", "right", "mean", (2 * F.sqrt(n / F.pi())).alias("diameter"), "major", "minor",
        eccentricity.alias("eccentricity"), (n / box).alias("solidity"), (4 * n - 2 * F.coalesce("touching", F.lit(0))).alias("perimeter"),
    )


def distances(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """The pixels with ``distance``, the steps to sides from each to the nearest place that is no pixel of its image.

    Each round settles every tile with the border of its neighbours as it stands, and rounds go on until nothing falls:
    as many as tiles that a shortest way crosses."""
    own = materialized(pixels.select("image", "y", "x", F.lit(_FAR).cast("long").alias("distance")))
    kind = own.schema["image"].dataType.simpleString()

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        y, x = frame["y"].to_numpy(np.int64), frame["x"].to_numpy(np.int64)
        top, left = int(frame["_ty"].iat[0]) * tile - 1, int(frame["_tx"].iat[0]) * tile - 1
        d = np.zeros((tile + 2, tile + 2), np.int64)
        d[y - top, x - left] = frame["distance"].to_numpy(np.int64)
        while True:
            step = np.minimum(np.minimum(d[:-2, 1:-1], d[2:, 1:-1]), np.minimum(d[1:-1, :-2], d[1:-1, 2:])) + 1
            new = np.minimum(d[1:-1, 1:-1], step)
            if (new == d[1:-1, 1:-1]).all():
                break
            d[1:-1, 1:-1] = new
        inside = (y > top) & (y <= top + tile) & (x > left) & (x <= left + tile)
        return pd.DataFrame({"image": frame["image"].iat[0], "y": y[inside], "x": x[inside], "distance": d[y[inside] - top, x[inside] - left]})

    total = None
    while True:
        # a pixel goes to its own tile, and beside it if it lies on the border
        ty, tx = F.floor(F.col("y") / tile), F.floor(F.col("x") / tile)
        side = lambda c: F.when(F.pmod(c, F.lit(tile)) == 0, F.array(F.lit(0), F.lit(-1))).when(F.pmod(c, F.lit(tile)) == tile - 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        filed = own.withColumn("_dy", F.explode(side(F.col("y")))).withColumn("_dx", F.explode(side(F.col("x")))).select("image", "y", "x", "distance", (ty + F.col("_dy")).alias("_ty"), (tx + F.col("_dx")).alias("_tx"))
        own = materialized(filed.groupBy("image", "_ty", "_tx").applyInPandas(settle, f"image {kind}, y long, x long, distance long"))
        now = own.agg(F.sum("distance")).first()[0]
        if now == total or now is None:
            return pixels.join(own.select(F.col("image").alias("_i"), F.col("y").alias("_y"), F.col("x").alias("_x"), "distance"), F.col("image").eqNullSafe(F.col("_i")) & (F.col("y") == F.col("_y")) & (F.col("x") == F.col("_x"))).select(*pixels.columns, "distance")
        total = now


def watershed(pixels: DataFrame, depth: int = 2, tile: int = TILE) -> DataFrame:
    """The pixels with ``basin``, the number from 1 in the image of the part of an object that they belong to.

    Parts are the basins of the ``distances`` to the background: each pixel points to its highest neighbour (of equal ones
    the first in rows), a peak is higher than all of its neighbours, and pointers lead there by doubling. Two basins that
    touch are one if the pass between them lies less than ``depth`` below the lower peak."""
    far = materialized(distances(pixels.select("image", "y", "x"), tile).withColumn("code", _code()))
    every = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)]
    beside = _neighbours(far, every, "distance", "code")
    best = beside.groupBy("image", "code", "distance").agg(F.max(F.struct(F.col("o_distance").alias("d"), (-F.col("o_code")).alias("c"))).alias("x"))
    higher = best.where(F.struct("x.d", "x.c") > F.struct(F.col("distance").alias("d"), (-F.col("code")).alias("c")))
    links = higher.select(F.struct("image", "code").alias("node"), F.struct("image", (-F.col("x.c")).alias("code")).alias("to"))
    ends = _followed(links)
    peaks = far.join(ends, F.struct("image", "code") == F.col("node"), "left").withColumn("peak", F.coalesce("last.code", "code")).drop("node", "last")
    peaks = materialized(peaks)
    heights = peaks.where("code = peak").select(F.col("image").alias("_i"), F.col("code").alias("_c"), F.col("distance").alias("height"))
    passes = _neighbours(peaks, _AHEAD[1], "distance", "peak").where("peak <> o_peak").groupBy("image", F.least("peak", "o_peak").alias("p"), F.greatest("peak", "o_peak").alias("q")).agg(F.max(F.least("distance", "o_distance")).alias("saddle"))
    low = passes.join(heights.select("_i", F.col("_c").alias("p"), F.col("height").alias("hp")), ["p"]).where(F.col("image").eqNullSafe(F.col("_i"))).drop("_i")
    low = low.join(heights.select("_i", F.col("_c").alias("q"), F.col("height").alias("hq")), ["q"]).where(F.col("image").eqNullSafe(F.col("_i")))
    ties = materialized(low.where(F.least("hp", "hq") - F.col("saddle") < depth).select(F.struct("image", F.col("p").alias("code")).alias("a"), F.struct("image", F.col("q").alias("code")).alias("b")))
    if ties.isEmpty():
        grouped = peaks.withColumn("group", F.col("peak"))
    else:
        grouped = peaks.join(components(ties, "a", "b"), F.struct("image", F.col("peak").alias("code")) == F.col("node"), "left").withColumn("group", F.coalesce("component.code", "peak"))
    grouped = materialized(grouped.select("image", "y", "x", "distance", "group"))
    numbers = ordinal(grouped.groupBy("image", "group").agg(F.min(_code()).alias("_first")), ["image", "_first"], "_at")
    before = numbers.groupBy(F.col("image").alias("_im")).agg(F.min("_at").alias("_least"))
    named = numbers.join(before, F.col("image").eqNullSafe(F.col("_im"))).select(F.col("image").alias("_i"), F.col("group").alias("_g"), (F.col("_at") - F.col("_least") + 1).alias("basin"))
    found = grouped.join(named, F.col("image").eqNullSafe(F.col("_i")) & (F.col("group") == F.col("_g"))).select(F.col("image").alias("_i"), F.col("y").alias("_y"), F.col("x").alias("_x"), "distance", "basin")
    return pixels.join(found, F.col("image").eqNullSafe(F.col("_i")) & (F.col("y") == F.col("_y")) & (F.col("x") == F.col("_x"))).select(*pixels.columns, "distance", "basin")


def _followed(links: DataFrame) -> DataFrame:
    """(node, last): where pointers (node, to), which make no ring, end; by doubling."""
    now = materialized(links)
    while True:
        ahead = now.select(F.col("node").alias("_n"), F.col("to").alias("_to"))
        after = materialized(now.join(ahead, F.col("to") == F.col("_n"), "left").select("node", F.coalesce("_to", "to").alias("to"), F.col("_to").isNotNull().alias("moved")))
        now = after.select("node", "to")
        if after.where("moved").isEmpty():
            return now.select("node", F.col("to").alias("last"))
