"""Ordered passes along chromosomes, tile by tile: one exchange by tile, and one row a tile that crosses into others.

A tile has a fixed number of places, so that no task holds a chromosome. What lies in other tiles of the chromosome
reaches a row by a window over one summary row a tile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

#: A tile has 2 ^ TILE places.
TILE = 14
KEYS = ["chrom", "tile"]


def tiled(df: DataFrame, at: str = "at") -> DataFrame:
    """``df`` (chrom, and a place) with ``tile``, dealt out by tile."""
    return df.withColumn("tile", F.expr(f"shiftright(`{at}`, {TILE})")).repartition(*KEYS)


def inside(*order: Column | str) -> WindowSpec:
    """The rows of a tile up to the current one."""
    return Window.partitionBy(*KEYS).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def others(back: bool = False) -> WindowSpec:
    """The tiles of a chromosome before the current one, or behind it."""
    return Window.partitionBy("chrom").orderBy(F.desc("tile") if back else "tile").rowsBetween(Window.unboundedPreceding, -1)


def with_tiles(df: DataFrame, tiles: DataFrame) -> DataFrame:
    """``df`` with what was made for its tiles; rows without a chromosome or place have nulls."""
    of = tiles.withColumnsRenamed({k: f"_{k}" for k in KEYS})
    return df.join(of, [F.col(k) == F.col(f"_{k}") for k in KEYS], "left").drop(*[f"_{k}" for k in KEYS])
