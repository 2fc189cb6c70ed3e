"""Numbering and summing along a long axis, in tiles.

A tile is a range of the axis; what a tile needs of those before it comes from
one row per tile.  There are at most ``TILES`` of these, because tiles grow with
the axis, so the window over them stays small however long the axis is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of an axis in one tile, at least, and tiles at most.
TILE, TILES = 4096, 1_000_000


def tile_size(df: DataFrame, axis: str) -> int:
    """Values in a tile, from the axis' range; df is read once for it."""
    low, high = df.agg(F.min(axis), F.max(axis)).first()
    return TILE if low is None else max(TILE, int((high - low) // TILES) + 1)


def tile_of(axis: str, tile: int) -> Column:
    return F.floor(F.col(axis) / tile)


def before(group: list[str]):
    """A window over the tiles before a tile; group: columns, which may be none."""
    return Window.partitionBy(*group, F.lit(0)).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)


def numbered(df: DataFrame, group: list[str], axis: str, order: list, name: str, tile: int | None = None) -> DataFrame:
    """Adds each row's place, from 0, in its group by axis and then order; rows of one value of the axis share a task."""
    rows = df.withColumn("_tile", tile_of(axis, tile or tile_size(df, axis)))
    first = rows.groupBy(*group, "_tile").agg(F.count("*").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before(group)), F.lit(0))).drop("_n")
    at = F.row_number().over(Window.partitionBy(*group, "_tile").orderBy(axis, *order)) - 1
    return rows.withColumn("_at", at).join(first, [*group, "_tile"]).withColumn(name, (F.col("_first") + F.col("_at")).cast("long")).drop("_tile", "_at", "_first")
