"""Prefix sums over one long order, in tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skysift.operators.tiles import before, tile_of, tile_size


def prefix_sum(df: DataFrame, index: str, value: str, exclusive: bool = False, tile: int | None = None) -> DataFrame:
    """(index, total): running sums in index order; exclusive ones leave the row itself out.

    Each tile of the index is summed on its own and starts after those before it.
    """
    rows = df.select(index, value).withColumn("_tile", tile_of(index, tile or tile_size(df, index)))
    start = rows.groupBy("_tile").agg(F.sum(value).alias("_s")).withColumn("_start", F.coalesce(F.sum("_s").over(before([])), F.lit(0))).drop("_s")
    inner = Window.partitionBy("_tile").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    total = F.col("_start") + F.sum(value).over(inner) - (F.col(value) if exclusive else F.lit(0))
    return rows.join(start, "_tile").select(index, total.alias("total"))


def permuted_prefix_sum(order: DataFrame, heap: DataFrame, value: str) -> DataFrame:
    """Running sums, led by 0, of values read through (i, pos); places that the heap (pos, value) lacks count as 0."""
    read = order.join(heap, "pos", "left").select((F.col("i") + 1).alias("i"), F.coalesce(value, F.lit(0)).alias("v"))
    lead = order.sparkSession.sql("select 0L as i, 0L as v")
    return prefix_sum(read.unionByName(lead), "i", "v")
