"""Windowed detection: boxcars of several widths over every row.

Rows may be long, so they are cut into tiles of time; each tile also gets the
first samples of the next one, as many as the widest window needs, and windows
run over tiles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Samples of a tile.
TILE = 8192


def tiled(w: DataFrame, halo: int, tile: int = TILE) -> DataFrame:
    """Adds tile and own (false for samples lent by the next tile)."""
    tile = max(tile, halo + 1)
    own = F.struct((F.floor(F.col("t") / tile)).cast("long").alias("tile"), F.lit(True).alias("own"))
    lent = F.struct((F.floor(F.col("t") / tile) - 1).cast("long").alias("tile"), F.lit(False).alias("own"))
    both = F.when((F.col("t") % tile < halo) & (F.col("t") >= tile), F.array(own, lent)).otherwise(F.array(own))
    return w.withColumn("_at", F.explode(both)).select(*w.columns, "_at.tile", "_at.own")


def _sums(w: DataFrame, widths: list[int], of: str = "x", tile: int = TILE, keys: list[str] | None = None) -> DataFrame:
    """(keys, chan, t, width, s): sums over width samples from t on, where the window fits."""
    keys = keys or []
    base = Window.partitionBy(*keys, "chan", "tile").orderBy("t")
    cols = []
    for n in widths:
        frame = base.rowsBetween(0, n - 1)
        cols.append(F.when(F.count(of).over(frame) == n, F.sum(of).over(frame)).alias(f"s{n}"))
    wide = tiled(w, max(widths) - 1, tile).select(*keys, "chan", "t", "own", *cols)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("width"), F.col(f"s{n}").alias("s")) for n in widths]))
    return wide.where("own").select(*keys, "chan", "t", each.alias("b")).select(*keys, "chan", "t", "b.width", "b.s").where("s is not null")


def _snr():
    return F.col("s") / F.sqrt(F.col("width").cast("double"))


def boxcar(w: DataFrame, widths: list[int], threshold: float, log_index: bool = False, tile: int = TILE, keys: list[str] | None = None) -> DataFrame:
    """Candidates (keys, mt, mdt, mwidth, msnr) whose sum over the root of the width exceeds the threshold; mwidth may be the width's exponent."""
    found = _sums(w, widths, tile=tile, keys=keys).withColumn("msnr", _snr()).where((F.col("msnr") > threshold) & ~F.isnan("msnr"))
    width = F.log2(F.col("width").cast("double")).cast("long") if log_index else F.col("width").cast("long")
    return found.select(*(keys or []), F.col("t").alias("mt"), F.col("chan").alias("mdt"), width.alias("mwidth"), "msnr")


def below(cand: DataFrame, limit: float) -> DataFrame:
    """Candidates weaker than a limit."""
    return cand.where(F.col("msnr") < limit)


def boxcar_plan(w: DataFrame, widths: list[int], threshold: float) -> DataFrame:
    """(mdt, mt, n): how many widths give a candidate in each cell."""
    return _sums(w, widths).groupBy(F.col("chan").alias("mdt"), F.col("t").alias("mt")).agg(F.sum((_snr() > threshold).cast("int")).cast("long").alias("n"))


def best_detection(w: DataFrame, norm: DataFrame, widths: list[int], threshold: float, block: int = 256) -> DataFrame:
    """The single best window of x over the root of norm; windows do not cross blocks of columns."""
    scaled = w.join(norm.withColumnRenamed("x", "n"), ["chan", "t"]).select("chan", "t", (F.col("x") / F.sqrt(F.col("n") + 1e-7)).alias("x"))
    base = Window.partitionBy("chan", F.floor(F.col("t") / block)).orderBy("t")
    cols = [F.when(F.count("x").over(base.rowsBetween(0, n - 1)) == n, F.sum("x").over(base.rowsBetween(0, n - 1)) / F.sqrt(F.lit(float(n)))).alias(f"s{n}") for n in widths]
    both = F.array(*[F.struct(F.lit(n).cast("long").alias("width"), F.col(f"s{n}").alias("snr")) for n in widths])
    each = scaled.select("chan", "t", *cols).select("chan", "t", F.explode(both).alias("b")).where("b.snr is not null")
    key = F.struct(F.col("b.snr").alias("snr"), (-F.col("chan")).alias("c"), (-F.col("t")).alias("t"), (-F.col("b.width")).alias("w"))
    top = each.agg(F.max(key).alias("m"))
    return top.select((-F.col("m.c")).alias("irow"), (-F.col("m.t")).alias("icol"), (-F.col("m.w")).alias("iwidth"), F.col("m.snr").alias("snr")).where(F.col("snr") >= threshold)


def energy_ratio(w: DataFrame, norm: DataFrame, widths: list[int], threshold: float) -> DataFrame:
    """(chan, t, width, snr): root of the signal's energy over the norm's in each window."""
    squares = w.join(norm.withColumnRenamed("x", "n"), ["chan", "t"]).select("chan", "t", (F.col("x") * F.col("x")).alias("x"), (F.col("n") * F.col("n")).alias("n"))
    top = _sums(squares.select("chan", "t", "x"), widths)
    low = _sums(squares.select("chan", "t", "n"), widths, of="n").withColumnRenamed("s", "sn")
    return top.join(low, ["chan", "t", "width"]).select("chan", "t", F.col("width").cast("long").alias("width"), F.sqrt(F.col("s") / F.col("sn")).alias("snr")).where(F.col("snr") >= threshold)
