"""Fourier transforms, dispersion filters and their products.

Complex numbers are two columns, re and im.  Transforms go through numpy by
Arrow; everything else stays in the JVM.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from skysift.plans.grids import K_CHIRP

_PAIR = T.StructType([T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("re", "im")])


@pandas_udf(_PAIR)
def fft(re: pd.Series, im: pd.Series) -> pd.DataFrame:
    """Forward transform, not normalised, of each row's arrays."""
    out = [np.fft.fft(np.asarray(a) + 1j * np.asarray(b)) for a, b in zip(re, im, strict=True)]
    return pd.DataFrame({"re": [z.real for z in out], "im": [z.imag for z in out]})


@pandas_udf(_PAIR)
def ifft(re: pd.Series, im: pd.Series) -> pd.DataFrame:
    """Inverse transform, divided by the length."""
    out = [np.fft.ifft(np.asarray(a) + 1j * np.asarray(b)) for a, b in zip(re, im, strict=True)]
    return pd.DataFrame({"re": [z.real for z in out], "im": [z.imag for z in out]})


def as_rows(df: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Samples gathered to one row of arrays re and im per key."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(index, "re", "im"))).alias("v")).select(*keys, F.col("v.re").alias("re"), F.col("v.im").alias("im"))


def transformed(df: DataFrame, keys: list[str], index: str, inverse: bool = False) -> DataFrame:
    """(keys, index, re, im) of each row's transform."""
    z = as_rows(df, keys, index).select(*keys, (ifft if inverse else fft)("re", "im").alias("z"))
    return z.select(*keys, F.posexplode(F.arrays_zip(F.col("z.re").alias("re"), F.col("z.im").alias("im"))).alias(index, "p")).select(*keys, F.col(index).cast("long").alias(index), "p.re", "p.im")


def long_transformed(df: DataFrame, keys: list[str], index: str, n1: int, n2: int, inverse: bool = False) -> DataFrame:
    """(keys, index, re, im): transforms of series of n1 times n2 samples each, which no task holds whole.

    Samples n2 apart are transformed together, turned by the product of their
    place and their frequency, and then those of one frequency are; so a task
    holds n1 or n2 of them, and a series is two shuffles.
    """
    i, n = F.col(index), n1 * n2
    apart = df.select(*keys, (i % n2).alias("_b"), F.floor(i / n2).cast("long").alias("_a"), "re", "im")
    first = transformed(apart, [*keys, "_b"], "_a", inverse)
    turn = (F.col("_a") * F.col("_b") % n) * F.lit((2 if inverse else -2) * np.pi / n)
    c, s = F.cos(turn), F.sin(turn)
    turned = first.select(*keys, "_a", "_b", (F.col("re") * c - F.col("im") * s).alias("re"), (F.col("re") * s + F.col("im") * c).alias("im"))
    return transformed(turned, [*keys, "_a"], "_b", inverse).select(*keys, (F.col("_a") + n1 * F.col("_b")).alias(index), "re", "im")


def subchannel_frequencies(bands: DataFrame, channels: int, subs: int) -> DataFrame:
    """(bands, chan, sub, f): centres of the sub-channels of each band; bands: f_min, bandwidth and any others."""
    bw = F.col("bandwidth") / channels
    chan, sub = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(channels - 1).cast("long"))), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(subs - 1).cast("long")))
    grid = bands.withColumn("chan", chan).withColumn("sub", sub)
    return grid.withColumn("f", F.col("f_min") + bw * (0.5 + F.col("chan")) + bw / subs * (F.col("sub") - F.lit(subs / 2) + 0.5))


def taper(bands: DataFrame, mbin: int, bw: Column) -> DataFrame:
    """(bands, bin, f, taper): offsets of bins from the centre of a sub-channel as wide as bw, and the filter that damps its edges."""
    f = -bw / 2 + (F.col("bin") + 0.5) * bw / F.lit(float(mbin))
    grid = bands.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(mbin - 1).cast("long"))))
    return grid.withColumn("f", f).withColumn("taper", 1 / F.sqrt(1 + F.pow(F.col("f") / (F.lit(0.47) * bw), F.lit(80.0))))


def chirp(bands: DataFrame, channels: int, subs: int, mbin: int) -> DataFrame:
    """(bands, chan, sub, bin, re, im): the filter that undoes the dispersion of each band's dm; phases are reduced to a turn before the trigonometry."""
    centres = subchannel_frequencies(bands, channels, subs).withColumnRenamed("f", "fc")
    grid = taper(centres, mbin, F.col("bandwidth") / channels / subs)
    phase = F.col("dm") * (F.col("f") / F.col("fc")) * (F.col("f") / F.col("fc")) / (F.col("fc") + F.col("f")) * F.lit(K_CHIRP)
    turn = (phase - F.floor(phase)) * F.lit(2 * np.pi)
    return grid.withColumns({"re": F.cos(turn) * F.col("taper"), "im": -F.sin(turn) * F.col("taper")}).drop("fc", "f", "taper")


def multiply(spectrum: DataFrame, by: DataFrame, on: list[str]) -> DataFrame:
    """Complex product on equal keys; filters are sent along only if Spark finds them small."""
    right = by.withColumnsRenamed({"re": "_re", "im": "_im"})
    a, b, c, d = (F.col(x) for x in ("re", "im", "_re", "_im"))
    return spectrum.join(right, on).withColumns({"re": a * c - b * d, "im": a * d + b * c}).drop("_re", "_im")
