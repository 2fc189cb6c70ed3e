"""Scalar plans as columns, for tables of observations that each have their own band, sample time and pulse.

The same numbers as in ``grids``, which plans one search on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.plans.grids import K_MAX_DT, K_OVERLAP, K_TRANSFORM


def delay(f0: Column, f1: Column, k: Column | float = 1.0) -> Column:
    return (k if isinstance(k, Column) else F.lit(k)) * (1 / (f0 * f0) - 1 / (f1 * f1))


def half_away(x: Column) -> Column:
    return (F.floor(F.abs(x) + 0.5) * F.signum(x)).cast("long")


def optimal_overlap(d_max: Column, f_min: Column, chan_bw: Column, len_sft: Column, t_sample: Column) -> Column:
    """Half the longest delay within the lowest sub-channel, in samples, as a power of two."""
    samples = half_away(delay(f_min, f_min + chan_bw / len_sft, F.lit(K_OVERLAP) * d_max) / t_sample) / 2
    return F.when(samples > 0, F.pow(F.lit(2.0), F.floor(F.log2(samples) + 0.5))).otherwise(0.0).cast("long")


def coherent_count(d_max: Column, f_min: Column, f_max: Column, t_sample: Column, pulse: Column) -> Column:
    return F.ceil(delay(f_min, f_max, F.lit(K_OVERLAP) * d_max) * t_sample / (pulse * pulse)).cast("long")


def sub_channels(pulse: Column, t_sample: Column) -> Column:
    return F.ceil(pulse / t_sample).cast("long")


def max_dt(f_min: Column, f_max: Column, pulse: Column, dm_max: Column) -> Column:
    """Rows of the transform; at least 1."""
    td = delay(f_min, f_max, F.lit(K_MAX_DT) * dm_max)
    t_tel = F.lit(1e-6) / (f_max - f_min)
    ratio = (td / t_tel) / ((pulse / t_tel) * (pulse / t_tel))
    return F.when(ratio == 0, 1).otherwise(F.greatest(F.lit(1), F.floor(td / F.nullif(ratio, F.lit(0.0)) / pulse))).cast("long")


def dm_grid(observations: DataFrame, d_min: str, d_max: str, n: str) -> DataFrame:
    """Each observation with i and dm: steps of d_max / n from d_min on."""
    step = F.col(d_max) / F.col(n)
    count = F.floor((F.col(d_max) - F.col(d_min)) / step).cast("long")
    rows = observations.where(count > 0).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    return rows.withColumn("dm", F.col(d_min) + F.col("i") * step)


def delay_measures(observations: DataFrame, f_min: str, f_max: str, t_sample: str, dt_max: str) -> DataFrame:
    """Each observation with the dispersion measure of each of a transform's delays, in samples from 0 on."""
    rows = observations.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col(dt_max).cast("long"))))
    return rows.withColumn("dm", F.col("i") * F.col(t_sample) / delay(F.col(f_min), F.col(f_max), K_TRANSFORM))
