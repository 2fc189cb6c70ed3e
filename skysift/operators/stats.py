"""Statistics of a waterfall and the excision of disturbed channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Channels whose variance lies further than this from the mean variance, in its standard deviations, are excised.
EXCISE = 4.0


def row_stats(w: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, chan, mean, var): population variance as E[x^2] - E[x]^2."""
    keys = keys or []
    n, s, q = F.count("*"), F.sum("x"), F.sum(F.col("x") * F.col("x"))
    return w.groupBy(*keys, "chan").agg(n.alias("n"), s.alias("s"), q.alias("q")).select(*keys, "chan", (F.col("s") / F.col("n")).alias("mean"), (F.col("q") / F.col("n") - (F.col("s") / F.col("n")) * (F.col("s") / F.col("n"))).alias("var"))


def _global() -> list[Column]:
    m = F.avg("mean")
    return [m.alias("g_mean"), F.sqrt(F.avg(F.col("var") + F.col("mean") * F.col("mean")) - m * m).alias("g_std")]


def _variances() -> list[Column]:
    return [F.avg("var").alias("mean_var"), F.stddev_pop("var").alias("std_var")]


def global_stats(rows: DataFrame) -> DataFrame:
    """One row (mean, std) of the whole waterfall from its row statistics; rows are equally long."""
    return rows.agg(*_global()).toDF("mean", "std")


def variance_stats(rows: DataFrame) -> DataFrame:
    """One row (mean_var, std_var) of the row variances."""
    return rows.agg(*_variances())


def row_table(w: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Row statistics beside the global ones of their waterfall: as many rows as channels."""
    rows = row_stats(w, keys)
    if keys:
        return rows.join(rows.groupBy(*keys).agg(*_global(), *_variances()), keys)
    return rows.crossJoin(F.broadcast(rows.agg(*_global(), *_variances())))  # one row


def _bad():
    return F.abs(F.col("var") - F.col("mean_var")) > EXCISE * F.col("std_var")


def excise_zscore(w: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, chan, t, x, mask): x in standard deviations from the global mean; disturbed channels 0 with mask 0.

    keys: blocks, chunks or trials, each a waterfall of its own.
    """
    keys = keys or []
    joined = w.join(row_table(w, keys), [*keys, "chan"])
    return joined.select(*keys, "chan", "t", F.when(_bad(), 0.0).otherwise((F.col("x") - F.col("g_mean")) / F.col("g_std")).alias("x"), F.when(_bad(), 0.0).otherwise(1.0).alias("mask"))


def clean(w: DataFrame) -> DataFrame:
    """Disturbed channels set to 0, others as they are."""
    return w.join(row_table(w), "chan").select("chan", "t", F.when(_bad(), 0.0).otherwise(F.col("x")).alias("x"))


def quarter_scale(w: DataFrame) -> DataFrame:
    """Deviations from the global mean in quarters of its standard deviation."""
    return w.crossJoin(F.broadcast(global_stats(row_stats(w)))).select("chan", "t", ((F.col("x") - F.col("mean")) / (F.col("std") * 0.25)).alias("x"))


def dispersion_about(w: DataFrame, center: float) -> DataFrame:
    """(chan, disp): mean square distance from a given value."""
    d = F.col("x") - F.lit(center)
    return w.groupBy("chan").agg((F.sum(d * d) / F.count("*")).alias("disp"))


def largest(df: DataFrame, value: str) -> DataFrame:
    """One row with the largest value, whatever its sign."""
    return df.agg(F.max(value).alias(f"max_{value}"))


def moments(df: DataFrame, group: str, value: str) -> DataFrame:
    """n, min, max, mean, var, var_n, skew and kurtosis (not the excess), all mergeable."""
    v = F.col(value)
    return df.groupBy(group).agg(
        F.count(v).alias("n"), F.min(v).alias("min_v"), F.max(v).alias("max_v"), F.avg(v).alias("mean_v"), F.var_samp(v).alias("var_v"), F.var_pop(v).alias("var_n"), F.skewness(v).alias("skew"), (F.kurtosis(v) + 3).alias("kurt")
    )


def ratio(signal: DataFrame, norm: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, k, t, x): signal over the root of what a transform of ones gives."""
    by = [*(keys or []), "k", "t"]
    return signal.join(norm.withColumnRenamed("x", "n"), by).select(*by, (F.col("x") / F.sqrt(F.col("n") + 1e-8)).alias("x"))
