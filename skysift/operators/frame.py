"""Framing, rolling, transposing and scaling of samples in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlap_frames(samples: DataFrame, nbin: int, nfft: int, overlap: int, keys: list[str], values: list[str]) -> DataFrame:
    """Frames of nbin samples that overlap by ``overlap`` on each side: (keys, fft, bin, values), 0 outside the samples.

    samples: (keys, isamp, values), one for each isamp below (nbin - 2 overlap) nfft,
    or some more: these end the last frame, as far as it reaches.
    Each goes to the few frames that hold it; only the edges before the first and
    after the last sample are made up, 2 overlap rows for each of the keys at most.
    """
    step = nbin - 2 * overlap
    if step < overlap:
        raise ValueError("a frame must hold more than three overlaps")
    last = f"least(floor((isamp + {overlap}) / {step}), {nfft - 1})"
    first = f"greatest(ceil((isamp + {overlap - nbin + 1}) / {step}), 0)"
    held = samples.where(f"{first} <= {last}")  # samples after the last frame have none
    inner = held.select(*keys, "isamp", *values, F.explode(F.expr(f"sequence(cast({first} as bigint), cast({last} as bigint))")).alias("fft"))
    inner = inner.select(*keys, "fft", (F.col("isamp") + overlap - step * F.col("fft")).alias("bin"), *values)
    if not overlap:
        return inner
    if nfft < 1:
        return inner
    edge = F.explode(F.expr(f"flatten(transform(sequence(0, {overlap - 1}), i -> array(struct(0L as fft, cast(i as bigint) as bin), struct({nfft - 1}L as fft, cast({nbin - overlap} + i as bigint) as bin))))"))
    outer = samples.groupBy(*keys).agg(F.max("isamp").alias("_last")).select(*keys, "_last", edge.alias("e"))
    at = F.col("e.bin") - overlap + step * F.col("e.fft")
    outer = outer.where((at < 0) | (at > F.col("_last")))
    return inner.unionByName(outer.select(*keys, "e.fft", "e.bin", *[F.lit(0).cast(samples.schema[v].dataType).alias(v) for v in values]))


def fft_shift(df: DataFrame, index: str, n: int, values: list[str], scale: float = 1.0) -> DataFrame:
    """Halves of the index swapped, values times scale."""
    return df.withColumns({index: (F.col(index) + n // 2) % n} | {v: F.col(v) * scale for v in values})


def roll(df: DataFrame, index: str, n: int, by: int) -> DataFrame:
    """Circular shift to the right."""
    return df.withColumn(index, F.pmod(F.col(index) + by, F.lit(n)))


def power(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x): squared magnitude summed over polarisations."""
    return df.groupBy(*keys).agg(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("x"))


def rolled_power(df: DataFrame, nbin: int) -> DataFrame:
    """Rolled by half a row, over nbin squared, summed over polarisations."""
    half = df.withColumn("bin", F.pmod(F.col("bin") + nbin // 2, F.lit(nbin)))
    return power(half, ["fft", "chan", "bin"]).withColumn("x", F.col("x") / float(nbin * nbin))


def unpad_transpose(df: DataFrame, mbin: int, overlap: int, subs: int, channels: int, *values: str) -> DataFrame:
    """(fft, sub, chan, bin, values) without the overlap, frequencies reversed, as (row, t, values); complex samples are two values."""
    kept = mbin - 2 * overlap
    row = F.col("sub") * channels + channels - 1 - F.col("chan")
    inner = df.where((F.col("bin") >= overlap) & (F.col("bin") < mbin - overlap)).withColumn("sub", subs - 1 - F.col("sub"))
    return inner.select(row.alias("row"), (F.col("bin") - overlap + kept * F.col("fft")).alias("t"), *values)


def transpose(df: DataFrame, row: str, column: str) -> DataFrame:
    return df.select(F.col(column).alias(row), F.col(row).alias(column), *[c for c in df.columns if c not in (row, column)])


def digitize(df: DataFrame, value: str, bits: int = 11) -> DataFrame:
    """Whole numbers of value times 2^bits over the maximum, truncated."""
    top = df.agg(F.max(value).alias("_max"))
    scaled = F.col(value) * float(1 << bits) / F.col("_max")
    return df.crossJoin(F.broadcast(top)).withColumn("q", F.when(scaled < 0, F.ceil(scaled)).otherwise(F.floor(scaled)).cast("long")).drop("_max")


def scale_complex(df: DataFrame, by: float) -> DataFrame:
    return df.withColumns({"re": F.col("re") * by, "im": F.col("im") * by})


def cut(df: DataFrame, row: int, column: int, rows: int, columns: int, dim: int) -> DataFrame:
    """A square of dim around a place, moved inside the image; row and column count from its corner."""
    r0, c0 = max(0, min(row - dim // 2, rows - dim)), max(0, min(column - dim // 2, columns - dim))
    inside = F.col("r").between(r0, r0 + dim - 1) & F.col("c").between(c0, c0 + dim - 1)
    return df.where(inside).withColumns({"r": F.col("r") - r0, "c": F.col("c") - c0})


def image_levels(df: DataFrame) -> DataFrame:
    """Flipped upside down and scaled to whole numbers of 255 over the largest magnitude."""
    top = df.agg(F.max(F.abs("x")).alias("_max"), F.max("r").alias("_last"))  # one row
    level = F.abs(F.col("x")) * 255.0 / F.col("_max")
    return df.crossJoin(F.broadcast(top)).select((F.col("_last") - F.col("r")).alias("r"), "c", (F.floor(level) * F.when(F.col("x") < 0, -1).otherwise(1)).cast("long").alias("level"))


def floored(df: DataFrame, value: str) -> DataFrame:
    return df.withColumn(value, F.floor(value).cast("double"))
