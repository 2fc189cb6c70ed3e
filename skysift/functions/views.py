"""Views of plain tables as the arrays that a search works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHANNELS = 32


def waterfall(spark: SparkSession, sf_dir: str, channels: int = CHANNELS, multiple: int = 1) -> DataFrame:
    """(chan, t, x): events summed by channel and hour on a dense grid from the first hour to the last, 0 where nothing is.

    The grid may go on to a multiple of so many hours.  Sums are of whole numbers,
    so they do not depend on the order of the rows.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000).cast("long")
    sums = events.groupBy((F.col("user_id") % channels).alias("chan"), hour.alias("hour")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).cast("double").alias("x"))
    ends = sums.agg(F.min("hour").alias("first"), F.max("hour").alias("last"))  # one row
    grid = spark.range(channels).crossJoin(F.broadcast(ends)).select(F.col("id").alias("chan"), "first", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil((F.col("last") - F.col("first") + 1) / multiple).cast("long") * multiple - 1)).alias("t"))
    return grid.join(sums.withColumnRenamed("chan", "_chan"), (F.col("chan") == F.col("_chan")) & (F.col("t") + F.col("first") == F.col("hour")), "left").select("chan", "t", F.coalesce("x", F.lit(0.0)).alias("x"))


def hours(w: DataFrame) -> int:
    """Samples of a waterfall's rows."""
    last = w.agg(F.max("t")).first()[0]
    return 0 if last is None else last + 1


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(r, c, x): embeddings times 1000 in whole numbers."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vectors.select(F.col("vec_id").alias("r"), F.posexplode("embedding").alias("c", "e")).select("r", F.col("c").cast("long").alias("c"), F.floor(F.col("e").cast("double") * 1000 + 0.5).cast("double").alias("x"))


def raw_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mt, mdt, mwidth, msnr) from all lineitems, for stress on clustering."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return items.select(F.col("l_orderkey").alias("mt"), F.col("l_partkey").alias("mdt"), F.col("l_linenumber").cast("long").alias("mwidth"), F.col("l_extendedprice").alias("msnr"))


def rounded(column, digits: int = 6):
    """To so many digits, without a negative zero."""
    return F.round(column, digits) + F.lit(0.0)
