"""Blocks cut to overlapping chunks, and searches over streams of chunks and of recordings.

Chunks do not depend on one another, so a stream needs no state: each micro-batch
brings whole chunks as files of (block, chunk, chan, t, x), and its candidates are
written beside their block and chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skysift.operators import cluster, coherent, detect, stats
from skysift.plans.grids import chunks
from skysift.sources import raw

SCHEMA = "block long, chunk long, chan long, t long, x double"


def cut_chunks(samples: DataFrame, block: int, chunk: int, overlap: int) -> DataFrame:
    """(block, chan, t, x) with a chunk number; samples in overlaps belong to both chunks, t counts from the chunk's start."""
    table = samples.sparkSession.createDataFrame([(c.index, c.start, c.start + c.length) for c in chunks(block, chunk, overlap)], "chunk long, first long, past long")
    step = chunk - 2 * overlap
    # A sample lies in few chunks: those that begin in the step it lies in, or before it; the last chunk ends with the block.
    near = F.array_distinct(F.expr(f"transform(sequence(-{-(-chunk // step)}, 1), i -> least(greatest(cast(t div {step} as bigint) + i, 0L), {len(chunks(block, chunk, overlap)) - 1}L))"))
    return samples.withColumn("chunk", F.explode(near)).join(F.broadcast(table), "chunk").where("t >= first and t < past").select("block", "chunk", "chan", (F.col("t") - F.col("first")).alias("t"), "x")


def search(w: DataFrame, widths: list[int], threshold: float, gaps: tuple[int, int, int], keys: list[str] | None = None) -> DataFrame:
    """Delegates of waterfalls (keys, chan, t, x), with their clusters' sizes; keys tell the waterfalls apart."""
    found = detect.boxcar(stats.excise_zscore(w, keys), widths, threshold, keys=keys)
    return cluster.delegates(cluster.clusters(found, gaps, keys), keys)


def search_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, widths: list[int], threshold: float, gaps: tuple[int, int, int] = (2, 1, 2)) -> StreamingQuery:
    """Searches every chunk that arrives as Parquet in a folder; one row per delegate, partitioned by block and chunk.

    All chunks of a micro-batch go through together.  A micro-batch that is done
    again writes the same files' partitions over.
    """

    def each(batch: DataFrame, number: int) -> None:
        found = search(batch, widths, threshold, gaps, ["block", "chunk"])
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("block", "chunk").parquet(sink)

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 8).parquet(source)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def search_recordings_stream(spark: SparkSession, folder: str, sink: str, checkpoint: str, plan: coherent.SearchPlan) -> StreamingQuery:
    """The whole search of every chunk of the recordings that arrive in a folder; one row per delegate, partitioned by file, block and chunk.

    A micro-batch is a table of places; each chunk is read by the task that
    searches it.  A chunk lies in one micro-batch, and one that is done again
    writes the same partitions over, so a restart repeats nothing.
    """
    raw.register(spark)
    keys = ["file", "block", "chunk"]

    def each(batch: DataFrame, number: int) -> None:
        found = coherent.found_in(coherent.settled(coherent.chunk_candidates(batch, plan)), plan, keys)
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(sink)

    stream = spark.readStream.format("raw_chunks").option("length", plan.length).option("overlap", plan.overlap).load(folder)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
